"""Probability expressions built from model coefficients; no UDFs, null features give null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """A softmax model: one row of weights per class over ``features``."""

    features: tuple[str, ...]
    labels: tuple[str, ...]
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    #: steps of the fit and whether it ended before its limit; None for a model that was not fitted here
    iterations: int | None = None
    converged: bool | None = None

    def relative_to_first(self) -> LinearModel:
        """The same probabilities, written with the first class as the zero baseline."""
        b0, w0 = self.intercepts[0], self.weights[0]
        return LinearModel(
            self.features, self.labels,
            tuple(b - b0 for b in self.intercepts),
            tuple(tuple(w - v for w, v in zip(row, w0)) for row in self.weights),
            self.iterations, self.converged,
        )

    def probability(self, label: str) -> Column:
        """Share of one class, as ``1 / sum(exp(score_j - score_label))``.

        Score differences are linear in the features, so nothing has to be shifted for
        stability and the expression stays flat enough to be pushed into filters. Null for
        a class the model has not seen.
        """
        if label not in self.labels:
            return F.lit(None).cast("double")
        i = self.labels.index(label)
        total = F.lit(1.0)
        for j in range(len(self.labels)):
            if j != i:
                gap = [w - v for w, v in zip(self.weights[j], self.weights[i])]
                total = total + F.exp(linear(self.intercepts[j] - self.intercepts[i], gap, self.features))
        return F.lit(1.0) / total

    def predicted(self) -> Column:
        """Most probable class, from scores alone; ties go to the earlier class, null features give null."""
        out = None
        for i, label in enumerate(self.labels):
            best = F.lit(True)
            for j in range(len(self.labels)):
                if j != i:
                    weights = [w - v for w, v in zip(self.weights[j], self.weights[i])]
                    gap = linear(self.intercepts[j] - self.intercepts[i], weights, self.features)
                    best = best & (gap < 0 if j < i else gap <= 0)
            out = F.when(best, F.lit(label)) if out is None else out.when(best, F.lit(label))
        return out

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(label, term, coefficient); a few rows, bounded by classes x features."""
        rows = [
            (label, term, float(value))
            for label, b, w in zip(self.labels, self.intercepts, self.weights)
            for term, value in zip(("intercept", *self.features), (b, *w))
        ]
        return spark.createDataFrame(rows, "label string, term string, coefficient double")


def linear(intercept: float, weights: Sequence[float], features: Sequence[str]) -> Column:
    out = F.lit(float(intercept))
    for w, f in zip(weights, features):
        out = out + F.lit(float(w)) * F.col(f)
    return out


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def binary_probability(intercept: float, weights: Sequence[float], features: Sequence[str]) -> Column:
    return logistic(linear(intercept, weights, features))


def add_class_probabilities(
    df: DataFrame,
    model: LinearModel | Mapping[object, LinearModel],
    names: Mapping[str, str],
    *,
    model_key: str | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Append one probability column per class.

    ``names`` maps a class to its output column. ``model`` is one model, or one per
    value of ``model_key`` (e.g. per season); rows without a model get null. ``where``
    restricts scoring, leaving null elsewhere, so scores need not be joined back.
    """
    models = {None: model} if isinstance(model, LinearModel) else dict(model)
    features = sorted({f for m in models.values() for f in m.features})
    usable = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    for f in features:
        usable = usable & F.col(f).isNotNull()

    def share(label: str) -> Column:
        if set(models) == {None}:
            return F.when(usable, models[None].probability(label))
        out = None
        for key, m in models.items():
            hit = usable & (F.col(model_key) == F.lit(key))
            out = F.when(hit, m.probability(label)) if out is None else out.when(hit, m.probability(label))
        return out

    return df.withColumns({column: share(label) for label, column in names.items()})
