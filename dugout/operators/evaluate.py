"""Losses, confusion tables and model comparison, all as aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions.columns import ratio

#: added to a class probability before its logarithm
MULTICLASS_EPSILON = 1e-15


def binary_loss(label: Column, probability: Column, eps: float = 1e-15) -> Column:
    """Log loss of one 0/1 prediction, clipped away from certainty; null when unscored."""
    p = F.greatest(F.least(probability, F.lit(1.0 - eps)), F.lit(eps))
    return F.when(probability.isNotNull() & label.isNotNull(),
                  F.when(label == 1, -F.ln(p)).otherwise(-F.ln(F.lit(1.0) - p)))


def probability_of(label: Column, names: Mapping[str, str]) -> Column:
    """Probability the model gave to the class that happened."""
    out = None
    for value, c in names.items():
        hit = label == value
        out = F.when(hit, F.col(c)) if out is None else out.when(hit, F.col(c))
    return out


def multiclass_logloss(
    scored: DataFrame, label: str, names: Mapping[str, str], *, by: Sequence[str] = (),
    weight: str | None = None, eps: float = MULTICLASS_EPSILON, drop_null: bool = True,
) -> DataFrame:
    """Mean of ``-ln(p[actual] + eps)``.

    ``drop_null=False`` lets one unscored row make the whole loss null.
    """
    w = F.col(weight) if weight else F.lit(1)
    loss = -F.ln(probability_of(F.col(label), names) + F.lit(eps))
    scored_n = F.sum(F.when(loss.isNotNull(), w))
    mean = ratio(F.sum(loss * w), scored_n)
    if not drop_null:
        mean = F.when(F.count_if(loss.isNull()) == 0, mean)
    return scored.groupBy(*by).agg(mean.alias("log_loss"))


def model_deviance(
    scored: DataFrame, label: str, names: Mapping[str, str], n_features: int, *,
    by: Sequence[str] = (), weight: str | None = None,
) -> DataFrame:
    """Residual deviance, effective parameters and AIC of a softmax model."""
    w = F.col(weight) if weight else F.lit(1)
    edf = (len(names) - 1) * (n_features + 1)
    out = scored.groupBy(*by).agg(
        (F.lit(-2.0) * F.sum(F.ln(probability_of(F.col(label), names)) * w)).alias("deviance")
    )
    return out.withColumns({"edf": F.lit(edf), "aic": F.col("deviance") + F.lit(2.0 * edf)})


def confusion_counts(
    scored: DataFrame, reference: str, predicted: str, labels: Sequence[str], *, by: Sequence[str] = (),
) -> DataFrame:
    """Count per (reference, prediction) over the full label grid; empty cells are 0.

    ``dropped`` is, in every row, the number of rows of the group that fit no cell: a null on
    either side, or a label that is not in ``labels``.
    """
    counted = scored.groupBy(*by, F.col(reference).alias("reference"), F.col(predicted).alias("prediction")) \
        .agg(F.count("*").alias("n"))
    cells = [(r, p) for r in labels for p in labels]
    hit = lambda r, p: (F.col("reference") == r) & (F.col("prediction") == p)
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    inside = F.col("reference").isin(*labels) & F.col("prediction").isin(*labels)
    wide = counted.groupBy(*by).agg(
        total(F.when(~F.coalesce(inside, F.lit(False)), F.col("n"))).alias("dropped"),
        *[total(F.when(hit(r, p), F.col("n"))).alias(f"__{i}") for i, (r, p) in enumerate(cells)],
    )
    rows = F.array(*[
        F.struct(F.lit(r).alias("reference"), F.lit(p).alias("prediction"), F.col(f"__{i}").alias("n"))
        for i, (r, p) in enumerate(cells)
    ])
    return wide.select(*by, F.inline(rows), "dropped")


def _margins(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    # The table has one row per label pair, so windows over it are small.
    return counts.withColumns({
        "__ref": F.sum("n").over(W.partitionBy(*by, "reference")),
        "__pred": F.sum("n").over(W.partitionBy(*by, "prediction")),
        "__all": F.sum("n").over(W.partitionBy(*(by or [F.lit(0)]))),
    })


def class_metrics(counts: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One-versus-rest rates per class."""
    hit, ref, pred, n = F.col("n"), F.col("__ref"), F.col("__pred"), F.col("__all")
    rejected = n - ref - pred + hit
    diagonal = _margins(counts, by).where(F.col("reference") == F.col("prediction"))
    rates = diagonal.select(
        *by, F.col("reference").alias("label"),
        ratio(hit, ref).alias("sensitivity"),
        ratio(rejected, n - ref).alias("specificity"),
        ratio(hit, pred).alias("positive_predictive_value"),
        ratio(rejected, n - pred).alias("negative_predictive_value"),
        ratio(ref, n).alias("prevalence"),
        ratio(hit, n).alias("detection_rate"),
        ratio(pred, n).alias("detection_prevalence"),
    )
    return rates.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def overall_metrics(counts: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, no-information rate and kappa of the counted rows, and how many rows were dropped."""
    marked = _margins(counts, by)
    same = F.col("reference") == F.col("prediction")
    n = F.max("__all")
    chance = F.sum(F.when(same, F.col("__ref").cast("double") * F.col("__pred").cast("double")))
    out = marked.groupBy(*by).agg(
        n.alias("n"),
        F.max("dropped").alias("dropped"),
        F.sum(F.when(same, F.col("n"))).alias("correct"),
        ratio(F.max("__ref"), n).alias("no_information_rate"),
        ratio(chance, n.cast("double") * n.cast("double")).alias("__chance"),
    ).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))
    return out.withColumn(
        "kappa", F.try_divide(F.col("accuracy") - F.col("__chance"), F.lit(1.0) - F.col("__chance"))
    ).drop("__chance")


def accuracy_inference(overall: DataFrame, level: float = 0.95) -> DataFrame:
    """Add the exact binomial interval of the accuracy and P[accuracy > no-information rate].

    Runs on the one-row-per-model result of ``overall_metrics``.
    """
    tail = (1.0 - level) / 2.0

    @F.pandas_udf("accuracy_lower double, accuracy_upper double, p_value double")
    def exact(correct: pd.Series, n: pd.Series, rate: pd.Series) -> pd.DataFrame:
        rows = []
        for k, m, p in zip(correct, n, rate):
            k, m = int(k), int(m)
            lower = 0.0 if k == 0 else _beta_quantile(tail, k, m - k + 1)
            upper = 1.0 if k == m else _beta_quantile(1.0 - tail, k + 1, m - k)
            rows.append((lower, upper, 1.0 if k == 0 else _beta_cdf(p, k, m - k + 1)))
        return pd.DataFrame(rows, columns=["accuracy_lower", "accuracy_upper", "p_value"])

    counted = F.col("n") > 0
    found = overall.withColumn("__x", exact(
        F.when(counted, F.col("correct")).otherwise(0), F.when(counted, F.col("n")).otherwise(1),
        F.when(counted, F.col("no_information_rate")).otherwise(0.0)))
    names = ("accuracy_lower", "accuracy_upper", "p_value")
    return found.withColumns({c: F.when(counted, F.col(f"__x.{c}")) for c in names}).drop("__x")


def _stirling_rest(z: float) -> float:
    """What Stirling's formula for ln(gamma(z)) leaves out."""
    if z < 16.0:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2.0 * math.pi))
    i = 1.0 / (z * z)
    return (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / z


def _excess(count: float, expected: float) -> float:
    """``count * ln(count / expected) + expected - count`` without cancellation."""
    gap = (count - expected) / expected
    if abs(gap) > 0.1:
        return count * math.log(count / expected) + expected - count
    # ln(1 + g) = 2 atanh(v) with v = g / (2 + g); the leading terms cancel by hand.
    v = gap / (2.0 + gap)
    total, power, k = 0.0, 2.0 * count * v * v * v, 3
    while abs(power / k) > 1e-18 * max(abs(total), 1e-300):
        total += power / k
        power, k = power * v * v, k + 2
    return (count - expected) * v + total


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz).

    The factor in front is built from Stirling remainders and the distance to the mean, so that
    nothing large is subtracted. Raises when the fraction has not converged.
    """
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_cdf(1.0 - x, b, a)
    n = a + b
    front = math.sqrt(b / (2.0 * math.pi * a * n)) * math.exp(
        _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - _excess(a, n * x) - _excess(b, n * (1.0 - x))
    )
    floor = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), floor)
    total = d
    for m in range(1, 2_000_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + term / c
            c = c if abs(c) > floor else floor
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            return front * total
    raise ArithmeticError(f"incomplete beta function did not converge at x={x}, a={a}, b={b}")


def _beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if _beta_cdf(mid, a, b) < q else (low, mid)
    return (low + high) / 2.0


def coefficient_errors(
    scored: DataFrame, names: Mapping[str, str], features: Sequence[str], weight: str | None = None
) -> DataFrame:
    """(label, term, std_error) of a softmax model from the inverse information matrix.

    One aggregate gathers the matrix entries; its size depends on classes and features only.
    """
    spark = scored.sparkSession
    labels = list(names)[1:]
    terms = [F.lit(1.0), *[F.col(f) for f in features]]
    w = F.col(weight) if weight else F.lit(1.0)
    k, t = len(labels), len(terms)
    sums, where = [], []
    for a in range(k):
        for b in range(a, k):
            pa, pb = F.col(names[labels[a]]), F.col(names[labels[b]])
            share = pa * (F.lit(1.0) - pa) if a == b else -pa * pb
            for i in range(t):
                for j in range(i, t):
                    sums.append(F.sum(w * share * terms[i] * terms[j]).alias(f"s{len(sums)}"))
                    where.append((a, b, i, j))
    found = scored.agg(*sums).first()
    info = np.zeros((k * t, k * t))
    for value, (a, b, i, j) in zip(found, where):
        for r, c in ((a * t + i, b * t + j), (a * t + j, b * t + i)):
            info[r, c] = info[c, r] = value
    errors = np.sqrt(np.diag(np.linalg.inv(info)))
    rows = [
        (label, term, float(errors[a * t + i]))
        for a, label in enumerate(labels) for i, term in enumerate(("intercept", *features))
    ]
    return spark.createDataFrame(rows, "label string, term string, std_error double")


def select_model(results: DataFrame, name: str, metric: str, *, lowest: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Name and metric of the best model; ties go to the first name."""
    if lowest:
        order = F.struct(F.col(metric), F.col(name))
        best = F.min_by(name, F.when(F.col(metric).isNotNull(), order))
        value = F.min(metric)
    else:
        order = F.struct(-F.col(metric), F.col(name))
        best = F.min_by(name, F.when(F.col(metric).isNotNull(), order))
        value = F.max(metric)
    return results.groupBy(*by).agg(best.alias(name), value.alias(metric))
