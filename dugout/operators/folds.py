"""Cross-validation fits that share their passes.

Every logistic fit of a cross-validation (feature set, outcome, held-out fold) needs the same sums per step: gradient and
information at its coefficients. One aggregate gives them for all fits at once, so a pass over the rows serves them all.

First the fits on all rows, with sums per fold. At their optimum the sums without a fold are a subtraction, which
gives every held-out fit its first step. The steps that are left need a pass each, few since they start close.

The driver holds sums only: fits x (features + 1) x (features + 2) / 2 numbers.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions.scoring import logistic
from dugout.operators import model as M
from dugout.sources.tables import union_sources

_ALL = 0  # in place of a held-out fold: the fit on all rows
#: halvings of a step that does not lower the loss, before the fit is given up
_HALVINGS = 30


@dataclass(frozen=True)
class FoldFits:
    """``fits`` as ``model.fit_folds`` gives them, and how many passes over the rows they took."""

    fits: list[tuple]
    passes: int
    converged: bool


class _Newton:
    """One fit: the best coefficients so far, the step being tried, and where the last accepted sums were taken."""

    def __init__(self, at: np.ndarray, loss: float = np.inf):
        self.best, self.at, self.loss, self.step, self.halved, self.done = at, at, loss, np.zeros_like(at), 0, False

    @property
    def trial(self) -> np.ndarray:
        return self.best + self.step

    def aim(self, gradient: np.ndarray, information: np.ndarray, tol: float) -> None:
        # The least-squares solution: a constant feature has no direction of its own.
        self.step, self.halved = np.linalg.lstsq(information, gradient, rcond=1e-14)[0], 0
        if np.all(np.abs(self.step) <= tol * (1.0 + np.abs(self.best))):
            self.best, self.done = self.trial, True

    def take(self, sums: tuple[float, np.ndarray, np.ndarray], tol: float) -> bool:
        """The sums at ``trial``: accept it, or try half the step."""
        loss, gradient, information = sums
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.step, self.halved = self.step / 2, self.halved + 1
            if self.halved > _HALVINGS:
                self.done = True
            return False
        self.best = self.at = self.trial
        self.loss = loss
        self.aim(gradient, information, tol)
        return True


def _rows(tables: Mapping[str, DataFrame], feature_sets: Mapping[str, Sequence[str]], fold: str, width: int) -> DataFrame:
    """One table for all feature sets: set, fold, x0.. (0 beyond the set's features), flags, weight."""
    return union_sources([
        tables[name].select(
            F.lit(name).alias("model_set"), F.col(fold).alias("fold"), *M.OUTCOME_FLAGS, F.col(M.WEIGHT).alias("w"),
            *[(F.col(features[i]).cast("double") if i < len(features) else F.lit(0.0)).alias(f"x{i}") for i in range(width)])
        for name, features in feature_sets.items()])


def _sums(rows: DataFrame, fits: Mapping[tuple, np.ndarray], width: int, per_fold: bool) -> dict[tuple, tuple]:
    """(loss, gradient, information) of every fit (set, outcome, held-out fold), or of every fold of the fits on all rows."""
    spark = rows.sparkSession
    names = [f"b{i}" for i in range(width + 1)]
    # As many rows as there are fits, known here: small enough to broadcast.
    models = F.broadcast(spark.createDataFrame(
        [(*key, *map(float, np.pad(b, (0, width + 1 - len(b))))) for key, b in fits.items()],
        "model_set string, outcome string, held_out int, " + ", ".join(f"{b} double" for b in names)))
    joined = rows.join(models, "model_set")
    if not per_fold:
        joined = joined.where(F.col("fold") != F.col("held_out"))
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(width)]]
    z = sum((F.col(f"b{i}") * x[i] for i in range(1, width + 1)), F.col("b0"))
    hit = F.lit(None).cast("double")
    for y in M.OUTCOME_FLAGS:
        hit = F.when(F.col("outcome") == y, F.col(y)).otherwise(hit)
    scored = joined.withColumn("z", z).withColumns({"p": logistic(F.col("z")), "y": hit})
    # ln(1 + e^z) - y z without overflow
    loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest(F.col("z"), F.lit(0.0)) - F.col("y") * F.col("z")
    spread = F.col("w") * F.col("p") * (1 - F.col("p"))
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    part = F.col("fold") if per_fold else F.col("held_out")
    found = scored.groupBy("model_set", "outcome", part.cast("int").alias("part")).agg(
        F.sum(loss * F.col("w")).alias("loss"),
        *[F.sum(F.col("w") * (F.col("y") - F.col("p")) * x[i]).alias(f"g{i}") for i in range(width + 1)],
        *[F.sum(spread * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs])
    out = {}
    for r in found.collect():  # one row per fit
        information = np.zeros((width + 1, width + 1))
        for i, j in pairs:
            information[i, j] = information[j, i] = r[f"h{i}_{j}"]
        out[r["model_set"], r["outcome"], r["part"]] = (
            r["loss"], np.array([r[f"g{i}"] for i in range(width + 1)]), information)
    return out


def _cut(sums: tuple, size: int) -> tuple:
    loss, gradient, information = sums
    return loss, gradient[:size], information[:size, :size]


def _total(sums: Sequence[tuple]) -> tuple:
    return tuple(sum(parts) for parts in zip(*sums))


def fit_folds_together(
    balls: DataFrame, *, k: int = 5, fold: str = "fold",
    feature_sets: Mapping[str, Sequence[str]] = M.FEATURE_SETS, max_passes: int = 40, tol: float = 1e-9,
) -> FoldFits:
    """The fits of ``model.fit_folds`` from shared passes over the rows.

    Folds are numbered 1..k. A set whose training rows are none is an error. Without a finite optimum (an outcome that
    does not occur, or is separable) a fit stops after ``max_passes`` and warns with ``NotConverged``.
    """
    tables = M._fold_tables(balls, fold, feature_sets)
    width = max(len(f) for f in feature_sets.values())
    size = {name: len(f) + 1 for name, f in feature_sets.items()}
    try:
        sized = {name: M._sized(t) for name, t in tables.items()}
        rows, passes = _rows(sized, feature_sets, fold, width), 0
        whole = {(name, y, _ALL): _Newton(np.zeros(size[name])) for name in feature_sets for y in M.OUTCOME_FLAGS}
        by_fold: dict[tuple, dict[int, tuple]] = {}
        while passes < max_passes // 2 and any(not f.done for f in whole.values()):
            open_fits = {key: f.trial for key, f in whole.items() if not f.done}
            found, passes = _sums(rows, open_fits, width, per_fold=True), passes + 1
            for key in open_fits:
                name, y, _ = key
                folds = {i: _cut(found[name, y, i], size[name]) for i in range(1, k + 1) if (name, y, i) in found}
                if not folds:
                    raise ValueError(f"no training rows for {name}")
                if whole[key].take(_total(list(folds.values())), tol):
                    by_fold[key] = folds
        held = {}
        for (name, y, _), fit in whole.items():
            for i in range(1, k + 1):
                others = [s for f, s in by_fold[name, y, _ALL].items() if f != i]
                if not others:
                    raise ValueError(f"no training rows for {name} without fold {i}")
                loss, gradient, information = _total(others)
                held[name, y, i] = _Newton(fit.at, loss)
                held[name, y, i].aim(gradient, information, tol)
        while passes < max_passes and any(not f.done for f in held.values()):
            open_fits = {key: f.trial for key, f in held.items() if not f.done}
            found, passes = _sums(rows, open_fits, width, per_fold=False), passes + 1
            for key in open_fits:
                held[key].take(_cut(found[key], size[key[0]]), tol)
    finally:
        for table in tables.values():
            table.unpersist()
    converged = all(f.done for f in held.values())
    if not converged:
        warnings.warn(f"fold fits stopped after {passes} passes without converging", M.NotConverged, stacklevel=2)
    fits = [
        (name, i, y, float(held[name, y, i].best[0]), *map(float, held[name, y, i].best[1:]))
        for i in range(1, k + 1) for name in feature_sets for y in M.OUTCOME_FLAGS]
    return FoldFits(fits, passes, converged)
