"""Level forecasts: horizon models, predictor comparison and boards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout import schema as S
from dugout.functions.scoring import LinearModel, add_class_probabilities
from dugout.operators import evaluate
from dugout.operators.batting import top_k
from dugout.operators.levels import target_level
from dugout.operators.model import (
    HORIZON_SETS, SEASON_SETS, fit_multinomial, predictor_sweep, stratified_split,
)
from dugout.session import side_by_side
from dugout.sources.shared import materialize


def fit_horizons(
    training: DataFrame, level_columns: Mapping[int, str], *,
    predictor_sets: Mapping[str, Sequence[str]] = HORIZON_SETS, chosen: str | None = "Traditional",
    labels: Sequence[str] = S.TARGET_LEVELS,
) -> tuple[dict[int, LinearModel], DataFrame]:
    """One model per projected year and the losses (year, predictor_set, log_loss).

    ``level_columns`` maps the projected year to the column with the level reached after
    that many years. ``chosen=None`` takes the predictor set with the lowest loss.
    """
    def one_year(item):
        year, column = item
        labelled = training.withColumn("target_level", target_level(F.col(column)))
        fitted, loss = predictor_sweep(labelled, predictor_sets, "target_level", labels)
        name = chosen or evaluate.select_model(loss, "predictor_set", "log_loss").first()["predictor_set"]
        return year, fitted[name], loss.select(F.lit(year).alias("year"), "predictor_set", "log_loss")

    training = materialize(training, "training")  # read by every fit
    years = side_by_side(training.sparkSession, one_year, list(level_columns.items()))
    return {y: m for y, m, _ in years}, reduce(DataFrame.unionByName, [loss for _, _, loss in years])


@dataclass(frozen=True)
class ModelReports:
    """Models of several predictor sets with their evaluation; every table has a ``model`` column."""

    models: dict[str, LinearModel]
    #: rows of the input with ``is_train``
    split: DataFrame
    #: (reference, prediction, n, dropped) over the test rows
    confusion: DataFrame
    #: one row per model: accuracy, its interval and test, kappa
    overall: DataFrame
    #: one-versus-rest rates of every label
    by_class: DataFrame
    #: deviance, parameters and AIC over the training rows, iterations and convergence of the fit
    summary: DataFrame


def report_models(
    profiles: DataFrame, ids: Sequence[str], label: str, labels: Sequence[str], *,
    predictor_sets: Mapping[str, Sequence[str]] = SEASON_SETS, p: float = 0.8, seed: int = 425,
) -> ModelReports:
    """Fit every predictor set on the training split, evaluate on the rest.

    A set keeps its row, with ``n = 0`` and null rates, when no test row could be scored; unscored
    rows count as ``dropped``.
    """
    profiles = materialize(profiles, "profiles")  # the split reads them for every step that looks for its cuts
    split = materialize(stratified_split(profiles, ids, label, p=p, seed=seed), "split")
    spark = split.sparkSession
    train, test = split.where("is_train"), split.where(~F.col("is_train"))
    fit = lambda item: (item[0], fit_multinomial(train, item[1], label, labels))
    models = dict(side_by_side(spark, fit, list(predictor_sets.items())))
    # One pass over the test rows scores every model; null features give no prediction.
    calls = F.array(*[
        F.struct(F.lit(name).alias("model"), m.predicted().alias("predicted")) for name, m in models.items()
    ])
    every = test.select(F.col(label).alias("actual"), F.inline(calls))
    confusion = materialize(
        evaluate.confusion_counts(every, "actual", "predicted", labels, by=["model"]), "confusion")
    fits = spark.createDataFrame(
        [(name, m.iterations, m.converged) for name, m in models.items()],
        "model string, iterations int, converged boolean")
    overall = fits.select("model").join(evaluate.overall_metrics(confusion, by=["model"]), "model", "left")
    overall = overall.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "dropped", "correct")})
    parts = []
    for name, m in models.items():
        names = {x: f"p_{i}" for i, x in enumerate(m.labels)}
        scored = add_class_probabilities(train.where(F.col(label).isin(*m.labels)), m, names)
        fitted = evaluate.model_deviance(scored, label, names, len(m.features))
        parts.append(fitted.select(F.lit(name).alias("model"), "*"))
    return ModelReports(
        models, split, confusion, evaluate.accuracy_inference(overall),
        evaluate.class_metrics(confusion, by=["model"]), reduce(DataFrame.unionByName, parts).join(fits, "model"),
    )


def compare_predictors(
    profiles: DataFrame, ids: Sequence[str], label: str, labels: Sequence[str], **options
) -> tuple[dict[str, LinearModel], DataFrame]:
    """The models and one row of overall metrics per predictor set; see :func:`report_models`."""
    found = report_models(profiles, ids, label, labels, **options)
    return found.models, found.overall


def board(players: DataFrame, model: LinearModel, label: str, *, player: str = "batter", k: int = 5) -> DataFrame:
    """The ``k`` players most likely to end up in ``label``."""
    column = label.lower().replace(" ", "_")
    names = {x: f"p_{i}" for i, x in enumerate(model.labels)}
    scored = add_class_probabilities(players, model, names)
    return top_k(scored.withColumnRenamed(names[label], column), column, k, player).select(player, column)
