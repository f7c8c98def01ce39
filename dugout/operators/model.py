"""Model fitting with MLlib, splits and folds.

Fits read a table of distinct (features, label) rows with a count as weight. The optimum
is the same, repeated rows cost nothing, and the table is cached for the passes of a fit.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions.scoring import LinearModel, add_class_probabilities, logistic
from dugout.operators.clean import hit_indicators
from dugout.operators.evaluate import binary_loss, multiclass_logloss
from dugout.operators.ordered import digest_cut, hash_rank, shuffle_digest
from dugout.session import side_by_side

WEIGHT = "n_rows"
#: rows per task while a fit iterates (a parameter of speed only); small tables then need few tasks per pass
ROWS_PER_TASK = 250_000


def kfold(df: DataFrame, ids: Sequence[str], *, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Balanced folds 1..k: sizes differ by at most one."""
    ranked = hash_rank(df, ids=ids, seed=seed, rank="__rank", size="__size")
    return ranked.withColumn(name, ((F.col("__rank") - 1) % k + 1).cast("int")).drop("__rank", "__size")


def stratified_split(
    df: DataFrame, ids: Sequence[str], stratum: str, *, p: float = 0.8, seed: int = 425, flag: str = "is_train"
) -> DataFrame:
    """Exact split: ``ceil(p * n)`` rows of every stratum go to training.

    The rows are not ranked: the digest at the cut is found from histograms, and the split is a filter on it, so no row
    is shuffled or sorted. ``ids`` must identify a row.
    """
    # Integer arithmetic keeps the ceiling exact: 0.8 * 5 must not become 4.0000001.
    parts = 1_000_000
    share = F.lit(round(p * parts)) * F.col("n")
    digest = shuffle_digest(ids, seed)
    cuts = digest_cut(df, digest, F.ceil(share / parts).cast("long"), by=[stratum])
    cuts = cuts.select(F.col(f"key.{stratum}").alias("__stratum"), F.col("cut").alias("__cut"))
    # One row per stratum, written before: the planner sees its size and sends it to the rows.
    joined = df.join(cuts, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    return joined.withColumn(flag, digest <= F.col("__cut")).drop("__stratum", "__cut")


def compress(df: DataFrame, features: Sequence[str], *others: str) -> DataFrame:
    """Distinct rows with a count; rows with a null feature are left out, as a fit would."""
    kept = df.dropna(subset=list(features))
    return kept.groupBy(*features, *others).agg(F.count("*").cast("double").alias(WEIGHT))


def _sized(cached: DataFrame) -> DataFrame:
    """Fill the cache and merge its partitions to a task size worth a pass; never splits more."""
    return cached.coalesce(max(1, -(-cached.count() // ROWS_PER_TASK)))


def _label_index(label: Column, labels: Sequence[str]) -> Column:
    out = None
    for i, value in enumerate(labels):
        out = F.when(label == value, F.lit(float(i))) if out is None else out.when(label == value, F.lit(float(i)))
    return out


class NotConverged(UserWarning):
    """A fit stopped at its iteration limit; on separable data no finite optimum exists."""


def _report(what: str, iterations: int, limit: int) -> bool:
    converged = iterations < limit
    if not converged:
        warnings.warn(f"{what} stopped after {iterations} iterations without converging", NotConverged, stacklevel=3)
    return converged


def fit_multinomial(
    rows: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], *,
    max_iter: int = 200, tol: float = 1e-9, compressed: bool = False,
) -> LinearModel:
    """Unpenalised softmax regression; classes without a training row are left out.

    The first class present is the baseline, so coefficients read as log-odds against it. The model
    says how many iterations it took; one that reaches ``max_iter`` is marked and warned about.
    ``compressed`` says that ``rows`` already is a cached ``compress`` table.
    """
    if not compressed:
        table = compress(rows, features, label).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return fit_multinomial(
                _sized(table), features, label, labels, max_iter=max_iter, tol=tol, compressed=True
            )
        finally:
            table.unpersist()
    # At most len(labels) values reach the driver.
    seen = {r[0] for r in rows.where(F.col(label).isin(*labels)).select(label).distinct().collect()}
    present = tuple(x for x in labels if x in seen)
    if not present:
        raise ValueError("no training rows")
    if len(present) == 1:
        return LinearModel(tuple(features), present, (0.0,), ((0.0,) * len(features),), 0, True)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        rows.where(F.col(label).isin(*present)).withColumn("label", _label_index(F.col(label), present))
    )
    fitted = LogisticRegression(
        family="multinomial", regParam=0.0, maxIter=max_iter, tol=tol, weightCol=WEIGHT
    ).fit(vectors)
    weights, steps = fitted.coefficientMatrix.toArray(), fitted.summary.totalIterations
    return LinearModel(
        tuple(features), present,
        tuple(float(v) for v in fitted.interceptVector.toArray()),
        tuple(tuple(float(v) for v in row) for row in weights),
        steps, _report(f"softmax fit of {label}", steps, max_iter),
    ).relative_to_first()


def fit_multinomial_per(
    rows: DataFrame, key: str, values: Sequence, features: Sequence[str], label: str, labels: Sequence[str], **options
) -> dict[object, LinearModel]:
    """One model per value of ``key`` (e.g. per season), fitted side by side."""
    fit = lambda v: (v, fit_multinomial(rows.where(F.col(key) == v), features, label, labels, **options))
    return dict(side_by_side(rows.sparkSession, fit, list(values)))


def train_multinomial(
    rows: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], **options
) -> tuple[LinearModel, float]:
    """Model and its in-sample log loss."""
    table = compress(rows, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sized = _sized(table)
        model = fit_multinomial(sized, features, label, labels, compressed=True, **options)
        loss = _model_loss(sized, model, label).first()["log_loss"]
    finally:
        table.unpersist()
    return model, float(loss)


def _model_loss(table: DataFrame, model: LinearModel, label: str) -> DataFrame:
    names = {x: f"p_{i}" for i, x in enumerate(model.labels)}
    return multiclass_logloss(add_class_probabilities(table, model, names), label, names, weight=WEIGHT)


def sweep_losses(rows: DataFrame, models: Mapping[str, LinearModel], label: str) -> DataFrame:
    """(predictor_set, log_loss): the loss of every model on the rows that have all of its features."""
    losses = [
        _model_loss(compress(rows, model.features, label), model, label).select(F.lit(name).alias("predictor_set"), "log_loss")
        for name, model in models.items()
    ]
    return reduce(DataFrame.unionByName, losses)


def predictor_sweep(
    rows: DataFrame, predictor_sets: Mapping[str, Sequence[str]], label: str, labels: Sequence[str], **options
) -> tuple[dict[str, LinearModel], DataFrame]:
    """Fit every predictor set; (models, DataFrame of (predictor_set, log_loss))."""
    fit = lambda item: (item[0], train_multinomial(rows, item[1], label, labels, **options))
    fitted = dict(side_by_side(rows.sparkSession, fit, list(predictor_sets.items())))
    losses = rows.sparkSession.createDataFrame(
        [(name, loss) for name, (_, loss) in fitted.items()], "predictor_set string, log_loss double"
    )
    return {name: model for name, (model, _) in fitted.items()}, losses


def fit_binary(
    table: DataFrame, features: Sequence[str], label: str, *, max_iter: int = 25, tol: float = 1e-8
) -> tuple[float, tuple[float, ...]]:
    """Intercept and weights of a logistic regression on a ``compress``-like table.

    Warns with ``NotConverged`` when the fit reaches ``max_iter``.
    """
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(table)
    fitted = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=label, weightCol=WEIGHT, maxIter=max_iter, tol=tol
    ).fit(vectors)
    _report(f"logistic fit of {label}", fitted.summary.numIterations, max_iter)
    return float(fitted.intercept), tuple(float(v) for v in fitted.coefficients)


OUTCOME_FLAGS = ("is_single", "is_double", "is_triple", "is_home_run")
FEATURE_SETS = {
    "NoDirection": ("exit_speed", "angle"),
    "WithDirection": ("exit_speed", "angle", "direction"),
}


def _fold_tables(balls: DataFrame, fold: str, feature_sets: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Distinct rows with counts per feature set, cached: all rows, and those that have every feature."""
    complete = F.lit(True)
    for f in dict.fromkeys(f for fs in feature_sets.values() for f in fs):
        complete = complete & F.col(f).isNotNull()
    tables = {}
    for name, features in feature_sets.items():
        counted = balls.dropna(subset=list(features)).groupBy(fold, *features, "play_result").agg(
            F.count("*").cast("double").alias(WEIGHT), F.count_if(complete).cast("double").alias("n_complete")
        )
        tables[name] = hit_indicators(counted).persist(StorageLevel.MEMORY_AND_DISK)
    return tables


def _fit_all_folds(
    spark, tables: Mapping[str, DataFrame], k: int, fold: str, feature_sets: Mapping[str, Sequence[str]], parallelism: int
) -> list[tuple]:
    def fit(job):
        held_out, name, y = job
        intercept, weights = fit_binary(tables[name].where(F.col(fold) != held_out), feature_sets[name], y)
        return (name, held_out, y, intercept, *weights)

    jobs = [(i, name, y) for i in range(1, k + 1) for name in feature_sets for y in OUTCOME_FLAGS]
    return side_by_side(spark, fit, jobs, parallelism)


def fit_folds(
    balls: DataFrame, *, k: int = 5, fold: str = "fold",
    feature_sets: Mapping[str, Sequence[str]] = FEATURE_SETS, parallelism: int = 8,
) -> list[tuple]:
    """(feature set, held-out fold, outcome, intercept, *weights) of every cross-validation fit."""
    tables = _fold_tables(balls, fold, feature_sets)
    try:
        sized = {name: _sized(table) for name, table in tables.items()}
        return _fit_all_folds(balls.sparkSession, sized, k, fold, feature_sets, parallelism)
    finally:
        for table in tables.values():
            table.unpersist()


def cross_validated_logloss(
    balls: DataFrame, *, k: int = 5, fold: str = "fold", common_rows: bool = True,
    feature_sets: Mapping[str, Sequence[str]] = FEATURE_SETS, parallelism: int = 8,
) -> DataFrame:
    """(model_set, outcome, log_loss): mean over folds of the held-out binary log loss.

    ``balls`` are batted balls with a fold column. Each feature set gets one cached table of
    distinct rows with counts, shared by all its fits; a set of few features stays small
    however many balls there are. ``common_rows`` scores every set on the balls that have
    all features, so the sets are compared on the same balls.
    """
    spark = balls.sparkSession
    tables = _fold_tables(balls, fold, feature_sets)
    try:
        sized = {name: _sized(table) for name, table in tables.items()}
        fits = _fit_all_folds(spark, sized, k, fold, feature_sets, parallelism)
        summary = _mean_losses(spark, sized, fits, fold, common_rows, feature_sets)
        found = [tuple(r) for r in summary.collect()]  # one row per model set and outcome
    finally:
        for table in tables.values():
            table.unpersist()
    return spark.createDataFrame(found, "model_set string, outcome string, log_loss double")


def score_folds(
    balls: DataFrame, fits: Sequence[tuple], *, fold: str = "fold", common_rows: bool = True,
    feature_sets: Mapping[str, Sequence[str]] = FEATURE_SETS,
) -> DataFrame:
    """(model_set, outcome, log_loss): the mean over folds of the held-out loss of fits as :func:`fit_folds` gives them."""
    tables = _fold_tables(balls, fold, feature_sets)
    try:
        summary = _mean_losses(balls.sparkSession, tables, fits, fold, common_rows, feature_sets)
        found = [tuple(r) for r in summary.collect()]  # one row per model set and outcome
    finally:
        for table in tables.values():
            table.unpersist()
    return balls.sparkSession.createDataFrame(found, "model_set string, outcome string, log_loss double")


def _mean_losses(
    spark, tables: Mapping[str, DataFrame], fits: Sequence[tuple], fold: str, common_rows: bool,
    feature_sets: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Each fold's rows are scored by the fit that did not see them; folds count alike."""

    def held_out_losses(name: str) -> DataFrame:
        features = feature_sets[name]
        schema = f"{fold} int, outcome string, intercept double, " + ", ".join(f"b_{f} double" for f in features)
        # k x outcomes rows, known here: small enough to broadcast.
        models = F.broadcast(spark.createDataFrame([r[1:] for r in fits if r[0] == name], schema))
        z = F.col("intercept")
        for f in features:
            z = z + F.col(f"b_{f}") * F.col(f)
        hit = F.lit(None).cast("double")
        for y in OUTCOME_FLAGS:
            hit = F.when(F.col("outcome") == y, F.col(y)).otherwise(hit)
        weight = F.col("n_complete" if common_rows else WEIGHT)
        return (
            tables[name].join(models, fold)
            .select(F.lit(name).alias("model_set"), "outcome", fold, weight.alias("__w"),
                    binary_loss(hit, logistic(z)).alias("__loss"))
            .where(F.col("__w") > 0)
            .groupBy("model_set", "outcome", fold)
            .agg((F.sum(F.col("__loss") * F.col("__w")) / F.sum("__w")).alias("log_loss"))
        )

    per_fold = reduce(DataFrame.unionByName, [held_out_losses(name) for name in feature_sets])
    return per_fold.groupBy("model_set", "outcome").agg(F.avg("log_loss").alias("log_loss"))


def level_column(year: int, level: str) -> str:
    """``(2025, "A+")`` -> ``p_2025_a_plus``."""
    return f"p_{year}_{level.lower().replace('+', '_plus').replace(' ', '_')}"


def project_levels(
    players: DataFrame, models: Mapping[int, LinearModel]
) -> DataFrame:
    """Append one probability column per projected year and class the model was trained on."""
    out = players
    for year, model in models.items():
        out = add_class_probabilities(out, model, {x: level_column(year, x) for x in model.labels})
    return out


TRADITIONAL = ("obp", "slg", "k_percentage", "bb_percentage")
HORIZON_SETS = {
    "Traditional": TRADITIONAL,
    "HitQuality": ("hard_hit_percentage", "avg_angle"),
    "Expected": ("xwoba_plus",),
}
SEASON_SETS = {
    "age": ("age",),
    "expected": ("xwoba_plus",),
    "traditional": ("ba", "ops"),
    "hit_quality": ("avg_exit_speed_top", "avg_angle"),
    "rates": ("k_percentage", "bb_percentage"),
    "traditional_rates": ("ba", "ops", "k_percentage", "bb_percentage"),
}
