"""Fits on generated data, splits, folds and confusion statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dugout import schema as S
from dugout.functions.scoring import LinearModel, add_class_probabilities
from dugout.operators import evaluate, model
from dugout.plans import projection
from tests.conftest import SF
from verification import fixture as X
from verification.queries import ORACLES, QUERIES

LABELS = ("A", "B", "C")
TRUE_B, TRUE_W = np.array([0.0, 0.5, -1.0]), np.array([[0.0, 0.0], [1.0, -0.5], [-0.8, 0.7]])


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-20, 21, size=(20_000, 2)) / 10.0
    z = x @ TRUE_W.T + TRUE_B
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = (p.cumsum(axis=1) < rng.random((len(x), 1))).sum(axis=1)
    rows = [(i, float(a), float(b), LABELS[c]) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, u double, v double, label string").cache()


def test_multinomial_recovers_coefficients(sample):
    m = model.fit_multinomial(sample, ["u", "v"], "label", LABELS)
    assert m.labels == LABELS and m.intercepts[0] == 0.0
    assert np.array(m.intercepts) == pytest.approx(TRUE_B, abs=0.08)
    assert np.array(m.weights) == pytest.approx(TRUE_W, abs=0.08)
    # at the optimum, mean probabilities equal the class shares
    names = {x: f"p_{x}" for x in LABELS}
    scored = add_class_probabilities(sample, m, names)
    means = scored.agg(*[F.avg(c).alias(c) for c in names.values()]).first()
    shares = {r.label: r["count"] / 20_000 for r in sample.groupBy("label").count().collect()}
    assert [means[f"p_{x}"] for x in LABELS] == pytest.approx([shares[x] for x in LABELS], abs=1e-4)


def test_absent_class_is_left_out(sample):
    m = model.fit_multinomial(sample.where("label <> 'B'"), ["u"], "label", ("Z", *LABELS))
    assert m.labels == ("A", "C")
    alone = model.fit_multinomial(sample.where("label = 'C'"), ["u"], "label", LABELS)
    names = {x: x for x in LABELS}
    r = add_class_probabilities(sample.limit(1), alone, names).select(*LABELS).first()
    assert tuple(r) == (None, None, 1.0)


def test_null_features_are_ignored_by_the_fit_and_unscored(spark, sample):
    holes = sample.withColumn("u", F.when(F.col("id") % 3 != 0, F.col("u")))
    m = model.fit_multinomial(holes, ["u"], "label", LABELS)
    same = model.fit_multinomial(sample.where("id % 3 <> 0"), ["u"], "label", LABELS)
    assert np.array(m.weights) == pytest.approx(np.array(same.weights), abs=1e-6)
    assert holes.where(m.predicted().isNull()).count() == sample.where("id % 3 = 0").count()


def test_standard_errors(sample):
    m = model.fit_multinomial(sample, ["u", "v"], "label", LABELS)
    names = {x: f"p_{x}" for x in LABELS}
    scored = add_class_probabilities(sample, m, names)
    got = {(r.label, r.term): r.std_error for r in evaluate.coefficient_errors(scored, names, ["u", "v"]).collect()}
    rows = np.array([tuple(r) for r in scored.select("u", "v", "p_B", "p_C").collect()])
    design = np.column_stack([np.ones(len(rows)), rows[:, :2]])
    p = rows[:, 2:]
    info = np.block([
        [design.T @ (design * (p[:, [a]] * ((a == b) - p[:, [b]]))) for b in range(2)] for a in range(2)
    ])
    want = np.sqrt(np.diag(np.linalg.inv(info)))
    keys = [(x, t) for x in ("B", "C") for t in ("intercept", "u", "v")]
    assert [got[k] for k in keys] == pytest.approx(list(want))


def test_sweep_prefers_the_informative_set(sample):
    models, losses = model.predictor_sweep(sample, {"both": ["u", "v"], "one": ["v"]}, "label", LABELS)
    assert set(models) == {"both", "one"}
    assert evaluate.select_model(losses, "predictor_set", "log_loss").first()["predictor_set"] == "both"


def test_cross_validation(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        es, la, di = rng.integers(50, 110), rng.integers(-30, 50), rng.integers(-45, 45)
        p = 1 / (1 + math.exp(-(-8 + 0.08 * es + 0.02 * la)))
        result = "Single" if rng.random() < p else rng.choice(["Out", "Double", "Triple", "HomeRun"])
        rows.append((i, float(es), float(la), None if i % 10 == 0 else float(di), str(result)))
    balls = spark.createDataFrame(rows, "id long, exit_speed double, angle double, direction double, play_result string")
    folded = model.kfold(balls, ["id"], k=3)
    for common in (True, False):
        out = {(r.model_set, r.outcome): r.log_loss
               for r in model.cross_validated_logloss(folded, k=3, common_rows=common).collect()}
        assert len(out) == 8
        base = np.mean([r[4] == "Single" for r in rows])
        entropy = -(base * math.log(base) + (1 - base) * math.log(1 - base))
        assert out[("NoDirection", "is_single")] < entropy - 0.05
        # direction carries nothing
        assert out[("WithDirection", "is_single")] == pytest.approx(out[("NoDirection", "is_single")], abs=0.01)


def test_folds_are_balanced(spark):
    sizes = [r["count"] for r in model.kfold(spark.range(1003), ["id"], k=5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_split_sizes_are_exact(spark):
    df = spark.range(1111).withColumn("y", F.when(F.col("id") < 5, "rare").when(F.col("id") < 6, "single").otherwise("common"))
    split = model.stratified_split(df, ["id"], "y", p=0.8)
    got = {r.y: (r.n, r.train) for r in split.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if("is_train").alias("train")).collect()}
    assert got == {y: (n, math.ceil(n * 4 / 5)) for y, n in (("rare", 5), ("single", 1), ("common", 1105))}


def test_binary_loss_at_certainty(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (1.0, None), (None, 0.5)], "y double, p double")
    loss = [r[0] for r in df.select(evaluate.binary_loss(F.col("y"), F.col("p"))).collect()]
    assert loss[0] == pytest.approx(0, abs=1e-12) and loss[1] == pytest.approx(0, abs=1e-12)
    assert loss[2] == pytest.approx(-math.log(1e-15)) and loss[3:] == [None, None]


def test_multiclass_loss_null_rule(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.9, 0.1), ("a", None, None)], "y string, pa double, pb double")
    names = {"a": "pa", "b": "pb"}
    keep = evaluate.multiclass_logloss(df, "y", names).first()["log_loss"]
    assert keep == pytest.approx(-(math.log(0.5) + math.log(0.1)) / 2)
    assert evaluate.multiclass_logloss(df, "y", names, drop_null=False).first()["log_loss"] is None


def _confusion(spark):
    rows = [("a", "a")] * 40 + [("a", "b")] * 10 + [("b", "a")] * 5 + [("b", "b")] * 25 + [("c", "a")] * 2
    df = spark.createDataFrame(rows + [("a", None), ("x", "a")], "ref string, pred string")
    return evaluate.confusion_counts(df, "ref", "pred", ("a", "b", "c"))


def test_confusion_grid_is_complete(spark):
    cells = {(r.reference, r.prediction): r.n for r in _confusion(spark).collect()}
    assert len(cells) == 9 and cells[("c", "c")] == 0 and cells[("a", "b")] == 10 and sum(cells.values()) == 82


def test_confusion_metrics(spark):
    rows = {r.label: r for r in evaluate.class_metrics(_confusion(spark)).collect()}
    assert rows["a"].sensitivity == pytest.approx(0.8) and rows["a"].specificity == pytest.approx(25 / 32)
    assert rows["c"].positive_predictive_value is None and rows["c"].sensitivity == 0.0
    out = evaluate.accuracy_inference(evaluate.overall_metrics(_confusion(spark))).first()
    n, k, rate = 82, 65, 50 / 82
    assert (out.n, out.correct) == (n, k) and out.no_information_rate == pytest.approx(rate)
    tail = lambda p, lo, hi: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(lo, hi + 1))
    assert out.p_value == pytest.approx(tail(rate, k, n), rel=1e-9)
    assert tail(out.accuracy_lower, k, n) == pytest.approx(0.025, rel=1e-6)
    assert tail(out.accuracy_upper, 0, k) == pytest.approx(0.025, rel=1e-6)
    chance = (50 * 47 + 30 * 35) / n**2
    assert out.kappa == pytest.approx((k / n - chance) / (1 - chance))


def test_confusion_by_model(spark):
    df = spark.createDataFrame([("m1", "a", "a"), ("m1", "b", "a"), ("m2", "b", "b")], "m string, ref string, pred string")
    counts = evaluate.confusion_counts(df, "ref", "pred", ("a", "b"), by=["m"])
    assert counts.count() == 8
    got = {r.m: (r.n, r.correct, r.kappa) for r in evaluate.overall_metrics(counts, by=["m"]).collect()}
    assert got["m1"][:2] == (2, 1) and got["m1"][2] == pytest.approx(0.0)
    assert got["m2"] == (1, 1, None)


def test_deviance(spark):
    df = spark.createDataFrame([("a", 0.25, 0.75), ("b", 0.5, 0.5)], "y string, pa double, pb double")
    r = evaluate.model_deviance(df, "y", {"a": "pa", "b": "pb"}, 3).first()
    assert r.deviance == pytest.approx(-2 * (math.log(0.25) + math.log(0.5))) and (r.edf, r.aic) == (4, pytest.approx(r.deviance + 8))


def test_projection_columns_and_boards(spark):
    m = LinearModel(("x",), S.TARGET_LEVELS[:3], (0.0, 1.0, 2.0), ((0.0,), (1.0,), (-1.0,)))
    players = spark.createDataFrame([(f"p{i}", float(i)) for i in range(8)], "batter string, x double")
    out = model.project_levels(players, {2025: m})
    assert out.columns == ["batter", "x", "p_2025_a_plus", "p_2025_aa", "p_2025_aaa"]
    top = projection.board(players, m, "AA", k=3).collect()
    assert [r.batter for r in top] == ["p7", "p6", "p5"]


def test_compare_predictors(sample):
    profiles = sample.limit(3000)
    models, metrics = projection.compare_predictors(
        profiles, ["id"], "label", LABELS, predictor_sets={"both": ["u", "v"], "one": ["v"]}
    )
    rows = {r.model: r for r in metrics.collect()}
    assert set(models) == set(rows) == {"both", "one"}
    assert rows["both"].accuracy > rows["both"].no_information_rate
    assert rows["both"].accuracy_lower < rows["both"].accuracy < rows["both"].accuracy_upper


def test_fitted_outcome_models_reproduce_league_hits(spark):
    from dugout.plans.season import fit_outcome_models, score_pitches

    pitches = X.plays(spark, SF)
    scored = score_pitches(pitches, fit_outcome_models(pitches, X.SEASONS))
    sums = scored.where(F.col("xba").isNotNull()).groupBy("season").agg(
        F.sum("x1b").alias("x"), F.count_if(F.col("play_result") == "Single").alias("n"))
    for r in sums.collect():
        assert r.x == pytest.approx(r.n, rel=1e-3)


def test_confusion_accounts_for_every_row(spark):
    df = spark.createDataFrame([("a", "a"), ("b", None), (None, "a"), ("zz", "b"), ("a", "zz")], "ref string, pred string")
    counts = evaluate.confusion_counts(df, "ref", "pred", ("a", "b"))
    assert {r.dropped for r in counts.collect()} == {4} and sum(r.n for r in counts.collect()) == 1
    overall = evaluate.overall_metrics(counts).first()
    assert (overall.n, overall.dropped, overall.accuracy) == (1, 4, 1.0)
    nothing = evaluate.accuracy_inference(evaluate.overall_metrics(
        evaluate.confusion_counts(df.limit(0), "ref", "pred", ("a", "b")))).first()
    assert (nothing.n, nothing.dropped, nothing.accuracy, nothing.p_value) == (0, 0, None, None)


def test_p_value_keeps_its_digits():
    import math

    for n in (10**4, 10**8, 10**11, 6 * 10**11, 10**12):
        k = n // 2
        # P[X >= n/2] for a fair coin is one half and half the probability of the middle.
        middle = math.sqrt(2.0 / (math.pi * n)) * (1 - 1 / (4 * n))
        assert abs(evaluate._beta_cdf(0.5, k, n - k + 1) - (0.5 + 0.5 * middle)) < 1e-9
    for n, k, p in ((10, 3, 0.2), (50, 1, 0.01), (400, 390, 0.95), (3000, 900, 0.31)):
        tail = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) if n < 900 else None
        if tail is not None:
            assert abs(evaluate._beta_cdf(p, k, n - k + 1) - tail) < 1e-12


def test_fits_report_convergence(spark):
    from dugout.operators.model import NotConverged

    apart = spark.createDataFrame([(float(i), "a" if i < 50 else "b") for i in range(100)], "x double, y string")
    with pytest.warns(NotConverged):
        fitted = model.fit_multinomial(apart, ["x"], "y", ("a", "b"), max_iter=5)
    assert fitted.converged is False and fitted.iterations == 5
    mixed = spark.createDataFrame([(float(i % 7), "a" if i % 3 else "b") for i in range(200)], "x double, y string")
    assert model.fit_multinomial(mixed, ["x"], "y", ("a", "b")).converged


def test_comparison_keeps_sets_without_scored_rows(spark):
    from dugout.plans.projection import compare_predictors

    rows = [(i, float(i % 5), float(i) if i < 0 else None, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, gap double, y string")
    _, found = compare_predictors(df, ["id"], "y", ("a", "b"), predictor_sets={"x": ("x",)})
    assert [(r.model, r.n, r.dropped) for r in found.collect()] == [("x", 8, 0)]
    half = df.withColumn("z", F.when(F.col("id") % 4 < 2, F.col("x")))
    found = compare_predictors(half, ["id"], "y", ("a", "b"), predictor_sets={"z": ("z",)})[1].first()
    assert found.n + found.dropped == 8 and found.dropped > 0


def test_workers_find_the_package_from_another_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(repo)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).getOrCreate()
print("P", e.queries()["accuracy_p_value"](spark, "/root/testdata/sf0.001").count())
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "P 1" in out.stdout, out.stderr[-2000:]


def test_reports_cover_every_predictor_set(spark):
    found = QUERIES["season_model_reports"](spark, SF.replace("0.001", "0.01"))
    assert {r["model"] for r in found.select("model").distinct().collect()} == set(model.SEASON_SETS)


def test_every_horizon_set_has_a_moment_check():
    checks = {"Traditional": "horizon_moments", "HitQuality": "horizon_moments_quality",
              "Expected": "horizon_moments_expected"}
    assert set(checks) == set(model.HORIZON_SETS) and set(checks.values()) <= set(ORACLES)


@pytest.mark.parametrize("digits,sorted_rows", [(4, 10_000), (1, 0), (1, 3), (2, 40), (32, 5)])
def test_digest_cut_takes_the_first_rows_of_the_shuffled_order(spark, digits, sorted_rows):
    from dugout.operators import ordered

    df = spark.range(700).withColumn("y", F.when(F.col("id") % 50 == 0, None).when(F.col("id") < 3, "rare").otherwise("common"))
    for share in (0.0, 0.31, 0.8, 1.0):
        wanted = F.ceil(F.col("n") * share).cast("long")
        cuts = ordered.digest_cut(df, ordered.shuffle_digest(["id"], 7), wanted, by=["y"], digits=digits, sorted_rows=sorted_rows)
        found = {r["key"]["y"]: r["cut"] for r in cuts.collect()}
        assert set(found) == {None, "rare", "common"}
        ranked = ordered.hash_rank(df, ids=["id"], seed=7, by=["y"]).withColumn("digest", ordered.shuffle_digest(["id"], 7)).collect()
        for r in ranked:
            assert (r["digest"] <= found[r["y"]]) == (r["rank"] <= math.ceil(r["group_size"] * share))


def test_split_moves_no_row(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS y", "id * 2 AS other")
    split = model.stratified_split(df, ["id"], "y")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan and "BroadcastHashJoin" in plan
    assert split.columns == ["id", "y", "other", "is_train"] and split.where("is_train").count() == 3 * 1334 - 2 + 1
    assert model.stratified_split(df.limit(0), ["id"], "y").count() == 0


def test_reports_compute_their_profiles_once(spark):
    """The split looks for its cuts in several passes; none of them may compute the profiles again."""
    computed = spark.sparkContext.accumulator(0)

    def name(x):
        computed.add(1)
        return "AB"[x % 2]

    label = F.udf(name, "string").asNondeterministic()
    profiles = spark.range(60).repartition(3).withColumns({"u": F.col("id") % 7 * 0.5, "label": label("id")})
    found = projection.report_models(profiles, ["id"], "label", ["A", "B"], predictor_sets={"one": ["u"]})
    assert computed.value == 60
    assert sorted(r["is_train"] for r in found.split.collect()).count(True) == 48
