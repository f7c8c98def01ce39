"""Batting lines and qualification on hand-made rows."""

import pytest

from dugout import schema as S
from dugout.functions.scoring import LinearModel, add_class_probabilities
from dugout.operators import batting, clean, indexing, levels, quality
from dugout.sources.tables import union_sources
from pyspark.sql import functions as F

PITCH = "season int, batter string, play_result string, exit_speed double, angle double"


def _pitches(spark):
    rows = [
        (2023, "a", "Single", 90.0, 10.0), (2023, "a", "Single", None, 10.0), (2023, "a", "Walk", None, None),
        (2023, "a", "Out", None, None), (2023, "a", "StrikeoutLooking", None, None), (2023, "a", None, 99.0, 1.0),
        (2023, "a", "Sacrifice", 80.0, 40.0), (2023, "a", "Error", 95.0, None), (2023, "a", "HomeRun", 105.0, 30.0),
        (2023, "b", "Out", 70.0, 5.0),
        (2023, None, "Walk", None, None), (2023, None, "Walk", None, None), (2023, None, "Double", 96.0, 12.0),
        (2024, "c", "Walk", None, None), (2024, "c", "Single", None, None), (2024, "c", "Walk", None, None),
    ]
    return spark.createDataFrame(rows, PITCH)


def _line(spark, minimum):
    totals = batting.batter_totals(_pitches(spark), expected=False)
    return {(r.season, r.batter): r for r in batting.batting_line(totals, minimum=minimum, expected=False).collect()}


def test_untracked_hits_count_for_qualification_only(spark):
    lines = _line(spark, 3)
    assert set(lines) == {(2023, "a"), (2023, None), (2024, "c")}
    a = lines[(2023, "a")]
    # the untracked single and the error without an angle are dropped; the out stays
    assert (a.total_pa, a.total_ab, a.hits, a.walks, a.strikeouts, a.errors) == (6, 4, 2, 1, 1, 0)
    assert (a.ba, a.obp, a.slg) == pytest.approx((0.5, 0.5, 1.25))
    c = lines[(2024, "c")]
    assert (c.total_pa, c.total_ab, c.ba, c.slg, c.ops) == (2, 0, None, None, None)
    assert set(_line(spark, 8)) == {(2023, "a")}


def test_null_batter_can_qualify(spark):
    kept = batting.qualified_pitches(_pitches(spark), minimum=3)
    assert kept.where("batter IS NULL").count() == 3
    assert kept.where("batter = 'a'").count() == 9
    assert kept.where("batter = 'b'").count() == 0


def test_batted_balls_and_labels(spark):
    balls = clean.batted_balls(_pitches(spark)).collect()
    assert sorted((b.play_result, b.outcome) for b in balls) == [
        ("Double", "Double"), ("HomeRun", "HomeRun"), ("Out", "Not a Hit"), ("Sacrifice", "Not a Hit"), ("Single", "Single"),
    ]
    assert sum(b.is_home_run for b in balls) == 1.0


def test_probabilities_sum_to_one_and_survive_extremes(spark):
    model = LinearModel(("x",), S.OUTCOMES, (0.0, 1.0, -1.0, 0.5, 2.0), ((0.0,), (3.0,), (-2.0,), (800.0,), (1.0,)))
    df = spark.createDataFrame([(0.0,), (1.0,), (-5.0,), (900.0,), (-900.0,), (None,)], "x double")
    names = {x: f"p{i}" for i, x in enumerate(S.OUTCOMES)}
    for r in add_class_probabilities(df, model, names).collect():
        shares = [r[c] for c in names.values()]
        assert shares == [None] * 5 if r.x is None else sum(shares) == pytest.approx(1.0)


def test_predicted_class_agrees_with_probabilities(spark):
    model = LinearModel(("x",), ("a", "b", "c"), (0.0, 0.0, 1.0), ((0.0,), (1.0,), (-1.0,)))
    df = spark.createDataFrame([(-2.0,), (0.0,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(model.predicted()).collect()] == ["c", "c", "b", None]
    tied = LinearModel(("x",), ("a", "b"), (0.0, 0.0), ((0.0,), (1.0,)))
    assert df.where("x = 0").select(tied.predicted()).first()[0] == "a"


def test_models_per_season(spark):
    flat = lambda p: LinearModel(("x",), ("a", "b"), (0.0, p), ((0.0,), (0.0,)))
    df = spark.createDataFrame([(2023, 1.0), (2024, 1.0), (2025, 1.0)], "season int, x double")
    out = add_class_probabilities(df, {2023: flat(0.0), 2024: flat(50.0)}, {"b": "p"}, model_key="season").collect()
    assert [r.p for r in out] == [pytest.approx(0.5), pytest.approx(1.0), None]


def test_duplicates(spark):
    p = _pitches(spark)
    assert clean.deduplicate(p.unionAll(p)).count() == p.distinct().count()


def test_null_columns(spark):
    df = _pitches(spark).withColumn("a.b", F.lit(None).cast("string"))
    assert "a.b" not in clean.drop_empty_columns(df).columns
    profile = {r.column_name: (r.n_rows, r.n_nulls) for r in clean.null_profile(df).collect()}
    assert profile["a.b"] == (16, 16) and profile["batter"] == (16, 3)


def test_hit_quality_keeps_balls_without_result(spark):
    rows = {r.batter: r for r in quality.hit_quality(_pitches(spark), minimum=3).collect()}
    a = rows["a"]
    assert (a.total_hard_hits, a.total_batted_balls) == (3, 5)
    assert a.avg_angle == pytest.approx((10 + 1 + 40 + 30) / 4)
    assert "c" not in rows and rows[None].hard_hit_percentage == 1.0


def test_plus_stats_against_another_season(spark):
    players = spark.createDataFrame([(2023, "a", 2.0), (2024, "b", 3.0)], "season int, batter string, woba double")
    league = spark.createDataFrame([(2023, 4.0), (2024, 0.0)], "season int, woba double")
    own = indexing.plus_stats(players, league, ["woba"]).collect()
    assert {r.batter: r.woba_plus for r in own} == {"a": 50.0, "b": None}
    fixed = indexing.plus_stats(players, league, ["woba"], baseline_season=2023).collect()
    assert {r.batter: r.woba_plus for r in fixed} == {"a": 50.0, "b": 75.0}


def test_simple_index(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", None)], "g string, v double")
    assert [r.v_plus for r in indexing.simple_index(df, "v").orderBy("v").collect()] == [None, 0.5, 1.5]
    assert [r.i for r in indexing.simple_index(df, "v", by=["g"], name="i", scale=100).orderBy("v").collect()] == [None, 50.0, 150.0]


def test_levels(spark):
    df = spark.createDataFrame([("A",), ("A+",), ("MLB",), ("Mex",), ("DNP",), (None,)], "l string")
    out = df.select(
        levels.target_level(F.col("l")), levels.consolidate_affiliated(F.col("l")), levels.consolidate_levels(F.col("l"))
    ).collect()
    assert [tuple(r) for r in out] == [
        ("Other", "Affiliated", "Affiliated"), ("A+", "Affiliated", "Affiliated"), ("MLB", "MLB", "MLB"),
        ("Other", "Mex", "Independent"), ("Other", "DNP", "DNP"), ("Other", None, None),
    ]


def test_season_level(spark):
    seen = spark.createDataFrame(
        [(1, 2024, "AA", 130), (1, 2024, "MLB", 20), (2, 2024, "AA", 50), (2, 2024, "A", 90), (3, 2024, "Winter", 300),
         (4, 2024, "AA", 60), (4, 2024, "MLB", 60), (5, 2024, "MLB", 100), (5, 2024, "MLB", 30)],
        "player int, season int, level string, pa int",
    )
    roster = spark.createDataFrame([(i,) for i in range(1, 7)], "player int")
    out = levels.season_level(seen, roster, player="player", seasons=[2024], ranks={"MLB": 1, "AA": 2, "A": 3}, excluded=["Winter"])
    assert {r.player: r.level for r in out.collect()} == {1: "AA", 2: "A", 3: "DNP", 4: "MLB", 5: "MLB", 6: "DNP"}


def test_union_pads_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2.0, 2)], "d double, i int")
    assert sorted(tuple(r) for r in union_sources([a, b]).select("i", "s", "d").collect()) == [(1, "x", None), (2, None, 2.0)]
