"""Run values and weights: edge states, a half-inning split over chunks, identities."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dugout.functions.columns import minute_chunk
from dugout.operators import runvalue
from dugout.plans.season import season_statistics, score_pitches
from tests.conftest import SF
from verification import fixture as X

SCHEMA = """season int, game string, ts timestamp_ntz, pitch_id long, play_result string,
  outs int, outs_on_play int, runs_scored int"""
START = dt.datetime(2023, 5, 1, 18, 0)


def _plays(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        game = "hot" if rng.random() < 0.6 else rng.choice(["g1", "g2", None])
        rows.append((
            rng.choice([2023, 2024]), game, START + dt.timedelta(minutes=rng.randrange(0, 600)), i,
            rng.choice(["Single", "HomeRun", "Out", "Walk", "Double", None]),
            rng.choice([0, 1, 2, None]), rng.choice([0, 0, 1, 2]), rng.choice([0, 0, 1, 3, None]),
        ))
    return rows


def _brute(rows):
    plays = [r for r in rows if r[4] is not None]
    rte = {}
    for key in {(r[0], r[1]) for r in plays}:
        group = sorted((r for r in plays if (r[0], r[1]) == key), key=lambda r: (r[2], r[3]))
        for i, r in enumerate(group):
            rte[r[3]] = sum(x[7] or 0 for x in group[i + 1:])
    by_outs = {}
    for r in plays:
        by_outs.setdefault((r[0], r[5]), []).append(rte[r[3]])
    re = {k: sum(v) / len(v) for k, v in by_outs.items()}
    found = {}
    for r in plays:
        season, result, outs, runs = r[0], r[4], r[5], r[7] or 0
        after = None if outs is None else outs + r[6]
        post = None if after is None else 0.0 if after == 3 else re.get((season, after))
        change = None if post is None else post - re[(season, outs)]
        m = found.setdefault((season, result), ([], [], []))
        m[1].append(rte[r[3]] + runs)
        if change is not None:
            m[0].append(change + runs)
            m[2].append(change + runs + rte[r[3]])
    mean = lambda v: sum(v) / len(v) if v else None
    return re, {k: tuple(mean(v) for v in m) for k, m in found.items()}


@pytest.mark.parametrize("minutes", [10, 60, 100_000])
def test_methods_match_brute_force(spark, minutes):
    rows = _plays()
    cells = runvalue.state_cells(
        spark.createDataFrame(rows, SCHEMA), half_inning=["game"], order=["ts", "pitch_id"],
        chunk=minute_chunk("ts", minutes),
    )
    re, values = _brute(rows)
    got = {(r.season, r.outs): r.avg_runs_to_end for r in runvalue.run_expectancy(cells).collect()}
    assert got == pytest.approx(re)
    out = runvalue.run_values(cells).collect()
    assert {(r.season, r.play_result) for r in out} == set(values)
    for r in out:
        assert (r.m1, r.m2, r.m3) == pytest.approx(values[(r.season, r.play_result)])
    two_step = {(r.season, r.play_result): r.m2 for r in runvalue.run_values_by_state(cells).collect()}
    assert two_step == pytest.approx({k: v[1] for k, v in values.items()})


def test_last_play_has_nothing_to_come(spark):
    rows = runvalue.running_runs(
        X.plays(spark, SF), half_inning=X.HALF_INNING, order=X.ORDER, chunk=X.chunk()
    )
    last = rows.groupBy(*X.HALF_INNING).agg(
        F.max_by("runs_to_end", F.struct(*X.ORDER)).alias("last"),
        F.max("cumulative_runs").alias("total"), F.sum("runs").alias("runs"),
    )
    assert last.where((F.col("last") != 0) | (F.col("total") != F.col("runs"))).count() == 0


@pytest.fixture(scope="module")
def stats(spark):
    scored = score_pitches(X.plays(spark, SF), X.OUTCOME_MODEL)
    return season_statistics(
        scored, half_inning=X.HALF_INNING, order=X.ORDER, chunk=X.chunk(), minimum=X.MINIMUM
    )


def test_out_is_worth_nothing_and_league_woba_is_obp(stats):
    for r in stats.weights.where("play_result = 'Out'").collect():
        assert r.m2_weight == 0 and r.m3_weight == 0
    for m in ("m2", "m3"):
        earned = stats.weights.where("play_result IN ('Walk','Single','Double','Triple','HomeRun')")
        pa = stats.weights.groupBy("season").agg(F.sum("plays").alias("pa"), F.max("league_obp").alias("obp"))
        check = earned.groupBy("season").agg(F.sum(F.col(f"{m}_weight") * F.col("plays")).alias("total")).join(pa, "season")
        for r in check.collect():
            assert r.total / r.pa == pytest.approx(r.obp)
    for r in stats.league_m2.select("woba", "obp").collect():
        assert r.woba == pytest.approx(r.obp)


def test_plus_statistics_centre_on_100(stats):
    means = stats.plus_m1.groupBy("season").agg(*[F.avg(f"{c}_plus").alias(c) for c in ("xba", "woba", "xwoba", "xops")])
    for r in means.collect():
        assert list(r)[1:] == pytest.approx([100.0] * 4)


def test_checks_report_instead_of_raising(stats):
    rows = stats.checks.collect()
    assert len(rows) == 12 and {type(r.passed) for r in rows} == {bool}


def test_reference_season_stays_inside_its_league(spark):
    rows = [(lg, s, r, float(v), 10) for lg, base in (("a", 0), ("b", 5)) for s in (1, 2)
            for r, v in (("Out", base - 0.3 * s), ("Walk", base + 0.3 * s), ("Single", base + 0.5 * s))]
    values = spark.createDataFrame(rows, "league string, season int, play_result string, m3 double, plays long")
    by = ("league", "season")
    taken = runvalue.linear_weights(values, methods=("m3",), by=by, reference_season=1)
    found = {(r.league, r.season, r.play_result): r.m3 for r in taken.collect()}
    for s in (1, 2):
        assert found["a", s, "Out"] == -0.3 and found["b", s, "Out"] == 4.7
