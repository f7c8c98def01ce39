"""Physical plans: what would hurt on a large cluster must not appear."""

import re

import pytest

from dugout.operators import batting, runvalue
from tests.conftest import SF
from verification import fixture as X
from verification.queries import QUERIES

EAGER = {
    "cv_logloss", "multinomial_fit", "coefficient_errors", "outcome_models", "predictor_sweep", "project_levels",
    "season_models_fine", "season_models_coarse", "season_model_reports", "horizon_moments", "cv_fold_moments",
    "horizon_losses", "confusion_inference", "accuracy_p_value",  # the interval is a function of one row per model
}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_cells_read_the_plays_once(spark):
    cells = runvalue.state_cells(X.plays(spark, SF), half_inning=X.HALF_INNING, order=X.ORDER, chunk=X.chunk())
    values = runvalue.linear_weights(runvalue.run_values(cells))
    plan = _plan(values)
    assert plan.count("FileScan") == 1 and "Join" not in plan
    # row-level windows are spread by (half-inning, chunk)
    assert re.search(r"Exchange hashpartitioning\(__key#\d+, __chunk#\d+L", plan)


def test_batter_totals_are_one_partial_aggregate(spark):
    plan = _plan(batting.batter_totals(X.plays(spark, SF), expected=False))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_" in plan
    assert "Sort" not in plan


def test_only_needed_columns_are_read(spark):
    plan = _plan(QUERIES["level_counts"](spark, SF))
    assert "ReadSchema: struct<o_orderpriority:string>" in plan


def test_row_level_data_never_lands_in_one_partition(spark):
    for name in ("runs_to_end", "pitch_id_dense", "kfold_assign", "dedup_rows", "qualified_pitches", "top_half_mean"):
        plan = _plan(QUERIES[name](spark, SF))
        for part in plan.split("Exchange SinglePartition")[1:]:
            # what is gathered has been reduced by an aggregate or is bounded by the slice count
            assert "Aggregate" in part.split("FileScan")[0]


def test_a_season_from_files_to_results(spark, tmp_path):
    from dugout.plans import season
    from dugout.sources import tables

    log = X.plays(spark, SF).selectExpr(
        "season", "CAST(ts AS STRING) AS stamp", "game_no", "inning", "top_bottom", "batter", "outs", "outs_on_play",
        "play_result", "runs_scored", "exit_speed", "angle", "direction", "pitch_id AS row")
    for s in X.SEASONS:
        for team in ("home", "away"):  # each game is delivered twice
            tables.write_csv(log.where(f"season = {s}").drop("season"), str(tmp_path / str(s) / team))
    schema = log.drop("season").schema
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    bad = season.ingest_seasons(spark, {s: str(tmp_path / str(s)) for s in X.SEASONS}, table, schema)
    assert bad.count() == 0
    pitches = tables.read_season_table(spark, table).selectExpr("*", "CAST(stamp AS TIMESTAMP_NTZ) AS ts",
                                                                "CAST(CAST(stamp AS TIMESTAMP_NTZ) AS DATE) AS game_date")
    assert pitches.count() == log.count()
    stats = season.run_seasons(
        pitches, out, models=X.OUTCOME_MODEL, id_columns=["row"], minimum=X.MINIMUM, half_inning=X.HALF_INNING,
        order=("ts", "row"), chunk=X.chunk())
    back = tables.read_csv(spark, f"{out}/players", stats.players.schema)
    key = lambda df: sorted((r["season"], r["batter"], r["total_pa"]) for r in df.collect())
    expected = QUERIES["batting_line"](spark, SF)
    assert key(back) == key(expected)
