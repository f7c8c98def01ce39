"""Run expectancy, three run-value methods and linear weights.

Every result here depends on the plays only through counts and integer sums per
(season, result, outs before, outs after). ``state_cells`` builds that small table in
one pass; all methods and weights are then arithmetic on a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout import schema as S
from dugout.functions.columns import is_in, key_of, ratio
from dugout.operators.ordered import running_totals, sum_of_later_rows

LEAGUE = ("season",)


def _finished_plays(plays: DataFrame) -> DataFrame:
    return plays.where(F.col("play_result").isNotNull()).withColumns({
        "runs": F.coalesce(F.col("runs_scored").cast("long"), F.lit(0).cast("long")),
        "post_outs": F.col("outs") + F.col("outs_on_play"),
    })


def running_runs(
    plays: DataFrame, *, half_inning: Sequence[str], order: Sequence[str], chunk: Column
) -> DataFrame:
    """Plays with ``cumulative_runs`` and ``runs_to_end`` of their half-inning."""
    return running_totals(
        _finished_plays(plays), "runs", by=half_inning, order=order, chunk=chunk,
        running="cumulative_runs", remaining="runs_to_end",
    )


def state_cells(
    plays: DataFrame, *, half_inning: Sequence[str], order: Sequence[str], chunk: Column,
    by: Sequence[str] = LEAGUE,
) -> DataFrame:
    """(by, play_result, outs, post_outs) -> plays, runs, runs_to_end (integer sums).

    Half-innings are cut into time chunks. Inside a chunk the later runs are a window sum;
    across chunks they are added after the chunk has been reduced to its cells, as
    ``plays x later runs``. No task ever holds a whole oversized half-inning.
    """
    rows = _finished_plays(plays).select(
        *by, key_of(*by, *half_inning).alias("__key"), chunk.alias("__chunk"), *order,
        "play_result", "outs", "post_outs", "runs",
    )
    pair = ["__key", "__chunk"]
    cell = [*by, "play_result", "outs", "post_outs"]
    inside = rows.withColumn("__rest", sum_of_later_rows("runs", pair, order))
    per_chunk = inside.groupBy(*pair, *cell).agg(
        F.count("*").alias("plays"), F.sum("runs").alias("runs"), F.sum("__rest").alias("__rest")
    )
    later_chunks = (
        W.partitionBy("__key").orderBy(F.col("__chunk").desc()).rangeBetween(W.unboundedPreceding, -1)
    )
    carried = per_chunk.withColumn("__later", F.coalesce(F.sum("runs").over(later_chunks), F.lit(0)))
    return carried.groupBy(*cell).agg(
        F.sum("plays").alias("plays"),
        F.sum("runs").alias("runs"),
        F.sum(F.col("__rest") + F.col("plays") * F.col("__later")).alias("runs_to_end"),
    )


def run_expectancy(cells: DataFrame, by: Sequence[str] = LEAGUE) -> DataFrame:
    """Mean runs to the end of the half-inning per out state; unknown outs are a state."""
    return cells.groupBy(*by, "outs").agg(
        ratio(F.sum("runs_to_end"), F.sum("plays")).alias("avg_runs_to_end")
    )


def with_state_change(cells: DataFrame, by: Sequence[str] = LEAGUE) -> DataFrame:
    """Add the expectancy before and after the play to every cell.

    The cell table is tiny, so both lookups are windows over it and the plays behind it
    are read once. After three outs nothing more is expected; an unknown or impossible
    out state has no value.
    """
    state = W.partitionBy(*by, "outs")
    league = W.partitionBy(*by)
    pre = ratio(F.sum("runs_to_end").over(state), F.sum("plays").over(state))
    known = F.when(F.col("outs").isNotNull(), F.struct("outs", "pre"))
    return (
        cells.withColumn("pre", pre)
        .withColumn("__by_outs", F.map_from_entries(F.collect_set(known).over(league)))
        .withColumn(
            "post",
            F.when(F.col("post_outs") == S.OUTS_PER_HALF_INNING, F.lit(0.0))
            .when(F.col("post_outs").isNotNull(), F.try_element_at("__by_outs", F.col("post_outs"))),
        )
        .drop("__by_outs")
    )


def run_values(cells: DataFrame, by: Sequence[str] = LEAGUE) -> DataFrame:
    """Mean run value per result under the three methods.

    m1: change of expectancy plus runs on the play; m2: runs on the play plus runs to the
    end; m3: m2 plus the change of expectancy. m1 and m3 skip plays without a known state.
    """
    change = F.col("post") - F.col("pre")
    known = change.isNotNull()
    n_known = F.sum(F.when(known, F.col("plays")))
    moved = F.col("plays") * change
    return with_state_change(cells, by).groupBy(*by, "play_result").agg(
        F.sum("plays").alias("plays"),
        ratio(F.sum(F.when(known, moved + F.col("runs"))), n_known).alias("m1"),
        ratio(F.sum(F.col("runs") + F.col("runs_to_end")), F.sum("plays")).alias("m2"),
        ratio(F.sum(F.when(known, moved + F.col("runs") + F.col("runs_to_end"))), n_known).alias("m3"),
    )


def run_values_by_state(cells: DataFrame, by: Sequence[str] = LEAGUE) -> DataFrame:
    """Method 2 in its two-step form: mean per (outs, result), then averaged over the plays."""
    per_state = cells.groupBy(*by, "outs", "play_result").agg(
        F.sum("plays").alias("plays"),
        ratio(F.sum(F.col("runs") + F.col("runs_to_end")), F.sum("plays")).alias("value"),
    )
    return per_state.groupBy(*by, "play_result").agg(
        ratio(F.sum(F.col("value") * F.col("plays")), F.sum("plays")).alias("m2")
    )


def linear_weights(
    values: DataFrame, *, methods: Sequence[str] = ("m2", "m3"), by: Sequence[str] = LEAGUE,
    reference_season: int | None = None,
) -> DataFrame:
    """Run values moved so that an out is worth 0 and scaled to the league on-base percentage.

    ``values`` is ``run_values``: at most a dozen rows per season, which is why windows per
    season are safe here. ``reference_season`` takes the run values of that season for every
    season, keeping each season's own league totals; other keys in ``by`` keep to themselves.
    """
    league = W.partitionBy(*by)
    result, plays = F.col("play_result"), F.col("plays")
    share = lambda cond: F.sum(F.when(cond, plays).otherwise(0)).over(league)
    on_base = ratio(share(is_in(result, S.WEIGHTED)), F.sum(plays).over(league))
    out = values.withColumn("league_obp", on_base)
    for m in methods:
        if reference_season is not None:
            same_result = W.partitionBy(*[c for c in by if c != "season"], "play_result")
            taken = F.max(F.when(F.col("season") == reference_season, F.col(m))).over(same_result)
            out = out.withColumn(m, taken)
        at_out = F.max(F.when(result == S.OUT, F.col(m))).over(league)
        out = out.withColumn(f"{m}_centred", F.col(m) - at_out)
        earned = F.sum(F.when(is_in(result, S.WEIGHTED), F.col(f"{m}_centred") * plays)).over(league)
        out = out.withColumn(f"{m}_unscaled_woba", ratio(earned, F.sum(plays).over(league)))
        out = out.withColumn(
            f"{m}_weight", F.col(f"{m}_centred") * ratio(F.col("league_obp"), F.col(f"{m}_unscaled_woba"))
        )
    return out


def weights_row(weights: DataFrame, method: str = "m3", by: Sequence[str] = LEAGUE) -> DataFrame:
    """One row per season: ``w_walk``, ``w_single``, ``w_double``, ``w_triple``, ``w_home_run``."""
    names = {S.WALK: "w_walk", S.SINGLE: "w_single", S.DOUBLE: "w_double",
             S.TRIPLE: "w_triple", S.HOME_RUN: "w_home_run"}
    return weights.groupBy(*by).agg(*[
        F.max(F.when(F.col("play_result") == r, F.col(f"{method}_weight"))).alias(n)
        for r, n in names.items()
    ])


def sanity_checks(values: DataFrame, method: str = "m3", by: Sequence[str] = LEAGUE) -> DataFrame:
    """(by, check, passed): the order run values are expected to have; reports, never raises."""
    tolerance = 0.05
    v = lambda r: F.max(F.when(F.col("play_result") == r, F.col(method)))
    looking, swinging = "StrikeoutLooking", "StrikeoutSwinging"
    wide = values.groupBy(*by).agg(
        v(S.HOME_RUN).alias("homer"), v(S.TRIPLE).alias("triple"), v(S.DOUBLE).alias("double"),
        v(S.SINGLE).alias("single"), v(S.WALK).alias("walk"), v(S.OUT).alias("out"),
        v(looking).alias("looking"), v(swinging).alias("swinging"),
    )
    c = F.col
    checks = {
        "home_run_above_triple": c("homer") > c("triple"),
        "triple_above_double": c("triple") > c("double"),
        "double_above_single": c("double") > c("single"),
        "single_above_walk": c("single") > c("walk"),
        "strikeouts_alike": F.abs(c("looking") - c("swinging")) < tolerance,
        "strikeout_near_out": F.abs((c("looking") + c("swinging")) / 2 - c("out")) < tolerance,
    }
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), F.coalesce(cond, F.lit(False)).alias("passed"))
        for n, cond in checks.items()
    ])
    return wide.select(*by, F.inline(rows))
