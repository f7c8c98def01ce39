"""Per-player and per-league batting lines, qualification and weighted on-base averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout import schema as S
from dugout.functions.columns import is_in, not_in, null_safe_join, ratio, sum_or_zero
from dugout.operators.clean import has_required_tracking, is_plate_appearance

BATTER = ("season", "batter")

#: per-ball probability column of each hit type
HIT_PROBABILITIES = {S.SINGLE: "x1b", S.DOUBLE: "x2b", S.TRIPLE: "x3b", S.HOME_RUN: "xhr"}


def plate_appearances(pitches: DataFrame, by: Sequence[str] = BATTER) -> DataFrame:
    return pitches.where(is_plate_appearance()).groupBy(*by).agg(F.count("*").alias("total_pa"))


def qualified_batters(
    pitches: DataFrame, by: Sequence[str] = BATTER, minimum: int = S.MIN_PLATE_APPEARANCES
) -> DataFrame:
    return plate_appearances(pitches, by).where(F.col("total_pa") >= minimum)


def qualified_pitches(
    pitches: DataFrame, by: Sequence[str] = BATTER, minimum: int = S.MIN_PLATE_APPEARANCES
) -> DataFrame:
    """All pitches of qualified batters.

    The join carries no broadcast hint: the batter list grows with the data, so the
    planner broadcasts it only below its size threshold and otherwise merges, splitting
    a batter that holds many rows (adaptive skew join).
    """
    return null_safe_join(pitches, qualified_batters(pitches, by, minimum).select(*by), list(by), "left_semi")


def expected_per_ball(df: DataFrame) -> DataFrame:
    p = {r: F.col(c) for r, c in HIT_PROBABILITIES.items()}
    single, double, triple, homer = (p[r] for r in S.HITS)
    return df.withColumns({
        "xba": single + double + triple + homer,
        "xslg": single + 2 * double + 3 * triple + 4 * homer,
    })


def _counts(keep: Column, prefix: str = "") -> list[Column]:
    """Conditional counts over the kept rows; 0, not null, when nothing matches."""
    r = F.col("play_result")
    count = lambda cond: F.count_if(keep & cond)
    columns = {
        "total_pa": F.count_if(keep),
        "total_ab": count(not_in(r, S.NOT_AT_BAT)),
        "walks": count(r == S.WALK),
        "strikeouts": count(is_in(r, S.STRIKEOUTS)),
        "singles": count(r == S.SINGLE),
        "doubles": count(r == S.DOUBLE),
        "triples": count(r == S.TRIPLE),
        "home_runs": count(r == S.HOME_RUN),
        "errors": count(r == S.ERROR),
    }
    return [c.alias(prefix + n) for n, c in columns.items()]


_COUNTS = ("total_pa", "total_ab", "walks", "strikeouts", "singles", "doubles", "triples", "home_runs", "errors")


def _expected_sums(keep: Column, prefix: str = "") -> list[Column]:
    # Probabilities are null off batted balls, so the sums need no further mask.
    names = {"x1b": "x1b", "x2b": "x2b", "x3b": "x3b", "xhr": "x_home_runs"}
    return [sum_or_zero(F.when(keep, F.col(c))).alias(prefix + n) for c, n in names.items()]


_EXPECTED = ("x1b", "x2b", "x3b", "x_home_runs")


def _add_rates(line: DataFrame) -> DataFrame:
    c = F.col
    line = line.withColumn("hits", c("singles") + c("doubles") + c("triples") + c("home_runs"))
    bases = c("singles") + 2 * c("doubles") + 3 * c("triples") + 4 * c("home_runs")
    line = line.withColumns({
        "obp": ratio(c("hits") + c("walks"), c("total_pa")),
        "ba": ratio(c("hits"), c("total_ab")),
        "slg": ratio(bases, c("total_ab")),
        "k_percentage": ratio(c("strikeouts"), c("total_pa")),
        "bb_percentage": ratio(c("walks"), c("total_pa")),
    })
    return line.withColumn("ops", c("obp") + c("slg"))


def _add_expected_rates(line: DataFrame) -> DataFrame:
    c = F.col
    hits = c("x1b") + c("x2b") + c("x3b") + c("x_home_runs")
    bases = c("x1b") + 2 * c("x2b") + 3 * c("x3b") + 4 * c("x_home_runs")
    line = line.withColumns({
        "xobp": ratio(c("walks") + hits, c("total_pa")),
        "xba": ratio(hits, c("total_ab")),
        "xslg": ratio(bases, c("total_ab")),
    })
    return line.withColumn("xops", c("xobp") + c("xslg"))


LINE_COLUMNS = (
    "total_pa", "total_ab", "walks", "strikeouts", "hits", "singles", "doubles", "triples",
    "home_runs", "errors", "obp", "ba", "slg", "ops", "k_percentage", "bb_percentage",
)
EXPECTED_COLUMNS = ("x1b", "x2b", "x3b", "x_home_runs", "xobp", "xba", "xslg", "xops")


def batter_totals(pitches: DataFrame, by: Sequence[str] = BATTER, expected: bool = True) -> DataFrame:
    """One row per batter with everything later steps need, from one pass over the pitches.

    Plain columns follow the batting line (untracked hits dropped); ``all_*`` columns
    count every finished plate appearance and feed qualification and league totals.
    """
    finished = is_plate_appearance()
    tracked = finished & has_required_tracking()
    aggs = _counts(tracked) + _counts(finished, "all_")
    if expected:
        aggs += _expected_sums(tracked) + _expected_sums(finished, "all_")
    return pitches.groupBy(*by).agg(*aggs).where(F.col("all_total_pa") > 0)


def batting_line(
    totals: DataFrame, by: Sequence[str] = BATTER, minimum: int = S.MIN_PLATE_APPEARANCES,
    expected: bool = True,
) -> DataFrame:
    """Batting line of the qualified batters out of ``batter_totals``.

    Qualification counts every finished plate appearance; ``total_pa`` counts those left
    after untracked hits are dropped.
    """
    line = _add_rates(totals.where((F.col("all_total_pa") >= minimum) & (F.col("total_pa") > 0)))
    columns = LINE_COLUMNS
    if expected:
        line, columns = _add_expected_rates(line), LINE_COLUMNS + EXPECTED_COLUMNS
    return line.select(*by, *columns)


def league_line(
    totals: DataFrame, by: Sequence[str] = ("season",), expected: bool = True, tracked_only: bool = False
) -> DataFrame:
    """Pooled line per league season, summed from the much smaller batter totals."""
    prefix = "" if tracked_only else "all_"
    names = _COUNTS + (_EXPECTED if expected else ())
    pooled = totals.groupBy(*by).agg(*[F.sum(prefix + n).alias(n) for n in names])
    line, columns = _add_rates(pooled), LINE_COLUMNS
    if expected:
        line, columns = _add_expected_rates(line), LINE_COLUMNS + EXPECTED_COLUMNS
    return line.select(*by, *columns)


def add_weighted_on_base(
    lines: DataFrame, weights: DataFrame, *, on: Sequence[str] = ("season",), expected: bool = True
) -> DataFrame:
    """wOBA and its expected twin. ``weights`` has one row per league season (``w_*``)."""
    joined = null_safe_join(lines, weights, list(on), "left")
    c = F.col
    actual = (
        c("w_single") * c("singles") + c("w_double") * c("doubles") + c("w_triple") * c("triples")
        + c("w_home_run") * c("home_runs") + c("w_walk") * c("walks")
    )
    out = {"woba": ratio(actual, c("total_pa"))}
    if expected:
        likely = (
            c("w_single") * c("x1b") + c("w_double") * c("x2b") + c("w_triple") * c("x3b")
            + c("w_home_run") * c("x_home_runs") + c("w_walk") * c("walks")
        )
        out["xwoba"] = ratio(likely, c("total_pa"))
    return joined.withColumns(out).drop("w_single", "w_double", "w_triple", "w_home_run", "w_walk")


def leaderboard(df: DataFrame, by: Column | str, *ties: str) -> DataFrame:
    """Descending order, nulls last, ties broken by ``ties``; sort only where a report is written."""
    column = F.col(by) if isinstance(by, str) else by
    return df.orderBy(column.desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])


def top_k(df: DataFrame, column: str, k: int, *ties: str) -> DataFrame:
    return leaderboard(df, column, *ties).limit(k)
