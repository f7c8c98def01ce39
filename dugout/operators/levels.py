"""Competition levels: labels, consolidation and the level a player reached in a season."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout import schema as S
from dugout.functions.columns import is_in, null_safe_join
from dugout.operators.clean import recode


def target_level(level: Column) -> Column:
    """The level itself for the named targets; everything else, also null, is ``Other``."""
    other = S.TARGET_LEVELS[-1]
    return F.when(is_in(level, S.TARGET_LEVELS[:-1]), level).otherwise(F.lit(other))


def consolidate_affiliated(level: Column) -> Column:
    return recode(level, {"Affiliated": S.AFFILIATED})


def consolidate_levels(level: Column) -> Column:
    return recode(level, {"Affiliated": S.AFFILIATED, "Independent": S.INDEPENDENT})


def seasons_of(appearances: DataFrame, season: str = "season") -> list[int]:
    """The seasons that occur, in order; the driver receives one number per season."""
    found = appearances.select(season).distinct().where(F.col(season).isNotNull()).collect()
    return sorted(r[0] for r in found)


def season_level(
    appearances: DataFrame, players: DataFrame, *, player: str, seasons: Sequence[int],
    ranks: Mapping[str, int], minimum: int = S.MIN_PLATE_APPEARANCES, excluded: Sequence[str] = (),
) -> DataFrame:
    """Level of each player in each season.

    ``appearances`` holds (player, season, level, pa). The highest level with enough
    plate appearances counts; failing that the level with the most (the higher one on a
    tie); players without appearances are ``DNP``. ``ranks`` orders the levels, 1 highest.
    """
    rank = None
    for level, r in ranks.items():
        hit = F.col("level") == level
        rank = F.when(hit, F.lit(r)) if rank is None else rank.when(hit, F.lit(r))
    rank = rank.otherwise(F.lit(len(ranks) + 1))
    played = (
        appearances.where(F.col("season").isin(*seasons) & ~is_in(F.col("level"), excluded))
        .groupBy(player, "season", "level").agg(F.sum("pa").alias("pa"))
        .withColumn("__rank", rank)
    )
    best = played.groupBy(player, "season").agg(
        F.min_by("level", F.when(F.col("pa") >= minimum, F.struct("__rank", "level"))).alias("__reached"),
        F.max_by("level", F.struct(F.col("pa"), -F.col("__rank"), F.col("level"))).alias("__most"),
        F.count_if(F.col("pa") >= minimum).alias("__qualified"),
    ).select(
        player, "season",
        F.when(F.col("__qualified") > 0, F.col("__reached")).otherwise(F.col("__most")).alias("level"),
    )
    roster = players.select(player).distinct().withColumn(
        "season", F.explode(F.array(*[F.lit(s) for s in seasons]))
    )
    return null_safe_join(roster, best, [player, "season"], "left").withColumn(
        "level", F.coalesce("level", F.lit(S.DID_NOT_PLAY))
    )
