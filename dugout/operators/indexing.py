"""League averages and indexed ("plus") statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions.columns import null_safe_join, ratio, scale_suffix
from dugout.sources.shared import materialize

INDEXED = ("xba", "xobp", "xslg", "xops", "k_percentage", "bb_percentage", "woba", "xwoba")


def league_average(
    players: DataFrame, stats: Sequence[str] = INDEXED, by: Sequence[str] = ("season",)
) -> DataFrame:
    """Unweighted mean over players (method 1)."""
    return players.groupBy(*by).agg(*[F.avg(s).alias(s) for s in stats])


def plus_stats(
    players: DataFrame, league: DataFrame, stats: Sequence[str] = INDEXED,
    by: Sequence[str] = ("season",), scale: float = 100.0, baseline_season: int | None = None,
) -> DataFrame:
    """``scale * player / league`` as ``<stat>_plus``.

    ``league`` has one row per season. ``baseline_season`` indexes every season against
    that season's league row instead of its own.
    """
    base = league.select(*by, *stats)
    if baseline_season is not None:
        # One row per season, so a window over the league table is as small as the table.
        alike = W.partitionBy(*[c for c in by if c != "season"])
        at = lambda s: F.max(F.when(F.col("season") == baseline_season, F.col(s))).over(alike)
        base = base.withColumns({s: at(s) for s in stats})
    renamed = base.withColumnsRenamed({s: f"__{s}" for s in stats})
    joined = null_safe_join(players, renamed, list(by), "left")
    indexed = joined.withColumns({f"{s}_plus": ratio(F.col(s), F.col(f"__{s}")) for s in stats})
    indexed = indexed.drop(*[f"__{s}" for s in stats])
    return scale_suffix(indexed, "_plus", scale)


def simple_index(
    profiles: DataFrame, stat: str, *, by: Sequence[str] = (), name: str | None = None, scale: float = 1.0
) -> DataFrame:
    """``scale * stat / mean(stat)``, over the whole frame or within ``by``.

    The profiles, one row per player, are read for the mean and again for the index; they are written first.
    """
    name = name or f"{stat}_plus"
    profiles = materialize(profiles, "profiles")
    if not by:
        mean = profiles.agg(F.avg(stat)).scalar()
        return profiles.withColumn(name, F.lit(scale) * F.try_divide(F.col(stat), mean))
    means = profiles.groupBy(*by).agg(F.avg(stat).alias("__mean"))
    return null_safe_join(profiles, means, list(by), "left").withColumn(
        name, F.lit(scale) * F.try_divide(F.col(stat), F.col("__mean"))
    ).drop("__mean")
