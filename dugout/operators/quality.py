"""Contact quality per player and binned response summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout import schema as S
from dugout.functions.columns import null_safe_join, ratio
from dugout.operators.clean import is_plate_appearance
from dugout.operators.ordered import top_fraction_mean
from dugout.sources.shared import materialize

BATTER = ("season", "batter")


def hit_quality(
    pitches: DataFrame, by: Sequence[str] = BATTER, minimum: int = S.MIN_PLATE_APPEARANCES,
    hard_hit: float = S.HARD_HIT_SPEED,
) -> DataFrame:
    """Hard-hit share, mean speed and mean angle of the tracked balls of qualified batters.

    Qualification and the averages come out of the same aggregate, so no semi-join is needed.
    """
    speed, tracked = F.col("exit_speed"), F.col("exit_speed").isNotNull()
    line = pitches.groupBy(*by).agg(
        F.count_if(is_plate_appearance()).alias("__pa"),
        F.count_if(tracked & (speed >= hard_hit)).alias("total_hard_hits"),
        F.count("exit_speed").alias("total_batted_balls"),
        F.avg("exit_speed").alias("avg_exit_speed"),
        F.avg(F.when(tracked, F.col("angle"))).alias("avg_angle"),
    )
    return (
        line.where((F.col("__pa") >= minimum) & (F.col("total_batted_balls") > 0))
        .withColumn("hard_hit_percentage", ratio(F.col("total_hard_hits"), F.col("total_batted_balls")))
        .drop("__pa")
    )


def top_half_quality(
    pitches: DataFrame, by: Sequence[str] = BATTER, minimum: int = S.MIN_PLATE_APPEARANCES,
    top: float = 0.5, bin_width: float = 0.5,
) -> DataFrame:
    """Mean of the fastest ``top`` share of each qualified batter's tracked balls, and mean angle.

    ``top=1.0`` gives the plain mean.
    """
    plain = hit_quality(pitches, by, minimum)
    if top < 1.0:
        plain = materialize(plain, "qualified")  # read to choose the pitches and again for the result
    if top >= 1.0:
        return plain.select(*by, F.col("avg_exit_speed").alias("avg_exit_speed_top"), "avg_angle")
    chosen = null_safe_join(pitches.select(*by, "exit_speed"), plain.select(*by), list(by), "left_semi")
    fastest = top_fraction_mean(
        chosen, "exit_speed", by=by, top=top, name="avg_exit_speed_top", bin_width=bin_width
    )
    # Small on both sides: one row per batter.
    return null_safe_join(plain.select(*by, "avg_angle"), fastest, list(by), "left").select(
        *by, "avg_exit_speed_top", "avg_angle"
    )


def binned_trend(
    df: DataFrame, xs: Mapping[str, tuple[float, float]], ys: Sequence[str], *, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """(by, x, y, bin, n, mean_x, mean_y, sd_y): mean and spread of each ``y`` along each ``x``.

    ``xs`` maps a column to its range, cut into equal bins; bins 0 and ``bins + 1`` collect
    the tails. All pairs are summarised in one pass.
    """
    pairs = F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), _bucket(x, low, high, bins).alias("bin"),
                 F.col(x).alias("x_value"), F.col(y).alias("y_value"))
        for x, (low, high) in xs.items() for y in ys
    ])
    points = df.select(*by, F.inline(pairs))
    return points.where(F.col("x_value").isNotNull() & F.col("y_value").isNotNull()).groupBy(
        *by, "x", "y", "bin"
    ).agg(
        F.count("*").alias("n"), F.avg("x_value").alias("mean_x"),
        F.avg("y_value").alias("mean_y"), F.stddev_samp("y_value").alias("sd_y"),
    )


def binned_scatter(
    df: DataFrame, x: str, y: str, *, x_range: tuple[float, float], y_range: tuple[float, float],
    bins: int, by: Sequence[str] = (),
) -> DataFrame:
    """Point counts on an even grid, in place of drawing every point."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return kept.groupBy(
        *by, _bucket(x, *x_range, bins).alias("x_bin"), _bucket(y, *y_range, bins).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def _bucket(c: str, low: float, high: float, bins: int):
    return F.width_bucket(F.col(c), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
