"""Row cleaning: duplicates, batted balls, labels, null profiles, small lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout import schema as S
from dugout.functions.columns import is_in, not_in, null_safe_join
from dugout.operators.ordered import changed_since_previous, hash_rank


def deduplicate(df: DataFrame) -> DataFrame:
    """Drop exact repeats (every game file is delivered once per team).

    ``distinct`` aggregates on the map side first, so many copies of a row leave each
    task as one.
    """
    return df.distinct()


def with_dense_id(df: DataFrame, ids: Sequence[str], *, name: str = "pitch_id", seed: int = 0) -> DataFrame:
    """1..n surrogate id without a global sort."""
    return hash_rank(df, ids=ids, seed=seed, rank=name, size="__size").drop("__size")


def is_plate_appearance(result: str = "play_result") -> Column:
    return F.col(result).isNotNull()


def is_tracked(speed: str = "exit_speed", angle: str = "angle") -> Column:
    return F.col(speed).isNotNull() & F.col(angle).isNotNull()


def is_batted_ball(result: str = "play_result", speed: str = "exit_speed", angle: str = "angle") -> Column:
    return (
        F.col(result).isNotNull()
        & not_in(F.col(result), S.NOT_IN_PLAY)
        & is_tracked(speed, angle)
    )


def hit_indicators(df: DataFrame, result: str = "play_result") -> DataFrame:
    """0/1 doubles, one per hit type; null for a null result."""
    flag = lambda r: F.when(F.col(result) == r, 1.0).when(F.col(result).isNotNull(), 0.0)
    return df.withColumns({
        "is_single": flag(S.SINGLE),
        "is_double": flag(S.DOUBLE),
        "is_triple": flag(S.TRIPLE),
        "is_home_run": flag(S.HOME_RUN),
    })


def outcome_label(result: str = "play_result") -> Column:
    """Five-class outcome of a ball in play."""
    return F.when(is_in(F.col(result), S.HITS), F.col(result)).otherwise(F.lit(S.NOT_A_HIT))


def batted_balls(df: DataFrame) -> DataFrame:
    kept = df.where(is_batted_ball())
    return hit_indicators(kept).withColumn("outcome", outcome_label())


def has_required_tracking(
    result: str = "play_result", speed: str = "exit_speed", angle: str = "angle"
) -> Column:
    """False for results that need a tracked ball but lack speed or angle."""
    return ~(is_in(F.col(result), S.NEEDS_TRACKING) & ~is_tracked(speed, angle))


def tracked_results(df: DataFrame) -> DataFrame:
    return df.where(is_plate_appearance() & has_required_tracking())


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_nulls), from a single aggregate over all columns."""
    one_row = df.agg(
        F.count("*").alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(df.columns)]
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("__n").alias("n_rows"),
                 (F.col("__n") - F.col(f"__{i}")).alias("n_nulls"))
        for i, c in enumerate(df.columns)
    ])
    return one_row.select(F.inline(entries))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold only nulls. Runs one aggregate to learn which they are."""
    found = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if found[f"c{i}"] > 0])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def value_frequencies(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def recode(column: Column, groups: Mapping[str, Iterable[str]]) -> Column:
    """Replace each value listed in a group by the group's name; others stay."""
    out = column
    for target, members in groups.items():
        out = F.when(is_in(column, tuple(members)), F.lit(target)).otherwise(out)
    return out


def attach(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a keyed lookup; null keys match each other, rows without a match stay."""
    return null_safe_join(df, lookup, list(on), "left")


def plate_appearance_changes(
    df: DataFrame, *, half_inning: Sequence[str], order: Sequence[str], chunk: Column,
    counter: str = "pa_of_inning", flag: str = "is_new_pa",
) -> DataFrame:
    """Flag rows whose plate-appearance counter differs from the previous row's."""
    return changed_since_previous(df, counter, by=half_inning, order=order, chunk=chunk, flag=flag)
