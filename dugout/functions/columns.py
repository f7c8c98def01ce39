"""Null-safe predicates, safe ratios, composite keys and header names.

Spark's three-valued logic and ANSI errors differ from the statistics conventions
the operators follow (a null is simply "not in the set", an empty sum is 0), so the
rules live here once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_in(col: Column, values: Iterable) -> Column:
    """Set membership that is false, not null, for a null value."""
    return F.coalesce(col.isin(*values), F.lit(False))


def not_in(col: Column, values: Iterable) -> Column:
    """Set exclusion that keeps null values."""
    return ~is_in(col, values)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double; null when the denominator is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sum_or_zero(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def key_of(*cols: str) -> Column:
    """Composite key as a struct.

    Struct equality treats null fields as equal, so joins on the key are null-safe,
    and one physical partitioning serves the aggregate, the window and the join.
    """
    return F.struct(*[F.col(c) for c in cols]) if cols else F.struct(F.lit(0).alias("all"))


def unpack_key(df: DataFrame, key: str, cols: Iterable[str], *rest) -> DataFrame:
    return df.select(*[F.col(key)[c].alias(c) for c in cols], *rest)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other; the right key columns are dropped."""
    if not on:
        raise ValueError("a join needs at least one key")
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = eq if cond is None else cond & eq
    joined = left.join(renamed, cond, how)
    return joined if how == "left_semi" else joined.drop(*[f"__r_{c}" for c in on])


#: word starts inside a name: ``ExitSpeed``, ``GameID``, ``PAofInning``; not ``wOBA`` or ``xSLG``
_WORD_START = re.compile(r"(?<=[a-z0-9])(?=[A-Z][a-z])|(?<=[a-z])(?=ID$)|(?<=[A-Z])(?=of[A-Z])")


def snake_case(name: str) -> str:
    """``Top/Bottom`` -> ``top_bottom``, ``xWOBA_plus`` -> ``xwoba_plus``, ``2024.Level`` -> ``level_2024``."""
    words = _WORD_START.sub("_", name.strip())
    words = re.sub(r"[^0-9A-Za-z]+", "_", words).strip("_").lower()
    leading_year = re.fullmatch(r"(\d{4})_(.+)", words)
    return f"{leading_year[2]}_{leading_year[1]}" if leading_year else words


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def scale_suffix(df: DataFrame, suffix: str, factor: float) -> DataFrame:
    """Multiply every column whose name ends with ``suffix``."""
    return df.withColumns({c: F.col(c) * F.lit(factor) for c in df.columns if c.endswith(suffix)})


def minute_chunk(ts: str, minutes: int = 60) -> Column:
    """Running number of the wall-clock slice a timestamp falls in; monotone in ``ts``.

    Works on zone-less timestamps without a time-zone conversion.
    """
    c = F.col(ts)
    total = F.unix_date(F.to_date(c)).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return F.floor(total / F.lit(minutes)).cast("long")


def quoted_column(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
