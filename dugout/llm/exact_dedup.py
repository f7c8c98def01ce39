"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

Defined results: a null text counts as empty. A null id loses against any other id; if all
ids of a group are null the kept row has a null id. Rows that repeat id and text are copies
of each other and exactly one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import ascii_lower, id_and_text, quoted
from dugout.sources.shared import materialize

#: internal names; prefixed so that they cannot meet a column of the input
_HASH, _BODY, _BEST = "__hash128", "__body", "__best"


def _preference(keep: str, *parts: Column) -> Column:
    """Struct whose maximum is the row that stays; null ids come last."""
    id_, rest = parts[0], parts[1:]
    if keep == "largest":
        return F.struct(id_.isNotNull().alias("known"), id_.alias("rank"), *rest)
    if keep == "smallest":
        return F.struct(id_.isNotNull().alias("known"), (-id_).alias("rank"), *rest)
    raise ValueError("keep must be 'smallest' or 'largest'")


def exact_groups(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts meet in one aggregate on (hash, normalised text). Its map side combines copies, so a
    text that fills a third of the table reaches the reducer as one row per task, and the key
    comparison of the aggregate is the byte comparison that keeps colliding texts apart. Rows
    themselves travel as (row number, id, hash, SHA-256) only.
    """
    body = normalise(F.coalesce(F.col("text"), F.lit("")))
    source = id_and_text(df, id_col, text_col).select("doc_id", body.alias("body"))
    source = source.select("doc_id", "body", content_hash(F.col("body")).alias("hash"))
    members = materialize(
        source.select(
            "doc_id", "hash", F.sha2("body", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ), "members",
    )
    classes = materialize(
        source.groupBy("hash", "body").agg(F.count("*").alias("group_size"))
        .select("hash", F.sha2("body", 256).alias("text_sha256"), "group_size"), "classes",
    )
    key = ["hash", "text_sha256"]
    if not classes.groupBy(*key).count().where("count > 1").isEmpty():
        raise ArithmeticError("two different texts share both hashes")
    best = members.groupBy(*key).agg(F.max(_preference(keep, F.col("doc_id"), (-F.col("row")).alias("tie"))).alias("best"))
    keep_id = F.col("best.rank") if keep == "largest" else -F.col("best.rank")
    # Written, so that both sides of the last join are shuffled and adaptive execution can split a large group.
    decided = materialize(classes.join(best, key).select(
        *key, "group_size", keep_id.alias("keep_id"), (-F.col("best.tie")).alias("keep_row")
    ), "decided")
    return members.join(decided, key).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def exact_survivors(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they were: one row per text.

    The same grouping as :func:`exact_groups`, with the row carried through the aggregate.
    Among rows that repeat id and text one is chosen by the hash of its other columns.
    """
    columns = [quoted(c) for c in df.columns]
    body = normalise(F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    order = _preference(keep, quoted(id_col).cast("long"), F.xxhash64(*columns).alias("tie"))
    keyed = df.select(F.struct(*columns).alias("row"), body.alias(_BODY), order.alias(_BEST))
    grouped = keyed.withColumn(_HASH, content_hash(F.col(_BODY))).groupBy(_HASH, _BODY)
    return grouped.agg(F.max_by("row", _BEST).alias("row")).select("row.*")
