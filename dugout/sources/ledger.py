"""Stable ids over deliveries: an append-only ledger keyed by content.

A row's key is a digest of the columns that identify it. A delivery adds ids only for keys that the ledger does not have,
so an id never changes and a play that is delivered again, however late, keeps its first one. New ids follow the
largest so far without a gap: every partition of the new keys gets a block as long as it has rows. The new part of the
ledger becomes valid with one switch (:mod:`dugout.sources.publish`), of two deliveries at once the second fails.

Null columns are part of the key like any value; rows that repeat all columns of the key share an id.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dugout.functions.columns import quoted_column
from dugout.sources import publish as P
from dugout.sources.shared import materialize

_PARTITION_BITS = 33  # of monotonically_increasing_id: the row inside its partition


def content_key(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns with their places, null told apart from empty."""
    row = F.to_json(F.array(*[quoted_column(c).cast("string") for c in columns]), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(row, 256))


def read_ledger(spark: SparkSession, base: str) -> DataFrame:
    """(key, id) of all deliveries so far."""
    _, parts, _ = P.published(spark, base)
    frames = [P.read_published(spark, base, name) for name in sorted(parts)]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "key binary, id long")


def extend_ledger(rows: DataFrame, base: str, columns: Sequence[str]) -> int:
    """Give ids to the rows of a delivery that have none; returns how many. Ids start at 1 and have no gaps.

    Only keys travel, 32 bytes a row, and copies of a row meet before they do.
    """
    spark = rows.sparkSession
    number, parts, notes = P.published(spark, base)
    keys = rows.select(content_key(columns).alias("key")).distinct()
    fresh = materialize(keys.join(read_ledger(spark, base), "key", "left_anti").select(
        "key", F.monotonically_increasing_id().alias("place")), "fresh_keys")
    last = notes.get("last", 0)
    partition = F.shiftright("place", _PARTITION_BITS)
    counts = fresh.groupBy(partition.alias("partition")).agg(F.count("*").alias("n"))
    # One row per partition of the new keys.
    along = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(counts.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0)) + F.lit(last + 1)), "blocks")
    inside = F.col("place") - F.shiftleft(partition, _PARTITION_BITS)
    numbered = fresh.withColumn("partition", partition).join(blocks.select("partition", "start"), "partition").select(
        "key", (F.col("start") + inside).alias("id"))
    name = f"delivery-{number + 1:08d}"
    part = P.stage(numbered, base, name, run=uuid.uuid4().hex)
    if part.rows:
        P.switch(spark, base, number, {**parts, name: part}, {**notes, "last": last + part.rows})
    return part.rows


def with_ledger_id(rows: DataFrame, base: str, columns: Sequence[str], name: str = "pitch_id") -> DataFrame:
    """``rows`` with the id that the ledger holds for each; null where it holds none."""
    ledger = read_ledger(rows.sparkSession, base).select(F.col("key").alias("__key"), F.col("id").alias(name))
    keyed = rows.withColumn("__key", content_key(columns))
    return keyed.join(ledger, "__key", "left").drop("__key")
