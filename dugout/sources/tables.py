"""Season tables, extracts, CSV files and named sheets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout import schema as S
from dugout.functions.columns import normalize_names, snake_case

#: text that stands for a missing value in CSV files
NULL_TEXT = "NA"


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column absent from a frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_season_table(df: DataFrame, path: str, season: str = "season") -> None:
    """Replace the seasons present in ``df``, leaving other seasons in place.

    The rebalance hint lets adaptive execution split a large season over several tasks
    and merge small ones, so file sizes stay even.
    """
    (
        df.hint("rebalance", season)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(season)
        .parquet(path)
    )


def read_season_table(spark: SparkSession, path: str, season: int | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if season is None else table.where(F.col("season") == season)


def extract(table: DataFrame, season: int, columns: Sequence[str]) -> DataFrame:
    """Column projection of one season; both reach the Parquet scan."""
    return table.where(F.col("season") == season).select(*columns)


def extract_pitches(table: DataFrame, season: int) -> DataFrame:
    return extract(table, season, S.PITCH_COLUMNS)


def extract_plays(table: DataFrame, season: int) -> DataFrame:
    return extract(table, season, S.PLAY_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", NULL_TEXT).csv(path)


def coerce(value: Column, to: T.DataType) -> Column:
    """Text to ``to``; null where it does not parse."""
    text = F.nullif(value, F.lit(""))
    if isinstance(to, T.DateType):
        return F.try_to_date(text, "yyyy-MM-dd")
    if isinstance(to, (T.IntegerType, T.LongType)):
        # "3.0" and "3.7" are whole numbers to a lenient reader; exact text goes first.
        return F.coalesce(text.try_cast(to), text.try_cast("double").try_cast(to))
    parsed = text.try_cast(to)
    if isinstance(to, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(parsed), parsed)  # "NaN" is a missing value
    return parsed


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns matched by name to ``schema``: cast, padded, extras dropped, reordered."""
    return df.select(*[
        (coerce(F.col(f.name), f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back a CSV extract, columns matched by the names in its header.

    ``NA`` and empty text are null, names become snake case, columns follow ``schema``. All files of
    an extract must have the same header; a file that differs fails the read.
    """
    options = {"header": True, "nullValue": NULL_TEXT, "recursiveFileLookup": True}
    header = spark.read.options(**options).csv(path).columns
    texts = T.StructType([T.StructField(c, T.StringType()) for c in header])
    found = normalize_names(spark.read.schema(texts).options(**options, enforceSchema=False).csv(path))
    wanted = [T.StructField(snake_case(f.name), f.dataType) for f in schema.fields]
    return conform(found, T.StructType(wanted))


def write_sheet(df: DataFrame, base: str, sheet: str) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{sheet}")


def read_sheet(spark: SparkSession, base: str, sheet: str) -> DataFrame:
    """Named table of a workbook-like folder, with lower-case names."""
    return normalize_names(spark.read.parquet(f"{base}/{sheet}"))
