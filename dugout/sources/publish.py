"""Results that appear whole or not at all.

Tables are written to a folder of their own first. Then one small file names the folders that are valid, with
row counts and checksums, and moving that file into place is the only step that readers notice. A run that
stops earlier leaves the last publication as it was; what it wrote is not referred to and can be removed.

Layout below ``base``: ``data/<id>/<table>`` and ``published/<number>.json``; the largest number is valid. The
move must not replace an existing file, so of two runs that publish at once the second fails and loses
nothing. File systems with atomic renames give this (HDFS, a mounted folder); object stores need one that adds them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dugout.functions.columns import quoted_column
from dugout.sources.shared import materialize


@dataclass(frozen=True)
class Part:
    """A published table: its folder relative to the base, format, schema and content."""

    folder: str
    format: str
    schema: str
    rows: int
    checksum: str


class Conflict(RuntimeError):
    """Another run has published since this one looked."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str:
    jvm, target, fs = _hadoop(spark, path)
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole, and fail if it is there already."""
    jvm, target, fs = _hadoop(spark, path)
    _, temporary, _ = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temporary, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(temporary, target, options)
    except Exception as e:
        fs.delete(temporary, False)
        if fs.exists(target):
            raise Conflict(f"{path} exists") from e
        raise


def published(spark: SparkSession, base: str) -> tuple[int, dict[str, Part], dict]:
    """(number, parts by name, notes) of the valid publication; number 0 and nothing if there is none."""
    _, folder, fs = _hadoop(spark, f"{base}/published")
    if not fs.exists(folder):
        return 0, {}, {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}, {}
    found = json.loads(_read_text(spark, f"{base}/published/{max(numbers):08d}.json"))
    return max(numbers), {name: Part(**p) for name, p in found["parts"].items()}, found["notes"]


def content(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a checksum that does not depend on their order; sums of two parts add up."""
    columns = [quoted_column(c) for c in df.columns]
    # As text: the hash of a double is not the same before and after a trip through CSV.
    row = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) if columns else F.lit(0)
    n, total = df.agg(F.count("*"), F.sum(row.cast("decimal(20,0)"))).first()
    return n, str(total or 0)


def stage(df: DataFrame, base: str, name: str, *, run: str, format: str = "parquet", **options) -> Part:
    """Write a table where no reader looks, read it back and describe it.

    Text formats cannot hold everything: a table that does not read back as it was is an error before any reader sees it.
    """
    folder = f"data/{run}/{name}"
    part = Part(folder, format, df.schema.json(), 0, "")
    if format != "parquet":
        df = materialize(df, "staged")
    df.write.format(format).options(**options).save(f"{base}/{folder}")
    found = content(_load(df.sparkSession, base, part))
    if format != "parquet" and found != content(df):
        raise ValueError(f"table {name!r} does not survive the format {format}")
    return Part(folder, format, part.schema, *found)


def _load(spark: SparkSession, base: str, part: Part) -> DataFrame:
    schema = StructType.fromJson(json.loads(part.schema))
    options = {"header": True, "nullValue": "NA", "escape": '"'} if part.format == "csv" else {}
    return spark.read.schema(schema).options(**options).format(part.format).load(f"{base}/{part.folder}")


def switch(spark: SparkSession, base: str, after: int, parts: Mapping[str, Part], notes: dict | None = None) -> int:
    """Make ``parts`` valid as the publication that follows number ``after``."""
    text = json.dumps({"parts": {n: asdict(p) for n, p in parts.items()}, "notes": notes or {}}, indent=1)
    _put_new(spark, f"{base}/published/{after + 1:08d}.json", text)
    return after + 1


def publish(
    tables: Mapping[str, DataFrame], base: str, *, format: str = "parquet", keep_others: bool = True, **options
) -> int:
    """Replace the named tables together, with one switch; other tables stay as they are.

    Every table is on disk and counted before the switch. Returns the number of the publication.
    """
    spark = next(iter(tables.values())).sparkSession
    number, parts, notes = published(spark, base)
    if format == "csv":
        options = {"header": True, "nullValue": "NA", "escape": '"', "ignoreLeadingWhiteSpace": False,
                   "ignoreTrailingWhiteSpace": False, **options}
    run = uuid.uuid4().hex
    staged = {name: stage(df, base, name, run=run, format=format, **options) for name, df in tables.items()}
    return switch(spark, base, number, {**(parts if keep_others else {}), **staged}, notes)


def read_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the valid publication. What is read stays the same if a new one appears meanwhile."""
    _, parts, _ = published(spark, base)
    if name not in parts:
        raise KeyError(f"no table {name!r} is published below {base}")
    return _load(spark, base, parts[name])


def verify(spark: SparkSession, base: str) -> dict[str, bool]:
    """Does each table still have the rows that were published?"""
    _, parts, _ = published(spark, base)
    return {name: content(_load(spark, base, p)) == (p.rows, p.checksum) for name, p in parts.items()}


def remove_unpublished(spark: SparkSession, base: str) -> int:
    """Delete folders below ``data`` that the valid publication does not use. Not while another run is writing."""
    _, parts, _ = published(spark, base)
    used = {p.folder for p in parts.values()}
    _, folder, fs = _hadoop(spark, f"{base}/data")
    removed = 0
    for run in fs.listStatus(folder) if fs.exists(folder) else []:
        for table in fs.listStatus(run.getPath()):
            if f"data/{run.getPath().getName()}/{table.getPath().getName()}" not in used:
                removed += bool(fs.delete(table.getPath(), True))
        if not fs.listStatus(run.getPath()):
            fs.delete(run.getPath(), True)
    return removed
