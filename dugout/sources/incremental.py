"""Season tables that follow a growing tree of CSV files.

A manifest remembers every file that is in the table: path, size, time and a digest of its lines. A run lists the tree,
reads only files that are new or changed, and rewrites only the seasons that they, or files that are
gone, belong to. Seasons and manifest become valid together, with one switch (:mod:`dugout.sources.publish`).

A play that several files deliver is one row, with the files it came from in ``source_files``, so that it stays while one
of them does.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.functions.columns import null_safe_join, quoted_column
from dugout.sources import publish as P
from dugout.sources.csv_tree import _TREE, read_csv_tree
from dugout.sources.shared import materialize

FILES = "files"
_SOURCES = "source_files"
_MANIFEST = "season int, file_path string, length long, modified timestamp, digest string"


@dataclass(frozen=True)
class Delivery:
    """What a run did: the publication that is valid now, files listed, read and gone, seasons rewritten, and rejects."""

    number: int
    listed: int
    read: int
    gone: int
    seasons: tuple[int, ...]
    quarantine: DataFrame | None = None


def _listing(spark: SparkSession, roots: Mapping[int, str]) -> DataFrame:
    """season, file_path, length, modified of all files, without their content."""
    found = []
    for season, root in roots.items():
        try:
            files = spark.read.format("binaryFile").options(**_TREE).load(root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(files.where("length > 0").select(
            F.lit(season).alias("season"), F.col("_metadata.file_path").alias("file_path"), "length",
            F.col("modificationTime").alias("modified")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame(
        [], "season int, file_path string, length long, modified timestamp")


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, digest: two sums of hashes over the lines of each file, in splits; the order of lines does not count."""
    lines = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file_path"))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)")).cast("string")
    return lines.groupBy("file_path").agg(F.concat_ws(
        ":", total("value"), total(F.lit("second"), "value"), F.count("*").cast("string")).alias("digest"))


def _add_files(old: DataFrame | None, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of a season with their files, after ``gone`` left and ``new`` (row columns, file) came."""
    columns = [quoted_column(c) for c in new.columns if c != "file_path"]
    rows = new
    if old is not None:
        single = old.select(*columns, F.explode(_SOURCES).alias("file_path"))
        rows = single.join(gone.select("file_path"), "file_path", "left_anti").select(*columns, "file_path").unionByName(new)
    return rows.groupBy(*columns).agg(F.array_sort(F.collect_set("file_path")).alias(_SOURCES))


def ingest_deliveries(
    spark: SparkSession, roots: Mapping[int, str], base: str, schema: T.StructType, **options
) -> Delivery:
    """Bring the season tables below ``base`` up to date with the CSV trees of ``roots``.

    A run without new, changed or missing files lists the trees and does nothing else. Only the paths of files to
    read reach the driver, where the reader needs them. ``options`` go to ``read_csv_tree``.
    """
    number, parts, notes = P.published(spark, base)
    listing = materialize(_listing(spark, roots), "listing")
    listed = listing.count()
    known = P.read_published(spark, base, FILES) if FILES in parts else spark.createDataFrame([], _MANIFEST)
    known = known.where(F.col("season").isin(list(roots)))
    same = ["season", "file_path", "length", "modified"]
    fresh = listing.join(known.select(*same), same, "left_anti")
    absent = known.join(listing.select("season", "file_path"), ["season", "file_path"], "left_anti")
    paths = [r["file_path"] for r in fresh.select("file_path").distinct().collect()]
    if not paths and absent.isEmpty():
        return Delivery(number, listed, 0, 0, ())

    arrived = fresh.withColumn("digest", F.lit(None).cast("string"))
    if paths:
        arrived = materialize(fresh.join(file_digests(spark, paths), "file_path", "left"), "arrived")
    # A file whose time alone has changed keeps its rows.
    content = ["season", "file_path", "length", "digest"]
    changed = materialize(null_safe_join(arrived, known.select(*content), content, "left_anti"), "changed")
    leaving = absent.select("season", "file_path").unionByName(
        known.join(changed.select("season", "file_path"), ["season", "file_path"], "left_semi").select("season", "file_path"))
    leaving = materialize(leaving, "leaving")
    seasons = sorted(r["season"] for r in changed.select("season").union(leaving.select("season")).distinct().collect())

    run, staged, rejected, read = uuid.uuid4().hex, {}, [], 0
    for season in seasons:
        files = [r["file_path"] for r in changed.where(F.col("season") == season).select("file_path").collect()]
        new = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file_path", T.StringType())]))
        if files:
            tree = read_csv_tree(spark, files, schema, with_path=True, **options)
            new = tree.rows
            rejected.append(tree.quarantine.select(F.lit(season).alias("season"), "*"))
        name = f"season={season}"
        old = P.read_published(spark, base, name) if name in parts else None
        staged[name] = P.stage(_add_files(old, leaving.where(F.col("season") == season), new), base, name, run=run)
        read += len(files)
    untouched = known.join(fresh.select("season", "file_path"), ["season", "file_path"], "left_anti").join(
        absent.select("season", "file_path"), ["season", "file_path"], "left_anti")
    others = P.read_published(spark, base, FILES).where(~F.col("season").isin(list(roots))) if FILES in parts else known.limit(0)
    manifest = untouched.unionByName(arrived.select(*known.columns)).unionByName(others)
    staged[FILES] = P.stage(manifest, base, FILES, run=run)
    gone = leaving.count()
    number = P.switch(spark, base, number, {**parts, **staged}, notes)
    quarantine = reduce(DataFrame.unionByName, rejected) if rejected else None
    return Delivery(number, listed, read, gone, tuple(seasons), quarantine)


def read_seasons(spark: SparkSession, base: str, seasons: list[int] | None = None) -> DataFrame:
    """The rows of the valid seasons, with their season; None means all."""
    _, parts, _ = P.published(spark, base)
    names = sorted(n for n in parts if n.startswith("season="))
    wanted = [n for n in names if seasons is None or int(n[7:]) in seasons]
    if not wanted:
        raise KeyError(f"no such season is published below {base}")
    frames = [P.read_published(spark, base, n).drop(_SOURCES).withColumn("season", F.lit(int(n[7:]))) for n in wanted]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
