"""CSV records with line breaks between quotes, read in splits.

Whether a line break ends a record depends on all quotes before it in the file. A line start is
in one of two states, outside or inside quotes, so a line, and likewise a block of lines, is a
function from the state before it to the state after it. Every block is read under both assumptions at
once; composing the small functions along a file gives each block its true state; a second pass then cuts
the lines of all blocks into records. No task reads more than its split, however long a file is.

A quote opens a quoted field at the start of a field only, and is doubled inside.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dugout.sources.shared import materialize

#: to the closing quote of a field that is open, doubled quotes passed
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"(?!")')
_LINE = "file_path string, block long, line long, before0 boolean, before1 boolean, after0 boolean, after1 boolean, " \
        "start0 long, start1 long, value string"


def open_after(line: str, inside: bool) -> bool:
    """Is a quoted field open after ``line``, given whether one is before it?"""
    at = 0
    while True:
        if inside:
            m = _CLOSING.match(line, at)
            if m is None:
                return True
            at, inside = m.end(), False
        if line.startswith('"', at) and (at == 0 or line[at - 1] == ","):
            at, inside = at + 1, True
            continue
        found = line.find(',"', at)
        if found < 0:
            return False
        at, inside = found + 2, True


class _Block:
    """The lines of one block in order, under the assumptions that it begins outside (0) or inside (1) quotes."""

    def __init__(self, key: tuple):
        self.key, self.line = key, 0
        self.state, self.start = [False, True], [-1, -1]
        self.header: list[str] | None = [] if key[1] == 0 else None
        self.header_done = False
        self.bytes = 0

    def take(self, values: pa.Array) -> dict[str, list]:
        """State before and after each line and the line that its record starts on, for both assumptions."""
        n = len(values)
        quotes = np.flatnonzero(pc.fill_null(pc.match_substring(values, '"'), False).to_numpy(zero_copy_only=False))
        before = [np.empty(n, bool), np.empty(n, bool)]
        after = [np.empty(n, bool), np.empty(n, bool)]
        for h in (0, 1):
            at, state = 0, self.state[h]
            for q in quotes.tolist():  # a line without a quote leaves the state as it is
                before[h][at:q + 1] = state
                after[h][at:q] = state
                state = open_after(values[q].as_py(), state)
                after[h][q] = state
                at = q + 1
            before[h][at:], after[h][at:] = state, state
            self.state[h] = state
        starts = []
        numbers = np.arange(self.line, self.line + n)
        for h in (0, 1):
            found = np.maximum.accumulate(np.where(before[h], -1, numbers)) if n else numbers
            found = np.maximum(found, self.start[h])
            self.start[h] = int(found[-1]) if n else self.start[h]
            starts.append(found)
        if self.header is not None and not self.header_done:
            for value, open_ in zip(values, after[0].tolist()):
                self.header.append(value.as_py())
                if not open_:
                    self.header_done = True
                    break
        self.line += n
        self.bytes += int(pc.sum(pc.binary_length(values)).as_py() or 0) + n
        return {"line": numbers, "before0": before[0], "before1": before[1], "after0": after[0], "after1": after[1],
                "start0": starts[0], "start1": starts[1]}


def _runs(batch: pa.RecordBatch):
    """(path, block, values) of the stretches of a batch that come from one block."""
    paths, blocks, values = batch.column("file_path"), batch.column("block").to_numpy(), batch.column("value")
    if not len(blocks):
        return
    path = paths.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(blocks) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
        yield paths[a].as_py(), int(blocks[a]), values.slice(a, b - a)


def _marked(batches):
    block = None
    for batch in batches:
        for path, start, values in _runs(batch):
            if block is None or block.key != (path, start):
                block = _Block((path, start))
            found = block.take(values)
            yield pa.RecordBatch.from_pydict({
                "file_path": pa.array([path]).take(pa.array(np.zeros(len(values), np.int64))),
                "block": pa.array(np.full(len(values), start)), **{k: pa.array(v) for k, v in found.items()},
                "value": values})


_BLOCK = "file_path string, block long, after0 boolean, after1 boolean, start0 long, start1 long, header string, bytes long"


def _summaries(batches):
    def row(b: _Block):
        header = "\n".join(b.header) if b.header_done else None
        return pa.RecordBatch.from_pylist([{
            "file_path": b.key[0], "block": b.key[1], "after0": b.state[0], "after1": b.state[1], "start0": b.start[0],
            "start1": b.start[1], "header": header, "bytes": b.bytes}], schema=_BLOCK_SCHEMA)

    block = None
    for batch in batches:
        for path, start, values in _runs(batch):
            if block is None or block.key != (path, start):
                if block:
                    yield row(block)
                block = _Block((path, start))
            block.take(values)
    if block:
        yield row(block)


_BLOCK_SCHEMA = pa.schema([
    ("file_path", pa.string()), ("block", pa.int64()), ("after0", pa.bool_()), ("after1", pa.bool_()), ("start0", pa.int64()),
    ("start1", pa.int64()), ("header", pa.string()), ("bytes", pa.int64())])


def _lines(spark: SparkSession, root: str, options: dict) -> DataFrame:
    # Lines are cut at line feeds alone; a carriage return before one belongs to the text until a record is whole.
    return spark.read.options(**options, lineSep="\n").text(root).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))


def block_states(spark: SparkSession, root: str, options: dict) -> DataFrame:
    """One row per block of every file, from one pass: file_path, block, header, bytes, inside, open_block, open_line,
    last_block, last_line, unclosed.

    ``inside``: the block begins between quotes. ``open_*``: where the record starts that is then open.
    ``last_*``: where the file's last record starts; ``unclosed``: it never ends. A file has one row per
    block, so the prefix scan along it reads little even where the file holds most of the text.
    """
    blocks = materialize(_lines(spark, root, options).mapInArrow(_summaries, _BLOCK), "blocks")
    order = Window.partitionBy("file_path").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # A block keeps the state, flips it, or sets it whatever it was. Flips since the last one that sets it count.
    flips = blocks.withColumn("flip", (F.col("after0") & ~F.col("after1")).cast("int")).withColumn(
        "flips", F.sum("flip").over(order))
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct("block", F.col("after0").alias("state"), "flips"))
    known = flips.withColumn("set", F.max(fixed).over(earlier)).withColumn(
        "before", F.coalesce(F.sum("flip").over(earlier), F.lit(0)))
    odd = lambda c: c % 2 == 1
    inside = F.when(F.col("set").isNull(), odd(F.col("before"))).otherwise(
        F.col("set.state") != odd(F.col("before") - F.col("set.flips")))
    stated = known.withColumn("inside", inside)
    own = F.when(F.col("inside"), F.col("start1")).otherwise(F.col("start0"))
    stated = stated.withColumn("last", F.when(own >= 0, F.struct("block", own.alias("line"))))
    whole = Window.partitionBy("file_path")
    ends = F.struct("block", F.when(F.col("inside"), F.col("after1")).otherwise(F.col("after0")).alias("after"))
    return stated.select(
        "file_path", "block", "header", "bytes", "inside", F.max("last").over(earlier).alias("open"),
        F.max("last").over(whole).alias("final"), F.max(ends).over(whole)["after"].alias("unclosed"),
    ).select("file_path", "block", "header", "bytes", "inside", F.col("open.block").alias("open_block"),
             F.col("open.line").alias("open_line"), F.col("final.block").alias("last_block"),
             F.col("final.line").alias("last_line"), "unclosed")


def quoted_records(spark: SparkSession, root: str, states: DataFrame, options: dict) -> DataFrame:
    """file_path, header (is this the first record of its file?), closed, record.

    A record that lies on one line goes straight through; only lines of longer records are shuffled. Lines
    after a quote that is never closed come out one by one with ``closed`` false, so that no record grows with
    its file.
    """
    lines = _lines(spark, root, options).mapInArrow(_marked, _LINE)
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    joined = lines.join(states.drop("header", "bytes"), ["file_path", "block"]).select(
        "file_path", "block", "line", "value", "last_block", "last_line", "unclosed", "open_block", "open_line",
        pick("before").alias("before"), pick("after").alias("after"), pick("start").alias("start"))
    here = F.col("start") >= 0
    placed = joined.select(
        "file_path", "block", "line", "value", "before", "after", "unclosed", "last_block", "last_line",
        F.when(here, F.col("block")).otherwise(F.col("open_block")).alias("first_block"),
        F.when(here, F.col("start")).otherwise(F.col("open_line")).alias("first_line"))
    lost = F.col("unclosed") & (F.col("first_block") == F.col("last_block")) & (F.col("first_line") == F.col("last_line"))
    placed = placed.withColumn("lost", lost)
    is_header = (F.col("first_block") == 0) & (F.col("first_line") == 0)
    alone = F.col("lost") | ~(F.col("before") | F.col("after"))
    single = placed.where(alone).select(
        "file_path", is_header.alias("header"), (~F.col("lost")).alias("closed"), _without_return(F.col("value")).alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    longer = placed.where(~alone).groupBy("file_path", "first_block", "first_line").agg(parts.alias("parts")).select(
        "file_path", is_header.alias("header"), F.lit(True).alias("closed"),
        _without_return(F.array_join(F.col("parts.value"), "\n")).alias("record"))
    return single.unionByName(longer)


def _without_return(text: Column) -> Column:
    return F.regexp_replace(text, "\r$", "")
