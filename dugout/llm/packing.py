"""Pack token sequences into windows of fixed size, with a bounded number of open windows.

Every partition packs on its own: full windows of a document go out at once, the rest is put
into the open window that it fills best, and when none has room the fullest is closed. What
is still open at the end of a partition is merged in groups of bounded size, where pieces are
cut to fill windows exactly.

Defined results: a null text counts as empty and consists of the end token alone. Rows that
repeat an id are packed each on its own. Sequence ids are unique; they follow from partition
and group numbers, so a task that runs again produces the same rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dugout.llm.common import arrow_schema, id_and_text, slices
from dugout.sources.shared import materialize

WINDOW, OPEN_WINDOWS, MERGE_WINDOWS = 1024, 256, 4096
_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MERGED = 1 << 62  # sequence ids of merged leftovers start here

#: Characters on which both libraries agree how text is split: Latin letters and common signs.
_PLAIN = regex.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027\\u20ac]*+")


class TextEncoder:
    """Ids as the tokenizer file defines them, taken from the faster rank library where both agree.

    The rank file is the same vocabulary. Texts that hold an added token of the tokenizer file, or
    characters outside the Latin blocks, go to the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        self.exact = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


class OpenWindows:
    """At most ``limit`` windows, each with room left; best fit, the fullest is closed first."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.by_fill: list[tuple[int, int]] = []  # (fill, window), sorted
        self.content: dict[int, list] = {}
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, length: int, piece) -> list[tuple[int, list]]:
        """Place a piece; the windows that are closed by it, as (window, pieces)."""
        closed = []
        # Fullest window with room: the last one whose fill is at most size - length.
        i = bisect_left(self.by_fill, (self.size - length + 1, -1)) - 1
        if i >= 0:
            fill, window = self.by_fill.pop(i)
        else:
            if len(self.by_fill) >= self.limit:
                _, full = self.by_fill.pop()
                closed.append((full, self.content.pop(full)))
            fill, window = 0, self.new()
            self.content[window] = []
        self.content[window].append(piece)
        if fill + length == self.size:
            closed.append((window, self.content.pop(window)))
        else:
            insort(self.by_fill, (fill + length, window))
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return sorted(self.content.items())


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    parts = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, schema)], schema=schema)


def _pack_partition(encode, size: int, limit: int, end_id: int, schema: pa.Schema):
    def run(batches):
        encoder, windows = encode(), OpenWindows(size, limit)
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(window: int, pieces: list, leftover: bool = False) -> None:
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), _crc(ids), total, base + window, at,
                             ids.astype("<u4").tobytes() if leftover else None))
                at += len(ids)

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array(encoder(text or "") + [end_id], np.uint32)
                    whole = len(ids) - len(ids) % size
                    for start in range(0, whole, size):
                        emit(windows.new(), [(doc, start, ids[start:start + size], len(ids))])
                    if whole < len(ids):
                        for window, pieces in windows.put(len(ids) - whole, (doc, whole, ids[whole:], len(ids))):
                            emit(window, pieces)
                yield _columns(rows, schema)
                rows.clear()
        for window, pieces in windows.rest():
            emit(window, pieces, leftover=True)
        yield _columns(rows, schema)

    return run


def _merge_group(size: int, schema: pa.Schema):
    """Concatenate the pieces of a group of leftover windows and cut them into full windows."""

    def run(key, table):
        group = key[0].as_py()
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows, at = [], 0
        for r in table.to_pylist():
            ids, start = np.frombuffer(r["ids"], "<u4"), r["start"]
            while len(ids):
                take = min(len(ids), size - at % size)
                rows.append((r["doc_id"], start, take, _crc(ids[:take]), r["doc_tokens"],
                             _MERGED + (group << 32) + at // size, at % size))
                ids, start, at = ids[take:], start + take, at + take
        return pa.Table.from_batches([_columns(rows, schema)])

    return run


def pack_documents(
    df: DataFrame,
    *,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_windows: int = MERGE_WINDOWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are encoded where they are read; only the leftovers, at most ``open_windows`` per
    partition, are shuffled, in groups of about ``merge_windows`` windows.
    """
    first = materialize(
        id_and_text(df, id_col, text_col).mapInArrow(
            _pack_partition(lambda: TextEncoder(tokenizer_path, ranks_path, pattern), window, open_windows,
                            end_id, arrow_schema(_FIELDS + ", ids binary")),
            _FIELDS + ", ids binary",
        ), "packed",
    )
    left = first.where("ids IS NOT NULL")
    groups = max(1, -(-left.select("sequence_id").distinct().count() // merge_windows))
    merged = (
        left.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        .groupBy("group").applyInArrow(_merge_group(window, arrow_schema(_FIELDS)), _FIELDS)
    )
    return first.where("ids IS NULL").drop("ids").unionByName(merged)
