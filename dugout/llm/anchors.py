"""Which parts of which documents may hold a sequence that occurs elsewhere.

Two operators look for sequences of ``length`` units (words or bytes) that occur more than
once in the corpus. Listing all windows of a corpus would move it several times over, so they
share this sieve. Each window is represented by its anchor, the gram of ``gram`` units with the
smallest hash inside it. The anchor depends on the window's content alone, so equal windows have
equal anchors, and a window whose anchor occurs once in the corpus occurs once itself. Neighbouring
windows mostly share their anchor, which leaves one anchor for several windows.

* Documents are written once to the shared folder, in buckets of bounded size that later steps
  read without a shuffle.
* Anchors go to shards as sorted arrays of 32 bits each; a shard returns to each bucket the
  anchors that occur elsewhere too. Chance agreement of hashes only lets a candidate through.
* Runs of windows with a recurring anchor become segments. An anchor with more than ``hot``
  occurrences is divided further by the content around it, so no shard gathers all places of a
  common phrase.

What remains, deciding which windows really recur, is done on the text itself by the operators.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import arrow_schema, id_and_text, quoted
from dugout.sources.shared import materialize, new_path

#: text in a bucket, and text that is hashed at a time
BUCKET_BYTES, PART_BYTES = 4 << 20, 1 << 20
#: buckets whose anchors one shard may gather, about 256 MB of text
SHARD_BUCKETS = 64
NO_ID = np.iinfo(np.int64).max  # null ids come after all others
_LOW = np.uint64(0xFFFFFFFF)
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Sieve:
    """What is looked for: windows of ``length`` units, anchors of ``gram`` units."""

    length: int
    gram: int
    unit: str  # "words" or "bytes"
    per_document: bool  # an anchor must occur in two documents, not just twice
    shards: int
    hot: int = 2000
    #: windows of a hot anchor that still travel together
    hot_run: int = 1


# --- hashing --------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of all grams of a text, from prefix sums modulo 2^64."""

    def __init__(self, sieve: Sieve):
        self.gram, self.words = sieve.gram, sieve.unit == "words"
        self.table = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
        self.room = 0

    def _prefix(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if n >= self.room:
            self.room = n + 1
            self.up = _powers(self.room, int(_STEP))
            self.down = _powers(self.room, pow(int(_STEP), -1, 1 << 64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[:n], out=sums[1:])
        return sums

    def grams(self, raw: bytes) -> np.ndarray:
        """``raw`` is any text, or words joined by single spaces if words are the units."""
        text = np.frombuffer(raw, np.uint8)
        sums = self._prefix(text)
        if not self.words:
            n = len(text) - self.gram + 1
            return mix((sums[self.gram:] - sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)
        start = word_starts(raw)
        word = mix((sums[np.append(start[1:] - 1, len(text))] - sums[start]) * self.down[start])
        n = len(start) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(self.gram):
            out = out * _OTHER + word[k:k + n]
        return mix(out)


def word_starts(flat: bytes) -> np.ndarray:
    """Where the words of a text begin whose words are joined by single spaces."""
    if not flat:
        return np.zeros(0, np.int64)
    return np.append(0, np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) + 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_runs(grams: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Maximal runs of neighbouring windows with the same anchor: first window, count, anchor place.

    ``ends[i]`` is where the document of unit ``i`` ends; windows do not cross it.
    """
    n = len(ends) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty
    # Hash in the upper half, place in the lower: the smallest hash, leftmost among equals.
    packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(packed, length - gram + 1) & _LOW).astype(np.int64)
    at = np.flatnonzero(ends[:n] - np.arange(n) >= length)
    if not len(at):
        return empty, empty, empty
    place = place[at]
    first = np.ones(len(at), bool)
    first[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(first)
    return at[heads], np.diff(np.append(heads, len(at))), place[heads]


# --- a bucket of documents --------------------------------------------------------------


class Bucket:
    """Documents of a bucket with the runs of their windows.

    Arrays with one entry per run: ``doc`` (row of the bucket), ``start`` (unit inside the
    document), ``count`` (windows), ``place`` (unit of the anchor), ``key`` (hash of the anchor).
    ``flat`` is the text of a row, with single spaces if words are the units; ``edge`` is where its
    units begin, and one more for the end.
    """

    def __init__(self, table: pa.Table, sieve: Sieve):
        self.sieve = sieve
        self.ids = table.column("doc_id").fill_null(int(NO_ID)).to_numpy()
        self.raw = table.column("text").to_pylist()
        if sieve.unit == "words":
            self.flat = [b" ".join(t.split()) for t in self.raw]
            self.edge = [np.append(word_starts(t), len(t) + 1) for t in self.flat]
            self.size = [len(e) - 1 for e in self.edge]
        else:
            self.flat, self.size = self.raw, [len(t) for t in self.raw]
        hasher = Hasher(sieve)
        found = [self._part(rows, hasher) for rows in self._parts()]
        names = ("doc", "start", "count", "place", "key")
        for i, name in enumerate(names):
            kind = np.uint64 if name == "key" else np.int64
            setattr(self, name, np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind))

    def content(self, doc: int, start: int, stop: int) -> bytes:
        if self.sieve.unit == "words":
            edge = self.edge[doc]
            return self.flat[doc][edge[start]:edge[stop] - 1]
        return self.flat[doc][start:stop]

    def _parts(self):
        """(document, from unit, to unit): groups of about PART_BYTES; long documents in overlapping pieces."""
        per_unit = 6 if self.sieve.unit == "words" else 1
        room, overlap = PART_BYTES // per_unit, self.sieve.length - 1
        part, held = [], 0
        for d, size in enumerate(self.size):
            start = 0
            while size - start >= self.sieve.length:
                stop = min(size, start + max(room, 2 * self.sieve.length))
                if held and held + stop - start > room:
                    yield part
                    part, held = [], 0
                part.append((d, start, stop))
                held += stop - start
                if stop == size:
                    break
                start = stop - overlap
        if part:
            yield part

    def _part(self, rows, hasher):
        sizes = np.array([b - a for _, a, b in rows])
        offsets = np.cumsum(sizes) - sizes
        ends = np.repeat(offsets + sizes, sizes)
        glue = b" " if self.sieve.unit == "words" else b""
        grams = hasher.grams(glue.join([self.content(d, a, b) for d, a, b in rows]))
        start, count, place = window_runs(grams, ends, self.sieve.length, self.sieve.gram)
        row = np.searchsorted(offsets, start, side="right") - 1
        shift = np.array([a for _, a, _ in rows])[row] - offsets[row]
        doc = np.array([d for d, _, _ in rows])[row]
        return doc, start + shift, count, place + shift, mix(grams[place] ^ _OTHER)

    def shard_keys(self) -> np.ndarray:
        """Shard in the upper, 32 bits of the hash in the lower half."""
        shard = (self.key >> np.uint64(32)) % np.uint64(self.sieve.shards)
        return (shard << np.uint64(32)) | (self.key & _LOW)

    def anchor_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and their number of documents or places, at most 255."""
        keys = self.shard_keys()
        if self.sieve.per_document:
            ids = self.ids[self.doc]
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys = keys[new]
        found, counts = np.unique(keys, return_counts=True)
        return found, np.minimum(counts, 255).astype(np.uint8)

    def segments(self, recurring: np.ndarray, hot: np.ndarray) -> Segments:
        """Runs whose anchor recurs; those of a hot anchor in steps of ``hot_run`` windows."""
        keys = self.shard_keys()
        known, is_hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        if len(recurring):
            at = np.minimum(np.searchsorted(recurring, keys), len(recurring) - 1)
            known = recurring[at] == keys
            is_hot = known & hot[at]
        cold = np.flatnonzero(known & ~is_hot)
        doc, start, count, route = self.doc[cold], self.start[cold], self.count[cold], self.key[cold]
        more = [s for r in np.flatnonzero(is_hot).tolist() for s in self._steps(r)]
        if more:
            d, f, n, k = zip(*more)
            doc, start, count = np.append(doc, d), np.append(start, f), np.append(count, n)
            route = np.append(route, np.array(k, np.uint64))
        return Segments(self, doc, start, count, route)

    def _steps(self, run: int):
        step, length = self.sieve.hot_run, self.sieve.length
        doc, place = int(self.doc[run]), int(self.place[run])
        first, stop = int(self.start[run]), int(self.start[run] + self.count[run])
        while first < stop:
            # Windows whose distance to the anchor falls into the same step go together; the part that
            # all windows of the step share says where.
            top = place - (place - first) // step * step  # last window of the step
            last = min(stop - 1, top)
            shared = self.content(doc, top, top - step + 1 + length)
            yield doc, first, last - first + 1, xxhash.xxh3_64_intdigest(shared)
            first = last + 1


class Segments:
    """Candidate places of a bucket and the distinct texts among them.

    ``doc``, ``start``, ``count`` and ``code`` describe places; ``code`` numbers distinct texts, whose
    128-bit digests, one place each (``sample``) and routes are listed in that order.
    """

    def __init__(self, bucket: Bucket, doc, start, count, route):
        self.bucket, self.doc, self.start, self.count = bucket, doc, start, count
        stop = start + count + bucket.sieve.length - 1
        if bucket.sieve.unit == "words" and len(doc):
            sizes = np.array([len(e) for e in bucket.edge])
            edges, offset = np.concatenate(bucket.edge), np.cumsum(sizes) - sizes
            self.low, self.high = edges[offset[doc] + start], edges[offset[doc] + stop] - 1
        else:
            self.low, self.high = start, stop
        digest, flat = xxhash.xxh3_128_digest, bucket.flat
        number: dict[bytes, int] = {}
        name = number.setdefault
        places = zip(doc.tolist(), self.low.tolist(), self.high.tolist())
        self.code = np.array([name(digest(flat[d][a:b]), len(number)) for d, a, b in places], np.int64)
        self.digests = list(number)
        _, self.sample = np.unique(self.code, return_index=True)
        self.route = route[self.sample]

    def text(self, code: int) -> bytes:
        at = self.sample[code]
        return self.bucket.flat[self.doc[at]][self.low[at]:self.high[at]]

    def by_shard(self, shards: int):
        """(shard, codes) of the distinct texts; texts of one anchor side by side."""
        shard = ((self.route >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.route, shard))
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for codes in np.split(order, cuts):
            if len(codes):
                yield int(shard[codes[0]]), codes


# --- arrays in binary columns ---------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, one after the other, compressed."""
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(body) // sum(widths)
    out, at = [], 0
    for kind, width in zip(kinds, widths):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * width
    return out


# --- the distributed steps --------------------------------------------------------------------


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    parts = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(p, f.type) for p, f in zip(parts, schema)], schema=schema)


def bucket_table(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Write (bucket, doc_id, text as bytes[, row]) to the shared folder, bucketed for later steps.

    A bucket is a slice of one input partition, so nothing is shuffled. With ``carry`` the whole
    input row travels along as a struct.
    """
    spark = df.sparkSession
    source = id_and_text(df, id_col, text_col)
    if carry:
        source = df.select(
            quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"),
            F.struct(*[quoted(c) for c in df.columns]).alias("row"),
        )
    source = source.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    numbered = source.select(F.lit(0).cast("long").alias("bucket"), *source.columns)

    def assign(batches):
        number, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_pylist()
            labels = []
            for size in sizes:
                if held and held + size > BUCKET_BYTES:
                    number, held = number + 1, 0
                held += size
                labels.append(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int64()), *batch.columns[1:]], schema=batch.schema)

    name = f"buckets_{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (
        numbered.mapInArrow(assign, numbered.schema)
        .write.bucketBy(min(parts, 100_000), "bucket").option("path", new_path(spark, "buckets"))
        .option("compression", "zstd").saveAsTable(name)
    )
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # forgets the name; the files stay where they are
    return table


def shard_count(buckets: DataFrame) -> int:
    """Shards for the anchors: the shuffle partitions, and more where these would make shards too large.

    Memory of a shard is thus bounded also when the setting does not fit the size of the input.
    """
    parts = max(1, int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(parts, -(-buckets.select("bucket").distinct().count() // SHARD_BUCKETS))


def recurring_anchors(buckets: DataFrame, sieve: Sieve) -> DataFrame:
    """(bucket, shard, blob): for each bucket its anchors that recur in the corpus, with a hot mark."""

    counted, returned = "shard long, bucket long, blob binary", "bucket long, shard long, blob binary"

    def count(key, table):
        keys, counts = Bucket(table, sieve).anchor_counts()
        shard = (keys >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = []
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            low = (keys[a:b] & _LOW).astype(np.uint32)
            rows.append((int(shard[a]), key[0].as_py(), pack(low, counts[a:b])))
        return table_of(arrow_schema(counted), rows)

    def choose(key, table):
        shard = key[0].as_py()
        parts = [unpack(b, np.uint32, np.uint8) for b in table.column("blob").to_pylist()]
        bucket = np.repeat(table.column("bucket").to_numpy(), [len(p[0]) for p in parts])
        low, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        names, inverse = np.unique(low, return_inverse=True)
        total = np.bincount(inverse, weights=counts)[inverse]
        keep = total > 1
        low, hot, bucket = low[keep], total[keep] > sieve.hot, bucket[keep]
        order = np.lexsort((low, bucket))
        low, hot, bucket = low[order], hot[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = [
            (int(bucket[a]), shard, pack(low[a:b], hot[a:b].astype(np.uint8)))
            for a, b in zip(edges, [*edges[1:], len(low)])
        ]
        return table_of(arrow_schema(returned), rows)

    counts = buckets.select("bucket", "doc_id", "text").groupBy("bucket").applyInArrow(count, counted)
    return materialize(counts.groupBy("shard").applyInArrow(choose, returned), "anchors")


def read_anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (shard and low bits) of a bucket and which of them are hot."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, hot = [], []
    for shard, blob in zip(table.column("shard").to_pylist(), table.column("blob").to_pylist()):
        low, mark = unpack(blob, np.uint32, np.uint8)
        keys.append((np.uint64(shard) << np.uint64(32)) | low.astype(np.uint64))
        hot.append(mark.astype(bool))
    keys, hot = np.concatenate(keys), np.concatenate(hot)
    order = np.argsort(keys)
    return keys[order], hot[order]
