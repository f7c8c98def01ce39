"""Remove repeated byte strings with longest-previous-factor arrays.

A byte is covered by a repeat if it lies in a string of ``length`` bytes that also starts
elsewhere. Strings that may recur are found by the sieve of :mod:`dugout.llm.anchors` and meet
in shards, as short segments of text. A shard sorts the suffixes of its distinct segments, laid
out in corpus order, and measures what neighbours have in common. For a suffix, the nearest suffixes
before and after it in sorted order that start earlier in the text hold its longest previous factor;
its length is the smallest common prefix on the way there. A segment that occurs several times stands in
the text once: its other places have the rest of the segment as a factor, which enters the array as a
length. A byte string is removed exactly where the array says that the factor has ``length`` bytes. The
mirrored array, with later positions, finds the strings that are repeated further on.

``keep="first"`` removes later copies and keeps the first one, in order of (id, position);
``keep="none"`` removes every copy. Matches never cross documents.

Defined results: a null text is empty. Null ids come after all others. With ``keep="first"``, rows that
repeat an id are in no order among each other: the string stays in all of them or in none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm import anchors as A
from dugout.llm.anchors import table_of
from dugout.llm.common import arrow_schema
from dugout.sources.shared import materialize

#: bytes whose suffixes are sorted at a time, and anchor gram
SORT_BYTES, GRAM_BYTES = 1 << 20, 48
_SENT = "shard long, bucket long, heads binary, text binary"
_FOUND = "bucket long, kind int, shard long, blob binary"
#: never part of UTF-8
_SEPARATOR = 0xFF


# --- suffixes -----------------------------------------------------------------------------


def _first_rank(text: np.ndarray, width: int) -> np.ndarray:
    """Big-endian number of the first ``width`` bytes (at most 8) of every suffix."""
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for j in range(width):
        out = (out << np.uint64(8)) | padded[j:j + len(text)]
    return out


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes sorted by ``length`` bytes or more, and (width, ranks) for widths that double up to it.

    Ranks of a width are equal exactly where the first ``width`` bytes are equal; only suffixes that still tie
    are sorted again in a round.
    """
    n = len(text)
    width = 8
    while width > length:
        width //= 2
    key = _first_rank(text, width)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    levels = [(width, rank.astype(np.int32))]
    while width < length:
        ranks = rank[order]
        tied = np.ones(n, bool)
        tied[1:] = ranks[1:] != ranks[:-1]
        lone = tied & np.append(tied[1:], True)
        at = np.flatnonzero(~lone)
        if not len(at):
            break
        suffix = order[at]
        after = suffix + width
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + behind
        sort = np.argsort(key, kind="stable")
        key, suffix = key[sort], suffix[sort]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        rank[suffix] = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
        width *= 2
        if width <= length:
            levels.append((width, rank.astype(np.int32)))
    return order, levels


def common_prefixes(text: np.ndarray, order: np.ndarray, levels: list, length: int, least: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in sorted order, from ``least`` to ``length``, else 0."""
    n = len(text)
    link = np.zeros(n, np.int32)
    enough = [rank for width, rank in levels if width <= least]
    if enough:  # who differs in the first bytes shares less than ``least``
        ranks = enough[-1][order]
        at = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
    else:
        at = np.arange(1, n)
    a, b = order[at - 1], order[at]
    shared = np.zeros(len(at), np.int64)
    for width, rank in reversed(levels):
        ends = np.maximum(a, b) + shared + width
        equal = rank[np.minimum(a + shared, n - 1)] == rank[np.minimum(b + shared, n - 1)]
        shared += width * (equal & (ends <= n))
    # Less than the smallest width is left.
    open_ = np.flatnonzero(shared < length)
    for _ in range(levels[0][0] - 1):
        x, y = a[open_] + shared[open_], b[open_] + shared[open_]
        fits = np.maximum(x, y) < n
        open_, x, y = open_[fits], x[fits], y[fits]
        open_ = open_[text[x] == text[y]]
        shared[open_] += 1
    link[at] = np.where(shared >= least, np.minimum(shared, length), 0)
    return link


def _to_nearest_smaller(values: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest link on the way to the nearest smaller value on the left; 0 if a link of 0 lies before it.

    ``link[i]`` joins i - 1 and i. Pointers jump over values that are not smaller, and minima go with them.
    """
    previous = np.where(link > 0, np.arange(-1, len(values) - 1, dtype=np.int32), -1)
    least = np.where(previous >= 0, link, 0)
    wrong = np.flatnonzero(previous >= 0)
    while len(wrong):
        via = previous[wrong]
        larger = values[via] >= values[wrong]
        wrong, via = wrong[larger], via[larger]
        least[wrong] = np.minimum(least[wrong], least[via])
        previous[wrong] = previous[via]
        wrong = wrong[previous[wrong] >= 0]
    return least


def factor_lengths(text: np.ndarray, length: int, again: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest factors at every position that also start earlier, later, and earlier than the position's other places.

    Lengths are exact from half of ``length`` on and end at ``length``; shorter factors are 0. ``again`` holds for each
    position of a segment that occurs several times the bytes up to the segment's end, else 0: that is what its places
    have in common.
    """
    n = len(text)
    again = np.zeros(n, np.int64) if again is None else np.minimum(again, length)
    earlier, later = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n > 1:
        order, levels = suffix_order(text, length)
        link = common_prefixes(text, order, levels, length, max(1, length // 2))
        # Suffixes without a link on either side have no factor of this length.
        at = np.flatnonzero((link > 0) | (np.append(link[1:], 0) > 0))
        place, link = order[at].astype(np.int32), link[at]
        back = np.append(0, link[:0:-1]) if len(at) else link
        for out, value in ((earlier, place), (later, -place)):
            before = _to_nearest_smaller(value, link)
            behind = _to_nearest_smaller(value[::-1], back)[::-1]
            out[place] = np.maximum(before, behind)
    return earlier, np.maximum(later, again), np.maximum(earlier, again)


# --- the distributed steps ------------------------------------------------------------------


def _sieve(buckets: DataFrame, length: int, hot: int) -> tuple[A.Sieve, int]:
    shards = A.shard_count(buckets)
    gram = max(1, min(GRAM_BYTES, length - length // 2))
    return A.Sieve(length, gram, "bytes", False, shards=shards, hot=hot, hot_run=max(1, length // 20)), 4 * shards


def _first_places(found: A.Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every distinct segment of a bucket the first (id, position) and the number of places."""
    ids = found.bucket.ids[found.doc]
    order = np.lexsort((found.start, ids, found.code))
    _, head = np.unique(found.code[order], return_index=True)
    return ids[order][head], found.start[order][head], np.bincount(found.code, minlength=len(found.digests))


def _send(sieve: A.Sieve, shards: int):
    def run(key, docs, anchors):
        found = A.Bucket(docs, sieve).segments(*A.read_anchors(anchors))
        ids, starts, places = _first_places(found)
        windows = found.count[found.sample]
        coder = zstandard.ZstdCompressor(level=3)
        rows = [
            (shard, key[0].as_py(),
             A.pack(ids[codes], starts[codes], found.route[codes], np.minimum(places[codes], 255).astype(np.int32),
                    windows[codes].astype(np.int32)),
             coder.compress(b"".join([found.text(c) for c in codes.tolist()])))
            for shard, codes in found.by_shard(shards)
        ]
        return table_of(arrow_schema(_SENT), rows)

    return run


def _batches(order: list[int], routes: list[int], sizes: list[int]):
    """Groups of about SORT_BYTES that never divide segments of one anchor."""
    batch, held = [], 0
    for i, s in enumerate(order):
        if held >= SORT_BYTES and routes[s] != routes[order[i - 1]]:
            yield batch
            batch, held = [], 0
        batch.append(s)
        held += sizes[s] + 1
    if batch:
        yield batch


def _mark(sieve: A.Sieve, keep: str):
    length = sieve.length

    def run(key, table):
        opened = zstandard.ZstdDecompressor()
        index: dict[bytes, int] = {}
        texts, first, places, routes = [], [], [], []
        rows = []
        columns = (table.column(c).to_pylist() for c in ("bucket", "heads", "text"))
        for bucket, heads, blob in zip(*columns):
            ids, starts, route, count, windows = A.unpack(heads, np.int64, np.int64, np.uint64, np.int32, np.int32)
            body, at = opened.decompress(blob), 0
            for d, p, r, c, w in zip(ids.tolist(), starts.tolist(), route.tolist(), count.tolist(), windows.tolist()):
                text = body[at:at + w + length - 1]
                at += len(text)
                s = index.get(text)
                if s is None:
                    s = index[text] = len(texts)
                    texts.append(text)
                    first.append((d, p))
                    places.append(c)
                    routes.append(r)
                else:
                    first[s] = min(first[s], (d, p))
                    places[s] += c
                rows.append((bucket, (d, p), s))
        del index
        flags: list = [None] * len(texts)
        others: list = [None] * len(texts)  # of a segment's places after the first
        sizes = [len(t) for t in texts]
        for batch in _batches(sorted(range(len(texts)), key=routes.__getitem__), routes, sizes):
            batch.sort(key=first.__getitem__)  # corpus order: an earlier place in the text is an earlier copy
            joined = b"".join(texts[s] + bytes([_SEPARATOR]) for s in batch)
            again = np.concatenate([
                np.append(np.arange(sizes[s], 0, -1), 0) if places[s] > 1 else np.zeros(sizes[s] + 1, np.int64) for s in batch])
            earlier, later, repeated = factor_lengths(np.frombuffer(joined, np.uint8), length, again)
            at = 0
            for s in batch:
                windows = slice(at, at + sizes[s] - length + 1)
                flags[s] = earlier[windows] >= length
                if keep == "none":
                    flags[s] |= later[windows] >= length
                else:
                    others[s] = repeated[windows] >= length
                at += sizes[s] + 1
        out: dict[int, list] = {}
        for bucket, place, s in rows:
            marks = [flags[s]] if keep == "none" else [flags[s] if place == first[s] else others[s], others[s]]
            if any(m.any() for m in marks):
                out.setdefault(bucket, []).append((xxhash.xxh3_128_digest(texts[s]), marks))
        found = []
        for bucket, rows in out.items():
            width = -(-(length - sieve.gram + 1) // 8)
            bits = np.zeros((len(rows), width * len(rows[0][1])), np.uint8)
            for i, (_, marks) in enumerate(rows):
                for k, mark in enumerate(marks):
                    packed = np.packbits(mark)
                    bits[i, k * width:k * width + len(packed)] = packed
            digests = np.frombuffer(b"".join(d for d, _ in rows), np.uint8).reshape(-1, 16)
            found.append((bucket, 1, key[0].as_py(), A.pack(np.hstack([digests, bits]))))
        return table_of(arrow_schema(_FOUND), found)

    return run


def _removed_bytes(bucket: A.Bucket, found: pa.Table, keep: str) -> list[np.ndarray]:
    """For each document of the bucket which of its bytes go."""
    kind = found.column("kind").to_numpy() if found.num_rows else np.zeros(0)
    anchors, marks = found.filter(pa.array(kind == 0)), found.filter(pa.array(kind == 1))
    length, part = bucket.sieve.length, -(-(bucket.sieve.length - bucket.sieve.gram + 1) // 8)
    width = 16 + part * (1 if keep == "none" else 2)
    bits_of: dict[bytes, bytes] = {}
    for blob in marks.column("blob").to_pylist():
        for row in A.unpack(blob, f"V{width}")[0].tolist():
            bits_of[row[:16]] = row[16:]
    places = bucket.segments(*A.read_anchors(anchors))
    edges = [np.zeros(n + 1, np.int32) for n in bucket.size]
    other = np.zeros(len(places.code), bool)
    if keep == "first":  # the bucket's first place of a segment, or one of the others
        ids, starts, _ = _first_places(places)
        other = (bucket.ids[places.doc] != ids[places.code]) | (places.start != starts[places.code])
    bits = [bits_of.get(d) for d in places.digests]
    rows = zip(places.doc.tolist(), places.start.tolist(), places.count.tolist(), places.code.tolist(), other.tolist())
    for doc, start, count, code, later in rows:
        if bits[code] is None:
            continue
        mine = bits[code][part:] if later else bits[code][:part]
        gone = np.flatnonzero(np.unpackbits(np.frombuffer(mine, np.uint8))[:count])
        if len(gone) < count:
            edges[doc][start + gone] += 1
            edges[doc][start + gone + length] -= 1
            continue
        edges[doc][start] += 1
        edges[doc][start + count + length - 1] -= 1
    return [np.cumsum(e[:-1]) > 0 for e in edges]


def repeated_bytes(
    df: DataFrame,
    *,
    length: int = 200,
    keep: str = "first",
    hot: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (remaining bytes)."""
    if keep not in ("first", "none"):
        raise ValueError("keep must be 'first' or 'none'")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    buckets = A.bucket_table(df, id_col, text_col)
    sieve, shards = _sieve(buckets, length, hot)
    anchors = A.recurring_anchors(buckets, sieve)
    sent = buckets.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(_send(sieve, shards), _SENT)
    marks = sent.groupBy("shard").applyInArrow(_mark(sieve, keep), _FOUND)
    found = materialize(
        marks.unionByName(anchors.select("bucket", F.lit(0).alias("kind"), "shard", "blob")), "factors"
    )

    def run(key, docs, found):
        bucket = A.Bucket(docs, sieve)
        rows = []
        gone_of = _removed_bytes(bucket, found, keep)
        for id_, raw, gone in zip(docs.column("doc_id").to_pylist(), bucket.raw, gone_of):
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            rows.append((id_, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return table_of(arrow_schema(ddl), rows)

    return buckets.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, ddl)
