"""Remove repeated phrases: confirm recurring passages, compile automata, locate every occurrence.

A window of ``length`` words is removed from a document if the same words also start in a document
with a smaller id. Windows that may recur are found by the sieve of :mod:`dugout.llm.anchors` and
meet, as text, in shards. A shard confirms the phrases that occur in more than one document,
compiles them into Aho-Corasick automata of bounded size, whose symbols are words, and streams the
candidate text of all documents through them. Text outside the candidates cannot hold a confirmed
phrase: it has no anchor that occurs in a second document.

Copies inside a bucket are sent once, with the smallest id that holds them, so a phrase that a third
of all documents share reaches its shard once per bucket.

Defined results: a null text has no words. Null ids come after all others and do not remove from each
other; rows that repeat an id do not either. Words are separated as ``[\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dugout.llm import anchors as A
from dugout.llm.anchors import table_of
from dugout.llm.common import arrow_schema
from dugout.sources.shared import materialize

#: phrases in one automaton, and anchor gram; the smaller the gram, the fewer anchors
PHRASES, GRAM_WORDS = 50_000, 7
#: windows of a segment are marked in one byte
MASK_BITS = 8
_SENT = "shard long, bucket long, heads binary, text binary"
_FOUND = "bucket long, kind int, shard long, blob binary"


def _sieve(buckets: DataFrame, length: int, hot: int) -> tuple[A.Sieve, int]:
    shards = A.shard_count(buckets)
    # At most MASK_BITS windows share an anchor.
    gram = max(min(GRAM_WORDS, length - length // 2), length + 1 - MASK_BITS)
    return A.Sieve(length, gram, "words", True, shards=shards, hot=hot), 4 * shards


def _smallest_ids(found: A.Segments) -> tuple[np.ndarray, np.ndarray]:
    """Of every distinct segment of a bucket the smallest id that has it, and whether several have."""
    ids = found.bucket.ids[found.doc]
    low = np.full(len(found.digests), A.NO_ID)
    high = np.full(len(found.digests), np.iinfo(np.int64).min)
    np.minimum.at(low, found.code, ids)
    np.maximum.at(high, found.code, ids)
    return low, low != high


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _repeated_windows(words: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows that occur twice or more among the segments, and a number for each distinct one."""
    n = len(valid)
    hashed = A.mix(words.astype(np.uint64) + np.uint64(1))
    name = np.zeros(n, np.uint64)
    for j in range(length):
        name = name * np.uint64(0x9E3779B97F4A7C15) + hashed[j:j + n]
    at = np.flatnonzero(valid)
    order = np.argsort(name[at], kind="stable")
    at, name = at[order], name[at][order]
    new = np.ones(len(at), bool)
    new[1:] = name[1:] != name[:-1]
    group = np.cumsum(new) - 1
    twice = np.bincount(group)[group] > 1 if len(at) else new
    at, group = at[twice], group[twice]
    if len(at):  # the same hash must mean the same words
        heads = np.append(True, group[1:] != group[:-1])
        head = at[heads][np.cumsum(heads) - 1]
        steps = np.arange(length)
        for k in range(0, len(at), 1 << 16):
            part = slice(k, k + (1 << 16))
            if (words[at[part, None] + steps] != words[head[part, None] + steps]).any():
                _, group = np.unique(words[at[:, None] + steps], axis=0, return_inverse=True)
                return at, group.reshape(-1)
    return at, np.unique(group, return_inverse=True)[1].reshape(-1) if len(at) else group


def confirm_and_locate(
    texts: list[bytes], first: np.ndarray, several: np.ndarray, length: int, per_automaton: int = PHRASES
) -> list[list[int]]:
    """For every window of every segment the smallest id that holds it, NO_ID if no second id does.

    ``texts`` are distinct segments, ``first`` the smallest id that has each, ``several`` whether more
    than one id has it. Two kinds of passage are confirmed: whole segments that several ids have, and
    single windows that occur in different segments. The automata hold both; their symbols are words.
    """
    sizes = np.array([t.count(b" ") + 1 for t in texts])
    words = np.array(list(map(_Numbers().__getitem__, b" ".join(texts).split(b" "))), np.int64)
    offsets = np.cumsum(sizes) - sizes
    segment = np.repeat(np.arange(len(texts)), sizes)
    n = max(0, len(words) - length + 1)
    valid = segment[:n] == segment[length - 1:length - 1 + n]
    at, group = _repeated_windows(words, valid, length)
    listed = words.tolist()
    passages: dict[tuple, int] = {}
    busy = several.copy()
    if len(at):
        held = segment[at]
        low, high = np.full(group.max() + 1, A.NO_ID), np.full(group.max() + 1, -1 << 63)
        shared = np.zeros(group.max() + 1, bool)
        np.minimum.at(low, group, first[held])
        np.maximum.at(high, group, first[held])
        np.logical_or.at(shared, group, several[held])
        confirmed = shared | (low != high)
        busy[held[confirmed[group]]] = True
        _, sample = np.unique(group, return_index=True)
        for g in np.flatnonzero(confirmed).tolist():
            k = int(at[sample[g]])
            passages[tuple(listed[k:k + length])] = int(low[g])
    for s in np.flatnonzero(several).tolist():
        whole = tuple(listed[offsets[s]:offsets[s] + sizes[s]])
        passages[whole] = min(int(first[s]), passages.get(whole, A.NO_ID))
    smallest = [[A.NO_ID] * max(0, size - length + 1) for size in sizes.tolist()]
    streamed = [(s, tuple(listed[offsets[s]:offsets[s] + sizes[s]])) for s in np.flatnonzero(busy).tolist()]
    todo = list(passages.items())
    for k in range(0, len(todo), per_automaton):
        part = todo[k:k + per_automaton]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, (passage, _) in enumerate(part):
            automaton.add_word(passage, i)
        automaton.make_automaton()
        for s, symbols in streamed:
            row = smallest[s]
            for end, i in automaton.iter(symbols):
                passage, doc = part[i]
                for w in range(end - len(passage) + 1, end - length + 2):
                    if doc < row[w]:
                        row[w] = doc
    return smallest


def _send(sieve: A.Sieve, shards: int):
    def run(key, docs, anchors):
        found = A.Bucket(docs, sieve).segments(*A.read_anchors(anchors))
        low, several = _smallest_ids(found)
        coder = zstandard.ZstdCompressor(level=3)
        rows = [
            (shard, key[0].as_py(), A.pack(low[codes], several[codes].astype(np.uint8)),
             coder.compress(b"\n".join([found.text(c) for c in codes.tolist()])))
            for shard, codes in found.by_shard(shards)
        ]
        return table_of(arrow_schema(_SENT), rows)

    return run


def _locate(sieve: A.Sieve):
    def run(key, table):
        opened = zstandard.ZstdDecompressor()
        index: dict[bytes, int] = {}
        buckets, ids, many, codes = [], [], [], []
        for bucket, heads, blob in zip(*(table.column(c).to_pylist() for c in ("bucket", "heads", "text"))):
            low, several = A.unpack(heads, np.int64, np.uint8)
            codes += [index.setdefault(t, len(index)) for t in opened.decompress(blob).split(b"\n")]
            buckets.append(np.full(len(low), bucket))
            ids.append(low)
            many.append(several.astype(bool))
        bucket, id_, code = np.concatenate(buckets), np.concatenate(ids), np.array(codes, np.int64)
        first, last = np.full(len(index), A.NO_ID), np.full(len(index), -1 << 63)
        several = np.zeros(len(index), bool)
        np.minimum.at(first, code, id_)
        np.maximum.at(last, code, id_)
        np.logical_or.at(several, code, np.concatenate(many))
        texts = list(index)
        smallest = confirm_and_locate(texts, first, several | (first != last), sieve.length)
        # A window of a bucket's smallest holder goes if a smaller id elsewhere holds the window.
        mask = np.array([sum((doc < mine) << j for j, doc in enumerate(smallest[c]))
                         for c, mine in zip(codes, id_.tolist())], np.uint8)
        marked = np.flatnonzero(mask)
        marked = marked[np.argsort(bucket[marked], kind="stable")]
        found = []
        for part in np.split(marked, np.flatnonzero(np.diff(bucket[marked])) + 1):
            if len(part):
                digests = b"".join([xxhash.xxh3_128_digest(texts[c]) for c in code[part].tolist()])
                found.append((int(bucket[part[0]]), 1, key[0].as_py(),
                              A.pack(np.frombuffer(digests, np.uint8).reshape(-1, 16), mask[part])))
        return table_of(arrow_schema(_FOUND), found)

    return run


def _removed_words(bucket: A.Bucket, found: pa.Table) -> list[np.ndarray]:
    """For each document of the bucket which of its words go."""
    kind = found.column("kind").to_numpy() if found.num_rows else np.zeros(0)
    anchors, marks = found.filter(pa.array(kind == 0)), found.filter(pa.array(kind == 1))
    mask_of: dict[bytes, int] = {}
    for blob in marks.column("blob").to_pylist():
        digests, masks = A.unpack(blob, "V16", np.uint8)
        mask_of.update(zip(digests.tolist(), masks.tolist()))
    places = bucket.segments(*A.read_anchors(anchors))
    low, _ = _smallest_ids(places)
    length, sizes = bucket.sieve.length, np.array(bucket.size)
    offset = np.cumsum(sizes + 1) - (sizes + 1)
    change = np.zeros(int((sizes + 1).sum()), np.int32)
    at = offset[places.doc] + places.start
    # Holders with a larger id than the smallest of the bucket lose the whole segment.
    later = bucket.ids[places.doc] > low[places.code]
    np.add.at(change, at[later], 1)
    np.add.at(change, (at + places.count + length - 1)[later], -1)
    mask = np.array([mask_of.get(d, 0) for d in places.digests], np.uint8)[places.code]
    mask[later] = 0
    for j in range(MASK_BITS):
        hit = at[(mask >> j & 1).astype(bool)] + j
        np.add.at(change, hit, 1)
        np.add.at(change, hit + length, -1)
    gone = np.cumsum(change) > 0
    return [gone[a:a + n] for a, n in zip(offset.tolist(), sizes.tolist())]


def kept_words(flat: bytes, edge: np.ndarray, gone: np.ndarray) -> bytes:
    """The words that stay, joined by single spaces."""
    if not gone.any():
        return flat
    change = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    spans = zip(edge[change[0::2]].tolist(), edge[change[1::2]].tolist())
    return b" ".join([flat[a:b - 1] for a, b in spans])


def kept_text(raw: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """``raw`` without the removed words and the white space after each of them."""
    starts, at = [], 0
    for word in words:
        at = raw.index(word, at)
        starts.append(at)
        at += len(word)
    starts.append(len(raw))
    kept = (raw[starts[i]:starts[i + 1]] for i in np.flatnonzero(~gone).tolist())
    return raw[:starts[0]] + b"".join(kept)


def _find(df: DataFrame, id_col: str, text_col: str, length: int, hot: int, carry: bool):
    buckets = A.bucket_table(df, id_col, text_col, carry)
    sieve, shards = _sieve(buckets, length, hot)
    anchors = A.recurring_anchors(buckets, sieve)
    sent = buckets.select("bucket", "doc_id", "text").groupBy("bucket").cogroup(
        anchors.groupBy("bucket")).applyInArrow(_send(sieve, shards), _SENT)
    marks = sent.groupBy("shard").applyInArrow(_locate(sieve), _FOUND)
    found = materialize(
        marks.unionByName(anchors.select("bucket", F.lit(0).alias("kind"), "shard", "blob")), "phrases"
    )
    return sieve, buckets, found


def phrase_digests(
    df: DataFrame, *, length: int = 13, hot: int = 2000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    sieve, buckets, found = _find(df, id_col, text_col, length, hot, carry=False)

    def run(key, docs, found):
        bucket = A.Bucket(docs, sieve)
        rows = []
        ids = docs.column("doc_id").to_pylist()
        for id_, flat, edge, gone in zip(ids, bucket.flat, bucket.edge, _removed_words(bucket, found)):
            kept = hashlib.sha256(kept_words(flat, edge, gone)).hexdigest()
            rows.append((id_, len(gone), int(gone.sum()), kept))
        return table_of(arrow_schema(ddl), rows)

    return buckets.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, ddl)


def without_repeated_phrases(
    df: DataFrame,
    *,
    length: int = 13,
    hot: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str | None = None,
) -> DataFrame:
    """``df`` with the removed words cut out of ``text_col``; other columns and white space stay.

    ``chars_col`` names a column that is set to the number of characters left. Rows stay even if
    nothing is left of their text; a null text stays null.
    """
    sieve, buckets, found = _find(df, id_col, text_col, length, hot, carry=True)
    schema = buckets.select("row.*").schema

    def run(key, docs, found):
        bucket = A.Bucket(docs, sieve)
        rows = docs.column("row").to_pylist()
        for row, raw, gone in zip(rows, bucket.raw, _removed_words(bucket, found)):
            if row[text_col] is not None and gone.any():
                row[text_col] = kept_text(raw, raw.split(), gone).decode()
                if chars_col:
                    row[chars_col] = len(row[text_col])
        return pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))

    return buckets.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, schema)
