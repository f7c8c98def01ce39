"""Near duplicates by SimHash, with pivot distance tables.

Fingerprints are computed where the texts are read. Equal fingerprints are collapsed before
anything else, so a group of exact copies is one row from there on. Candidate pairs come from
a pigeonhole split: two fingerprints that differ in at most ``max_distance`` of their ``blocks``
parts agree in the others, so they meet under at least one choice of agreeing parts. The distances
of every distinct fingerprint to fixed pivots are tabled once, before, and stored; a row of the table
travels with its fingerprint as two numbers. By the triangle inequality two fingerprints whose distances to some pivot differ by more than the limit cannot be linked:
the first pivot orders the rows, so that only a short run of neighbours is looked at, the largest
difference over all pivots discards most of these, and the survivors are compared bit by bit.
A task returns a spanning forest of its links and never all pairs of a group.

Defined results: a null text has no words and the fingerprint zero. Rows with a null id take part
in links, but never name a component unless all ids in it are null.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import arrow_schema, id_and_text, map_slices, quoted
from dugout.llm.components import connected_components
from dugout.sources.shared import materialize

BITS, PIVOTS, PIVOT_SEED = 64, 16, 20240229
_NEAR = tuple(f"near{i}" for i in range(PIVOTS // 8))
#: rows that a task compares, and the size from which rows under one key are split further
TASK_ROWS, HOT_ROWS = 400_000, 20_000


def fingerprint_batch(texts: list[str | None], shingle_words: int, seed: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    ends: list[int] = []

    def flush() -> None:
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        starts = np.array([0, *ends[:-1]])
        sizes = np.diff([0, *ends])
        filled = np.flatnonzero(sizes)
        ones = np.add.reduceat(bits, starts[filled], axis=0, dtype=np.int64)
        high = 2 * ones > sizes[filled][:, None]
        rows[filled] = np.packbits(high, axis=1, bitorder="little").view("<u8").reshape(-1)

    done = 0
    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []  # bytes: only A-Z are lowered
        n = len(words)
        if n:
            joined = b" ".join(words)
            if n <= shingle_words:
                hashes.append(digest(joined, seed))
            else:
                to = np.cumsum([len(w) + 1 for w in words]) - 1
                since = np.concatenate([[0], to[:-1] + 1])
                pairs = zip(since[:n - shingle_words + 1].tolist(), to[shingle_words - 1:].tolist())
                hashes += [digest(joined[a:b], seed) for a, b in pairs]
        ends.append(len(hashes))
        if len(hashes) > 100_000 or i == len(texts) - 1:
            rows = out[done:i + 1]
            flush()
            done = i + 1
            hashes, ends = [], []
    return out


def fingerprints(
    df: DataFrame, *, shingle_words: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long. A bit is set if it is set in over half the shingles."""

    def factory():
        def work(batch):
            found = fingerprint_batch(batch.column("text").to_pylist(), shingle_words, seed)
            return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}
        return work

    return map_slices(id_and_text(df, id_col, text_col), factory, "doc_id long, fp long", limit=1 << 20)


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` parts that cover all bits."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def agreeing_keys(fp, blocks: int, agree: int):
    """Column of (choice, value of the chosen parts): one entry for each choice of ``agree`` parts."""
    parts = _blocks(blocks)
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << parts[p][1]) - 1) << parts[p][0] for p in chosen)
        keys.append(F.struct(F.lit(c).alias("choice"), fp.bitwiseAND(F.lit(_signed(mask))).alias("value")))
    return F.array(*keys)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def split_scheme(n: int, max_distance: int) -> tuple[int, int]:
    """Parts and agreeing parts, such that unrelated fingerprints seldom meet. Never changes the result."""
    blocks = max_distance + 1
    while blocks < BITS // 4:
        agree = blocks - max_distance
        if n >> (BITS * agree // blocks) <= 64:
            break
        blocks += 1
    return blocks, blocks - max_distance


def _rest_masks(blocks: int, agree: int, max_distance: int) -> list[list[int]]:
    """For each choice of agreeing parts: masks that divide the other bits into max_distance + 1 sets."""
    out = []
    for chosen in combinations(range(blocks), agree):
        rest = [b for p, (a, w) in enumerate(_blocks(blocks)) if p not in chosen for b in range(a, a + w)]
        n = max_distance + 1
        out.append([sum(1 << b for b in rest[len(rest) * i // n:len(rest) * (i + 1) // n]) for i in range(n)])
    return out


def pivot_table(distinct: DataFrame) -> DataFrame:
    """fp and its distances to the pivots, a byte each, eight to a column ``near0``, ``near1``."""
    pivots = np.random.default_rng(PIVOT_SEED).integers(0, 2**64, PIVOTS, np.uint64).tolist()
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in pivots]
    packed = [
        reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(d, 8 * i) for i, d in enumerate(far[at:at + 8])])
        for at in range(0, PIVOTS, 8)]
    return distinct.select("fp", *[c.alias(name) for c, name in zip(packed, _NEAR)])


def unpacked(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of distances out of the packed columns."""
    return np.column_stack(columns).astype("<i8").view(np.int8)


def linked_forest(
    key: np.ndarray, fp: np.ndarray, table: np.ndarray, limit: int, tally: Counter | None = None
) -> np.ndarray:
    """Pairs (fingerprint, root) that span all links between rows of equal key.

    ``tally`` counts pairs: of equal key, left by the first pivot, in one tree already, discarded by the other pivots,
    discarded by their bits, linked.
    """
    order = np.lexsort((fp, table[:, 0], key))
    key, fp, table = key[order], fp[order], table[order]
    tally = Counter() if tally is None else tally
    sizes = np.unique(key, return_counts=True)[1]
    tally["equal key"] += int((sizes * (sizes - 1) // 2).sum())
    root = np.arange(len(fp))
    at, step = np.arange(len(fp) - 1), 1
    while len(at):
        other = at + step
        near = (key[at] == key[other]) & (table[other, 0] - table[at, 0] <= limit)
        at = at[near]  # sorted by the first pivot: a row that is too far stays too far
        i, j = at, at + step
        tally["first pivot"] += len(i)
        keep = root[i] != root[j]
        tally["one tree"] += len(i) - int(keep.sum())
        i, j = i[keep], j[keep]
        keep = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= limit
        tally["by pivots"] += len(i) - int(keep.sum())
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= limit
        tally["by bits"] += len(i) - int(keep.sum())
        tally["linked"] += int(keep.sum())
        for a, b in zip(i[keep].tolist(), j[keep].tolist()):
            a, b = _find(root, a), _find(root, b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if keep.any():
            root = _flat(root)
        step += 1
        at = at[at + step < len(fp)]
    child = np.flatnonzero(root != np.arange(len(root)))
    pairs = np.column_stack([fp[child], fp[root[child]]])
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return int(i)


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def links(distinct: DataFrame, max_distance: int, *, task_rows: int = TASK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): enough links between distinct fingerprints ``fp`` to connect all that are linked."""
    blocks, agree = split_scheme(distinct.count(), max_distance)
    tabled = materialize(pivot_table(distinct), "simhash-pivots")
    keyed = materialize(
        tabled.select("fp", *_NEAR, F.explode(agreeing_keys(F.col("fp"), blocks, agree)).alias("key")), "simhash-keys"
    )
    # A key with many rows is split again. The bits outside the agreeing parts hold all differences;
    # cut into one more set than there may be differences, two linked fingerprints agree in one of them.
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_rows).select("key")
    rest = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks])
                     for masks in _rest_masks(blocks, agree, max_distance)])
    finer = F.transform(rest[F.col("key.choice")], lambda m: F.col("fp").bitwiseAND(m))
    split = keyed.join(hot, "key", "left_semi").select("fp", *_NEAR, "key", F.posexplode(finer))
    rows = keyed.join(hot, "key", "left_anti").select("fp", *_NEAR, F.xxhash64("key").alias("key")).unionByName(
        split.select("fp", *_NEAR, F.xxhash64("key", "pos", "col").alias("key")))
    tasks = max(1, -(-keyed.count() // task_rows))

    def run(batches):
        schema = arrow_schema("a long, b long")
        parts = [[b.column(c).to_numpy() for c in ("key", "fp", *_NEAR)] for b in batches]
        if not parts:
            return
        key, fp, *near = [np.concatenate(columns) for columns in zip(*parts)]
        found = linked_forest(key, fp.view(np.uint64), unpacked(near), max_distance).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    return rows.repartition(tasks, "key").mapInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame,
    *,
    shingle_words: int,
    max_distance: int,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    docs = materialize(
        fingerprints(df, shingle_words=shingle_words, seed=seed, id_col=id_col, text_col=text_col), "fingerprints"
    )
    distinct = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = materialize(links(distinct.select("fp"), max_distance), "links")
    labels = connected_components(found)  # node, component; linked fingerprints only
    member = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(member.join(smallest, "component").select("fp", "component_id"), "named")
    return docs.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _free(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def one_per_component(
    df: DataFrame, *, shingle_words: int, max_distance: int, seed: int = 42, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``df`` that name their component by id and fingerprint; all columns as they were.

    Rows with a null id stay: nothing tells them apart, so none is singled out. Different texts under one
    id are judged each by itself; of those under the smallest id of one component the smallest fingerprint
    stays. Rows equal in id and fingerprint stay or go together.
    """
    id_name, fp_name, mark_name = (_free(df, name) for name in ("__id", "__fp", "__mark"))
    found = materialize(near_duplicates(df, shingle_words=shingle_words, max_distance=max_distance, seed=seed,
                                        id_col=id_col, text_col=text_col), "near-duplicates")
    heads = found.where("doc_id = component_id").groupBy(F.col("component_id").alias("__head")).agg(
        F.min("fingerprint").alias("__first"))
    judged = found.where("doc_id IS NOT NULL").join(heads, F.col("component_id") == F.col("__head"), "left").select(
        F.col("doc_id").alias(id_name), F.col("fingerprint").alias(fp_name),
        F.coalesce((F.col(id_name) == F.col("component_id")) & (F.col(fp_name) == F.col("__first")), F.lit(False))
        .alias("__stays"))
    ids = judged.groupBy(id_name).agg(F.bool_and("__stays").alias("__all"), F.bool_or("__stays").alias("__any"))
    ids = materialize(ids.where("NOT __all"), "judged-ids")
    key = quoted(id_col).cast("long") == F.col(id_name)
    clear = df.join(ids.select(id_name), key, "left_anti")
    # Only ids with rows of both kinds need the fingerprint again to tell their rows apart.
    several = materialize(ids.where("__any").select(id_name), "mixed-ids")
    mixed = df.join(several, key, "left_semi")
    kept = judged.where("__stays").select(id_name, fp_name).distinct()
    marked = T.StructType([*df.schema.fields, T.StructField(mark_name, T.LongType())])

    def mark(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            prints = pa.array(fingerprint_batch(texts, shingle_words, seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, mark_name])

    prints = F.lower(F.lpad(F.hex(mark_name), 16, "0"))
    stay = mixed.mapInArrow(mark, marked).join(kept, key & (prints == F.col(fp_name)), "left_semi")
    return clear.unionByName(stay.drop(mark_name))
