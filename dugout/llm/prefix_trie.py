"""Prefix tries over conversations: ternary search trees per range of sequences, merged at the edges.

Turns are dictionary-encoded, so that a conversation is a short array of numbers. Equal sequences are
grouped first and one row stands for them, however many conversations hold it. The
distinct sequences are sorted by range into shards. A task reads a shard in order, in chunks of bounded
size, and builds a ternary search tree of each by median insertion. One iterative traversal gives
members, children, leaves and savings of every node. The only nodes that a chunk shares with others are the
prefixes common to its first sequence and the one before it, or its last and the one after it. With those
two neighbours known, every chunk counts exactly its own share of such a node, and the shares are added.

Defined results: turns are ordered by number, a null number first, equal numbers by the SHA-256 of
role and text. A null role or text is empty. Rows that repeat a turn are turns of their own. Rows
without a conversation id belong to no conversation and are left out. Texts are digested whole and do not
travel. Other columns are not looked at. An empty table has no members and gives no nodes.
A conversation is one row of eight bytes and some per turn; memory grows with the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import arrow_schema, quoted
from dugout.sources.shared import materialize

#: turns that a chunk's tree holds, and conversations whose ids meet in one aggregate (as a power of two)
CHUNK_TURNS, ID_BITS = 100_000, 12
#: turns in a shard, so that the number of shards follows the input
SHARD_TURNS = 1_000_000

_NODE = (
    "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# --- sequences ------------------------------------------------------------------------------


def encoded_conversations(
    df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, seq: the turns of each conversation in order, as (id, chars) of the dictionary's entries.

    The text is read once. What travels is a digest of 32 bytes a turn.
    """
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # The role's length keeps role and text apart.
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = materialize(df.where(quoted(conv_col).isNotNull()).select(
        quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).cast("long").alias("turn"),
        digest.alias("digest"), F.length(text).cast("long").alias("chars"),
    ), "turns")
    dictionary = materialize(turns.select("digest", "chars").distinct().select(
        "digest", "chars", F.monotonically_increasing_id().alias("id")), "turn_dictionary")
    coded = turns.select("conv_id", "turn", "digest").join(dictionary, "digest")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "chars")))
    return coded.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("seq"))


def with_shared_heads(conversations: DataFrame, *, block: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of the first of its block, h = crc32(c) % ``heads``.

    Its own turns after the first h follow. The block's first conversation is c - c % ``block``; if it has
    fewer turns all of them count, if it does not exist none.
    """
    conversations = materialize(conversations, "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = conversations.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, heads - 1).alias("head"))
    keyed = conversations.select(
        "conv_id", "seq", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    tail = F.slice("seq", F.col("h") + 1, F.size("seq"))
    shared = F.when(F.col("head").isNull(), F.slice("seq", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return keyed.join(first, "base", "left").select("conv_id", F.concat(shared, tail).alias("seq"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """seq, n_convs, conv_id (the smallest), ends_sha256: one row per different sequence of turns.

    Ids meet in slices of ``2^ID_BITS`` neighbouring ids, so no aggregate holds more of them, and
    the slices of a sequence are hashed one after the other.
    """
    key = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda t: t["id"].cast("string")), ","), 256))
    slices = conversations.groupBy(
        key.alias("key"), F.shiftright("conv_id", ID_BITS).alias("slice")
    ).agg(
        F.first("seq").alias("seq"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )

    def run(batches):
        key, seq, n, conv_id, sha = None, None, 0, 0, None

        def done(seqs, rows):
            columns = [pa.array(c) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays(
                [seqs, columns[0].cast(pa.int64()), columns[1].cast(pa.int64()), columns[2]],
                names=["seq", "n_convs", "conv_id", "ends_sha256"])

        for batch in batches:
            seqs, starts, ended = batch.column("seq"), [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "n_convs", "conv_id", "ids")]
            for i, (this, count, least, ids) in enumerate(zip(*columns)):
                if this != key:
                    if sha:
                        ended.append((n, conv_id, sha.hexdigest()))
                    starts.append(i)
                    key, n, conv_id, sha = this, 0, least, hashlib.sha256()
                else:
                    sha.update(b",")
                n += count
                sha.update(ids.encode())
            if starts:
                fresh = seqs.take(pa.array(starts[:-1], pa.int64()))
                if ended:
                    yield done(fresh if seq is None else pa.concat_arrays([seq, fresh]), ended)
                seq = seqs.take(pa.array(starts[-1:], pa.int64()))
        if sha:
            yield done(seq, [(n, conv_id, sha.hexdigest())])

    ordered = slices.repartition("key").sortWithinPartitions("key", "slice").select("key", "seq", "n_convs", "conv_id", "ids")
    return ordered.mapInArrow(run, "seq array<struct<id:long,chars:long>>, n_convs long, conv_id long, ends_sha256 string")


# --- trees ----------------------------------------------------------------------------------


def medians(n: int) -> Iterator[int]:
    """0..n-1 with the middle first, then the middles of both halves and so on."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(m + 1, b), (a, m)]


class TernaryTree:
    """Ternary search tree over sequences of turn ids; node 0 is the root, the empty sequence.

    ``lo`` and ``hi`` lead to smaller and larger ids at the same depth, ``eq`` to the next turn.
    """

    def __init__(self):
        self.ids, self.chars, self.depth = [None], [0], [0]
        self.lo, self.eq, self.hi = [0], [0], [0]
        self.row = [-1]  # of the sequence that ends here

    def _add(self, turn: int, chars: int, depth: int) -> int:
        for column, value in ((self.ids, turn), (self.chars, chars), (self.depth, depth), (self.lo, 0), (self.eq, 0),
                              (self.hi, 0), (self.row, -1)):
            column.append(value)
        return len(self.ids) - 1

    def insert(self, seq: list[tuple[int, int]], row: int) -> None:
        node = 0
        for depth, (turn, chars) in enumerate(seq, 1):
            child = self.eq[node]
            if not child:
                child = self.eq[node] = self._add(turn, chars, depth)
            while (here := self.ids[child]) != turn:
                side = self.lo if turn < here else self.hi
                if not side[child]:
                    side[child] = self._add(turn, chars, depth)
                child = side[child]
            node = child
        self.row[node] = row

    def preorder(self) -> Iterator[tuple[int, int]]:
        """(node, parent in the trie), every parent before its children."""
        yield 0, -1
        todo = [(self.eq[0], 0)] if self.eq[0] else []
        while todo:
            node, parent = todo.pop()
            yield node, parent
            todo += [(x, parent) for x in (self.lo[node], self.hi[node]) if x]
            if self.eq[node]:
                todo.append((self.eq[node], node))


def common_prefix(a, b) -> int:
    """Turns that two sequences share from the start; -1 if one of them does not exist."""
    if a is None or b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x[0] != y[0]:
            break
        n += 1
    return n


def _path_ids(seq, depth: int) -> list[bytes]:
    """A name for each prefix of a sequence, from the root to ``depth``."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for turn, _ in seq[:depth]:
        state.update(turn.to_bytes(8, "little", signed=True))
        out.append(state.digest())
    return out


def chunk_nodes(seqs: list, counts: list[int], heads: list[int], ends: list[str], before, after) -> dict[str, list]:
    """This chunk's share of every node that its sequences reach, as columns of ``_NODE``.

    ``seqs`` are distinct and sorted; ``before`` and ``after`` are the neighbouring sequences or None. A
    node that a neighbour reaches too has a name (``node``) and its numbers are shares to be added; the
    chunk that meets it first in the sort order counts it as a child and takes the one copy off its savings.
    """
    tree = TernaryTree()
    for i in medians(len(seqs)):
        tree.insert(seqs[i], i)
    n = len(tree.ids)
    order, parent = [], [0] * n
    for node, above in tree.preorder():
        order.append(node)
        parent[node] = above
    old, shared_after = common_prefix(before, seqs[0]), common_prefix(seqs[-1], after)
    names: dict[int, bytes] = {}  # nodes that other chunks reach
    known: set[int] = set()  # of these, the ones counted by an earlier chunk
    for seq, depth in ((seqs[0], old), (seqs[-1], shared_after)):
        node = 0
        for d, name in enumerate(_path_ids(seq, depth) if depth >= 0 else []):
            if d:
                node = _child(tree, node, seq[d - 1][0])
            names[node] = name
            if seq is seqs[0] and d <= old:
                known.add(node)
    convs, least, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    goes_on = after is not None and shared_after == len(seqs[-1])  # the last sequence has its children elsewhere
    for node in reversed(order):
        row = tree.row[node]
        if row >= 0:
            convs[node] += counts[row]
            least[node] = heads[row] if least[node] is None else min(least[node], heads[row])
            leaves[node] += not tree.eq[node] and not (goes_on and row == len(seqs) - 1)
        saved[node] += (convs[node] - (node not in known)) * tree.chars[node]
        up = parent[node]
        if up >= 0:
            convs[up] += convs[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            children[up] += node not in known
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    above = [parent[v] for v in order]
    return {
        "node": [names.get(v) for v in order],
        "parent": [names.get(p) for p in above],
        "conv_id": [least[v] for v in order],
        "depth": [tree.depth[v] for v in order],
        "parent_conv_id": [None if p < 0 or p in names else least[p] for p in above],
        "n_convs": [convs[v] for v in order],
        "n_children": [children[v] for v in order],
        "n_leaves": [leaves[v] for v in order],
        "saved_tokens": [saved[v] for v in order],
        "ends_sha256": [ends[tree.row[v]] if tree.row[v] >= 0 else None for v in order],
    }


def _child(tree: TernaryTree, node: int, turn: int) -> int:
    child = tree.eq[node]
    while tree.ids[child] != turn:
        child = tree.lo[child] if turn < tree.ids[child] else tree.hi[child]
    return child


# --- shards ---------------------------------------------------------------------------------


def _with_neighbours(sequences: DataFrame, shards: int) -> DataFrame:
    """shard, kind, seq, ...: each shard's sequences (kind 1), the one before (0) and the one after (2)."""
    ranged = materialize(
        sequences.repartitionByRange(shards, "seq").withColumn("shard", F.spark_partition_id()), "sequence_shards")
    edges = materialize(ranged.groupBy("shard").agg(F.min("seq").alias("low"), F.max("seq").alias("high")), "shard_edges")
    # Shards may be empty; one number per shard is all that this window sees.
    previous = edges.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("previous")).where(
        "previous IS NOT NULL")
    ends = edges.select(F.col("shard").alias("s"), "low", "high")
    lows = previous.join(ends, F.col("previous") == F.col("s")).select(
        "shard", F.lit(0).alias("kind"), F.col("high").alias("seq"))
    highs = previous.join(ends, F.col("shard") == F.col("s")).select(
        F.col("previous").alias("shard"), F.lit(2).alias("kind"), F.col("low").alias("seq"))
    own = ranged.select("shard", F.lit(1).alias("kind"), "seq", "n_convs", "conv_id", "ends_sha256")
    return own.unionByName(lows.unionByName(highs), allowMissingColumns=True)


def _build(batches):
    """Trees of the shards that a task reads, in chunks of bounded size."""
    schema = arrow_schema(_NODE.replace(", ", ","))
    before, chunk, held, shard = None, [], 0, None

    def flush(after):
        columns = chunk_nodes(*(list(c) for c in zip(*chunk)), before, after)
        return pa.RecordBatch.from_pydict(columns, schema=schema)

    for batch in batches:
        of, kinds, counts, heads, ends = (
            batch.column(c).to_pylist() for c in ("shard", "kind", "n_convs", "conv_id", "ends_sha256"))
        seqs = batch.column("seq")
        starts = seqs.offsets.to_pylist()
        ids, chars = (seqs.values.field(k).to_numpy() for k in (0, 1))
        for i, kind in enumerate(kinds):
            part = slice(starts[i], starts[i + 1])
            seq = list(zip(ids[part].tolist(), chars[part].tolist()))
            if of[i] != shard:
                if chunk:
                    yield flush(None)
                shard, before, chunk, held = of[i], None, [], 0
            if kind == 0:
                before = seq
            elif kind == 2:
                yield flush(seq)
                before, chunk, held = None, [], 0
            else:
                if held + len(seq) > CHUNK_TURNS and chunk:
                    yield flush(seq)
                    before, chunk, held = chunk[-1][0], [], 0
                chunk.append((seq, counts[i], heads[i], ends[i]))
                held += len(seq) + 1
    if chunk:
        yield flush(None)


def prefix_trie(conversations: DataFrame, *, shards: int | None = None) -> DataFrame:
    """One row per node of the trie over ``conversations`` (conv_id, seq of (id, chars)).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = conversations.sparkSession
    sequences = materialize(distinct_sequences(conversations), "sequences")
    turns = sequences.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // SHARD_TURNS + 1)
    rows = _with_neighbours(sequences, shards)
    shares = materialize(
        rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "seq").mapInArrow(_build, _NODE),
        "trie_shares")
    return _merge(shares)


def _merge(shares: DataFrame) -> DataFrame:
    """Add the shares of nodes that several chunks reach, and name the parents of the others."""
    total = lambda c: F.sum(c).alias(c)
    merged = materialize(shares.where("node IS NOT NULL").groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"),
        F.max("ends_sha256").alias("ends_sha256"),
    ), "shared_nodes")
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    known = shares.where("node IS NULL AND parent IS NULL")
    below = shares.where("node IS NULL AND parent IS NOT NULL").drop("node", "parent_conv_id").unionByName(
        merged.drop("node")).join(names, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    columns: list[Column] = [F.col(c) for c in (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    columns.append(F.coalesce("ends_sha256", F.lit(_NO_MEMBERS)).alias("ends_sha256"))
    return known.select(*columns).unionByName(below.select(*columns))
