"""The prefix trie against plain prefix sets, with shards and chunks of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from dugout.llm import prefix_trie as P

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (
    ("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()),
    ("seq", T.StringType()), ("id", T.StringType()), ("node", T.StringType()), ("depth", T.StringType()))])
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows, block=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % block if c >= 0 else -(-c % block))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(sequences):
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(found) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(sequences[c]) == len(p))))
        out.append((min(found), len(p), min(members[p[:-1]]) if p else None, len(found), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["", "hi", "hello there", "été 🎉", "A", "a", "same"]
    out = []
    for c in [*range(0, 130), *range(200, 230), *range(-205, -190), 10**12, 5_000, 9_000, 9_100]:
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts[:2 + t])))
    same = [("user", "a common start"), ("assistant", "an answer"), ("user", "thanks")]
    out += [(c, t, *x) for c in range(20_000, 20_400) for t, x in enumerate(same)]
    out += [(300, t, "user", f"turn {t}") for t in range(700)] + [(301, t, "user", f"turn {t}") for t in range(650)]
    out += [(400, None, "x", "y"), (400, 3, None, None), (400, 3, "a", "b"), (400, 3, "a", "b"), (400, None, None, "q"),
            (None, 1, "user", "lost"), (401, 1, "ab", "c"), (402, 1, "a", "bc"), (403, 2, "user", "t" * 50_000)]
    return out


@pytest.mark.parametrize("shards,chunk,bits", [(1, 100_000, 12), (7, 100_000, 3), (3, 1, 0), (40, 60, 12)])
def test_nodes_equal_plain_prefix_sets(spark, rows, monkeypatch, shards, chunk, bits):
    monkeypatch.setattr(P, "CHUNK_TURNS", chunk)
    monkeypatch.setattr(P, "ID_BITS", bits)
    df = spark.createDataFrame([(*r, "s", "i", None, "d") for r in rows], SCHEMA).repartition(4)
    if chunk < 100_000:  # the setting travels with the function, not with the module
        monkeypatch.setattr(P, "_build", _with_chunks(chunk))
    got = P.prefix_trie(P.with_shared_heads(P.encoded_conversations(df)), shards=shards)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rebuilt(rows))


def _with_chunks(size):
    def build(batches):
        from dugout.llm import prefix_trie

        prefix_trie.CHUNK_TURNS = size
        return BUILD(batches)

    return build


BUILD = P._build


def test_conversations_without_turns_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 60)]  # no conversation 0: the first h turns are gone
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = P.prefix_trie(P.with_shared_heads(P.encoded_conversations(df)))
    found = {r["depth"]: r for r in got.collect()}
    keep = [c for c, *_ in rows if zlib.crc32(str(c).encode()) % 6 == 0]
    assert found[0]["n_convs"] == 59 and found[1]["n_convs"] == len(keep) and len(found) == 2
    gone = ",".join(str(c) for c, *_ in rows if c not in keep)
    assert found[0]["ends_sha256"] == hashlib.sha256(gone.encode()).hexdigest()


def test_an_empty_table_gives_no_nodes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(P.with_shared_heads(P.encoded_conversations(empty))).count() == 0


def test_medians_balance_the_tree():
    for n in (0, 1, 2, 7, 1000):
        assert sorted(P.medians(n)) == list(range(n))
    tree = P.TernaryTree()
    for i in P.medians(1023):
        tree.insert([(i, 1)], i)
    depth, todo = 0, [(tree.eq[0], 1)]
    while todo:
        node, d = todo.pop()
        depth = max(depth, d)
        todo += [(x, d + 1) for x in (tree.lo[node], tree.hi[node]) if x]
    assert depth == 10


def test_shares_of_chunks_add_up():
    rng = random.Random(8)
    seqs = sorted({tuple((rng.randrange(3), 5) for _ in range(rng.randrange(7))) for _ in range(200)})
    whole = P.chunk_nodes(seqs, [1] * len(seqs), list(range(len(seqs))), ["e"] * len(seqs), None, None)
    for size in (1, 2, 5, 50):
        parts = [seqs[k:k + size] for k in range(0, len(seqs), size)]
        total = defaultdict(int)
        for k, part in enumerate(parts):
            before, after = parts[k - 1][-1] if k else None, parts[k + 1][0] if k + 1 < len(parts) else None
            got = P.chunk_nodes(part, [1] * len(part), list(range(len(part))), ["e"] * len(part), before, after)
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                total[c] += sum(v for v, d in zip(got[c], got["depth"]) if d < 2)
        for c, v in total.items():
            assert v == sum(x for x, d in zip(whole[c], whole["depth"]) if d < 2)
