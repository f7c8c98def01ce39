"""The filter audit against plain filters applied in every order."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import types as T

from dugout.llm import filter_audit as A
from tests.llm import brute

DOCS = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("mask", T.StringType()),
    ("part", T.StringType()), ("good", T.StringType()), ("digest", T.StringType()))])
LABELS = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("quality", T.IntegerType()), ("toxic", T.IntegerType()), ("mask", T.StringType()))])


def plain(docs, labels):
    texts = {}
    for i, text, _ in docs:
        if i is not None:
            texts[text or ""] = min(i, texts.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = brute.words_of(text)
        rows.append((lang or "", i, {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > texts[text]}))
    out = []
    for part in {r[0] for r in rows}:
        mine, found, shapley = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                shapley[f] += len(gone)
                found.append((
                    part, "".join(order), step, len(left), len(gone), sum(r[2][f] for r in mine) - len(gone),
                    sum(r[2][f] and sum(r[2].values()) == 1 for r in mine), sum(r[1] in good for r in gone),
                    sum(r[1] in toxic for r in gone)))
        out += [(*row, shapley[row[1][row[2] - 1]]) for row in found]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(300)] + ["Big", "CAPS", "été"]
    out = []
    for i in range(260):
        text = " ".join(rng.choice(pool[:rng.choice([40, 303])]) for _ in range(rng.choice([20, 99, 100, 140])))
        text += rng.choice(["", "", "#", "\x0b\x0c|"])
        if rng.random() < 0.2:
            text = text.upper()
        out.append((i, text, rng.choice(["en", "de", "fr", None, ""])))
    out += [(300 + k, out[k % 5][1], rng.choice(["en", "de"])) for k in range(80)]  # groups of copies
    out += [(400, None, "en"), (401, "", "en"), (402, None, None), (None, None, "de"), (None, out[0][1], "en"),
            (None, out[0][1], "en"), (3, out[3][1], out[3][2]), (3, out[3][1], "de"), (3, "another", "en"),
            (403, "a b " * 40_000, "xx"), (404, "x" * 100_000, "xx"), (405, "a\x00b\nc " * 60, "xx"), (-5, out[7][1], "fr")]
    return out


LABEL_ROWS = [(i, i % 3 % 2, i % 7 % 2) for i in range(0, 330, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (999, 1, 1)]


def audit(spark, docs, labels):
    d = spark.createDataFrame([(*r, "m", "p", None, "x") for r in docs], DOCS).repartition(3)
    return A.interaction_audit(A.failure_counts(d, spark.createDataFrame([(*r, "m") for r in labels], LABELS)), "ABCDE")


def test_steps_equal_plain_filters(spark, docs):
    got = audit(spark, docs, LABEL_ROWS)
    assert sorted(map(tuple, got.collect())) == plain(docs, LABEL_ROWS)


def test_empty_tables(spark, docs):
    assert audit(spark, [], LABEL_ROWS).count() == 0
    assert sorted(map(tuple, audit(spark, docs[:30], []).collect())) == plain(docs[:30], [])


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for level in A.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_a_swap_keeps_every_weight():
    rng = random.Random(2)
    weights = {m: (rng.randrange(50), rng.randrange(5), rng.randrange(3)) for m in rng.sample(range(32), 20)}
    diagram, memo = A.Diagram(weights, 5), {}
    total = tuple(sum(w[k] for w in weights.values()) for k in range(3))
    for level in A.adjacent_swaps(5):
        diagram.swap(level)
        assert diagram.weight(diagram.root, memo) == total
        for mask in range(32):
            node = diagram.root
            for variable in diagram.order:
                node = diagram.nodes[node][1 + (mask >> variable & 1)]
            assert diagram.nodes[node][1] == weights.get(mask, (0, 0, 0))


def test_equal_branches_share_nodes():
    assert len(A.Diagram({}, 5).nodes) == 6  # nothing fails: one node a level
    with pytest.raises(ValueError):
        A.interaction_audit(None, "ABCDEFGH")
