"""Pivot tables of fingerprints, what they discard, and clashing column names."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dugout.llm import simhash


def _pivots():
    return np.random.default_rng(simhash.PIVOT_SEED).integers(0, 2**64, simhash.PIVOTS, np.uint64)


def test_table_holds_the_distances(spark):
    rng = random.Random(2)
    prints = [0, -1, 2**63 - 1, -(2**63), *[simhash._signed(rng.getrandbits(64)) for _ in range(50)]]
    rows = simhash.pivot_table(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    table = simhash.unpacked([np.array([r[c] for r in rows]) for c in simhash._NEAR])
    assert table.shape == (len(prints), simhash.PIVOTS)
    for r, distances in zip(rows, table):
        assert distances.tolist() == [((r["fp"] % 2**64) ^ int(p)).bit_count() for p in _pivots()]


def test_pivots_discard_pairs_and_lose_none():
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(400)}
    for p in list(prints)[:200]:
        for b in rng.sample(range(64), 3):
            p ^= 1 << b
        prints.add(p)
    fp = np.array(sorted(prints), np.uint64)
    table = np.bitwise_count(fp[:, None] ^ _pivots()[None, :]).astype(np.int8)
    tally = Counter()
    pairs = simhash.linked_forest(np.zeros(len(fp), np.int64), fp, table, 3, tally)
    linked = sum((a ^ b).bit_count() <= 3 for a in prints for b in prints if a < b)
    assert len(pairs) == linked == tally["linked"] == 200
    assert tally["equal key"] == len(fp) * (len(fp) - 1) // 2
    assert tally["first pivot"] == sum(tally[k] for k in ("one tree", "by pivots", "by bits", "linked"))
    assert tally["by bits"] < tally["by pivots"] / 100 and tally["first pivot"] < tally["equal key"] / 2


def test_columns_with_the_names_in_use(spark):
    near = " ".join(f"word{i}" for i in range(300))
    rows = [(1, near, 5, "a", 7), (2, near, 6, "b", 8), (2, "something else", 6, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __ID long, __fp string, __mark long")
    got = simhash.one_per_component(df.withColumn("key", F.lit(1)), shingle_words=3, max_distance=3)
    assert got.columns == [*df.columns, "key"]
    assert sorted(r["__fp"] for r in got.collect()) == ["a", "c"]
