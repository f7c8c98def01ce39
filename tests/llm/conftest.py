import random

import pytest
from pyspark.sql import types as T

#: names that operators use inside; the tables of these tests have them too
CLASHING = ("bucket", "row", "hash", "body", "fp", "ids", "key", "shard", "n_words", "component_id", "kept")


@pytest.fixture(scope="session")
def make(spark):
    """Table of (doc_id, text) rows with extra columns whose names clash with internal ones."""

    def build(rows, partitions=3):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
            + [T.StructField(c, T.StringType()) for c in CLASHING]
        )
        data = [(i, t, *(None if k % 2 else f"{c}{i}" for k, c in enumerate(CLASHING))) for i, t in rows]
        return spark.createDataFrame(data, schema).repartition(partitions)

    return build


def _prose(rng, n, words=None):
    pool = words or ["the", "of", "and", "river", "stone", "walks", "under", "light", "été", "Straße", "ÀB", "x"]
    return " ".join(rng.choice(pool) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies, shared passages, white space."""
    rng = random.Random(11)
    shared = _prose(rng, 60, [f"w{k}" for k in range(400)])
    rows = [(i, _prose(rng, rng.randrange(0, 120))) for i in range(40)]
    rows += [(100 + i, f"{_prose(rng, 8)}\n{shared}\t{_prose(rng, 5)}") for i in range(12)]
    rows += [(200 + i, shared.upper() if i % 2 else shared) for i in range(6)]
    rows += [(300, None), (301, ""), (302, "   \n\t"), (303, "word"), (304, "a b"), (None, None), (None, shared),
             (None, "only here " * 3), (305, "\x0b\x0c\r\x00 nul"), (306, "  two  spaces  "), (307, "1234 5678 !!")]
    rows += [(308, "ab" * 900), (309, "aaaa " * 700), (310, "日本語 テキスト 🎉 " * 40), (311, "x" * 5000)]
    rows += [(400, _prose(rng, 20000)), (401, "line one\n" * 300)]
    rows += [(7, rows[7][1]), (7, "another text under the same id"), (500, rows[3][1]), (501, rows[3][1])]
    return rows
