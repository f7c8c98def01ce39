"""The pipeline: each stage against plain definitions, and the SQL definitions of single operators."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from dugout.llm.queries import ORACLES, QUERIES, SHINGLE_WORDS
from dugout.sources.shared import materialize
from tests.conftest import SF
from tests.llm import brute
from verification.check import connect, sorted_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = connect(SF).execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, cursor.fetchall())


def test_stages_follow_plain_definitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(materialize(stage(spark, results[-1], SF), name))
        if name != "packing":
            assert results[-1].columns == columns
    before = [{r["doc_id"]: r for r in df.collect()} for df in results[:-1]]
    raw, identified, exact, near, cut = before
    assert len(identified) >= 0.97 * len(raw)
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    heads = {}
    for i, r in identified.items():
        heads[lower(r["text"])] = max(i, heads.get(lower(r["text"]), i))
    assert set(exact) == set(heads.values())
    rows = [(i, r["text"]) for i, r in exact.items()]
    assert set(near) == {c for _, _, c in brute.near_duplicates(rows, SHINGLE_WORDS, 3)}
    rows = sorted((i, r["text"]) for i, r in near.items())
    for i, n, removed, sha in brute.phrases(rows, 13):
        words = brute.words_of(cut[i]["text"])
        assert len(words) == n - removed and brute.sha(b" ".join(words)) == sha
        assert cut[i]["n_chars"] == len(cut[i]["text"])
        assert removed or cut[i]["text"] == near[i]["text"]
    rows = [(i, r["text"]) for i, r in cut.items()]
    import public_tokenizers

    brute.check_packing(results[-1].collect(), rows, public_tokenizers.path("byte_bpe_50k.json"), 0, 1024)


def test_run_equals_its_stages_in_size(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns[:2] == ["doc_id", "start"] and found.count() > 0


def test_stages_take_nulls_repeated_rows_and_more_columns(spark, make, odd_rows):
    docs = make(odd_rows).selectExpr("*", "'xx' AS lang", "'s' AS source", "1L AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() > 0
    empty = make([]).limit(0).selectExpr("*", "'xx' AS lang", "'s' AS source", "1L AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_oracles_and_names():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert set(ORACLES) <= set(QUERIES) and duckdb and zlib
