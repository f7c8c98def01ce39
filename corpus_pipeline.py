"""A training corpus from raw documents: five stages, each one operator of ``dugout.llm``.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a table; all
but the last return the columns of ``docs``. Each result is written and read again before the next
stage, so a lost executor never costs more than the stage it worked on.

Defined results: an empty table passes through every stage. Nulls, repeated rows and extra columns
are treated as the operators state; a document without letters is not identified and goes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dugout.llm import exact_dedup, language_id, phrase_automata, queries, simhash
from dugout.sources.shared import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression does not tell apart go."""
    return language_id.keep_identified(docs, queries.fitted_languages(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays, the one with the largest id."""
    return exact_dedup.exact_survivors(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the smallest id.

    Rows are told apart by id and fingerprint, so different texts under one id are judged each by itself.
    """
    return simhash.one_per_component(
        docs, shingle_words=queries.SHINGLE_WORDS, max_distance=queries.MAX_DISTANCE)


def cut_repeated_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the text; ``n_chars`` follows."""
    return phrase_automata.without_repeated_phrases(
        docs, length=queries.PHRASE_WORDS, chars_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return queries.packed(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("substring_dedup", cut_repeated_phrases),
    ("packing", pack),
]

#: SQL cannot express compression, fingerprints or tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
