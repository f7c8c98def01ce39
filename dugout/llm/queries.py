"""The operators over the test tables, with production parameters, and their SQL definitions."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm import (
    exact_dedup,
    factor_dedup,
    filter_audit,
    language_id,
    main_text,
    packing,
    phrase_automata,
    prefix_trie,
    quality_bands,
    sentencepiece_bpe,
    simhash,
    token_counts,
    warc,
)

#: windows and limits of the contracts
PHRASE_WORDS, FACTOR_BYTES, TOKEN_LIMIT = 13, 200, 4096
SHINGLE_WORDS, MAX_DISTANCE = 3, 3
PIECES, BYTE_BPE, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 0
BLOCK_CONVERSATIONS, SHARED_TURNS = 100, 6


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def held_out(id_col: str = "doc_id"):
    """Rows that language learning must not see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted_languages(docs: DataFrame) -> language_id.LanguageModel:
    return language_id.fit_languages(docs.where(~held_out()))


def op1_phrase_automata(spark, sf_dir):
    return phrase_automata.phrase_digests(_documents(spark, sf_dir), length=PHRASE_WORDS)


def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(
        docs, tokenizer_path=public_tokenizers.path(BYTE_BPE), ranks_path=public_tokenizers.path(BYTE_RANKS),
        pattern=public_tokenizers.PATTERN, end_id=END_ID,
    )


def op3_packing(spark, sf_dir):
    return packed(_documents(spark, sf_dir))


def op4_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(
        _documents(spark, sf_dir), public_tokenizers.path(PIECES), limit=TOKEN_LIMIT)
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_factor_dedup(spark, sf_dir):
    return factor_dedup.repeated_bytes(_documents(spark, sf_dir), length=FACTOR_BYTES, keep="none")


def op6_warc(spark, sf_dir):
    index, folder = warc.archive_pages(spark, _read(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = language_id.classify_languages(docs, fitted_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_quality_bands(spark, sf_dir):
    return quality_bands.quality_bands(_documents(spark, sf_dir))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(
        _documents(spark, sf_dir), shingle_words=SHINGLE_WORDS, max_distance=MAX_DISTANCE)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_documents(spark, sf_dir), keep="largest")


def op11_main_text(spark, sf_dir):
    return main_text.extract_main_text(_read(spark, sf_dir, "pages"))


def op12_prefix_trie(spark, sf_dir):
    coded = prefix_trie.encoded_conversations(_read(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(
        prefix_trie.with_shared_heads(coded, block=BLOCK_CONVERSATIONS, heads=SHARED_TURNS))


def op13_filter_audit(spark, sf_dir):
    counts = filter_audit.failure_counts(_documents(spark, sf_dir), _read(spark, sf_dir, "labels"))
    return filter_audit.interaction_audit(counts, "ABCDE")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f for f in (
        op1_phrase_automata, op2_sentencepiece, op3_packing, op4_token_counts, op5_factor_dedup, op6_warc,
        op7_language_id, op8_quality_bands, op9_simhash, op10_exact_dedup, op11_main_text, op12_prefix_trie,
        op13_filter_audit, pipeline,
    )
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, {1 + 5 * part}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
    for part in range(8) for shift in (15, 10, 5, 0)
)

ORACLES = {
    "op1_phrase_automata": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'),
                                       lambda w: w <> '') AS words FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)
        ), firsts AS (SELECT phrase, min(doc_id) AS head FROM win GROUP BY phrase),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos
            FROM win JOIN firsts USING (phrase) WHERE head < doc_id
        ), cut AS (SELECT doc_id, list(pos) AS ats, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN ats IS NULL THEN words ELSE
                   list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
                                              lambda p: NOT list_contains(ats, p[2])), lambda p: p[1]) END, ' ')
               ) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op6_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        s AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
                     max(page_id) OVER (PARTITION BY body) AS head FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> head THEN head END AS refers_to
        FROM s
    """,
    "op10_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY body)
    """,
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(text, '') AS body,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, body, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS rn FROM t
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                           string_split(conv_id::VARCHAR, ''),
                           lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384)
                                         ELSE a >> 1 END), 4294967295::BIGINT) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ), rebuilt AS (
            SELECT c.conv_id, 0 AS part, rn, body, k FROM c JOIN own ON own.conv_id = base AND rn <= h
            UNION ALL
            SELECT c.conv_id, 1, rn, body, k FROM c JOIN own ON own.conv_id = c.conv_id AND rn > h
        ), reached AS (
            SELECT conv_id, 0::BIGINT AS depth, '' AS pre, 0::BIGINT AS chars FROM c
            UNION ALL
            SELECT conv_id, row_number() OVER w, string_agg(k, ',') OVER w, length(body)
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, rn)
        ), node AS (
            SELECT depth, pre, min(conv_id) AS node, count(*) AS n_convs, any_value(chars) AS chars
            FROM reached GROUP BY depth, pre
        ), member AS (SELECT conv_id, depth, node FROM reached JOIN node USING (depth, pre)),
        family AS (
            SELECT n.node, n.depth, n.n_convs, n.chars, p.node AS above
            FROM node n LEFT JOIN member p ON p.conv_id = n.node AND p.depth = n.depth - 1
        ), born AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n FROM family WHERE depth > 0 GROUP BY ALL),
        whole AS (
            SELECT family.*, coalesce(born.n, 0) AS n_children FROM family LEFT JOIN born USING (node, depth)
        ), sums AS (
            SELECT p.node, p.depth, sum((e.n_children = 0)::INT) AS n_leaves, sum((e.n_convs - 1) * e.chars) AS saved
            FROM whole e JOIN member p ON p.conv_id = e.node AND p.depth <= e.depth GROUP BY p.node, p.depth
        ), ends AS (
            SELECT node, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
            FROM member JOIN (SELECT conv_id, max(depth) AS depth FROM member GROUP BY conv_id) USING (conv_id, depth)
            GROUP BY node, depth
        )
        SELECT node AS conv_id, depth, above AS parent_conv_id, n_convs::BIGINT AS n_convs,
               n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
               sha256(coalesce(ids, '')) AS ends_sha256
        FROM whole JOIN sums USING (node, depth) LEFT JOIN ends USING (node, depth)
    """,
    "op13_filter_audit": """
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words
            FROM documents
        ), failed AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) THEN 'E' ELSE '' END AS mask
            FROM d
        ), marked AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
        ), counted AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM failed LEFT JOIN marked USING (doc_id) GROUP BY part, mask
        ), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), fall AS (
            SELECT part, mask, n, good, toxic, filter_order,
                   coalesce(list_min(list_transform(nullif(string_split(mask, ''), ['']),
                                                    lambda f: instr(filter_order, f))), 6) AS falls
            FROM counted, orders
        ), steps AS (
            SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
                   sum(CASE WHEN falls > step THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN falls = step THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN falls < step AND contains(mask, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN falls = step THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN falls = step THEN toxic ELSE 0 END) AS toxic_lost
            FROM fall, range(1, 6) r(step) GROUP BY part, filter_order, step
        )
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
               redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
               toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM steps
    """,
}
