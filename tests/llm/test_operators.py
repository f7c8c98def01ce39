"""The operators against plain definitions, on odd tables and on the small test tables."""

import random

import public_tokenizers
import pytest

from dugout.llm import (
    exact_dedup,
    factor_dedup,
    language_id,
    packing,
    phrase_automata,
    quality_bands,
    queries,
    sentencepiece_bpe,
    simhash,
    token_counts,
)
from tests.conftest import SF
from tests.llm import brute

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df, *names):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


PHRASE = ("doc_id", "n_words", "n_removed", "kept_sha256")
FACTOR = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# --- 1 phrase automata ----------------------------------------------------------------


@pytest.mark.parametrize("length,hot", [(13, 2000), (13, 2), (5, 3), (1, 2000), (30, 2000)])
def test_phrases_on_odd_rows(make, odd_rows, length, hot):
    got = phrase_automata.phrase_digests(make(odd_rows), length=length, hot=hot)
    assert rows_of(got, *PHRASE) == ordered(brute.phrases(odd_rows, length))


def test_shards_follow_the_input_when_few_partitions_are_set(spark, make, odd_rows, monkeypatch):
    monkeypatch.setattr(phrase_automata.A, "SHARD_BUCKETS", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = make(odd_rows, partitions=5)
        buckets = phrase_automata.A.bucket_table(df, "doc_id", "text")
        assert phrase_automata.A.shard_count(buckets) == 5
        assert phrase_automata.A.shard_count(buckets.limit(0)) == 1
        got = phrase_automata.phrase_digests(df)
        assert rows_of(got, *PHRASE) == ordered(brute.phrases(odd_rows, 13))
        got = factor_dedup.repeated_bytes(df, length=60, keep="none")
        assert rows_of(got, *FACTOR) == ordered(brute.repeated_bytes(odd_rows, 60, "none"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_phrases_are_judged_on_the_input(make):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, text + " tail"), (3, "head " + text + " tail")]
    got = {r["doc_id"]: r["n_removed"] for r in phrase_automata.phrase_digests(make(rows)).collect()}
    assert got == {1: 0, 2: 20, 3: 21}  # "tail" goes with the windows of document 2


def test_confirm_and_locate_with_many_small_automata():
    import numpy as np

    texts = [b"a b c d", b"x a b c", b"q r s t", b"b c d"]
    first, several = np.array([4, 9, 2, 6]), np.array([False, False, True, False])
    none = phrase_automata.A.NO_ID
    for size in (1, 2, 100):
        found = phrase_automata.confirm_and_locate(texts, first, several, 3, per_automaton=size)
        assert found == [[4, 4], [none, 4], [2, 2], [4]]


def test_text_without_phrases_keeps_white_space_and_columns(make):
    text = " ".join(f"w{i}" for i in range(15))
    df = make([(1, f"A  b\n{text}"), (2, f" B\t{text}\n end  of it "), (3, None), (4, "")])
    got = phrase_automata.without_repeated_phrases(df, chars_col=None)
    assert got.columns == df.columns
    found = {r["doc_id"]: r for r in got.collect()}
    assert found[1]["text"] == f"A  b\n{text}" and found[2]["text"] == " B\tend  of it "
    assert found[3]["text"] is None and found[4]["text"] == "" and found[2]["bucket"] == "bucket2"


# --- 2 sentencepiece --------------------------------------------------------------------


def test_sentencepiece_on_odd_rows(make, odd_rows):
    got = sentencepiece_bpe.round_trip_digests(make(odd_rows), PIECES)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(
        brute.sentencepiece_digests(odd_rows, PIECES))


def test_sentencepiece_equals_the_library_on_random_text():
    import random

    model, library = sentencepiece_bpe.load_model(PIECES), sentencepiece_bpe.library_model(PIECES)
    rng = random.Random(5)
    alphabet = " abcdeéßñth.,\n\t▁日本語🎉0123  <>_\x00 İ�"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [rng.randrange(3, 32000 if rng.random() < 0.5 else 600) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == library.decode(ids)


def test_sentencepiece_caches_stay_bounded(monkeypatch):
    cache = sentencepiece_bpe._Cache(lambda k: k * 2, 3)
    assert [cache[i] for i in range(10)] == [2 * i for i in range(10)] and len(cache) <= 3


def test_long_parts_do_not_fill_the_memory():
    import resource

    cache = sentencepiece_bpe._TextCache(lambda k: (k * 2, k, len(k)), 4 << 20, 48)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for i in range(100_000):
        cache["\u65e5\u672c" * 500 + str(i)]  # all different, 1,000 signs each
    assert len(cache) == 0 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000  # KB
    for i in range(100_000):
        assert cache[f"w{i}"] == (f"w{i}" * 2, f"w{i}", len(f"w{i}"))
        assert cache.held <= 4 << 20
    assert 0 < len(cache) < 15_000


# --- 3 packing ---------------------------------------------------------------------------


@pytest.mark.parametrize("window,open_windows,merge", [(1024, 256, 4096), (64, 2, 4), (7, 1, 1)])
def test_packing_on_odd_rows(make, odd_rows, window, open_windows, merge):
    rows = [(n, t) for n, (_, t) in enumerate(odd_rows)]  # ids told apart for the check
    rows.append((9000, "before <|endoftext|> after"))
    pieces = packing.pack_documents(
        make(rows), tokenizer_path=BYTE_BPE, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN, end_id=0, window=window, open_windows=open_windows, merge_windows=merge,
    ).collect()
    brute.check_packing(pieces, rows, BYTE_BPE, 0, window)


def test_packing_of_the_test_table_pads_little(spark):
    pieces = queries.op3_packing(spark, SF).collect()
    padding = brute.check_packing(pieces, documents(spark), BYTE_BPE, 0, 1024)
    assert padding < 0.01 * sum(p["length"] for p in pieces)


def test_open_windows_close_the_fullest():
    windows = packing.OpenWindows(10, 2)
    assert windows.put(6, "a") == [] and windows.put(7, "b") == []
    assert windows.put(4, "c") == [(0, ["a", "c"])]  # best fit fills the first window
    assert windows.put(8, "d") == [] and windows.put(9, "e") == [(2, ["d"])]
    assert windows.rest() == [(1, ["b"]), (3, ["e"])]


def test_fast_and_exact_token_ids_agree():
    import random

    encode = packing.TextEncoder(BYTE_BPE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    alphabet = "ab zé ÀŠ  \n\t\r'sll.,!?½²€–’\xa0\x85\x1f1日"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids, repr(text)


# --- 4 token counts -----------------------------------------------------------------------


@pytest.mark.parametrize("chunk,overlap", [(32768, 64), (200, 8), (50, 2)])
def test_token_counts_on_odd_rows(make, odd_rows, chunk, overlap):
    got = token_counts.token_counts(make(odd_rows), PIECES, limit=100, chunk_chars=chunk, overlap_chars=overlap)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == ordered(
        brute.token_counts(odd_rows, PIECES, 100))


def test_splices_widen_until_a_common_token_is_found():
    encode = token_counts.OffsetEncoder(PIECES)
    widened = 0
    for text in ("a" * 5000, "ab" * 3000, " " * 4000, "\n" * 3000, "日本" * 1500, "a" * 3001 + "b" * 2999):
        count, times = token_counts.spliced_count(encode, text, 300, 4)
        assert count == len(encode.model.encode(text))
        widened += times
    assert widened


# --- 5 longest previous factors ---------------------------------------------------------------


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length,hot", [(200, 2000), (40, 2), (9, 3), (3, 2000)])
def test_repeated_bytes_on_odd_rows(make, odd_rows, length, hot, keep):
    rows = [r for r in odd_rows if len(r[1] or "") < 6000]
    if keep == "first":  # rows that repeat an id are in no order; tell them apart
        seen = set()
        rows = [r for r in rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    got = factor_dedup.repeated_bytes(make(rows), length=length, hot=hot, keep=keep)
    assert rows_of(got, *FACTOR) == ordered(brute.repeated_bytes(rows, length, keep))


def test_repeated_bytes_of_the_test_table(spark):
    rows = documents(spark)
    assert rows_of(queries.op5_factor_dedup(spark, SF), *FACTOR) == ordered(brute.repeated_bytes(rows, 200))


@pytest.mark.parametrize("length", [1, 2, 5, 8, 9, 13, 16, 30, 31])
def test_factors_of_random_text(length):
    import numpy as np

    rng = np.random.default_rng(length)
    for size in (1, 2, 40, 120):
        text = rng.integers(97, 99, size).astype(np.uint8)
        text = np.concatenate([text, text[: size // 2], rng.integers(97, 100, 9).astype(np.uint8), text])
        earlier, later, _ = factor_dedup.factor_lengths(text, length)
        raw, least = text.tobytes(), max(1, length // 2)
        for i in range(len(raw)):
            for found, starts in ((earlier[i], range(i)), (later[i], range(i + 1, len(raw)))):
                longest = max((_shared(raw, i, j, length) for j in starts), default=0)
                assert found == (longest if longest >= least else 0)


def _shared(raw, i, j, most):
    n = 0
    while n < most and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
        n += 1
    return n


def test_places_of_a_segment_enter_the_array():
    import numpy as np

    text = np.frombuffer(b"abcdefgh\xffxyzxyzxy\xff", np.uint8)
    again = np.append(np.arange(8, 0, -1), np.zeros(10, np.int64))
    earlier, later, repeated = factor_dedup.factor_lengths(text, 4, again)
    assert earlier[:8].tolist() == [0] * 8 and later[:8].tolist() == repeated[:8].tolist() == [4, 4, 4, 4, 4, 3, 2, 1]
    assert earlier[9:17].tolist() == [0, 0, 0, 4, 4, 3, 2, 0] and later[9:17].tolist() == [4, 4, 3, 2, 0, 0, 0, 0]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_nothing_goes_without_the_factor_arrays(make, odd_rows, monkeypatch, keep):
    import numpy as np

    monkeypatch.setattr(factor_dedup, "factor_lengths", lambda text, *_: (np.zeros(len(text), np.int64),) * 3)
    got = factor_dedup.repeated_bytes(make(odd_rows), length=40, keep=keep).collect()
    assert sum(r["n_removed"] for r in got) == 0 and len(got) == len(odd_rows)


# --- 7 language --------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op7_language_id(spark, sf).collect()
    assert len(found) == len(truth) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_learning_sees_no_held_out_row(spark, make):
    import zlib

    from pyspark.sql import functions as F

    rows = [(i, "aaa bbb " * 9 if zlib.crc32(str(i).encode()) % 4 != 2 else "zzz yyy " * 9) for i in range(40)]
    docs = make(rows).withColumn("lang", F.lit("xx"))
    model = queries.fitted_languages(docs)
    assert b"aaa" in model.content["xx"] and b"z" not in model.content["xx"] + b"".join(model.primers["xx"])


def test_language_of_odd_rows(make, odd_rows):
    model = language_id.LanguageModel({"a": b"the of and river stone", "b": b"xyz"}, {"a": [b"the"] * 8, "b": [b"q"] * 8})
    found = {r["doc_id"]: r for r in language_id.classify_languages(make(odd_rows), model).collect()}
    for i in (300, 301, 302, 307):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    empty = language_id.classify_languages(make(odd_rows), language_id.LanguageModel({}, {})).collect()
    assert {r["lang_pred"] for r in empty} == {"und"}
    kept = language_id.keep_identified(make(odd_rows), model)
    assert kept.columns == make(odd_rows).columns and kept.count() < len(odd_rows)


def test_margin_from_which_languages_are_reliable():
    narrow = [(0.001 * (i % 9), i % 2 == 0) for i in range(90)]  # half right, whatever the margin
    wide = [(0.05 + 0.001 * i, i != 70) for i in range(100)]
    assert 0.008 < language_id.reliable_margin(narrow + wide, 0.95) <= 0.05
    assert language_id.reliable_margin(wide, 0.95) == 0.05
    assert language_id.reliable_margin([(m, True) for m, _ in narrow + wide], 0.95) == language_id.MIN_MARGIN
    assert language_id.reliable_margin([(m, False) for m, _ in narrow + wide], 0.95) == float("inf")
    assert language_id.reliable_margin(narrow, 0.95) == language_id.MIN_MARGIN  # too few rows to tell


def test_documents_of_no_certain_language_are_rejected(make):
    rng = random.Random(4)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400)]
    pools = {"aa": letters[:200], "bb": letters[200:]}
    rows, langs = [], {}
    for i in range(900):
        lang = ("aa", "bb")[i % 2]
        mixed = i % 9 == 0  # words of both languages, either label
        langs[i] = (lang, mixed)
        rows.append((i, " ".join(rng.choices(letters if mixed else pools[lang], k=80))))
    docs = make(rows).join(make([]).sparkSession.createDataFrame(
        [(i, lang) for i, (lang, _) in langs.items()], "doc_id long, lang string"), "doc_id")
    model = language_id.fit_languages(docs, dictionary_bytes=8000)
    assert model.min_margin > 0.005
    kept = {r["doc_id"] for r in language_id.keep_identified(docs, model).collect()}
    plain = [i for i, (_, mixed) in langs.items() if not mixed]
    assert sum(i in kept for i in plain) >= 0.99 * len(plain)
    assert len(kept) - len(kept & set(plain)) <= 0.5 * (len(langs) - len(plain))
    found = language_id.classify_languages(docs, model).collect()
    assert {r["doc_id"] for r in found if not r["rejected"]} == kept
    every = language_id.keep_identified(docs, model, min_margin=language_id.MIN_MARGIN)
    assert every.count() >= 0.98 * len(langs)


def test_size_of_the_dictionary_is_a_parameter(make):
    rows = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}" for k in range(100))) for i in range(40)]
    docs = make(rows).selectExpr("*", "'xx' AS lang")
    sizes = {n: len(language_id.fit_languages(docs, dictionary_bytes=n).content["xx"]) for n in (500, 2000)}
    assert sizes == {500: 500, 2000: 2000}


# --- 8 quality -----------------------------------------------------------------------------------


def test_quality_counts_on_odd_rows(make, odd_rows):
    got = quality_bands.quality_bands(make(odd_rows))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows_of(got, *names) == ordered((i, *brute.base_counts(t)) for i, t in odd_rows)
    for r in got.collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_bands_reject_repetition_and_noise_and_keep_prose(make):
    import base64
    import random

    rng = random.Random(4)
    syllables = ["ter", "an", "sto", "ri", "el", "mon", "ka", "dis", "per", "lo", "um", "ex"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    prose = " ".join(word() for _ in range(3000))
    noise = " ".join(base64.b85encode(rng.randbytes(30)).decode() for _ in range(300))
    dull = " ".join(f"item {i % 10} is {'very ' * (i % 7)}good" for i in range(600))
    rows = [(1, prose), (2, noise), (3, dull), (4, prose[:300]), (5, prose[:9000] + " " + "na " * 20000)]
    kept = {r["doc_id"]: r["kept"] for r in quality_bands.quality_bands(make(rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_quality_keeps_documents_labelled_good(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op8_quality_bands(spark, sf).join(labels, "doc_id").where("not base_failed")
    good = found.where("quality = 1")
    assert good.where("not kept").count() == 0 and good.count() > 0


def _coder():
    import zstandard

    return zstandard.ZstdCompressor(level=quality_bands.LEVEL, write_checksum=False, write_content_size=False)


def _random_words(rng, n, letters):
    out = ""
    while len(out) < n:
        out += "".join(rng.choices(letters, k=rng.randrange(3, 10))) + " "
    return out[:n].encode()


def _base64_lines(rng, n):
    import base64

    return base64.encodebytes(rng.randbytes(n))[:n]


def test_noise_is_out_of_band_at_every_length():
    import random
    import string

    rng, coder = random.Random(8), _coder()
    signs = string.ascii_letters + string.digits + "+/"
    starts = [b[0] for b in quality_bands.BANDS]
    for start, end in zip(starts, [*starts[1:], 100_000]):
        for n in (start, (start + end) // 2, end - 1) * 5:
            lines = _base64_lines(rng, n)
            assert not quality_bands.in_band(coder, lines)[0] or n < 160 and len(lines.split()) < quality_bands.MIN_WORDS, n
            if n >= 192:
                assert not quality_bands.in_band(coder, _random_words(rng, n, signs))[0], n
            if n >= 1280:
                assert not quality_bands.in_band(coder, _random_words(rng, n, string.ascii_lowercase))[0], n


def _good_bodies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    return [r["text"].encode() for r in docs.join(good, "doc_id").orderBy("doc_id").collect() if r["text"]]


def test_documents_that_are_mostly_noise_are_out_of_band(spark):
    import random
    import string

    rng, coder = random.Random(9), _coder()
    good = _good_bodies(spark, SF.replace("0.001", "0.01"))
    prose = b" ".join(b for b in good if len(b) > 1000)
    for n in (8192, 20_000, 65_536, 226_000):
        for noise in (_base64_lines(rng, n * 9 // 10), _random_words(rng, n * 9 // 10, string.ascii_lowercase)):
            share = prose[:n // 10]
            assert not quality_bands.in_band(coder, share + b"\n" + noise)[0], n
            assert not quality_bands.in_band(coder, noise + b"\n" + share)[0], n


def test_prose_labelled_good_is_in_band_at_every_length(spark):
    coder = _coder()
    good = _good_bodies(spark, SF.replace("0.001", "0.1"))
    assert all(quality_bands.in_band(coder, b)[0] for b in good)
    assert {quality_bands.band(len(b)) for b in good} >= {b[1:] for b in quality_bands.BANDS if b[0] <= 16384}


def test_every_chunk_is_tested_from_one_chunk_on(spark):
    import random

    rng, coder = random.Random(10), _coder()
    good = _good_bodies(spark, SF.replace("0.001", "0.01"))
    prose = b" ".join(b for b in good if len(b) > 1000)
    half = quality_bands.CHUNK_BYTES // 2
    for n in (5000, 6500, 8191):
        noise = _base64_lines(rng, quality_bands.CHUNK_BYTES)
        assert not quality_bands.in_band(coder, noise + prose[:n - len(noise)])[0], n
        dull = (prose[:60] + b" ") * 40
        repeated = prose[:half] + dull[:half] + prose[half:n - half]
        assert not quality_bands.in_band(coder, repeated)[0], n
        assert quality_bands.in_band(coder, prose[:n])[0], n
    last = prose[:2 * 4096] + _base64_lines(rng, 4000)
    assert quality_bands.in_band(coder, last)[2] == 4000 / len(last)


# --- 9 simhash -----------------------------------------------------------------------------------


def test_simhash_on_odd_rows(make, odd_rows):
    got = simhash.near_duplicates(make(odd_rows), shingle_words=3, max_distance=3)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == ordered(brute.near_duplicates(odd_rows, 3, 3))


def test_links_connect_exactly_what_is_close(spark):
    import random

    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints):  # chains and dense groups
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                p ^= 1 << b
            prints.add(p)
    signed = [simhash._signed(p) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    expected = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    for options in ({}, {"task_rows": 50, "hot_rows": 2}):
        found = [frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(df, 3, **options).collect()]
        assert _classes(prints, found) == _classes(prints, expected)
        assert len(found) < 25 * len(prints)


def _classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for pair in pairs:
        a, b = (find(n) for n in pair)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_different_texts_under_one_id_are_judged_each_by_itself(make):
    near = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"sign{i * 7}" for i in range(300))
    third = " ".join(f"leaf{i * 3}" for i in range(300))
    rows = [(3, near), (7, near + " end"), (7, other), (8, other), (5, third), (5, third + " end"), (None, near)]
    got = simhash.one_per_component(make(rows), shingle_words=3, max_distance=6)
    kept = sorted((r["doc_id"] or 0, r["text"][:4]) for r in got.collect())
    assert kept == [(0, "word"), (3, "word"), (5, "leaf"), (7, "sign")]


def test_split_scheme_never_loses_a_pair():
    import random

    rng = random.Random(1)
    for n in (0, 10, 10**7, 10**10, 10**13):
        blocks, agree = simhash.split_scheme(n, 3)
        assert blocks - 3 == agree >= 1
        parts = simhash._blocks(blocks)
        for _ in range(300):
            flips = rng.sample(range(64), 3)
            clean = [p for p in parts if not any(p[0] <= f < p[0] + p[1] for f in flips)]
            assert len(clean) >= agree


def test_components_of_a_long_chain(spark):
    from dugout.llm.components import connected_components

    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


# --- 10 exact duplicates ------------------------------------------------------------------------------


def test_exact_groups_on_odd_rows(make, odd_rows):
    from pyspark.sql import functions as F

    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    for keep, pick in (("largest", max), ("smallest", min)):
        # A weak hash makes different texts collide; only their bytes tell them apart.
        for weak in (F.md5, lambda c: F.substring(F.md5(c), 1, 1)):
            found = exact_dedup.exact_groups(make(odd_rows), keep=keep, content_hash=weak).collect()
            groups: dict = {}
            for i, t in odd_rows:
                groups.setdefault(lower(t), []).append(i)
            head = lambda ids: pick([i for i in ids if i is not None], default=None)
            expected = [(i, head(groups[lower(t)]), len(groups[lower(t)]), brute.sha(lower(t))) for i, t in odd_rows]
            got = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found]
            assert ordered(got) == ordered(expected)
            kept = [r for r in found if r["kept"]]
            assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    stay = exact_dedup.exact_survivors(make(odd_rows), keep="largest")
    assert stay.columns == make(odd_rows).columns
    assert ordered((lower(r["text"]),) for r in stay.collect()) == ordered((t,) for t in groups)


# --- empty tables -------------------------------------------------------------------------------------


def test_empty_tables_give_empty_results(make):
    empty = make([]).limit(0)
    model = language_id.fit_languages(empty.selectExpr("*", "text AS lang"))
    results = [
        phrase_automata.phrase_digests(empty), phrase_automata.without_repeated_phrases(empty),
        sentencepiece_bpe.round_trip_digests(empty, PIECES), queries.packed(empty),
        token_counts.token_counts(empty, PIECES, limit=5), factor_dedup.repeated_bytes(empty),
        language_id.classify_languages(empty, model), language_id.keep_identified(empty, model),
        quality_bands.quality_bands(empty), simhash.near_duplicates(empty, shingle_words=3, max_distance=3),
        simhash.one_per_component(empty, shingle_words=3, max_distance=3),
        exact_dedup.exact_groups(empty), exact_dedup.exact_survivors(empty),
    ]
    assert [df.count() for df in results] == [0] * len(results)
