"""Language by compression: the language whose dictionary encodes a text smallest wins.

A raw-content zstandard dictionary per language is cut from a bounded sample of labelled
rows. Texts are reduced to lower-case letters before they are encoded. A text of under
``SHORT_BYTES`` says little in one frame, whose size is in whole bytes and which is stored
raw when it is small; it is therefore encoded behind several fixed samples of each
language, and the mean growth of the frame counts.

A language that wins narrowly is often wrong. Learning rows that entered neither dictionary nor
samples tell from which margin on the winner can be relied on: the share of right labels is fitted
as a rising function of the margin, and the model's ``min_margin`` is where it reaches a stated
precision. Narrower wins are rejected.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when
nothing could be learned. Equal sizes go to the first language in alphabetical order and
are marked as rejected, as is every ``und``. With fewer than ``CALIBRATION_ROWS`` rows to judge by,
only these are. Where no margin reaches the precision, every row is rejected.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import accumulate, groupby

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import id_and_text, map_slices, quoted

UNKNOWN = "und"
#: Bounds of what is learned, all documented parameters of :func:`fit_languages`.
SAMPLE_ROWS, ROW_BYTES, DICTIONARY_BYTES, MAX_LANGUAGES = 400, 2000, 1 << 16, 256
SHORT_BYTES, PRIMERS, PRIMER_BYTES = 400, 8, 1200
#: smallest share of a text's bytes by which the best language must win, whatever the calibration says
MIN_MARGIN = 1e-6
#: share of right labels that rows of a margin must reach, and the rows it takes to tell
MIN_PRECISION, CALIBRATION_ROWS = 0.95, 100
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """Lower-case words of letters, joined by single spaces."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


@dataclass(frozen=True)
class LanguageModel:
    """Per language: dictionary content and the samples that short texts are encoded behind."""

    content: dict[str, bytes]
    primers: dict[str, list[bytes]]
    #: narrower wins are rejected
    min_margin: float = MIN_MARGIN


def fit_languages(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    row_bytes: int = ROW_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    max_languages: int = MAX_LANGUAGES,
    precision: float = MIN_PRECISION,
) -> LanguageModel:
    """Learn from about ``sample_rows`` rows of each of the ``max_languages`` commonest languages.

    The rows are chosen by a hash threshold that follows from the size of the language, so the
    driver receives a bounded sample whatever the size of the table. Each row gives at most
    ``row_bytes`` characters. A fifth of the rows feeds the primers; of the others, joined in the order
    of their hash, the first ``dictionary_bytes`` bytes are the dictionary. The sampled rows behind these are classified
    by their whole texts, in tasks, and set the margin from which on a share of ``precision`` is right.
    """
    rows = labelled.select(
        quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"),
        F.xxhash64(quoted(id_col).cast("string"), quoted(text_col).cast("string")).alias("order"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    share: Column = F.lit(0.0)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * sample_rows / n))).otherwise(share)
    unit = F.pmod(F.col("order"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Rows that repeat an id and its text share their hash and count once; the limit only bounds bad luck.
    chosen = (
        rows.where(unit < share).select("lang", "order", F.substring("text", 1, row_bytes).alias("text"))
        .distinct().limit(4 * sample_rows * max(1, len(counts)))
    )
    samples: dict[str, list] = {lang: [] for lang in sorted(counts)}
    for r in chosen.collect():
        samples[r["lang"]].append((r["order"], r["text"]))
    content, primers, spare = {}, {}, F.lit(False)
    for lang, found in samples.items():
        placed = [(order, w) for order, w in ((order, letters(t)) for order, t in sorted(found)) if w]
        words = [w for _, w in placed]
        held = max(1, len(words) // 5)  # kept out of the dictionary, for the primers
        ends = list(accumulate(len(w) + 1 for w in words[held:]))
        unused = held + bisect_left(ends, dictionary_bytes) + 1  # the first row behind the end of the dictionary
        if unused < len(placed):
            spare = spare | ((F.col("lang") == lang) & (F.col("order") >= placed[unused][0]))
        content[lang] = b" ".join(words[held:] or words)[:dictionary_bytes]
        pool = b" ".join(words[:held])
        step = max(1, (len(pool) - PRIMER_BYTES) // PRIMERS)
        primers[lang] = [pool[i * step:][:PRIMER_BYTES] for i in range(PRIMERS)]
    known = [lang for lang in content if content[lang]]
    model = LanguageModel({k: content[k] for k in known}, {k: primers[k] for k in known})
    # Judged once for each id and text, as they are learned.
    judged = _judged(rows.where((unit < share) & spare), model).distinct().limit(4 * sample_rows * max(1, len(counts)))
    return replace(model, min_margin=reliable_margin([(r["margin"], r["right"]) for r in judged.collect()], precision))


def _judged(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(order, margin, right) of labelled rows with letters."""

    def run(batches):
        classify = _classifier(model)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(2)]
            judged = pa.RecordBatch.from_pydict({
                "order": batch.column(0), "margin": pa.array([f[2] for f in found], pa.float64()),
                "right": pa.array([f[0] == lang.as_py() for f, lang in zip(found, batch.column(1))], pa.bool_()),
            })
            yield judged.filter(pa.array([f[0] != UNKNOWN for f in found], pa.bool_()))

    return rows.select("order", "lang", "text").mapInArrow(run, "order long, margin double, right boolean")


def reliable_margin(judged: Sequence[tuple[float, bool]], precision: float = MIN_PRECISION) -> float:
    """The margin from which on wins are right often enough, by the rising step function that fits (margin, right) best."""
    if len(judged) < CALIBRATION_ROWS:
        return MIN_MARGIN
    steps: list[list] = []  # lowest margin, rows, right ones; neighbours that do not rise are pooled
    for margin, rights in groupby(sorted(judged), key=lambda j: j[0]):
        rights = [right for _, right in rights]
        steps.append([margin, len(rights), sum(rights)])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, n, right = steps.pop()
            steps[-1][1:] = [steps[-1][1] + n, steps[-1][2] + right]
    return max(MIN_MARGIN, next((margin for margin, n, right in steps if right >= precision * n), float("inf")))


def _classifier(model: LanguageModel):
    params = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    coders = {
        lang: zstandard.ZstdCompressor(
            compression_params=params,
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        ) for lang, content in model.content.items()
    }
    bare = {
        lang: [(p, len(coders[lang].compress(p))) for p in model.primers[lang]] for lang in coders
    }

    def size(lang: str, body: bytes) -> float:
        encode = coders[lang].compress
        if len(body) >= SHORT_BYTES:
            return len(encode(body))
        return sum(len(encode(p + b" " + body)) - alone for p, alone in bare[lang]) / PRIMERS

    def classify(text: str | None) -> tuple[str, float, float]:
        body = letters(text) if text else b""
        if not body or not coders:
            return UNKNOWN, 0.0, 0.0
        found = sorted((size(lang, body), lang) for lang in coders)
        best, lang = found[0]
        gap = found[1][0] - best if len(found) > 1 else float(len(body))
        # A byte less is eight bits more likely.
        weight = sum(2.0 ** max(-1000.0, 8 * (best - s)) for s, _ in found)
        return lang, 1.0 / weight, max(0.0, gap / len(body))

    return classify


def classify_languages(
    df: DataFrame,
    model: LanguageModel,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_margin: float | None = None,
) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), margin (bytes won per byte of letters), rejected.

    Rejected are margins below ``min_margin``, by default the one of the model.
    """
    least = model.min_margin if min_margin is None else min_margin

    def factory():
        classify = _classifier(model)

        def work(batch):
            found = [classify(t) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                "margin": [f[2] for f in found], "rejected": [f[0] == UNKNOWN or f[2] < least for f in found],
            }
        return work

    return map_slices(
        id_and_text(df, id_col, text_col), factory,
        "doc_id long, lang_pred string, score double, margin double, rejected boolean",
    )


def keep_identified(
    df: DataFrame, model: LanguageModel, *, text_col: str = "text", min_margin: float | None = None
) -> DataFrame:
    """The rows of ``df`` whose language is recognised, unchanged. One pass, no shuffle.

    Rows that :func:`classify_languages` rejects go: wins below ``min_margin``, by default the one of the model.
    """
    least = model.min_margin if min_margin is None else min_margin

    def run(batches):
        classify = _classifier(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [classify(t.as_py()) for t in texts]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[2] >= least for f in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
