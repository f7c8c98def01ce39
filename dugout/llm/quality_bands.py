"""Quality rules: counts of a text, and limits on how well it compresses.

The zstandard ratio (bytes before / after) of ordinary prose grows slowly with length.
Text far above the band of its length repeats itself, text below it is noise. The ratio
is taken over the whole text and over fixed chunks, so that a document is also rejected
when most of its bytes lie in chunks out of band while the whole looks ordinary. The last
chunk is judged by the limits of its own length; texts of one chunk or more have chunks.

Signs of three bytes or more, as in Chinese, Japanese and Korean, carry more per byte than letters do, so ordinary
text of them compresses less. The lower limit moves from the one for letters to the one for such signs with their
share of the bytes.

Defined results: a null text has no words and counts 0 everywhere; it fails the base rules.
Texts shorter than the smallest band have no ratio limits. Rows that repeat are judged each by itself, very long texts
in whole and chunk by chunk; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from dugout.llm.common import id_and_text, map_slices

#: (bytes from, smallest ratio, largest ratio); a text uses the last row that it reaches.
#: The lower limits lie below every document labelled good in 0.5 GB, above the ratio of base64 in lines from 160
#: bytes on (up to 1.33) and in words of three to nine signs from 192 bytes on (up to 1.39), and above random
#: lower-case letters from 1,280 bytes on (1.65 to 1.72). Shorter than that, prose and such noise overlap.
BANDS = (
    (128, 1.02, 2.6),
    (160, 1.07, 2.6),
    (176, 1.09, 2.6),
    (192, 1.125, 2.6),
    (224, 1.18, 2.6),
    (256, 1.20, 2.8),
    (384, 1.28, 2.8),
    (512, 1.33, 3.0),
    (768, 1.42, 3.0),
    (1024, 1.50, 3.2),
    (1280, 1.66, 3.2),
    (1536, 1.69, 3.2),
    (2048, 1.72, 3.4),
    (4096, 1.76, 3.6),
    (8192, 1.80, 3.8),
    (16384, 1.80, 4.0),
    (65536, 1.80, 4.5),
)
#: (bytes from, smallest ratio) for text of signs of three bytes and more. Below pieces of Chinese, Japanese and Korean
#: program messages, and from 1,024 bytes on above random signs out of 600 of all
#: ideographs (1.29 there, 1.36 and 1.43 from 2,048 and 4,096). Random signs of a narrow range of code points share
#: their first bytes, compress like text and pass.
WIDE_LOW = ((512, 1.10), (768, 1.20), (1024, 1.30), (1536, 1.42), (2048, 1.50), (4096, 1.60), (8192, 1.65))
#: share of the bytes from which the limits for such signs hold alone
WIDE_SHARE = 0.5
CHUNK_BYTES, LEVEL = 4096, 3
#: a document goes when more than this share of its bytes lies in chunks out of band
MAX_BAD_CHUNKS = 0.5
REPEAT_WORDS, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def band(n_bytes: int, wide: float = 0.0, bands=BANDS) -> tuple[float, float]:
    """Limits for a text of so many bytes, of which the share ``wide`` belongs to signs of three bytes or more."""
    low, high = 0.0, float("inf")
    for start, a, b in bands:
        if n_bytes >= start:
            low, high = a, b
    if wide and low:
        other = max((ratio for start, ratio in WIDE_LOW if n_bytes >= start), default=0.0)
        low += (min(low, other) - low) * min(1.0, wide / WIDE_SHARE)
    return low, high


def wide_share(body: bytes) -> float:
    """Share of the bytes that belong to signs of three bytes or more."""
    if body.isascii():
        return 0.0
    lead = np.frombuffer(body, np.uint8) >= 0xE0
    return min(1.0, 3 * int(np.count_nonzero(lead)) / len(body))


def repeated_words(words: list[bytes], width: int = REPEAT_WORDS) -> int:
    """Words inside a window of ``width`` words that occurs twice or more; first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Name windows of 1, 2, 4, ... words exactly: equal names are equal word sequences.
    name, have = ids, 1
    while have < width:
        step = min(have, width - have)
        pair = name[: len(name) - step] * (len(words) + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1].reshape(-1)
        have += step
    twice = np.bincount(name)[name] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(len, _SPACES.findall(text)))
    lines = Counter(line for line in text.split("\n") if line.encode().split()) if "\n" in text else {}
    duplicated = sum(n - 1 for n in lines.values()) if lines else 0
    return len(words), chars, len(_SYMBOL.findall(text)), duplicated, repeated_words(words)


def _ratio(coder, body: bytes) -> float:
    return len(body) / len(coder.compress(body))


def in_band(coder, body: bytes) -> tuple[bool, float, float]:
    """Verdict, ratio of the whole, share of the bytes in chunks out of band; the last chunk may be short."""
    if not body:
        return True, 0.0, 0.0
    whole = _ratio(coder, body)
    low, high = band(len(body), wide_share(body))
    ok = low <= whole <= high
    bad = 0
    for i in range(0, len(body) if len(body) >= CHUNK_BYTES else 0, CHUNK_BYTES):
        chunk = body[i:i + CHUNK_BYTES]
        low, high = band(len(chunk), wide_share(chunk))
        bad += 0 if low <= _ratio(coder, chunk) <= high else len(chunk)
    share = bad / len(body)
    return ok and share <= MAX_BAD_CHUNKS, whole, share


def quality_bands(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, compression figures and the final ``kept`` of every row. No shuffle."""

    def factory():
        coder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)

        def work(batch):
            texts = batch.column("text").to_pylist()
            counts = [base_counts(t) for t in texts]
            failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0] for c in counts]
            bands = [in_band(coder, (t or "").encode()) for t in texts]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return {
                "doc_id": batch.column("doc_id"), **{k: [c[i] for c in counts] for i, k in enumerate(names)},
                "base_failed": failed, "kept": [b[0] and not f for b, f in zip(bands, failed)],
                "ratio": [b[1] for b in bands], "bad_chunks": [b[2] for b in bands],
            }
        return work

    return map_slices(
        id_and_text(df, id_col, text_col), factory,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, bad_chunks double",
    )
