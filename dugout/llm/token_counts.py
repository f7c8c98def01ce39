"""Token counts, with huge texts encoded in overlapping chunks that are spliced exactly.

A sequence of merge-type tokens is the encoding of a text exactly if each adjacent pair is
one that encoding the pair gives back. All adjacent pairs inside the encoding of a chunk
have this property. When the encodings of two overlapping chunks both hold the same token
at the same place, the left encoding up to that token and the right one from it on
therefore form the encoding of both chunks together: every adjacent pair comes from one of
them. That common token is the proof the splice needs; where the overlap has none, the overlap
is widened and the right chunk is encoded again, in the extreme up to the chunk's own length
and beyond, so the count is exact for every text.

Defined results: a null text counts as empty: 0 bytes, 0 tokens.
"""

from __future__ import annotations

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from dugout.llm.common import id_and_text, map_slices

#: characters of a chunk and of the first overlap; texts up to one chunk are encoded whole
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 64


class OffsetEncoder:
    """Ids of a text with the character at which each token starts."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = len(self.model.encode_as_pieces("a")[0]) - 1  # characters put before a text
        self.chars = np.array([self._chars(i) for i in range(self.model.get_piece_size())], np.int64)

    def _chars(self, i: int) -> int:
        if not self.model.is_byte(i):
            return len(self.model.id_to_piece(i))
        value = int(self.model.id_to_piece(i)[3:5], 16)
        return 0 if 0x80 <= value < 0xC0 else 1  # the first byte of a character stands for all of it

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.model.encode(text), np.int64)
        widths = self.chars[ids]
        return ids, np.cumsum(widths) - widths - self.prefix

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


def common_token(left, right, first: int) -> tuple[int, int] | None:
    """Indices of the first token after ``first`` that both encodings hold at the same place."""
    (left_ids, left_at), (right_ids, right_at) = left, right
    _, i, j = np.intersect1d(
        (left_at << 20) | left_ids, (right_at << 20) | right_ids, assume_unique=False, return_indices=True
    )
    good = (left_at[i] > first) & (i > 0)
    if not good.any():
        return None
    k = int(np.flatnonzero(good)[0])
    return int(i[k]), int(j[k])


def spliced_count(
    encode, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> tuple[int, int]:
    """Number of tokens of ``text`` and how often an overlap had to be widened."""
    left = encode(text[:chunk_chars])
    done = min(chunk_chars, len(text))
    total = widened = 0
    while done < len(text):
        overlap = overlap_chars
        while True:
            start = max(0, done - overlap)
            end = min(len(text), done + chunk_chars)
            if start == 0:  # nothing left to widen into: encode from the beginning
                left, total = encode(text[:end]), 0
                break
            ids, at = encode(text[start:end])
            right = (ids, at + start)
            found = common_token(left, right, start)
            if found:
                i, j = found
                total += i
                left = (right[0][j:], right[1][j:])
                break
            overlap, widened = overlap * 4, widened + 1
            # ``left`` begins at a token of the chunk before; beyond it there is nothing to compare with.
            if done - overlap < left[1][0] and total:
                left, total, overlap = encode(text[:done]), 0, min(overlap, done)
        done = end
    return total + len(left[0]), widened


def token_counts(
    df: DataFrame,
    model_path: str,
    *,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), n_widened. No shuffle."""

    def factory():
        encode = OffsetEncoder(model_path)

        def work(batch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            counts = dict(zip(short, encode.counts([texts[i] for i in short])))
            widened = [0] * len(texts)
            for i, t in enumerate(texts):
                if i not in counts:
                    counts[i], widened[i] = spliced_count(encode, t, chunk_chars, overlap_chars)
            return {
                "doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": [counts[i] for i in range(len(texts))],
                "over_limit": [counts[i] > limit for i in range(len(texts))], "n_widened": widened,
            }
        return work

    return map_slices(
        id_and_text(df, id_col, text_col), factory,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_widened long", limit=1 << 20,
    )
