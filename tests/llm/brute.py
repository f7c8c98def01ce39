"""Plain definitions of what the operators return, row by row, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import sentencepiece
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def covered(n: int, starts, length: int) -> list[bool]:
    out = [False] * n
    for s in starts:
        out[s:s + length] = [True] * length
    return out


def runs(flags: list[bool]) -> int:
    return sum(b and not a for a, b in zip([False, *flags], flags))


def phrases(rows, length: int) -> list[tuple]:
    """rows: (id, text). (doc_id, n_words, n_removed, kept_sha256)."""
    key = lambda i: float("inf") if i is None else i
    first: dict = {}
    for i, text in rows:
        w = words_of(text)
        for j in range(len(w) - length + 1):
            phrase = tuple(w[j:j + length])
            first[phrase] = min(first.get(phrase, key(i)), key(i))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = covered(len(w), [j for j in range(len(w) - length + 1) if first[tuple(w[j:j + length])] < key(i)], length)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def repeated_bytes(rows, length: int, keep: str = "none") -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    key = lambda i: float("inf") if i is None else i
    places = defaultdict(list)
    for r, (i, text) in enumerate(rows):
        raw = (text or "").encode()
        for j in range(len(raw) - length + 1):
            places[raw[j:j + length]].append((key(i), j, r))
    starts = defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            head = min(found)[:2]
            for i, j, r in found:
                if keep == "none" or (i, j) != head:
                    starts[r].append(j)
    out = []
    for r, (i, text) in enumerate(rows):
        raw = (text or "").encode()
        gone = covered(len(raw), starts[r], length)
        out.append((i, len(raw), sum(gone), runs(gone), sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def sentencepiece_digests(rows, path: str) -> list[tuple]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i, text in rows:
        ids = model.encode(text or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    return out


def token_counts(rows, path: str, limit: int) -> list[tuple]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i, text in rows:
        n = len(model.encode(text or ""))
        out.append((i, len((text or "").encode()), n, n > limit))
    return out


def token_ids(rows, path: str, end_id: int) -> list[tuple[int | None, list[int]]]:
    model = Tokenizer.from_file(path)
    return [(i, model.encode(text or "", add_special_tokens=False).ids + [end_id]) for i, text in rows]


def check_packing(pieces, rows, path: str, end_id: int, size: int) -> int:
    """Assert that pieces hold every id once and sequences are gapless; returns the padding."""
    docs = dict(token_ids(rows, path, end_id))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(docs)
    for i, found in by_doc.items():
        at, ids = 0, docs[i]
        for p in sorted(found, key=lambda p: p["start"]):
            part = ids[at:at + p["length"]]
            raw = b"".join(x.to_bytes(4, "little") for x in part)
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(raw))
            assert p["length"] > 0
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def base_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = [w.decode() for w in words_of(text)]
    seen, duplicated = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            duplicated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[j:j + 8]) for j in range(len(words) - 7))
    twice = covered(len(words), [j for j in range(len(words) - 7) if windows[tuple(words[j:j + 8])] > 1], 8)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicated, sum(twice)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[j:j + width]) for j in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows, width: int, distance: int) -> list[tuple]:
    """(doc_id, fingerprint, component_id) by comparing all pairs."""
    prints = [fingerprint(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    smallest: dict = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(r)] = min(smallest.get(find(r), i), i)
    return [(i, f"{prints[r]:016x}", smallest.get(find(r))) for r, (i, _) in enumerate(rows)]
