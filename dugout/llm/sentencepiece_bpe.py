"""Merge-type SentencePiece encoding by backtracking, and decoding.

A token sequence is the encoding of a text exactly if every adjacent pair of tokens, merged
again from its characters, falls back into the same two tokens. The encoder therefore takes
the longest token at each position (Aho-Corasick over the pieces), tests it against the token
before, shortens it while the test fails, steps back when nothing shorter is left, and marks
positions that cannot be continued in a bitfield so that none is tried twice.

Texts are cut before they are encoded where no piece can cross: between two characters that
never stand next to each other inside a piece. The cuts change no token; they make the parts
short and let a bounded cache serve repeated words.

Defined results: a null text is encoded as the empty text, which has no tokens. Texts are encoded whole, in memory that
follows the longest single text. Rows that repeat are encoded each on its own, null ids stay null, other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import string
from sys import getsizeof

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from dugout.llm.common import id_and_text, map_slices

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: bytes that a worker's cache of encoded parts holds, and entries of its cache of pairs; a full cache starts again empty
CHUNK_BYTES, PAIR_ENTRIES = 96 << 20, 400_000
#: longer parts hardly ever come again; they are encoded each time
LONGEST_CACHED = 48


class _Cache(dict):
    """Computes missing values; bounded by its number of entries."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class _TextCache(dict):
    """Computes missing values of texts; bounded by the bytes of keys and values, long texts are not kept."""

    def __init__(self, compute, limit: int, longest: int):
        super().__init__()
        self.compute, self.limit, self.longest, self.held = compute, limit, longest, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            # The tuple, the slot in the table and the integers come to less than 300 bytes.
            size = 300 + getsizeof(key) + sum(map(getsizeof, value))
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self.held += size
            self[key] = value
        return value


class PieceModel:
    """Pieces of a merge-type model with byte fallback, and its encoder and decoder."""

    def __init__(self, path: str):
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with byte fallback and leading space marks is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in spec.pieces]
        self.types = [p.type for p in spec.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type == _NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.special = {i for i, t in enumerate(self.types) if t != _NORMAL}
        self._build_tokens()
        self._build_cuts()
        self.round_trip = _TextCache(self._round_trip, CHUNK_BYTES, LONGEST_CACHED)

    # --- merging, the definition that everything else is checked against

    def merge(self, text: str) -> list[str]:
        """Join the adjacent pair with the best piece, leftmost first, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank),
                       default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _build_tokens(self) -> None:
        """Pieces that merging can reach, numbered; characters known only inside pieces count too."""
        reachable = [p for p in self.rank if len(p) == 1 or self.merge(p) == [p]]
        single = {c for p in reachable for c in p}
        self.tokens = reachable + sorted(single - set(reachable))
        number = {t: i for i, t in enumerate(self.tokens)}
        self.length = [len(t) for t in self.tokens]
        # The next shorter token that starts the same way, -1 if there is none.
        self.shorter = [
            next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.tokens
        ]
        self.ids = [
            (self.id_of[t],) if t in self.id_of else tuple(self.byte_id[b] for b in t.encode()) for t in self.tokens
        ]
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in number.items():
            self.matcher.add_word(t, i)
        self.matcher.make_automaton()
        size = len(self.tokens)
        tokens, merge = self.tokens, self.merge

        def compatible(pair: int) -> bool:
            a, b = tokens[pair // size], tokens[pair % size]
            return merge(a + b) == [a, b]

        self.compatible = _Cache(compatible, PAIR_ENTRIES)

    def _build_cuts(self) -> None:
        """Where a text may be cut: at line breaks, before a space mark that follows something else,
        and between a letter or digit and a sign, as far as no piece has the two side by side."""
        all_pieces = "\n".join(self.rank)
        if re.search(f"[^{SPACE}\n]{SPACE}", all_pieces) or any("\n" in p for p in self.rank):
            self.cut = re.compile(r"(?s:.+)")  # some piece crosses these places: do not cut
            return
        letter = r"[^\W\d_]"
        before = {c: set(re.findall(f"({letter}){re.escape(c)}", all_pieces)) for c in string.punctuation}
        signs = [c for c, met in before.items() if len(met) <= 8]
        odd = "".join(sorted(set().union(*(before[c] for c in signs))))
        word = f"{SPACE}*[^\\W\\d_{odd}]++(?=[{re.escape(''.join(signs))}])|" if signs else ""
        self.cut = re.compile(f"{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    # --- encoding

    def encode_chunk(self, chunk: str) -> list[int]:
        n, size = len(chunk), len(self.tokens)
        longest = [-1] * n
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, token in self.matcher.iter(chunk):
            longest[end - length[token] + 1] = token  # later ends overwrite: the longest stays
        out: list[int] = []
        start = 0
        while start < n:
            if longest[start] < 0:  # a character that no piece contains is spelled in bytes
                out += [self.byte_id[b] for b in chunk[start].encode()]
                start += 1
                continue
            stop = start
            while stop < n and longest[stop] >= 0:
                stop += 1
            out += self._backtrack(longest, start, stop, size, length, shorter, compatible)
            start = stop
        return out

    def _backtrack(self, longest, start, stop, size, length, shorter, compatible) -> list[int]:
        path: list[int] = []
        failed = 0  # bit i: nothing valid continues from position start + i
        at, token = start, longest[start]
        while True:
            end = at + length[token]
            if end <= stop and not failed >> (end - start) & 1 and (
                not path or compatible[path[-1] * size + token]
            ):
                path.append(token)
                if end == stop:
                    break
                at, token = end, longest[end]
                continue
            if shorter[token] >= 0:
                token = shorter[token]
                continue
            failed |= 1 << (at - start)
            token = path.pop()
            at -= length[token]
            # The token itself led to a failed position; the test above rejects it and shortens it.
        return [i for t in path for i in self.ids[t]]

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for c in self.chunks(text or "") for i in self.round_trip[c][0].split(",")]

    def _round_trip(self, chunk: str) -> tuple[str, str]:
        """Ids of a part in decimal, and the text that these ids decode to."""
        ids = self.encode_chunk(chunk)
        return ",".join([self.decimal[i] for i in ids]), self.pieces_to_text(ids)

    # --- decoding

    def pieces_to_text(self, ids: list[int]) -> str:
        """Text of a run of ids, the leading space not removed."""
        if self.special.isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in ids:
            kind = self.types[i]
            if kind == _BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_bytes_to_text(held))
                held = bytearray()
            if kind == _NORMAL:
                out.append(self.plain[i])
            elif kind == _UNKNOWN:
                out.append(" ⁇ ")
        if held:
            out.append(_bytes_to_text(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        while ids and self.types[ids[0]] == _CONTROL:
            ids = ids[1:]
        text = self.pieces_to_text(ids)
        starts_with_mark = bool(ids) and self.types[ids[0]] == _NORMAL and self.pieces[ids[0]].startswith(SPACE)
        return text[1:] if self.prefix and starts_with_mark else text


def _bytes_to_text(raw: bytearray) -> str:
    """UTF-8, every byte that does not belong to a valid character replaced."""
    out, i = [], 0
    while i < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i:i + width]).decode())
                i += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def load_model(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(
    df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (array of int). One pass, no shuffle."""

    def factory():
        model = load_model(model_path)

        def work(batch):
            return {"doc_id": batch.column("doc_id"),
                    "ids": [model.encode(t) for t in batch.column("text").to_pylist()]}
        return work

    return map_slices(id_and_text(df, id_col, text_col), factory, "doc_id long, ids array<int>")


def round_trip_digests(
    df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and digests both.

    The ids of a part and the text they decode to are cached together. Decoding a part alone
    is decoding it in place: a run of byte tokens never spans a cut.
    """

    def factory():
        model = load_model(model_path)
        look_up, mark = model.round_trip.__getitem__, model.prefix

        def one(text: str | None) -> tuple[int, str, str]:
            parts = list(map(look_up, model.chunks(text or "")))
            ids = ",".join([p[0] for p in parts])
            decoded = "".join([p[1] for p in parts])
            if mark and decoded:  # the first piece starts with the mark that encoding put there
                decoded = decoded[1:]
            return (ids.count(",") + 1 if ids else 0), _digest(ids), _digest(decoded)

        def work(batch):
            rows = [one(t) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"), "n_tokens": [r[0] for r in rows],
                "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows],
            }
        return work

    return map_slices(
        id_and_text(df, id_col, text_col), factory,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def library_model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's own processor, for comparison."""
    return sentencepiece.SentencePieceProcessor(model_file=path)
