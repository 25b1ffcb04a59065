"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

Encoding keeps, for every prefix of a piece of text, the last token of that prefix's encoding. That token is unique: it
is the one token that ends there (found by an Aho-Corasick automaton) and that is compatible with the last token of the
prefix before it. Two tokens are compatible when merging the text of both gives just these two. The ids are then
recovered backwards. Because a character that no token holds, and a space after a non-space, can never lie inside a
token, texts fall into units that are encoded alone; each worker keeps the units it has seen in a bounded cache.

Edge cases: a null text counts as empty and gives just begin and end; empty tables give empty results; repeated rows
each get a row; other columns pass through (columns named ids, n_tokens or decoded are replaced).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_computed

SPACE = "▁"
_UNKNOWN = -1


class PieceModel:
    """The vocabulary of a SentencePiece model, and encoding and decoding by it."""

    #: Units kept by the cache's two generations.
    KEPT = 150_000

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.pieces = [b""] * size
        for p, i in self.ids.items():
            self.pieces[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.pieces[i] = bytes([b])
        self.names = {i: p for p, i in self.ids.items()}
        self.single = {p for p in self.ids if len(p) == 1}
        inside = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        if inside:
            raise ValueError(f"pieces hold a space or line end inside: {inside[:3]}")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [p]:  # others are never the outcome of merging
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.width = {i: len(p) for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """What merging gives: again and again the best-ranked adjacent pair that forms a piece, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both tokens gives just these two."""
        x, y = self.names[a], self.names[b]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self.merged(x + y) == [x, y]
        return found

    def encode_unit(self, unit: str) -> list[int]:
        """ids of a unit, by its table of last tokens."""
        last: list[int | None] = [None] * (len(unit) + 1)
        last[0] = _UNKNOWN
        if not self.single.issuperset(unit):
            for i, c in enumerate(unit):
                if c not in self.single:
                    last[i + 1] = _UNKNOWN
        seen = self.pairs.get
        for at, (token, length) in self.automaton.iter(unit):
            if last[at + 1] is None:
                before = last[at + 1 - length]
                if before < 0:
                    last[at + 1] = token
                else:
                    fits = seen(before << 20 | token)
                    if fits or (fits is None and self.compatible(before, token)):
                        last[at + 1] = token
        out: list[int] = []
        i = len(unit)
        while i > 0:
            token = last[i]
            if token < 0:
                out.extend(self.byte_ids[b] for b in reversed(unit[i - 1].encode()))
                i -= 1
            else:
                out.append(token)
                i -= self.width[token]
        return out[::-1]

    def unit(self, unit: str) -> bytes:
        found = self.young.get(unit)
        if found is None:
            found = self.old.get(unit)
            if found is None:
                found = np.array(self.encode_unit(unit.replace(" ", SPACE)), "<u4").tobytes()
            if len(unit) <= 64:
                if len(self.young) >= self.KEPT:
                    self.old, self.young = self.young, {}
                self.young[unit] = found
        return found

    _units = re.compile(r" +[^ \n]*|[^ \n]+|\n")

    def encode(self, text: str | None) -> bytes:
        """ids with begin and end, as little-endian unsigned 32-bit integers."""
        parts = [np.uint32(self.begin).tobytes()]
        if text:
            if SPACE in text:
                text = text.replace(SPACE, " ")
            get, unit = self.young.get, self.unit
            parts += [get(u) or unit(u) for u in self._units.findall(" " + text)]
        parts.append(np.uint32(self.end).tobytes())
        return b"".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        raw = b"".join(map(self.pieces.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit, binary), n_tokens and decoded added. No shuffle; batch by batch.

    `path` is the model file on every machine (an installed package), read once by each worker.
    """

    def compute():
        model = model_at(path)

        def of(texts):
            ids = [model.encode(t) for t in texts]
            decoded = [model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())]

        return of

    return with_computed(docs, text, "ids binary, n_tokens bigint, decoded string", compute)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    out = encode_decode(docs.select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))

