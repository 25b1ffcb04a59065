"""Fill-in-middle: documents cut into prefix, middle and suffix at token borders, found by content-defined chunks.

Tokens are runs of separators with the word after them, `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`, and the separators that a
text ends with. A rolling hash over the last WINDOW bytes cuts every text into chunks, so that equal passages fall into
equal chunks wherever they stand. A chunk's boundary summary (how many words, whether it starts and ends inside one) is
kept in the worker by its hash and used again only when the kept content is the same, byte by byte; the oldest leave when
the kept content passes CACHE_BYTES. The number of words that end in each chunk follows from its summary and the start of
the next; running sums of these give the number of tokens and the chunk in which a cut lies, and only that chunk is
searched. Nothing is shuffled, and a lost executor's texts are cut anew, with the same result.

Edge cases: a null or empty text is plain with no tokens; so is one that holds a marker. Null ids hash as an empty
id. Repeated rows give equal rows. Texts of any length are taken whole, with some 40 bytes of memory a byte. Other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes under the rolling hash, chunk sizes, and one cut in so many places: about 640 bytes a chunk.
WINDOW, LEAST, MOST, EVERY = 32, 128, 4096, 512
#: Kept content of a worker.
CACHE_BYTES = 32 << 20
_WORD = re.compile(rb"[^ \t-\r]+")
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


def chunk_ends(raw: bytes, borders: list[int]) -> list[list[int]]:
    """Ends of the chunks of each text (raw[borders[i]:borders[i + 1]]): where the hash of the last bytes says so, never inside a code point."""
    data = np.frombuffer(raw, np.uint8)
    starts_char = (data & 0xC0) != 0x80
    cuts = np.arange(WINDOW, len(data), dtype=np.int64)
    cuts = cuts[starts_char[WINDOW:] & (SpanHash(data)(cuts - WINDOW, cuts) % np.uint64(EVERY) == 0)].tolist()
    out = []
    for first, last in zip(borders, borders[1:]):
        ends, at = [], first
        while at < last:
            i = bisect_left(cuts, at + LEAST)
            at = min(cuts[i] if i < len(cuts) else last, at + MOST, last)
            while at < last and not starts_char[at]:
                at += 1
            ends.append(at)
        out.append(ends)
    return out


class Summaries:
    """Boundary summaries (words, starts inside a word, ends inside one) of chunks by content."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held, self.hits, self.kept = most, 0, 0, {}

    def of(self, key: int, content: bytes) -> tuple[int, bool, bool]:
        known = self.kept.get(key)
        if known and known[0] == content:
            self.hits += 1
            return known[1]
        found = (len(_WORD.findall(content)), content[0] not in _SPACES, content[-1] not in _SPACES)
        self.held += len(content) - (len(known[0]) if known else 0)
        self.kept[key] = (content, found)
        while self.held > self.most and len(self.kept) > 1:
            self.held -= len(self.kept.pop(next(iter(self.kept)))[0])
        return found


class Cutter:
    """Finds token borders in texts through chunk summaries."""

    def __init__(self, summaries: Summaries | None = None):
        self.summaries = summaries or Summaries()

    def batch(self, texts: list[bytes]) -> Iterator[TextCuts]:
        borders = [0]
        for t in texts:
            borders.append(borders[-1] + len(t))
        raw = b"".join(texts)
        every = chunk_ends(raw, borders)
        last = np.array([e for ends in every for e in ends], np.int64)
        first = np.array([s for a, ends in zip(borders, every) for s in [a, *ends[:-1]][: len(ends)]], np.int64)
        keys = SpanHash(np.frombuffer(raw, np.uint8))(first, last).tolist()
        found = [self.summaries.of(k, raw[a:b]) for k, a, b in zip(keys, first.tolist(), last.tolist())]
        done = 0
        for a, ends in zip(borders, every):
            yield TextCuts(raw, a, ends, found[done : done + len(ends)])
            done += len(ends)


class TextCuts:
    """One text's chunks with running numbers of the words that end in them."""

    def __init__(self, raw: bytes, start: int, ends: list[int], found: list[tuple[int, bool, bool]]):
        self.raw, self.starts, self.ends, self.sums = raw, [start, *ends], ends, [0]
        for (words, _, inside), following in zip(found, [*found[1:], (0, False, False)]):
            self.sums.append(self.sums[-1] + words - (inside and following[1]))
        self.n = self.sums[-1] + (bool(found) and not found[-1][2])

    def cut(self, tokens: int) -> int:
        """Where the first so many tokens end, as a place in raw."""
        if tokens == 0:
            return self.starts[0]
        if tokens > self.sums[-1]:
            return self.ends[-1]
        chunk = bisect_left(self.sums, tokens) - 1
        here = self.raw[self.starts[chunk] : self.ends[chunk]]
        return self.starts[chunk] + next(islice(_WORD.finditer(here), tokens - self.sums[chunk] - 1, None)).end()


def draws(seed: int, doc_id: object) -> list[int]:
    """The first four 32-bit numbers of the sha256 of seed:id."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12)]


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output: one row per row of docs.

    rate: percent of documents that are cut at all; spm_rate: percent of those that take the suffix first.
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                rows = []
                for doc_id, text, cuts in zip(ids.slice(lo, hi - lo).to_pylist(), texts[lo:hi], cutter.batch([t.encode() for t in texts[lo:hi]])):
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
                        rows.append((cuts.n, "plain", None, None, text))
                        continue
                    a, b = (cuts.cut(k) for k in sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1))))
                    prefix, middle, suffix = (cuts.raw[x:y].decode() for x, y in ((cuts.starts[0], a), (a, b), (b, cuts.ends[-1])))
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    rows.append((cuts.n, form, len(prefix), len(middle), arrange(form, prefix, middle, suffix)))
                n, forms, p, m, out = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No marker stands in a text that was cut, nor can one arise at a border."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transform(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))
