"""Small helpers that the training-data operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_folder, written

__all__ = ["discard", "shared_folder", "written"]


def with_computed(rows: DataFrame, text: str, added: str, compute: Callable[[], Callable[[list], list[pa.Array]]], most: int = 1_000_000) -> DataFrame:
    """rows with columns computed from their texts; all other columns pass through as they are, whatever their type and nulls.

    compute() is called once in each task and gives what turns a list of texts (None: null) into the arrays of the added
    columns. Texts come in lists of about `most` characters.
    """
    names = [c.split()[0] for c in added.split(", ")]
    rows = rows.drop(*names)
    at = rows.columns.index(text)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, {added}"

    def run(batches):
        of = compute()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in chunks(texts, most):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *of(texts[lo:hi])], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every bit of its input."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


#: Odd, so that it has an inverse modulo 2**64 and prefix sums give the hash of any span.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The separators of `[^\x20\x09-\x0D]+`.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n (grown as needed, kept by the worker)."""
    if len(_powers.get("up", ())) < n + 1:
        size = max(1 << 18, 1 << int(n + 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            with np.errstate(over="ignore"):
                _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
    return _powers["up"], _powers["down"]


def text_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts (None: empty) as one byte array, A-Z lower-cased, and the borders of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    borders = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    return _LOWER[joined], borders


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


class SpanHash:
    """64-bit hashes of spans of a byte array, from prefix sums of a polynomial in an odd base."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data))
        with np.errstate(over="ignore"):
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[last] - self.total[first]) * self.down[first] + (last - first).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words start (one more entry than texts)."""
    data, borders = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first, last = runs(~_SPACE[data])
    return SpanHash(data)(first, last), np.searchsorted(first, borders)


def chunks(texts: list[str | None], most: int = 1_000_000):
    """Ranges of texts of about `most` characters each (a longer text stands alone), to bound memory: some 50 bytes a character."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def crc_fold(doc_id: object, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n
