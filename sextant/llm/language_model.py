"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from all training texts. A count c is kept as its quantised logarithm
q(c) = 1 + floor(log_B c), and an n-gram is put into the Bloom filter once for every level 1 .. q: a reader probes level
after level until one is missing and so recovers q, never less than was put in. The filter's bits follow the number of
entries without bound; it is built in segments by the workers. Up to MOST_BITS it is broadcast. A larger one stays in
segments: every batch of texts sends its distinct n-grams to the segments that know them, and their levels come back
to the batch. Smoothed probabilities interpolate the pair estimate with the word estimate and a uniform one
(Jelinek-Mercer, WEIGHTS).

The exact base score needs the exact count of every token. Counts of frequent words (HOT of them at most) are a bounded
table that the workers hold; the others meet their counts in a join by word, gathered per text first, so that no key is
hot there.

Edge cases: a null text counts as empty and has just the end token; null ids are scored and take part in training; an
empty training set gives counts of 0; repeated rows each get a row (and count each); empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, word_hashes, written

FOLDS, HELD_OUT = 7, 2
#: Base of the quantised logarithm, probes per level, bits per entry, and the most bits that are broadcast (64 MB).
LOG_BASE, PROBES, BITS_PER_ENTRY, MOST_BITS = 2.0, 3, 8, 1 << 29
SEGMENT_BITS = 20
#: Neighbouring segments that are asked together where the filter is not broadcast (4 MB).
SHARD = 32
HOT = 200_000
#: Weights of the pair, word and uniform estimates.
WEIGHTS = (0.6, 0.35, 0.05)
_END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts (words, then one end each) and the borders of the texts in them."""
    words, at = word_hashes(texts)
    n = len(texts)
    out = np.empty(len(words) + n, np.uint64)
    place = np.ones(len(out), bool)
    ends = at[1:] + np.arange(n)
    place[ends] = False
    out[place], out[ends] = words, _END
    return out, np.concatenate([[0], ends + 1])


def pairs(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; a text's first token follows the end token."""
    before = np.empty_like(found)
    before[1:], before[at[:-1]] = found[:-1], _END
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(3) + found + _PAIR)


def counted_words(docs: DataFrame) -> DataFrame:
    """gram, c: exact counts of tokens over all texts, added up batch by batch before they are shuffled."""

    def run(batches):
        for batch in batches:
            texts = list(batch["text"])
            for lo, hi in chunks(texts):
                found, _ = tokens(texts[lo:hi])
                g, c = np.unique(found, return_counts=True)
                yield pd.DataFrame({"gram": g.view(np.int64), "c": c})

    return docs.select("text").mapInPandas(run, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def quantised(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(LOG_BASE) + 1e-9).astype(np.int64)


def key(grams: np.ndarray) -> np.ndarray:
    """The 40 bits by which the filter knows an n-gram."""
    return mix(grams) >> np.uint64(24)


def probes(keys: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """PROBES bit numbers of (key, level), all in one segment, which the key's first bits alone choose."""
    segments = bits >> SEGMENT_BITS
    with np.errstate(over="ignore"):
        h = mix(keys + np.asarray(level).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    inside = np.stack([(h >> np.uint64(s)) & np.uint64((1 << SEGMENT_BITS) - 1) for s in (0, 21, 42)])
    return ((keys * np.uint64(segments) >> np.uint64(40)) << np.uint64(SEGMENT_BITS)) + inside


def size(entries: int) -> int:
    """The filter's bits for about so many entries: whole segments, and no upper bound."""
    bits = 1 << SEGMENT_BITS
    while bits < entries * BITS_PER_ENTRY:
        bits <<= 1
    return bits


def segment_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(bits >> SEGMENT_BITS) >> np.uint64(40)).astype(np.int64)


def build(docs: DataFrame, bits: int) -> DataFrame:
    """segment, bits: the packed filter of the words and pairs of all texts (segments without an entry have no row).

    Each batch sends its distinct keys and counts, packed, to the segments they belong to; there they are added up and
    their levels set. The filter grows with the entries, so a segment's keys stay about as many.
    """
    schema = "segment int, bits binary"

    def send(batches):
        for batch in batches:
            texts = list(batch["text"])
            for lo, hi in chunks(texts):
                found, at = tokens(texts[lo:hi])
                k, c = np.unique(key(np.concatenate([found, pairs(found, at)])), return_counts=True)
                where = segment_of(k, bits)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(k)]]) if len(k) else [0]
                five = k.view(np.uint8).reshape(-1, 8)[:, :5]
                packed = []
                for i, j in zip(cut, cut[1:]):
                    more = np.flatnonzero(c[i:j] > 1).astype(np.uint32)
                    packed.append(np.uint32(j - i).tobytes() + five[i:j].tobytes() + more.tobytes() + c[i:j][more].astype(np.uint32).tobytes())
                at_ = where[cut[:-1]] if len(k) else np.zeros(0, np.int64)
                yield pd.DataFrame({"segment": at_.astype(np.int32), "bits": packed})

    def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 4).reshape(n, 5)
        rest = np.frombuffer(raw[4 + 5 * n :], np.uint32)
        c = np.ones(n, np.int64)
        c[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
        return wide.view(np.uint64).ravel(), c

    def set_bits(held: list[bytes]) -> bytes:
        k, c = (np.concatenate(x) for x in zip(*map(unpack, held)))
        distinct, inverse = np.unique(k, return_inverse=True)
        q = quantised(np.bincount(inverse, c))
        made = np.zeros(1 << SEGMENT_BITS, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            made[(probes(distinct[q >= level], level, bits) & np.uint64((1 << SEGMENT_BITS) - 1)).ravel().astype(np.int64)] = True
        return np.packbits(made).tobytes()

    def fill(batches):
        now, held = None, []
        for batch in batches:
            for segment, raw in batch.itertuples(index=False):
                if segment != now:
                    if held:
                        yield pd.DataFrame({"segment": [now], "bits": [set_bits(held)]})
                    now, held = segment, []
                held.append(raw)
        if held:
            yield pd.DataFrame({"segment": [now], "bits": [set_bits(held)]})

    dealt = docs.select("text").mapInPandas(send, schema).repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInPandas(fill, schema)


def gathered(filter_: DataFrame, bits: int) -> np.ndarray:
    """A filter small enough to broadcast, in one array."""
    out, wide = np.zeros(bits // 8, np.uint8), 1 << (SEGMENT_BITS - 3)
    for r in filter_.toLocalIterator():
        out[r["segment"] * wide : (r["segment"] + 1) * wide] = np.frombuffer(r["bits"], np.uint8)
    return out


#: No count has a higher level.
MOST_LEVELS = 64


def levels(filter_: np.ndarray, grams: np.ndarray, top: int = MOST_LEVELS) -> np.ndarray:
    """q of each n-gram by repeated probes up to the highest level stored, 0 where level 1 is missing."""
    return probed(filter_, key(grams), len(filter_) * 8, top)


def probed(filter_: np.ndarray, keys: np.ndarray, bits: int, top: int, first: int = 0) -> np.ndarray:
    """q of each key in the part of a filter of `bits` bits that starts at bit `first`."""
    q = np.zeros(len(keys), np.int64)
    there = np.arange(len(keys))
    for level in range(1, top + 1):
        if not len(there):
            break
        hit = np.ones(len(there), bool)
        for row in probes(keys[there], level, bits) - np.uint64(first):
            hit &= (filter_[row >> np.uint64(3)] >> (7 - (row & np.uint64(7))).astype(np.uint8)) & 1 > 0
        there = there[hit]
        q[there] = level
    return q


def restored(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 1 for level 1."""
    return np.where(q == 0, 0.0, np.where(q == 1, 1.0, LOG_BASE ** (q - 1) * (1 + LOG_BASE) / 2 - 0.5))


def hot_from(words: DataFrame) -> int:
    """The smallest count that at most HOT words reach, from how many words have each count (a short table: counts add up to N)."""
    left, least = HOT, None
    for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).toLocalIterator():
        left -= r["k"]
        if left < 0:
            break
        least = r["c"]
    return least if least is not None else 1 << 62


def fit(docs: DataFrame) -> dict:
    """The model of training texts: filter (an array, or its written segments), its bits, N, V, and the written exact counts of tokens."""
    words = written(counted_words(docs), "lm-words")
    total = words.agg(F.sum("c"), F.count(F.lit(1)), F.max("c")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)
    hot = words.where(F.col("c") >= hot_from(words)).toPandas()
    grams, c = hot["gram"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64)
    order = np.argsort(grams)
    # pairs are at most tokens; about half of them are new, and most are seen once
    bits = size(v + n // 2)
    made = build(docs, bits)
    filter_ = gathered(made, bits) if bits <= MOST_BITS else written(made, "lm-filter")
    # no pair is seen more often than its word
    top = int(quantised(np.array([total[2] or 1]))[0])
    return {"filter": filter_, "bits": bits, "top": top, "N": n, "V": v, "words": words, "hot": (grams[order], c[order])}


def asked(texts: list[str | None]) -> np.ndarray:
    """The distinct keys, in order, that the scores of texts depend on."""
    found, at = tokens(texts)
    return np.unique(key(np.concatenate([found, pairs(found, at)])))


def answered(docs: DataFrame, filter_: DataFrame, bits: int, top: int) -> DataFrame:
    """chunk, shard, doc_id, held_out, text, q: docs in chunks, and after each chunk's texts the levels of its keys by shard.

    Chunks and their keys are written once, so that both meet again whatever task is repeated. Keys go to their shard of
    the filter, which answers with one byte each, in the order of the keys; answers go back to the chunk.
    """

    def ask(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = list(batch["text"])
            for lo, hi in chunks(texts, 1_000_000):
                k = asked(texts[lo:hi])
                where = segment_of(k, bits) // SHARD
                cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(k)]])
                five = k.view(np.uint8).reshape(-1, 8)[:, :5]
                few = batch.iloc[lo:hi]
                yield pd.DataFrame({"chunk": chunk, "doc_id": few["doc_id"].array, "held_out": few["held_out"].array, "text": few["text"].array})
                yield pd.DataFrame({"chunk": chunk, "shard": where[cut[:-1]].astype(np.int32), "keys": [five[i:j].tobytes() for i, j in zip(cut, cut[1:])]}).assign(doc_id=None, held_out=None, text=None)
                chunk += 1

    def ordered(batches):
        names = ["chunk", "shard", "doc_id", "held_out", "text", "keys"]
        for frame in ask(batches):
            if "shard" not in frame:
                frame = frame.assign(shard=pd.array([None] * len(frame), "Int32"), keys=None)
            yield frame[names]

    schema = "chunk bigint, shard int, doc_id string, held_out boolean, text string, keys binary"
    rows = written(docs.select("doc_id", "held_out", "text").mapInPandas(ordered, schema), "lm-chunks")
    texts = rows.where(F.col("shard").isNull()).select("chunk", "shard", "doc_id", "held_out", "text", F.lit(None).cast("binary").alias("q"))
    wide = 1 << (SEGMENT_BITS - 3)

    def answer(batches):
        now, held = None, None
        for batch in batches:
            got = []
            for shard, segment, chunk, raw in batch.itertuples(index=False):
                if shard != now:
                    now, held = shard, np.zeros(SHARD * wide, np.uint8)
                if segment >= 0:
                    at = (segment - shard * SHARD) * wide
                    held[at : at + wide] = np.frombuffer(raw, np.uint8)
                    continue
                k = np.zeros((len(raw) // 5, 8), np.uint8)
                k[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
                got.append((chunk, shard, probed(held, k.view(np.uint64).ravel(), bits, top, shard * SHARD << SEGMENT_BITS).astype(np.uint8).tobytes()))
            yield pd.DataFrame(got, columns=["chunk", "shard", "q"])

    stored = filter_.select(F.floor(F.col("segment") / SHARD).cast("int").alias("shard"), "segment", F.lit(-1).cast("bigint").alias("chunk"), F.col("bits").alias("raw"))
    sent = rows.where(F.col("shard").isNotNull()).select("shard", F.lit(-1).alias("segment"), "chunk", F.col("keys").alias("raw"))
    met = stored.unionByName(sent).repartition("shard").sortWithinPartitions("shard", F.desc("segment"))
    answers = met.mapInPandas(answer, "chunk bigint, shard int, q binary").select("chunk", "shard", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"), "q")
    return texts.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_first("shard"))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text, held_out).

    Ids travel as text: a column of numbers with a null would lose digits on its way through pandas.
    """
    kind = docs.schema["doc_id"].dataType
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    n, v, bits, top = model["N"], model["V"], model["bits"], model["top"]
    whole = isinstance(model["filter"], np.ndarray)
    shared = docs.sparkSession.sparkContext.broadcast((model["filter"] if whole else None, *model["hot"]))
    w2, w1, w0 = WEIGHTS

    def scored_chunk(rows: pd.DataFrame, find) -> pd.DataFrame:
        """Scores of the rows' texts; find(n-grams) gives levels."""
        _, grams, counts = shared.value
        logs = np.log10(counts + 1.0)
        found, at = tokens(list(rows["text"]))
        k, owner = len(rows), np.repeat(np.arange(len(rows)), np.diff(at))
        # smoothed probabilities from the filter; each distinct n-gram is probed once
        u, inverse = np.unique(found, return_inverse=True)
        c1 = restored(find(u))[inverse]
        p, pinverse = np.unique(pairs(found, at), return_inverse=True)
        c2 = restored(find(p))[pinverse]
        before = np.empty_like(c1)
        # a text's first token follows the end token, which each text has as its last
        before[1:], before[at[:-1]] = c1[:-1], c1[at[1:] - 1]
        prob = w2 * np.minimum(c2 / np.maximum(before, 1), 1) + w1 * c1 / max(n, 1) + w0 / (v + 1)
        total = np.bincount(owner, np.log10(np.minimum(prob, 1.0)), k)
        # exact counts of frequent words here, of others by a join
        place = np.searchsorted(grams, u).clip(0, max(len(grams) - 1, 0))
        is_hot = (grams[place] == u) if len(grams) else np.zeros(len(u), bool)
        gained = np.where(is_hot, logs[place] if len(logs) else 0.0, 0.0)[inverse]
        hot_sum = np.bincount(owner, gained, k)
        hot_n = np.bincount(owner, is_hot[inverse], k)
        cold = ~is_hot[inverse]
        code = owner[cold] * np.int64(len(u) + 1) + inverse[cold]
        distinct, times = np.unique(code, return_counts=True)
        cut = np.searchsorted(distinct // (len(u) + 1), np.arange(k + 1))
        rest = u[distinct % (len(u) + 1)].view(np.int64)
        return pd.DataFrame({
            "doc_id": rows["doc_id"].array, "held_out": rows["held_out"].astype(bool).array, "n_tokens": np.diff(at), "hot_n": hot_n.astype(np.int64), "hot_sum": hot_sum, "score": total,
            "cold": [rest[i:j] for i, j in zip(cut, cut[1:])], "times": [times[i:j].astype(np.int32) for i, j in zip(cut, cut[1:])]})

    def run(batches):
        bloom = shared.value[0]
        for batch in batches:
            for lo, hi in chunks(list(batch["text"]), 1_000_000):
                yield scored_chunk(batch.iloc[lo:hi], lambda grams: levels(bloom, grams, top))

    def with_answers(group: pd.DataFrame) -> pd.DataFrame:
        is_text = group["shard"].isna().to_numpy()
        rows = group[is_text]
        k, q = asked(list(rows["text"])), np.frombuffer(b"".join(group["q"][~is_text]), np.uint8)
        if len(k) != len(q):
            raise ValueError(f"{len(q)} answers to {len(k)} n-grams of a chunk")
        return scored_chunk(rows, lambda grams: q[np.searchsorted(k, key(grams))].astype(np.int64))

    def run_answered(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cut = [0, *(np.flatnonzero(np.diff(held["chunk"])) + 1)]
            for lo, hi in zip(cut, cut[1:]):
                yield with_answers(held.iloc[lo:hi])
            held = held.iloc[cut[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield with_answers(held)

    schema = "doc_id string, held_out boolean, n_tokens bigint, hot_n bigint, hot_sum double, score double, cold array<bigint>, times array<int>"
    if whole:
        rows = docs.select("doc_id", "held_out", "text").mapInPandas(run, schema)
    else:
        rows = answered(docs, model["filter"], bits, top).mapInPandas(run_answered, schema)
    scored = written(rows.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    cold = scored.where(F.size("cold") > 0).select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("gram"), "x.times")
    gained = cold.join(model["words"], "gram").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("cold_sum"), F.sum("times").alias("cold_n"))
    out = scored.drop("cold", "times").join(gained, "row", "left")
    base = F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", (F.col("hot_n") + F.coalesce("cold_n", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def digest(docs: DataFrame, remainder: Column) -> DataFrame:
    """Scores of all texts by a model of those whose remainder is not HELD_OUT."""
    rows = docs.select("doc_id", "text", F.coalesce(remainder == HELD_OUT, F.lit(False)).alias("held_out"))
    return score(rows, fit(rows.where(~F.col("held_out"))))
