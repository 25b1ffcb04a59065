"""Toxicity by a chain of classifiers.

The categories are predicted one after the other. Each has a linear (logistic) model over the features of a text and the
probabilities of the categories before it. For training, those earlier probabilities are out-of-fold: each training text
gets them from models that have not seen it, so later models learn from errors like those they will meet.

Features: the presence of words and of their first 4 and 5 bytes (letters of any script, lower-cased, hashed), and the
shares of capitals and of symbols in tenths. Of these, each category keeps the KEPT with the highest chi-squared on the
training texts. Texts are read whole.

The `labels` table knows two categories, used in this order: `junk` (quality is 0) and `toxic`. A document is rejected
when its toxic probability is at least THRESHOLD. Models are fitted in numpy on a bounded, hash-ordered sample: at most
SAMPLE labelled rows with and SAMPLE without the last category.

Edge cases: a null text counts as empty (no features: the bias decides); null ids and null labels are not learned from;
several labels of one id count as the largest; with no labels, or only one class, a category's probability is its
training share (0 without labels); empty tables give empty results; repeated rows each get a row; other columns pass
through (columns named p_junk, p_toxic, toxic_pred or score are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, chunks, mix, runs, text_bytes, with_computed

SAMPLE, KEPT, FOLDS, THRESHOLD = 2000, 1000, 3, 0.5
#: A feature of fewer texts, or of a smaller chi-squared (p above 0.0016), tells nothing.
RARE, CHI = 3, 10.0
CATEGORIES = ("junk", "toxic")
_BITS = 22
_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = _INSIDE[128:] = True


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(kind)) >> np.uint64(64 - _BITS)).astype(np.int32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature bucket), distinct, for all texts of a chunk."""
    texts = [t or "" for t in texts]
    data, borders = text_bytes([t.lower() for t in texts])
    first, last = runs(_INSIDE[data])
    span, owner = SpanHash(data), np.searchsorted(borders, first, "right") - 1
    found, owners = [_bucket(span(first, last), 1)], [owner]
    for n, kind in ((4, 2), (5, 3)):
        long = last - first >= n
        found.append(_bucket(span(first[long], first[long] + n), kind))
        owners.append(owner[long])
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "replace") + b"\n", np.uint8)
    upper, symbol = (raw >= 65) & (raw <= 90), (raw > 32) & (raw < 127) & ~((raw | 32) >= 97) & ~((raw >= 48) & (raw <= 57))
    if len(texts):
        ends = np.cumsum([len(t.encode("utf-8", "replace")) + 1 for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        n = np.maximum(ends - starts - 1, 1)
        for flags, kind in ((upper, 4), (symbol, 5)):
            sums = np.concatenate([[0], np.cumsum(flags)])
            tenth = np.minimum(10 * (sums[ends] - sums[starts]) // n, 9)
            found.append(_bucket(tenth.astype(np.uint64), kind))
            owners.append(np.arange(len(texts)))
    both = np.unique(np.concatenate(owners).astype(np.int64) << _BITS | np.concatenate(found))
    return (both >> _BITS).astype(np.int64), (both & ((1 << _BITS) - 1)).astype(np.int32)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic model with balanced classes, by accelerated gradient descent."""
    n, k = x.shape
    share = y.mean() if n else 0.0
    if not 0 < share < 1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(k, np.float32), float(np.log(p / (1 - p)))
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / n
    x1 = np.concatenate([x, np.ones((n, 1), np.float32)], 1)
    rate = 4.0 / max(float((weight[:, None] * x1 * x1).sum()), 1e-6)
    w = np.zeros(k + 1, np.float32)
    look, before = w.copy(), w.copy()
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ look, -30, 30)))
        g = x1.T @ (weight * (p - y)) + ridge * np.append(look[:-1], 0).astype(np.float32)
        before, w = w, (look - np.float32(rate) * g).astype(np.float32)
        look = w + np.float32(i / (i + 3)) * (w - before)
    return w[:-1], float(w[-1])


def best_features(texts: np.ndarray, buckets: np.ndarray, y: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The buckets with the highest chi-squared with y, among those of at least RARE texts and above CHI; sorted."""
    n, pos = len(y), y.sum()
    both = np.bincount(buckets, y[texts], 1 << _BITS)
    all_ = np.bincount(buckets, minlength=1 << _BITS)
    seen = np.flatnonzero((all_ >= RARE) & (all_ < n))
    a, c = both[seen], all_[seen].astype(float)
    chi = n * (a * n - c * pos) ** 2 / np.maximum(c * (n - c) * pos * (n - pos), 1)
    order = np.lexsort((seen, -chi))[:kept]
    return np.sort(seen[order[chi[order] > CHI]])


def presence(texts: np.ndarray, buckets: np.ndarray, n: int, kept: np.ndarray) -> np.ndarray:
    at = np.searchsorted(kept, buckets).clip(0, max(len(kept) - 1, 0))
    hit = kept[at] == buckets if len(kept) else np.zeros(len(buckets), bool)
    x = np.zeros((n, len(kept)), np.float32)
    x[texts[hit], at[hit]] = 1
    return x


@dataclass
class Link:
    """One category's model: its features and weights, those of earlier probabilities, and the bias."""

    name: str
    kept: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def fit_chain(texts: np.ndarray, buckets: np.ndarray, y: dict[str, np.ndarray], fold: np.ndarray) -> list[Link]:
    """The chain's models from training features; fold: each text's fold for the out-of-fold probabilities."""
    n, chain = len(fold), []
    earlier = np.zeros((n, 0), np.float32)
    for name, target in y.items():
        kept = best_features(texts, buckets, target)
        x = np.concatenate([presence(texts, buckets, n, kept), earlier], 1)
        w, b = logistic(x, target)
        chain.append(Link(name, kept, w[: len(kept)], w[len(kept) :], b))
        out = np.zeros(n, np.float32)
        for f in range(FOLDS):
            held = fold == f
            if held.any():  # features are chosen anew, too: the held-out texts play no part
                there = ~held[texts]
                own = best_features(np.cumsum(~held)[texts[there]] - 1, buckets[there], target[~held])
                xf = np.concatenate([presence(texts, buckets, n, own), earlier], 1)
                wf, bf = logistic(xf[~held], target[~held])
                out[held] = 1 / (1 + np.exp(-np.clip(xf[held] @ wf + bf, -30, 30)))
        earlier = np.concatenate([earlier, out[:, None]], 1)
    return chain


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, text, junk, toxic of at most `size` labelled documents of each toxic value, in hash order.

    Labels are chosen first, so documents meet a bounded broadcast table and are not shuffled.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int")).alias("junk"))
    ranked = one.withColumn("h", F.xxhash64("doc_id"))
    picked = [ranked.where(F.col("toxic") == v).orderBy("h", "doc_id").limit(size) for v in (0, 1)]
    few = picked[0].unionByName(picked[1]).drop("h")
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # of an id with several texts the smallest, so that training does not depend on the order of rows
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("junk").alias("junk"))


def train(docs: DataFrame, labels: DataFrame) -> list[Link]:
    """The chain, from features of the bounded sample (their buckets come to the driver, not the texts)."""

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(list(batch["text"])):
                part = batch.iloc[lo:hi]
                t, b = features(list(part["text"]))
                cut = np.searchsorted(t, np.arange(len(part) + 1))
                yield pd.DataFrame({"doc_id": part["doc_id"], "junk": part["junk"], "toxic": part["toxic"], "buckets": [b[i:j].tobytes() for i, j in zip(cut, cut[1:])]})

    rows = sample(docs, labels).mapInPandas(run, "doc_id bigint, junk int, toxic int, buckets binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    found = [np.frombuffer(r["buckets"], np.int32) for r in rows]
    texts = np.repeat(np.arange(len(rows)), [len(x) for x in found])
    buckets = np.concatenate(found) if found else np.zeros(0, np.int32)
    fold = (mix(np.array([r["doc_id"] for r in rows], np.int64).astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    if not rows:
        return [Link(name, np.zeros(0, int), np.zeros(0), np.zeros(i), -30.0) for i, name in enumerate(CATEGORIES)]
    return fit_chain(texts, buckets, {c: np.array([r[c] for r in rows], np.float32) for c in CATEGORIES}, fold)


def chain_probabilities(chain: list[Link], texts: list[str | None], tables: list[np.ndarray]) -> np.ndarray:
    """Probabilities [text, category]; tables: each link's weights by bucket."""
    t, b = features(texts)
    out = np.zeros((len(texts), len(chain)))
    for i, (link, by_bucket) in enumerate(zip(chain, tables)):
        z = np.bincount(t, by_bucket[b], len(texts)) + link.bias + out[:, :i] @ link.earlier
        out[:, i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def predict(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """docs with p_junk, p_toxic, toxic_pred and score (the toxic probability). No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def compute():
        links, tables = model.value, []
        for link in links:
            by_bucket = np.zeros(1 << _BITS, np.float32)
            by_bucket[link.kept] = link.weights
            tables.append(by_bucket)

        def of(texts):
            p = chain_probabilities(links, texts, tables)
            return [*(pa.array(p[:, i]) for i in range(len(links))), pa.array(p[:, -1] >= THRESHOLD), pa.array(p[:, -1])]

        return of

    names = ", ".join(f"p_{link.name} double" for link in chain)
    return with_computed(docs, "text", f"{names}, toxic_pred boolean, score double", compute)


def rejected(toxic_pred: Column) -> Column:
    return F.coalesce(toxic_pred, F.lit(False))
