"""Language ID: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a text, one forwards and one backwards; a softmax over both states labels
every position. A document's probabilities are the mean of its positions' probabilities over the bytes of letters. The
network is trained in numpy by backpropagation through time, with Adam, on the whole texts of a bounded hash-ordered
sample of labelled rows (SAMPLE). Whole texts are read, in windows of STEPS bytes that lie side by side and reach CONTEXT
bytes into their neighbours on both sides, where states warm up and nothing is labelled.

Cell: f = sigmoid(F[x] + U f-part), c = tanh(C[x] + V (f * h)), h' = h + f * (c - h), where F and C are tables by byte
(the byte's embedding times the input weights) and U, V are recurrent weights. Letters are lower-cased; ASCII
characters other than letters read as spaces.

Edge cases: a null text or one without a letter is 'und' with score 0; null labels are not learned from; without any
labelled row every text is 'und'; an empty table gives an empty result; repeated rows each get a row; other columns are
ignored. Null ids are not held out. Of equally likely languages the first in order is taken. A very long text is read
whole, window by window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_computed

#: Bound of the training sample: labelled rows.
SAMPLE = 600
STEPS, CONTEXT, LANES, HIDDEN = 64, 16, 4096, 6
EPOCHS, BATCH, RATE = 4, 64, 0.02
UNDETERMINED = "und"

_READ = np.full(256, 32, np.uint8)
_READ[97:123] = np.arange(97, 123)
_READ[65:91] = np.arange(97, 123)
_READ[128:] = np.arange(128, 256)
_LETTER = (_READ != 32).astype(np.float32)


@dataclass
class Network:
    """Weights of both directions and the output layer; arrays are feature by lane, so lanes are contiguous."""

    labels: list[str]
    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    out: np.ndarray  # labels x 2 hidden
    bias: np.ndarray  # labels x 1


def start(labels: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    cell = lambda: {
        "F": rng.normal(0, 0.3, (hidden, 256)).astype(np.float32), "C": rng.normal(0, 0.5, (hidden, 256)).astype(np.float32),
        "U": rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32), "V": rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)}
    return Network(labels, cell(), cell(), rng.normal(0, 0.3, (len(labels), 2 * hidden)).astype(np.float32), np.zeros((len(labels), 1), np.float32))


def sweep(cell: dict[str, np.ndarray], x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States [step, hidden, lane] of one direction over x [step, lane]; with `keep`, what backpropagation needs."""
    steps, lanes = x.shape
    h = np.zeros((len(cell["U"]), lanes), np.float32)
    states = np.empty((steps, *h.shape), np.float32)
    kept = []
    for t in range(steps):
        f = cell["U"] @ h
        f += cell["F"][:, x[t]]
        f *= 0.5
        np.tanh(f, out=f)
        f *= 0.5
        f += 0.5
        gated = f * h
        c = cell["V"] @ gated
        c += cell["C"][:, x[t]]
        np.tanh(c, out=c)
        if keep:
            kept.append((h, f, gated, c))
        d = c - h
        d *= f
        h = np.add(h, d, out=states[t])
    return states, kept


def probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """Label probabilities [step, label, lane] of every position of x [step, lane]."""
    ahead, _ = sweep(net.forward, x)
    back, _ = sweep(net.backward, x[::-1])
    half = ahead.shape[1]
    scores = np.matmul(net.out[:, :half], ahead) + np.matmul(net.out[:, half:], back[::-1]) + net.bias
    scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(1, keepdims=True)
    return scores


def through_time(cell: dict[str, np.ndarray], x: np.ndarray, kept: list, dstates: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of one direction by backpropagation through time."""
    grad = {k: np.zeros_like(v) for k, v in cell.items()}
    dh = np.zeros_like(dstates[0])
    for t in range(len(x) - 1, -1, -1):
        h, f, gated, c = kept[t]
        dh = dh + dstates[t]
        dc = dh * f * (1 - c * c)
        df = dh * (c - h)
        dgated = cell["V"].T @ dc
        df = (df + dgated * h) * f * (1 - f)
        grad["V"] += dc @ gated.T
        grad["U"] += df @ h.T
        for name, d in (("C", dc), ("F", df)):
            for i in range(len(d)):
                grad[name][i] += np.bincount(x[t], d[i], 256)
        dh = dh * (1 - f) + dgated * f + cell["U"].T @ df
    return grad


def fit(texts: list[bytes], targets: list[str], seed: int = 0, epochs: int = EPOCHS) -> Network | None:
    """A network trained on the texts (bytes); classes weigh the same however often they occur."""
    labels = sorted(set(targets))
    if not labels:
        return None
    net = start(labels, seed=seed)
    x, letters, y = windows(texts)
    if not x.shape[1]:
        return None
    target = np.array([labels.index(t) for t in targets])[y]
    weight = (1 / np.bincount(target, minlength=len(labels)).clip(1))[target].astype(np.float32)
    weight /= weight.mean()
    rng = np.random.default_rng(seed)
    half = HIDDEN
    params = [(net.forward, k) for k in net.forward] + [(net.backward, k) for k in net.backward] + [(net.__dict__, "out"), (net.__dict__, "bias")]
    m, v, step = [0.0] * len(params), [0.0] * len(params), 0
    total = epochs * -(-len(target) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            xb = x[:, pick]
            ahead, kept_a = sweep(net.forward, xb, True)
            back, kept_b = sweep(net.backward, xb[::-1], True)
            both = np.concatenate([ahead, back[::-1]], 1)
            s = np.matmul(net.out, both) + net.bias
            s -= s.max(1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(1, keepdims=True)
            p[:, target[pick], np.arange(len(pick))] -= 1
            p *= (letters[:, pick] * weight[pick])[:, None, :] / (len(pick) * STEPS / 8)
            dboth = np.matmul(net.out.T, p)
            grads = list(through_time(net.forward, xb, kept_a, dboth[:, :half]).values())
            grads += list(through_time(net.backward, xb[::-1], kept_b, dboth[::-1, half:]).values())
            grads += [np.einsum("tlb,thb->lh", p, both), p.sum((0, 2))[:, None]]
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for i, ((owner, name), g) in enumerate(zip(params, grads)):
                np.clip(g, -1, 1, out=g)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                owner[name] = owner[name] - np.float32(rate) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
                owner[name] = owner[name].astype(np.float32)
    return net


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes [step, lane] of the windows of all texts (spaces around a text), the weights of what each labels, and each lane's text."""
    counts = np.array([-(-len(t) // STEPS) for t in texts], np.int64)
    around = b" " * CONTEXT
    data = _READ[np.frombuffer(b"".join(around + t.ljust(n * STEPS) + around for t, n in zip(texts, counts.tolist())), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.arange(len(owner)) * STEPS + owner * 2 * CONTEXT
    x = data[first + np.arange(STEPS + 2 * CONTEXT)[:, None]]
    letters = _LETTER[x]
    letters[:CONTEXT] = letters[STEPS + CONTEXT :] = 0
    return x, letters, owner


def label(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability [text, label] over the letters of each text; zeros where there are none."""
    x, letters, owner = windows(texts)
    sums = np.zeros((len(texts), len(net.labels)))
    for lo in range(0, x.shape[1], LANES):
        p = probabilities(net, x[:, lo : lo + LANES])
        p *= letters[:, None, lo : lo + LANES]
        np.add.at(sums, owner[lo : lo + LANES], p.sum(0).T)
    n = np.bincount(owner, letters.sum(0), len(texts)) if len(owner) else np.zeros(len(texts))
    return sums / np.maximum(n, 1)[:, None]


def sample(docs: DataFrame, learn: Column, size: int = SAMPLE) -> DataFrame:
    """lang, text of a bounded number of labelled rows, in hash order."""
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # About twice the sample passes a bound on the hash, so that no task sends more than its share to the final sort.
    share = min(1.0, 2.0 * size / max(rows.count(), 1))
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    return rows.orderBy("h", "lang", "text").limit(size)


def train(docs: DataFrame, learn: Column) -> Network | None:
    """A network from the bounded sample, which comes to the driver: SAMPLE texts, a few megabytes."""
    rows = sample(docs, learn).collect()
    return fit([r["text"].lower().encode("utf-8", "replace") for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs (their own columns, of which text is read) with lang_pred and score. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def compute():
        known = model.value

        def of(texts):
            texts = [t or "" for t in texts]
            has = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if known is None or not has.any():
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                p = label(known, [t.lower().encode("utf-8", "replace") for t in texts])
                best, score = p.argmax(1), p.max(1)
            names = np.array(known.labels if known else [UNDETERMINED], object)[best]
            names[~has | (score <= 0)] = UNDETERMINED
            return [pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0).clip(0, 1).astype(float))]

        return of

    return with_computed(docs, "text", "lang_pred string, score double", compute)


#: Documents of this remainder are held out of learning.
FOLDS, HELD_OUT = 4, 2


def digest(docs: DataFrame, remainder: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(remainder == HELD_OUT, F.lit(False))
    net = train(docs, ~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return predict(rows, net).select("doc_id", "held_out", "lang_pred", "score")
