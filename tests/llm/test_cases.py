"""Cases that each operator must get right: ids that are missing, parts of every kind, chains, lists that descent repairs."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, graph, jaccard, licenses, toxicity, vectors

BIG = 2**53 + 1


def linked(rows, t):
    """n_links and smallest reachable id of (key, vector, label) by comparing all pairs; keys of None stay apart by place."""
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= t:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    first = {r: min((k for k in keys if k is not None), default=None) for r, keys in ids.items()}
    return Counter((rows[i][0], links[i], first[find(i)], rows[i][0] == first[find(i)]) for i in range(len(rows)))


def near(rng, n, width=8, spread=0.12):
    centres = rng.normal(size=(n // 6 - 1, width))  # no divisor of 20 in common with the ids
    return [(centres[i % len(centres)] + spread * rng.normal(size=width)).tolist() for i in range(n)]


def test_vectors_without_ids_link(spark):
    rng = np.random.default_rng(3)
    made = near(rng, 60)
    rows = [(None if i % 4 == 1 else BIG + i, v, i % 2) for i, v in enumerate(made)] + [(None, made[0], 0), (None, [9.0] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rep string")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, 0.98).collect())
    assert got == linked(rows, 0.98) and sum(n for (i, k, *_), n in got.items() if i is None and k) > 5


def test_descent_finds_links_that_the_tables_missed(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MISS", 0.1)
    monkeypatch.setattr(vectors, "WHOLE", 10)
    monkeypatch.setattr(vectors, "BUCKET", 12)
    rng = np.random.default_rng(5)
    rows = [(i, v, 1) for i, v in enumerate(near(rng, 600, 16, 0.09))]
    report = {}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, 0.98, report).collect())
    assert got == linked(rows, 0.98)
    assert 0.9 < report["before"] < report["after"] and report["recall"] == 1.0 and report["attempts"] < vectors.ATTEMPTS


def test_every_query_row_is_audited(spark):
    """A class is a query if any of its ids is divisible by 20, not only its smallest."""
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (40, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)], "vec_id bigint, embedding array<double>, label int")
    assert {r["first"]: r["asked"] for r in vectors.usable(df).collect()} == {3: True, 5: False}


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1061)}


PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_typed_parts_through_spark(spark):
    long = "wort <|im_end|> \\ " * 20_000
    rows = [
        (BIG, 0, "user", "hello", None), (BIG, 1, "assistant", "unused", [part("text", "see <"), part("image", ref="a.png", width=600, height=100), part("audio", ref="b", seconds=1.2)]),
        (BIG, 2, "assistant", None, [part("document", ref="c", pages=3), part("video", ref="d"), part("text", None)]),
        (None, 0, "user", None, None), (None, 1, None, long, None), (7, 0, "user", "x", [])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"conv_id bigint, turn int, role string, text string, parts {PARTS}, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {BIG, None, 7}
    turns = chat.read_back(got[BIG]["formatted"])
    assert turns[0] == ("user", "hello") and [a["kind"] for a in got[BIG]["attachments"]] == ["image", "audio", "document", "other"]
    assert got[BIG]["tokens"] == 2 * chat.IMAGE_TOKENS + 2 * chat.AUDIO_TOKENS + 3 * chat.PAGE_TOKENS
    assert chat.read_back(got[None]["formatted"]) == [("user", ""), ("", long)] and chat.read_back(got[7]["formatted"]) == [("user", "")]
    for r in chat.digest(chat.format_conversations(df)).collect():
        assert r["formatted_chars"] == len(got[r["conv_id"]]["formatted"]) and r["n_turns"] == len(chat.read_back(got[r["conv_id"]]["formatted"]))
    plain = [[{"type": "text", "text": r[3] or ""}] if r[4] is None else [dict(zip(("type", "text", "ref", "width", "height", "seconds", "pages"), p)) for p in r[4]] for r in rows[:3]]
    want = chat.format_turns([(r[2], p) for r, p in zip(rows[:3], plain)])
    assert got[BIG]["formatted"] == want["formatted"] and json.loads(json.dumps(want["attachments"])) == [a.asDict() for a in got[BIG]["attachments"]]


def test_license_matches_are_whole_and_telling_is_apart(spark):
    texts = {
        1: "licensed under a creative commons attribution 4 0 international license", 2: "this work is licensed under the gnu general public license version 3", 3: "plain words only",
        4: "you may not use this file except in compliance with the license you may obtain a copy of it", 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = set()
    for doc, text in texts.items():
        held = set((text or "").split())
        for tid, (_, template) in enumerate(licenses.TEMPLATES):
            t = set(template.split())
            if len(held & t) >= licenses.THRESHOLD * len(t) - 1e-9:
                want.add((doc, tid, round(len(held & t) / len(t), 9), (licenses.TELLING & t) <= held))
    got = {(r["doc_id"], r["tid"], round(r["containment"], 9), r["told"]) for r in licenses.template_matches(df).collect()}
    assert got == want and any(not told for *_, told in want)


def test_counters_pack_whole():
    rng = np.random.default_rng(1)
    for counts in (np.zeros(1 << 16, np.uint32), rng.integers(0, 3, 1 << 16).astype(np.uint32), np.where(rng.random(1 << 16) < 0.01, 70_000, 0).astype(np.uint32), np.where(rng.random(1 << 16) < 0.02, 7, 0).astype(np.uint32)):
        raw = jaccard.packed(counts)
        at, values = jaccard.unpacked(raw)
        back = np.zeros(1 << 16, np.uint64)
        back[at] += values
        assert (back == counts).all() and len(raw) <= 1 + counts.nbytes


def plain_chain(features, y, folds):
    """The chain in plain Python: for each category, chosen features, gradient descent to the optimum, out-of-fold probabilities for the next."""
    n, earlier, out = len(features), [[] for _ in features], []

    def chosen(rows, target):
        pos, size, score = sum(target[i] for i in rows), len(rows), {}
        for b in sorted(set().union(*(features[i] for i in rows))):
            have = [i for i in rows if b in features[i]]
            a, c = sum(target[i] for i in have), len(have)
            if toxicity.RARE <= c < size:
                score[b] = size * (a * size - c * pos) ** 2 / max(c * (size - c) * pos * (size - pos), 1)
        best = sorted(score, key=lambda b: (-score[b], b))[: toxicity.KEPT]
        return sorted(b for b in best if score[b] > toxicity.CHI)

    def fit(rows, kept, target):
        x = np.array([[float(b in features[i]) for b in kept] + earlier[i] + [1.0] for i in rows])
        t = np.array([target[i] for i in rows], float)
        share = t.mean()
        weight = np.where(t > 0, 0.5 / share, 0.5 / (1 - share)) / len(rows)
        w, ridge = np.zeros(x.shape[1]), 1e-3 * np.append(np.ones(x.shape[1] - 1), 0)
        for _ in range(60):  # Newton's method, to the optimum
            p = 1 / (1 + np.exp(-x @ w))
            g = x.T @ (weight * (p - t)) + ridge * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12)
            w = w - np.linalg.solve(h, g)
        return w

    prob = lambda i, kept, w: 1 / (1 + np.exp(-(np.array([float(b in features[i]) for b in kept] + earlier[i] + [1.0]) @ w)))
    for target in y:
        kept = chosen(range(n), target)
        w = fit(range(n), kept, target)
        out.append((kept, [prob(i, kept, w) for i in range(n)]))
        late = [0.0] * n
        for f in sorted(set(folds)):
            rows = [i for i in range(n) if folds[i] != f]
            own = chosen(rows, target)
            wf = fit(rows, own, target)
            for i in range(n):
                if folds[i] == f:
                    late[i] = prob(i, own, wf)
        earlier = [e + [p] for e, p in zip(earlier, late)]
    return out


def test_chain_against_plain_python(monkeypatch):
    rng = np.random.default_rng(8)
    n = 160
    y = [[int(rng.random() < 0.4) for _ in range(n)]]
    y.append([int(rng.random() < (0.7 if a else 0.15)) for a in y[0]])
    features = [{int(b) for b in range(30) if rng.random() < (0.15 + 0.4 * (b % 3 == 0) * y[b % 2][i])} for i in range(n)]
    folds = [i % toxicity.FOLDS for i in range(n)]
    texts = np.concatenate([np.full(len(f), i) for i, f in enumerate(features)]).astype(int)
    buckets = np.concatenate([sorted(f) for f in features]).astype(int)
    chain = toxicity.fit_chain(texts, buckets, {"a": np.array(y[0], np.float32), "b": np.array(y[1], np.float32)}, np.array(folds))
    want = plain_chain(features, y, folds)
    for link, (kept, _) in zip(chain, want):
        assert link.kept.tolist() == kept
    p_first = [1 / (1 + np.exp(-(sum(w for b, w in zip(chain[0].kept, chain[0].weights) if b in f) + chain[0].bias))) for f in features]
    assert max(abs(a - b) for a, b in zip(p_first, want[0][1])) < 0.02 and chain[1].earlier.shape == (1,) and chain[1].earlier[0] > 0


def test_repeated_ids_train_alike(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    for rows in (docs, docs.orderBy(F.desc("text"))):
        assert {(r["doc_id"], r["text"]) for r in toxicity.sample(rows, labels).collect()} == {(1, "a"), (2, "c")}


@pytest.mark.parametrize("unset", [True])
def test_a_cluster_without_shared_folder_is_refused(unset):
    from sextant.sources.shared import shared_folder

    class Nothing:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Nothing)
