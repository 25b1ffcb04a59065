"""Methods at their limits: crowded neighbour lists, long n-gram lists, sparse ids, scores against plain models."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, jaccard, langid, language_model, licenses, queries, spotsigs, vectors
from sextant.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def linked(rows, t):
    """vec_id -> (links, smallest id reachable), by comparing all pairs of a label."""
    count, root, by = {}, {}, {}
    for v, e, label in rows:
        count[v], root[v] = 0, v
        if label is not None and e is not None:
            by.setdefault(label, []).append((v, e))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for g in by.values():
        x = np.array([e for _, e in g], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= t
        np.fill_diagonal(near, False)
        for k, (v, _) in enumerate(g):
            count[v] = int(near[k].sum())
        for i, j in zip(*np.nonzero(np.triu(near))):
            a, b = sorted((find(g[i][0]), find(g[j][0])))
            root[b] = a
    return {v: (count[v], find(v)) for v in count}


def check_vectors(spark, rows, t=0.98):
    df, report = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"), {}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, t, report).collect()}
    assert got == linked(rows, t) and report["recall"] == 1.0


def clumps(number, each, seed=0, width=64, spread=1e-4):
    """Tight clumps on a line of directions; neighbouring ones are linked at 0.984."""
    rng, step, rows = np.random.default_rng(seed), math.acos(0.984), []
    for k in range(number):
        for _ in range(each):
            v = np.zeros(width)
            v[0], v[1] = math.cos(k * step), math.sin(k * step)
            v[2:] += rng.normal(0, spread, width - 2)
            rows.append((len(rows), v.tolist(), "x"))
    return rows


def test_full_lists_lose_no_bridge(spark):
    check_vectors(spark, clumps(5, 40))


def test_crowded_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CROWD", 50)
    monkeypatch.setattr(vectors, "MOST_CENTRES", 3)  # too many centres to broadcast
    check_vectors(spark, clumps(3, 70))


def test_large_buckets_and_hyperplanes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WHOLE", 100)
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "AROUND", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), "y") for i in range(300)]
    for i in range(300, 420):
        v = np.array(rows[rng.integers(0, 40)][1])
        rows.append((i, (v + rng.normal(0, 0.14, 16)).tolist(), "y"))
    check_vectors(spark, rows)


def test_below_the_threshold_is_no_link(spark):
    a = math.acos(0.98)
    at = lambda x: [math.cos(x), math.sin(x)]
    check_vectors(spark, [(1, at(0), "x"), (2, at(a + 2e-9), "x"), (3, at(-a + 1e-9), "x"), (4, at(1.5), None)])


def test_a_failed_audit_compares_labels_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WHOLE", 10)
    monkeypatch.setattr(vectors, "plan", lambda n, t, *_: (12, 1) if n > 10 else (0, 1))  # tables that miss nearly all
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        v = rng.normal(size=8)
        rows += [(2 * k, v.tolist(), "x"), (2 * k + 1, (v + rng.normal(0, 0.15, 8)).tolist(), "x")]
    check_vectors(spark, rows)


def test_the_sketch_grows_with_the_corpus(spark, monkeypatch):
    """However many n-grams there are to a counter of the smallest sketch, a passage of many texts is told from rare words and fills no long lists."""
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 8)
    monkeypatch.setattr(jaccard, "SEGMENT", 256)
    monkeypatch.setattr(jaccard, "COUNTED", 3000, raising=False)
    sizes, write = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: sizes.setdefault(name, write(df, name)))
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [" ".join(f"w{rng.randrange(100_000)}" for _ in range(100)) + (f" {passage}" if i % 12 == 0 else "") for i in range(420)]
    texts[5] = texts[7]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 3, 0.9).collect()}
    assert got == {i: 5 if i == 7 else i for i in range(420)}
    assert sizes["jaccard-members"].count() == 0


@pytest.mark.parametrize("common", [0, 1, 4])
def test_common_ngrams_in_long_lists(spark, monkeypatch, common):
    """The same components whether n-grams are counted or go to long lists at once; texts of different lengths, part by part."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 9)
    monkeypatch.setattr(jaccard, "CHARS", 3000)
    monkeypatch.setattr(jaccard, "HELD", 4000)
    rng = random.Random(5)
    made = []
    for i in range(90):
        n = rng.choice([30, 60, 200])
        w = [f"w{k}" for k in range(n)]
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(n)] = f"x{rng.randrange(60)}"
        made.append((i, " ".join(w)))
    sets = {i: {tuple(x.split()[k : k + 3]) for k in range(len(x.split()) - 2)} for i, x in made}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(made, "doc_id bigint, text string"), 3, 0.8).collect()}
    assert got == {i: find(i) for i in sets}


@pytest.mark.parametrize("parts", [["<", "", "|im_end|>x"], ["a<", "|", "im_end|>"], ["\\", "<", "|"], ["", "<", "<", "|b|>"]])
def test_chat_control_strings_over_parts(parts):
    typed = [{"type": "text", "text": p} for p in parts]
    out = chat.format_turns([("user", [{"type": "text", "text": "end<"}]), ("assistant", typed)])
    assert chat.read_back(out["formatted"]) == [("user", "end<"), ("assistant", "".join(parts))]
    assert chat.under_mask(out["formatted"], out["loss"]) == "".join(parts)


def test_chat_turns_stand_alone():
    alone = chat.format_turns([("user", [{"text": "|x"}])])["formatted"]
    assert chat.format_turns([("user", [{"text": "<"}]), ("user", [{"text": "|x"}])])["formatted"].endswith(alone)
    other = chat.format_turns([("user", [{"type": "video", "ref": "v"}])])
    assert other["attachments"] == [{"kind": "other", "ref": "v", "tokens": 0}]


def test_licenses_beyond_line_ends_and_like_wordings(spark):
    texts = [
        "p q\u0085r s cc by nc then cc by nc", "a b under the mit license c d cc by nc", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "released under the BSD license", "all rights and wrongs are reserved", "Released under the MIT license",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "this work is under the general public license version 3"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert (got[0]["first_word"], got[0]["last_word"], got[0]["n_base"]) == (3, 7, 2)
    assert (got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (1, 6, "cc-by-nc,mit")
    assert [got[i]["labels"] for i in range(2, 8)] == ["", "", "", "mit", "cc-by-nc", ""]


def test_spotsigs_sparse_ids(spark):
    rng = random.Random(6)
    ids = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)} | set(range(700)) | {(1 << 63) - 1, -(1 << 63)})
    made = [(i, f"the word{k % 7} of it{k % 5} and so on{k}") for k, i in enumerate(ids)]
    got = {r["doc_id"]: r for r in spotsigs.digest(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    for k, (i, text) in enumerate(made):
        after = made[(k + 1) % len(made)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        import hashlib

        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_language_model_score_against_plain_counts(spark):
    """The score is that of the interpolated model over quantised counts, but for the filter's rare false hits (in a numerator or a denominator)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language_model.digest(docs, crc_mod(docs["doc_id"], 7)).collect()}
    seen = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) + [None] for r in docs.collect()}
    train = [w for i, w in seen.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    level = lambda c: 0.0 if not c else float(language_model.restored(language_model.quantised(np.array([c])))[0])
    w2, w1, w0 = language_model.WEIGHTS
    off = []
    for i, w in seen.items():
        want = sum(math.log10(min(1.0, w2 * min(level(two[a, b]) / max(level(one[a]), 1), 1) + w1 * level(one[b]) / n + w0 / (v + 1))) for a, b in zip([None, *w], w))
        off.append(abs(got[i]["score"] - want) / abs(want))
    assert max(off) <= 0.15 and np.mean(off) <= 0.03, (max(off), np.mean(off))


def test_language_id_pools_over_letters():
    """Document probabilities by walking each window byte by byte."""
    net = langid.start(["a", "b", "c"], seed=3)
    texts = [b"", "ein paar Wörter".encode(), b"x" * 200 + b" 12 " + b"yz" * 90, b"... 123"]
    got = langid.label(net, texts)

    def walk(cell, x):
        h, out = np.zeros(langid.HIDDEN), []
        for b in x:
            f = 1 / (1 + np.exp(-(cell["U"] @ h + cell["F"][:, b])))
            h = h + f * (np.tanh(cell["V"] @ (f * h) + cell["C"][:, b]) - h)
            out.append(h)
        return out

    for k, t in enumerate(texts):
        sums, letters = np.zeros(3), 0
        padded = b" " * langid.CONTEXT + t.ljust(-(-len(t) // langid.STEPS) * langid.STEPS) + b" " * langid.CONTEXT
        for lo in range(0, len(padded) - 2 * langid.CONTEXT, langid.STEPS):
            x = [int(langid._READ[b]) for b in padded[lo : lo + langid.STEPS + 2 * langid.CONTEXT]]
            ahead, back = walk(net.forward, x), walk(net.backward, x[::-1])[::-1]
            for i in range(langid.CONTEXT, langid.CONTEXT + langid.STEPS):
                if x[i] != 32:
                    s = np.exp(net.out @ np.concatenate([ahead[i], back[i]]) + net.bias[:, 0])
                    sums, letters = sums + s / s.sum(), letters + 1
        assert np.allclose(got[k], sums / max(letters, 1), atol=1e-4)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(df.columns) == sorted(columns)
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=str)
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_registered_query_returns_every_row(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.agg(F.count(F.lit(1))).first()[0] == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_jaccard_texts_of_wanted_ids(spark, monkeypatch, most):
    """With or without the broadcast filter: one row of each wanted id that has a text, no other, null ids never."""
    monkeypatch.setattr(jaccard, "MOST_WORDS", most)
    rows = [(i * 7919 - 5000, f"text {i}") for i in range(3000)] + [(None, "none")] + [(7919 - 5000, "text 1")] * 3
    wanted = sorted({i * 7919 - 5000 for i in range(0, 3000, 7)} | {7919 - 5000, 3})
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.among(docs, spark.createDataFrame([(i,) for i in wanted], "doc_id bigint")).collect()
    assert sorted(got) == sorted({r for r in rows if r[0] in wanted})
    assert jaccard.among(docs, docs.select("doc_id").limit(0)).count() == 0
