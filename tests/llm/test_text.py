"""Fill-in-middle, collocations and decontamination against brute force; edge cases; exact ids."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import collocations, fim, jaccard, langid, language_model, pieces, queries, toxicity, winnow

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string"
#: Beyond what a double holds exactly.
BIG = 2**53 + 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle


def test_cuts_fall_at_token_borders():
    rng = random.Random(1)
    alphabet = ["a", "b", "é", "漢", "😀", " ", "\t", "\n", "x", " ", "\u0085"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 50, 700, 6000]))) for _ in range(120)]
    texts += ["漢" * 5000, " " * 5000, "a" * 9000 + " ", "ab " * 4000, "a" * 20000]
    texts += texts[:50]
    cutter = fim.Cutter()
    for text, cuts in zip(texts, cutter.batch([t.encode() for t in texts])):
        units = TOKEN.findall(text)
        assert cuts.n == len(units)
        for k in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(4))}:
            assert cuts.cut(k) - cuts.starts[0] == len("".join(units[:k]).encode())
    assert cutter.summaries.hits > 100  # repeated texts come from the memo


def test_a_kept_summary_is_used_only_for_the_same_content():
    s = fim.Summaries(most=64)
    assert s.of(7, b"one two") == (2, True, True) and s.of(7, b" other ") == (1, False, False)
    for i in range(40):
        s.of(i, b"word " * 4)
    assert s.held <= 64 and len(s.kept) <= 3


def expected_fim(doc_id, text, seed=42):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def test_fim_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_fim"](spark, SF).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:] == expected_fim(r["doc_id"], docs[r["doc_id"]]) for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fim_edges(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(999)}" for _ in range(60_000))
    rows = [(BIG, "ein Wort < P> <"), (None, "kein Name"), (-4, None), (5, ""), (6, "a <S> b"), (7, " \n "), (8, "x"), (8, "x"), (9, long), (10, "é漢 😀 z" * 50), (BIG + 1, "<P" * 30)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], f"{SCHEMA}, form string, n double")
    got = Counter(tuple(r) for r in fim.digest(df).collect())
    assert got == Counter((i, *expected_fim(i, t)) for i, t in rows)
    assert fim.digest(df.where("false")).count() == 0


# --- collocations


def expected_phrases(rows, least, top=2000):
    by, out = defaultdict(list), []
    for lang, text in rows:
        by[lang or "und"].append(text or "")
    for lang, texts in by.items():
        c = Counter()
        for t in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(LOWER)):
                w = re.findall(r"[^\x20\x09]+", piece)
                for n in range(1, 6):
                    c.update(zip(*[w[i:] for i in range(n)]))
        total = sum(v for k, v in c.items() if len(k) == 1)
        chosen = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        held = {k[i:j] for k, v in chosen.items() for i in range(len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) and v >= c[k[i:j]]}
        ranked = []
        for k, a in chosen.items():
            if k not in held:
                score, cut = min((1000 * a * total // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
                ranked.append((-score, -a, " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(3, 2000), (2, 17)])
def test_collocations_are_exact(spark, least, top):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(docs, least, top).collect())
    want = expected_phrases([(r["lang"], r["text"]) for r in docs.collect()], least, top)
    assert len(want) > 60 and got == want


def test_collocations_edges(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 40)  # many shards, so that ranges meet parts from several
    rows = [("en", "To be, or not to be: TO BE or not"), ("en", "to be or not to be"), (None, "to be\tto be; to be"), ("und", "to be"), ("fr", None), ("fr", " .,; "), ("de", "é漢 z y é漢 z y é漢 z y"), ("en", "x " * 300)]
    df = spark.createDataFrame([(r[0], r[1], 1) for r in rows], "lang string, text string, n int").withColumn("doc_id", F.lit(None).cast("bigint"))
    got = sorted(tuple(r) for r in collocations.mine(df, 2).collect())
    assert got == expected_phrases(rows, 2)
    assert collocations.mine(df.where("false"), 2).count() == 0


def test_automata():
    rng = random.Random(2)
    for _ in range(40):
        size = rng.choice([3, 8, 40])
        paths = sorted({tuple(rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 200))})
        rows = np.array([list(p) + [0] * (5 - len(p)) for p in paths], np.int32)
        weight = np.array([rng.randrange(1, 4) for _ in paths], np.int64)
        words = [b"w%03d" % i for i in range(size)]
        a = collocations.Automaton.read(*collocations.Automaton.build(words, rows, weight).columns())
        back, counted = collocations.summed(*a.paths())
        assert (back == rows).all() and (counted == weight).all()
        asked = np.array([[rng.choice([-1, *range(1, size + 1)]) for _ in range(5)] for _ in range(60)], np.int32)
        for row in asked:
            row[rng.randrange(1, 6) :] = 0
        known = {tuple(r): w for r, w in zip(rows.tolist(), weight.tolist())}
        assert a.compose(asked).tolist() == [known.get(tuple(r), 0) for r in asked.tolist()]
        twice, doubled = collocations.united([a, a], 4).paths()
        assert sorted(doubled.tolist()) == sorted(2 * w for w in weight.tolist() if 2 * w >= 4)


def test_equal_subtrees_are_one_state():
    rows = np.array([[a, 3, 4, b, 0] for a in (1, 2) for b in (5, 6)], np.int32)
    a = collocations.Automaton.build([b"%d" % i for i in range(6)], rows, np.ones(4, np.int64))
    assert len(a.label) == 2 + 1 + 1 + 2  # both beginnings lead to the same state


# --- decontamination


def expected_hits(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = Counter()
    for doc, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if held := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= held
        out[doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)] += 1
    return out


def test_decontamination_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in queries.QUERIES["op13_winnowing"](spark, SF).collect())
    assert got == expected_hits(docs, items)


@pytest.mark.parametrize("broadcast", [winnow.BROADCAST, 0])
def test_decontamination_edges(spark, monkeypatch, broadcast):
    monkeypatch.setattr(winnow, "BROADCAST", broadcast)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, draw(rng.choice([10, 12, 25]))) for i in range(12)] + [(20, "w1 w2"), (21, "W3"), (22, "été naïf"), (23, None), (24, " ... "), (None, draw(11)), (25, "same " * 12), (9, draw(30)), (9, draw(14))]
    docs = [(i, draw(rng.choice([0, 1, 5, 9, 10, 40]))) for i in range(25)]
    docs += [(100 + i, f"{draw(8)}. {items[i % 12][1].upper()}, {draw(3)}") for i in range(20)]
    docs += [(BIG, "ÉTÉ été NAÏF naïf"), (None, items[0][1]), (None, items[0][1]), (-1, None), (7, items[1][1]), (7, "other"), (200, "same " * 40), (201, draw(30_000))]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], f"{SCHEMA}, h string, n int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, size int")
    assert Counter(tuple(r) for r in winnow.decontaminate(d, b).collect()) == expected_hits(docs, items)
    none = Counter(tuple(r) for r in winnow.decontaminate(d, b.where("false")).collect())
    assert none == expected_hits(docs, []) and winnow.decontaminate(d.where("false"), b).count() == 0


@pytest.mark.parametrize("broadcast", [winnow.BROADCAST, 0])
def test_hits_at_the_start_count_all_their_words(spark, monkeypatch, broadcast):
    monkeypatch.setattr(winnow, "BROADCAST", broadcast)
    passage = [f"w{i}" for i in range(14)]
    docs = [(at, " ".join([f"x{i}" for i in range(at)] + passage[:length] + ["end"])) for length in (10, 14) for at in range(12)]
    docs = [(i, text) for i, (_, text) in enumerate(docs)] + [(100, " ".join(passage[3:13] + passage[:10]))]
    items = [("a", " ".join(passage)), ("b", None), ("c", "")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    assert Counter(tuple(r) for r in winnow.decontaminate(d, b).collect()) == expected_hits(docs, items)


# --- ids of every operator on texts


def test_large_and_missing_ids_stay_exact(spark):
    rows = [(BIG, "the cat sat on the mat with the dog", "en", 2**60 + 1), (None, "le chat est sur la table avec le chien", "fr", None), (-7, "der Hund ist auf dem Tisch", "de", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, more bigint").coalesce(1)
    want = {(BIG, 2**60 + 1), (None, None), (-7, 3)}
    ids = {BIG, None, -7}
    for out in (langid.predict(df, None), pieces.encode_decode(df, queries.piece_model()), toxicity.predict(df, toxicity.train(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")))):
        assert {(r["doc_id"], r["more"]) for r in out.select("doc_id", "more").collect()} == want
    assert {r["doc_id"] for r in jaccard.join(df, 3, 0.9).collect()} == ids == {r["component_id"] for r in jaccard.join(df, 3, 0.9).collect()}
    for bound in (language_model.MOST_BITS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(language_model, "MOST_BITS", bound)
            assert {r["doc_id"] for r in language_model.digest(df, F.lit(1)).collect()} == ids
