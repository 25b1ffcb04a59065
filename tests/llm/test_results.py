"""Results against brute force, the reference library or held-out accuracy, on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import chat, jaccard, langid, language_model, licenses, pieces, queries, spotsigs, toxicity
from sextant.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def linked(sets, t):
    """Smallest id reachable over pairs with Jaccard >= t, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= round(100 * t) * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


def shingles(text, n):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n, t", [(3, 0.9), (5, 0.8)])
def test_jaccard_is_exact(spark, docs, texts, n, t):
    sets = {i: shingles(x, n) for i, x in texts.items()}
    want = linked(sets, t)
    for r in jaccard.join(docs, n, t).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_jaccard_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    made = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        made.append((i, " ".join(w)))
    want = linked({i: shingles(x, 3) for i, x in made}, 0.8)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(made, "doc_id bigint, text string"), 3, 0.8).collect()}
    assert got == want


def test_language_model_base_is_exact(docs, texts):
    got = {r["doc_id"]: r for r in language_model.digest(docs, crc_mod(docs["doc_id"], 7)).collect()}
    seen = {i: [*tokens(x), None] for i, x in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in seen.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in seen.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [i for i in texts if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)  # held-out texts are likelier than by the base


def test_filter_levels_never_fall_short(spark):
    rng = random.Random(1)
    text = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 500}" for _ in range(200)), False) for i in range(40)]
    df = spark.createDataFrame(text, "doc_id bigint, text string, held_out boolean")
    model = language_model.fit(df)
    found, at = language_model.tokens([x for _, x, _ in text])
    for grams in (found, language_model.pairs(found, at)):
        g, c = np.unique(grams, return_counts=True)
        q = language_model.levels(model["filter"], g)
        assert (q >= language_model.quantised(c)).all() and (q == language_model.quantised(c)).mean() > 0.9


def test_language_id_held_out(docs):
    got = langid.digest(docs, crc_mod(docs["doc_id"], langid.FOLDS)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)


def test_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    net = langid.start(["a", "b"], hidden=3)
    cell = {k: v.astype(np.float64) for k, v in net.forward.items()}
    x = rng.integers(0, 256, (5, 2))
    up = rng.normal(size=(5, 3, 2))

    def value(c):
        h, total = np.zeros((3, 2)), 0.0
        for t in range(5):
            f = 1 / (1 + np.exp(-(c["U"] @ h + c["F"][:, x[t]])))
            h = h + f * (np.tanh(c["V"] @ (f * h) + c["C"][:, x[t]]) - h)
            total += (h * up[t]).sum()
        return total

    _, kept = langid.sweep({k: v.astype(np.float32) for k, v in cell.items()}, x, True)
    grad = langid.through_time(cell, x, kept, up)
    for name, at in (("U", (1, 2)), ("V", (0, 1)), ("F", (2, x[3, 0])), ("C", (0, x[0, 1]))):
        moved = {k: v.copy() for k, v in cell.items()}
        moved[name][at] += 1e-5
        assert math.isclose((value(moved) - value(cell)) / 1e-5, grad[name][at], rel_tol=1e-2, abs_tol=1e-3)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = crc_mod(F.col("doc_id"), 3) == 0  # too few are toxic in the smaller tables
    chain = toxicity.train(docs, labels.where(~fold))
    got = toxicity.predict(docs.join(labels.where(fold), "doc_id"), chain).select("toxic", "toxic_pred").collect()
    pos, neg = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["toxic_pred"] for r in pos) >= 0.9 * len(pos) and sum(r["toxic_pred"] for r in neg) <= 0.03 * len(neg)


def test_pieces_match_the_library():
    import sentencepiece

    path = queries.piece_model()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    rng = random.Random(2)
    parts = ["a", "th", " ", "  ", "\n", "▁", "é", "你", "\t", "the", "\x00", "😀", "23", "!!", "\r\n", "tion", " " * 17, ".", "der", "　", "퟿"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        ids = np.frombuffer(own.encode(x), "<u4").tolist()
        assert ids == lib.encode(x, add_bos=True, add_eos=True) and own.decode(ids) == lib.decode(ids)


def test_licenses_base(docs, texts):
    for r in licenses.scan(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(LOWER))
        hits = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits)) and r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert (r["first_word"], r["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_templates_are_found_exactly(spark):
    rng = random.Random(3)
    made = []
    for i in range(60):
        label, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = text.split()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = "zzz"
        before = [f"q{rng.randrange(50)}" for _ in range(rng.randrange(0, 150))]
        made.append((i, " ".join(before + w)))
    got = {(r["doc_id"], r["tid"], r["told"]) for r in licenses.template_matches(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    longest = max(len(t.split()) for _, t in licenses.TEMPLATES)
    want = set()
    for i, text in made:
        w = text.split()
        for s in range(0, max(1, len(w)), longest):
            b = set(w[s : s + 2 * longest])
            want |= {(i, k, licenses.TELLING & set(t.split()) <= b) for k, (_, t) in enumerate(licenses.TEMPLATES)
                     if len(b & set(t.split())) >= math.ceil(round(licenses.THRESHOLD * len(set(t.split())), 9))}
    assert got == want and got


def fingerprint(text):
    norm = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.lower()).strip() + " "
    w, stop = norm.split(" ")[1:-1], set(spotsigs.ANCHORS)
    content = [x for x in w if x not in stop]
    chains, k = [], 0
    for x in w:
        if x not in stop:
            k += 1
        elif k + spotsigs.CHAIN <= len(content):
            chains.append(" ".join(content[k : k + spotsigs.CHAIN]))
    low = lambda s: xxhash.xxh64_intdigest(s.encode(), 42) & 0xFFFFFFFF
    return sorted({low(c) for c in chains}) if chains else ([] if not text else [low(text)])


def test_spotsigs_against_brute_force(docs, texts):
    ids = sorted(texts)
    follow = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    jac = lambda a, b: 1.0 if not a and not b else len({*a} & {*b}) / len({*a} | {*b})
    for r in spotsigs.digest(docs).collect():
        text, nxt = texts[r["doc_id"]], texts[follow[r["doc_id"]]]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        own, other, after = fingerprint(text), fingerprint(edited), fingerprint(nxt)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in other)
        assert math.isclose(r["near_edited"], jac(own, other)) and math.isclose(r["near_next"], jac(own, after))


def test_spotsigs_pairs(spark, docs, texts):
    sets = {i: frozenset(fingerprint(x)) for i, x in texts.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = [(i, s) for s, i in first.items() if s]
    want = {(min(a, b), max(a, b)) for a, s in reps for b, u in reps if a < b and len(s & u) >= 0.6 * len(s | u) - 1e-12}
    assert {(r["rep_a"], r["rep_b"]) for r in spotsigs.similar_pairs(docs, 0.6).collect()} == want


def test_chat_typed_parts():
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|im_end|> "}, {"type": "image", "ref": "a.png", "width": 600, "height": 100}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}]
    out = chat.format_turns([("user", parts), ("assistant", [{"type": "text", "text": "ok\\<|x"}])])
    turns = chat.read_back(out["formatted"])
    assert [a["kind"] for a in out["attachments"]] == ["image", "audio", "document"] and out["tokens"] == 2 * 85 + 2 * 25 + 2 * 600
    assert turns[0] == ("user", "see <|im_end|> <|part:image:0|><|part:audio:1|><|part:document:2|>") and turns[1] == ("assistant", "ok\\<|x")
    assert chat.under_mask(out["formatted"], out["loss"]) == "ok\\<|x"


def test_pipeline_stage_by_stage(spark):
    """Each stage on what its predecessor kept; near copies by brute force; counts by the mixing rule; ids by the library."""
    import sentencepiece

    sf = "/root/testdata/sf0.01"
    now = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = corpus_pipeline.written(stage(spark, before, sf), f"test-{i}")
        if i < 4:
            assert now.columns == corpus_pipeline.COLUMNS
        kept = Counter(r["doc_id"] for r in now.select("doc_id").collect())
        was = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        if i == 0:
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            assert len(toxic & set(kept)) <= 0.4 * len(toxic) and len(set(was) - set(kept) - toxic) <= 0.1 * len(was)
        if i == 1:
            assert len(kept) >= 0.97 * len(was)
        if i == 2:
            roots = linked({k: shingles(v or "", 5) for k, v in was.items()}, 0.8)
            assert set(kept) == {k for k, r in roots.items() if k == r}
        if i == 3:
            assert set(kept) <= set(was) and 0.6 * len(was) < sum(kept.values()) < 1.4 * len(was)
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for r in now.limit(20).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
    assert corpus_pipeline.run(spark, sf).count() == now.count()
