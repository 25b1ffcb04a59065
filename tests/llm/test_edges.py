"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, jaccard, langid, language_model, licenses, mixing, pieces, queries, spotsigs, toxicity, vectors

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label string, row int, rep string, run string, h string, c int, ids string, mix_copy string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "blue", "stone", "river", "and", "Mountain,", "speaks", "to", "wind", "loser", "a1"]) + rng.choice(["", "", "er", "ing", "x"]) for _ in range(n))


def rows():
    extra = (0.5, "l", 1, "r", "u", "h", 3, "i", "m")
    texts = [None, "", "   ", "12 !! 34", "one", "one two", words(60, 1), words(60, 1), words(60, 2), "under the MIT license", words(30_000, 3), "é ü ñ 你好 😀", "a" * 5000, "\x00\t\n"]
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "s", "t"][i % 3], None, *extra) for i, t in enumerate(texts)]
    return out + [out[6], out[6], (None, "null id text here", "en", "s", None, *extra), (None, None, None, None, None, *extra)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_langid(spark, docs, none):
    net = langid.train(docs, F.lit(True))
    found = langid.predict(docs, net).select("doc_id", "lang_pred", F.col("score").alias("s")).collect()
    assert len(found) == len(rows())
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["s"] == 0 for i in (0, 1, 2, 3, 13))
    assert all(0 <= r["s"] <= 1 for r in found) and by_id[11]["lang_pred"] in ("en", "fr")
    assert langid.predict(none, langid.train(none, F.lit(True))).count() == 0
    assert {r[0] for r in langid.predict(docs, None).select("lang_pred").collect()} == {"und"}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.05], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, None], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0], 1), (13, [1e300, 1e300], 3), (14, [1e-300, 1e-300], 3)]
    df = spark.createDataFrame([(*x, 9, "z") for x in v], "vec_id bigint, embedding array<double>, label int, copies int, root string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *[(i, 0, i, True) for i in range(4, 13)], (13, 1, 13, True), (14, 1, 13, False)]
    assert vectors.near_duplicates(df.where("false")).count() == 0


def brute_force(made, t=0.98):
    """vec_id, n_links, component_id of unit vectors of one label, by comparing all pairs."""
    x = np.array([v for _, v, _ in made])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= t
    root = np.arange(len(x))
    while True:
        lower = np.array([root[row].min() for row in linked])
        if (lower == root).all():
            return {i: (int(linked[i].sum()) - 1, int(root[i])) for i in range(len(x))}
        root = lower


def test_vectors_bridge_between_tight_groups(spark):
    """Two groups of vectors with more than LIST closer neighbours each, joined only by weaker links."""
    rng = np.random.default_rng(2)
    turn = np.arccos(0.983)
    ends = [np.eye(16)[0], np.cos(turn) * np.eye(16)[0] + np.sin(turn) * np.eye(16)[1]]
    made = []
    for end, away in zip(ends, (-1, 1)):
        made.append((len(made), end.tolist(), 1))
        for _ in range(14):  # away from the other end, so that only the two ends are linked
            side = 0.05 * rng.normal(size=16) / 4
            side[:2] = 0
            v = end + side + away * 0.06 * np.array([-np.sin(turn / 2), np.cos(turn / 2), *[0] * 14])
            made.append((len(made), (v / np.linalg.norm(v)).tolist(), 1))
    want = brute_force(made)
    assert set(c for _, c in want.values()) == {0} and want[0][0] == 15
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()} == want


def test_vectors_dense_label_beside_a_far_larger_one(spark, monkeypatch):
    """Links of few common neighbours, in a label whose vectors lie close together, are all found."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(vectors, "BLOCK", 100)  # more than two blocks: by tables, and buckets in blocks
    topic = rng.normal(size=32)
    dense = [topic / np.linalg.norm(topic) + 0.3 * rng.normal(size=32) / 32**0.5 for _ in range(700)]
    dense += [v + 0.17 * np.linalg.norm(v) * rng.normal(size=32) / 32**0.5 for v in dense[:200]]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(dense)], "vec_id bigint, embedding array<double>, label int")
    want = brute_force([(i, v.tolist(), 1) for i, v in enumerate(dense)])
    assert 100 < sum(n > 0 for n, _ in want.values())
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()} == want


def test_vectors_tables_follow_the_label():
    """Every label has tables enough for its own size."""
    for n in (3_000, 100_000, 33_000_000):
        bits, number = vectors.plan(n, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** number <= 1e-6 and n / 2**bits <= 2 * vectors.BUCKET
    assert vectors.plan(64, 0.98) == (0, 1) and vectors.plan(65, 0.98)[0] == 1


def test_pieces(spark, docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = pieces.encode_decode(docs, queries.piece_model()).select("text", "ids", "n_tokens", "decoded").collect()
    assert len(out) == len(rows())
    for r in out:
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == model.decode(ids)
    assert pieces.digest(none, queries.piece_model()).count() == 0


def test_mixing(spark, docs, none):
    out = mixing.mix(docs, {"s": 5.0, None: 2.0, "absent": 3.0}, 1.0, size=3.0, seed=1)
    assert "text" in out.columns and out.where("source = 's'").count() > 0
    assert out.count() == mixing.mix(docs, {"s": 5.0, None: 2.0, "absent": 3.0}, 1.0, size=3.0, seed=1).count()
    same = out.where("doc_id = 6").groupBy("mix_copy").count().collect()
    assert all(r["count"] % 3 == 0 for r in same)  # repeated rows get the same count
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs, {"s": 0.0}, 1.0).where("source = 's'").count() == 0


def test_jaccard(spark, docs, none):
    got = jaccard.join(docs, 3, 0.9).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["component_id"] == 6 and by_id[8]["component_id"] == 8
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (0, 1, 2)) and by_id[4]["n_shingles"] == 1 == by_id[5]["n_shingles"]
    assert by_id[None]["component_id"] is None
    assert jaccard.join(none).count() == 0


def test_language_model(spark, docs, none):
    d = docs.withColumn("held_out", F.lit(False))
    got = language_model.score(d, language_model.fit(d)).collect()
    assert len(got) == len(rows())
    empty = [r for r in got if r["doc_id"] == 0][0]
    assert empty["n_tokens"] == 1 == empty["n_known"] and empty["score"] < 0
    assert language_model.digest(none, F.lit(0)).count() == 0


def test_language_model_filter_grows(spark, docs, monkeypatch):
    """Beyond MOST_BITS the filter is not broadcast, but as large as before and with the same scores."""
    rng = random.Random(5)
    many = spark.createDataFrame([(100 + i, " ".join(f"w{rng.randrange(400_000)}" for _ in range(8000)), i % 7 == 2) for i in range(50)], "doc_id bigint, text string, held_out boolean")
    d = docs.select("doc_id", "text", F.lit(False).alias("held_out")).unionByName(many)

    def scores():
        return sorted(map(tuple, language_model.score(d, language_model.fit(d.where(~F.col("held_out")))).collect()), key=str)

    whole = scores()
    monkeypatch.setattr(language_model, "MOST_BITS", 1 << language_model.SEGMENT_BITS)
    assert scores() == whole and len(whole) == len(rows()) + 50


def test_language_model_levels_end(spark):
    """A full filter, in which every probe hits, still ends."""
    import threading

    done = []
    ended = threading.Thread(target=lambda: done.append(language_model.levels(np.full(1 << 17, 255, np.uint8), np.arange(3, dtype=np.uint64))), daemon=True)
    ended.start()
    ended.join(20)
    assert done and (done[0] == language_model.MOST_LEVELS).all()


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, int(i in (6, 8))) for i in range(14)] + [(6, 0, 0), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    got = toxicity.predict(docs, chain).collect()
    assert len(got) == len(rows()) and all(0 <= r["p_toxic"] <= 1 for r in got)
    assert toxicity.predict(none, chain).count() == 0
    assert not any(r["toxic_pred"] for r in toxicity.predict(docs, toxicity.train(docs, labels.where("false"))).collect())


def test_chat(spark):
    talk = [(1, 0, "user", None, "x"), (1, 1, "assistant", "a<|im_end|>\\b", "x"), (1, 1, "assistant", "a<|im_end|>\\b", "x"), (2, None, None, "", "x"), (None, 3, "assistant", "", "x"), (3, 0, "ro\nle<|", "<", "x")]
    df = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 * len("a<|im_end|>\\b") and got[2]["loss_chars"] == 0 and len(got) == 4
    assert chat.format_conversations(df.where("false")).count() == 0


def test_licenses(spark, docs, none):
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9]["base_labels"] == "mit" and by_id[9]["first_word"] == 0 == by_id[9]["last_word"] and by_id[9]["n_words"] == 4
    assert by_id[0]["n_words"] == 0 == by_id[1]["n_words"] and by_id[0]["first_word"] is None and by_id[0]["labels"] == ""
    assert licenses.scan(none).count() == 0


def test_licenses_unicode_line_ends(spark):
    """Line ends outside ASCII stay in words; phrases before and after them have the right places."""
    text = "one\u0085two three under the MIT license four\u2028five \u2029 cc by nc six"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (12, 2, 2, 8)


def test_spotsigs(spark, docs, none):
    got = spotsigs.digest(docs).collect()
    assert len(got) == len(rows())
    six = [r["fingerprint"] for r in got if r["doc_id"] in (6, 7)]
    assert len(set(six)) == 1
    assert spotsigs.digest(none).count() == 0
    assert spotsigs.similar_pairs(none).count() == 0
