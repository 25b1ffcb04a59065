"""The pipeline's stages on awkward documents: nulls, empty and long texts, ties, repeated rows, an empty table, clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm.common import written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BIG = 2**53 + 1


def awkward():
    rng = random.Random(1)
    words = {"en": "the cat and dog of house with river that was for it on hill".split(), "fr": "le chat et chien de maison avec fleuve que dans il pour sur mont".split()}
    made = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rng.choice(words[lang]) for _ in range(40 + i))
        made.append((BIG + i, text, lang, f"src{i % 3}", len(text)))
    copy = made[5]
    made += [(BIG + 200, copy[1], "en", "src1", copy[4]), (BIG + 201, copy[1] + " end", "en", None, 1), copy, copy]
    made += [(None, made[7][1] + " more of it", "en", "src0", None), (-3, None, None, None, None), (4, "", "en", "src0", 0), (5, " .. 12 ", "en", "src0", 7)]
    long = " ".join(rng.choice(words["en"]) for _ in range(40_000))
    return [*made, (6, long, "en", "src2", len(long))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, "clash", 7, True) for r in awkward()], f"{SCHEMA}, score string, n_tokens int, toxic_pred boolean")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(BIG + i, i % 2, int(i % 11 == 0)) for i in range(60)] + [(None, 1, 1), (999, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_what_they_must(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = written(stages["toxicity"](spark, docs, folder), "case")
    assert clean.columns == corpus_pipeline.COLUMNS
    kept = Counter(r["doc_id"] for r in clean.select("doc_id").collect())
    assert kept[-3] == kept[4] == 1 and kept[BIG + 5] in (0, 3)  # equal rows share their fate; nothing in a null text is toxic

    named = written(stages["language ID"](spark, clean, folder), "case")
    ids = {r["doc_id"] for r in named.select("doc_id").collect()}
    assert named.columns == corpus_pipeline.COLUMNS and not ids & {-3, 4, 5} and named.where(~F.col("lang").isin("en", "fr")).isEmpty()
    assert ids <= {r["doc_id"] for r in clean.select("doc_id").collect()}

    single = written(stages["n-gram Jaccard join"](spark, named, folder), "case")
    left = Counter(r["doc_id"] for r in single.select("doc_id").collect())
    assert single.columns == corpus_pipeline.COLUMNS and all(n == 1 for i, n in left.items() if i is not None)
    assert not set(left) & {BIG + 200, BIG + 201} and set(left) <= ids

    mixed = written(stages["mixing sources to target weights"](spark, single, folder), "case")
    assert mixed.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in mixed.select("doc_id").collect()} <= set(left)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    out = stages["SentencePiece encoding and decoding"](spark, mixed, folder).collect()
    assert len(out) == mixed.count() and all(r["n_tokens"] == len(r["ids"]) // 4 > 2 and r["decoded"] == texts[r["doc_id"]] for r in out)


def test_an_empty_table_passes_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
