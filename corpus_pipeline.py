"""The corpus pipeline: toxicity, language ID, near duplicates, mixing to target weights, tokenizing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last adds token ids and the decoded text.

Edge cases: null and empty texts are kept by the toxicity stage (nothing in them is toxic) and rejected by language ID
(no language), as are texts without letters; texts are taken whole, however long. Equal rows share their fate, and one row of each id is left by the
third stage, whose rows of one id are taken to hold one text; rows without an id are no copies of others and stay. Ids keep all their digits.
Other columns of documents are dropped by the first stage, whatever their names; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import jaccard, langid, mixing, pieces, toxicity
from sextant.llm.common import written
from sextant.llm.queries import MIX_DEFAULT, MIX_SEED, MIX_WEIGHTS, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this score (hardly above a guess among four), or without a letter, a document is rejected.
LANGUAGE_SCORE = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic probability is below the threshold; trained on the labels of this stage's documents."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.predict(docs, chain).where(~toxicity.rejected(F.col("toxic_pred"))).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; `lang` becomes the predicted one."""
    net = langid.train(docs, F.lit(True))
    kept = langid.predict(docs, net).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-grams, Jaccard >= 0.8): the one with the smallest id (one row of each id; rows without id stay)."""
    found = jaccard.join(docs, n=5, t=0.8)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])  # both by doc_id: texts are shuffled once
    return kept.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights and shuffled globally."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_DEFAULT, seed=MIX_SEED).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit), n_tokens, decoded."""
    return pieces.encode_decode(docs, piece_model()).select("doc_id", "lang", "source", "ids", "n_tokens", "decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: Learned models are no SQL: tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; every stage's result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs
