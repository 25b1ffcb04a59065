"""The registered queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, langid, language_model, licenses, mixing, pieces, queries_text, spotsigs, toxicity, vectors
from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.digest(docs, crc_mod(docs["doc_id"], langid.FOLDS))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


OP2_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE array_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id) AS n_links, min(r.v) AS component_id, e.vec_id = min(r.v) AS kept
FROM embeddings e JOIN reach r ON r.u = e.vec_id GROUP BY e.vec_id
"""


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, t=0.9)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g
  FROM words, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(len(w) - 2, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
links AS (SELECT a AS u, b AS v FROM near UNION SELECT b, a FROM near),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.v) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.u = d.doc_id GROUP BY d.doc_id
"""


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.digest(docs, crc_mod(docs["doc_id"], language_model.FOLDS))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.predict(docs.select("doc_id", "text"), toxicity.train(docs, labels)).drop("text")


#: The hot source is thinned to a tenth of the mix, the others share the rest evenly.
MIX_WEIGHTS, MIX_DEFAULT, MIX_SEED = {"src0": 2.0}, 1.0, 11


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_DEFAULT, seed=MIX_SEED)


OP4_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM documents GROUP BY source),
rates AS (SELECT source, (1.0::DOUBLE * sum(n) OVER () * (w / sum(w) OVER ()) / n)::DOUBLE AS rate FROM counts),
pieces AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.PIECE}::DOUBLE))::INT AS m FROM rates),
terms AS (
  SELECT source, 0 AS k, exp(-(rate / m)) AS term, exp(-(rate / m)) AS total FROM pieces
  UNION ALL
  SELECT t.source, k + 1, term * (p.rate / p.m) / (k + 1), total + term * (p.rate / p.m) / (k + 1)
  FROM terms t JOIN pieces p ON t.source IS NOT DISTINCT FROM p.source WHERE k < {mixing.TERMS}),
draws AS (
  SELECT d.doc_id, d.source, (('0x' || substr(md5(concat_ws(':', '{MIX_SEED}', d.doc_id::VARCHAR, i::VARCHAR)), 1, {mixing.DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**mixing.DIGITS)!r} AS u
  FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source, range(0, p.m) r(i)),
copies AS (
  SELECT doc_id, sum((SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM x.source AND t.total < x.u)) AS n FROM draws x GROUP BY doc_id)
SELECT d.*, c.i::INT AS mix_copy, md5(concat_ws(':', '{MIX_SEED}', d.doc_id::VARCHAR, 'place', c.i::VARCHAR)) AS mix_key
FROM documents d JOIN (SELECT doc_id, unnest(range(0, n::BIGINT)) AS i FROM copies) c USING (doc_id)
"""


def piece_model() -> str:
    """The vocabulary file's place: an installed package, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), piece_model())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


#: Turn texts and the loss text follow from the rows alone; the formatted length adds marks and escapes.
OP8_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (
  SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
    + (length(text) - length(replace(text, '<|', ''))) // 2 AS escaped FROM rows),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(12 + length(role) + 1 + escaped + 11) AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars FROM said
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_LONGEST = max(len(text.split()) for _, text in licenses.TEMPLATES)
_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(licenses.TEMPLATES))
_BASE = ", ".join(f"CASE WHEN contains(norm, ' {p} ') THEN '{label}' END" for p, label in licenses.PHRASES.items())
OP9_SQL = rf"""
WITH spaced AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS words FROM documents),
n AS (SELECT doc_id, CASE WHEN words = '' THEN ' ' ELSE ' ' || words || ' ' END AS norm, CASE WHEN words = '' THEN []::VARCHAR[] ELSE string_split(words, ' ') END AS w FROM spaced),
places AS (
  SELECT doc_id, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM n)
  WHERE array_to_string(w[i:i + 3], ' ') IN ('under the mit license', 'apache license version 2') OR array_to_string(w[i:i + 2], ' ') = 'cc by nc'),
found AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, list_distinct(w[(k * {_LONGEST} + 1):((k + 2) * {_LONGEST})]) AS b
  FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {_LONGEST}) / {_LONGEST}.0)::BIGINT) + 1)) AS k FROM n)),
templates AS (
  SELECT label, list_distinct(string_split(t, ' ')) AS t, list_intersect(list_distinct(string_split(t, ' ')), {sorted(licenses.TELLING)}) AS telling FROM (VALUES {_TEMPLATES}) v(tid, label, t)),
matched AS (
  SELECT doc_id, label, len(list_intersect(b, t))::DOUBLE / len(t) AS containment FROM blocks, templates
  WHERE len(list_intersect(b, t)) >= ceil(round({licenses.THRESHOLD} * len(t), 9)) AND len(list_intersect(b, telling)) = len(telling)),
best AS (SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS best FROM matched GROUP BY doc_id),
based AS (SELECT *, list_sort(list_distinct(list_filter([{_BASE}], lambda x: x IS NOT NULL))) AS base FROM n)
SELECT b.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, []::VARCHAR[])))), ',') AS labels,
  greatest(CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM based b LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_langid": op1_langid,
    "op4_mixing": op4_mixing,
    "op2_vectors": op2_vectors,
    "op3_pieces": op3_pieces,
    "op5_jaccard": op5_jaccard,
    "op6_language_model": op6_language_model,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_licenses": op9_licenses,
    "op10_spotsigs": op10_spotsigs,
} | queries_text.QUERIES
ORACLE_SQL = {"op2_vectors": OP2_SQL, "op4_mixing": OP4_SQL, "op5_jaccard": OP5_SQL, "op8_chat": OP8_SQL, "op9_licenses": OP9_SQL} | queries_text.ORACLE_SQL
