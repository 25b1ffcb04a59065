"""The registered queries of fill-in-middle, collocations and decontamination, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, fim, winnow

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(_read(spark, sf_dir, "documents"))


_WORD = "('0x' || substr(h, {}, 8))::BIGINT"
OP11_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
c AS (
  SELECT *, len(u) AS n, {_WORD.format(1)} % (len(u) + 1) AS x, {_WORD.format(9)} % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_WORD.format(17)} % 100 >= 50 THEN 'plain'
      WHEN {_WORD.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(u[greatest(x, y) + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"), least=100, top=2000)


OP12_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
inside AS (
  SELECT DISTINCT c.lang, s.phrase FROM (
    SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase FROM cand, range(1, 6) x(i), range(1, 6) y(j) WHERE j <= m AND j - i >= 1 AND j - i + 1 < m) c
  JOIN cand s ON s.lang = c.lang AND s.phrase = c.phrase AND 100 * c.a >= 100 * s.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cand c JOIN totals USING (lang), range(1, 5) s(k), f x, f y
  WHERE k < c.m AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM worst WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = worst.lang AND i.phrase = worst.phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
marks AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM marks),
grams AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, pos, g.size, item FROM grams g JOIN marks m ON m.size = g.size AND m.g = g.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT doc_id, pos, size FROM hits)) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN held USING (doc_id)
"""

QUERIES = {"op11_fim": op11_fim, "op12_collocations": op12_collocations, "op13_winnowing": op13_winnowing}
ORACLE_SQL = {"op11_fim": OP11_SQL, "op12_collocations": OP12_SQL, "op13_winnowing": OP13_SQL}
