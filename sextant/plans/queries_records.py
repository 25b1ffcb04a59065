"""Queries: the SQL surface, record search, counts, changes and eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..sources.adapters import table
from .catalogue import Catalogue

Q = Catalogue()

_SURFACE = """SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice) / 1000, 2) AS value_k
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 HAVING count(*) > 1"""


@Q.query(_SURFACE)
def sql_surface(spark, sf_dir):
    """SQL over named views of stored tables, as it stands."""
    for name in ("customer", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_SURFACE)


@Q.query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring') OR contains(lower(p_name || ' ' || p_brand), 'brand#1')")
def record_search(spark, sf_dir):
    return records.search(table(spark, sf_dir, "part"), ["p_name", "p_brand"], ["RING", "Brand#1"]).select("p_partkey", "p_name")


@Q.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def registry_find(spark, sf_dir):
    return records.find(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "o_orderkey").select("o_orderkey", "o_totalprice")


@Q.query("""SELECT 'status' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY 2""")
def record_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return records.counts(o, ["status", "priority", "year"])


@Q.query("""SELECT 'orders' AS source, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' UNION ALL SELECT 'lines', l_orderkey::VARCHAR FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-06-01'""")
def changes_since(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    early = records.changes_since({"orders": (o, "o_orderkey", "o_orderdate")}, F.lit("1998-06-01").cast("timestamp"))
    late = records.changes_since({"lines": (li, "l_orderkey", "l_shipdate")}, F.lit("2001-06-01").cast("timestamp"))
    return early.unionByName(late).select("source", "id")


@Q.query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_dig(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", records.dig(F.col("props"), "k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@Q.query("""WITH f AS (SELECT l_suppkey AS supp, l_shipdate::DATE AS entry, l_shipdate::DATE + 3 AS exit, l_discount - l_tax AS net, l_tax / 100 AS slippage FROM lineitem WHERE l_orderkey % 20 = 0),
h AS (SELECT l_suppkey AS supp, avg(l_discount - l_tax) AS hm, stddev_samp(l_discount - l_tax) AS hs FROM lineitem WHERE l_orderkey % 20 <> 0 GROUP BY 1),
g AS (SELECT supp, count(*) AS n, avg(net) AS m, avg(slippage) AS s, min(entry) AS a, max(exit) AS b, sum(net) AS t FROM f GROUP BY 1),
d AS (SELECT *, (SELECT count(*) FROM range(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY) r(x) WHERE dayofweek(x) BETWEEN 1 AND 5) AS days FROM g)
SELECT supp, n, days::INT AS days, n >= 20 AND days >= 60 AND t > 1e-9 AND coalesce(m >= hm - 2 * hs / sqrt(n), false) AND s <= 0.000601 AS eligible FROM d LEFT JOIN h USING (supp)""")
def live_eligibility(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", F.col("l_suppkey").alias("supp"), F.to_date("l_shipdate").alias("entry"), F.date_add(F.to_date("l_shipdate"), 3).alias("exit"), (F.col("l_discount") - F.col("l_tax")).alias("net"), (F.col("l_tax") / 100).alias("slippage"))
    past = rows.where("l_orderkey % 20 <> 0").groupBy("supp").agg(F.avg("net").alias("hist_mean"), F.stddev_samp("net").alias("hist_sd"))
    return records.eligibility(rows.where("l_orderkey % 20 = 0"), past, "supp", 0.000601 / 1.5).select("supp", "n", "days", "eligible")
