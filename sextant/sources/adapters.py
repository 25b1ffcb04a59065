"""Market relations made from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, session, open, high, low, close, volume: line items as trades of a symbol per shipping day.

    One aggregation by (symbol, session); open and close are the prices at the smallest and largest trade key.
    """
    li = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    t = li.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("session"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", key.alias("k"))
    return t.groupBy("symbol", "session").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"))


def bars_intraday(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """symbol, bar_start, open, high, low, close, n: events as ticks, in buckets of so many minutes."""
    e = table(spark, sf_dir, "events")
    key = F.struct("ts", "event_id")
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / (60 * minutes)) * (60 * minutes))
    return e.groupBy(F.col("event_type").alias("symbol"), start.alias("bar_start")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).alias("n"))


def corporate_actions(bars: DataFrame) -> DataFrame:
    """symbol, ex_date, action, value: by rule, every 63rd bar pays a dividend of 1 and every 500th splits two for one."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("session"))
    numbered = bars.select("symbol", "session", n.alias("n"))
    dividend = numbered.where(F.col("n") % 63 == 0).select("symbol", F.col("session").alias("ex_date"), F.lit("dividend").alias("action"), F.lit(1.0).alias("value"))
    split = numbered.where(F.col("n") % 500 == 0).select("symbol", F.col("session").alias("ex_date"), F.lit("split").alias("action"), F.lit(2.0).alias("value"))
    return dividend.unionByName(split)


def macro_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, observation_date, available_at, value, seq: orders as releases of a monthly series by priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("observation_date"),
        F.col("o_orderdate").cast("timestamp").alias("available_at"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))


def identifier_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, id_value, valid_from, valid_to (closed): the span of a user's events of a type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("security_id"), F.col("event_type").alias("id_value")).agg(
        F.to_date(F.min("ts")).alias("valid_from"), F.to_date(F.max("ts")).alias("valid_to"))


def strategy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, part_key, entry, ret: line items as trades that earn discount minus tax."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("entry"), (F.col("l_discount") - F.col("l_tax")).alias("ret"))


#: The same relations as DuckDB SQL (common table expressions).
BARS_SQL = """
trades0 AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::DATE AS session, l_extendedprice / l_quantity AS p, l_quantity,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
bars AS (SELECT symbol, session, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM trades0 GROUP BY symbol, session)"""
ACTIONS_SQL = BARS_SQL + """,
numbered AS (SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM bars),
actions AS (
  SELECT symbol, session AS ex_date, 'dividend' AS action, 1.0::DOUBLE AS value FROM numbered WHERE n % 63 = 0
  UNION ALL SELECT symbol, session, 'split', 2.0::DOUBLE FROM numbered WHERE n % 500 = 0)"""
PANEL_SQL = ACTIONS_SQL + """,
spine AS (SELECT s.session, y.symbol FROM (SELECT DISTINCT session FROM bars) s CROSS JOIN (SELECT DISTINCT symbol FROM bars) y),
acts AS (SELECT symbol, ex_date, product(CASE WHEN action = 'split' THEN value ELSE 1.0 END) AS ratio,
  sum(CASE WHEN action = 'dividend' THEN value ELSE 0.0 END) AS div FROM actions GROUP BY symbol, ex_date),
dense AS (
  SELECT p.session, p.symbol, b.open AS raw_open, b.high AS raw_high, b.low AS raw_low, b.close AS raw_close, b.volume AS raw_volume,
    coalesce(a.ratio, 1.0) AS split_ratio, coalesce(a.div, 0.0) AS dividend
  FROM spine p LEFT JOIN bars b USING (session, symbol) LEFT JOIN acts a ON a.symbol = p.symbol AND a.ex_date = p.session),
rets AS (SELECT *, (raw_close * split_ratio + dividend) / last_value(raw_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS ret FROM dense),
tri AS (SELECT *, CASE WHEN raw_close IS NOT NULL THEN
    first_value(raw_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    * product(1 + coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS close,
  product(split_ratio) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_split,
  first_value(split_ratio) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_split FROM rets),
panel AS (SELECT session, symbol, raw_open, raw_high, raw_low, raw_close, raw_volume, split_ratio, dividend, ret, close,
  raw_open * close / raw_close AS open, raw_high * close / raw_close AS high, raw_low * close / raw_close AS low,
  raw_volume * first_split / cum_split AS volume, raw_close * raw_volume AS dollar_volume FROM tri)"""
