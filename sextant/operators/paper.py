"""Orders with the quotes that held when they came."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def with_quotes(orders: DataFrame, quotes: DataFrame, by: list[str]) -> DataFrame:
    """orders (by, order_id, at, ..) with bid, ask and quote_at of the latest quote (by, at, bid, ask) not after them."""
    q = quotes.select(*by, F.col("at").alias("_at"), F.struct("bid", "ask", F.col("at").alias("quote_at")).alias("_q"))
    o = orders.select("*", F.col("at").alias("_at"))
    both = o.unionByName(q, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", F.col("_q").isNull(), "order_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_q", ignorenulls=True).over(w)).where("order_id IS NOT NULL").select(*[c for c in orders.columns], "_last.*")


