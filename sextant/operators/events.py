"""Event studies: abnormal returns around events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol
from .panel import with_market


def abnormal_returns(panel: DataFrame, events: DataFrame, market: str, pre: int = 5, post: int = 20, estimation: int = 120, gap: int = 10) -> DataFrame:
    """symbol, event_pos, rel_day, ar: return minus beta times the market's, for events whose whole window is there.

    Sessions are numbered by symbol and events meet their windows by an equi join on symbol and an offset exploded per
    event (a fixed number of rows for each event), not by a range join.
    """
    p = with_market(panel, market).withColumn("pos", F.row_number().over(by_symbol())).select("symbol", "session", "pos", "ret", "market_ret")
    e = p.join(events.select("symbol", "session").distinct(), ["symbol", "session"]).select("symbol", F.col("pos").alias("event_pos"))
    rel = e.select("symbol", "event_pos", F.explode(F.sequence(F.lit(-pre - gap - estimation), F.lit(post))).alias("rel_day")).withColumn("pos", F.col("event_pos") + F.col("rel_day"))
    j = rel.join(p.drop("session"), ["symbol", "pos"])
    both = F.col("ret").isNotNull() & F.col("market_ret").isNotNull()
    early = both & (F.col("rel_day") < -pre - gap)
    x, m = F.when(early, F.col("ret")), F.when(early, F.col("market_ret"))
    per_event = Window.partitionBy("symbol", "event_pos")
    beta = F.when(F.count(x).over(per_event) >= estimation // 2, F.covar_samp(x, m).over(per_event) / F.var_samp(m).over(per_event))
    ar = j.withColumn("beta", beta).where(F.col("rel_day") >= -pre).withColumn("ar", F.col("ret") - F.col("beta") * F.col("market_ret"))
    full = F.count("ar").over(per_event) == pre + post + 1
    return ar.withColumn("_full", full).where("_full").select("symbol", "event_pos", "rel_day", "ar")


def event_study(panel: DataFrame, events: DataFrame, market: str, **how) -> DataFrame:
    """rel_day, n, mean_ar, car: the mean abnormal return of each day and its running sum (one row per day)."""
    days = abnormal_returns(panel, events, market, **how).groupBy("rel_day").agg(F.count(F.lit(1)).alias("n"), F.avg("ar").alias("mean_ar"))
    return days.withColumn("car", F.sum("mean_ar").over(Window.orderBy("rel_day").rowsBetween(Window.unboundedPreceding, 0)))
