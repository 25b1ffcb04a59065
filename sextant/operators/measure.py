"""Measurements of a market series, and the walk-forward choice between parameter sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, ratio
from .metrics import sharpe
from .panel import realized_variance_forward


def variance_premium(panel: DataFrame, implied: DataFrame, h: int = 21, least: int = 250) -> DataFrame:
    """symbol, n, mean, sd, p05, p95, share_positive of implied variance less the realised variance after it.

    implied: session, symbol, iv (as a fraction). NULLs below `least` sessions.
    """
    p = panel.withColumn("_rv", realized_variance_forward(h)).join(implied.select("session", "symbol", "iv"), ["session", "symbol"])
    d = p.withColumn("_d", F.col("iv") * F.col("iv") - F.col("_rv")).where("_d IS NOT NULL")
    n = F.count(F.lit(1))
    keep = lambda c: F.when(n >= least, c)
    return d.groupBy("symbol").agg(n.alias("n"), keep(F.avg("_d")).alias("mean"), keep(F.stddev_samp("_d")).alias("sd"), keep(F.expr("percentile(_d, 0.05)")).alias("p05"), keep(F.expr("percentile(_d, 0.95)")).alias("p95"), keep(F.avg((F.col("_d") > 0).cast("double"))).alias("share_positive"))


def conditional_forward(panel: DataFrame, state, h: int = 21, least: int = 30) -> DataFrame:
    """symbol, on, n, mean, sd, episodes: forward returns over h sessions while a condition holds and while it does not.

    An episode begins where the condition begins to hold. NULL means below `least` rows.
    """
    w = by_symbol()
    p = panel.withColumns({"_on": F.coalesce(state, F.lit(False)), "_f": F.lead("close", h).over(w) / F.col("close") - 1})
    p = p.withColumn("_start", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    n = F.count("_f")
    return p.groupBy("symbol", F.col("_on").alias("on")).agg(n.alias("n"), F.when(n >= least, F.avg("_f")).alias("mean"), F.when(n >= least, F.stddev_samp("_f")).alias("sd"), F.sum("_start").alias("episodes"))


def walk_forward_choice(daily: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, param, train_sharpe, n, oos_mean: in each fold the parameter with the best training Sharpe (ties: the first), out of sample.

    daily: param, session, ret for every declared parameter. The fold table is a handful of rows; each day meets the
    folds it trains or tests by a broadcast of it.
    """
    few = F.broadcast(folds)
    train = daily.join(few, daily["session"].between(F.col("train_from"), F.col("train_to"))).groupBy("fold", "param").agg(sharpe(F.col("ret")).alias("train_sharpe"))
    best = train.withColumn("_n", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc_nulls_last("train_sharpe"), "param"))).where("_n = 1").drop("_n")
    test = daily.join(few, daily["session"].between(F.col("test_from"), F.col("test_to"))).join(best, ["fold", "param"])
    return test.groupBy("fold", "param", "train_sharpe").agg(F.count("ret").alias("n"), F.avg("ret").alias("oos_mean"))


def excess_over(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """param, n, annual_excess, information: daily returns less the benchmark's (session, bench)."""
    d = daily.join(benchmark, "session").withColumn("_e", F.col("ret") - F.col("bench"))
    return d.groupBy("param").agg(F.count("_e").alias("n"), (F.avg("_e") * 252).alias("annual_excess"), (ratio(F.avg("_e"), F.stddev_samp("_e")) * F.sqrt(F.lit(252.0))).alias("information"))


def capacity(trades: DataFrame, by: list[str], capitals: list[float], slots: int = 5, most: float = 0.01) -> DataFrame:
    """by, capital, n, median_participation, share_affordable, share_feasible: what a level of capital does to each trade.

    trades: entry_price_raw, participation (at notional 10,000).
    """
    t = trades.withColumn("capital", F.explode(F.array(*[F.lit(float(c)) for c in capitals])))
    size = F.col("capital") / slots
    part = F.col("participation") * size / 10_000.0
    return t.groupBy(*by, "capital").agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile(participation * capital / {slots} / 10000, 0.5)").alias("median_participation"), F.avg((F.col("entry_price_raw") <= size).cast("double")).alias("share_affordable"), F.avg((part <= most).cast("double")).alias("share_feasible"))
