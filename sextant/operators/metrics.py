"""Summaries of returns and trades as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import quantile_bucket, ratio

YEAR = 252.0


def skew(x: Column) -> Column:
    """Bias-corrected skewness."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def sharpe(x: Column) -> Column:
    return F.when(F.count(x) > 1, ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(YEAR)))


def sortino(x: Column) -> Column:
    low = F.least(x, F.lit(0.0))
    return F.when(F.count(x) > 1, ratio(F.avg(x), F.sqrt(F.avg(low * low))) * F.sqrt(F.lit(YEAR)))


def growth(x: Column) -> Column:
    return F.product(1 + x)


def cagr(x: Column) -> Column:
    return F.when(growth(x) <= 0, -1.0).otherwise(F.pow(F.greatest(growth(x), F.lit(1e-300)), YEAR / F.count(x)) - 1)


def returns_summary(returns: DataFrame, by: list[str], order: str = "session", ret: str = "ret") -> DataFrame:
    """One row per group of daily returns: moments, Sharpe and Sortino, drawdown and its longest run, VaR and ES."""
    x = F.col(ret)
    r = returns.where(x.isNotNull())
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_eq", F.product(1 + x).over(w)).withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    r = r.withColumn("_isle", F.sum(F.when(F.col("_dd") < 0, 0).otherwise(1)).over(w))
    r = r.withColumn("_run", F.count(F.when(F.col("_dd") < 0, 1)).over(Window.partitionBy(*by, "_isle")))
    r = r.withColumn("_q", F.expr(f"percentile({ret}, 0.05)").over(Window.partitionBy(*by)))
    return r.groupBy(*by).agg(
        F.count(x).alias("n_days"), (growth(x) - 1).alias("total_return"), cagr(x).alias("cagr"), (F.stddev_samp(x) * F.sqrt(F.lit(YEAR))).alias("ann_vol"),
        sharpe(x).alias("sharpe"), sortino(x).alias("sortino"), F.min("_dd").alias("max_drawdown"), F.max("_run").alias("max_dd_duration"),
        skew(x).alias("skew"), kurtosis(x).alias("excess_kurtosis"), (-F.first("_q")).alias("var_95"), (-F.avg(F.when(x <= F.col("_q"), x))).alias("es_95"), F.avg((x > 0).cast("double")).alias("pct_positive"))


def trades_summary(trades: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    x = F.col(ret)
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    n = F.count(x)
    return trades.groupBy(*by).agg(
        n.alias("n_trades"), F.avg(x).alias("mean"), F.expr(f"percentile({ret}, 0.5)").alias("median"), F.stddev_samp(x).alias("sd"),
        ratio(F.avg(x), F.stddev_samp(x) / F.sqrt(n)).alias("t_naive"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        (F.avg(win) / -F.avg(loss)).alias("payoff"), ratio(F.coalesce(F.sum(win), F.lit(0.0)), -F.sum(loss)).alias("profit_factor"), F.max(x).alias("best"), F.min(x).alias("worst"))


def yearly(returns: DataFrame, by: list[str], session: str = "session", ret: str = "ret") -> DataFrame:
    return returns.where(F.col(ret).isNotNull()).groupBy(*by, F.year(session).alias("year")).agg((growth(F.col(ret)) - 1).alias("total"))


def effective_n(trades: DataFrame, sessions: DataFrame, holding: int, by: list[str]) -> DataFrame:
    """effective_n: distinct blocks of `holding` sessions that hold an entry."""
    p = sessions.select("session", (F.row_number().over(Window.orderBy("session")) - 1).alias("p"))
    return trades.join(p, trades["entry"] == p["session"]).groupBy(*by).agg(F.count_distinct(F.floor(F.col("p") / holding)).alias("effective_n"))


def quantile_returns(rows: DataFrame, signal: str, label: str, tie: list[str], q: int = 5) -> DataFrame:
    """bucket, n, mean, median of label by equal-count buckets of the signal's rank (ties by `tie`).

    Ranks over all rows come from a range sort whose partitions are numbered one after the other, not from one window.
    """
    pooled = rows.where(F.col(signal).isNotNull() & F.col(label).isNotNull())
    ranked = global_rank(pooled, [signal, *tie])
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    b = ranked.join(F.broadcast(n)).withColumn("bucket", quantile_bucket(F.col("_rank"), F.col("_n"), q))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"), F.expr(f"percentile({label}, 0.5)").alias("median"))


def global_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds _rank 1 .. N by a total order: the first order column is cut at sampled quantiles, rows are ranked within a
    slice, and the slices' sizes are added up before them (one row per slice)."""
    first = order[0]
    cuts = sorted(set(rows.stat.approxQuantile(first, [i / 32 for i in range(1, 32)], 0.005))) if dict(rows.dtypes)[first] in ("double", "float", "int", "bigint") else []
    piece = sum(((F.col(first) > c).cast("int") for c in cuts), F.lit(0))
    sliced = rows.withColumn("_slice", piece)
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_slice", (F.sum("_size").over(Window.orderBy("_slice")) - F.col("_size")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return sliced.withColumn("_in", inside).join(F.broadcast(offsets), "_slice").withColumn("_rank", F.col("_in") + F.col("_offset")).drop("_slice", "_in", "_offset")


def regime_labels(panel: DataFrame, market: str, vix: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """session, trend, volatility, market_drawdown, year (and rates) of one symbol's history.

    vix (session, vix): levels in percent that take the place of realised volatility against their own trailing median.
    rates (session, rate): the last known rate of each session, rising or falling over 63 sessions. Both have one row a session at most.
    """
    from ..functions.windows import by_symbol, gated, trailing

    m = panel.where(F.col("symbol") == market)
    c, lr = F.col("close"), F.log1p("ret")
    m = m.withColumns({"_sma": gated(F.avg(c), c, 200, trailing(200)), "_rv": gated(F.stddev_samp(lr), lr, 21, trailing(21)) * F.sqrt(F.lit(YEAR))})
    if vix is not None:
        m = m.drop("_rv").join(vix.select("session", (F.col("vix") / 100).alias("_rv")), "session", "left")
    m = m.withColumns({
        "_med": F.when(F.count("_rv").over(trailing(756)) >= 126, F.expr("percentile(_rv, 0.5)").over(trailing(756))),
        "_dd": c / F.max(c).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)) - 1})
    more = []
    if rates is not None:
        known = F.last("rate", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
        m = m.join(rates.select("session", "rate"), "session", "left").withColumn("_rate", known)
        change = F.col("_rate") - F.lag("_rate", 63).over(by_symbol())
        more = [F.when(change > 0, "RISING_RATES").when(change <= 0, "FALLING_RATES").alias("rates")]
    return m.select(
        "session", F.when(F.col("_sma").isNotNull(), F.when(c > F.col("_sma"), "BULL").otherwise("BEAR")).alias("trend"),
        F.when(F.col("_med").isNotNull() & F.col("_rv").isNotNull(), F.when(F.col("_rv") > F.col("_med"), "HIGH_VOL").otherwise("LOW_VOL")).alias("volatility"),
        F.when(F.col("_dd") <= -0.20, "DRAWDOWN_GT_20").otherwise("NORMAL").alias("market_drawdown"), F.year("session").cast("string").alias("year"), *more)


def by_regime(trades: DataFrame, labels: DataFrame, ret: str = "net_ret", min_n: int = 10) -> DataFrame:
    """dimension, label, n, mean, median, win_rate, small_sample of trades by the labels at their signal session."""
    dims = [c for c in labels.columns if c != "session"]
    j = trades.join(labels, trades["signal_session"] == labels["session"], "left")
    long = j.selectExpr(f"{ret} AS r", f"stack({len(dims)}, {', '.join(f'{chr(39)}{d}{chr(39)}, {d}' for d in dims)}) AS (dimension, label)").where("label IS NOT NULL AND r IS NOT NULL")
    n = F.count("r")
    return long.groupBy("dimension", "label").agg(n.alias("n"), F.avg("r").alias("mean"), F.expr("percentile(r, 0.5)").alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), (n < min_n).alias("small_sample"))
