"""Evaluating experiments: what surrounds a strategy's trades, and the pieces that a decision is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, exact_quantiles, quantile_bucket, rank_pct, ratio
from . import signals, stats, trades
from .costs import Costs
from .metrics import kurtosis, skew

#: What a template's name runs as.
KINDS = {"threshold_event": "event", "quantile_event": "event", "state_position": "position", "buy_and_hold": "position", "segment_hold": "segment"}


def template_kind(name: str) -> str:
    if name.startswith("measurement:"):
        return "measurement"
    if name not in KINDS:
        raise KeyError(f"unknown template {name!r}")
    return KINDS[name]


def run_strategy(p: DataFrame, name: str, params: dict, costs: Costs, holding: int = 5) -> DataFrame:
    """symbol, signal_session, entry_session, exit_session, gross_ret, cost_frac, net_ret of a template over a panel with features.

    Event templates give the trades of their signals, position templates the spells of their weights, segments their
    round trips. Measurements have no trades.
    """
    kind = template_kind(name)
    if kind == "measurement":
        raise ValueError("a measurement has no trades")
    if kind == "segment":
        found = trades.segments(p, costs, params["segment"])
    elif kind == "event":
        wanted = params.get("conditions")
        if name == "threshold_event":
            signal = signals.threshold_signal(p, wanted, params.get("direction", 1.0), params.get("on_transition", False))
        else:
            signal = signals.quantile_signal(p, params["feature"], params.get("quantile", 0.2), params.get("side", "top"), params.get("every", 1), params.get("direction", 1.0), wanted)
        found = trades.candidates(signal, costs, holding)
    else:
        weighted = signals.state_weights(p, params["conditions"], params.get("gross", 1.0), params.get("slots")) if name == "state_position" else signals.constant_weights(p)
        found = signals.spells(weighted, (costs.half_spread_bps + costs.slippage_bps) / 1e4)
    return found.select("symbol", "signal_session", "entry_session", "exit_session", "gross_ret", "cost_frac", "net_ret")


def restrict(p: DataFrame, symbols: DataFrame) -> DataFrame:
    """The panel of the given symbols (symbol) on all sessions; those the panel lacks have NULLs."""
    return p.select("session").distinct().crossJoin(symbols.select("symbol")).join(p, ["session", "symbol"], "left")


def annotate(found: DataFrame, features: DataFrame, names: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Trades with feature values (session, symbol, names) and regime labels (session, ..) of their signal's session; missing ones are NULL."""
    out = found.join(features.select(F.col("session").alias("signal_session"), "symbol", *names), ["signal_session", "symbol"], "left")
    return out.join(labels.withColumnRenamed("session", "signal_session"), "signal_session", "left") if labels is not None else out


def signal_strength(rows: DataFrame, by: list[str], feature: str, ret: str, tie: list[str], q: int = 5, least: int = 50) -> DataFrame:
    """by, bucket, n, mean, lo, hi, rho: mean return and feature range by quintile of the feature, and its rank correlation with the return.

    Groups below `least` trades or q distinct values have no rows.
    """
    r = rows.where(F.col(feature).isNotNull() & F.col(ret).isNotNull())
    w = Window.partitionBy(*by)
    r = r.withColumns({"_k": F.row_number().over(w.orderBy(feature, *tie)), "_n": F.count(F.lit(1)).over(w), "_a": rank_pct(F.col(feature), by), "_b": rank_pct(F.col(ret), by)})
    rho = r.groupBy(*by).agg(F.corr("_a", "_b").alias("rho"), F.count_distinct(feature).alias("_d"))
    g = r.where(F.col("_n") >= least).groupBy(*by, quantile_bucket(F.col("_k"), F.col("_n"), q).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    return g.join(rho.where(F.col("_d") >= q).drop("_d"), by)


def calibration(pred: DataFrame, by: list[str], prob: str, label: str, tie: list[str], bins: int = 10) -> DataFrame:
    """by, bin, n, predicted, realised: mean probability and share of positives by decile of the probability."""
    w = Window.partitionBy(*by)
    r = pred.withColumns({"_k": F.row_number().over(w.orderBy(prob, *tie)), "_n": F.count(F.lit(1)).over(w)})
    return r.groupBy(*by, quantile_bucket(F.col("_k"), F.col("_n"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("predicted"), F.avg(F.col(label).cast("double")).alias("realised"))


def time_series_ic(rows: DataFrame, by: list[str], signal: str, label: str, least: int = 11) -> DataFrame:
    """by, n, ic: Spearman over all complete pairs of a group, NULL below `least`."""
    r = rows.where(F.col(signal).isNotNull() & F.col(label).isNotNull()).withColumns({"_a": rank_pct(F.col(signal), by), "_b": rank_pct(F.col(label), by)})
    n = F.count(F.lit(1))
    return r.groupBy(*by).agg(n.alias("n"), F.when(n >= least, F.corr("_a", "_b")).alias("ic"))


def family_pvalues(hypotheses: DataFrame, experiments: DataFrame) -> DataFrame:
    """id, family, p, q: each hypothesis's latest p-value (1 where it was never tested), adjusted for its family under any dependence.

    hypotheses: id, family; experiments: id, seq, p.
    """
    last = experiments.groupBy("id").agg(F.max_by("p", "seq").alias("p"))
    each = hypotheses.join(last, "id", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return stats.adjust(each, "p", ["id"], ["family"]).select("id", "family", "p", F.col("by").alias("q"))


def neighbour_share(hypotheses: DataFrame, neighbours: DataFrame, means: DataFrame) -> DataFrame:
    """id, n, share of a hypothesis's declared neighbours (id, neighbour) whose mean net return (id, mean) is above 0; a missing mean is not."""
    j = hypotheses.select("id").join(neighbours, "id").join(means.select(F.col("id").alias("neighbour"), "mean"), "neighbour", "left")
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("mean", F.lit(-1.0)) > 0).cast("double")).alias("share"))


def sharpe_inputs(daily: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """by, sr, n, skew, kurt (not in excess): what a deflated Sharpe ratio is made of."""
    x = F.col(ret)
    return daily.where(x.isNotNull()).groupBy(*by).agg(ratio(F.avg(x), F.stddev_samp(x)).alias("sr"), F.count(x).alias("n"), skew(x).alias("skew"), (kurtosis(x) + 3).alias("kurt"))


def effective_p(*parts: Column) -> Column:
    """The largest of the p-values that are there."""
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def measurement_outcome(status: Column, effective_n: Column, q: Column, train: Column, dev_status: Column, dev: Column, least: int = 30, level: float = 0.10) -> Column:
    """SUPPORTED with a small q and the same sign over the whole development period; INCONCLUSIVE without a result or a sample."""
    unknown = (F.coalesce(status, F.lit("")) != "OK") | (effective_n < least)
    same = (q < level) & (dev_status == "OK") & (F.signum(dev) == F.signum(train))
    return F.when(unknown, "INCONCLUSIVE").when(same, "SUPPORTED").otherwise("NOT_SUPPORTED")


def predicted_distribution(rows: DataFrame, by: list[str], ret: str) -> DataFrame:
    """by, n, q05, q25, q50, q75, q95, shrunk: quantiles of past net returns and their shrunk mean."""
    x = F.col(ret)
    se = F.stddev_samp(x) / F.sqrt(F.count(x))
    shrunk = stats.shrinkage_posterior(F.avg(x), se)[0]
    names = {0.05: "q05", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.95: "q95"}
    q = exact_quantiles(rows, by, ret, list(names)).groupBy(*by).agg(*[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n) for v, n in names.items()])
    g = rows.where(x.isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), shrunk.alias("shrunk"))
    return g.join(q, by).select(*by, "n", *names.values(), "shrunk")


def latest_adv(p: DataFrame, n: int = 20) -> DataFrame:
    """symbol, adv: mean dollar volume of the last n rows of each symbol."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    return p.withColumn("_k", k).where(F.col("_k") <= n).groupBy("symbol").agg(F.avg("dollar_volume").alias("adv"))


def opportunities(p: DataFrame, wanted: list[tuple[str, str, float]], history: DataFrame, equity: float = 10_000.0, fraction: float = 0.10) -> DataFrame:
    """symbol, session, notional, shrunk, adv of the symbols whose conditions hold on the panel's last session (history: symbol, net_ret)."""
    last = p.agg(F.max("session").alias("_last"))
    now = p.join(F.broadcast(last), F.col("session") == F.col("_last")).where(signals.conditions(wanted)).select("symbol", "session")
    past = predicted_distribution(history, ["symbol"], "net_ret").select("symbol", "shrunk")
    return now.join(past, "symbol", "left").join(latest_adv(p), "symbol", "left").select("symbol", "session", F.when(F.col("shrunk") > 0, equity * fraction).otherwise(0.0).alias("notional"), "shrunk", "adv")


def warmup_end(sessions: DataFrame, lookbacks: DataFrame) -> DataFrame:
    """lookback, session: the first session with lookback + 1 rows; NULL where there is none."""
    numbered = sessions.select("session", F.row_number().over(Window.orderBy("session")).alias("_p"))  # one row per session
    return lookbacks.join(numbered, F.col("_p") == F.col("lookback") + 1, "left").select("lookback", "session")


def equity_and_drawdown(p: DataFrame) -> DataFrame:
    """session, symbol, equity, drawdown of each symbol's returns."""
    from .panel import drawdown, equity_curve

    e = p.where("ret IS NOT NULL").withColumn("equity", equity_curve(F.col("ret"), ["session"], ["symbol"]))
    return e.withColumn("drawdown", drawdown(F.col("equity"), ["session"], ["symbol"])).select("session", "symbol", "equity", "drawdown")


def market_beta(p: DataFrame, ret: str = "ret", market: str = "market_ret", least: int = 20) -> DataFrame:
    """symbol, n, beta over all sessions with both returns."""
    r = p.where(F.col(ret).isNotNull() & F.col(market).isNotNull())
    n = F.count(F.lit(1))
    return r.groupBy("symbol").agg(n.alias("n"), F.when(n >= least, ratio(F.covar_samp(ret, market), F.var_samp(market))).alias("beta"))


def next_and_previous(dates: DataFrame, sessions: DataFrame) -> DataFrame:
    """date, is_session, next_session, previous_session. Windows run over the calendar, one row per day."""
    both = dates.select("date").distinct().withColumn("_side", F.lit(0)).withColumn("_s", F.lit(None).cast("date"))
    both = both.unionByName(sessions.select(F.col("session").alias("date"), F.lit(1).alias("_side"), F.col("session").alias("_s")))
    after = Window.orderBy(F.desc("date"), "_side").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumns({"next_session": F.last("_s", ignorenulls=True).over(after), "previous_session": F.last("_s", ignorenulls=True).over(before)}).where("_side = 0")
    return out.join(sessions.select(F.col("session").alias("date"), F.lit(True).alias("_is")), "date", "left").select("date", F.coalesce("_is", F.lit(False)).alias("is_session"), "next_session", "previous_session")
