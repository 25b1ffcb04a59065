"""Queries: signals, weights, trades, portfolios, metrics and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features
from ..functions.windows import out
from ..operators import metrics as M
from ..operators import signals, trades
from ..operators.costs import PROFILES, profile
from ..sources.adapters import PANEL_SQL, strategy_trades, table
from .catalogue import Catalogue
from .queries_features import S, _frame, _sma, market_panel

Q = Catalogue()
_FEAT = f"f AS (SELECT *, close / {_sma(20)} - 1 AS sma, lag(close, 5) OVER ({S}) / lag(close, 60) OVER ({S}) - 1 AS mom FROM panel)"


def _features(spark, sf_dir):
    return features.compute(market_panel(spark, sf_dir), {"sma": "sma_ratio(n=20)", "mom": "mom(lookback=60, skip=5)"})


_ON = f"o AS (SELECT *, coalesce(sma > 0.05, false) AS is_on FROM f), sg AS (SELECT *, is_on AND NOT coalesce(lag(is_on) OVER ({S}), false) AS signal FROM o)"


@Q.query(f"WITH {PANEL_SQL}, {_FEAT}, {_ON} SELECT session, symbol, signal::INT::DOUBLE AS signal FROM sg")
def threshold_signal(spark, sf_dir):
    return signals.threshold_signal(_features(spark, sf_dir), [("sma", ">", 0.05)], on_transition=True).select("session", "symbol", "signal")


@Q.query(f"""WITH {PANEL_SQL}, {_FEAT}, r AS (SELECT *, row_number() OVER ({S}) - 1 AS pos,
  CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY mom NULLS LAST) + (count(*) OVER (PARTITION BY session, mom) - 1) / 2.0) / count(mom) OVER (PARTITION BY session) END AS pct FROM f)
SELECT session, symbol, coalesce(pct > 1 - 0.3 AND pos % 5 = 0, false)::INT::DOUBLE AS signal FROM r""")
def quantile_signal(spark, sf_dir):
    return signals.quantile_signal(_features(spark, sf_dir), "mom", 0.3, every=5).select("session", "symbol", "signal")


@Q.query(f"WITH {PANEL_SQL}, {_FEAT}, o AS (SELECT *, coalesce(sma > 0, false)::INT AS q FROM f) SELECT session, symbol, CASE WHEN count(sma) OVER (PARTITION BY session) > 0 THEN round(coalesce(q / nullif(sum(q) OVER (PARTITION BY session), 0), 0) * 0.8, 6) + 0.0 END AS weight FROM o")
def state_weights(spark, sf_dir):
    return signals.state_weights(_features(spark, sf_dir), [("sma", ">", 0.0)], gross=0.8).select("session", "symbol", out(F.col("weight")).alias("weight"))


@Q.query(f"WITH {PANEL_SQL} SELECT session, symbol, round(1.0::DOUBLE / count(*) OVER (PARTITION BY session), 6) AS weight FROM panel")
def buy_and_hold_weights(spark, sf_dir):
    return signals.constant_weights(market_panel(spark, sf_dir)).select("session", "symbol", out(F.col("weight")).alias("weight"))


@Q.query(f"""WITH {PANEL_SQL}, {_FEAT}, s AS (SELECT *, CASE WHEN mom IS NOT NULL THEN greatest(sign(mom), 0) END AS s FROM f)
SELECT session, symbol, CASE WHEN count(s) OVER (PARTITION BY session) > 0 THEN round(coalesce(coalesce(s, 0)::DOUBLE / nullif(sum(abs(s)) OVER (PARTITION BY session), 0), 0), 6) + 0.0 END AS weight FROM s""")
def time_series_momentum_weights(spark, sf_dir):
    return signals.momentum_weights(market_panel(spark, sf_dir), 60, 5).select("session", "symbol", out(F.col("weight")).alias("weight"))


@Q.query(f"""WITH {PANEL_SQL}, x AS (SELECT *, ln(1 + ret) AS lr FROM panel),
z AS (SELECT session, symbol, CASE WHEN count(lr) OVER {_frame(5)} >= 5 AND count(lr) OVER {_frame(30)} >= 30 THEN sum(lr) OVER {_frame(5)} / nullif(stddev_samp(lr) OVER {_frame(30)} * sqrt(5), 0) END AS z FROM x)
SELECT session, symbol, coalesce(z < -0.5, false)::INT::DOUBLE AS signal FROM z""")
def mean_reversion_signal(spark, sf_dir):
    return signals.mean_reversion_signal(market_panel(spark, sf_dir), 5, -0.5, 30).select("session", "symbol", "signal")


@Q.query(f"WITH {PANEL_SQL} SELECT session, symbol, (('0x' || substr(md5('7:' || symbol || ':' || session::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.05)::INT::DOUBLE AS signal FROM panel")
def random_signal(spark, sf_dir):
    return signals.random_signal(market_panel(spark, sf_dir), 0.05, 7).select("session", "symbol", "signal")


@Q.query(f"""WITH {PANEL_SQL}, {_FEAT}, o AS (SELECT *, coalesce(sma > 0, false) AS w FROM f),
n AS (SELECT *, lead(session) OVER ({S}) AS i, lead(open) OVER ({S}) AS ip, lead(raw_open) OVER ({S}) AS ir, lead(session, 2) OVER ({S}) AS x, lead(open, 2) OVER ({S}) AS xp, (w AND NOT coalesce(lag(w) OVER ({S}), false))::INT AS st FROM o),
g AS (SELECT *, sum(st) OVER ({S}) AS spell FROM n)
SELECT symbol, min(session) AS signal_session, arg_min(i, session) AS entry_session, max(x) AS exit_session, round(arg_max(coalesce(xp, -1e9), session) / arg_min(coalesce(ip, 1e-9), session) - 1, 6) + 0.0 AS gross_ret
FROM g WHERE w GROUP BY symbol, spell HAVING arg_max(coalesce(xp, -1e9), session) > 0 AND arg_min(coalesce(ip, -1e9), session) > 0""")
def spells_to_trades(spark, sf_dir):
    p = signals.state_weights(_features(spark, sf_dir), [("sma", ">", 0.0)])
    return signals.spells(p, 0.0005).select("symbol", "signal_session", "entry_session", "exit_session", out(F.col("gross_ret")).alias("gross_ret"))


def _candidates(spark, sf_dir):
    p = signals.threshold_signal(_features(spark, sf_dir), [("sma", ">", 0.05)], on_transition=True)
    return trades.candidates(p, profile("retail_largecap"), holding=5)


_CANDIDATES = f"""{PANEL_SQL}, {_FEAT}, {_ON},
lq AS (SELECT *, avg(dollar_volume) OVER {_frame(20)} AS adv, CASE WHEN count(ret) OVER {_frame(21)} >= 5 THEN stddev_samp(ret) OVER {_frame(21)} END AS dvol, row_number() OVER ({S}) AS pos FROM sg),
ld AS (SELECT *, lead(session) OVER ({S}) AS i, lead(open) OVER ({S}) AS ip, lead(raw_open) OVER ({S}) AS ir, lead(raw_volume) OVER ({S}) AS iv,
  min(CASE WHEN open IS NOT NULL AND raw_volume > 0 THEN pos END) OVER ({S} ROWS BETWEEN 6 FOLLOWING AND UNBOUNDED FOLLOWING) AS xpos FROM lq),
cand AS (SELECT l.symbol, l.session AS signal_session, l.i AS entry_session, x.session AS exit_session, l.pos + 1 AS entry_pos, l.xpos AS exit_pos, x.open / l.ip - 1 AS gross_ret,
  2 * (6 / 1e4 + 0.1 * coalesce(l.dvol, 0.02) * sqrt(least(10000 / l.adv, 1))) AS cost_frac, 10000 / l.adv AS participation, l.xpos - l.pos - 1 > 5 AS delayed_exit
  FROM ld l JOIN lq x ON x.symbol = l.symbol AND x.pos = l.xpos WHERE l.signal AND l.ip IS NOT NULL AND l.iv > 0 AND l.raw_close IS NOT NULL)"""


@Q.query(f"WITH {_CANDIDATES} SELECT symbol, signal_session, entry_session, exit_session, round(gross_ret, 6) + 0.0 AS gross_ret, round(cost_frac, 6) AS cost_frac, round(participation, 6) AS participation, delayed_exit FROM cand")
def trades_overlap_allowed(spark, sf_dir):
    return _candidates(spark, sf_dir).select("symbol", "signal_session", "entry_session", "exit_session", out(F.col("gross_ret")).alias("gross_ret"), out(F.col("cost_frac")).alias("cost_frac"), out(F.col("participation")).alias("participation"), "delayed_exit")


_GREEDY = f"""WITH RECURSIVE {_CANDIDATES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_pos) AS k FROM cand),
walk AS (SELECT symbol, k, entry_session, exit_session, gross_ret - cost_frac AS net_ret, true AS taken, exit_pos AS busy FROM ranked WHERE k = 1
  UNION ALL SELECT r.symbol, r.k, r.entry_session, r.exit_session, r.gross_ret - r.cost_frac, r.entry_pos > w.busy, CASE WHEN r.entry_pos > w.busy THEN r.exit_pos ELSE w.busy END FROM walk w JOIN ranked r ON r.symbol = w.symbol AND r.k = w.k + 1)"""


@Q.query(f"{_GREEDY} SELECT symbol, entry_session, exit_session, round(net_ret, 6) + 0.0 AS net_ret FROM walk WHERE taken")
def trades_no_overlap(spark, sf_dir):
    return trades.without_overlap(_candidates(spark, sf_dir)).select("symbol", "entry_session", "exit_session", out(F.col("net_ret")).alias("net_ret"))


@Q.query(f"""{_GREEDY},
tk AS (SELECT symbol, entry_session, exit_session, net_ret, row_number() OVER (ORDER BY entry_session, symbol, exit_session) AS q FROM walk WHERE taken AND exit_session > entry_session),
dl AS (SELECT q, entry_session, exit_session, net_ret, 1 AS slot, [exit_session, NULL, NULL] AS busy FROM tk WHERE q = 1
  UNION ALL SELECT t.q, t.entry_session, t.exit_session, t.net_ret, list_position(list_transform(d.busy, lambda b: b IS NULL OR b <= t.entry_session), true),
    list_transform(range(1, 4), lambda i: CASE WHEN i = list_position(list_transform(d.busy, lambda b: b IS NULL OR b <= t.entry_session), true) THEN t.exit_session ELSE d.busy[i] END)
  FROM dl d JOIN tk t ON t.q = d.q + 1),
num AS (SELECT session, row_number() OVER (ORDER BY session) AS p FROM (SELECT DISTINCT session FROM panel)),
sp AS (SELECT a.p AS pa, b.p AS pb, net_ret FROM dl JOIN num a ON a.session = entry_session JOIN num b ON b.session = exit_session WHERE slot IS NOT NULL),
dy AS (SELECT unnest(range(pa + 1, pb + 1)) AS p, CASE WHEN net_ret > -1 THEN pow(1 + net_ret, 1.0 / (pb - pa)) - 1 ELSE -1 END / 3 AS d FROM sp)
SELECT session, round(coalesce(sum(d), 0), 6) + 0.0 AS ret FROM num LEFT JOIN dy USING (p) GROUP BY session""")
def trades_to_daily(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    t = trades.without_overlap(_candidates(spark, sf_dir))
    return trades.to_daily(t, p.select("session").distinct(), 3).select("session", out(F.col("ret")).alias("ret"))


def _segment(kind: str) -> str:
    e, x, r, ok, xs = ("lead(close) OVER w", "lead(open, 2) OVER w", "lead(raw_close) OVER w", "lead(raw_volume) OVER w > 0 AND lead(raw_volume, 2) OVER w > 0", "lead(session, 2) OVER w") if kind == "overnight" else (
        "lead(open) OVER w", "lead(close) OVER w", "lead(raw_open) OVER w", "lead(raw_volume) OVER w > 0", "lead(session) OVER w")
    return f"""WITH {PANEL_SQL}, lq AS (SELECT *, avg(dollar_volume) OVER {_frame(20)} AS adv, CASE WHEN count(ret) OVER {_frame(21)} >= 5 THEN stddev_samp(ret) OVER {_frame(21)} END AS dvol FROM panel),
s AS (SELECT symbol, session AS signal_session, {xs} AS exit_session, {x} / {e} - 1 AS gross_ret, {ok} AS ok, 2 * (3 / 1e4 + 0.1 * coalesce(dvol, 0.02) * sqrt(CASE WHEN adv > 0 THEN least(20000 / adv, 1) ELSE 1 END)) AS cost_frac FROM lq WINDOW w AS ({S}))
SELECT symbol, signal_session, exit_session, round(gross_ret, 6) + 0.0 AS gross_ret, round(cost_frac, 6) AS cost_frac FROM s WHERE coalesce(ok, false) AND gross_ret IS NOT NULL"""


def _segments(kind, spark, sf_dir):
    return trades.segments(market_panel(spark, sf_dir), profile("retail_etf"), kind).select("symbol", "signal_session", "exit_session", out(F.col("gross_ret")).alias("gross_ret"), out(F.col("cost_frac")).alias("cost_frac"))


@Q.query(_segment("overnight"))
def segment_overnight(spark, sf_dir):
    return _segments("overnight", spark, sf_dir)


@Q.query(_segment("intraday"))
def segment_intraday(spark, sf_dir):
    return _segments("intraday", spark, sf_dir)


_R = f"{PANEL_SQL}, r AS (SELECT symbol, session, ret FROM panel WHERE ret IS NOT NULL)"


@Q.query(f"""WITH {_R}, e AS (SELECT *, product(1 + ret) OVER w AS eq FROM r WINDOW w AS ({S} ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, eq / max(eq) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS dd, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS q FROM e),
i AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER ({S}) AS isle FROM d), k AS (SELECT *, count(*) FILTER (dd < 0) OVER (PARTITION BY symbol, isle) AS run FROM i)
SELECT symbol, count(*) AS n_days, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe,
 round(avg(ret) / sqrt(avg(least(ret, 0) * least(ret, 0))) * sqrt(252), 6) AS sortino, round(min(dd), 6) AS max_drawdown, max(run) AS max_dd_duration,
 round(skewness(ret), 5) AS skew, round(kurtosis(ret), 4) AS excess_kurtosis, round(-any_value(q), 6) AS var_95, round(-avg(ret) FILTER (ret <= q), 6) AS es_95, round(avg((ret > 0)::INT), 6) AS pct_positive
FROM k GROUP BY symbol""")
def summarize_returns(spark, sf_dir):
    s = M.returns_summary(market_panel(spark, sf_dir).select("symbol", "session", "ret"), ["symbol"])
    six = ("ann_vol", "sharpe", "sortino", "max_drawdown", "var_95", "es_95", "pct_positive")
    return s.select("symbol", "n_days", *[out(F.col(c)).alias(c) for c in six], "max_dd_duration", F.round("skew", 5).alias("skew"), F.round("excess_kurtosis", 4).alias("excess_kurtosis"))


@Q.query("""WITH t AS (SELECT l_suppkey AS supp, l_discount - l_tax AS ret FROM lineitem)
SELECT supp, count(*) AS n_trades, round(avg(ret), 6) + 0.0 AS mean, round(quantile_cont(ret, 0.5), 6) + 0.0 AS median, round(stddev_samp(ret), 6) AS sd, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 5) + 0.0 AS t_naive,
 round(avg((ret > 0)::INT), 6) AS win_rate, round(avg(ret) FILTER (ret > 0) / -(avg(ret) FILTER (ret < 0)), 5) AS payoff, round(sum(ret) FILTER (ret > 0) / -(sum(ret) FILTER (ret < 0)), 5) AS profit_factor FROM t GROUP BY supp""")
def summarize_trades(spark, sf_dir):
    s = M.trades_summary(strategy_trades(spark, sf_dir).withColumnRenamed("l_suppkey", "supp"), ["supp"])
    return s.select("supp", "n_trades", *[out(F.col(c)).alias(c) for c in ("mean", "median", "sd", "win_rate")], *[out(F.col(c), 5).alias(c) for c in ("t_naive", "payoff", "profit_factor")])


@Q.query(f"WITH {_R} SELECT symbol, year(session) AS year, round(product(1 + ret), 6) AS growth FROM r GROUP BY 1, 2")
def yearly_returns(spark, sf_dir):
    return M.yearly(market_panel(spark, sf_dir), ["symbol"]).select("symbol", "year", F.round(F.col("total") + 1, 6).alias("growth"))


@Q.query("""WITH s AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS p FROM (SELECT DISTINCT l_shipdate::DATE AS session FROM lineitem))
SELECT l_partkey, count(DISTINCT p // 5) AS effective_n FROM lineitem JOIN s ON l_shipdate::DATE = session GROUP BY 1""")
def effective_n(spark, sf_dir):
    t = strategy_trades(spark, sf_dir)
    return M.effective_n(t, t.select(F.col("entry").alias("session")).distinct(), 5, ["l_partkey"])


@Q.query(f"""WITH {PANEL_SQL}, {_FEAT}, l AS (SELECT *, lead(open, 6) OVER ({S}) / lead(open, 1) OVER ({S}) - 1 AS label FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY mom, symbol, session) AS k, count(*) OVER () AS n FROM l WHERE mom IS NOT NULL AND label IS NOT NULL)
SELECT greatest(1, ceil((k - 1) * 5 / (n - 1)))::INT AS bucket, count(*) AS n, round(avg(label), 6) + 0.0 AS mean, round(quantile_cont(label, 0.5), 6) + 0.0 AS median FROM r GROUP BY 1""")
def quantile_returns(spark, sf_dir):
    from ..operators.panel import forward_return

    p = _features(spark, sf_dir).withColumn("label", forward_return(5))
    return M.quantile_returns(p, "mom", "label", ["symbol", "session"]).select("bucket", "n", out(F.col("mean")).alias("mean"), out(F.col("median")).alias("median"))


_REGIMES = f"""m AS (SELECT *, ln(1 + ret) AS lr FROM panel WHERE symbol = 'AF'),
m1 AS (SELECT *, CASE WHEN count(close) OVER {_frame(200)} >= 200 THEN avg(close) OVER {_frame(200)} END AS sma, CASE WHEN count(lr) OVER {_frame(21)} >= 21 THEN stddev_samp(lr) OVER {_frame(21)} * sqrt(252) END AS rv, close / max(close) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM m),
m2 AS (SELECT *, CASE WHEN count(rv) OVER {_frame(756)} >= 126 THEN median(rv) OVER {_frame(756)} END AS med FROM m1),
labels AS (SELECT session, CASE WHEN sma IS NOT NULL THEN CASE WHEN close > sma THEN 'BULL' ELSE 'BEAR' END END AS trend,
  CASE WHEN med IS NOT NULL AND rv IS NOT NULL THEN CASE WHEN rv > med THEN 'HIGH_VOL' ELSE 'LOW_VOL' END END AS volatility,
  CASE WHEN dd <= -0.2 THEN 'DRAWDOWN_GT_20' ELSE 'NORMAL' END AS market_drawdown, year(session)::VARCHAR AS year FROM m2)"""


@Q.query(f"WITH {PANEL_SQL}, {_REGIMES} SELECT * FROM labels")
def regime_labels(spark, sf_dir):
    return M.regime_labels(market_panel(spark, sf_dir), "AF")


_MACRO = f"""vx AS (SELECT o_orderdate::DATE AS session, avg(o_totalprice) / 5000 AS vix FROM orders GROUP BY 1),
rt AS (SELECT o_orderdate::DATE AS session, avg(o_totalprice) AS rate FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
m AS (SELECT p.*, vix / 100 AS rv, last_value(rate IGNORE NULLS) OVER (ORDER BY p.session ROWS UNBOUNDED PRECEDING) AS known FROM panel p LEFT JOIN vx USING (session) LEFT JOIN rt USING (session) WHERE symbol = 'AF'),
m1 AS (SELECT *, CASE WHEN count(rv) OVER {_frame(756)} >= 126 THEN median(rv) OVER {_frame(756)} END AS med, known - lag(known, 63) OVER ({S}) AS change FROM m)"""


@Q.query(f"WITH {PANEL_SQL}, {_MACRO} SELECT session, CASE WHEN med IS NOT NULL AND rv IS NOT NULL THEN CASE WHEN rv > med THEN 'HIGH_VOL' ELSE 'LOW_VOL' END END AS volatility, CASE WHEN change > 0 THEN 'RISING_RATES' WHEN change <= 0 THEN 'FALLING_RATES' END AS rates FROM m1")
def regime_labels_macro(spark, sf_dir):
    """Volatility by an index of its own (mean order value by day), rates by urgent orders' mean value."""
    o = table(spark, sf_dir, "orders").withColumn("session", F.to_date("o_orderdate"))
    vix = o.groupBy("session").agg((F.avg("o_totalprice") / 5000).alias("vix"))
    rates = o.where("o_orderpriority = '1-URGENT'").groupBy("session").agg(F.avg("o_totalprice").alias("rate"))
    return M.regime_labels(market_panel(spark, sf_dir), "AF", vix, rates).select("session", "volatility", "rates")


@Q.query(f"""{_GREEDY}, {_REGIMES}, t AS (SELECT c.signal_session, c.gross_ret - c.cost_frac AS r FROM walk w JOIN cand c ON c.symbol = w.symbol AND c.entry_session = w.entry_session WHERE taken),
u AS (SELECT r, unnest(['trend', 'volatility', 'market_drawdown', 'year']) AS dimension, unnest([trend, volatility, market_drawdown, year]) AS label FROM t JOIN labels ON signal_session = session)
SELECT dimension, label, count(*) AS n, round(avg(r), 6) + 0.0 AS mean, round(quantile_cont(r, 0.5), 6) + 0.0 AS median, round(avg((r > 0)::INT), 6) AS win_rate, count(*) < 10 AS small_sample FROM u WHERE label IS NOT NULL GROUP BY 1, 2""")
def regime_performance(spark, sf_dir):
    t = trades.without_overlap(_candidates(spark, sf_dir))
    s = M.by_regime(t, M.regime_labels(market_panel(spark, sf_dir), "AF"))
    return s.select("dimension", "label", "n", *[out(F.col(c)).alias(c) for c in ("mean", "median", "win_rate")], "small_sample")


@Q.query(f"WITH {PANEL_SQL} SELECT session, symbol, round(CASE WHEN count(ret) OVER {_frame(63)} >= 63 THEN avg(ret) OVER {_frame(63)} / stddev_samp(ret) OVER {_frame(63)} * sqrt(252) END, 6) + 0.0 AS sharpe FROM panel")
def rolling_sharpe(spark, sf_dir):
    from ..functions.windows import gated, trailing

    x = F.col("ret")
    s = gated(F.avg(x), x, 63, trailing(63)) / F.stddev_samp(x).over(trailing(63)) * F.sqrt(F.lit(252.0))
    return market_panel(spark, sf_dir).select("session", "symbol", out(s).alias("sharpe"))
