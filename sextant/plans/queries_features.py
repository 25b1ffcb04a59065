"""Queries: bars, panel, labels and the feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..functions.windows import out
from ..operators import panel as P
from ..operators import signals
from ..sources.adapters import ACTIONS_SQL, BARS_SQL, PANEL_SQL, bars_daily, bars_intraday, corporate_actions
from .catalogue import Catalogue, wilder_sql

Q = Catalogue()


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    return P.build_panel(bars, corporate_actions(bars))


@Q.query(f"WITH {BARS_SQL} SELECT symbol, session, open, high, low, close, volume FROM bars")
def bars_from_trades(spark, sf_dir):
    return bars_daily(spark, sf_dir)


@Q.query("""SELECT event_type AS symbol, epoch(date_trunc('hour', ts))::BIGINT AS bar_start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2""")
def bars_intraday_hourly(spark, sf_dir):
    return bars_intraday(spark, sf_dir).withColumn("bar_start", F.unix_timestamp("bar_start"))


@Q.query(f"WITH {ACTIONS_SQL} SELECT symbol, ex_date, action, value FROM actions")
def split_dividend_actions(spark, sf_dir):
    return corporate_actions(bars_daily(spark, sf_dir))


@Q.query(f"WITH {PANEL_SQL} SELECT session, symbol, raw_close, raw_volume, split_ratio, dividend FROM dense")
def densify_panel(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return P.densify(bars, corporate_actions(bars)).select("session", "symbol", "raw_close", "raw_volume", "split_ratio", "dividend")


@Q.query(f"WITH {PANEL_SQL} SELECT session, symbol, round(ret, 6) + 0.0 AS ret FROM panel")
def total_return(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return P.densify(bars, corporate_actions(bars)).select("session", "symbol", out(P.total_return()).alias("ret"))


@Q.query(f"""WITH {PANEL_SQL} SELECT session, symbol, round(open / raw_open, 6) AS factor, round(close / raw_close, 6) AS close_factor, volume, dollar_volume FROM panel""")
def tri_panel(spark, sf_dir):
    return market_panel(spark, sf_dir).select(
        "session", "symbol", F.round(F.col("open") / F.col("raw_open"), 6).alias("factor"), F.round(F.col("close") / F.col("raw_close"), 6).alias("close_factor"),
        "volume", "dollar_volume")


S = "PARTITION BY symbol ORDER BY session"


def _forward(name: str, px: str, h: int):
    @Q.query(f"WITH {PANEL_SQL} SELECT session, symbol, round(lead({px}, {1 + h}) OVER ({S}) / lead({px}, 1) OVER ({S}) - 1, 6) + 0.0 AS label FROM panel")
    def f(spark, sf_dir):
        return market_panel(spark, sf_dir).select("session", "symbol", out(P.forward_return(h, name)).alias("label"))

    return f


for _name, _px in (("next_open", "open"), ("next_close", "close")):
    _f = _forward(_name, _px, 5)
    Q.queries[f"fwd_return_{_name}"], Q.sql[f"fwd_return_{_name}"] = Q.queries.pop("f"), Q.sql.pop("f")


@Q.query(f"WITH {PANEL_SQL}, x AS (SELECT *, ln(1 + ret) AS lr FROM panel) SELECT session, symbol, round(CASE WHEN count(lr) OVER w >= 21 THEN sum(lr * lr) OVER w * 252 / 21 END, 6) AS rv FROM x WINDOW w AS ({S} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)")
def realized_variance_forward(spark, sf_dir):
    return market_panel(spark, sf_dir).select("session", "symbol", F.round(P.realized_variance_forward(21), 6).alias("rv"))


def _frame(n: int, lag: int = 0) -> str:
    return f"({S} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"


def _gated(agg: str, x: str, n: int, lag: int = 0) -> str:
    return f"(CASE WHEN count({x}) OVER {_frame(n, lag)} >= {n} THEN {agg} OVER {_frame(n, lag)} END)"


def _sma(n: int) -> str:
    return _gated("avg(close)", "close", n)


_MOM = f"(lag(close, 5) OVER ({S}) / lag(close, 60) OVER ({S}) - 1)"
_VOL = f"({_gated('stddev_samp(lr)', 'lr', 21)} * sqrt(252))"
#: alias: (spec, steps of SQL, the last of which is the value).
_FEATURES = {
    "feat_ret": ("ret(h=5)", [f"close / lag(close, 5) OVER ({S}) - 1"]),
    "feat_mom": ("mom(lookback=60, skip=5)", [_MOM]),
    "feat_vol": ("vol(n=21)", [_VOL]),
    "feat_zret": ("zret(h=3, vol_n=30)", [f"{_gated('sum(lr)', 'lr', 3)} / nullif({_gated('stddev_samp(lr)', 'lr', 30, 3)} * sqrt(3), 0)"]),
    "feat_vol_adj_mom": ("vol_adj_mom(lookback=60, skip=5, vol_n=21)", [f"{_MOM} / nullif({_VOL}, 0)"]),
    "feat_overnight": ("overnight", [f"open / lag(close) OVER ({S}) - 1"]),
    "feat_intraday": ("intraday", ["close / open - 1"]),
    "feat_sma_ratio": ("sma_ratio(n=20)", [f"close / {_sma(20)} - 1"]),
    "feat_sma_slope": ("sma_slope(n=20, k=5)", [_sma(20), f"s1 / lag(s1, 5) OVER ({S}) - 1"]),
    "feat_ma_cross": ("ma_cross(fast=10, slow=30)", [f"{_sma(10)} / {_sma(30)} - 1"]),
    "feat_bollinger": ("bollinger(n=20, k=2.0)", [f"(close - {_sma(20)}) / nullif(2.0 * {_gated('stddev_samp(close)', 'close', 20)}, 0)"]),
    "feat_drawdown": ("drawdown(n=60)", [f"close / max(close) OVER {_frame(60)} - 1"]),
    "feat_breakout": ("breakout(n=20)", [f"close / {_gated('max(high)', 'high', 20, 1)} - 1"]),
    "feat_rel_volume": ("rel_volume(n=20)", [f"volume / nullif({_gated('avg(volume)', 'volume', 20, 1)}, 0)"]),
    "feat_adv_dollar": ("adv_dollar(n=20)", [f"{_gated('avg(dollar_volume)', 'dollar_volume', 20)} / 1000.0"]),
    "feat_price": ("price", ["raw_close"]),
    "feat_beta": ("beta(n=63, market=AF)", [
        f"CASE WHEN count(CASE WHEN mret IS NOT NULL THEN ret END) OVER {_frame(63)} >= 63 THEN covar_samp(ret, mret) OVER {_frame(63)} END / nullif({_gated('var_samp(mret)', 'mret', 63)}, 0)"]),
    "feat_corr": ("corr(n=63, market=AF)", [f"CASE WHEN count(CASE WHEN mret IS NOT NULL THEN ret END) OVER {_frame(63)} >= 63 THEN corr(ret, mret) OVER {_frame(63)} END"]),
    "feat_rel_ret": ("rel_ret(h=21, market=AF)", [f"close / lag(close, 21) OVER ({S}) - mclose / lag(mclose, 21) OVER ({S})"]),
    "feat_breadth": ("breadth(n=20)", [_sma(20), "avg(CASE WHEN s1 IS NOT NULL THEN coalesce((close > s1)::INT, 0) END) OVER (PARTITION BY session)"]),
    "feat_xs_rank_mom": ("xs_rank_mom(lookback=60, skip=5)", [
        _MOM, "CASE WHEN s1 IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY s1 NULLS LAST) + (count(*) OVER (PARTITION BY session, s1) - 1) / 2.0) / count(s1) OVER (PARTITION BY session) END"]),
    "feat_turn_of_month": ("tom(before=2, after=3, lead=1)", [
        "NULL", """(SELECT t.led FROM (SELECT session, lead(f, 1) OVER (ORDER BY session) AS led FROM (SELECT session,
          ((row_number() OVER (PARTITION BY date_trunc('month', session) ORDER BY session)) <= 3 OR (row_number() OVER (PARTITION BY date_trunc('month', session) ORDER BY session DESC)) <= 2)::INT::DOUBLE AS f
          FROM (SELECT DISTINCT session FROM panel))) t WHERE t.session = x1.session)"""]),
}


def _feature(name: str, spec: str, steps: list[str]) -> None:
    ctes, source = "", "x0"
    for i, step in enumerate(steps[:-1]):
        ctes += f", x{i + 1} AS (SELECT *, {step} AS s{i + 1} FROM x{i})"
        source = f"x{i + 1}"
    sql = f"WITH {PANEL_SQL}, x0 AS (SELECT p.*, ln(1 + p.ret) AS lr, m.ret AS mret, m.close AS mclose FROM panel p LEFT JOIN (SELECT session, ret, close FROM panel WHERE symbol = 'AF') m USING (session)){ctes} SELECT session, symbol, {steps[-1] if name == "feat_price" else f"round({steps[-1]}, 6) + 0.0"} AS x FROM {source}"

    def f(spark, sf_dir):
        scale = 1000.0 if name == "feat_adv_dollar" else 1.0
        x = F.col("x") if name == "feat_price" else out(F.col("x") / scale)
        return features.add(market_panel(spark, sf_dir), spec, "x").select("session", "symbol", x.alias("x"))

    f.__name__ = name
    Q.query(sql)(f)


for _n, (_spec, _steps) in _FEATURES.items():
    _feature(_n, _spec, _steps)

# RSI and ATR: the fold over a symbol's growing prefix is quadratic in SQL; tests hold them to pandas.


_POS = f"q AS (SELECT *, row_number() OVER ({S}) AS pos, close - lag(close) OVER ({S}) AS d, lag(close) OVER ({S}) AS before FROM panel)"


@Q.query(f"""WITH RECURSIVE {PANEL_SQL}, {_POS}, ru2 AS (SELECT symbol, pos, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS x FROM q), rd AS (SELECT symbol, pos, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS x FROM q),
u AS ({wilder_sql('ru2', 14)} u e JOIN ru2 r ON r.symbol = e.symbol AND r.pos = e.pos + 1), v AS ({wilder_sql('rd', 14)} v e JOIN rd r ON r.symbol = e.symbol AND r.pos = e.pos + 1)
SELECT q.session, q.symbol, round(CASE WHEN u.c >= 14 AND v.c >= 14 THEN CASE WHEN v.m = 0 AND u.m > 0 THEN 100.0 ELSE 100 - 100 / (1 + u.m / nullif(v.m, 0)) END END, 6) + 0.0 AS x FROM q JOIN u USING (symbol, pos) JOIN v USING (symbol, pos)""")
def feat_rsi(spark, sf_dir):
    return features.add(market_panel(spark, sf_dir), "rsi(n=14)", "x").select("session", "symbol", out(F.col("x")).alias("x"))


@Q.query(f"""WITH RECURSIVE {PANEL_SQL}, {_POS}, rt AS (SELECT symbol, pos, CASE WHEN before IS NOT NULL AND close IS NOT NULL THEN greatest(high - low, abs(high - before), abs(low - before)) END AS x FROM q),
u AS ({wilder_sql('rt', 14)} u e JOIN rt r ON r.symbol = e.symbol AND r.pos = e.pos + 1)
SELECT q.session, q.symbol, round(CASE WHEN u.c >= 14 THEN u.m / close END, 6) + 0.0 AS x FROM q JOIN u USING (symbol, pos)""")
def feat_atr_pct(spark, sf_dir):
    return features.add(market_panel(spark, sf_dir), "atr(n=14)", "x").select("session", "symbol", out(F.col("x")).alias("x"))


@Q.query(f"""WITH {PANEL_SQL}, x AS (SELECT session, symbol, close / {_sma(20)} - 1 AS s, {_MOM} AS m,
  lead(open, 6) OVER ({S}) / lead(open, 1) OVER ({S}) - 1 AS label FROM panel)
SELECT symbol, count(label) AS n, round(avg(label), 6) + 0.0 AS mean_label, round(stddev_samp(label), 6) AS sd_label FROM x WHERE coalesce(s > 0 AND m > 0, false) GROUP BY symbol""")
def flagship_sma_signal(spark, sf_dir):
    """Does a close above its average, with momentum, tell the next five sessions' return?"""
    p = features.compute(market_panel(spark, sf_dir), {"s": "sma_ratio(n=20)", "m": "mom(lookback=60, skip=5)"})
    held = p.withColumn("label", P.forward_return(5)).where(signals.conditions([("s", ">", 0.0), ("m", ">", 0.0)]))
    return held.groupBy("symbol").agg(F.count("label").alias("n"), out(F.avg("label")).alias("mean_label"), F.round(F.stddev_samp("label"), 6).alias("sd_label"))
