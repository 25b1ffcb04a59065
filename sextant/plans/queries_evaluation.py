"""Queries: universes and calendars, evaluation of experiments, the registry's rules, option positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import options as O
from ..functions.windows import by_symbol, out
from ..operators import evaluation as E
from ..operators import measure, metrics, records, risk, security, validation
from ..operators.costs import PROFILES, profile
from ..operators.panel import forward_return, spine, with_market
from ..sources import vendors
from ..sources.adapters import ACTIONS_SQL, PANEL_SQL, bars_daily, corporate_actions, identifier_intervals, strategy_trades, table
from . import research_log as L
from .catalogue import Catalogue, normal_sql
from .queries_features import S, market_panel
from .queries_models import _CHAIN, _STATUS, _statuses, chain
from .queries_trading import _CANDIDATES, _FEAT, _REGIMES, _candidates, _features, _segment

Q = Catalogue()
_IV = "iv AS (SELECT user_id AS security_id, event_type AS value, min(ts)::DATE AS valid_from, max(ts)::DATE AS valid_to FROM events GROUP BY 1, 2)"
_SEC = "sec AS (SELECT symbol, min(session) AS a, max(session) - 100 AS b FROM bars GROUP BY symbol)"


# -- universes and calendars


@Q.query(f"WITH {_IV} SELECT security_id, value, valid_from, valid_to, row_number() OVER (PARTITION BY security_id ORDER BY valid_from, value) AS n FROM iv")
def identifier_history(spark, sf_dir):
    return security.history(identifier_intervals(spark, sf_dir).withColumnRenamed("id_value", "value"))


@Q.query("""WITH sec AS (SELECT user_id AS security_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY 1), d AS (SELECT DISTINCT ts::DATE AS date FROM events)
SELECT date, security_id FROM d JOIN sec ON date BETWEEN a AND b""")
def listed_on(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sec = e.groupBy(F.col("user_id").alias("security_id")).agg(F.to_date(F.min("ts")).alias("first_session"), F.to_date(F.max("ts")).alias("last_session"))
    return security.listed_on(sec, e.select(F.to_date("ts").alias("date")).distinct())


def _securities(bars):
    return bars.groupBy(F.col("symbol").alias("security_id")).agg(F.min("session").alias("first_session"), F.date_sub(F.max("session"), 100).alias("last_session"))


@Q.query(f"WITH {PANEL_SQL}, {_SEC} SELECT session, symbol, session BETWEEN a AND b AS listed FROM spine JOIN sec USING (symbol)")
def listed_mask(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return security.listed(spine(bars), _securities(bars)).select("session", "symbol", "listed")


_UNIVERSE = [("AF", None), ("RF", "1996-01-01"), ("ZZ", None)]


@Q.query(f"""WITH {PANEL_SQL}, u AS (SELECT * FROM (VALUES ('AF', NULL::DATE), ('RF', DATE '1996-01-01'), ('ZZ', NULL::DATE)) v(symbol, inception))
SELECT session, symbol, u.symbol IS NOT NULL AND session >= coalesce(inception, DATE '0001-01-01') AS member FROM spine LEFT JOIN u USING (symbol)""")
def static_universe_mask(spark, sf_dir):
    u = spark.createDataFrame(_UNIVERSE, "symbol string, inception string").withColumn("inception", F.col("inception").cast("date"))
    return security.static_mask(spine(bars_daily(spark, sf_dir)), u).select("session", "symbol", "member")


@Q.query("""SELECT c_custkey AS symbol FROM customer WHERE c_custkey % 3 <> 0 OR (DATE '1992-01-01' + (c_custkey % 3000)::INT) <= DATE '1996-06-30'""")
def static_universe_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    u = c.select(F.col("c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 3 == 0, F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int"))).alias("inception"))
    return security.static_members(u, "1996-06-30")


@Q.query(f"""WITH {PANEL_SQL}, u AS (SELECT * FROM (VALUES ('AF'), ('NO'), ('ZZ')) v(symbol)), d AS (SELECT DISTINCT session FROM panel)
SELECT d.session, u.symbol, round(p.close, 4) AS close FROM d CROSS JOIN u LEFT JOIN panel p ON p.session = d.session AND p.symbol = u.symbol""")
def restricted_panel(spark, sf_dir):
    u = spark.createDataFrame([("AF",), ("NO",), ("ZZ",)], "symbol string")
    return E.restrict(market_panel(spark, sf_dir), u).select("session", "symbol", F.round("close", 4).alias("close"))


@Q.query("""WITH s AS (SELECT DISTINCT l_shipdate::DATE AS s FROM lineitem WHERE dayofweek(l_shipdate::DATE) BETWEEN 1 AND 5), d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders),
a AS (SELECT date, x.s AS next_session FROM d ASOF LEFT JOIN s x ON d.date < x.s), b AS (SELECT date, y.s AS previous_session FROM d ASOF LEFT JOIN s y ON d.date > y.s)
SELECT date, s.s IS NOT NULL AS is_session, next_session, previous_session FROM a JOIN b USING (date) LEFT JOIN s ON s.s = date""")
def session_neighbours(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct().where(F.dayofweek("session").between(2, 6))
    return E.next_and_previous(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")), s)


@Q.query("""WITH s AS (SELECT session, row_number() OVER (ORDER BY session) AS p FROM (SELECT DISTINCT l_shipdate::DATE AS session FROM lineitem)), l AS (SELECT DISTINCT p_size * 60 AS lookback FROM part)
SELECT lookback::INT AS lookback, session FROM l LEFT JOIN s ON p = lookback + 1""")
def warmup_end(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct()
    return E.warmup_end(s, table(spark, sf_dir, "part").select((F.col("p_size") * 60).cast("int").alias("lookback")).distinct())


@Q.query("SELECT replace(upper(replace(s_name, '#', '.')), '.', '-') AS ticker, s_suppkey::BIGINT AS cik FROM supplier")
def ticker_map(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    entry = F.struct(F.col("s_suppkey").cast("string").alias("k"), F.struct(F.col("s_suppkey").cast("bigint").alias("cik_str"), F.translate("s_name", "#", ".").alias("ticker")).alias("v"))
    payloads = s.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return vendors.ticker_map(payloads)


@Q.query(f"""WITH {ACTIONS_SQL}, x AS (SELECT symbol, ex_date, CASE WHEN year(ex_date) = 1995 THEN 'merger' ELSE action END AS action, CASE WHEN year(ex_date) = 1996 THEN -value ELSE value END AS value FROM actions),
e AS (SELECT 'unknown_action' AS "check", symbol || ' ' || ex_date::VARCHAR AS e FROM x WHERE action NOT IN ('split', 'dividend') UNION ALL SELECT 'non_positive_value', symbol || ' ' || ex_date::VARCHAR FROM x WHERE value <= 0)
SELECT "check", 'ERROR' AS severity, count(*) AS n, (SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT DISTINCT f.e FROM e f WHERE f."check" = e."check" ORDER BY f.e LIMIT 5)) AS examples FROM e GROUP BY "check" """)
def validate_actions(spark, sf_dir):
    a = corporate_actions(bars_daily(spark, sf_dir))
    y = F.year("ex_date")
    a = a.withColumns({"action": F.when(y == 1995, "merger").otherwise(F.col("action")), "value": F.when(y == 1996, -F.col("value")).otherwise(F.col("value"))})
    return validation.validate_actions(a).where("n > 0")


# -- evaluation


@Q.query(f"""WITH {_CANDIDATES}, {_REGIMES} SELECT c.symbol, c.signal_session, round(f.sma, 6) + 0.0 AS sma, round(f.mom, 6) + 0.0 AS mom, l.trend, l.market_drawdown
FROM cand c LEFT JOIN f ON f.symbol = c.symbol AND f.session = c.signal_session LEFT JOIN labels l ON l.session = c.signal_session""")
def annotated_trades(spark, sf_dir):
    p = _features(spark, sf_dir)
    a = E.annotate(_candidates(spark, sf_dir), p, ["sma", "mom"], metrics.regime_labels(market_panel(spark, sf_dir), "AF"))
    return a.select("symbol", "signal_session", out(F.col("sma")).alias("sma"), out(F.col("mom")).alias("mom"), "trend", "market_drawdown")


@Q.query(f"""WITH {_CANDIDATES}, t AS (SELECT c.symbol, c.signal_session, f.mom AS x, c.gross_ret - c.cost_frac AS r FROM cand c JOIN f ON f.symbol = c.symbol AND f.session = c.signal_session WHERE f.mom IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x, signal_session) AS k, count(*) OVER (PARTITION BY symbol) AS n, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2.0 AS b FROM t),
rho AS (SELECT symbol, corr(a, b) AS rho FROM k GROUP BY 1 HAVING count(DISTINCT x) >= 5)
SELECT symbol, greatest(1, ceil((k - 1) * 5 / (n - 1)))::INT AS bucket, count(*) AS n, round(avg(r), 6) + 0.0 AS mean, round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi, round(any_value(rho), 6) + 0.0 AS rho FROM k JOIN rho USING (symbol) WHERE n >= 50 GROUP BY 1, 2""")
def signal_strength(spark, sf_dir):
    t = E.annotate(_candidates(spark, sf_dir), _features(spark, sf_dir), ["mom"])
    g = E.signal_strength(t, ["symbol"], "mom", "net_ret", ["signal_session"])
    return g.select("symbol", "bucket", "n", *[out(F.col(c)).alias(c) for c in ("mean", "lo", "hi", "rho")])


@Q.query("""SELECT l_suppkey AS experiment, round(avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax), 6) + 0.0 AS sharpe FROM lineitem GROUP BY 1""")
def trial_sharpes(spark, sf_dir):
    """Sharpe ratios out of the experiments' JSON results."""
    t = strategy_trades(spark, sf_dir).groupBy("l_suppkey").agg((F.avg("ret") / F.stddev_samp("ret")).alias("s"))
    logged = t.select(F.col("l_suppkey").alias("experiment"), F.to_json(F.struct(F.struct(F.struct(F.col("s").alias("sharpe")).alias("net")).alias("train"))).alias("results"))
    return logged.select("experiment", out(records.dig(F.col("results"), "train.net.sharpe").cast("double")).alias("sharpe"))


@Q.query("""WITH p AS (SELECT l_suppkey, (l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 1009 / 1009.0::DOUBLE AS prob, (l_discount > l_tax)::INT AS label, l_orderkey, l_linenumber, l_partkey FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY prob, l_orderkey, l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM p)
SELECT l_suppkey, greatest(1, ceil((k - 1) * 10 / (n - 1)))::INT AS bin, count(*) AS n, round(avg(prob), 6) AS predicted, round(avg(label), 6) AS realised FROM k GROUP BY 1, 2""")
def calibration_table(spark, sf_dir):
    prob = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_linenumber")) % 1009) / F.lit(1009.0)
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", prob.alias("prob"), (F.col("l_discount") > F.col("l_tax")).alias("label"), "l_orderkey", "l_linenumber", "l_partkey")
    return E.calibration(p, ["l_suppkey"], "prob", "label", ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "bin", "n", F.round("predicted", 6).alias("predicted"), F.round("realised", 6).alias("realised"))


@Q.query("""WITH p AS (SELECT l_suppkey, (l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 1009 / 1009.0::DOUBLE AS prob, (l_discount > l_tax)::INT AS label, l_discount - l_tax AS ret FROM lineitem)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (prob >= 0.55) AS taken, round(avg(ret - 0.001) FILTER (prob >= 0.55), 6) + 0.0 AS net_mean, round(avg(ret - 0.001), 6) + 0.0 AS always_mean, round(avg(label) FILTER (prob >= 0.55), 6) AS hit_rate, round(avg(label), 6) AS base_rate, round(avg(power(prob - label, 2)), 6) AS brier FROM p GROUP BY 1""")
def evaluate_predictions(spark, sf_dir):
    prob = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_linenumber")) % 1009) / F.lit(1009.0)
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", prob.alias("prob"), (F.col("l_discount") > F.col("l_tax")).cast("int").alias("label"), (F.col("l_discount") - F.col("l_tax")).alias("ret"))
    return risk.evaluate_predictions(p, ["l_suppkey"], 0.001).select("l_suppkey", "n", "taken", *[out(F.col(c)).alias(c) for c in ("net_mean", "always_mean", "hit_rate", "base_rate", "brier")])


@Q.query(f"""WITH {PANEL_SQL}, x AS (SELECT symbol, session, lag(close, 5) OVER ({S}) / lag(close, 60) OVER ({S}) - 1 AS s, lead(open, 6) OVER ({S}) / lead(open, 1) OVER ({S}) - 1 AS l FROM panel),
y AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY s) + (count(*) OVER (PARTITION BY symbol, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY l) + (count(*) OVER (PARTITION BY symbol, l) - 1) / 2.0 AS b FROM x WHERE s IS NOT NULL AND l IS NOT NULL)
SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 11 THEN corr(a, b) END, 6) + 0.0 AS ic FROM y GROUP BY symbol""")
def time_series_ic(spark, sf_dir):
    w = by_symbol()
    p = market_panel(spark, sf_dir).withColumns({"s": F.lag("close", 5).over(w) / F.lag("close", 60).over(w) - 1, "l": forward_return(5)})
    return E.time_series_ic(p, ["symbol"], "s", "l").select("symbol", "n", out(F.col("ic")).alias("ic"))


_EXPERIMENTS = "ex AS (SELECT l_partkey AS id, row(l_orderkey, l_linenumber, l_suppkey) AS seq, ((l_orderkey * 7919 + l_linenumber * 31) % 9973 + 1) / 1000000.0::DOUBLE AS p FROM lineitem WHERE l_shipdate >= DATE '1997-01-01')"


def _experiments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= DATE '1997-01-01'")
    return li.select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"), (((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 9973 + 1) / F.lit(1000000.0)).alias("p"))


@Q.query(f"""WITH {_EXPERIMENTS}, las AS (SELECT id, arg_max(p, seq) AS p FROM ex GROUP BY 1), h AS (SELECT p_partkey AS id, p_brand AS family, coalesce(p, 1.0) AS p FROM part LEFT JOIN las ON las.id = p_partkey),
r AS (SELECT *, count(*) OVER (PARTITION BY family)::DOUBLE AS m, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k FROM h)
SELECT id, family, round(p, 8) AS p, round(least(min(p * m / k) OVER (PARTITION BY family ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * list_sum(list_transform(range(1, m::BIGINT + 1), lambda i: 1.0 / i)), 1), 8) AS q FROM r""")
def family_pvalues(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"))
    return E.family_pvalues(h, _experiments(spark, sf_dir)).select("id", "family", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@Q.query("SELECT p_brand AS family, count(*) AS n FROM part GROUP BY 1")
def family_size(spark, sf_dir):
    return records.counts(table(spark, sf_dir, "part"), ["p_brand"]).select(F.col("value").alias("family"), "n")


@Q.query("""SELECT p_partkey, round(greatest(CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 7919 % 9973 + 1) / 10000.0 END, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey * 104729 % 9973 + 1) / 10000.0 END)::DOUBLE, 6) AS p FROM part""")
def effective_p(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = F.when(k % 17 != 0, (k * 7919 % 9973 + 1) / F.lit(10000.0)), F.when(k % 5 != 0, (k * 104729 % 9973 + 1) / F.lit(10000.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(E.effective_p(a, b), 6).alias("p"))


@Q.query("""WITH m AS (SELECT p_brand, p_size, avg(l_discount - l_tax - 0.01037) AS mean FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), g AS (SELECT DISTINCT p_brand, p_size FROM part), d AS (SELECT unnest([-1, 1]) AS d)
SELECT g.p_brand || '/' || g.p_size AS id, count(*) AS n, round(avg((coalesce(m.mean, -1) > 0)::INT), 6) AS share FROM g CROSS JOIN d LEFT JOIN m ON m.p_brand = g.p_brand AND m.p_size = g.p_size + d GROUP BY 1""")
def neighbour_share(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = lambda size: F.concat_ws("/", "p_brand", size.cast("string"))
    h = part.select("p_brand", "p_size").distinct()
    near = h.select(name(F.col("p_size")).alias("id"), F.explode(F.array(name(F.col("p_size") - 1), name(F.col("p_size") + 1))).alias("neighbour"))
    t = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    means = t.groupBy(name(F.col("p_size")).alias("id")).agg(F.avg(F.col("l_discount") - F.col("l_tax") - 0.01037).alias("mean"))
    return E.neighbour_share(h.select(name(F.col("p_size")).alias("id")), near, means).select("id", "n", F.round("share", 6).alias("share"))


@Q.query(f"WITH {PANEL_SQL} SELECT symbol, round(avg(ret) / stddev_samp(ret), 6) + 0.0 AS sr, count(ret) AS n, round(skewness(ret), 5) + 0.0 AS skew, round(kurtosis(ret) + 3, 4) AS kurt FROM panel WHERE ret IS NOT NULL AND session <= DATE '1997-12-31' GROUP BY 1")
def deflated_sharpe_inputs(spark, sf_dir):
    s = E.sharpe_inputs(market_panel(spark, sf_dir).where("session <= DATE '1997-12-31'"), ["symbol"])
    return s.select("symbol", out(F.col("sr")).alias("sr"), "n", out(F.col("skew"), 5).alias("skew"), F.round("kurt", 4).alias("kurt"))


@Q.query(f"""WITH {PANEL_SQL}, b AS (SELECT session, avg(ret) AS bench FROM panel GROUP BY 1), d AS (SELECT symbol AS param, ret - bench AS e FROM panel JOIN b USING (session))
SELECT param, count(e) AS n, round(avg(e) * 252, 6) + 0.0 AS annual_excess, round(avg(e) / stddev_samp(e) * sqrt(252), 6) + 0.0 AS information FROM d GROUP BY 1""")
def excess_over_benchmark(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    bench = p.groupBy("session").agg(F.avg("ret").alias("bench"))
    return measure.excess_over(p.select("session", F.col("symbol").alias("param"), "ret"), bench).select("param", "n", out(F.col("annual_excess")).alias("annual_excess"), out(F.col("information")).alias("information"))


@Q.query("""WITH t AS (SELECT l_suppkey AS id, avg(l_discount - l_tax) FILTER (l_shipdate < DATE '1997-01-01') AS train, avg(l_discount - l_tax) AS dev, count(*) // 5 AS n FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN train IS NULL OR n < 100 THEN 'INCONCLUSIVE' WHEN (id * 37 % 100) / 400.0 < 0.1 AND sign(dev) = sign(train) THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS outcome FROM t""")
def measurement_outcomes(spark, sf_dir):
    x = F.col("l_discount") - F.col("l_tax")
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg(F.when(F.col("l_shipdate") < F.lit("1997-01-01").cast("date"), x)).alias("train"), F.avg(x).alias("dev"), F.floor(F.count(F.lit(1)) / 5).alias("n"))
    status = F.when(F.col("train").isNotNull(), "OK")
    return t.select("id", E.measurement_outcome(status, F.col("n"), (F.col("id") * 37 % 100) / F.lit(400.0), F.col("train"), F.lit("OK"), F.col("dev"), 100).alias("outcome"))


@Q.query("""WITH t AS (SELECT l_suppkey, l_discount - l_tax AS r FROM lineitem), g AS (SELECT l_suppkey, count(*) AS n, quantile_cont(r, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, avg(r) AS m FROM t GROUP BY 1)
SELECT l_suppkey, n, round(q[1], 6) + 0.0 AS q05, round(q[2], 6) + 0.0 AS q25, round(q[3], 6) + 0.0 AS q50, round(q[4], 6) + 0.0 AS q75, round(q[5], 6) + 0.0 AS q95, round(m / 2, 6) + 0.0 AS shrunk FROM g""")
def predicted_distribution(spark, sf_dir):
    g = E.predicted_distribution(strategy_trades(spark, sf_dir), ["l_suppkey"], "ret")
    return g.select("l_suppkey", "n", *[out(F.col(c)).alias(c) for c in ("q05", "q25", "q50", "q75", "q95", "shrunk")])


_ADV = "adv AS (SELECT symbol, avg(dollar_volume) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM panel) WHERE k <= 20 GROUP BY 1)"


@Q.query(f"WITH {PANEL_SQL}, {_ADV} SELECT symbol, round(adv, 4) AS adv FROM adv")
def latest_adv(spark, sf_dir):
    return E.latest_adv(market_panel(spark, sf_dir)).select("symbol", F.round("adv", 4).alias("adv"))


@Q.query(f"""WITH {_CANDIDATES}, {_ADV}, h AS (SELECT symbol, avg(gross_ret - cost_frac) / 2 AS shrunk, count(*) AS n FROM cand GROUP BY 1),
x AS (SELECT f.symbol, f.session, h.shrunk, adv, CASE WHEN h.n > 1 AND h.shrunk > 0 THEN 1000.0 ELSE 0.0 END AS notional FROM f JOIN (SELECT max(session) AS session FROM panel) USING (session) LEFT JOIN h USING (symbol) LEFT JOIN adv USING (symbol) WHERE sma > -1)
SELECT symbol, session, round(shrunk, 6) + 0.0 AS shrunk, round(CASE WHEN notional > 0 THEN greatest(0, least(notional, coalesce(0.01 * adv, 'inf'::DOUBLE))) ELSE 0 END, 4) AS allowed FROM x""")
def current_opportunities(spark, sf_dir):
    o = E.opportunities(_features(spark, sf_dir), [("sma", ">", -1.0)], _candidates(spark, sf_dir))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    state = {"equity": F.lit(10_000.0), "cash": F.lit(10_000.0), "held": zero, "gross": zero, "sector_value": zero, "beta": F.lit(1.0), "beta_exposure": zero, "drawdown": zero, "var95": none, "event_risk": F.lit(False), "event_value": zero, "loss_share": none, "vega_share": none}
    g = risk.gate(o.withColumns(state))
    return g.select("symbol", "session", out(F.col("shrunk")).alias("shrunk"), F.round("allowed", 4).alias("allowed"))


def _template_sql(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS template, symbol, count(*) AS n, round(avg(gross_ret), 5) + 0.0 AS mean FROM ({rows}) GROUP BY 2"


@Q.query(" UNION ALL ".join([
    _template_sql("threshold_event", f"WITH {_CANDIDATES} SELECT symbol, gross_ret FROM cand"), _template_sql("segment_hold", _segment("overnight")),
    _template_sql("state_position", f"""WITH {PANEL_SQL}, {_FEAT}, o AS (SELECT *, coalesce(sma > 0, false) AS w FROM f),
n AS (SELECT *, lead(open) OVER ({S}) AS ip, lead(open, 2) OVER ({S}) AS xp, (w AND NOT coalesce(lag(w) OVER ({S}), false))::INT AS st FROM o), g AS (SELECT *, sum(st) OVER ({S}) AS spell FROM n)
SELECT symbol, arg_max(coalesce(xp, -1e9), session) / arg_min(coalesce(ip, -1e-9), session) - 1 AS gross_ret FROM g WHERE w GROUP BY symbol, spell HAVING arg_max(coalesce(xp, -1e9), session) > 0 AND arg_min(coalesce(ip, -1e-9), session) > 0""")]))
def run_strategy(spark, sf_dir):
    """Three templates by name over one panel."""
    p = _features(spark, sf_dir)
    wanted = {
        "threshold_event": ({"conditions": [("sma", ">", 0.05)], "on_transition": True}, "retail_largecap"), "segment_hold": ({"segment": "overnight"}, "retail_etf"), "state_position": ({"conditions": [("sma", ">", 0.0)]}, "retail_etf")}
    runs = [E.run_strategy(p, n, params, profile(costs)).withColumn("template", F.lit(n)) for n, (params, costs) in wanted.items()]
    both = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return both.groupBy("template", "symbol").agg(F.count(F.lit(1)).alias("n"), out(F.avg("gross_ret"), 5).alias("mean"))


@Q.query(f"WITH {PANEL_SQL}, e AS (SELECT session, symbol, product(1 + ret) OVER ({S} ROWS UNBOUNDED PRECEDING) AS equity FROM panel WHERE ret IS NOT NULL) SELECT session, symbol, round(equity, 5) AS equity, round(equity / max(equity) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1, 5) + 0.0 AS drawdown FROM e")
def equity_drawdown(spark, sf_dir):
    return E.equity_and_drawdown(market_panel(spark, sf_dir)).select("session", "symbol", F.round("equity", 5).alias("equity"), out(F.col("drawdown"), 5).alias("drawdown"))


@Q.query(f"WITH {PANEL_SQL} SELECT p.symbol, count(*) AS n, round(covar_samp(p.ret, k.ret) / var_samp(k.ret), 6) + 0.0 AS beta FROM panel p JOIN (SELECT session, ret FROM panel WHERE symbol = 'AF') k USING (session) WHERE p.ret IS NOT NULL AND k.ret IS NOT NULL GROUP BY 1")
def market_beta(spark, sf_dir):
    return E.market_beta(with_market(market_panel(spark, sf_dir), "AF")).select("symbol", "n", out(F.col("beta")).alias("beta"))


_MOMENTS = "g AS (SELECT l_suppkey, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s, skewness(l_discount - l_tax) AS sk, kurtosis(l_discount - l_tax) AS k, count(*) AS n FROM lineitem GROUP BY 1)"


def _moments(spark, sf_dir):
    x = F.col("ret")
    return strategy_trades(spark, sf_dir).groupBy("l_suppkey").agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), metrics.skew(x).alias("sk"), metrics.kurtosis(x).alias("k"), F.count(x).alias("n"))


@Q.query(f"""WITH {_MOMENTS}, z AS (SELECT *, -1.6448536269514729 AS z FROM g) SELECT l_suppkey, round(1.6448536269514722 * s - m, 6) + 0.0 AS var, round(s * 0.10313564037537139 / 0.05 - m, 6) + 0.0 AS es,
 round(-(m + (z + (z * z - 1) * sk / 6 + (power(z, 3) - 3 * z) * k / 24 - (2 * power(z, 3) - 5 * z) * sk * sk / 36) * s), 6) + 0.0 AS modified FROM z""")
def parametric_var(spark, sf_dir):
    m, s, sk, k = (F.col(c) for c in ("m", "s", "sk", "k"))
    var, es = risk.parametric_var_es(m, s)
    return _moments(spark, sf_dir).select("l_suppkey", out(var).alias("var"), out(es).alias("es"), out(risk.cornish_fisher_var(m, s, sk, k)).alias("modified"))


@Q.query(f"""WITH {_MOMENTS}, k AS (SELECT *, m / (s * s) AS kelly FROM g), f AS (SELECT *, CASE WHEN n < 30 THEN 0.0 ELSE greatest(least(kelly * 0.25, 0.2), 0.0) END AS f FROM k),
d AS (SELECT *, 0.5 * m - 0.125 * s * s AS dm, 0.5 * s AS ds FROM f) SELECT l_suppkey, round(f, 6) AS recommended, round(CASE WHEN dm <= 0 THEN 1.0 ELSE exp(2 * dm * ln(0.5) / (ds * ds)) END, 6) AS ruin FROM d""")
def position_sizing(spark, sf_dir):
    m, s, n = F.col("m"), F.col("s"), F.col("n")
    return _moments(spark, sf_dir).select("l_suppkey", F.round(risk.recommended_fraction(risk.kelly_gaussian(m, s), n), 6).alias("recommended"), F.round(risk.ruin_probability(m, s, F.lit(0.5)), 6).alias("ruin"))


@Q.query(f"""WITH {_MOMENTS} SELECT l_suppkey, round(CASE WHEN l_suppkey % 7 <> 0 THEN m / 2 * CASE l_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 0.5 END * CASE WHEN l_suppkey % 5 = 0 THEN 1.0 ELSE 0.8 END ELSE 0.0 END, 8) + 0.0 AS edge FROM g""")
def adjusted_edges(spark, sf_dir):
    k = F.col("l_suppkey")
    s = _moments(spark, sf_dir).select("l_suppkey", F.col("m").alias("mean"), (F.col("s") / F.sqrt("n")).alias("se"), F.when(k % 4 == 0, "STABLE").when(k % 4 == 1, "WEAKENED").when(k % 4 == 2, "DISAPPEARED").alias("stability"), F.when(k % 5 != 0, 0.8).alias("regime_factor"), (k % 7 != 0).alias("active"))
    return risk.adjusted_edges(s).select("l_suppkey", out(F.col("edge"), 8).alias("edge"))


@Q.query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN 'option' ELSE 'equity' END AS kind, l_quantity - 25 AS q, (l_orderkey % 40)::DOUBLE AS held FROM lineitem)
SELECT *  EXCLUDE (kind, q, held), concat_ws('; ', CASE WHEN kind <> 'option' AND held + q < 0 THEN 'short stock' END, CASE WHEN kind = 'option' AND q < 0 AND l_suppkey % 3 <> 0 THEN 'undefined risk' END, CASE WHEN kind = 'option' AND q > 0 AND l_orderkey % 11 = 0 THEN 'no largest loss' END) AS why FROM t""")
def risk_refusals(spark, sf_dir):
    option, q = F.col("l_partkey") % 2 == 0, F.col("l_quantity") - 25
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(option, "option").otherwise("equity").alias("kind"), q.alias("quantity"), (F.col("l_orderkey") % 40).cast("double").alias("existing"),
        (option & (q < 0)).alias("short_option"), (F.col("l_suppkey") % 3 == 0).alias("defined_risk"), F.when(F.col("l_orderkey") % 11 != 0, 1.0).alias("max_loss"))
    return risk.refusals(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "why")


@Q.query(f"""WITH k AS (SELECT unnest([0.0, 1.0, 2.0])::DOUBLE AS k) SELECT l_returnflag, k, round(sum(2 * (CASE WHEN l_extendedprice > 0 THEN (2 + 2) * k / 1e4 + 0.1 * k * 0.02 * sqrt(least(l_extendedprice / 1000000.0, 1)) ELSE 0 END + greatest(1.0 * k, 0.005 * k * l_quantity) / l_extendedprice)) / 1000, 6) AS cost_k FROM lineitem, k GROUP BY 1, 2""")
def commissions(spark, sf_dir):
    """Round trips of every line item under a broker that takes a fee per share, at three multiples."""
    li = table(spark, sf_dir, "lineitem")
    x = F.col("l_extendedprice")
    base = PROFILES["per_share_broker"]
    parts = []
    for k, costs in ((0.0, base.zero()), (1.0, base), (2.0, base.scaled(2.0))):
        c = costs.round_trip(x, x / F.col("l_quantity"), F.lit(1_000_000.0), F.lit(None).cast("double"))
        parts.append(li.groupBy("l_returnflag").agg(F.round(F.sum(c) / 1000, 6).alias("cost_k")).withColumn("k", F.lit(k)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("l_returnflag", "k", "cost_k")


# -- the registry's rules


@Q.query("SELECT c_custkey AS entity_id, c_name AS name, arg_max(o_orderstatus, o_orderkey) AS to_status, max(o_orderkey) AS status_seq FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def hypotheses_with_status(spark, sf_dir):
    h = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("to_status"), F.col("o_orderkey").alias("seq"))
    return L.with_status(h, e)


@Q.query(f"WITH {_STATUS}, c AS (SELECT entity_id, arg_max(to_status, seq) AS now, max(seq) FILTER (to_status = 'REJECTED') AS status_seq FROM st GROUP BY 1) SELECT entity_id, status_seq FROM c WHERE now = 'REJECTED'")
def rejected_signals(spark, sf_dir):
    e = _statuses(spark, sf_dir)
    now = L.current_status(e).where("to_status = 'REJECTED'").select("entity_id")
    return L.with_status(now, e, "REJECTED").select("entity_id", "status_seq")


@Q.query(f"WITH {_STATUS} SELECT entity_id, seq, to_status FROM st QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1")
def all_signals(spark, sf_dir):
    from ..operators.pit import latest_per_key

    return latest_per_key(_statuses(spark, sf_dir), ["entity_id"], ["seq"]).select("entity_id", "seq", "to_status")


@Q.query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def journal(spark, sf_dir):
    return records.find(table(spark, sf_dir, "events"), {}, "event_id", True, 50).select("event_id", "event_type")


@Q.query("SELECT user_id AS signal_id, event_id, value FROM events WHERE event_type = 'purchase'")
def forward_results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return records.find(e, {"event_type": "purchase"}, "event_id").select(F.col("user_id").alias("signal_id"), "event_id", "value")


@Q.query(f"""WITH {PANEL_SQL}, c AS (SELECT a.symbol AS sym_a, b.symbol AS sym_b, corr(a.ret, b.ret) AS rho FROM panel a JOIN panel b ON a.session = b.session AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)
SELECT sym_a, sym_b, round(rho, 6) + 0.0 AS rho FROM c ORDER BY abs(rho), sym_a, sym_b LIMIT 5""")
def least_correlated_pairs(spark, sf_dir):
    from .queries_joins import pair_correlations

    return pair_correlations(spark, sf_dir).orderBy(F.abs("rho"), "sym_a", "sym_b").limit(5).select("sym_a", "sym_b", "rho")


@Q.query("""WITH b AS (SELECT p_partkey AS id, sha256(concat_ws('|', p_brand, p_size::VARCHAR)) AS h, p_partkey % 9 = 0 AS loose, CASE WHEN p_partkey % 2 = 0 THEN 'small sample' ELSE ' ' END AS why FROM part),
r AS (SELECT *, loose AND trim(why) = '' AS refused, h IN (SELECT sha256(concat_ws('|', p_brand, p_size::VARCHAR)) FROM part WHERE p_size <= 10) AS old FROM b)
SELECT id, CASE WHEN refused THEN 'REFUSED' WHEN old OR row_number() OVER (PARTITION BY h, refused ORDER BY id) > 1 THEN 'DUPLICATE' ELSE 'REGISTERED' END AS verdict FROM r""")
def register_batch(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.select(F.col("p_partkey").alias("id"), L.spec_hash(F.col("p_brand"), F.col("p_size")).alias("spec_hash"), (F.col("p_partkey") % 9 == 0).alias("loosened"), F.when(F.col("p_partkey") % 2 == 0, "small sample").otherwise(" ").alias("justification"))
    old = p.where("p_size <= 10").select(L.spec_hash(F.col("p_brand"), F.col("p_size")).alias("spec_hash"))
    return L.register(old, b, ["id"]).select("id", "verdict")


@Q.query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' ELSE 'CHANGED' END AS why FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0""")
def not_registered(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    specs = p.select(F.col("p_partkey").alias("id"), L.spec_hash(F.col("p_brand"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("spec_hash"))
    known = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), L.spec_hash(F.col("p_brand"), F.col("p_size")).alias("spec_hash"))
    return L.not_registered(specs, known)


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, bs in L.TRANSITIONS.items() for b in bs)


@Q.query(f"""WITH {_STATUS}, l AS (SELECT *, lag(to_status) OVER (PARTITION BY entity_id ORDER BY seq) AS f FROM st)
SELECT entity_id, seq, CASE WHEN f || '>' || to_status NOT IN ({_ALLOWED}) THEN 'NOT_ALLOWED' WHEN to_status IN ('PAPER_TRADING', 'LIVE_ELIGIBLE') AND seq % 3 = 0 THEN 'NEEDS_APPROVAL'
 WHEN to_status IN ('ACCEPTED', 'PAPER_TRADING', 'LIVE_ELIGIBLE') AND entity_id % 4 = 0 THEN 'BLOCKED' ELSE 'OK' END AS verdict FROM l WHERE f IS NOT NULL""")
def transition_verdicts(spark, sf_dir):
    from pyspark.sql import Window

    e = _statuses(spark, sf_dir).withColumn("from_status", F.lag("to_status").over(Window.partitionBy("entity_id").orderBy("seq"))).where("from_status IS NOT NULL")
    e = e.withColumns({"approved_by": F.when(F.col("seq") % 3 != 0, "someone"), "grade": F.when(F.col("entity_id") % 4 != 0, "RESEARCH_GRADE").otherwise("BIASED / LOOK-AHEAD")})
    return L.transition_verdicts(e).select("entity_id", "seq", "verdict")


_LIFE = "lf AS (SELECT user_id AS entity_id, event_id AS seq, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS p FROM events)"


@Q.query(f"WITH {_LIFE}, b AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY entity_id ORDER BY seq), -1) AS b FROM lf) SELECT entity_id, seq FROM b WHERE p <> b + 1")
def backward_steps(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for kv in zip(("view", "click", "signup", "purchase", "error"), L.LIFECYCLE) for x in kv])
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), m[F.col("event_type")].alias("to_status"))
    return L.backward_steps(e)


def _vault(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "EVALUATED").when(F.col("event_type") != "view", "FROZEN")
    return e.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("event_id") % 2 == 0).alias("acknowledged"))


@Q.query("""WITH v AS (SELECT user_id AS entity_id, event_id AS seq, event_type NOT IN ('error', 'view') AS frozen FROM events), b AS (SELECT *, coalesce(sum(frozen::INT) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
SELECT entity_id, seq, CASE WHEN NOT frozen THEN 'REFUSED' WHEN before = 0 THEN 'OPENED' WHEN seq % 2 = 0 THEN 'CONTAMINATED' ELSE 'REFUSED' END AS verdict FROM b""")
def vault_accesses(spark, sf_dir):
    return L.vault_accesses(_vault(spark, sf_dir)).select("entity_id", "seq", "verdict")


def _records(spark, sf_dir):
    """A record version for each supplier and year of its trades."""
    t = strategy_trades(spark, sf_dir).groupBy(F.col("l_suppkey").alias("signal_id"), F.year("entry").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    k, v = F.col("signal_id"), F.col("version")
    none = F.array().cast("array<string>")
    return t.select(
        "signal_id", "version", F.when(k % 6 == 0, F.array(F.lit("MODEL_PRICED"), F.lit("OTHER"))).otherwise(none).alias("flags"), F.when(k % 10 == 1, F.array(F.lit("negative_volume"), F.lit("strange"))).alias("failed_checks"),
        F.when((k + v) % 9 == 0, 2).alias("lookahead_failures"), (k % 13 == 0).alias("contaminated"), F.lit(None).cast("boolean").alias("leakage"), F.when(k % 8 != 0, (k % 4).cast("double")).alias("frictions"),
        F.when(k % 5 == 0, 0.2).alias("participation"), F.when(v % 2 == 0, "next_open").when(k % 7 == 0, "same_close").alias("execution"), F.col("n").alias("effective_n"), F.lit(0.01).alias("p"), F.when(k % 3 != 0, (k % 3) / F.lit(15.0)).alias("q"))


_AUTO = """r AS (SELECT l_suppkey AS k, year(l_shipdate) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
fd AS (SELECT k, v, 'UNRELIABLE_PRICES' AS category FROM r WHERE k % 6 = 0 OR k % 10 = 1 UNION ALL SELECT k, v, 'OTHER_DEFECT' FROM r WHERE k % 10 = 1 UNION ALL SELECT k, v, 'LOOK_AHEAD_BIAS' FROM r WHERE (k + v) % 9 = 0
 UNION ALL SELECT k, v, 'TEST_CONTAMINATION' FROM r WHERE k % 13 = 0 UNION ALL SELECT k, v, 'MISSING_COSTS' FROM r WHERE k % 8 <> 0 AND k % 4 = 0 UNION ALL SELECT k, v, 'UNREALISTIC_EXECUTION' FROM r WHERE (k % 8 <> 0 AND k % 5 = 0) OR (v % 2 <> 0 AND k % 7 = 0)
 UNION ALL SELECT k, v, 'INADEQUATE_SAMPLE' FROM r WHERE n < 30 UNION ALL SELECT k, v, 'UNCORRECTED_MULTIPLE_TESTING' FROM r WHERE k % 3 = 0 UNION ALL SELECT k, v, 'INSUFFICIENT_SIGNIFICANCE' FROM r WHERE k % 3 = 2)"""


@Q.query(f"WITH {_AUTO} SELECT k AS signal_id, v AS version, category, 'MATERIAL' AS severity FROM fd")
def automatic_findings(spark, sf_dir):
    return L.automatic_findings(_records(spark, sf_dir), ["signal_id", "version"])


def _grade_sql(groups: str) -> str:
    """The grade of (k, category) rows as SQL, from the fixed tables."""
    order = ", ".join(f"('{c}', {i}, '{label}', {str(c in L.LACKING).lower()}, {str(c in L.WRONG).lower()})" for i, (c, label) in enumerate(L.FINDINGS.items()))
    part = lambda lacks: f"coalesce(string_agg(label, '+' ORDER BY place) FILTER (lacks = {lacks}), '')"
    return f"""SELECT k, count(*) AS n_findings, CASE WHEN {part('false')} = '' AND {part('true')} = '' THEN 'RESEARCH_GRADE' ELSE concat_ws('; ', CASE WHEN {part('false')} <> '' THEN CASE WHEN bool_or(wrong) THEN 'BIASED' ELSE 'PRELIMINARY' END || ' / ' || {part('false')} END,
 CASE WHEN {part('true')} <> '' THEN 'INSUFFICIENT_EVIDENCE / ' || {part('true')} END) END AS grade FROM ({groups}) JOIN (VALUES {order}) t(category, place, label, lacks, wrong) USING (category) GROUP BY k"""


@Q.query(f"""WITH {_AUTO}, a AS (SELECT DISTINCT k, category FROM fd UNION SELECT s_suppkey, 'INCOMPLETE_UNIVERSE' FROM supplier WHERE s_suppkey % 11 = 0), g AS ({_grade_sql('SELECT k, category FROM a')})
SELECT s_suppkey AS signal_id, coalesce(n_findings, 0) AS n_findings, coalesce(grade, 'RESEARCH_GRADE') AS grade FROM supplier LEFT JOIN g ON k = s_suppkey""")
def assessed_signals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("signal_id"))
    manual = s.where("signal_id % 11 = 0").select("signal_id", F.lit("INCOMPLETE_UNIVERSE").alias("category"), F.lit("MATERIAL").alias("severity"))
    return L.assess(L.automatic_findings(_records(spark, sf_dir), ["signal_id"]), manual, s, ["signal_id"])


@Q.query("""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'signup', 'purchase') THEN 'UNKNOWN_CATEGORY' WHEN event_id % 6 = 0 THEN 'UNKNOWN_SEVERITY' WHEN event_id % 10 = 3 THEN 'INCOMPLETE' ELSE 'RAISED' END AS verdict FROM events""")
def raised_findings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.create_map(*[F.lit(x) for x in ("click", "DATA_LEAKAGE", "signup", "OTHER_DEFECT", "purchase", "MISSING_COSTS", "view", "NO_SUCH")])
    f = e.select("event_id", m[F.col("event_type")].alias("category"), F.when(F.col("event_id") % 6 != 0, F.when(F.col("event_id") % 2 == 0, "MINOR").otherwise("MATERIAL")).alias("severity"), F.when(F.col("event_id") % 10 == 3, "  ").otherwise("seen").alias("detail"), F.lit("me").alias("raised_by"))
    return L.raise_verdicts(f).select("event_id", "verdict")


@Q.query("""WITH r AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'), d AS (SELECT s.user_id, max(s.event_id) AS last FROM events s WHERE event_type = 'click' GROUP BY 1)
SELECT r.event_id AS finding_id FROM r LEFT JOIN d USING (user_id) WHERE NOT coalesce(last > r.event_id, false)""")
def unresolved_findings(spark, sf_dir):
    """Findings that no later experiment has resolved; a user's clicks are experiments that claim to resolve all of the user's findings."""
    e = table(spark, sf_dir, "events")
    raised = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("finding_id"), F.col("event_id").alias("seq"))
    last = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("experiment_id"))
    resolved = raised.join(last, "user_id").select("finding_id", "experiment_id")
    return L.open_findings(raised, resolved, last.select("experiment_id", F.col("experiment_id").alias("seq"))).select("finding_id")


_CRIT = ["min_effective_n_accept", "fdr_q", "dsr_min_prob", "max_participation"]


@Q.query("""WITH c AS (SELECT p_partkey AS id, unnest(['min_effective_n_accept', 'fdr_q', 'dsr_min_prob', 'max_participation']) AS name, unnest([100.0 + p_size - 25, 0.002 * p_size, 0.9 + p_size / 500.0, p_size / 200.0]::DOUBLE[]) AS value FROM part),
d AS (SELECT * FROM (VALUES ('min_effective_n_accept', 100.0, -1), ('fdr_q', 0.1, 1), ('dsr_min_prob', 0.95, -1), ('max_participation', 0.1, 1)) v(name, dv, s))
SELECT id, name, round(value, 6) AS value FROM c JOIN d USING (name) WHERE s * (value - dv) > 1e-12""")
def loosened_criteria(spark, sf_dir):
    size = F.col("p_size")
    values = [100.0 + size - 25, 0.002 * size, 0.9 + size / F.lit(500.0), size / F.lit(200.0)]
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in zip(_CRIT, values)])).alias("c")).select("id", "c.name", "c.value")
    return L.loosened(c, ["id"]).select("id", "name", F.round("value", 6).alias("value"))


@Q.query("""WITH pl AS (SELECT user_id AS family, event_id AS seq FROM events WHERE event_type = 'signup'), ex AS (SELECT user_id AS family, min(event_id) AS f FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT family, seq, row_number() OVER (PARTITION BY family ORDER BY seq) AS n, coalesce(f < seq, false) AS late FROM pl LEFT JOIN ex USING (family)""")
def split_plans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("family"), F.col("event_id").alias("seq"), "event_type")
    return L.split_plans(e.where("event_type = 'signup'").drop("event_type"), e.where("event_type = 'purchase'")).select("family", "seq", "n", "late")


@Q.query("""SELECT p_partkey AS name, CASE WHEN p_partkey % 4 IN (0, 3) THEN 'SURVIVORSHIP_RISK,NO_PIT_MEMBERSHIP,SURVIVORSHIP_BIASED_UNIVERSE' ELSE '' END AS flags FROM part""")
def universe_flags(spark, sf_dir):
    k = F.col("p_partkey") % 4
    u = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.when(k == 1, "etf").when(k == 2, "stock_pit").when(k == 3, "stock_current").alias("kind"))
    return L.universe_flags(u).select("name", F.array_join("flags", ",").alias("flags"))


# -- option positions


@Q.query(f"""WITH {_CHAIN}, q AS (SELECT *, mid * 0.97 AS bid, mid * 1.03 AS ask FROM chain), e AS (SELECT *, (bid + ask) / 2 AS m2, ask - bid AS spread, strike / spot AS mon FROM q)
SELECT underlying, days, k, "right", round(days / 365.0, 6) AS t, round(spread, 5) AS spread, round(mon, 6) AS moneyness, coalesce(bid > 0 AND spread / m2 < 0.25 AND CASE WHEN "right" = 'C' THEN k >= 4 ELSE k <= 4 END, false) AS iv_reliable FROM e""")
def enriched_chain(spark, sf_dir):
    d = F.lit("2024-01-02").cast("date")
    c = chain(spark, sf_dir).select("underlying", "days", "k", "right", "spot", "strike", d.alias("session"), F.date_add(d, F.col("days")).alias("expiration"), (F.col("mid") * 0.97).alias("bid"), (F.col("mid") * 1.03).alias("ask"))
    return O.enrich_chain(c, 0.04, 0.01).select("underlying", "days", "k", "right", F.round("t", 6).alias("t"), F.round("spread", 5).alias("spread"), F.round("moneyness", 6).alias("moneyness"), "iv_reliable")


def _d(k: str) -> tuple[str, str]:
    d1 = f"((ln(1 / {k}) + (0.04 - 0.01 + v * v / 2) * t) / (v * sqrt(t)))"
    return d1, f"({d1} - v * sqrt(t))"


def _leg_sql(k: str, call: bool, qty: int, premium: str) -> str:
    d1, d2 = _d(k)
    g = 1 if call else -1
    n1, n2 = normal_sql(f"({g} * {d1})"), normal_sql(f"({g} * {d2})")
    price = f"{g} * s * (exp(-0.01 * t) * {n1} - {k} * exp(-0.04 * t) * {n2})"
    return f"SELECT id, {qty} * ({price} - {premium}) AS value, {qty * g} * exp(-0.01 * t) * {n1} AS delta, {qty} * s * exp(-0.01 * t) * exp(-{d1} * {d1} / 2) / 2.5066282746310002 * sqrt(t) AS vega FROM b"


@Q.query(f"""WITH b AS (SELECT p_partkey AS id, p_retailprice::DOUBLE AS s, 0.2 + p_size / 500.0::DOUBLE AS v, 0.25::DOUBLE AS t FROM part),
l AS ({' UNION ALL '.join([_leg_sql('0.9', False, 1, '0.01 * s'), _leg_sql('0.95', False, -1, '0.02 * s'), _leg_sql('1.05', True, -1, '0.02 * s'), _leg_sql('1.1', True, 1, '0.01 * s')])})
SELECT id, round(sum(value), 4) + 0.0 AS value, round(sum(delta), 5) + 0.0 AS delta, round(sum(vega), 3) + 0.0 AS vega FROM l GROUP BY 1""")
def condor_marks(spark, sf_dir):
    """Iron condors on every part: model marks and Greeks."""
    s = F.col("spot")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("spot"), (0.2 + F.col("p_size") / F.lit(500.0)).alias("v"))
    p = p.withColumn("legs", O.iron_condor(0.9 * s, 0.95 * s, 1.05 * s, 1.1 * s, F.lit(0.25), [0.01 * s, 0.02 * s, 0.02 * s, 0.01 * s]))
    m = O.position_marks(p, "id", "legs", "spot", 0.04, 0.01, F.col("v"))
    return m.select("id", out(F.col("value"), 4).alias("value"), out(F.col("delta"), 5).alias("delta"), out(F.col("vega"), 3).alias("vega"))


@Q.query("SELECT p_partkey AS id, round(0.95 * p_retailprice + 0.02 * p_retailprice, 3) AS upper, round(0.95 * p_retailprice - 0.02 * p_retailprice, 3) AS lower, round(0.02 * p_retailprice, 3) AS max_profit FROM part")
def straddle_analysis(spark, sf_dir):
    """Sold straddles: break-evens, largest profit, open loss."""
    s = F.col("spot")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("spot"))
    p = p.withColumn("legs", O.straddle(0.95 * s, F.lit(0.25), 0.01 * s, 0.01 * s, -1.0))
    b = O.breakevens(p, "id", "legs", "spot", 0.6, 241)
    near = lambda f: F.round(f("breakevens"), 3)
    return b.select("id", near(F.array_max).alias("upper"), near(F.array_min).alias("lower"), F.round("max_profit", 3).alias("max_profit"))


@Q.query(f"""WITH {_CHAIN}, m AS (SELECT underlying, days / 365.0 AS t, arg_min(iv, row(abs(strike - spot), strike)) * CASE WHEN underlying % 3 = 0 AND days = 90 THEN 0.3 ELSE 1 END AS iv FROM chain GROUP BY underlying, days),
v AS (SELECT *, iv * iv * t AS v, lag(iv * iv * t) OVER (PARTITION BY underlying ORDER BY t) AS before FROM m) SELECT underlying, count(*) FILTER (v < before - 1e-12) AS n_violations FROM v GROUP BY 1""")
def calendar_check(spark, sf_dir):
    t = O.atm_term_structure(chain(spark, sf_dir).withColumn("tt", F.col("t")), ["underlying", "days", "tt"])
    t = t.withColumn("iv", F.col("iv") * F.when((F.col("underlying") % 3 == 0) & (F.col("days") == 90), 0.3).otherwise(1.0))
    return O.calendar_violations(t, ["underlying"], "tt", "iv")


@Q.query(f"""WITH {_CHAIN}, x AS (SELECT underlying, days, k, "right", strike, spot, t, (ln(strike / spot) - (0.03 - 0.02) * t) / (0.2 * sqrt(t)) AS z FROM chain)
SELECT underlying, days, k, "right", round(exp(-z * z / 2) / (strike * 0.2 * sqrt(t) * sqrt(2 * pi())), 8) AS density FROM x""")
def lognormal_density(spark, sf_dir):
    c = chain(spark, sf_dir)
    return c.select("underlying", "days", "k", "right", F.round(O.lognormal_pdf(F.col("strike"), F.col("spot"), F.col("t"), F.lit(0.03), F.lit(0.2)), 8).alias("density"))


@Q.query(f"""WITH {_CHAIN}, q AS (SELECT *, mid * 0.97 AS bid, mid * 1.03 AS ask, "right" = 'C' AS buy FROM chain)
SELECT underlying, days, k, "right", round(CASE WHEN ask > 0 AND (buy OR bid > 0) THEN (bid + ask) / 2 + CASE WHEN buy THEN 1 ELSE -1 END * (ask - bid) / 2 * 0.5 END, 5) AS fill FROM q""")
def option_fills(spark, sf_dir):
    c = chain(spark, sf_dir)
    return c.select("underlying", "days", "k", "right", F.round(O.fill_price(F.col("mid") * 0.97, F.col("mid") * 1.03, F.col("right") == "C"), 5).alias("fill"))
