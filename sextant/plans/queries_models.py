"""Queries: options, risk, portfolios, models, the research log and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import options as O
from ..functions.windows import out, spread
from ..operators import risk, stats
from ..sources.adapters import PANEL_SQL, table
from ..sources.shared import written
from . import research_log as L
from .catalogue import Catalogue, normal_sql, t_tail_sql
from .queries_features import S, market_panel

Q = Catalogue()

#: An option chain by rule from the parts: spot is the price, strikes 80 % to 120 %, three expiries, quotes from a formula.
_CHAIN = """chain0 AS (SELECT p_partkey AS underlying, p_retailprice AS spot, k AS k, p_retailprice * (0.8 + 0.05 * k) AS strike, d AS days, d / 365.0::DOUBLE AS t, r AS "right", p_size AS size
  FROM part, range(0, 9) a(k), (VALUES (7), (30), (90)) b(d), (VALUES ('C'), ('P')) c(r)),
chain AS (SELECT *, greatest(CASE WHEN "right" = 'C' THEN spot - strike ELSE strike - spot END, 0) + spot * 0.08 * sqrt(t) * exp(-4 * abs(strike / spot - 1)) + CASE WHEN (underlying + k) % 11 = 0 THEN 0.01 * spot ELSE 0 END AS mid,
  0.2 + 0.1 * (1 - strike / spot) + 0.02 * t + 0.001 * (size % 10) AS iv, CASE WHEN "right" = 'C' THEN 1 / (1 + exp((strike / spot - 1) * 12)) ELSE 1 / (1 + exp((strike / spot - 1) * 12)) - 1 END AS delta FROM chain0)"""


def chain(spark, sf_dir) -> DataFrame:
    """underlying, spot, k, strike, days, t, right, mid, iv, delta (see _CHAIN); 54 quotes for each part, all in one task."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("underlying"), F.col("p_retailprice").alias("spot"), F.col("p_size").alias("size"))
    c = spread(p, ["underlying"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("days", F.explode(F.array(F.lit(7), F.lit(30), F.lit(90)))).withColumn("right", F.explode(F.array(F.lit("C"), F.lit("P"))))
    c = c.withColumns({"strike": F.col("spot") * (F.lit(0.8) + F.lit(0.05) * F.col("k")), "t": F.col("days") / F.lit(365.0)})
    call, m = F.col("right") == "C", F.col("strike") / F.col("spot")
    logistic = 1 / (1 + F.exp((m - 1) * 12))
    return c.withColumns({
        "mid": F.greatest(F.when(call, F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot")), F.lit(0.0)) + F.col("spot") * 0.08 * F.sqrt("t") * F.exp(-4 * F.abs(m - 1)) + F.when((F.col("underlying") + F.col("k")) % 11 == 0, 0.01 * F.col("spot")).otherwise(0.0),
        "iv": F.lit(0.2) + 0.1 * (1 - m) + 0.02 * F.col("t") + 0.001 * (F.col("size") % 10), "delta": F.when(call, logistic).otherwise(logistic - 1)})


@Q.query(f"""WITH {_CHAIN} SELECT underlying, days, k, round(max(mid) FILTER ("right" = 'C') - max(mid) FILTER ("right" = 'P') - any_value(spot * exp(-0.01 * t) - strike * exp(-0.04 * t)), 5) + 0.0 AS gap
FROM chain GROUP BY underlying, days, k""")
def option_parity_gap(spark, sf_dir):
    g = chain(spark, sf_dir).groupBy("underlying", "days", "k", "spot", "strike", "t").agg(F.max(F.when(F.col("right") == "C", F.col("mid"))).alias("call"), F.max(F.when(F.col("right") == "P", F.col("mid"))).alias("put"))
    gap = O.parity_gap(F.col("call"), F.col("put"), F.col("spot"), F.col("strike"), F.col("t"), F.lit(0.04), F.lit(0.01))
    return g.select("underlying", "days", "k", out(gap, 5).alias("gap"))


@Q.query(f"""WITH {_CHAIN}, q AS (SELECT underlying, days, k, t, spot, strike, max(mid) FILTER ("right" = 'C') AS c, max(mid) FILTER ("right" = 'P') AS p FROM chain GROUP BY ALL)
SELECT underlying, days, k, round(0.99 * c - 1.01 * p - spot * 1.0001 + strike * exp(-0.04 * t) - 0.05, 5) + 0.0 AS conversion, round(0.99 * p - 1.01 * c + spot * 0.9999 - strike * exp(-0.04 * t) - 0.05, 5) + 0.0 AS reversal FROM q""")
def parity_arbitrage(spark, sf_dir):
    g = chain(spark, sf_dir).groupBy("underlying", "days", "k", "spot", "strike", "t").agg(F.max(F.when(F.col("right") == "C", F.col("mid"))).alias("c"), F.max(F.when(F.col("right") == "P", F.col("mid"))).alias("p"))
    a, b = O.parity_arbitrage(0.99 * F.col("c"), 1.01 * F.col("c"), 0.99 * F.col("p"), 1.01 * F.col("p"), F.col("spot") * 0.9999, F.col("spot") * 1.0001, F.col("strike"), F.col("t"), F.lit(0.04), F.lit(0.0), 0.05)
    return g.select("underlying", "days", "k", out(a, 5).alias("conversion"), out(b, 5).alias("reversal"))


@Q.query(f"""WITH {_CHAIN}, near AS (SELECT underlying, days, arg_min(strike, row(abs(strike - spot), strike)) AS strike FROM chain GROUP BY 1, 2)
SELECT underlying, days, round(avg(iv), 6) AS iv, round(sum(mid), 5) AS straddle, round(sum(mid) / any_value(spot) / sqrt(2 / pi()), 6) AS implied_move FROM chain JOIN near USING (underlying, days, strike) GROUP BY 1, 2""")
def atm_term_structure(spark, sf_dir):
    c = chain(spark, sf_dir)
    a = O.atm_term_structure(c, ["underlying", "days", "spot"])
    return a.select("underlying", "days", F.round("iv", 6).alias("iv"), F.round("straddle", 5).alias("straddle"), F.round(O.expected_move_from_straddle(F.col("straddle"), F.col("spot")), 6).alias("implied_move"))


@Q.query(f"""WITH {_CHAIN} SELECT underlying, days, round(arg_min(iv, row(abs(delta + 0.25), strike)) FILTER ("right" = 'P'), 6) AS put_iv, round(arg_min(iv, row(abs(delta - 0.25), strike)) FILTER ("right" = 'C'), 6) AS call_iv FROM chain GROUP BY 1, 2""")
def skew_25d(spark, sf_dir):
    return O.skew_25d(chain(spark, sf_dir), ["underlying", "days"]).select("underlying", "days", F.round("put_iv", 6).alias("put_iv"), F.round("call_iv", 6).alias("call_iv"))


@Q.query(f"""WITH {_CHAIN}, s AS (SELECT *, (mid - lag(mid) OVER w) / (strike - lag(strike) OVER w) AS s FROM chain WINDOW w AS (PARTITION BY underlying, days, "right" ORDER BY strike)),
b AS (SELECT *, s - lag(s) OVER (PARTITION BY underlying, days, "right" ORDER BY strike) < -1e-9 AS bad FROM s) SELECT underlying, days, "right", count(*) AS n_quotes, count(*) FILTER (bad) AS n_violations FROM b GROUP BY 1, 2, 3""")
def butterfly_check(spark, sf_dir):
    return O.butterfly_violations(chain(spark, sf_dir), ["underlying", "days", "right"])


@Q.query(f"""WITH {_CHAIN}, a AS (SELECT underlying, max(iv) FILTER (days = 7) AS v1, max(iv) FILTER (days = 30) AS v2 FROM chain WHERE k = 4 GROUP BY 1), x AS (SELECT underlying, v1 * 1.5 AS v1, v2, 7 / 365.0::DOUBLE AS t1, 30 / 365.0::DOUBLE AS t2 FROM a),
b AS (SELECT *, (v2 * v2 * t2 - v1 * v1 * t1) / (t2 - t1) AS bg FROM x) SELECT underlying, round(CASE WHEN bg >= 0 AND v1 * v1 * t1 - bg * t1 >= 0 THEN sqrt(v1 * v1 * t1 - bg * t1) END, 6) AS event_move FROM b""")
def implied_event_move(spark, sf_dir):
    a = chain(spark, sf_dir).where("k = 4").groupBy("underlying").agg(F.max(F.when(F.col("days") == 7, F.col("iv"))).alias("v1"), F.max(F.when(F.col("days") == 30, F.col("iv"))).alias("v2"))
    return a.select("underlying", F.round(O.implied_event_move(F.col("v1") * 1.5, F.lit(7 / 365.0), F.col("v2"), F.lit(30 / 365.0)), 6).alias("event_move"))


@Q.query(f"""WITH {_CHAIN}, c AS (SELECT underlying, k, strike, t, mid FROM chain WHERE "right" = 'C' AND days = 30),
l AS (SELECT *, lag(mid) OVER w AS y0, lead(mid) OVER w AS y2, lag(strike) OVER w AS x0, lead(strike) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY underlying ORDER BY strike)),
g AS (SELECT underlying, k, strike, t, CASE WHEN x0 IS NULL THEN (y2 - mid) / (x2 - strike) WHEN x2 IS NULL THEN (mid - y0) / (strike - x0) ELSE (power(strike - x0, 2) * y2 + (power(x2 - strike, 2) - power(strike - x0, 2)) * mid - power(x2 - strike, 2) * y0) / ((strike - x0) * (x2 - strike) * (x2 - x0)) END AS mid FROM l),
l2 AS (SELECT *, lag(mid) OVER w AS y0, lead(mid) OVER w AS y2, lag(strike) OVER w AS x0, lead(strike) OVER w AS x2 FROM g WINDOW w AS (PARTITION BY underlying ORDER BY strike))
SELECT underlying, k, round(exp(0.04 * t) * CASE WHEN x0 IS NULL THEN (y2 - mid) / (x2 - strike) WHEN x2 IS NULL THEN (mid - y0) / (strike - x0) ELSE (power(strike - x0, 2) * y2 + (power(x2 - strike, 2) - power(strike - x0, 2)) * mid - power(x2 - strike, 2) * y0) / ((strike - x0) * (x2 - strike) * (x2 - x0)) END, 6) + 0.0 AS density FROM l2""")
def breeden_litzenberger(spark, sf_dir):
    c = chain(spark, sf_dir).where("right = 'C' AND days = 30")
    return O.breeden_litzenberger(c, ["underlying"], "strike", "mid", 0.04, "t").select("underlying", "k", out(F.col("density")).alias("density"))


@Q.query(f"""WITH {_CHAIN} SELECT underlying, days, k, "right", round(greatest(CASE WHEN "right" = 'C' THEN 1 ELSE -1 END * (spot * exp(-0.01 * t) - strike * exp(-0.04 * t)), 0), 5) + 0.0 AS lo,
 round(CASE WHEN "right" = 'C' THEN spot * exp(-0.01 * t) ELSE strike * exp(-0.04 * t) END, 5) AS hi, round(spot * iv * sqrt(t), 5) AS one_sd FROM chain""")
def price_bounds_moves(spark, sf_dir):
    c = chain(spark, sf_dir)
    lo, hi = O.price_bounds(F.col("spot"), F.col("strike"), F.col("t"), F.lit(0.04), F.lit(0.01), F.col("right") == "C")
    return c.select("underlying", "days", "k", "right", out(lo, 5).alias("lo"), out(hi, 5).alias("hi"), out(O.expected_move(F.col("spot"), F.col("iv"), F.col("t"))[0], 5).alias("one_sd"))


def _args():
    return F.col("spot"), F.col("strike"), F.col("t"), F.lit(0.04), F.lit(0.01)


@Q.query(f"""WITH {_CHAIN}, a AS (SELECT *, (ln(spot / strike) + (0.04 - 0.01 + iv * iv / 2) * t) / (iv * sqrt(t)) AS d1 FROM chain), b AS (SELECT *, d1 - iv * sqrt(t) AS d2 FROM a),
n AS (SELECT *, {normal_sql('d1')} AS n1, {normal_sql('d2')} AS n2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f, exp(-0.01 * t) AS ah, strike * exp(-0.04 * t) AS cash, CASE WHEN "right" = 'C' THEN 1 ELSE -1 END AS g FROM b),
m AS (SELECT *, CASE WHEN g > 0 THEN n1 ELSE 1 - n1 END AS a1, CASE WHEN g > 0 THEN n2 ELSE 1 - n2 END AS a2 FROM n)
SELECT underlying, days, k, "right", round(g * (spot * ah * a1 - cash * a2), 4) + 0.0 AS price, round(g * ah * a1, 4) + 0.0 AS delta, round(ah * f / (spot * iv * sqrt(t)), 4) + 0.0 AS gamma, round(spot * ah * f * sqrt(t), 4) + 0.0 AS vega,
 round(-spot * ah * f * iv / (2 * sqrt(t)) - g * 0.04 * cash * a2 + g * 0.01 * spot * ah * a1, 3) + 0.0 AS theta, round(g * cash * t * a2, 4) + 0.0 AS rho, round(n2, 4) + 0.0 AS prob_above FROM m""")
def bs_price_greeks(spark, sf_dir):
    c = chain(spark, sf_dir)
    call = F.col("right") == "C"
    g = O.bs_greeks(*_args(), F.col("iv"), call)
    return c.select("underlying", "days", "k", "right", out(O.bs_price(*_args(), F.col("iv"), call), 4).alias("price"), *[out(v, 3 if n == "theta" else 4).alias(n) for n, v in g.items()], out(O.prob_above(*_args(), F.col("iv")), 4).alias("prob_above"))


@Q.query()
def implied_vol(spark, sf_dir):
    """Prices at a known volatility, solved back."""
    c = chain(spark, sf_dir)
    call = F.col("right") == "C"
    c = c.withColumn("price", O.bs_price(*_args(), F.col("iv"), call))
    return c.select("underlying", "days", "k", "right", out(O.implied_vol(F.col("price"), *_args(), call), 5).alias("iv_back"), out(F.col("iv"), 5).alias("iv"))


@Q.query()
def crr_price(spark, sf_dir):
    c = chain(spark, sf_dir)
    call = F.col("right") == "C"
    c = c.withColumn("both", O.crr_prices(*_args(), F.col("iv"), call))
    return c.select("underlying", "days", "k", "right", out(F.col("both.american"), 5).alias("american"), out(F.col("both.american") - F.col("both.european"), 5).alias("premium"))


@Q.query(f"""WITH {_CHAIN}, l AS (SELECT underlying, spot, max(strike) FILTER (k = 4) AS k4, max(strike) FILTER (k = 6) AS k6, max(mid) FILTER (k = 4) AS p4, max(mid) FILTER (k = 6) AS p6 FROM chain WHERE "right" = 'C' AND days = 30 GROUP BY 1, 2)
SELECT underlying, i::INT AS i, round(greatest(spot * (0.7 + 0.1 * i) - k4, 0) - p4 - (greatest(spot * (0.7 + 0.1 * i) - k6, 0) - p6), 5) + 0.0 AS pnl FROM l, range(0, 7) r(i)""")
def option_payoff(spark, sf_dir):
    """A call spread's profit at expiry over seven prices."""
    c = chain(spark, sf_dir).where("right = 'C' AND days = 30 AND k IN (4, 6)")
    leg = F.struct(F.when(F.col("k") == 4, 1.0).otherwise(-1.0).alias("qty"), "strike", "right", F.col("mid").alias("premium"))
    pos = c.groupBy("underlying", "spot").agg(F.collect_list(leg).alias("legs")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return pos.select("underlying", "i", out(O.payoff(F.col("legs"), F.col("spot") * (F.lit(0.7) + 0.1 * F.col("i"))), 5).alias("pnl"))


@Q.query(f"""WITH {_CHAIN} SELECT underlying, days, strike, "right" FROM chain WHERE days = 30 QUALIFY row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - spot * 1.06), strike, "right") = 1""")
def select_contract(spark, sf_dir):
    return O.select_contract(chain(spark, sf_dir), ["underlying"], 10, F.col("spot") * 1.06).select("underlying", "days", "strike", "right")


_TR = "t AS (SELECT l_suppkey AS supp, l_discount - l_tax AS ret FROM lineitem)"


@Q.query(f"WITH {_TR}, s AS (SELECT supp, avg(ret) AS m, stddev_samp(ret) AS s, avg(ln(1 + 0.5 * ret)) AS g FROM t GROUP BY supp) SELECT supp, round(m / (s * s), 4) + 0.0 AS kelly, round(g, 6) + 0.0 AS growth, round(1.6448536269514722 * s - m, 6) AS var95 FROM s")
def kelly_growth(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), (F.col("l_discount") - F.col("l_tax")).alias("ret"))
    g = risk.growth_rate(t, ["supp"], "ret", F.lit(0.5))
    m, s = F.avg("ret"), F.stddev_samp("ret")
    k = t.groupBy("supp").agg(out(risk.kelly_gaussian(m, s), 4).alias("kelly"), out(risk.parametric_var_es(m, s)[0]).alias("var95"))
    return k.join(g, "supp").select("supp", "kelly", out(F.col("growth")).alias("growth"), "var95")


_GRID = lambda source: f"SELECT supp, arg_max(f, row(g, -f)) AS best FROM (SELECT supp, f, sum(w * ln(1 + greatest(f * x, -0.999999))) / sum(w) AS g FROM (SELECT s.supp, s.lo + (s.hi - s.lo) * k / 200 AS f, x, w FROM {source} s, range(1, 201) r(k), v WHERE v.supp = s.supp) GROUP BY supp, f) GROUP BY supp"


@Q.query(f"""WITH t AS (SELECT l_suppkey AS supp, l_discount - l_tax AS x FROM lineitem), v AS (SELECT supp, x, count(*) AS w FROM t GROUP BY 1, 2),
s AS (SELECT supp, count(*) AS n, avg(x) AS mean, 0.0 AS lo, CASE WHEN min(x) < 0 THEN least(10.0, 0.999 / -min(x)) ELSE 10.0 END AS hi FROM t GROUP BY 1), b1 AS ({_GRID('s')}),
s2 AS (SELECT supp, greatest(best - (hi - lo) / 200, 0) AS lo, least(best + (hi - lo) / 200, hi) AS hi FROM s JOIN b1 USING (supp)), b2 AS ({_GRID('s2')})
SELECT supp, round(CASE WHEN n < 10 OR mean <= 0 THEN 0.0 ELSE best END, 4) + 0.0 AS kelly FROM s JOIN b2 USING (supp)""")
def kelly_empirical(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), (F.col("l_discount") - F.col("l_tax")).alias("ret"))
    return risk.kelly_empirical(t, ["supp"], "ret").select("supp", out(F.col("kelly"), 4).alias("kelly"))


#: Trades to check by rule: an order is a proposed trade of its customer.
@Q.query("""WITH t AS (SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 19 = 0 THEN -0.05 ELSE 0.05 END AS notional, 100000.0 + o_custkey AS e, o_totalprice * 0.02 + 2500 AS cash, (o_orderkey % 30) * 1000.0 AS held, (o_orderkey % 110) * 1000.0 AS gross,
  (o_orderkey % 50) * 1000.0 AS sect, 0.5 + (o_orderkey % 4) * 0.5 AS beta, (o_orderkey % 120) * 1000.0 AS bexp, o_totalprice * 10 AS adv, CASE WHEN o_orderkey % 97 = 0 THEN -0.25 ELSE -0.05 END AS dd, o_orderkey % 9 = 0 AS ev, (o_orderkey % 12) * 1000.0 AS evv FROM orders),
c AS (SELECT *, list_sort([row(0.2 * e - held, 0, 'position'), row(e - gross, 1, 'gross_leverage'), row(0.4 * e - sect, 2, 'sector'), row((1.2 * e - bexp) / abs(beta), 3, 'beta'), row(cash - 0.02 * e, 4, 'cash'), row(0.01 * adv, 5, 'liquidity'),
  row(CASE WHEN ev THEN 0.1 * e - evv ELSE 1e300 END, 6, 'event_risk')])[1] AS m, notional > 0 AND dd <= -0.2 AS hard FROM t),
d AS (SELECT *, CASE WHEN hard THEN 0.0 WHEN notional > 0 THEN greatest(0.0, least(notional, m[1])) ELSE -notional END AS allowed FROM c)
SELECT o_orderkey, round(allowed, 4) + 0.0 AS allowed, CASE WHEN hard OR allowed <= 0 THEN 'REJECT' WHEN allowed + 1e-9 < abs(notional) THEN 'REDUCE' ELSE 'APPROVE' END AS verdict, CASE WHEN hard THEN 'hard' WHEN allowed + 1e-9 < abs(notional) THEN m[3] END AS binding FROM d""")
def risk_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, p, none = F.col("o_orderkey"), F.col("o_totalprice"), F.lit(None).cast("double")
    t = o.select(
        "o_orderkey", (p * F.when(k % 19 == 0, -0.05).otherwise(0.05)).alias("notional"), (F.lit(100000.0) + F.col("o_custkey")).alias("equity"), (p * 0.02 + 2500).alias("cash"), ((k % 30) * 1000.0).alias("held"), ((k % 110) * 1000.0).alias("gross"),
        ((k % 50) * 1000.0).alias("sector_value"), (F.lit(0.5) + (k % 4) * 0.5).alias("beta"), ((k % 120) * 1000.0).alias("beta_exposure"), (p * 10).alias("adv"), F.when(k % 97 == 0, -0.25).otherwise(-0.05).alias("drawdown"),
        none.alias("var95"), (k % 9 == 0).alias("event_risk"), ((k % 12) * 1000.0).alias("event_value"), none.alias("loss_share"), none.alias("vega_share"))
    return risk.gate(t).select("o_orderkey", out(F.col("allowed"), 4).alias("allowed"), "verdict", "binding")


@Q.query("SELECT o_custkey, round(sum(abs((o_orderkey % 7 - 3) * o_totalprice)), 2) AS gross, round(sum((o_orderkey % 7 - 3) * o_totalprice), 2) + 0.0 AS net, round(max(abs((o_orderkey % 7 - 3) * o_totalprice)), 2) AS largest FROM orders GROUP BY 1")
def portfolio_exposures(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 7 - 3).cast("double").alias("quantity"), F.col("o_totalprice").alias("price"), F.lit(None).cast("double").alias("beta"))
    return risk.exposures(p, ["o_custkey"]).select("o_custkey", F.round("gross", 2).alias("gross"), out(F.col("net"), 2).alias("net"), F.round("largest", 2).alias("largest"))


_COV = f"{PANEL_SQL}, c AS (SELECT a.symbol AS sa, b.symbol AS sb, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS rho FROM panel a JOIN panel b USING (session) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)"


@Q.query(f"WITH {_COV} SELECT round(sqrt(sum(cov) / 36 * 252), 6) AS vol FROM c")
def portfolio_vol(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    w = p.select("symbol").distinct().withColumn("weight", F.lit(1 / 6))
    return risk.portfolio_vol(stats.covariance(p), w).select(out(F.col("vol")).alias("vol"))


@Q.query(f"WITH {_COV} SELECT 6 AS n, round(36 / sum(c.cov * c.cov / (a.cov * b.cov)), 5) AS effective FROM c JOIN c a ON a.sa = c.sa AND a.sb = c.sa JOIN c b ON b.sa = c.sb AND b.sb = c.sb")
def effective_number(spark, sf_dir):
    c = stats.shrunk_covariance(stats.covariance(market_panel(spark, sf_dir)), 0.0).select("sym_a", "sym_b", "rho")
    return risk.effective_number(c).select("n", F.round("effective", 5).alias("effective"))


def _design(spark, sf_dir):
    """session, symbol, three features and the sign of the next five sessions; complete rows."""
    from ..functions import features
    from ..operators import learn
    from ..operators.panel import forward_return

    p = features.compute(market_panel(spark, sf_dir), {"a": "sma_ratio(n=20)", "b": "mom(lookback=60, skip=5)", "c": "vol(n=21)"})
    p = p.withColumn("ret5", forward_return(5)).withColumn("label", F.when(F.col("ret5").isNotNull(), (F.col("ret5") > 0).cast("double"))).select("session", "symbol", "a", "b", "c", "label")
    return written(learn.stack(p, ["a", "b", "c"], "label"), "design")


@Q.query()
def walk_forward_classifier(spark, sf_dir):
    """The sign of the next five sessions from three features, out of sample."""
    from ..operators import learn

    return learn.walk_forward(_design(spark, sf_dir), ["a", "b", "c"], "label", train=1500, test=400).select("session", "symbol", "label", out(F.col("prob"), 4).alias("prob"), "fold")


@Q.query()
def model_explanation(spark, sf_dir):
    """Permutation importance and partial dependence of a logistic model of the whole design."""
    from ..operators import learn

    rows = _design(spark, sf_dir)
    fitted = learn.estimator("logistic", ["a", "b", "c"], "label").fit(rows)
    e = learn.explain(fitted, rows, ["a", "b", "c"], "label")
    return e.select("kind", "feature", out(F.col("at")).alias("at"), out(F.col("value")).alias("value"), out(F.col("sd")).alias("sd"))


@Q.query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, event_type || ':' || event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, n, seq, payload, '{L.GENESIS}' AS prev_hash, sha256('{L.GENESIS}|' || seq || '|' || payload) AS row_hash FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.seq, e.payload, c.row_hash, sha256(c.row_hash || '|' || e.seq || '|' || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, seq, payload, prev_hash, row_hash FROM c""")
def hash_chain(spark, sf_dir):
    """One chained log for each user: seq, prev_hash and row_hash of every event."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", "event_id").alias("payload"))
    return L.chain(e, "user_id", "seq", "payload")


@Q.query("""WITH e AS (SELECT user_id, event_id AS seq, event_type || ':' || event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (seq % 500 = 0) AS tampered FROM e GROUP BY user_id""")
def hash_chain_verify(spark, sf_dir):
    """Logs whose payloads at every 500th event were changed after they had been chained: each is found."""
    log = hash_chain(spark, sf_dir)
    bad = log.withColumn("payload", F.when(F.col("seq") % 500 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    found = L.broken(bad, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("tampered"))
    return log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(found, "user_id", "left").select("user_id", "n", F.coalesce("tampered", F.lit(0)).alias("tampered"))


@Q.query("""WITH r AS (SELECT o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice > 20000 END AS ok FROM orders)
SELECT o_custkey, CASE WHEN bool_or(ok = false) THEN 'FAIL' WHEN count(*) FILTER (ok IS NULL) > 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS decision FROM r GROUP BY 1""")
def three_valued_decision(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") > 20000).alias("ok"))
    return L.decide(r, ["o_custkey"])


_FIND = "f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'LOOK_AHEAD_BIAS' WHEN 'signup' THEN 'SURVIVORSHIP_BIAS' WHEN 'click' THEN 'INADEQUATE_SAMPLE' ELSE 'MISSING_COSTS' END AS category, value > 60 AS m FROM events)"


@Q.query(f"""WITH {_FIND}, g AS (SELECT user_id, coalesce(bool_or(m AND category = 'LOOK_AHEAD_BIAS'), false) AS la, coalesce(bool_or(m AND category = 'SURVIVORSHIP_BIAS'), false) AS sb, coalesce(bool_or(m AND category = 'MISSING_COSTS'), false) AS mc, coalesce(bool_or(m AND category = 'INADEQUATE_SAMPLE'), false) AS s FROM f GROUP BY 1),
p AS (SELECT *, concat_ws('+', CASE WHEN sb THEN 'SURVIVORSHIP-BIASED' END, CASE WHEN la THEN 'LOOK-AHEAD' END, CASE WHEN mc THEN 'MISSING-COSTS' END) AS bad FROM g)
SELECT user_id, CASE WHEN bad = '' AND NOT s THEN 'RESEARCH_GRADE' ELSE concat_ws('; ', CASE WHEN bad <> '' THEN (CASE WHEN la THEN 'BIASED' ELSE 'PRELIMINARY' END) || ' / ' || bad END, CASE WHEN s THEN 'INSUFFICIENT_EVIDENCE / INADEQUATE-SAMPLE' END) END AS grade FROM p""")
def findings_grade(spark, sf_dir):
    kind = F.create_map(F.lit("error"), F.lit("LOOK_AHEAD_BIAS"), F.lit("signup"), F.lit("SURVIVORSHIP_BIAS"), F.lit("click"), F.lit("INADEQUATE_SAMPLE"))
    f = table(spark, sf_dir, "events").select("user_id", F.coalesce(kind[F.col("event_type")], F.lit("MISSING_COSTS")).alias("category"), F.when(F.col("value") > 60, "MATERIAL").otherwise("MINOR").alias("severity"))
    return L.grades(f, ["user_id"])


_STATUS = "st AS (SELECT user_id AS entity_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'EXPERIMENTAL' WHEN 'click' THEN 'VALIDATING' WHEN 'signup' THEN 'ACCEPTED' WHEN 'purchase' THEN 'PAPER_TRADING' ELSE 'REJECTED' END AS to_status FROM events)"


def _statuses(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for x in ("view", "EXPERIMENTAL", "click", "VALIDATING", "signup", "ACCEPTED", "purchase", "PAPER_TRADING", "error", "REJECTED")])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), m[F.col("event_type")].alias("to_status"))


@Q.query(f"WITH {_STATUS} SELECT entity_id, arg_max(to_status, seq) AS to_status FROM st GROUP BY 1")
def current_status(spark, sf_dir):
    return L.current_status(_statuses(spark, sf_dir))


@Q.query(f"""WITH {_STATUS}, l AS (SELECT *, lag(to_status) OVER (PARTITION BY entity_id ORDER BY seq) AS from_status FROM st)
SELECT entity_id, seq, from_status, to_status FROM l WHERE from_status IS NOT NULL AND NOT ((from_status = 'EXPERIMENTAL' AND to_status IN ('VALIDATING', 'REJECTED')) OR (from_status = 'VALIDATING' AND to_status IN ('ACCEPTED', 'REJECTED')) OR (from_status = 'ACCEPTED' AND to_status IN ('PAPER_TRADING')))""")
def illegal_transitions(spark, sf_dir):
    return L.illegal_transitions(_statuses(spark, sf_dir))


@Q.query("""WITH t AS (SELECT l_suppkey AS supp, l_discount - l_tax AS r, quantile_cont(l_discount - l_tax, 0.95) OVER (PARTITION BY l_suppkey) AS q FROM lineitem)
SELECT supp, count(*) AS n, round(avg(r) FILTER (r < q), 6) + 0.0 AS trimmed FROM t GROUP BY 1""")
def outlier_trimmed_mean(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), (F.col("l_discount") - F.col("l_tax")).alias("r"))
    return L.outlier_trimmed_mean(t, ["supp"], "r").select("supp", "n", out(F.col("trimmed")).alias("trimmed"))


@Q.query("""WITH y AS (SELECT l_suppkey AS supp, year(l_shipdate) AS y, sum(l_discount - l_tax) AS s FROM lineitem GROUP BY 1, 2) SELECT supp, round(CASE WHEN sum(s) > 0 THEN max(s) / sum(s) END, 5) AS concentration FROM y GROUP BY 1""")
def year_concentration(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), "l_shipdate", (F.col("l_discount") - F.col("l_tax")).alias("r"))
    return L.year_concentration(t, ["supp"], "l_shipdate", "r").select("supp", out(F.col("concentration"), 5).alias("concentration"))


@Q.query("""WITH t AS (SELECT l_suppkey AS supp, (l_shipdate::DATE - min(l_shipdate::DATE) OVER (PARTITION BY l_suppkey)) / 365.25::DOUBLE AS y, l_discount - l_tax AS r,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT supp, any_value(n) AS n, round(regr_slope(r, y), 6) + 0.0 AS slope, round(avg(r) FILTER (i <= n // 2), 6) + 0.0 AS first_half, round(avg(r) FILTER (i > n // 2), 6) + 0.0 AS second_half FROM t GROUP BY 1""")
def stability(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") - F.col("l_tax")).alias("r"))
    s = L.stability(t, ["supp"], "d", "r", ["l_orderkey", "l_linenumber", "l_partkey"])
    return s.select("supp", "n", *[out(F.col(c)).alias(c) for c in ("slope", "first_half", "second_half")])


@Q.query(f"""WITH t AS (SELECT l_suppkey AS supp, (l_shipdate::DATE - min(l_shipdate::DATE) OVER (PARTITION BY l_suppkey)) / 365.25::DOUBLE AS y, l_discount - l_tax AS r,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
g AS (SELECT supp, any_value(n) AS n, regr_slope(r, y) AS b, regr_r2(r, y) AS r2, avg(r) FILTER (i <= n // 2) AS f, avg(r) FILTER (i > n // 2) AS s FROM t GROUP BY 1),
p AS (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) AS tt FROM g), q AS (SELECT *, 2 * {t_tail_sql('tt', 'n - 2')} AS sp FROM p)
SELECT supp, round(sp, 5) + 0.0 AS slope_p, CASE WHEN n < 20 THEN 'INSUFFICIENT_DATA' WHEN f > 0 AND s <= 0 THEN 'DISAPPEARED' WHEN sp < 0.1 AND b > 0 THEN 'STRENGTHENED' WHEN sp < 0.1 THEN 'WEAKENED' WHEN s > 0 THEN 'STABLE' ELSE 'NO_EDGE_IN_EITHER_HALF' END AS verdict FROM q""")
def stability_verdicts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") - F.col("l_tax")).alias("r"))
    return L.stability(t, ["supp"], "d", "r", ["l_orderkey", "l_linenumber", "l_partkey"]).select("supp", out(F.col("slope_p"), 5).alias("slope_p"), "verdict")


@Q.query("""WITH h AS (SELECT o_custkey AS entity_id, o_orderkey AS seq, o_orderstatus AS field, o_orderpriority AS value FROM orders) SELECT entity_id, field, arg_max(value, seq) AS value FROM h GROUP BY 1, 2""")
def merged_records(spark, sf_dir):
    u = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("value"))
    return L.merged_records(u)


@Q.query(f"WITH {PANEL_SQL}, e AS (SELECT symbol, session, ret, lead(session) OVER ({S}) AS next_session FROM panel) SELECT symbol, count(*) AS n, count(next_session) AS n_next, min(session) AS first_session, max(session) AS last_session FROM e WHERE ret IS NOT NULL GROUP BY symbol")
def entry_exit_sessions(spark, sf_dir):
    from ..operators.panel import entry_exit_sessions as sessions

    p = market_panel(spark, sf_dir).withColumn("next_session", sessions(5)[0]).where("ret IS NOT NULL")
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("next_session").alias("n_next"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))
