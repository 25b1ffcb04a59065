"""Queries: inference, multiple testing, information coefficients, resampling and relative value."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.windows import by_symbol, gated, out, ratio, trailing
from ..operators import resample, stats
from ..operators.panel import forward_return, with_market
from ..sources.adapters import PANEL_SQL, strategy_trades, table
from .catalogue import Catalogue, normal_sql, t_tail_sql
from .queries_features import S, _frame, market_panel
from .queries_trading import _CANDIDATES, _candidates

Q = Catalogue()

#: p-values by rule: one for each part, spread over (0, 1) by a hash-free remainder.
_P = "p AS (SELECT p_partkey AS id, p_brand AS family, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE ((p_partkey * 7919) % 9973 + 1) / 10000.0::DOUBLE * (CASE WHEN p_partkey % 5 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END) END AS p FROM part)"


def _pvalues(spark, sf_dir):
    k = F.col("p_partkey")
    p = ((k * 7919) % 9973 + 1) / F.lit(10000.0) * F.when(k % 5 == 0, 0.001).otherwise(1.0)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("family"), F.when(k % 17 != 0, p).alias("p"))


@Q.query(f"""WITH {_P}, r AS (SELECT *, coalesce(p, 1.0) AS q, count(*) OVER (PARTITION BY family)::DOUBLE AS m, row_number() OVER (PARTITION BY family ORDER BY coalesce(p, 1.0), id) AS k FROM p)
SELECT id, family, round(least(q * m, 1), 8) AS bonferroni, round(max(least((m - k + 1) * q, 1)) OVER (PARTITION BY family ORDER BY q, id), 8) AS holm,
 round(min(least(q * m / k, 1)) OVER (PARTITION BY family ORDER BY q, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS bh,
 round(least(min(q * m / k) OVER (PARTITION BY family ORDER BY q, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * list_sum(list_transform(range(1, m::BIGINT + 1), lambda i: 1.0 / i)), 1), 8) AS "by" FROM r""")
def fdr_adjustments(spark, sf_dir):
    a = stats.adjust(_pvalues(spark, sf_dir), "p", ["id"], ["family"])
    return a.select("id", "family", *[out(F.col(c), 8).alias(c) for c in ("bonferroni", "holm", "bh", "by")])


_HAC = """WITH t AS (SELECT l_suppkey AS supp, l_discount - l_tax AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem),
u AS (SELECT supp, i, x - avg(x) OVER (PARTITION BY supp) AS u, count(*) OVER (PARTITION BY supp) AS n, avg(x) OVER (PARTITION BY supp) AS mean FROM t),
l AS (SELECT *, least(floor(4 * pow(n / 100.0, 2.0 / 9))::INT, n - 1) AS L FROM u),
g AS (SELECT a.supp, a.n, a.mean, a.L, k, sum(a.u * b.u) AS g FROM l a, range(0, 30) r(k), l b WHERE k <= a.L AND b.supp = a.supp AND b.i = a.i - k GROUP BY 1, 2, 3, 4, 5)"""


@Q.query(f"{_HAC}, s AS (SELECT supp, n, mean, sqrt(greatest(sum(CASE WHEN k = 0 THEN 1.0 ELSE 2 * (1 - k / (L + 1.0)) END * g / n), 0) / n) AS se FROM g GROUP BY 1, 2, 3) SELECT supp, n, round(mean, 6) + 0.0 AS mean, round(se, 6) AS se, round(mean / se, 4) + 0.0 AS t FROM s")
def hac_tstat(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), (F.col("l_discount") - F.col("l_tax")).alias("x"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("k"))
    return stats.hac_test(t, ["supp"], "k", "x").select("supp", "n", out(F.col("mean")).alias("mean"), out(F.col("se")).alias("se"), out(F.col("t"), 4).alias("t"))


_IC = f"""{PANEL_SQL}, x AS (SELECT session, symbol, lag(close, 5) OVER ({S}) / lag(close, 60) OVER ({S}) - 1 AS s, lead(open, 6) OVER ({S}) / lead(open, 1) OVER ({S}) - 1 AS l FROM panel),
y AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY s) + (count(*) OVER (PARTITION BY session, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY session ORDER BY l) + (count(*) OVER (PARTITION BY session, l) - 1) / 2.0 AS b FROM x WHERE s IS NOT NULL AND l IS NOT NULL),
ic AS (SELECT session, CASE WHEN count(*) >= 5 THEN corr(a, b) END AS ic, count(*) AS n FROM y GROUP BY session)"""


def _ic(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    w = by_symbol()
    p = p.withColumns({"s": F.lag("close", 5).over(w) / F.lag("close", 60).over(w) - 1, "l": forward_return(5)})
    return stats.cross_sectional_ic(p, "s", "l")


@Q.query(f"WITH {_IC} SELECT session, round(ic, 6) + 0.0 AS ic, n FROM ic")
def cross_sectional_ic(spark, sf_dir):
    return _ic(spark, sf_dir).select("session", out(F.col("ic")).alias("ic"), "n")


@Q.query(f"WITH {_IC} SELECT count(ic) AS n, round(avg(ic), 6) + 0.0 AS mean, round(stddev_samp(ic), 6) AS sd, round(avg(ic) / stddev_samp(ic), 6) + 0.0 AS ir, round(avg((ic > 1e-9)::INT) FILTER (ic IS NOT NULL), 6) AS share_positive FROM ic")
def ic_summary(spark, sf_dir):
    ic = F.col("ic")
    return _ic(spark, sf_dir).where("ic IS NOT NULL").agg(F.count(ic).alias("n"), out(F.avg(ic)).alias("mean"), out(F.stddev_samp(ic)).alias("sd"), out(F.avg(ic) / F.stddev_samp(ic)).alias("ir"), out(F.avg((ic > 1e-9).cast("double"))).alias("share_positive"))


@Q.query("""WITH t AS (SELECT l_suppkey AS supp, l_shipdate, l_orderkey, l_linenumber, l_partkey, -((l_discount - l_tax) - 0.01) / 0.04 - 0.5 AS z FROM lineitem),
p AS (SELECT *, sum(z) OVER (PARTITION BY supp ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS p FROM t),
c AS (SELECT supp, p - least(0, min(p) OVER (PARTITION BY supp ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)) AS c FROM p)
SELECT supp, count(*) AS n, round(max(c), 4) AS worst, count(*) FILTER (c > 8.0001) AS n_alarms FROM c GROUP BY supp""")
def cusum(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("ret", F.col("l_discount") - F.col("l_tax")).withColumnRenamed("l_suppkey", "supp")
    c = stats.cusum(t, ["supp"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "ret", 0.01, 0.04, h=8.0001)
    return c.groupBy("supp").agg(F.count(F.lit(1)).alias("n"), out(F.max("cusum"), 4).alias("worst"), F.count(F.when(F.col("alarm"), 1)).alias("n_alarms"))


@Q.query(f"WITH {PANEL_SQL}, r AS (SELECT symbol, ret, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS q FROM panel WHERE ret IS NOT NULL) SELECT symbol, count(*) AS n, round(-any_value(q), 6) AS var, round(-avg(ret) FILTER (ret <= q), 6) AS es FROM r GROUP BY symbol")
def var_es(spark, sf_dir):
    return stats.var_es(market_panel(spark, sf_dir), ["symbol"], "ret").select("symbol", "n", out(F.col("var")).alias("var"), out(F.col("es")).alias("es"))


@Q.query(f"WITH {PANEL_SQL} SELECT a.symbol AS sym_a, b.symbol AS sym_b, round(covar_samp(a.ret, b.ret), 6) + 0.0 AS cov, count(*) AS n FROM panel a JOIN panel b ON a.session = b.session AND a.symbol <= b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def cov_matrix(spark, sf_dir):
    return stats.covariance(market_panel(spark, sf_dir)).select("sym_a", "sym_b", out(F.col("cov")).alias("cov"), "n")


@Q.query(f"""WITH {PANEL_SQL}, c AS (SELECT a.symbol AS sym_a, b.symbol AS sym_b, covar_samp(a.ret, b.ret) AS cov, count(*) AS n FROM panel a JOIN panel b ON a.session = b.session AND a.symbol <= b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2),
v AS (SELECT sym_a AS s, sqrt(cov) AS sd FROM c WHERE sym_a = sym_b), r AS (SELECT c.*, va.sd AS sda, vb.sd AS sdb, cov / (va.sd * vb.sd) AS rho FROM c JOIN v va ON va.s = sym_a JOIN v vb ON vb.s = sym_b)
SELECT sym_a, sym_b, round((1 - 0.3) * cov + 0.3 * CASE WHEN sym_a = sym_b THEN cov ELSE (SELECT avg(rho) FROM r WHERE sym_a <> sym_b) * sda * sdb END, 6) + 0.0 AS shrunk FROM r""")
def shrunk_covariance(spark, sf_dir):
    return stats.shrunk_covariance(stats.covariance(market_panel(spark, sf_dir)), 0.3).select("sym_a", "sym_b", out(F.col("shrunk")).alias("shrunk"))


@Q.query(f"""WITH {PANEL_SQL}, s AS (SELECT symbol, session, ln(close) AS x FROM panel WHERE close IS NOT NULL), d AS (SELECT symbol, x - lag(x) OVER w AS d, lag(x) OVER w AS l FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session))
SELECT symbol, count(*) AS n, round(regr_slope(d, l), 6) + 0.0 AS slope, round(CASE WHEN regr_slope(d, l) < 0 THEN -ln(2) / regr_slope(d, l) * -1 * -1 END, 5) AS half_life FROM d WHERE l IS NOT NULL GROUP BY symbol""")
def half_life(spark, sf_dir):
    p = market_panel(spark, sf_dir).withColumn("x", F.log("close"))
    return stats.half_life(p, ["symbol"], "session", "x").select("symbol", "n", out(F.col("slope")).alias("slope"), out(F.col("half_life"), 5).alias("half_life"))


_MK = "m AS (SELECT p.session, p.symbol, ln(p.close) AS ly, ln(k.close) AS lx, p.ret, k.ret AS mret FROM panel p JOIN (SELECT session, close, ret FROM panel WHERE symbol = 'AF') k USING (session) WHERE p.symbol <> 'AF')"


@Q.query(f"""WITH {PANEL_SQL}, {_MK}, b AS (SELECT *, CASE WHEN lx IS NOT NULL AND ly IS NOT NULL THEN lx END AS bx, CASE WHEN lx IS NOT NULL AND ly IS NOT NULL THEN ly END AS "by" FROM m),
h AS (SELECT *, CASE WHEN count(bx) OVER {_frame(60)} >= 60 THEN covar_samp("by", bx) OVER {_frame(60)} / nullif(var_samp(bx) OVER {_frame(60)}, 0) END AS beta, avg(bx) OVER {_frame(60)} AS mx, avg("by") OVER {_frame(60)} AS my FROM b),
s AS (SELECT session, symbol, beta, "by" - beta * bx - (my - beta * mx) AS spread FROM h)
SELECT session, symbol, round(beta, 5) + 0.0 AS beta, round(spread, 5) + 0.0 AS spread, round(CASE WHEN count(spread) OVER {_frame(60)} >= 30 THEN (spread - avg(spread) OVER {_frame(60)}) / nullif(stddev_samp(spread) OVER {_frame(60)}, 0) END, 5) + 0.0 AS z FROM s""")
def rolling_spread(spark, sf_dir):
    from ..operators.relative import rolling_spread as run

    p = with_market(market_panel(spark, sf_dir), "AF").where("symbol <> 'AF'")
    return run(p, F.log("close"), F.log("market_close"), 60).select("session", "symbol", *[out(F.col(c), 5).alias(c) for c in ("beta", "spread", "z")])


@Q.query(f"WITH {PANEL_SQL}, {_MK}, b AS (SELECT *, CASE WHEN mret IS NOT NULL THEN ret END AS a FROM m) SELECT session, symbol, round(CASE WHEN count(a) OVER {_frame(63)} >= 63 THEN corr(a, mret) OVER {_frame(63)} END, 6) + 0.0 AS rho FROM b")
def rolling_correlation(spark, sf_dir):
    p = with_market(market_panel(spark, sf_dir), "AF").where("symbol <> 'AF'")
    a = F.when(F.col("market_ret").isNotNull(), F.col("ret"))
    b = F.when(F.col("ret").isNotNull(), F.col("market_ret"))
    return p.select("session", "symbol", out(gated(F.corr(a, b), a, 63, trailing(63))).alias("rho"))


def _psr_sql(benchmark: str) -> str:
    return normal_sql(f"((sr - {benchmark}) * sqrt(n - 1) / sqrt(sp))")


_Z95 = NormalDist().inv_cdf(0.95)
_ZMAX = (1 - stats.EULER) * NormalDist().inv_cdf(1 - 1 / 100) + stats.EULER * NormalDist().inv_cdf(1 - 1 / (100 * math.e))


@Q.query(f"""WITH g AS (SELECT l_suppkey, avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax) AS sr, count(*) AS n, skewness(l_discount - l_tax) AS sk, kurtosis(l_discount - l_tax) + 3 AS ku FROM lineitem GROUP BY 1),
p AS (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS sp FROM g)
SELECT l_suppkey, round(sr, 6) + 0.0 AS sr, n, round({_psr_sql('0.0')}, 6) + 0.0 AS psr, round({_psr_sql(f'{_ZMAX!r} / sqrt(n - 1)')}, 6) + 0.0 AS dsr, round(CASE WHEN sr > 0 THEN 1 + sp * power({_Z95!r} / sr, 2) END, 3) + 0.0 AS min_track FROM p""")
def probabilistic_sharpe(spark, sf_dir):
    """PSR, deflated Sharpe and the shortest track record of each supplier's trades."""
    from ..operators.metrics import kurtosis, skew

    t = strategy_trades(spark, sf_dir)
    g = t.groupBy("l_suppkey").agg(ratio(F.avg("ret"), F.stddev_samp("ret")).alias("sr"), F.count(F.lit(1)).alias("n"), skew(F.col("ret")).alias("skew"), (kurtosis(F.col("ret")) + 3).alias("kurt"))
    sr, n, sk, ku = (F.col(c) for c in ("sr", "n", "skew", "kurt"))
    return g.select("l_suppkey", out(sr).alias("sr"), "n", out(stats.psr(sr, n, sk, ku)).alias("psr"), out(stats.deflated_sharpe(sr, n, F.lit(100), sk, ku)).alias("dsr"), out(stats.min_track_record(sr, sk, ku), 3).alias("min_track"))


@Q.query(f"""{_HAC}, s AS (SELECT supp, n, mean, sqrt(greatest(sum(CASE WHEN k = 0 THEN 1.0 ELSE 2 * (1 - k / (L + 1.0)) END * g / n), 0) / n) AS se FROM g GROUP BY 1, 2, 3), t2 AS (SELECT supp, n, mean / se AS tt FROM s)
SELECT supp, n, round(tt, 4) + 0.0 AS t, round({t_tail_sql('tt', 'n - 1')}, 6) + 0.0 AS p FROM t2""")
def hac_pvalues(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), (F.col("l_discount") - F.col("l_tax")).alias("x"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("k"))
    return stats.hac_test(t, ["supp"], "k", "x").select("supp", "n", out(F.col("t"), 4).alias("t"), out(F.col("p"), 6).alias("p"))


DRAWS = 200
_U = lambda *parts: f"(('0x' || substr(md5(concat_ws(':', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(16**12)!r}::DOUBLE"
_SERIES = f"{PANEL_SQL}, s AS (SELECT symbol, ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM panel WHERE ret IS NOT NULL), dr AS (SELECT unnest(range(0, {DRAWS})) AS draw)"


@Q.query(f"""WITH {_SERIES}, m AS (SELECT symbol, draw, avg(abs(x) * CASE WHEN {_U(5, 'draw', 'pos')} < 0.5 THEN -1.0 ELSE 1.0 END) AS m FROM s, dr GROUP BY 1, 2),
st AS (SELECT symbol, count(*) AS n, avg(x) AS stat FROM s GROUP BY 1)
SELECT symbol, n, round(stat, 6) + 0.0 AS stat, round((1 + count(*) FILTER (m >= stat)) / {DRAWS + 1}.0, 6) AS p FROM m JOIN st USING (symbol) GROUP BY symbol, n, stat""")
def sign_flip_test(spark, sf_dir):
    t = resample.sign_flip_test(market_panel(spark, sf_dir), ["symbol"], ["session"], "ret", DRAWS, seed=5)
    return t.select("symbol", "n", out(F.col("stat")).alias("stat"), out(F.col("p")).alias("p"))


@Q.query(f"""WITH {_SERIES}, b AS (SELECT symbol, draw, pos, n, floor({_U(5, 'draw', 'pos', "'start'")} * n)::BIGINT AS a FROM s, dr WHERE pos = 0 OR {_U(5, 'draw', 'pos', "'cut'")} < pow(n, -1.0 / 3)),
l AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY symbol, draw ORDER BY pos), n) - pos AS len FROM b),
c AS (SELECT symbol, pos + 1 AS k, sum(x) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM s UNION ALL SELECT DISTINCT symbol, 0, 0.0 FROM s),
m AS (SELECT l.symbol, draw, sum(c1.c - c0.c + c2.c) / any_value(n) AS m FROM l JOIN c c0 ON c0.symbol = l.symbol AND c0.k = a JOIN c c1 ON c1.symbol = l.symbol AND c1.k = least(a + len, n) JOIN c c2 ON c2.symbol = l.symbol AND c2.k = greatest(a + len - n, 0) GROUP BY 1, 2),
st AS (SELECT symbol, count(*) AS n, avg(x) AS mean FROM s GROUP BY 1)
SELECT symbol, any_value(n) AS n, round(any_value(mean), 6) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS lo, round(quantile_cont(m, 0.975), 6) + 0.0 AS hi, round(avg((m <= 0)::INT), 6) AS p_le_zero FROM m JOIN st USING (symbol) GROUP BY symbol""")
def bootstrap_ci(spark, sf_dir):
    t = resample.bootstrap_ci(market_panel(spark, sf_dir), ["symbol"], ["session"], "ret", DRAWS, seed=5)
    return t.select("symbol", "n", *[out(F.col(c)).alias(c) for c in ("mean", "lo", "hi", "p_le_zero")])


_BLOCKS = f"""gp AS (SELECT DISTINCT symbol, n, pow(n, -1.0::DOUBLE / 3) AS p FROM s WHERE n >= 5), gm AS (SELECT *, ceil(n * p + 6 * sqrt(n * p) + 12)::INT AS m FROM gp),
gd AS (SELECT symbol, draw, n, m, i, 1 + floor(ln({_U(9, 'draw', 'i', "'len'")}) / ln(1 - p))::BIGINT AS g, floor({_U(9, 'draw', 'i', "'start'")} * n)::BIGINT AS a FROM gm, dr, range(0, 4000) r(i) WHERE i < m),
gs AS (SELECT *, (sum(g) OVER (PARTITION BY symbol, draw ORDER BY i ROWS UNBOUNDED PRECEDING) - g)::BIGINT AS s0 FROM gd),
bk AS (SELECT symbol, draw, n, a, CASE WHEN i = m - 1 THEN n - s0 ELSE least(g, n - s0) END AS len FROM gs WHERE s0 < n),
pk AS (SELECT symbol, draw, unnest(range(a, a + len)) % n AS pos FROM bk)"""


def _boot_sql(statistic: str) -> str:
    """statistic: of the rows x (and y) that a draw picks."""
    return f"""{_BLOCKS}, m AS (SELECT symbol, draw, {statistic} AS m FROM pk JOIN s USING (symbol, pos) GROUP BY 1, 2), e AS (SELECT symbol, count(*) AS n, {statistic} AS estimate FROM s WHERE n >= 5 GROUP BY 1)
SELECT symbol, e.n, round(any_value(estimate), 6) + 0.0 AS estimate, round(quantile_cont(m, 0.025), 6) + 0.0 AS lo, round(quantile_cont(m, 0.975), 6) + 0.0 AS hi, round(avg((m <= 0)::INT), 6) AS p_le_zero FROM m JOIN e USING (symbol) GROUP BY symbol, e.n"""


def _boot(t):
    return t.select("symbol", "n", *[out(F.col(c)).alias(c) for c in ("estimate", "lo", "hi", "p_le_zero")])


@Q.query(f"WITH {_SERIES}, {_boot_sql('avg(x) / stddev_samp(x) * sqrt(252)')}")
def bootstrap_sharpe(spark, sf_dir):
    return _boot(resample.bootstrap(market_panel(spark, sf_dir), ["symbol"], ["session"], *resample.sharpe_sums("ret"), DRAWS, seed=9))


@Q.query(f"WITH {_SERIES}, {_boot_sql('sum(greatest(x, 0)) / sum(greatest(-x, 0))')}")
def bootstrap_profit_factor(spark, sf_dir):
    gain = resample.ratio_sums(F.greatest("ret", F.lit(0.0)), F.greatest(-F.col("ret"), F.lit(0.0)))
    return _boot(resample.bootstrap(market_panel(spark, sf_dir).where("ret IS NOT NULL"), ["symbol"], ["session"], *gain, DRAWS, seed=9))


@Q.query(f"WITH {_SERIES}, {_boot_sql('quantile_cont(x, 0.3)')}")
def bootstrap_quantile(spark, sf_dir):
    return _boot(resample.bootstrap_quantile(market_panel(spark, sf_dir), ["symbol"], ["session"], "ret", 0.3, DRAWS, seed=9))


@Q.query(f"""WITH {_CANDIDATES}, dr AS (SELECT unnest(range(0, {DRAWS})) AS draw),
t AS (SELECT symbol, gross_ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY entry_session) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM cand),
lb AS (SELECT symbol, session, lead(open, 6) OVER ({S}) / lead(open, 1) OVER ({S}) - 1 AS y FROM panel),
pool AS (SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS size FROM lb WHERE y IS NOT NULL),
pk AS (SELECT t.symbol, draw, floor({_U(5, 'draw', 'pos')} * size)::BIGINT AS k FROM t JOIN (SELECT DISTINCT symbol, size FROM pool WHERE size >= 20) USING (symbol), dr WHERE n >= 5),
m AS (SELECT symbol, draw, avg(y) AS m FROM pk JOIN pool USING (symbol, k) GROUP BY 1, 2), st AS (SELECT symbol, count(*) AS n, avg(x) AS stat FROM t GROUP BY 1)
SELECT symbol, n, round(stat, 6) + 0.0 AS stat, round((1 + count(*) FILTER (m >= stat)) / {DRAWS + 1}.0, 6) AS p FROM m JOIN st USING (symbol) GROUP BY symbol, n, stat""")
def random_entry_test(spark, sf_dir):
    pool = market_panel(spark, sf_dir).withColumn("label", forward_return(5))
    t = resample.random_entry_test(_candidates(spark, sf_dir), pool, ["symbol"], ["entry_session"], "gross_ret", "direction", ["session"], "label", DRAWS, seed=5)
    return t.select("symbol", "n", out(F.col("stat")).alias("stat"), out(F.col("p")).alias("p"))


@Q.query(f"""WITH {PANEL_SQL}, {_MK}, dr AS (SELECT unnest(range(0, {DRAWS})) AS draw), x AS (SELECT symbol, session, ret, mret FROM m WHERE ret IS NOT NULL AND mret IS NOT NULL),
r AS (SELECT symbol, session, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY mret) + (count(*) OVER (PARTITION BY symbol, mret) - 1) / 2.0 AS b FROM x),
z AS (SELECT symbol, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS b, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS pos, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY symbol)),
k AS (SELECT symbol, draw, a, (pos - (21 + floor({_U(5, 'draw')} * (n - 42))::BIGINT) + n) % n AS pos FROM z, dr WHERE n > 42),
m2 AS (SELECT symbol, draw, abs(avg(k.a * z.b)) AS m FROM k JOIN z USING (symbol, pos) GROUP BY 1, 2),
st AS (SELECT symbol, count(*) AS n, abs(avg(a * b)) AS stat FROM z GROUP BY 1)
SELECT symbol, n, round(stat, 6) + 0.0 AS stat, round((1 + count(*) FILTER (m >= stat)) / {DRAWS + 1}.0, 6) AS p FROM m2 JOIN st USING (symbol) GROUP BY symbol, n, stat""")
def circular_shift_test(spark, sf_dir):
    p = with_market(market_panel(spark, sf_dir), "AF").where("symbol <> 'AF'")
    t = resample.circular_shift_test(p, ["symbol"], ["session"], "ret", "market_ret", DRAWS, seed=5)
    return t.select("symbol", "n", out(F.col("stat")).alias("stat"), out(F.col("p")).alias("p"))


@Q.query(f"""WITH {PANEL_SQL}, dr AS (SELECT unnest(range(0, {DRAWS})) AS draw), f AS (SELECT symbol, ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS pos FROM panel WHERE ret IS NOT NULL AND session >= DATE '1998-01-01'),
h AS (SELECT symbol, ret AS y, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS size FROM panel WHERE ret IS NOT NULL AND session < DATE '1998-01-01'),
pk AS (SELECT symbol, draw, floor({_U(5, 'draw', 'pos')} * size)::BIGINT AS k FROM f JOIN (SELECT DISTINCT symbol, size FROM h) USING (symbol), dr),
m AS (SELECT symbol, draw, avg(y) AS m FROM pk JOIN h USING (symbol, k) GROUP BY 1, 2), st AS (SELECT symbol, count(*) AS n, avg(x) AS fm FROM f GROUP BY 1)
SELECT symbol, n, round(fm, 6) + 0.0 AS forward_mean, round(avg((m <= fm)::INT), 6) AS percentile FROM m JOIN st USING (symbol) GROUP BY symbol, n, fm""")
def compare_with_history(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    t = resample.compare_with_history(p.where("session >= DATE '1998-01-01'"), p.where("session < DATE '1998-01-01'"), ["symbol"], ["session"], "ret", DRAWS, seed=5)
    return t.select("symbol", "n", out(F.col("forward_mean")).alias("forward_mean"), out(F.col("percentile")).alias("percentile"))


@Q.query("""WITH s AS (SELECT session, row_number() OVER (ORDER BY session) AS p FROM (SELECT DISTINCT l_shipdate::DATE AS session FROM lineitem)),
k AS (SELECT unnest(range(0, ((SELECT max(p) FROM s) - 756 - 21) // 252)) AS fold)
SELECT fold::INT AS fold, (SELECT session FROM s WHERE p = 1) AS train_from, (SELECT session FROM s WHERE p = 756 + fold * 252) AS train_to, (SELECT session FROM s WHERE p = 756 + fold * 252 + 22) AS test_from, (SELECT session FROM s WHERE p = 756 + fold * 252 + 273) AS test_to FROM k""")
def walk_forward_folds(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct()
    return resample.walk_forward_folds(s)
