"""Queries: cointegration, unit roots, factor residuals, variance shares, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import out
from ..operators import relative
from ..sources.adapters import PANEL_SQL, table
from .catalogue import Catalogue, normal_sql
from .queries_features import market_panel

Q = Catalogue()


def _p_sql(t: str, series: int) -> str:
    top, bottom, star, low, high = relative.SURFACE[series]
    poly = lambda c: " + ".join(f"{k!r} * power({t}, {i})" for i, k in enumerate(c))
    return f"CASE WHEN {t} > {top} THEN 1.0 WHEN {t} < {bottom} THEN 0.0 WHEN {t} <= {star} THEN {normal_sql(f'({poly(low)})')} ELSE {normal_sql(f'({poly(high)})')} END"


#: Pairs of log prices, residuals of y on x, and Dickey-Fuller with up to one lag: normal equations of one and two unknowns.
_EG = f"""{PANEL_SQL}, lp AS (SELECT symbol, session, ln(close) AS v FROM panel WHERE close > 0),
pr AS (SELECT y.symbol AS y, x.symbol AS x, session, y.v AS ly, x.v AS lx FROM lp y JOIN lp x USING (session) WHERE y.symbol <> x.symbol),
ft AS (SELECT y, x, count(*) AS n, regr_slope(ly, lx) AS b, regr_intercept(ly, lx) AS a FROM pr GROUP BY 1, 2),
us AS (SELECT y, x, session, n, b, ly - a - b * lx AS u FROM pr JOIN ft USING (y, x) WHERE n >= 100),
ds AS (SELECT *, lag(u) OVER w AS l, u - lag(u) OVER w AS d FROM us WINDOW w AS (PARTITION BY y, x ORDER BY session)),
d1 AS (SELECT *, lag(d) OVER (PARTITION BY y, x ORDER BY session) AS e FROM ds),
m0 AS (SELECT y, x, n, b, sum(l * l) AS ll, sum(l * d) AS ld, sum(d * d) AS dd, count(*) AS k FROM d1 WHERE l IS NOT NULL GROUP BY ALL),
m1 AS (SELECT y, x, n, b, sum(l * l) AS ll, sum(l * e) AS le, sum(e * e) AS ee, sum(l * d) AS ld, sum(e * d) AS ed, sum(d * d) AS dd, count(*) AS k FROM d1 WHERE e IS NOT NULL GROUP BY ALL),
s1 AS (SELECT *, (ee * ld - le * ed) / (ll * ee - le * le) AS r, (ll * ed - le * ld) / (ll * ee - le * le) AS g FROM m1),
c AS (SELECT m0.*, ld / ll AS r0, dd - ld * ld / ll AS q0 FROM m0),
j AS (SELECT c.y, c.x, c.n, c.b, r0 / sqrt(q0 / (c.k - 1) / c.ll) AS t0, s1.r / sqrt((s1.dd - s1.r * s1.ld - s1.g * s1.ed) / (s1.k - 2) * s1.ee / (s1.ll * s1.ee - s1.le * s1.le)) AS t1,
  s1.k * ln((s1.dd - s1.ld * s1.ld / s1.ll) / s1.k) + 2 AS a0, s1.k * ln((s1.dd - s1.r * s1.ld - s1.g * s1.ed) / s1.k) + 4 AS a1 FROM c JOIN s1 USING (y, x)),
t AS (SELECT y, x, n, b, CASE WHEN a1 < a0 THEN 1 ELSE 0 END AS lags, CASE WHEN a1 < a0 THEN t1 ELSE t0 END AS t FROM j)"""


@Q.query(f"WITH {_EG} SELECT ft.y, ft.x, ft.n, round(t.b, 5) + 0.0 AS hedge, round(t, 4) + 0.0 AS t, lags, round({_p_sql('t', 2)}, 5) + 0.0 AS p FROM ft LEFT JOIN t ON t.y = ft.y AND t.x = ft.x")
def engle_granger(spark, sf_dir):
    """All ordered pairs, with at most one lag, which SQL can follow."""
    e = relative.engle_granger(market_panel(spark, sf_dir), max_lag=1)
    return e.select("y", "x", "n", out(F.col("hedge"), 5).alias("hedge"), out(F.col("t"), 4).alias("t"), "lags", out(F.col("p"), 5).alias("p"))


@Q.query()
def engle_granger_lags(spark, sf_dir):
    """All ordered pairs, lags by sample size."""
    e = relative.engle_granger(market_panel(spark, sf_dir))
    return e.select("y", "x", "n", out(F.col("hedge"), 5).alias("hedge"), out(F.col("t"), 4).alias("t"), "lags", out(F.col("p"), 5).alias("p"))


#: With a constant: the same equations on values that are centred over each sample.
_ADF = f"""{PANEL_SQL}, us AS (SELECT symbol, session, ln(close) AS u, count(*) OVER (PARTITION BY symbol) AS n FROM panel WHERE close > 0),
ds AS (SELECT *, lag(u) OVER w AS l, u - lag(u) OVER w AS d FROM us WHERE n > 50 WINDOW w AS (PARTITION BY symbol ORDER BY session)),
d1 AS (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY session) AS e FROM ds),
m0 AS (SELECT symbol, n, var_pop(l) * count(*) AS ll, covar_pop(l, d) * count(*) AS ld, var_pop(d) * count(*) AS dd, count(*) AS k FROM d1 WHERE l IS NOT NULL GROUP BY ALL),
m1 AS (SELECT symbol, var_pop(l) * count(*) AS ll, covar_pop(l, e) * count(*) AS le, var_pop(e) * count(*) AS ee, covar_pop(l, d) * count(*) AS ld, covar_pop(e, d) * count(*) AS ed, var_pop(d) * count(*) AS dd, count(*) AS k FROM d1 WHERE e IS NOT NULL GROUP BY ALL),
s1 AS (SELECT *, (ee * ld - le * ed) / (ll * ee - le * le) AS r, (ll * ed - le * ld) / (ll * ee - le * le) AS g FROM m1),
j AS (SELECT m0.symbol, m0.n, m0.ld / m0.ll / sqrt((m0.dd - m0.ld * m0.ld / m0.ll) / (m0.k - 2) / m0.ll) AS t0, s1.r / sqrt((s1.dd - s1.r * s1.ld - s1.g * s1.ed) / (s1.k - 3) * s1.ee / (s1.ll * s1.ee - s1.le * s1.le)) AS t1,
  s1.k * ln((s1.dd - s1.ld * s1.ld / s1.ll) / s1.k) + 4 AS a0, s1.k * ln((s1.dd - s1.r * s1.ld - s1.g * s1.ed) / s1.k) + 6 AS a1 FROM m0 JOIN s1 USING (symbol)),
t AS (SELECT symbol, CASE WHEN a1 < a0 THEN 1 ELSE 0 END AS lags, CASE WHEN a1 < a0 THEN t1 ELSE t0 END AS t FROM j)"""


@Q.query(f"WITH {_ADF} SELECT symbol, n, round(t, 4) + 0.0 AS t, lags, round({_p_sql('t', 1)}, 5) + 0.0 AS p FROM (SELECT DISTINCT symbol, n FROM us) LEFT JOIN t USING (symbol)")
def unit_root_tests(spark, sf_dir):
    p = market_panel(spark, sf_dir).withColumn("x", F.log("close"))
    return relative.unit_root_tests(p, ["symbol"], "session", "x", max_lag=1).select("symbol", "n", out(F.col("t"), 4).alias("t"), "lags", out(F.col("p"), 5).alias("p"))


def _power_sql(gram: str, key: str) -> str:
    """The leading component by squaring each matrix g (symbols in order) 24 times; v: its unit vector, value, trace."""
    square = "list_transform(m, lambda p: list_transform(m, lambda q: list_dot_product(p, q)))"
    unit = lambda x: f"list_transform({x}, lambda row: list_transform(row, lambda c: c / list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i][i]))))"
    return f"""pw AS (SELECT {key}, g, {unit('g')} AS m, 0 AS it FROM {gram} UNION ALL SELECT {key}, g, {unit('sq')}, it + 1 FROM (SELECT *, {square} AS sq FROM pw WHERE it < 24)),
tp AS (SELECT {key}, g, m[list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]), list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))] AS c FROM pw WHERE it = 24),
ev AS (SELECT {key}, g, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM tp)"""


@Q.query(f"""WITH RECURSIVE {PANEL_SQL}, num AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM panel WHERE ret IS NOT NULL)),
rs AS (SELECT symbol, session, pos, coalesce(ret, 0) AS x FROM panel JOIN num USING (session)),
bl AS (SELECT b FROM range(4, 1000) r(b) WHERE b * 63 <= (SELECT max(pos) FROM num)),
wn AS (SELECT b, symbol, pos, x - avg(x) OVER (PARTITION BY b, symbol) AS x FROM bl JOIN rs ON pos >= b * 63 - 252 AND pos < b * 63),
cr AS (SELECT p.b, p.symbol AS i, q.symbol AS j, sum(p.x * q.x) AS g FROM wn p JOIN wn q ON p.b = q.b AND p.pos = q.pos GROUP BY 1, 2, 3),
rw AS (SELECT b, i, list(g ORDER BY j) AS row FROM cr GROUP BY 1, 2), gm AS (SELECT b, list(row ORDER BY i) AS g FROM rw GROUP BY 1), {_power_sql('gm', 'b')},
ld AS (SELECT b, v[k] AS w, symbol FROM ev, (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM rs))),
nw AS (SELECT session, symbol, x, w, sum(x * w) OVER (PARTITION BY session) AS f FROM rs JOIN ld USING (symbol) WHERE pos // 63 = b)
SELECT session, symbol, round(x - w * f, 5) + 0.0 AS residual FROM nw""")
def pca_residuals(spark, sf_dir):
    return relative.pca_residuals(market_panel(spark, sf_dir), 1, 252, 63).select("session", "symbol", out(F.col("residual"), 5).alias("residual"))


@Q.query(f"""WITH RECURSIVE {PANEL_SQL}, hv AS (SELECT symbol, session, ret AS x, count(*) OVER (PARTITION BY session) AS n FROM panel WHERE ret IS NOT NULL),
fl AS (SELECT symbol, session, x - avg(x) OVER (PARTITION BY symbol) AS x FROM hv WHERE n = (SELECT count(DISTINCT symbol) FROM hv)),
cr AS (SELECT p.symbol AS i, q.symbol AS j, sum(p.x * q.x) AS g FROM fl p JOIN fl q USING (session) GROUP BY 1, 2), rw AS (SELECT i, list(g ORDER BY j) AS row FROM cr GROUP BY 1),
gm AS (SELECT 0 AS b, list(row ORDER BY i) AS g FROM rw), {_power_sql('gm', 'b')}
SELECT 1 AS component, round(list_dot_product(v, list_transform(g, lambda row: list_dot_product(row, v))) / list_sum(list_transform(range(1, len(g) + 1), lambda i: g[i][i])), 6) AS share FROM ev WHERE g IS NOT NULL""")
def explained_variance(spark, sf_dir):
    return relative.explained_variance(market_panel(spark, sf_dir)).select("component", out(F.col("share")).alias("share"))


@Q.query()
def correlation_clusters(spark, sf_dir):
    """Suppliers by the correlation of their monthly mean prices' changes."""
    li = table(spark, sf_dir, "lineitem")
    monthly = li.groupBy(F.col("l_suppkey").alias("symbol"), F.trunc("l_shipdate", "month").alias("session")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    from pyspark.sql import Window

    p = monthly.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("session")) - 1)
    return relative.return_clusters(p, 0.25)
