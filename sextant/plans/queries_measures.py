"""Queries: measurements, walk-forward choice, capacity, unit roots and option trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions.windows import out
from ..operators import measure, paper, resample, stats
from ..sources.adapters import PANEL_SQL, table
from .catalogue import Catalogue, normal_sql
from .queries_features import S, _sma, market_panel
from .queries_models import chain
from .queries_trading import _CANDIDATES, _candidates

Q = Catalogue()


@Q.query(f"""WITH {PANEL_SQL}, x AS (SELECT *, ln(1 + ret) AS lr FROM panel), y AS (SELECT *, CASE WHEN count(lr) OVER w >= 21 THEN sum(lr * lr) OVER w * 252 / 21 END AS rv, 10 + (raw_volume % 10) AS iv FROM x WINDOW w AS ({S} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)),
d AS (SELECT symbol, iv * iv - rv AS d FROM y WHERE raw_volume IS NOT NULL)
SELECT symbol, count(*) AS n, round(avg(d), 4) + 0.0 AS mean, round(quantile_cont(d, 0.05), 4) + 0.0 AS p05, round(avg((d > 0)::INT), 6) AS share_positive FROM d WHERE d IS NOT NULL GROUP BY symbol""")
def variance_premium(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    iv = p.where("raw_volume IS NOT NULL").select("session", "symbol", (10 + F.col("raw_volume") % 10).alias("iv"))
    return measure.variance_premium(p, iv).select("symbol", "n", out(F.col("mean"), 4).alias("mean"), out(F.col("p05"), 4).alias("p05"), out(F.col("share_positive")).alias("share_positive"))


@Q.query(f"""WITH {PANEL_SQL}, f AS (SELECT symbol, session, coalesce(close / {_sma(20)} - 1 > 0.1, false) AS on_, lead(close, 21) OVER ({S}) / close - 1 AS f FROM panel),
g AS (SELECT *, (on_ AND NOT coalesce(lag(on_) OVER ({S}), false))::INT AS st FROM f)
SELECT symbol, on_ AS "on", count(f) AS n, round(avg(f), 6) + 0.0 AS mean, round(stddev_samp(f), 6) AS sd, sum(st)::BIGINT AS episodes FROM g GROUP BY 1, 2""")
def conditional_forward(spark, sf_dir):
    p = features.add(market_panel(spark, sf_dir), "sma_ratio(n=20)", "sma")
    return measure.conditional_forward(p, F.col("sma") > 0.1).select("symbol", "on", "n", out(F.col("mean")).alias("mean"), out(F.col("sd")).alias("sd"), "episodes")


def _daily(spark, sf_dir) -> DataFrame:
    """param, session, ret: the mean next-day return of symbols above their average, for three lengths of average."""
    p = features.compute(market_panel(spark, sf_dir), {f"s{n}": f"sma_ratio(n={n})" for n in (10, 20, 50)})
    p = p.withColumn("next", F.lead("ret").over(Window.partitionBy("symbol").orderBy("session")))
    parts = [p.groupBy("session").agg(F.coalesce(F.avg(F.when(F.col(f"s{n}") > 0, F.col("next"))), F.lit(0.0)).alias("ret")).withColumn("param", F.lit(n)) for n in (10, 20, 50)]
    return reduce(DataFrame.unionByName, parts)


_DAILY = ", ".join(f"d{n} AS (SELECT session, {n} AS param, coalesce(avg(CASE WHEN s{n} > 0 THEN nxt END), 0) AS ret FROM s GROUP BY session)" for n in (10, 20, 50))


@Q.query(f"""WITH {PANEL_SQL}, s AS (SELECT session, symbol, close / {_sma(10)} - 1 AS s10, close / {_sma(20)} - 1 AS s20, close / {_sma(50)} - 1 AS s50, lead(ret) OVER ({S}) AS nxt FROM panel), {_DAILY},
d AS (SELECT * FROM d10 UNION ALL SELECT * FROM d20 UNION ALL SELECT * FROM d50), n AS (SELECT session, row_number() OVER (ORDER BY session) AS p FROM (SELECT DISTINCT session FROM panel)),
k AS (SELECT unnest(range(0, ((SELECT max(p) FROM n) - 777) // 252)) AS fold), dp AS (SELECT d.*, p FROM d JOIN n USING (session)),
t AS (SELECT fold, param, avg(ret) / stddev_samp(ret) * sqrt(252) AS sh FROM dp JOIN k ON p BETWEEN 1 AND 756 + fold * 252 GROUP BY 1, 2),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sh DESC, param) = 1)
SELECT b.fold::INT AS fold, b.param, round(b.sh, 5) + 0.0 AS train_sharpe, count(*) AS n, round(avg(ret), 6) + 0.0 AS oos_mean FROM b JOIN dp ON dp.param = b.param AND p BETWEEN 756 + fold * 252 + 22 AND 756 + fold * 252 + 273 GROUP BY 1, 2, 3""")
def walk_forward_choice(spark, sf_dir):
    d = _daily(spark, sf_dir)
    folds = resample.walk_forward_folds(d.select("session").distinct())
    return measure.walk_forward_choice(d, folds).select("fold", "param", out(F.col("train_sharpe"), 5).alias("train_sharpe"), "n", out(F.col("oos_mean")).alias("oos_mean"))


@Q.query(f"""WITH {_CANDIDATES}, e AS (SELECT c.symbol, c.participation, l.ir AS price, unnest([1000.0, 25000.0, 1000000.0])::DOUBLE AS capital FROM cand c JOIN ld l ON l.symbol = c.symbol AND l.session = c.signal_session)
SELECT symbol, capital, count(*) AS n, round(quantile_cont(participation * capital / 5 / 10000, 0.5), 6) AS median_participation, round(avg((price <= capital / 5)::INT), 6) AS share_affordable, round(avg((participation * capital / 5 / 10000 <= 0.01)::INT), 6) AS share_feasible FROM e GROUP BY 1, 2""")
def capacity(spark, sf_dir):
    c = measure.capacity(_candidates(spark, sf_dir), ["symbol"], [1_000.0, 25_000.0, 1_000_000.0])
    return c.select("symbol", "capital", "n", *[out(F.col(x)).alias(x) for x in ("median_participation", "share_affordable", "share_feasible")])


@Q.query(f"""WITH {_CANDIDATES}, k AS (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS k) SELECT symbol, k, count(*) AS n, round(avg(gross_ret - k * cost_frac), 6) + 0.0 AS mean_net FROM cand, k GROUP BY 1, 2""")
def cost_stress(spark, sf_dir):
    """The mean net trade when all frictions are multiplied."""
    c = _candidates(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    return c.groupBy("symbol", "k").agg(F.count(F.lit(1)).alias("n"), out(F.avg(F.col("gross_ret") - F.col("k") * F.col("cost_frac"))).alias("mean_net"))


def _orders(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    quotes = e.where("event_type = 'view'").select(F.col("user_id").alias("account"), "at", (F.col("value") * 0.995).alias("bid"), (F.col("value") * 1.005).alias("ask"))
    orders = e.where("event_type IN ('purchase', 'click')").select(F.col("user_id").alias("account"), F.col("event_id").alias("order_id"), "at", F.when(F.col("event_type") == "purchase", 10.0).otherwise(-10.0).alias("quantity"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("limit"))
    return paper.with_quotes(orders, quotes, ["account"])


@Q.query("""WITH o AS (SELECT user_id AS account, event_id AS order_id, ts FROM events WHERE event_type IN ('purchase', 'click')), q AS (SELECT user_id AS account, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT o.account, o.order_id, round(q.value * 0.995, 6) AS bid, round(q.value * 1.005, 6) AS ask FROM o ASOF LEFT JOIN q ON o.account = q.account AND o.ts >= q.ts""")
def paper_quotes(spark, sf_dir):
    return _orders(spark, sf_dir).select("account", "order_id", out(F.col("bid")).alias("bid"), out(F.col("ask")).alias("ask"))


@Q.query(f"""WITH g AS (SELECT l_suppkey, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(m / 2, 6) + 0.0 AS post_mean, round(sqrt(0.5) * se, 6) + 0.0 AS post_sd, round({normal_sql('(m / 2 / (sqrt(0.5) * se))')}, 6) + 0.0 AS p_positive FROM g""")
def shrinkage_posterior(spark, sf_dir):
    """Posterior mean, sd and P(> 0) of each supplier's mean trade."""
    g = table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_discount") - F.col("l_tax")).groupBy("l_suppkey").agg(F.avg("r").alias("m"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se"))
    mean, sd, p = stats.shrinkage_posterior(F.col("m"), F.col("se"))
    return g.select("l_suppkey", out(mean).alias("post_mean"), out(sd).alias("post_sd"), out(p).alias("p_positive"))
