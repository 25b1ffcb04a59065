"""Queries: point-in-time joins, intervals, sets and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import out
from ..operators import pit, security, validation
from ..operators import panel as P
from ..sources.adapters import ACTIONS_SQL, BARS_SQL, PANEL_SQL, bars_daily, corporate_actions, identifier_intervals, macro_vintages, table
from .catalogue import Catalogue
from .queries_features import market_panel

Q = Catalogue()
_MACRO = "m AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS observation_date, o_orderdate::TIMESTAMP AS available_at, o_totalprice AS value, o_orderkey AS seq FROM orders)"
_INTERVALS = "iv AS (SELECT user_id AS security_id, event_type AS value, min(ts)::DATE AS valid_from, max(ts)::DATE AS valid_to FROM events GROUP BY 1, 2)"
_T = "1997-06-30 12:00:00"


@Q.query(f"""WITH {_MACRO}, d AS (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate::TIMESTAMP AS decision_at FROM orders),
fresh AS (SELECT * FROM (SELECT *, max(observation_date) OVER (PARTITION BY series_id ORDER BY available_at, observation_date, seq ROWS UNBOUNDED PRECEDING) AS top FROM m) WHERE observation_date = top),
one AS (SELECT series_id, available_at, last(value ORDER BY observation_date, seq) AS value, max(observation_date) AS period FROM fresh GROUP BY series_id, available_at)
SELECT d.series_id, d.decision_at, value, period FROM d ASOF LEFT JOIN one o ON d.series_id = o.series_id AND d.decision_at >= o.available_at""")
def asof_vintage(spark, sf_dir):
    m = macro_vintages(spark, sf_dir)
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("decision_at")).distinct()
    return pit.asof_backward(d, m, ["series_id"]).select("series_id", "decision_at", "value", "period")


@Q.query(f"""WITH {_MACRO} SELECT series_id, observation_date, value, seq FROM m WHERE available_at <= TIMESTAMP '{_T}'
QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY available_at DESC, seq DESC) = 1""")
def pit_snapshot(spark, sf_dir):
    m = macro_vintages(spark, sf_dir)
    return pit.as_of(m, F.lit(_T).cast("timestamp"), ["series_id", "observation_date"]).select("series_id", "observation_date", "value", "seq")


@Q.query("""SELECT e.event_id, s.session FROM events e ASOF LEFT JOIN (SELECT DISTINCT ts::DATE AS session, ts::DATE + INTERVAL 16 HOUR AS close_at FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5) s ON e.ts <= s.close_at""")
def reaction_session(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    days = e.where(F.dayofweek("ts").between(2, 6)).select(F.to_date("ts").alias("session")).distinct()
    s = days.withColumn("close_at", F.col("session").cast(e.schema["ts"].dataType) + F.expr("INTERVAL 16 HOURS"))
    return pit.asof_forward(e.select("event_id", "ts"), s, "ts").select("event_id", "session")


@Q.query(f"""WITH {_INTERVALS}, q AS (SELECT DISTINCT event_type AS value, ts::DATE AS as_of FROM events)
SELECT q.value, q.as_of, count(DISTINCT security_id) AS n_matches, CASE WHEN count(DISTINCT security_id) = 1 THEN min(security_id) END AS security_id
FROM q LEFT JOIN iv ON q.value = iv.value AND as_of BETWEEN valid_from AND valid_to GROUP BY 1, 2""")
def resolve_identifier(spark, sf_dir):
    i = identifier_intervals(spark, sf_dir).withColumnRenamed("id_value", "value")
    q = table(spark, sf_dir, "events").select(F.col("event_type").alias("value"), F.to_date("ts").alias("as_of")).distinct()
    return security.resolve(i, q)


@Q.query(f"""WITH {_INTERVALS}, q AS (SELECT DISTINCT user_id AS security_id, ts::DATE AS as_of FROM events)
SELECT q.security_id, q.as_of, arg_max(value, row(valid_from, value)) AS value FROM q LEFT JOIN iv ON q.security_id = iv.security_id AND as_of BETWEEN valid_from AND valid_to GROUP BY 1, 2""")
def attribute_as_of(spark, sf_dir):
    i = identifier_intervals(spark, sf_dir).withColumnRenamed("id_value", "value")
    q = table(spark, sf_dir, "events").select(F.col("user_id").alias("security_id"), F.to_date("ts").alias("as_of")).distinct()
    return security.attribute(i, q)


@Q.query(f"""WITH {_INTERVALS}, l AS (SELECT *, lead(valid_from) OVER w AS other_from, lead(security_id) OVER w AS other_id FROM iv WINDOW w AS (PARTITION BY value ORDER BY valid_from, security_id))
SELECT value, security_id, other_id, valid_from, other_from FROM l WHERE other_from <= valid_to AND other_id <> security_id""")
def identifier_overlaps(spark, sf_dir):
    return security.overlaps(identifier_intervals(spark, sf_dir).withColumnRenamed("id_value", "value"))


def _membership(spark, sf_dir):
    """Members of one index: a symbol's spell of 200 sessions every 300, announced ten days before it begins."""
    bars = bars_daily(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("session")) - 1
    numbered = bars.select("symbol", "session", n.alias("n"))
    starts = numbered.where("n % 300 = 0").select("symbol", F.col("session").alias("start_date"), F.col("n").alias("k"))
    ends = numbered.where("n % 300 = 200").select("symbol", F.col("session").alias("end_date"), (F.col("n") - 200).alias("k"))
    m = starts.join(ends, ["symbol", "k"], "left").withColumn("available_at", F.date_add("start_date", F.when(F.col("k") % 600 == 0, -10).otherwise(5)).cast("timestamp") + F.expr("INTERVAL 22 HOURS"))
    return bars, m.drop("k")


_MEMBERS = """, mn AS (SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS n FROM bars),
mm AS (SELECT a.symbol, a.session AS start_date, b.session AS end_date, a.session + CASE WHEN a.n % 600 = 0 THEN -10 ELSE 5 END AS told_date
  FROM mn a LEFT JOIN mn b ON a.symbol = b.symbol AND b.n = a.n + 200 WHERE a.n % 300 = 0)"""


@Q.query(f"""WITH {PANEL_SQL}{_MEMBERS}
SELECT p.session, p.symbol, EXISTS (SELECT 1 FROM mm WHERE mm.symbol = p.symbol AND p.session >= greatest(mm.start_date, mm.told_date + 1) AND p.session < coalesce(mm.end_date, DATE '9999-12-31')) AS member FROM spine p""")
def membership_mask(spark, sf_dir):
    bars, m = _membership(spark, sf_dir)
    return security.membership_mask(P.spine(bars), m)


@Q.query(f"""WITH {BARS_SQL}{_MEMBERS} SELECT DISTINCT symbol FROM mm WHERE start_date <= DATE '1996-03-15' AND coalesce(end_date, DATE '9999-12-31') > DATE '1996-03-15' AND told_date + INTERVAL 22 HOUR <= TIMESTAMP '1996-03-15 00:00:00'""")
def universe_members(spark, sf_dir):
    return security.members(_membership(spark, sf_dir)[1], "1996-03-15", F.lit("1996-03-15 00:00:00").cast("timestamp"))


@Q.query(f"""WITH {PANEL_SQL}, mn AS (SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM bars),
sec AS (SELECT symbol, min(session) AS a, max(session) - 100 AS b FROM bars GROUP BY symbol),
hl AS (SELECT symbol, session AS f, lead(session, 7) OVER (PARTITION BY symbol ORDER BY session) AS t, n FROM mn),
h AS (SELECT symbol, f, t FROM hl WHERE n % 400 = 0)
SELECT p.session, p.symbol, p.session BETWEEN sec.a AND sec.b AND coalesce(p.raw_volume > 0, false) AND NOT EXISTS (SELECT 1 FROM h WHERE h.symbol = p.symbol AND p.session >= f AND p.session < coalesce(t, DATE '9999-12-31')) AS tradable
FROM panel p JOIN sec USING (symbol)""")
def tradable_mask(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    securities = bars.groupBy(F.col("symbol").alias("security_id")).agg(F.min("session").alias("first_session"), F.date_sub(F.max("session"), 100).alias("last_session"))
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("session"))
    numbered = bars.select("symbol", F.col("session").alias("event_date"), n.alias("n"))
    halts = numbered.where("n % 400 = 0").select("symbol", F.lit("halt").alias("event_type"), "event_date")
    resumes = numbered.where("n > 7 AND n % 400 = 7").select("symbol", F.lit("resume").alias("event_type"), "event_date")
    return security.tradable(P.densify(bars), securities, halts.unionByName(resumes))


_BOUNDS = {"train": ("1995-01-01", "1997-12-31"), "validation": ("1998-01-15", "1999-12-31"), "test": ("2000-01-15", "2001-12-31")}


@Q.query("""SELECT part, count(*) AS n FROM (SELECT CASE
  WHEN e BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND x BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'train'
  WHEN e BETWEEN DATE '1998-01-15' AND DATE '1999-12-31' AND x BETWEEN DATE '1998-01-15' AND DATE '1999-12-31' THEN 'validation'
  WHEN e BETWEEN DATE '2000-01-15' AND DATE '2001-12-31' AND x BETWEEN DATE '2000-01-15' AND DATE '2001-12-31' THEN 'test' ELSE 'embargo' END AS part
  FROM (SELECT l_shipdate::DATE AS e, l_shipdate::DATE + (l_linenumber * 5)::INT AS x FROM lineitem)) GROUP BY part""")
def partition_trades(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("e"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") * 5).alias("x"))
    return t.groupBy(pit.partition_of(F.col("e"), F.col("x"), _BOUNDS).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@Q.query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark, sf_dir):
    return pit.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@Q.query("""SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2""")
def dedup_first(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority", "o_orderstatus").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n = 1")
    return o.select("o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("first_key"))


@Q.query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50""")
def topk_ranked(spark, sf_dir):
    rank = F.create_map(F.lit("F"), F.lit(0), F.lit("P"), F.lit(1))[F.col("o_orderstatus")]
    return table(spark, sf_dir, "orders").orderBy(F.coalesce(rank, F.lit(2)), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus", "o_totalprice")


@Q.query("""SELECT u.user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts::DATE <= DATE '2024-01-10') u WHERE u.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts::DATE <= DATE '2024-01-10')""")
def open_findings(spark, sf_dir):
    """Raised minus resolved: an anti join."""
    e = table(spark, sf_dir, "events")
    e = e.where(F.to_date("ts") <= F.lit("2024-01-10"))
    return e.where("event_type = 'purchase'").select("user_id").distinct().join(e.where("event_type = 'error'").select("user_id"), "user_id", "left_anti")


@Q.query(f"WITH {PANEL_SQL} SELECT a.symbol AS sym_a, b.symbol AS sym_b, round(corr(a.ret, b.ret), 6) + 0.0 AS rho, count(*) AS n FROM panel a JOIN panel b ON a.session = b.session AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def pair_correlations(spark, sf_dir):
    p = market_panel(spark, sf_dir).where("ret IS NOT NULL")
    a, b = p.select("session", F.col("symbol").alias("sym_a"), F.col("ret").alias("ra")), p.select("session", F.col("symbol").alias("sym_b"), F.col("ret").alias("rb"))
    return a.join(b, "session").where("sym_a < sym_b").groupBy("sym_a", "sym_b").agg(out(F.corr("ra", "rb")).alias("rho"), F.count(F.lit(1)).alias("n"))


@Q.query(f"""WITH {ACTIONS_SQL}, s AS (SELECT DISTINCT session FROM bars WHERE dayofweek(session) BETWEEN 1 AND 5), sn AS (SELECT session, row_number() OVER (ORDER BY session) AS p FROM s),
b AS (SELECT b.*, lag(close) OVER (PARTITION BY b.symbol ORDER BY b.session) AS before, s.session IS NOT NULL AS is_s, a.symbol IS NOT NULL AS act
  FROM bars b LEFT JOIN s USING (session) LEFT JOIN (SELECT DISTINCT symbol, ex_date FROM actions) a ON a.symbol = b.symbol AND a.ex_date = b.session),
r AS (SELECT *, sum(CASE WHEN close = before THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY session) AS run FROM b),
spans AS (SELECT symbol, min(session) AS f, max(session) AS t FROM bars GROUP BY symbol),
held AS (SELECT symbol, count(DISTINCT session) AS n FROM bars SEMI JOIN s USING (session) GROUP BY symbol)
SELECT * FROM (VALUES ('non_positive_or_missing_price', 'ERROR', (SELECT count(*) FROM b WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL)),
 ('ohlc_inconsistent', 'ERROR', (SELECT count(*) FROM b WHERE high < greatest(open, close, low) - 1e-9 OR low > least(open, close, high) + 1e-9)),
 ('negative_volume', 'ERROR', (SELECT count(*) FROM b WHERE volume < 0)), ('non_trading_session', 'ERROR', (SELECT count(*) FROM b WHERE NOT is_s)),
 ('extreme_move_without_action', 'WARNING', (SELECT count(*) FROM b WHERE abs(close / before - 1) > 0.4 AND NOT act)), ('zero_volume', 'WARNING', (SELECT count(*) FROM b WHERE volume = 0)),
 ('stale_close', 'WARNING', (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY symbol, run HAVING count(*) > 5))),
 ('missing_sessions', 'WARNING', (SELECT coalesce(sum(y.p - x.p + 1 - held.n), 0)::BIGINT FROM spans JOIN sn x ON x.session = f JOIN sn y ON y.session = t JOIN held USING (symbol))),
 ('duplicate_key', 'ERROR', 0)) AS v("check", severity, n)""")
def validate_bars_issues(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    sessions = bars.select("session").distinct().where(F.dayofweek("session").between(2, 6))
    return validation.validate_bars(bars, sessions, corporate_actions(bars))


@Q.query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_violations(spark, sf_dir):
    return validation.key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@Q.query(f"""WITH {PANEL_SQL}, ev AS (SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM bars),
pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS i FROM panel),
m AS (SELECT p.*, k.ret AS mret FROM pos p JOIN (SELECT session, ret FROM panel WHERE symbol = 'AF') k USING (session)),
evp AS (SELECT p.symbol, p.i FROM ev JOIN pos p USING (symbol, session) WHERE n % 250 = 0 AND symbol <> 'AF'),
est AS (SELECT e.symbol, e.i, CASE WHEN count(*) FILTER (m.ret IS NOT NULL AND m.mret IS NOT NULL) >= 30 THEN covar_samp(m.ret, m.mret) / var_samp(CASE WHEN m.ret IS NOT NULL THEN m.mret END) END AS beta
  FROM evp e JOIN m ON m.symbol = e.symbol AND m.i >= e.i - 75 AND m.i < e.i - 15 GROUP BY 1, 2),
ar AS (SELECT e.symbol, e.i, m.i - e.i AS rel, m.ret - beta * m.mret AS ar FROM est e JOIN m ON m.symbol = e.symbol AND m.i BETWEEN e.i - 5 AND e.i + 10),
good AS (SELECT symbol, i FROM ar GROUP BY 1, 2 HAVING count(*) = 16 AND count(ar) = 16)
SELECT rel AS rel_day, count(*) AS n, round(avg(ar), 6) + 0.0 AS mean_ar, round(sum(avg(ar)) OVER (ORDER BY rel), 6) + 0.0 AS car FROM ar SEMI JOIN good USING (symbol, i) GROUP BY rel""")
def event_study_car(spark, sf_dir):
    from ..operators.events import event_study

    bars = bars_daily(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("session"))
    events = bars.withColumn("n", n).where("n % 250 = 0 AND symbol <> 'AF'").select("symbol", "session")
    return event_study(market_panel(spark, sf_dir), events, "AF", pre=5, post=10, estimation=60, gap=10).select("rel_day", "n", out(F.col("mean_ar")).alias("mean_ar"), out(F.col("car")).alias("car"))


@Q.query("""WITH d AS (SELECT ts::DATE AS session, max(ts + to_microseconds((value * 300000000)::BIGINT)) AS available_at FROM events GROUP BY 1),
f AS (SELECT session, lead(session) OVER (ORDER BY session) AS fill_session FROM (SELECT DISTINCT ts::DATE AS session FROM events))
SELECT session, epoch_us(available_at) AS available_us, fill_session FROM d JOIN f USING (session) WHERE fill_session + INTERVAL '570 minutes' <= available_at""")
def timing_violations(spark, sf_dir):
    """Events as decisions that are known five minutes late for each unit of value, filled at 09:30 of the next day with events."""
    e = table(spark, sf_dir, "events").withColumn("session", F.to_date("ts"))
    late = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 300_000_000).cast("bigint"))
    fills = e.select("session").distinct().withColumn("fill_at", F.col("session").cast("timestamp") + F.expr("INTERVAL '570' MINUTE"))
    v = pit.timing_violations(e.select("session", late.alias("available_at")), fills)
    return v.select("session", F.unix_micros("available_at").alias("available_us"), "fill_session")
