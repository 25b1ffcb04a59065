"""Queries: forward trades from open to close, and landed files through the data source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.windows import out
from ..sources import providers
from ..sources.adapters import table
from ..streaming.ledger import Rules, batch_ledger
from .catalogue import Catalogue

Q = Catalogue()

def kind() -> Column:
    """What an event does: purchases open, errors close, views quote, others nothing."""
    e = F.col("event_type")
    return F.when(e == "purchase", "open").when(e == "error", "close").when(e == "view", "quote")


#: A quote fills for two days, a trade is held for five.
RULES = Rules(2 * 86_400, 5 * 86_400)
_US = 1_000_000
_GONE = f"(w.o IS NOT NULL AND e.us >= w.o + {RULES.hold * _US})"
_HELD = f"(w.o IS NOT NULL AND NOT {_GONE})"
_FRESH = f"(w.qat IS NOT NULL AND e.us - w.qat <= {RULES.stale * _US})"


@Q.query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, value, CASE event_type WHEN 'purchase' THEN 'open' WHEN 'error' THEN 'close' ELSE 'quote' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'error', 'view')),
w AS (SELECT user_id, 0::BIGINT AS k, NULL::DOUBLE AS q, NULL::BIGINT AS qat, NULL::BIGINT AS o, NULL::DOUBLE AS en, NULL::BIGINT AS xo, NULL::DOUBLE AS xe, NULL::BIGINT AS co, NULL::DOUBLE AS ce, NULL::BIGINT AS cat, NULL::DOUBLE AS cx, NULL::BIGINT AS ro FROM e GROUP BY 1
 UNION ALL SELECT e.user_id, e.k, CASE WHEN kind = 'quote' THEN value ELSE w.q END, CASE WHEN kind = 'quote' THEN e.us ELSE w.qat END,
  CASE WHEN kind = 'open' AND NOT {_HELD} THEN CASE WHEN {_FRESH} THEN e.us END WHEN kind = 'close' AND {_FRESH} THEN NULL WHEN {_HELD} THEN w.o END,
  CASE WHEN kind = 'open' AND NOT {_HELD} THEN w.q ELSE w.en END,
  CASE WHEN {_GONE} THEN w.o END, CASE WHEN {_GONE} THEN w.en END,
  CASE WHEN kind = 'close' AND {_HELD} AND {_FRESH} THEN w.o END, CASE WHEN kind = 'close' AND {_HELD} AND {_FRESH} THEN w.en END, CASE WHEN kind = 'close' AND {_HELD} AND {_FRESH} THEN e.us END, CASE WHEN kind = 'close' AND {_HELD} AND {_FRESH} THEN w.q END,
  CASE WHEN kind = 'open' AND NOT {_HELD} AND NOT {_FRESH} THEN e.us END
 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1),
lst AS (SELECT user_id, arg_max(o, k) AS o, arg_max(en, k) AS en FROM (SELECT user_id, k, coalesce(o, -1) AS o, en FROM w) GROUP BY 1),
rows AS (SELECT user_id, xo AS opened, xe AS entry, xo + {RULES.hold * _US} AS closed, NULL AS exit, 'EXPIRED' AS status FROM w WHERE xo IS NOT NULL
 UNION ALL SELECT user_id, co, ce, cat, cx, 'CLOSED' FROM w WHERE co IS NOT NULL UNION ALL SELECT user_id, ro, NULL, NULL, NULL, 'REFUSED' FROM w WHERE ro IS NOT NULL
 UNION ALL SELECT user_id, o, en, o + {RULES.hold * _US}, NULL, 'EXPIRED' FROM lst WHERE o >= 0 AND o + {RULES.hold * _US} <= (SELECT max(us) FROM e))
SELECT user_id, opened, round(entry, 6) AS entry, closed, round(exit, 6) AS exit, status, round(exit / nullif(entry, 0) - 1, 6) + 0.0 AS ret FROM rows""")
def forward_ledger(spark, sf_dir):
    """Purchases open, errors close, views quote: trades of each user in the order of time."""
    r = batch_ledger(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", kind(), "value", RULES)
    return r.select("user_id", F.unix_micros("opened_at").alias("opened"), out(F.col("entry")).alias("entry"), F.unix_micros("closed_at").alias("closed"), out(F.col("exit")).alias("exit"), "status", out(F.col("ret")).alias("ret"))


@Q.query("""SELECT l_returnflag AS flag, l_shipdate::DATE AS day, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_suppkey >= 3 AND l_returnflag IN ('A', 'N') AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.02 GROUP BY 1, 2""")
def provider_trades(spark, sf_dir):
    """Line items through the data source; three of the four filters reach it."""
    providers.register(spark)
    t = spark.read.format("landed").options(provider="star", capability="trades", root=sf_dir).schema("l_suppkey bigint, l_returnflag string, l_shipdate timestamp_ntz, l_quantity double, l_discount double").load()
    t = t.where((F.col("l_suppkey") >= 3) & F.col("l_returnflag").isin("A", "N") & (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1995-01-01'")) & (F.col("l_discount") > 0.02))
    return t.groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@Q.query("SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events WHERE user_id < 40 GROUP BY 1")
def provider_ticks(spark, sf_dir):
    providers.register(spark)
    t = spark.read.format("landed").options(provider="star", capability="ticks", root=sf_dir).schema("user_id bigint, event_type string, value double").load()
    return t.where("user_id < 40").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), out(F.sum("value"), 4).alias("total"))
