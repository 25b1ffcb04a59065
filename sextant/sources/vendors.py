"""Vendor files as canonical relations: CSV and JSON that have been landed are read by Spark and normalised as columns.

Fetching over a network is not part of the engine; each reader takes a path. Rows off the calendar (session, open_at,
close_at) are dropped by a semi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


class NotConfigured(RuntimeError):
    """A provider without its credentials."""


def calendar(spark: SparkSession, start: str, end: str, closed: list[str] = (), early: list[str] = ()) -> DataFrame:
    """session, open_at, close_at, is_early: weekdays less the closed dates, 09:30 to 16:00 (early: 13:00) New York time."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS session").where(F.dayofweek("session").between(2, 6))
    days = days.where(~F.col("session").cast("string").isin(list(closed))) if closed else days
    is_early = F.col("session").cast("string").isin(list(early)) if early else F.lit(False)
    at = lambda clock: F.to_utc_timestamp(F.concat_ws(" ", F.col("session").cast("string"), clock), NEW_YORK)
    return days.select("session", at(F.lit("09:30:00")).alias("open_at"), at(F.when(is_early, "13:00:00").otherwise("16:00:00")).alias("close_at"), is_early.alias("is_early"))


def bar_frame(raw: DataFrame, cal: DataFrame, symbol: Column, source: str, delay_minutes: int = 15) -> DataFrame:
    """Bars from columns session and open .. volume as text: bad numbers are NULL, availability is the close plus the delay."""
    typed = raw.select(F.to_date("session").alias("session"), symbol.alias("symbol"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in ("open", "high", "low", "close", "volume")])
    at = F.col("close_at") + F.make_dt_interval(mins=F.lit(delay_minutes))
    return typed.join(cal.select("session", "close_at"), "session").select("symbol", "session", "open", "high", "low", "close", "volume", at.alias("available_at"), F.lit(source).alias("source"))


def read_stooq(spark: SparkSession, path: str, symbol: str, cal: DataFrame) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    if "Date" not in raw.columns:
        raise ValueError("no Date header: an error page?")
    raw = raw.withColumn("Volume", F.col("Volume") if "Volume" in raw.columns else F.lit(None).cast("string"))
    return bar_frame(raw.withColumnsRenamed({"Date": "session"} | {c: c.lower() for c in ("Open", "High", "Low", "Close", "Volume")}), cal, F.lit(symbol), "stooq")


TIINGO = "date string, open string, high string, low string, close string, volume string, splitFactor double, divCash double"


def read_tiingo(spark: SparkSession, path: str, symbol: str, cal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars, and actions where the split factor is not 1 or cash was paid, available at the ex-date's open."""
    raw = spark.read.schema(TIINGO).option("multiLine", True).json(path).withColumn("session", F.substring("date", 1, 10))
    acts = raw.select(F.lit(symbol).alias("symbol"), F.to_date("session").alias("ex_date"), F.explode(F.array(
        F.struct(F.lit("split").alias("action"), F.when(F.col("splitFactor") != 1, F.col("splitFactor")).alias("value")),
        F.struct(F.lit("dividend").alias("action"), F.when(F.col("divCash") > 0, F.col("divCash")).alias("value")))).alias("a")).where("a.value IS NOT NULL")
    acts = acts.select("symbol", "ex_date", "a.action", "a.value").join(cal.select(F.col("session").alias("ex_date"), F.col("open_at").alias("available_at")), "ex_date").withColumn("source", F.lit("tiingo"))
    return bar_frame(raw, cal, F.lit(symbol), "tiingo"), acts


def read_fred(spark: SparkSession, path: str, series_id: str, vintages: bool, lag_days: int = 1) -> DataFrame:
    """Observations; '.' is missing. Vintages are known at 23:59 New York time of their date, others a lag later at 17:00."""
    raw = spark.read.schema("observations array<struct<date:string,value:string,realtime_start:string>>").option("multiLine", True).json(path)
    o = raw.select(F.explode("observations").alias("o")).select("o.*").where("value <> '.'")
    when = F.concat_ws(" ", F.col("realtime_start"), F.lit("23:59:00")) if vintages else F.concat_ws(" ", F.date_add(F.to_date("date"), lag_days).cast("string"), F.lit("17:00:00"))
    return o.select(F.lit(series_id).alias("series_id"), F.to_date("date").alias("observation_date"), F.to_utc_timestamp(when, NEW_YORK).alias("available_at"), F.expr("try_cast(value AS double)").alias("value"), F.lit("fred").alias("source"))


def read_index_csv(spark: SparkSession, path: str, index: str, cal: DataFrame, delay_minutes: int = 30) -> DataFrame:
    """Index levels: the CLOSE column, else the index's own or the last."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.upper().strip(): c for c in raw.columns}
    col = names.get("CLOSE") or names.get(index.upper()) or raw.columns[-1]
    day = F.coalesce(F.expr(f"try_to_date(`{names['DATE']}`, 'M/d/yyyy')"), F.expr(f"try_to_date(`{names['DATE']}`, 'yyyy-MM-dd')"))
    v = raw.select(day.alias("session"), F.expr(f"try_cast(`{col}` AS double)").alias("value")).where("value IS NOT NULL")
    return v.join(cal.select("session", "close_at"), "session").select(F.lit(index).alias("series_id"), F.col("session").alias("observation_date"), (F.col("close_at") + F.make_dt_interval(mins=F.lit(delay_minutes))).alias("available_at"), "value", F.lit("cboe").alias("source"))


def read_local_csv(spark: SparkSession, folder: str, columns: dict[str, str], cal: DataFrame, start: str, end: str) -> DataFrame:
    """One CSV per symbol, named after it; columns: canonical name to the file's header."""
    raw = spark.read.option("header", True).csv(f"{folder}/*.csv").select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("_symbol"))
    named = raw.select("_symbol", *[F.col(h).alias(c) for c, h in columns.items()])
    return bar_frame(named, cal, F.col("_symbol"), "local_csv").where(F.col("session").between(F.lit(start), F.lit(end)))


def timing(filed_at: Column, open_at: Column, close_at: Column) -> Column:
    """Before, during or after that day's session; no session counts as before."""
    return F.when(open_at.isNull() | (filed_at < open_at), "BMO").when(filed_at < close_at, "DURING").otherwise("AMC")


FILING = "accessionNumber array<string>, reportDate array<string>, acceptanceDateTime array<string>, form array<string>, items array<string>"


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Pages of columns as rows, one per accession number (the first), by acceptance time."""
    raw = spark.read.schema(FILING).option("multiLine", True).json(path)
    z = raw.select(F.explode(F.arrays_zip(*[F.col(c.split()[0]) for c in FILING.split(", ")])).alias("f")).select("f.*")
    w = Window.partitionBy("accessionNumber").orderBy("acceptanceDateTime")
    one = z.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.select("accessionNumber", F.to_date("reportDate").alias("report_date"), F.to_timestamp("acceptanceDateTime").alias("accepted_at"), "form", "items")


def earnings(filings: DataFrame, by: list[str]) -> DataFrame:
    """by, period_end, accepted_at, accession: one results release (8-K, item 2.02) for each fiscal period.

    Candidates come after the period's end and by the next one's (75 days at most); of several the one whose lag is
    nearest the median lag of the eight nearest periods with a single candidate (30 days without any); ties: the earlier.
    A release serves one period: the earlier period that ranks it first keeps it.
    """
    periods = filings.where(F.col("form").isin("10-Q", "10-K")).select(*by, F.col("report_date").alias("period_end")).distinct()
    w = Window.partitionBy(*by).orderBy("period_end")
    periods = periods.withColumn("last", F.least(F.coalesce(F.lead("period_end").over(w), F.lit("9999-12-31").cast("date")), F.date_add("period_end", 75))).withColumn("no", F.row_number().over(w))
    news = filings.where((F.col("form") == "8-K") & F.array_contains(F.split("items", ","), "2.02")).select(*by, "accepted_at", F.col("accessionNumber").alias("accession"))
    c = periods.join(news, by).where((F.to_date("accepted_at") > F.col("period_end")) & (F.to_date("accepted_at") <= F.col("last")))
    c = c.withColumn("lag", F.datediff(F.to_date("accepted_at"), "period_end")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "period_end")))
    single = c.where("_n = 1").select(*by, F.col("no").alias("_no"), F.col("lag").alias("_lag"))
    j = c.select(*by, "no").distinct().join(single, by, "left").where("_no IS NULL OR _no <> no")
    near = j.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "no").orderBy(F.abs(F.col("_no") - F.col("no")), "_no"))).where("_k <= 8")
    usual = near.groupBy(*by, "no").agg(F.expr("percentile(_lag, 0.5)").alias("usual"))
    r = c.join(usual, [*by, "no"], "left").withColumn("_d", F.abs(F.col("lag") - F.coalesce("usual", F.lit(30.0))))
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "no").orderBy("_d", "accepted_at", "accession"))).where("_k = 1")
    return r.withColumn("_u", F.row_number().over(Window.partitionBy(*by, "accession").orderBy("no"))).where("_u = 1").select(*by, "period_end", "accepted_at", "accession")


def ticker_map(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """ticker, cik of JSON payloads that map a key to {cik_str, ticker}: tickers in capitals, with '-' for '.'."""
    kind = "map<string, struct<cik_str: bigint, ticker: string>>"
    each = payloads.select(F.explode(F.map_values(F.from_json(text, kind))).alias("e"))
    return each.select(F.replace(F.upper("e.ticker"), F.lit("."), F.lit("-")).alias("ticker"), F.col("e.cik_str").alias("cik"))
