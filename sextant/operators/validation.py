"""Checks of relations: schema, keys, bars and actions. Each gives an issues table: check, severity, n, examples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"str": {"string"}, "float": {"double", "float", "int", "bigint", "smallint", "tinyint", "decimal"}, "int": {"int", "bigint", "smallint", "tinyint", "double", "float"},
         "date": {"date"}, "ts": {"timestamp"}, "bool": {"boolean"}}


@dataclass(frozen=True)
class TableSchema:
    """Column kinds, primary key and optional columns of a canonical table."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    optional: dict[str, str]

    def problems(self, df: DataFrame) -> list[str]:
        """Missing columns and wrong kinds, from the schema alone."""
        have = {c: t.split("(")[0] for c, t in df.dtypes}
        out = [f"missing column {c}" for c in self.columns if c not in have]
        for c, kind in (self.columns | self.optional).items():
            if c in have and have[c] not in KINDS[kind]:
                out.append(f"column {c}: {have[c]} is no {kind}")
        return out


def _schema(name: str, key: str, columns: str, optional: str = "") -> TableSchema:
    pairs = lambda text: dict(x.split(":") for x in text.split())
    return TableSchema(name, pairs(columns), tuple(key.split()), pairs(optional))


#: Fixed shapes of the canonical tables.
SCHEMAS = {s.name: s for s in (
    _schema("bars_daily", "symbol session", "symbol:str session:date open:float high:float low:float close:float volume:float available_at:ts source:str", "vwap:float trades:int"),
    _schema("bars_intraday", "symbol bar_start", "symbol:str bar_start:ts bar_end:ts open:float high:float low:float close:float volume:float available_at:ts source:str"),
    _schema("corporate_actions", "symbol ex_date action", "symbol:str ex_date:date action:str value:float available_at:ts source:str"),
    _schema("earnings_events", "symbol fiscal_period", "symbol:str fiscal_period:str announce_time:ts timing:str available_at:ts source:str", "scheduled_available_at:ts eps_actual:float revenue_actual:float cik:int accession:str"),
    _schema("earnings_estimates", "symbol fiscal_period metric available_at", "symbol:str fiscal_period:str metric:str available_at:ts mean:float stdev:float n_estimates:int source:str"),
    _schema("option_quotes_eod", "underlying session expiration strike right", "underlying:str session:date expiration:date strike:float right:str bid:float ask:float volume:float open_interest:float underlying_price:float quote_time:ts available_at:ts source:str", "iv:float delta:float gamma:float theta:float vega:float style:str multiplier:float"),
    _schema("macro_series", "series_id observation_date available_at", "series_id:str observation_date:date available_at:ts value:float source:str"),
    _schema("index_membership", "index_id symbol start_date", "index_id:str symbol:str start_date:date end_date:date available_at:ts source:str"),
    _schema("classifications", "symbol scheme level start_date", "symbol:str scheme:str level:str start_date:date code:str end_date:date available_at:ts source:str"),
    _schema("short_interest", "symbol settlement_date", "symbol:str settlement_date:date short_interest:float available_at:ts source:str", "avg_daily_volume:float days_to_cover:float"),
    _schema("fundamentals", "symbol fiscal_period metric available_at", "symbol:str fiscal_period:str metric:str available_at:ts period_end:date value:float source:str"),
    _schema("securities", "security_id", "security_id:str asset_type:str first_session:date last_session:date available_at:ts source:str", "delisting_reason:str delisting_return:float delisting_value:float"),
    _schema("security_identifiers", "security_id id_type valid_from", "security_id:str id_type:str valid_from:date value:str valid_to:date available_at:ts source:str"),
    _schema("security_events", "security_id event_type event_date", "security_id:str event_type:str event_date:date available_at:ts source:str", "counterparty_id:str cash_per_share:float shares_per_share:float detail:str"),
)}


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """key, n: keys held by more than one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """duplicates: rows beyond the first of each key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def _issue(df: DataFrame, check: str, severity: str, bad: Column, example: Column) -> DataFrame:
    """One row: count and five smallest examples of the rows that fail."""
    hits = df.where(F.coalesce(bad, F.lit(False))).select(example.alias("_e"))
    few = hits.distinct().orderBy("_e").limit(5).agg(F.array_join(F.sort_array(F.collect_list("_e")), ";").alias("examples"))
    return hits.agg(F.count(F.lit(1)).alias("n")).crossJoin(few).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n", "examples")  # one row each


def validate_bars(bars: DataFrame, sessions: DataFrame, actions: DataFrame | None = None, extreme: float = 0.4, stale: int = 5) -> DataFrame:
    """check, severity, n for daily bars: prices, brackets, volume, sessions, availability, gaps, jumps, repeats.

    sessions: session, and close_at if availability is to be checked. All row checks come from one pass over the bars with
    one window by symbol; gaps compare with the sessions between a symbol's first and last bar.
    """
    w = Window.partitionBy("symbol").orderBy("session")
    cal = F.broadcast(sessions) if sessions.limit(200_000).count() < 200_000 else sessions
    b = bars.join(cal.withColumn("_is", F.lit(True)), "session", "left")
    b = b.withColumn("_before", F.lag("close").over(w)).withColumn("_jump", F.col("close") / F.nullif("_before", F.lit(0.0)) - 1)
    if actions is not None:
        b = b.join(actions.select("symbol", F.col("ex_date").alias("session"), F.lit(True).alias("_act")).distinct(), ["symbol", "session"], "left")
    else:
        b = b.withColumn("_act", F.lit(None).cast("boolean"))
    run = F.sum(F.when(F.col("close") == F.col("_before"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("_run", run)
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bracket = (F.col("high") < F.greatest("open", "close", "low") - 1e-9) | (F.col("low") > F.least("open", "close", "high") + 1e-9)
    checks = {
        "non_positive_or_missing_price": ("ERROR", reduce(lambda a, c: a | c.isNull() | (c <= 0), prices, F.lit(False))),
        "ohlc_inconsistent": ("ERROR", bracket),
        "negative_volume": ("ERROR", F.col("volume") < 0),
        "non_trading_session": ("ERROR", F.col("_is").isNull()),
        "extreme_move_without_action": ("WARNING", (F.abs("_jump") > extreme) & F.col("_act").isNull()),
        "zero_volume": ("WARNING", F.col("volume") == 0),
    }
    if "close_at" in sessions.columns and "available_at" in bars.columns:
        checks["available_before_close"] = ("ERROR", F.col("available_at") < F.col("close_at"))
    counted = b.agg(*[F.count(F.when(F.coalesce(bad, F.lit(False)), 1)).alias(name) for name, (_, bad) in checks.items()])
    pairs = ", ".join(f"'{name}', '{sev}', `{name}`" for name, (sev, _) in checks.items())
    issues = counted.selectExpr(f"stack({len(checks)}, {pairs}) AS (check, severity, n)")
    runs = b.groupBy("symbol", "_run").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.when(F.col("k") > stale, 1)).alias("n"))
    spans = bars.groupBy("symbol").agg(F.min("session").alias("_a"), F.max("session").alias("_b"), F.count_distinct("session").alias("_have"))
    numbered = sessions.select("session", F.row_number().over(Window.orderBy("session")).alias("_p"))
    inside = spans.join(numbered.select(F.col("session").alias("_a"), F.col("_p").alias("_pa")), "_a").join(numbered.select(F.col("session").alias("_b"), F.col("_p").alias("_pb")), "_b")
    held = bars.join(sessions.select("session"), "session", "left_semi").groupBy("symbol").agg(F.count_distinct("session").alias("_held"))
    gaps = inside.join(held, "symbol").agg(F.coalesce(F.sum(F.col("_pb") - F.col("_pa") + 1 - F.col("_held")), F.lit(0)).alias("n"))
    row = lambda df, name, sev: df.select(F.lit(name).alias("check"), F.lit(sev).alias("severity"), F.col("n").cast("long").alias("n"))
    out = issues.unionByName(row(runs, "stale_close", "WARNING")).unionByName(row(gaps, "missing_sessions", "WARNING"))
    return out.unionByName(row(duplicates(bars, ["symbol", "session"]).withColumnRenamed("duplicates", "n"), "duplicate_key", "ERROR"))


def validate_actions(actions: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """check, severity, n, examples for corporate actions."""
    who = F.concat_ws(" ", "symbol", F.col("ex_date").cast("string"))
    out = _issue(actions, "unknown_action", "ERROR", ~F.col("action").isin("split", "dividend"), who)
    out = out.unionByName(_issue(actions, "non_positive_value", "ERROR", (F.col("value") <= 0) | F.col("value").isNull(), who))
    if sessions is not None and "available_at" in actions.columns:
        late = actions.join(sessions.select(F.col("session").alias("ex_date"), "open_at"), "ex_date", "left")
        out = out.unionByName(_issue(late, "available_after_ex_open", "WARNING", F.col("available_at") > F.col("open_at"), who))
    return out
