"""Security master and universes: identifiers, listings, halts and memberships over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pit import open_end, interval_contains


def resolve(identifiers: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (value, as_of) with security_id and n_matches: whose identifier it was on that date; NULL unless exactly one.

    identifiers: security_id, value, valid_from, valid_to (closed, NULL open). Intervals of a security that overlap are
    one, so that a date lies in at most one of each; then equal spans of a value are one row with their number of
    securities. A date meets distinct spans only, however many securities share them.
    """
    i = identifiers.where("value IS NOT NULL AND security_id IS NOT NULL").select(F.col("value").alias("_v"), "security_id", "valid_from", F.coalesce("valid_to", open_end()).alias("valid_to")).where("valid_from <= valid_to")
    w = Window.partitionBy("_v", "security_id").orderBy("valid_from", "valid_to")
    before = F.max("valid_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = i.withColumn("_new", F.when(F.col("valid_from") <= before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    held = i.groupBy("_v", "security_id", "_run").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    spans = held.groupBy("_v", "valid_from", "valid_to").agg(F.count(F.lit(1)).alias("_n"), F.min("security_id").alias("security_id"))
    asked = queries.select("value", "as_of").distinct()
    hit = asked.join(spans, (F.col("value") == F.col("_v")) & interval_contains(F.col("as_of"), F.col("valid_from"), F.col("valid_to"), True), "left")
    g = hit.groupBy("value", "as_of").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_matches"), F.min("security_id").alias("security_id"))
    return g.withColumn("security_id", F.when(F.col("n_matches") == 1, F.col("security_id")))


def attribute(identifiers: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (security_id, as_of) with value: the one of the latest valid_from that holds on the date."""
    i = identifiers.select(F.col("security_id").alias("_s"), "value", "valid_from", "valid_to")
    hit = queries.join(i, (F.col("security_id") == F.col("_s")) & interval_contains(F.col("as_of"), F.col("valid_from"), F.col("valid_to"), True), "left")
    return hit.groupBy("security_id", "as_of").agg(F.max_by("value", F.struct("valid_from", "value")).alias("value"))


def overlaps(identifiers: DataFrame) -> DataFrame:
    """Adjacent intervals of one identifier value held by two securities at once (by value, ordered by valid_from)."""
    w = Window.partitionBy("value").orderBy("valid_from", "security_id")
    i = identifiers.withColumns({"_next": F.lead("valid_from").over(w), "_other": F.lead("security_id").over(w)})
    clash = (F.col("_next") <= F.coalesce("valid_to", open_end())) & (F.col("_other") != F.col("security_id"))
    return i.where(clash).select("value", "security_id", F.col("_other").alias("other_id"), "valid_from", F.col("_next").alias("other_from"))


def listed(spine: DataFrame, securities: DataFrame) -> DataFrame:
    """spine (session, symbol) with listed: first_session <= session <= last_session (NULL open); unknown symbols false."""
    s = securities.select(F.col("security_id").alias("_s"), "first_session", "last_session")
    j = spine.join(s, F.col("symbol") == F.col("_s"), "left")
    return j.withColumn("listed", F.coalesce(interval_contains(F.col("session"), F.col("first_session"), F.col("last_session"), True), F.lit(False))).drop("_s", "first_session", "last_session")


def halts(events: DataFrame) -> DataFrame:
    """symbol, halt_from, halt_to from events (symbol, event_type halt or resume, event_date): [halt, resume).

    A second halt before a resume replaces the first one's start; an open halt never ends.
    """
    w = Window.partitionBy("symbol").orderBy("event_date", "event_type")
    e = events.withColumns({"_next": F.lead("event_type").over(w), "_to": F.lead("event_date").over(w)})
    return e.where((F.col("event_type") == "halt") & ((F.col("_next") == "resume") | F.col("_next").isNull())).select("symbol", F.col("event_date").alias("halt_from"), F.col("_to").alias("halt_to"))


def tradable(panel: DataFrame, securities: DataFrame, events: DataFrame) -> DataFrame:
    """session, symbol, tradable: listed, with volume, and not halted."""
    base = listed(panel.select("session", "symbol", "raw_volume"), securities)
    h = halts(events).select(F.col("symbol").alias("_s"), "halt_from", "halt_to")
    free = base.join(h, (F.col("symbol") == F.col("_s")) & interval_contains(F.col("session"), F.col("halt_from"), F.col("halt_to")), "left_anti").select("session", "symbol", F.lit(True).alias("_free"))
    j = base.join(free, ["session", "symbol"], "left")
    ok = F.col("listed") & F.coalesce(F.col("raw_volume") > 0, F.lit(False)) & F.coalesce("_free", F.lit(False))
    return j.select("session", "symbol", ok.alias("tradable"))


def members(membership: DataFrame, session, as_of=None) -> DataFrame:
    """symbol: members on a session (half-open intervals), as known at as_of."""
    m = membership.where(interval_contains(F.lit(session).cast("date"), F.col("start_date"), F.col("end_date")))
    if as_of is not None:
        m = m.where(F.col("available_at") <= F.lit(as_of))
    return m.select("symbol").distinct()


def membership_mask(spine: DataFrame, membership: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """spine with member: inside [max(start, the day after the announcement), end)."""
    told = F.date_add(F.to_date(F.from_utc_timestamp("available_at", zone)), 1)
    m = membership.select(F.col("symbol").alias("_s"), F.greatest("start_date", told).alias("_from"), F.col("end_date").alias("_to"))
    hit = spine.join(m, (F.col("symbol") == F.col("_s")) & interval_contains(F.col("session"), F.col("_from"), F.col("_to")), "left_semi").select("session", "symbol", F.lit(True).alias("_in")).distinct()
    return spine.join(hit, ["session", "symbol"], "left").withColumn("member", F.coalesce("_in", F.lit(False))).drop("_in")


def coverage(securities: DataFrame) -> DataFrame:
    """Counts and filled shares of the security table."""
    n = F.count(F.lit(1))
    return securities.agg(n.alias("n"), (F.count("last_session") / n).alias("share_delisted"), F.min("first_session").alias("first_session"), F.count_distinct("asset_type").alias("n_types") if "asset_type" in securities.columns else F.lit(None).alias("n_types"))


def history(identifiers: DataFrame, kind: str | None = None) -> DataFrame:
    """security_id, value, valid_from, valid_to, n: every interval of every security (of one kind), numbered in order."""
    rows = identifiers.where(F.col("kind") == kind) if kind is not None else identifiers
    n = F.row_number().over(Window.partitionBy("security_id").orderBy("valid_from", "value"))
    return rows.select("security_id", "value", "valid_from", "valid_to", n.alias("n"))


def listed_on(securities: DataFrame, dates: DataFrame) -> DataFrame:
    """date, security_id of what was listed on each date, delisted securities included."""
    inside = interval_contains(F.col("date"), F.col("first_session"), F.col("last_session"), True)
    return dates.join(securities, inside).select("date", "security_id")


def static_mask(spine: DataFrame, universe: DataFrame) -> DataFrame:
    """spine with member: in the fixed list (symbol, inception; NULL: always), not before its inception."""
    u = universe.select("symbol", F.coalesce("inception", F.lit("0001-01-01").cast("date")).alias("_from"))
    return spine.join(u, "symbol", "left").withColumn("member", F.coalesce(F.col("session") >= F.col("_from"), F.lit(False))).drop("_from")


def static_members(universe: DataFrame, session) -> DataFrame:
    """symbol: the fixed list's members on a session."""
    return universe.where(F.col("inception").isNull() | (F.col("inception") <= F.lit(session).cast("date"))).select("symbol")
