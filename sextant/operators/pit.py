"""Point-in-time joins: what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def open_end() -> Column:
    return F.lit("9999-12-31").cast("date")



class LookAheadError(ValueError):
    """A row was used before it could be known."""


def as_of(rows: DataFrame, t, keys: list[str], available: str = "available_at", tie: str = "seq") -> DataFrame:
    """Bitemporal snapshot: of the rows available at t, the last vintage of each key (ties: the larger `tie`)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(available), F.desc(tie))
    known = rows.where(F.col(available) <= F.lit(t))
    return known.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (last write wins)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assert_available(rows: DataFrame, t, available: str = "available_at") -> None:
    if rows.where(F.col(available) > F.lit(t)).limit(1).count():
        raise LookAheadError(f"rows become available after {t}")


def asof_backward(decisions: DataFrame, values: DataFrame, by: list[str], at: str = "decision_at", available: str = "available_at", period: str = "observation_date", value: str = "value", tie: str = "seq") -> DataFrame:
    """Each decision with the value of the latest period known at it, at its latest vintage.

    Vintages of a period older than one already known are passed over (late revisions never win). Both sides are
    united, sorted by time within `by` and carried forward: one shuffle, no range join.
    """
    w = Window.partitionBy(*by).orderBy(available, period, tie).rowsBetween(Window.unboundedPreceding, 0)
    fresh = values.withColumn("_top", F.max(period).over(w)).where(F.col(period) == F.col("_top"))
    right = fresh.select(*by, F.col(available).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(value).alias("value"), F.col(period).alias("period"), F.col(available).alias("available")).alias("_v"), F.lit(None).cast(decisions.schema[at].dataType).alias("_d"))
    left = decisions.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(values.schema[tie].dataType).alias("_tie"), F.lit(None).cast(right.schema["_v"].dataType).alias("_v"), F.col(at).alias("_d"))
    order = Window.partitionBy(*by).orderBy("_at", "_side", F.coalesce("_v.period", F.lit("0001-01-01").cast("date")), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = right.unionByName(left).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return both.select(*by, F.col("_d").alias(at), F.col("_last.value").alias("value"), F.col("_last.period").alias("period"), F.col("_last.available").alias("value_available_at"))


def asof_forward(events: DataFrame, sessions: DataFrame, at: str, close: str = "close_at", session: str = "session") -> DataFrame:
    """Each event with the first session whose close is not before it; NULL past the end.

    Sessions and events are united and carried backward within days, and an event after the last close of its day takes
    the first session of a later day, from a table of one row per day.
    """
    e = events.withColumns({"_at": F.col(at), "_side": F.lit(0), "_s": F.lit(None).cast("date")})
    s = sessions.select(F.col(close).alias("_at"), F.lit(1).alias("_side"), F.col(session).alias("_s"))
    both = e.unionByName(s, allowMissingColumns=True).withColumn("_y", F.to_date("_at"))
    w = Window.partitionBy("_y").orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    days = both.where("_y IS NOT NULL").groupBy("_y").agg(F.min_by("_s", F.when(F.col("_side") == 1, F.col("_at"))).alias("_first"))
    later = Window.orderBy(F.desc("_y")).rowsBetween(Window.unboundedPreceding, -1)
    after = days.select("_y", F.last("_first", ignorenulls=True).over(later).alias("_after"))
    out = both.withColumn("_found", F.last("_s", ignorenulls=True).over(w)).where("_side = 0").join(after, "_y", "left")
    return out.withColumn(session, F.coalesce("_found", "_after")).drop("_at", "_side", "_s", "_y", "_found", "_after")


def interval_contains(point: Column, start: Column, end: Column, closed: bool = False) -> Column:
    """start <= point < end (or <= end when closed); a NULL end is open."""
    stop = F.coalesce(end, open_end())
    return (start <= point) & ((point <= stop) if closed else (point < stop))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, closed: bool = True, how: str = "inner") -> DataFrame:
    """Equi join on keys with a containment condition on dates."""
    p, i = points.alias("p"), intervals.alias("i")
    same = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in on]
    inside = interval_contains(F.col(f"p.{point}"), F.col(f"i.{start}"), F.col(f"i.{end}"), closed)
    joined = p.join(i, [*same, inside], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[F.col(f"i.{c}") for c in on])


def partition_of(entry: Column, exit_: Column, bounds: dict[str, tuple[str, str]]) -> Column:
    """The partition that contains both dates, else 'embargo'."""
    out = F.lit("embargo")
    for name, (a, b) in reversed(bounds.items()):
        lo, hi = F.lit(a).cast("date"), F.lit(b).cast("date")
        out = F.when((entry >= lo) & (entry <= hi) & (exit_ >= lo) & (exit_ <= hi), name).otherwise(out)
    return out


def timing_violations(decisions: DataFrame, fills: DataFrame) -> DataFrame:
    """session, available_at, fill_session, fill_at of decisions that would be filled before all they rest on was known.

    decisions: session, available_at (any number of rows a session; the latest counts, NULLs do not); fills: session, fill_at, one row a
    session. A decision of a session is filled in the next one; that of the last session is not filled. The window runs over sessions.
    """
    w = Window.orderBy("session")
    after = fills.select("session", F.lead("session").over(w).alias("fill_session"), F.lead("fill_at").over(w).alias("fill_at"))
    known = decisions.groupBy("session").agg(F.max("available_at").alias("available_at"))
    return known.join(after, "session").where(F.col("fill_at") <= F.col("available_at"))


def assert_timing(decisions: DataFrame, fills: DataFrame) -> None:
    """Raises LookAheadError with the first sessions that violate the rule."""
    bad = [str(r["session"]) for r in timing_violations(decisions, fills).orderBy("session").limit(3).collect()]
    if bad:
        raise LookAheadError(f"fills would precede what decisions of {', '.join(bad)} rest on")
