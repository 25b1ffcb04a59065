"""Reading the research records: search, counts, changes, nested fields, and eligibility from forward results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(rows: DataFrame, columns: list[str], terms: list[str]) -> DataFrame:
    """Rows whose columns hold any of the terms, whatever the case."""
    text = F.lower(F.concat_ws(" ", *columns))
    return rows.where(reduce(lambda a, b: a | b, [text.contains(t.lower()) for t in terms]))


def find(rows: DataFrame, where: dict, order: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Equality filters on named columns, ordered by one; a limit only where the caller asks for the first so many."""
    unknown = set(where) - set(rows.columns)
    if unknown:
        raise KeyError(f"unknown columns {sorted(unknown)}")
    out = rows.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in where.items()], F.lit(True)))
    out = out.orderBy(F.desc(order) if descending else F.asc(order))
    return out.limit(limit) if limit is not None else out


def counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n for every dimension on its own: grouping sets in one pass over the rows."""
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    k = len(dimensions)
    which = reduce(lambda acc, i: F.when(F.col("g") == (1 << k) - 1 - (1 << (k - 1 - i)), F.struct(F.lit(dimensions[i]).alias("dimension"), F.col(dimensions[i]).cast("string").alias("value"))).otherwise(acc), range(k), F.lit(None))
    return sets.select(which.alias("w"), "n").select("w.dimension", "w.value", "n")


def changes_since(tables: dict[str, tuple[DataFrame, str, str]], since) -> DataFrame:
    """source, id, at of rows of several tables (frame, id column, time column) after a moment."""
    parts = [df.where(F.col(at) > F.lit(since)).select(F.lit(name).alias("source"), F.col(key).cast("string").alias("id"), F.col(at).cast("timestamp").alias("at")) for name, (df, key, at) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def dig(json: Column, path: str) -> Column:
    """A dotted path into JSON text."""
    return F.get_json_object(json, "$." + path)


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end)."""
    days = F.when(end > start, F.sequence(start, F.date_sub(end, 1))).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: F.dayofweek(d).between(2, 6)))


def eligibility(forward: DataFrame, history: DataFrame, by: str, slippage: float, min_trades: int = 20, min_days: int = 60, least: float = 1e-9) -> DataFrame:
    """by, n, days, and five criteria of forward trades (entry, exit, net, slippage) against history (by, hist_mean, hist_sd); eligible if all hold.

    A total up to `least` is no profit: gains and losses that cancel leave a rest of rounding, of either sign.
    """
    f = forward.groupBy(by).agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.avg("slippage").alias("slip"), F.min("entry").alias("a"), F.max("exit").alias("b"), F.sum("net").alias("total"))
    f = f.join(history, by, "left").withColumn("days", business_days(F.col("a"), F.col("b")))
    checks = {
        "enough_trades": F.col("n") >= min_trades, "enough_days": F.col("days") >= min_days, "profitable": F.col("total") > least,
        "near_history": F.col("mean") >= F.col("hist_mean") - 2 * F.col("hist_sd") / F.sqrt("n"), "slippage_as_modelled": F.col("slip") <= 1.5 * slippage}
    f = f.withColumns(checks)
    return f.select(by, "n", "days", *checks, reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in checks]).alias("eligible"))
