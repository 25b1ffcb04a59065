"""Signals and target weights from feature columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_session, by_symbol, rank_pct, ratio

_OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def conditions(wanted: list[tuple[str, str, float]]) -> Column:
    """All of (feature, op, value); a missing feature is false."""
    return reduce(operator.and_, [F.coalesce(_OPS[op](F.col(c), F.lit(float(v))), F.lit(False)) for c, op, v in wanted])


def threshold_signal(p: DataFrame, wanted: list[tuple[str, str, float]], direction: float = 1.0, on_transition: bool = False) -> DataFrame:
    """Adds signal: direction where all conditions hold (with on_transition only where they did not the row before), else 0."""
    p = p.withColumn("_on", conditions(wanted))
    on = F.col("_on")
    if on_transition:
        on = on & ~F.coalesce(F.lag("_on").over(by_symbol()), F.lit(False))
    return p.withColumn("signal", on.cast("double") * direction + 0.0).drop("_on")


def quantile_signal(p: DataFrame, feature: str, quantile: float = 0.2, side: str = "top", every: int = 1, direction: float = 1.0, wanted: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Adds signal: the top (pct > 1 - q) or bottom (pct <= q) of each session where all conditions hold, only at rows 0, every, 2 every .. of the sessions."""
    p = p.withColumn("_pct", rank_pct(F.col(feature), ["session"]))
    on = F.col("_pct") > 1 - quantile if side == "top" else F.col("_pct") <= quantile
    if wanted:
        on = on & conditions(wanted)
    if every > 1:
        p = p.withColumn("_pos", F.row_number().over(by_symbol()) - 1)
        on = on & (F.col("_pos") % every == 0)
    return p.withColumn("signal", F.coalesce(on, F.lit(False)).cast("double") * direction + 0.0).drop("_pct", "_pos")


def state_weights(p: DataFrame, wanted: list[tuple[str, str, float]], gross: float = 1.0, slots: int | None = None) -> DataFrame:
    """Adds weight: gross shared evenly by the qualifying symbols of a session, or in fixed slots; NULL (no decision) where no symbol has all features."""
    on = conditions(wanted).cast("double")
    known = reduce(operator.and_, [F.col(c).isNotNull() for c, _, _ in wanted])
    p = p.withColumns({"_on": on, "_known": F.count(F.when(known, 1)).over(by_session())})
    share = F.col("_on") / slots if slots else F.coalesce(ratio(F.col("_on"), F.sum("_on").over(by_session())), F.lit(0.0))
    return p.withColumn("weight", F.when(F.col("_known") > 0, share * gross)).drop("_on", "_known")


def constant_weights(p: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds weight: equal for all symbols of the session, or as given."""
    if weights is None:
        return p.withColumn("weight", 1 / F.count(F.lit(1)).over(by_session()))
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return p.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("symbol")], F.lit(0.0)))


def momentum_weights(p: DataFrame, lookback: int = 252, skip: int = 21, long_only: bool = True) -> DataFrame:
    """Adds weight: the sign of momentum (or its positive part) over the sum of absolute signs; NULL where no symbol has momentum."""
    m = F.lag("close", skip).over(by_symbol()) / F.lag("close", lookback).over(by_symbol()) - 1
    p = p.withColumn("_s", F.signum(m))
    if long_only:
        p = p.withColumn("_s", F.when(F.col("_s").isNotNull(), F.greatest("_s", F.lit(0.0))))
    total, known = F.sum(F.abs("_s")).over(by_session()), F.count("_s").over(by_session())
    return p.withColumn("weight", F.when(known > 0, F.coalesce(ratio(F.coalesce("_s", F.lit(0.0)), total), F.lit(0.0)))).drop("_s")


def mean_reversion_signal(p: DataFrame, lookback: int = 5, z: float = -2.0, vol_n: int = 63) -> DataFrame:
    lr, w = F.log1p("ret"), by_symbol()
    move = F.sum(lr).over(w.rowsBetween(-(lookback - 1), 0))
    sd = F.stddev_samp(lr).over(w.rowsBetween(-(vol_n - 1), 0))
    full = (F.count(lr).over(w.rowsBetween(-(lookback - 1), 0)) >= lookback) & (F.count(lr).over(w.rowsBetween(-(vol_n - 1), 0)) >= vol_n)
    score = F.when(full, ratio(move, sd * F.sqrt(F.lit(float(lookback)))))
    return p.withColumn("signal", F.coalesce(score < z, F.lit(False)).cast("double"))


def random_signal(p: DataFrame, frequency: float, seed: int, direction: float = 1.0) -> DataFrame:
    """Adds signal: direction at a hashed share of the rows, the same on every run."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "symbol", F.col("session").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return p.withColumn("signal", (u < frequency).cast("double") * direction)


def spells(p: DataFrame, cost_per_side: float = 0.0, px: str = "open", raw: str = "raw_open") -> DataFrame:
    """Runs of rows with a weight as trades: decided at the first, entered a row later, left a row after the first row without.

    Islands by a running sum of starts; spells that end past the data, or without a finite return, are dropped.
    """
    w = by_symbol()
    p = p.withColumn("_on", F.coalesce(F.abs("weight") > 0, F.lit(False))).withColumns({
        "_in": F.lead("session").over(w), "_px": F.lead(px).over(w), "_raw": F.lead(raw).over(w), "_next": F.coalesce(F.lead("_on").over(w), F.lit(False)),
        "_out": F.lead("session", 2).over(w), "_out_px": F.lead(px, 2).over(w)})
    start = (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int")
    p = p.withColumn("_spell", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    g = p.groupBy("symbol", "_spell").agg(
        F.min("session").alias("signal_session"), F.min_by("_in", "session").alias("entry_session"), F.min_by("_raw", "session").alias("entry_price_raw"),
        F.min_by("_px", "session").alias("_e"), F.max_by("_out", "session").alias("exit_session"), F.max_by("_out_px", "session").alias("_x"))
    gross = F.col("_x") / F.col("_e") - 1
    g = g.where(F.col("exit_session").isNotNull()).withColumn("gross_ret", gross).where(F.col("gross_ret").isNotNull())
    return g.withColumns({"direction": F.lit(1.0), "cost_frac": F.lit(2 * cost_per_side), "net_ret": F.col("gross_ret") - 2 * cost_per_side}).drop("_spell", "_e", "_x")
