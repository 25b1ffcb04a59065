"""The dense research panel: one row per session and symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol


def before():
    return by_symbol().rowsBetween(Window.unboundedPreceding, -1)


def so_far():
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def spine(bars: DataFrame) -> DataFrame:
    """Every session with every symbol. The symbols are a small dimension; sessions times symbols is the panel's size."""
    return bars.select("session").distinct().crossJoin(bars.select("symbol").distinct())


def daily_actions(actions: DataFrame) -> DataFrame:
    """symbol, session, split_ratio, dividend: the product of a day's splits and the sum of its dividends."""
    known = actions.where(F.assert_true(F.col("action").isin("split", "dividend"), F.lit("unknown corporate action")).isNull())
    split, dividend = F.col("action") == "split", F.col("action") == "dividend"
    return known.groupBy("symbol", F.col("ex_date").alias("session")).agg(
        F.product(F.when(split, F.col("value")).otherwise(1.0)).alias("split_ratio"), F.sum(F.when(dividend, F.col("value")).otherwise(0.0)).alias("dividend"))


def densify(bars: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """session, symbol, raw_open .. raw_volume (NULL where there is no bar), split_ratio, dividend. Actions off the sessions are dropped."""
    raw = bars.select("session", "symbol", *[F.col(c).alias(f"raw_{c}") for c in ("open", "high", "low", "close", "volume")], *[c for c in ("available_at",) if c in bars.columns])
    dense = spine(bars).join(raw, ["session", "symbol"], "left")
    if actions is None:
        return dense.withColumns({"split_ratio": F.lit(1.0), "dividend": F.lit(0.0)})
    a = daily_actions(actions)
    return dense.join(a, ["session", "symbol"], "left").withColumns({"split_ratio": F.coalesce("split_ratio", F.lit(1.0)), "dividend": F.coalesce("dividend", F.lit(0.0))})


def total_return() -> Column:
    """(close * ratio + dividend) / last close before - 1; over a gap it spans the gap."""
    return (F.col("raw_close") * F.col("split_ratio") + F.col("dividend")) / F.last("raw_close", ignorenulls=True).over(before()) - 1


def build_panel(bars: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """densify plus ret, the forward-adjusted open, high, low, close, split-adjusted volume, dollar_volume. One shuffle, by symbol."""
    p = densify(bars, actions).withColumn("ret", total_return())
    first = F.first("raw_close", ignorenulls=True).over(whole())
    p = p.withColumn("close", F.when(F.col("raw_close").isNotNull(), first * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(so_far())))
    factor = F.col("close") / F.col("raw_close")
    split = F.first("split_ratio").over(whole()) / F.product("split_ratio").over(so_far())
    return p.withColumns({
        "open": F.col("raw_open") * factor, "high": F.col("raw_high") * factor, "low": F.col("raw_low") * factor,
        "volume": F.col("raw_volume") * split, "dollar_volume": F.col("raw_close") * F.col("raw_volume")})


def forward_return(horizon: int, execution: str = "next_open") -> Column:
    """Label: price after entry at t + 1 and `horizon` sessions, against the entry price; NULL past the end."""
    if horizon < 1 or execution not in ("next_open", "next_close"):
        raise ValueError("horizon >= 1 and next_open or next_close")
    px = F.col("open" if execution == "next_open" else "close")
    return F.lead(px, 1 + horizon).over(by_symbol()) / F.lead(px, 1).over(by_symbol()) - 1


def entry_exit_sessions(horizon: int) -> tuple[Column, Column]:
    return F.lead("session", 1).over(by_symbol()), F.lead("session", 1 + horizon).over(by_symbol())


def with_market(panel: DataFrame, market: str, columns: tuple[str, ...] = ("ret", "close")) -> DataFrame:
    """Adds market_<column> of one symbol to every row: one row per session, joined by session."""
    m = panel.where(F.col("symbol") == market).select("session", *[F.col(c).alias(f"market_{c}") for c in columns])
    return panel.join(m, "session", "left")


def equity_curve(ret: Column, order: list[str], by: list[str] | None = None, start: float = 1.0) -> Column:
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.lit(start) * F.product(1 + ret).over(w)


def drawdown(equity: Column, order: list[str], by: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return equity / F.max(equity).over(w) - 1


def realized_variance_forward(h: int) -> Column:
    """252 / h times the sum of the next h squared log returns, where all are there."""
    lr = F.log1p("ret")
    frame = by_symbol().rowsBetween(1, h)
    return F.when(F.count(lr).over(frame) >= h, F.sum(lr * lr).over(frame) * 252 / h)
