"""Trailing-window feature families over the dense panel.

Every family is a function of a panel and parameters that adds one column; `add` parses specs such as `mom(lookback=60)`.
A value is NULL unless its whole frame is there. No family looks past the current session (see `leaks`).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.panel import with_market
from ..sources.shared import written
from .windows import by_session, by_symbol, composed, finite, gated, rank_pct, ratio, trailing

FAMILIES: dict[str, tuple[Callable, dict]] = {}


def C() -> Column:
    return F.col("close")


def LR() -> Column:
    return F.log1p("ret")



def family(**defaults):
    def keep(f):
        FAMILIES[f.__name__.strip("_")] = (f, defaults)
        return f

    return keep


def parse(spec: str) -> tuple[str, dict]:
    """'mom(lookback=60)' -> family and parameters, defaults merged; unknown names raise."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", spec)
    if not m or m[1] not in FAMILIES:
        raise KeyError(f"unknown feature {spec!r}")
    given = {}
    for part in filter(None, (x.strip() for x in (m[2] or "").split(","))):
        k, _, v = (x.strip() for x in part.partition("="))
        given[k] = int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d*\.\d+", v) else v.strip("'\"")
    defaults = FAMILIES[m[1]][1]
    if unknown := set(given) - set(defaults):
        raise KeyError(f"unknown parameters of {m[1]}: {sorted(unknown)}")
    return m[1], defaults | given


def canonical(spec: str) -> str:
    name, p = parse(spec)
    return name + (f"({','.join(f'{k}={p[k]}' for k in sorted(p))})" if p else "")


def add(panel: DataFrame, spec: str, alias: str) -> DataFrame:
    """The panel with the feature as column `alias`, infinities and NaN as NULL."""
    name, p = parse(spec)
    made = FAMILIES[name][0](panel, **p)
    df, col = made if isinstance(made, tuple) else (panel, made)
    return df.withColumn(alias, finite(col.cast("double"))).drop(*[c for c in df.columns if c.startswith("_")])


def compute(panel: DataFrame, specs: dict[str, str]) -> DataFrame:
    for alias, spec in specs.items():
        panel = add(panel, spec, alias)
    return panel


def leaks(panel: DataFrame, spec: str, sessions: list, tolerance: float = 1e-9) -> DataFrame:
    """Truncation test: rows whose value changes when later sessions are cut off. Empty for a feature without look-ahead."""
    full = add(panel, spec, "x").select("session", "symbol", "x")
    found = None
    for t in sessions:
        cut = add(panel.where(F.col("session") <= F.lit(t)), spec, "y").where(F.col("session") == F.lit(t)).select("session", "symbol", "y")
        both = cut.join(full, ["session", "symbol"])
        same = F.col("x").eqNullSafe(F.col("y")) | (F.abs(F.col("x") - F.col("y")) <= tolerance * F.abs(F.col("x")) + 1e-12)
        bad = both.where(~F.coalesce(same, F.lit(False)))
        found = bad if found is None else found.unionByName(bad)
    return found


def sma(x: Column, n: int) -> Column:
    return gated(F.avg(x), x, n, trailing(n))


@family(h=1)
def ret(p, h):
    return C() / F.lag(C(), h).over(by_symbol()) - 1


@family(lookback=252, skip=21)
def mom(p, lookback, skip):
    return F.lag(C(), skip).over(by_symbol()) / F.lag(C(), lookback).over(by_symbol()) - 1


@family(n=21)
def vol(p, n):
    return gated(F.stddev_samp(LR()), LR(), n, trailing(n)) * F.sqrt(F.lit(252.0))


@family(h=1, vol_n=63)
def zret(p, h, vol_n):
    sd = gated(F.stddev_samp(LR()), LR(), vol_n, trailing(vol_n, h))
    return ratio(gated(F.sum(LR()), LR(), h, trailing(h)), sd * F.sqrt(F.lit(float(h))))


@family(lookback=252, skip=21, vol_n=63)
def vol_adj_mom(p, lookback, skip, vol_n):
    return ratio(mom(p, lookback, skip), vol(p, vol_n))


@family()
def overnight(p):
    return F.col("open") / F.lag(C()).over(by_symbol()) - 1


@family()
def intraday(p):
    return C() / F.col("open") - 1


@family(n=50)
def sma_ratio(p, n):
    return C() / sma(C(), n) - 1


@family(n=50, k=10)
def sma_slope(p, n, k):
    return p.withColumn("_sma", sma(C(), n)), F.col("_sma") / F.lag("_sma", k).over(by_symbol()) - 1


@family(fast=20, slow=50)
def ma_cross(p, fast, slow):
    return sma(C(), fast) / sma(C(), slow) - 1


@family(n=20, k=2.0)
def bollinger(p, n, k):
    return ratio(C() - sma(C(), n), F.lit(float(k)) * gated(F.stddev_samp(C()), C(), n, trailing(n)))


def ewm(p: DataFrame, source: list[str], n: int) -> DataFrame:
    """Adds _e_<column>: Wilder means (weight 1 / n, NULL until n values; a missing row keeps the last value and fades its weight).

    A value moves the mean by an affine map whose coefficients follow from how many rows are missing before it, so the
    means are running compositions of maps (see `windows.composed`): a symbol's history is cut into blocks that are
    worked on side by side, and only the keys and the sources leave the panel.
    """
    keep, w = 1 - 1.0 / n, Window.partitionBy("symbol").orderBy("session")
    numbered = p.select("symbol", "session", F.row_number().over(w).alias("_r"), *source)
    long = numbered.select("symbol", "session", "_r", F.explode(F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).cast("double").alias("_x")) for c in source])).alias("_s")).select("symbol", "session", "_r", "_s.*")
    of = Window.partitionBy("symbol", "_of").orderBy("_r")
    there = long.where(F.col("_x").isNotNull()).withColumns({"pos": F.row_number().over(of) - 1, "_gap": F.col("_r") - F.lag("_r").over(of)})
    old = F.pow(F.lit(keep), "_gap")
    maps = there.select("symbol", "_of", "session", "pos", F.coalesce(old / (old + 1.0 / n), F.lit(0.0)).alias("a"), F.coalesce(F.col("_x") / n / (old + 1.0 / n), F.col("_x")).alias("b"))
    maps = written(maps, "wilder-maps")
    means = composed(maps.select("symbol", "_of", "pos", "a", "b"), ["symbol", "_of"])
    found = maps.join(means.select("symbol", "_of", "pos", F.col("b").alias("_m")), ["symbol", "_of", "pos"])
    wide = found.groupBy("symbol", "session").agg(*[F.max(F.when(F.col("_of") == c, F.struct("_m", "pos"))).alias(f"_e_{c}") for c in source])
    joined = p.join(wide, ["symbol", "session"], "left")
    last = {f"_e_{c}": F.last(f"_e_{c}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in source}
    return joined.withColumns(last).withColumns({f"_e_{c}": F.when(F.col(f"_e_{c}.pos") >= n - 1, F.col(f"_e_{c}._m")) for c in source})


@family(n=14)
def rsi(p, n):
    d = C() - F.lag(C()).over(by_symbol())
    p = p.withColumns({"_d": d})
    p = p.withColumns({"_up": F.greatest(F.col("_d"), F.lit(0.0)), "_dn": F.greatest(-F.col("_d"), F.lit(0.0))})
    p = p.withColumns({"_up": F.when(F.col("_d").isNotNull(), F.col("_up")), "_dn": F.when(F.col("_d").isNotNull(), F.col("_dn"))})
    p = ewm(p, ["_up", "_dn"], n)
    up, dn = F.col("_e__up"), F.col("_e__dn")
    return p, F.when((dn == 0) & (up > 0), 100.0).otherwise(100 - 100 / (1 + ratio(up, dn)))


@family(n=14)
def atr(p, n):
    before = F.lag(C()).over(by_symbol())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    p = p.withColumn("_tr", F.when(before.isNotNull() & C().isNotNull(), tr))
    return ewm(p, ["_tr"], n), F.col("_e__tr") / C()


@family(n=252)
def drawdown(p, n):
    return C() / F.max(C()).over(trailing(n)) - 1


@family(n=20)
def breakout(p, n):
    h = F.col("high")
    return C() / gated(F.max(h), h, n, trailing(n, 1)) - 1


@family(n=20)
def rel_volume(p, n):
    v = F.col("volume")
    return ratio(v, gated(F.avg(v), v, n, trailing(n, 1)))


@family(n=20)
def adv_dollar(p, n):
    d = F.col("dollar_volume")
    return gated(F.avg(d), d, n, trailing(n))


@family()
def price(p):
    return F.col("raw_close")


def _both(x: Column, m: Column) -> tuple[Column, Column]:
    there = x.isNotNull() & m.isNotNull()
    return F.when(there, x), F.when(there, m)


@family(n=63, market="AF")
def beta(p, n, market):
    p = with_market(p, market)
    x, m = _both(F.col("ret"), F.col("market_ret"))
    full_m = F.col("market_ret")
    cov = gated(F.covar_samp(x, m), x, n, trailing(n))
    return p.withColumnRenamed("market_close", "_mc"), ratio(cov, gated(F.var_samp(full_m), full_m, n, trailing(n)))


@family(n=63, market="AF")
def corr(p, n, market):
    p = with_market(p, market)
    x, m = _both(F.col("ret"), F.col("market_ret"))
    return p, gated(F.corr(x, m), x, n, trailing(n))


@family(h=21, market="AF")
def rel_ret(p, h, market):
    p = with_market(p, market)
    m = F.col("market_close")
    return p, (C() / F.lag(C(), h).over(by_symbol())) - (m / F.lag(m, h).over(by_symbol()))


@family(n=50)
def breadth(p, n):
    p = p.withColumn("_sma", sma(C(), n))
    above = F.when(F.col("_sma").isNotNull(), F.coalesce((C() > F.col("_sma")).cast("double"), F.lit(0.0)))
    return p, F.avg(above).over(by_session())


@family(lookback=252, skip=21)
def xs_rank_mom(p, lookback, skip):
    return p.withColumn("_m", mom(p, lookback, skip)), rank_pct(F.col("_m"), ["session"])


@family(before=1, after=3, lead=1)
def tom(p, before, after, lead):
    """The sessions of the panel are the calendar; the last `lead` sessions of a panel know no later ones."""
    cal = p.select("session").distinct()
    month = F.trunc("session", "month")
    up, down = Window.partitionBy(month).orderBy("session"), Window.partitionBy(month).orderBy(F.desc("session"))
    flags = cal.withColumn("_f", ((F.row_number().over(up) <= after) | (F.row_number().over(down) <= before)).cast("double"))
    led = flags.withColumn("_t", F.lead("_f", lead).over(Window.orderBy("session")))
    return p.join(led.select("session", "_t"), "session", "left"), F.col("_t")
