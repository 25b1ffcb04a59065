"""Event trades: candidates as columns, greedy selection as a fold over each symbol's few candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, trailing
from .costs import Costs


def with_liquidity(p: DataFrame, adv_window: int = 20, vol_window: int = 21) -> DataFrame:
    """Adds adv (mean dollar volume of up to so many sessions) and dvol (sd of returns, from five on)."""
    v = F.when(F.count("ret").over(trailing(vol_window)) >= 5, F.stddev_samp("ret").over(trailing(vol_window)))
    return p.withColumns({"adv": F.avg("dollar_volume").over(trailing(adv_window)), "dvol": v})


def candidates(p: DataFrame, costs: Costs, holding: int = 5, execution: str = "next_open", notional: float = 10_000.0) -> DataFrame:
    """One row per signal that can be entered and left: entry at the next session, exit `holding` later, delayed to the next tradeable bar.

    p: the panel with signal (0: none). Prices at positions come from windows; the exit is the first tradeable position
    at or after entry + holding, as a running minimum from behind.
    """
    px, raw = ("open", "raw_open") if execution == "next_open" else ("close", "raw_close")
    w = by_symbol()
    ok = F.col(px).isNotNull() & (F.col("raw_volume") > 0)
    p = with_liquidity(p).withColumn("pos", F.row_number().over(w))
    here = F.when(ok, F.struct("pos", F.col("session").alias("session"), F.col(px).alias("px")))
    later = F.min(here).over(Window.partitionBy("symbol").orderBy(F.desc("session")).rowsBetween(Window.unboundedPreceding, -(holding + 1)))
    p = p.withColumns({"_x": later, "_in": F.lead("session").over(w), "_px": F.lead(px).over(w), "_raw": F.lead(raw).over(w), "_vol": F.lead("raw_volume").over(w)})
    c = p.where((F.coalesce("signal", F.lit(0.0)) != 0) & F.col("_px").isNotNull() & (F.col("_vol") > 0) & F.col("_x").isNotNull() & F.col("raw_close").isNotNull())
    c = c.withColumns({"direction": F.signum("signal"), "_n": F.lit(float(notional))})
    gross = F.col("direction") * (F.col("_x.px") / F.col("_px") - 1)
    held = F.col("_x.pos") - F.col("pos") - 1
    cost = costs.round_trip(F.col("_n"), F.col("_raw"), F.col("adv"), F.col("dvol")) + F.when(F.col("direction") < 0, F.lit(costs.borrow_bps / 1e4 / 252) * held).otherwise(0.0)
    if not costs.shorts:
        c = c.where(F.assert_true(F.col("direction") > 0, F.lit("short signals need costs that allow shorts")).isNull())
    return c.select(
        "symbol", F.col("session").alias("signal_session"), F.col("_in").alias("entry_session"), F.col("_x.session").alias("exit_session"), "direction",
        F.col("_raw").alias("entry_price_raw"), gross.alias("gross_ret"), cost.alias("cost_frac"), (gross - cost).alias("net_ret"),
        (F.col("_n") / F.nullif("adv", F.lit(0.0))).alias("participation"), (held > holding).alias("delayed_exit"), (F.col("pos") + 1).alias("entry_pos"), F.col("_x.pos").alias("exit_pos"))


def without_overlap(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Greedy by symbol in order of entry: a trade is taken if it enters after the last taken one's exit.

    Each symbol's candidates are folded in one group: they are rows of one symbol's history, never of many symbols.
    """
    keys = keys or ["symbol"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_pos", kind="stable")
        busy, keep = -1, []
        for e, x in zip(pdf["entry_pos"], pdf["exit_pos"]):
            keep.append(e > busy)
            if keep[-1]:
                busy = x
        return pdf[np.array(keep, bool)]

    return trades.groupBy(*keys).applyInPandas(fold, trades.schema)


def islands(trades: DataFrame, run: str | None = None) -> DataFrame:
    """Adds island: entry sessions between which some trade is open have the same one. Trades of different islands never compete for a slot.

    Exits are reduced to the latest one of each entry session first, so the running maximum goes over sessions, not over trades.
    """
    keys = [run] if run else []
    ends = trades.groupBy(*keys, "entry_session").agg(F.max("exit_session").alias("_end"))
    w = Window.partitionBy(*keys).orderBy("entry_session")
    open_until = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.withColumn("_new", F.when(open_until > F.col("entry_session"), 0).otherwise(1))
    numbered = starts.select(*keys, "entry_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    return trades.join(numbered, [*keys, "entry_session"])


def slots(trades: DataFrame, max_concurrent: int = 5, run: str | None = None) -> DataFrame:
    """Adds slot: the first free of so many slots in order of entry and symbol, NULL where none is free. A trade that never holds over a session takes no slot.

    Where no trade is open the timeline falls apart into islands, which are dealt side by side. Of the trades that enter in one
    session only the first `max_concurrent` can find a slot, so a group holds at most that many rows for each session of its island.
    """
    keys = [run] if run else []
    w = Window.partitionBy(*keys, "entry_session").orderBy("symbol", "exit_session")
    ranked = trades.withColumn("_k", F.when(F.col("exit_session") > F.col("entry_session"), F.row_number().over(w.partitionBy(*keys, "entry_session", F.col("exit_session") > F.col("entry_session")))))
    able = islands(ranked.where(F.col("_k") <= max_concurrent).drop("_k"), run)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in trades.schema.fields)}, slot int"
    names = [f.name for f in trades.schema.fields]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_session", "symbol", "exit_session"], kind="stable")
        busy, out = [None] * max_concurrent, []
        for e, x in zip(pdf["entry_session"], pdf["exit_session"]):
            free = next((k for k, b in enumerate(busy) if b is None or b <= e), None)
            out.append(free)
            if free is not None:
                busy[free] = x
        return pdf[names].assign(slot=pd.array(out, "Int32"))

    dealt = able.groupBy(*keys, "island").applyInPandas(deal, schema)
    others = ranked.where(F.col("_k").isNull() | (F.col("_k") > max_concurrent)).drop("_k").withColumn("slot", F.lit(None).cast("int"))
    return dealt.unionByName(others)


def to_daily(trades: DataFrame, sessions: DataFrame, max_concurrent: int = 5, ret: str = "net_ret", run: str | None = None) -> DataFrame:
    """session, ret: each trade's return spread geometrically over (entry, exit], in equal slots; idle slots earn nothing."""
    taken = slots(trades, max_concurrent, run).where("slot IS NOT NULL")
    numbered = sessions.select("session", F.row_number().over(Window.orderBy("session")).alias("p"))
    a = taken.join(numbered.select(F.col("session").alias("entry_session"), F.col("p").alias("pa")), "entry_session").join(numbered.select(F.col("session").alias("exit_session"), F.col("p").alias("pb")), "exit_session")
    n = F.col("pb") - F.col("pa")
    day = F.when(F.col(ret) > -1, F.pow(1 + F.col(ret), 1 / n) - 1).otherwise(-1.0) / max_concurrent
    days = a.where(n > 0).withColumn("d", day).select("d", *([run] if run else []), F.explode(F.sequence(F.col("pa") + 1, F.col("pb"))).alias("p"))
    sums = days.groupBy("p", *([run] if run else [])).agg(F.sum("d").alias("ret"))
    return numbered.join(sums, "p", "left").select("session", *([run] if run else []), F.coalesce("ret", F.lit(0.0)).alias("ret"))


def segments(p: DataFrame, costs: Costs, segment: str, capital: float = 100_000.0, max_concurrent: int = 5) -> DataFrame:
    """Round trips over one part of each session: overnight (close t+1 to open t+2) or intraday (open to close of t+1)."""
    w, notional = by_symbol(), F.lit(capital / max_concurrent)
    p = with_liquidity(p)
    lead = lambda c, k: F.lead(c, k).over(w)
    if segment == "overnight":
        entry, exit_, raw, ok, x = lead("close", 1), lead("open", 2), lead("raw_close", 1), (lead("raw_volume", 1) > 0) & (lead("raw_volume", 2) > 0), lead("session", 2)
    else:
        entry, exit_, raw, ok, x = lead("open", 1), lead("close", 1), lead("raw_open", 1), lead("raw_volume", 1) > 0, lead("session", 1)
    rows = p.select("symbol", F.col("session").alias("signal_session"), lead("session", 1).alias("entry_session"), x.alias("exit_session"), raw.alias("entry_price_raw"), (exit_ / entry - 1).alias("gross_ret"), ok.alias("_ok"), "adv", "dvol")
    rows = rows.where(F.coalesce("_ok", F.lit(False)) & F.col("gross_ret").isNotNull())
    cost = costs.round_trip(notional, F.col("entry_price_raw"), F.col("adv"), F.col("dvol"))
    return rows.withColumns({"cost_frac": cost, "net_ret": F.col("gross_ret") - cost, "participation": notional / F.nullif("adv", F.lit(0.0))}).drop("_ok", "adv", "dvol")
