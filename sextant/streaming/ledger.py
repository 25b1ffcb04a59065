"""Forward trades from open to close over a stream, with expiry: one small state machine for each key.

Events are quotes, orders to open and orders to close, in order of time and id. An order is filled at the latest quote if
that is at most `stale` old: an order to open is refused without one, an order to close waits for the next. A key has one open
trade at a time; one that is not closed within `hold` expires without an exit price. The stream keeps events until the
watermark has passed them, so that they are taken in the order of time whatever order they come in, and a timer wakes a key for
its earliest pending event or expiry. Stale quotes leave the state by event time (state TTL in Spark goes by the wall clock,
which would make results depend on when a stream runs). The batch form folds sorted partitions and holds one key's four numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUOTE, OPEN, CLOSE = "quote", "open", "close"
#: Nothing quoted, nothing open: price, when, opened, entry (times in microseconds, -1 for none).
EMPTY = (0.0, -1, -1, 0.0)
_ROWS = "opened bigint, entry double, closed bigint, exit double, status string"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


@dataclass(frozen=True)
class Rules:
    """How long a quote may fill orders and a trade may stay open, in seconds."""

    stale: int
    hold: int

    def expired(self, state: tuple, at: int) -> list[tuple]:
        """The row of the open trade if it has expired by then."""
        _, _, opened, entry = state
        end = opened + self.hold * 1_000_000
        return [(opened, entry, end, None, "EXPIRED")] if opened >= 0 and end <= at else []

    def step(self, state: tuple, at: int, kind: str, price: float | None) -> tuple[tuple, list[tuple]]:
        """The state after an event, and the rows it makes."""
        rows = self.expired(state, at)
        quote, when, opened, entry = state
        if rows:
            opened = -1
        fresh = when >= 0 and at - when <= self.stale * 1_000_000
        if kind == QUOTE and price is not None:
            quote, when = price, at
        elif kind == OPEN and opened < 0:
            if fresh:
                opened, entry = at, quote
            else:
                rows.append((at, None, None, None, "REFUSED"))
        elif kind == CLOSE and opened >= 0 and fresh:
            rows.append((opened, entry, at, quote, "CLOSED"))
            opened = -1
        return (quote, when, opened, entry), rows


def _shaped(rows: DataFrame, by: str) -> DataFrame:
    at = lambda c: F.timestamp_micros(c)
    return rows.select(by, at("opened").alias("opened_at"), "entry", at("closed").alias("closed_at"), "exit", "status", (F.col("exit") / F.nullif("entry", F.lit(0.0)) - 1).alias("ret"))


def _events(events: DataFrame, by: str, ts: str, order: str, kind: Column, price: str) -> DataFrame:
    return events.select(F.col(by), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).cast("bigint").alias("no"), kind.alias("kind"), F.col(price).cast("double").alias("price")).where(
        F.col(by).isNotNull() & F.col("kind").isNotNull() & F.col("at").isNotNull())


def batch_ledger(events: DataFrame, by: str, ts: str, order: str, kind: Column, price: str, rules: Rules, until: int | None = None) -> DataFrame:
    """by, opened_at, entry, closed_at, exit, status, ret of all events before `until` (microseconds; none: all, and expiries up to the last event of any key).

    Rows of one key follow each other in a sorted partition; only the key's state is held.
    """
    e = _events(events, by, ts, order, kind, price)
    if until is None:
        until = (e.agg(F.max("at")).first()[0] or 0) + 1
    key = dict(events.dtypes)[by]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, EMPTY
        for pdf in batches:
            out = []
            for k, at, what, p in zip(pdf[by], pdf["at"], pdf["kind"], pdf["price"]):
                if k != now:
                    out += [(now, *r) for r in rules.expired(state, until - 1)]
                    now, state = k, EMPTY
                state, rows = rules.step(state, int(at), what, None if pd.isna(p) else p)
                out += [(k, *r) for r in rows]
            yield pd.DataFrame(out, columns=[by, *_NAMES]).astype({"opened": "Int64", "closed": "Int64"})
        yield pd.DataFrame([(now, *r) for r in rules.expired(state, until - 1)], columns=[by, *_NAMES]).astype({"opened": "Int64", "closed": "Int64"})

    folded = e.where(F.col("at") < until).drop("ts").repartition(by).sortWithinPartitions(by, "at", "no").select(by, "at", "kind", "price").mapInPandas(run, f"{by} {key}, {_ROWS}")
    return _shaped(folded, by)


class Ledger(StatefulProcessor):
    """Keeps a key's pending events and its state; see the module."""

    def __init__(self, by: str, rules: Rules):
        self.by, self.rules = by, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at bigint, no bigint, kind string, price double")
        self.state = handle.getValueState("state", "quote double, at bigint, opened bigint, entry double")

    def _wake(self, pending: list[tuple], state: tuple) -> None:
        """One timer: the earliest pending event, expiry or end of a quote."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = [pending[0][0]] if pending else []
        ends += [state[2] + self.rules.hold * 1_000_000] if state[2] >= 0 else []
        ends += [state[1] + self.rules.stale * 1_000_000] if state[1] >= 0 and not ends else []
        if ends:
            self.handle.registerTimer(min(ends) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.pending.appendList([(int(a), int(n), k, None if pd.isna(p) else float(p)) for a, n, k, p in zip(pdf["at"], pdf["no"], pdf["kind"], pdf["price"])])
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Takes the events that the watermark has passed, in order."""
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.pending.get())
        state = tuple(self.state.get()) if self.state.exists() else EMPTY
        out = []
        for at, _, kind, price in (r for r in waiting if r[0] < until):
            state, rows = self.rules.step(state, at, kind, price)
            out += rows
        late = self.rules.expired(state, until - 1)
        if late:
            out, state = out + late, (state[0], state[1], -1, 0.0)
        if state[1] >= 0 and state[1] + self.rules.stale * 1_000_000 < until:
            state = (0.0, -1, state[2], state[3])
        waiting = [r for r in waiting if r[0] >= until]
        self.pending.put(waiting) if waiting else self.pending.clear()
        self.state.update(state) if state != EMPTY else self.state.clear()
        self._wake(waiting, state)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.by, *_NAMES]).astype({"opened": "Int64", "closed": "Int64", "entry": float, "exit": float})

    def close(self) -> None:
        pass


def streaming_ledger(events: DataFrame, by: str, ts: str, order: str, kind: Column, price: str, rules: Rules, late: str = "1 hour") -> DataFrame:
    """The rows of `batch_ledger` as a stream, up to the watermark. Needs a state store that keeps timers (ROCKS)."""
    key = dict(events.dtypes)[by]
    e = _events(events, by, ts, order, kind, price).withWatermark("ts", late)
    rows = e.groupBy(by).transformWithStateInPandas(Ledger(by, rules), f"{by} {key}, {_ROWS}", "Append", "EventTime")
    return _shaped(rows, by)
