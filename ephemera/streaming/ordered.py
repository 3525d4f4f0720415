"""Stateful operators over rows that come in any order: a buffer per bucket of keys is released by timers as the watermark passes.

What is late by the watermark never reaches the state, so the watermark's delay is how far rows may be out of order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import BUCKETS, Held, before_each, dealt, packed, unpacked


class InOrder(StatefulProcessor):
    """Holds the rows (key, at, id, what) of a bucket until the watermark lies behind them, then folds them by key in order of time and id.

    One timer a bucket stands at the earliest moment at which there is something to do: a row to release, or what the fold
    itself waits for. Subclasses have their own state (open) and a fold.
    """

    row: tuple[str, ...] = ("key", "at", "id", "what")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "rows binary")
        self.due = handle.getValueState("due", "ms long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, ready: pd.DataFrame, now: float) -> tuple[pd.DataFrame, float | None]:
        """Output rows for the rows that are ready and for what has run out by now (seconds), and the time that is waited for, if any."""
        raise NotImplementedError

    @staticmethod
    def _ms(at: float) -> int:
        """The first watermark in milliseconds at which no row of this time can come any more."""
        return int(at * 1000) + 1

    def _arm(self, times: list[int]) -> None:
        held = self.due.get()
        held = held[0] if held is not None else None
        first = min([t for t in (held, *times) if t is not None], default=None)
        if first is not None and first != held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(first)
            self.due.update((first,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows), ignore_index=True)
        self.rows.appendValue((packed(data[list(self.row)]),))
        self._arm([self._ms(float(data["at"].min()))])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        parts = [unpacked(content) for (content,) in self.rows.get()]
        held = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in self.row})
        over = np.trunc(held["at"].to_numpy(float) * 1000) + 1 <= mark
        rest = held[~over]
        if len(rest):
            self.rows.put([(packed(rest),)])
        elif parts:
            self.rows.clear()
        out, waits = self.fold(held[over].sort_values(["key", "at", "id"], ignore_index=True), mark / 1000)
        self.due.clear()
        self._arm(([self._ms(float(rest["at"].min()))] if len(rest) else []) + ([self._ms(waits)] if waits is not None else []))
        if len(out):
            yield out

    def close(self) -> None:
        pass


class UnorderedRepeats(InOrder):
    """Marks rows whose key was seen at most window seconds before; each sighting moves the time on."""

    row = ("key", "at", "id")

    def __init__(self, window_s: float):
        self.window_s = window_s

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = Held(handle, "last", "key")

    def fold(self, ready: pd.DataFrame, now: float) -> tuple[pd.DataFrame, float | None]:
        held = self.last.get(["t"])
        duplicate = ready["at"] - before_each(ready["key"], ready["at"], held["t"]) <= self.window_s
        last = ready.drop_duplicates("key", keep="last").set_index("key")["at"].to_frame("t")
        # of a key to which nothing that can still come is near enough no state is needed
        near = lambda t: t[now - t["t"] <= self.window_s]
        old, new = near(held[~held.index.isin(last.index)]), near(last)
        self.last.put(old, new)
        newest = max((float(t["t"].max()) for t in (old, new) if len(t)), default=None)
        return ready[["key", "id", "at"]].assign(duplicate=duplicate), None if newest is None else newest + self.window_s + 0.001


class Leases(InOrder):
    """A task's life by its signals: claim, done, failed; and by time: a lease that runs out gives the task back.

    A claim counts if the task is free, or if its time to wait after a failure is over. After attempts claims a failure or
    a lease that runs out makes the task dead; done and dead tasks hear no more signals. A signal at the very end of a
    lease still counts.
    """

    def __init__(self, lease_s: float, backoff_s: float, attempts: int):
        self.lease_s, self.backoff_s, self.attempts = lease_s, backoff_s, attempts

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.task = Held(handle, "task", "task")

    def _run_out(self, status: str, n: int, until: float) -> tuple[str, int, float]:
        return ("dead" if n >= self.attempts else "expired", n, until)

    def _after(self, at: float, signal: str | None, status: str, n: int, until: float) -> tuple[str, int, float] | None:
        """What a task becomes by a signal, if that changes it."""
        if signal == "claim" and (status in ("free", "expired") or (status == "retry" and until <= at)):
            return "leased", n + 1, at + self.lease_s
        if signal == "done" and status == "leased":
            return "done", n, at
        if signal == "failed" and status == "leased":
            return ("dead", n, at) if n >= self.attempts else ("retry", n, at + self.backoff_s * 2 ** (n - 1))
        return None

    def fold(self, ready: pd.DataFrame, now: float) -> tuple[pd.DataFrame, float | None]:
        fields, out = ["status", "n", "until"], []
        held = self.task.get(fields)
        own = dict(zip(held.index, zip(*(held[f].tolist() for f in fields), strict=True), strict=True))

        def change(task: str, at: float, state: tuple[str, int, float]) -> tuple[str, int, float]:
            out.append((task, at, state[0], state[1]))
            own[task] = state
            return state

        for task, at, signal in zip(*(ready[c].tolist() for c in ("key", "at", "what")), strict=True):
            state = own.get(task, ("free", 0, 0.0))
            if state[0] == "leased" and state[2] < at:
                state = change(task, state[2], self._run_out(*state))
            after = self._after(at, signal, *state)
            if after is not None:
                change(task, at, after)
        leased = [(task, state) for task, state in own.items() if state[0] == "leased"]
        for task, state in leased:
            if self._ms(state[2]) <= self._ms(now) - 1:
                change(task, state[2], self._run_out(*state))
        if out:
            self.task.put(held.iloc[:0], pd.DataFrame(own.values(), columns=fields, index=list(own)))
        waits = min((own[task][2] for task, _ in leased if own[task][0] == "leased"), default=None)
        return pd.DataFrame(out, columns=["task", "at", "status", "attempts"]), waits


def _keyed(rows: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)


def unordered_repeats(messages: DataFrame, delay: str, window_s: float = 1800, buckets: int = BUCKETS) -> DataFrame:
    """key, id, at, duplicate of messages(key, id, event_time) in any order within delay, each once the watermark has passed it.

    Messages without a key or time go: they can be no repeats. Ties in time are told apart by id.
    """
    rows = _keyed(messages, "key", "event_time", delay).select("key", "event_time", F.col("event_time").cast("double").alias("at"), F.coalesce("id", F.lit(0)).alias("id"))
    return dealt(rows, "key", buckets).transformWithStateInPandas(UnorderedRepeats(window_s), "key string, id long, at double, duplicate boolean", "Append", "EventTime")


def leased_tasks(signals: DataFrame, delay: str, lease_s: float = 300, backoff_s: float = 60, attempts: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """task, at, status, attempts: every change of a task, from signals(task, id, event_time, signal) in any order within delay.

    Statuses are leased, expired, retry (until backoff_s, doubled with each attempt), done and dead. A lease that runs out
    is told when the watermark passes its end, whether or not another signal comes.
    """
    rows = _keyed(signals, "task", "event_time", delay).select(F.col("task").alias("key"), "event_time", F.col("event_time").cast("double").alias("at"), F.coalesce("id", F.lit(0)).alias("id"), F.col("signal").alias("what"))
    return dealt(rows, "key", buckets).transformWithStateInPandas(Leases(lease_s, backoff_s, attempts), "task string, at double, status string, attempts long", "Append", "EventTime")
