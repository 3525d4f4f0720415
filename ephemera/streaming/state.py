"""Stateful stream operators: sliding de-duplication, keyed upserts and fixed-window limits, a small state per key.

Keys share the states of a fixed number of buckets, as a call to a state takes as long for one key as for a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: So many states hold all keys. It is fixed for the life of a checkpoint.
BUCKETS = 1024


def with_state_store(spark: SparkSession) -> None:
    """Arbitrary state needs this provider; set it before a query starts."""
    spark.conf.set(PROVIDER, ROCKSDB)


def dealt(rows: DataFrame, key: str, buckets: int = BUCKETS):
    """rows grouped by the bucket of their key."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket")


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(content: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(content).read_pandas()


class Held:
    """A row for each key of a bucket, all read and written by one call to the state.

    With a time to live a key is forgotten that long after it was last put, and the state when the last key is.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, ttl_ms: int | None = None):
        self.key, self.ttl_ms, self.state = key, ttl_ms, handle.getValueState(name, "rows binary", ttl_ms)

    def get(self, columns: list[str], now_ms: int = 0) -> pd.DataFrame:
        """The columns by key."""
        content = self.state.get()
        rows = unpacked(content[0]) if content is not None else pd.DataFrame({c: [] for c in (self.key, *columns)})
        if self.ttl_ms and content is not None:
            rows = rows[rows["put_ms"] + self.ttl_ms > now_ms]
        return rows.set_index(self.key)

    def put(self, old: pd.DataFrame, new: pd.DataFrame, now_ms: int = 0) -> None:
        """new rows in place of old ones of the same keys."""
        if self.ttl_ms:
            new = new.assign(put_ms=now_ms)
        kept = old[~old.index.isin(new.index)]
        rows = pd.concat([kept, new]) if len(kept) else new
        if len(rows):
            self.state.update((packed(rows.rename_axis(self.key).reset_index()),))
        elif self.state.exists():
            self.state.clear()


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable", ignore_index=True)


def before_each(keys: pd.Series, at: pd.Series, last: pd.Series) -> pd.Series:
    """The time before each row of its key, of rows sorted by key and time; for a key's first row that of last."""
    return at.groupby(keys, sort=False).shift().where(keys.duplicated(), keys.map(last).astype(float))


def _mode(ttl_ms: int | None) -> str:
    return "ProcessingTime" if ttl_ms else "None"


class SlidingRepeats(StatefulProcessor):
    """Marks messages whose key was seen at most window seconds before; each sighting moves the time on.

    State is the last time of each key. A key that is not seen for the state's time to live is forgotten.
    """

    def __init__(self, window_s: int = 1800, ttl_ms: int | None = None):
        self.window_s, self.ttl_ms = window_s, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Held(handle, "last", "key", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data, now = _sorted(rows, "key", "at", "message_id"), timerValues.getCurrentProcessingTimeInMs()
        held = self.last.get(["t"], now)
        before = before_each(data["key"], data["at"], held["t"])
        self.last.put(held, data.groupby("key")["at"].last().dropna().to_frame("t"), now)
        yield pd.DataFrame({"message_id": data["message_id"], "key": data["key"], "at": data["at"], "duplicate": data["at"] - before <= self.window_s})

    def close(self) -> None:
        pass


def sliding_repeats(messages: DataFrame, window_s: int = 1800, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """messages (message_id, key, at in seconds) with duplicate; batches must come in time order.

    Messages without a key are never duplicates, and pass by the state. ttl_ms is of processing time: give it to a stream
    that runs on, so that its state stays bounded; a replay of what is there needs None, as Spark asks for batch after
    batch as long as a state may run out.
    """
    out = "message_id long, key string, at double, duplicate boolean"
    keyed = dealt(messages.where("key IS NOT NULL").select("message_id", "key", "at"), "key", buckets)
    marked = keyed.transformWithStateInPandas(SlidingRepeats(window_s, ttl_ms), out, "Append", _mode(ttl_ms))
    return marked.unionByName(messages.where("key IS NULL").selectExpr("message_id", "key", "at", "false AS duplicate"))


class LatestRow(StatefulProcessor):
    """The newest row of each key and how often it changed."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Held(handle, "row", "user_id", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data, now = _sorted(rows, "user_id", "at", "id").drop_duplicates(["user_id", "at", "id"]), timerValues.getCurrentProcessingTimeInMs()
        held = self.row.get(["id", "at", "layer", "revision"], now)
        none = pd.DataFrame({"id": 0, "at": -np.inf, "layer": None, "revision": 0}, index=pd.Index(data["user_id"].unique(), name="user_id"))
        touched = pd.concat([held[held.index.isin(none.index)][none.columns], none[~none.index.isin(held.index)]]) if len(held) else none
        at, ident = data["user_id"].map(touched["at"]), data["user_id"].map(touched["id"])
        newer = data[(data["at"] > at) | ((data["at"] == at) & (data["id"] > ident))]
        last = newer.drop_duplicates("user_id", keep="last").set_index("user_id")[["id", "at", "layer"]]
        last["revision"] = touched["revision"].reindex(last.index) + newer.groupby("user_id").size()
        self.row.put(held, last, now)
        now_held = pd.concat([touched[~touched.index.isin(last.index)], last]) if len(last) < len(touched) else last
        yield now_held.rename_axis("user_id").reset_index()

    def close(self) -> None:
        pass


def latest_rows(events: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """user_id, id, at, layer, revision: each batch emits the keys it touched. Rows without a key have no latest one and go."""
    out = "user_id long, id long, at double, layer string, revision long"
    return dealt(events.where("user_id IS NOT NULL").select("user_id", "id", "at", "layer"), "user_id", buckets).transformWithStateInPandas(LatestRow(ttl_ms), out, "Update", _mode(ttl_ms))


def windows_of(at: np.ndarray, start: float | None, n: int, window_s: float) -> tuple[np.ndarray, float, int]:
    """The place of each sorted request in its window, with the last window's start and count. A step per window."""
    place, i = np.zeros(len(at), np.int64), 0
    while i < len(at):
        if start is None or at[i] - start > window_s:
            start, n = float(at[i]), 0
        end = i + max(1, int(np.searchsorted(at[i:] - start, window_s, "right")))
        place[i:end] = n + np.arange(1, end - i + 1)
        n, i = n + end - i, end
    return place, start, n


class FixedWindow(StatefulProcessor):
    """Lets limit requests through in a window that begins with the first request after the last one ran out."""

    def __init__(self, limit: int, window_s: float, ttl_ms: int | None = None):
        self.limit, self.window_s, self.ttl_ms = limit, window_s, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = Held(handle, "window", "user_id", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data, now = _sorted(rows, "user_id", "at", "id"), timerValues.getCurrentProcessingTimeInMs()
        held = self.window.get(["start", "n"], now)
        users, at = data["user_id"].to_numpy(), data["at"].to_numpy(float)
        known = dict(zip(held.index, zip(held["start"].tolist(), held["n"].tolist(), strict=True), strict=True))
        begins = np.flatnonzero(np.concatenate([[True], users[1:] != users[:-1]]))
        place, ends = np.zeros(len(at), np.int64), []
        for a, b in zip(begins, [*begins[1:], len(at)], strict=True):
            place[a:b], start, n = windows_of(at[a:b], *known.get(users[a], (None, 0)), self.window_s)
            ends.append((float(start), int(n)))
        self.window.put(held, pd.DataFrame(ends, columns=["start", "n"], index=users[begins]), now)
        yield pd.DataFrame({"user_id": users, "id": data["id"], "passed": place <= self.limit})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int, window_s: float, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """user_id, id, passed. Requests without a user are not limited, and pass by the state."""
    keyed = dealt(requests.where("user_id IS NOT NULL").select("user_id", "id", "at"), "user_id", buckets)
    judged = keyed.transformWithStateInPandas(FixedWindow(limit, window_s, ttl_ms), "user_id long, id long, passed boolean", "Append", _mode(ttl_ms))
    return judged.unionByName(requests.where("user_id IS NULL").selectExpr("user_id", "id", "true AS passed"))
