"""Time-series operators over samples: rates of counters, gauges, quantiles of histograms, and request limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.state import windows_of


def window_start(time: str, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(time) / seconds) * seconds)


def rate(samples: DataFrame, series: Sequence[str], label: str, time: str, value: str, tie: str, seconds: int = 300) -> DataFrame:
    """label, start, rate: what the counters of a label gained a second in each window. A counter that falls was reset, and gained its value."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(time, tie))
    gain = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    gained = samples.select(label, window_start(time, seconds).alias("start"), gain.cast("double").alias("gain"))
    return gained.groupBy(label, "start").agg((F.sum("gain") / seconds).alias("rate"))


def event_rate(rows: DataFrame, label: str, time: str, seconds: int = 60) -> DataFrame:
    """label, start, rate: rows a second in each window."""
    return rows.groupBy(label, window_start(time, seconds).alias("start")).agg((F.count("*") / seconds).alias("rate"))


def gauge(samples: DataFrame, label: str, time: str, value: str, tie: str, seconds: int = 3600) -> DataFrame:
    """label, start, last, most: each window's last and greatest value."""
    return samples.groupBy(label, window_start(time, seconds).alias("start")).agg(F.max_by(value, F.struct(time, tie)).alias("last"), F.max(value).alias("most"))


def histogram_quantile(samples: DataFrame, label: str, value: str, bounds: Sequence[float], q: float) -> DataFrame:
    """label, quantile: read off cumulative buckets, evenly within the bucket that holds it; beyond the last bound that bound."""
    counts = samples.groupBy(label).agg(F.count(value).alias("total"), F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"), F.count_if(F.col(value) <= a).alias("under"), F.count_if(F.col(value) <= b).alias("upto")) for a, b in zip([0.0, *bounds], bounds, strict=False))).alias("b"))
    rank = F.col("total") * q
    hit = F.get(F.filter("b", lambda x: x["upto"] >= rank), F.lit(0))
    inside = hit["lo"] + (hit["hi"] - hit["lo"]) * (rank - hit["under"]) / F.nullif(hit["upto"] - hit["under"], F.lit(0))
    return counts.select(label, F.when(F.col("total") == 0, None).otherwise(F.coalesce(inside, hit["lo"], F.lit(float(bounds[-1])))).alias("quantile"))


def first_of(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """a's rows, and b's for what a lacks."""
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), list(on), "full_outer")
    return both.select(*on, F.coalesce("_a", "_b").alias(value))


def _judged(judge: Callable[[], Callable], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, requests, passed from rows sorted by key and time; one key's state at a time is kept, whatever its rows."""
    own, step, requests, passed = None, None, 0, 0
    for batch in batches:
        keys, at = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] if len(keys) and keys[0] != keys[-1] else []
        out = []
        for a, b in zip([0, *ends], [*ends, len(keys)], strict=True) if len(keys) else ():
            key = keys[a].as_py()
            if step is None or key != own:
                if step is not None:
                    out.append((own, requests, passed))
                own, step, requests, passed = key, judge(), 0, 0
            requests, passed = requests + b - a, passed + step(at[a:b])
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], keys.type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["key", "requests", "passed"])
    if step is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], keys.type), pa.array([requests], pa.int64()), pa.array([passed], pa.int64())], ["key", "requests", "passed"])


def _limited(requests: DataFrame, key: str, time: str, judge: Callable[[], Callable]) -> DataFrame:
    rows = requests.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(time).cast("double").alias("at"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.repartition("key").sortWithinPartitions("key", "at").mapInArrow(lambda batches: _judged(judge, batches), f"key {kind}, requests long, passed long")
    return found.withColumnRenamed("key", key)


def fixed_window_limits(requests: DataFrame, key: str, time: str, limit: int, window_s: float) -> DataFrame:
    """key, requests, passed: how many a fixed-window limiter lets through. A window starts with the first request more than window_s after the last start."""

    def judge() -> Callable:
        state: list = [None, 0]

        def step(at) -> int:
            place, state[0], state[1] = windows_of(at, state[0], state[1], window_s)
            return int((place <= limit).sum())

        return step

    return _limited(requests, key, time, judge)


def sliding_limits(requests: DataFrame, key: str, time: str, limit: int, window_s: float) -> DataFrame:
    """key, requests, passed: a request passes if fewer than limit passed in the window_s seconds before it; the state is those."""

    def judge() -> Callable:
        kept: deque[float] = deque(maxlen=limit)

        def step(at) -> int:
            n = 0
            for t in at.tolist():
                if len(kept) < limit or t - kept[0] >= window_s:
                    kept.append(t)
                    n += 1
            return n

        return step

    return _limited(requests, key, time, judge)
