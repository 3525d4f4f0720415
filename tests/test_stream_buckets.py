"""Keys of a stream share the states of a fixed number of buckets, and each is judged as if it had its own."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ephemera.streaming import ordered, sink, state

BASE, KEYS, BUCKETS = 1_700_000_000, 400, 8


def rows_held(out):
    """The state's rows after a run over all that is there."""
    query = out.writeStream.outputMode("append").trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.format("noop").mode("overwrite").save()).start()
    query.awaitTermination()
    held = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    return max(held)


@pytest.fixture(scope="module")
def made(spark):
    state.with_state_store(spark)
    rng = random.Random(11)
    rows = [(i, rng.randrange(KEYS), float(BASE + rng.randrange(20_000))) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id long, user_id long, at double")


def by_key(rows):
    out = {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(k, []).append((i, at))
    return out


def test_repeats_of_many_keys_in_few_states(spark, made):
    rows, df = made
    messages = sink.in_order(spark, df.select(F.col("id").alias("message_id"), F.col("user_id").cast("string").alias("key"), "at"), "at")
    out = state.sliding_repeats(messages, 600, buckets=BUCKETS)
    assert 0 < rows_held(out) <= BUCKETS
    want = {i: j > 0 and at - own[j - 1][1] <= 600 for own in by_key(rows).values() for j, (i, at) in enumerate(own)}
    assert {r["message_id"]: r["duplicate"] for r in sink.run_to_table(spark, out, "b-repeats").collect()} == want and 0 < sum(want.values()) < len(want)


def test_limits_of_many_keys_in_few_states(spark, made):
    rows, df = made
    out = state.limited(sink.in_order(spark, df, "at"), 2, 3000, buckets=BUCKETS)
    assert 0 < rows_held(out) <= BUCKETS
    want = {}
    for own in by_key(rows).values():
        place, *_ = state.windows_of(np.array([at for _, at in own]), None, 0, 3000)
        want |= {i: bool(p <= 2) for (i, _), p in zip(own, place, strict=True)}
    assert {r["id"]: r["passed"] for r in sink.run_to_table(spark, out, "b-limits").collect()} == want and 0 < sum(want.values()) < len(want)


def test_latest_rows_of_many_keys_in_few_states(spark, made):
    rows, df = made
    out = state.latest_rows(sink.in_order(spark, df.withColumn("layer", F.concat(F.lit("l"), "id")), "at"), buckets=BUCKETS)
    got = {}
    for r in sorted(sink.run_to_table(spark, out, "b-latest", mode="update").collect(), key=lambda r: r["revision"]):
        got[r["user_id"]] = (r["id"], r["at"], r["layer"], r["revision"])
    assert got == {k: (*own[-1], f"l{own[-1][0]}", len(own)) for k, own in by_key(rows).items()}


def test_a_key_is_forgotten_alone():
    class Handle:
        def getValueState(self, name, schema, ttl_ms=None):
            return self

        content = None
        get = lambda self: self.content
        exists = lambda self: self.content is not None

        def update(self, value):
            self.content = value

        def clear(self):
            self.content = None

    held = state.Held(Handle(), "x", "key", 100)
    put = lambda keys, t, now: held.put(held.get(["t"], now), pd.DataFrame({"t": t}, index=keys), now)
    put(["a", "b"], [1.0, 2.0], 1000)
    put(["b", "c"], [3.0, 4.0], 1060)
    assert held.get(["t"], 1099)["t"].to_dict() == {"a": 1.0, "b": 3.0, "c": 4.0}
    assert held.get(["t"], 1100)["t"].to_dict() == {"b": 3.0, "c": 4.0} and not len(held.get(["t"], 1160))


def test_any_order_in_few_states(spark, made):
    rows, df = made
    shuffled = df.select(F.col("user_id").cast("string").alias("key"), "id", F.timestamp_seconds("at").alias("event_time"))
    out = ordered.unordered_repeats(sink.out_of_order(spark, shuffled, "key", "event_time", 100_000), "100000 seconds", 600, buckets=BUCKETS)
    # a buffer, a due time and the last sightings for each bucket, and its timer in two orders
    assert 0 < rows_held(out) <= BUCKETS * 8


def test_leases_in_few_states(spark, made):
    rows, df = made
    signals = df.select(F.col("user_id").cast("string").alias("task"), "id", F.timestamp_seconds("at").alias("event_time"), F.element_at(F.array(F.lit("claim"), F.lit("done"), F.lit("failed")), (F.col("id") % 3 + 1).cast("int")).alias("signal"))
    leases = lambda n: ordered.leased_tasks(sink.out_of_order(spark, signals, "task", "event_time", 100_000), "100000 seconds", 900, 200, 3, buckets=n)
    assert 0 < rows_held(leases(BUCKETS)) <= BUCKETS * 8
    changes = lambda n: sorted(map(tuple, sink.run_to_table(spark, leases(n), "b-leases").where("task <> ''").collect()))
    assert changes(BUCKETS) == changes(1 << 40)
