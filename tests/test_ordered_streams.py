"""Streams whose rows come in no order, and whose state runs out with the watermark."""

import random

from pyspark.sql import functions as F

from ephemera.streaming import ordered, sink, state

BASE = 1_700_000_000


def stream(spark, rows, columns, key, delay):
    df = spark.createDataFrame(rows, columns).withColumn("event_time", F.timestamp_seconds("at")).drop("at")
    return sink.out_of_order(spark, df, key, "event_time", delay)


def test_repeats_of_a_shuffled_stream_equal_a_sorted_pass(spark):
    state.with_state_store(spark)
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, BASE + rng.randrange(40_000)) for i in range(300)] + [(None, 900, BASE), ("a", 901, None)]
    rows += [("d", 400, BASE + 5), ("d", 401, BASE + 5)]
    out = sink.run_to_table(spark, ordered.unordered_repeats(stream(spark, rows, "key string, id long, at long", "key", 100_000), "100000 seconds", 600), "t-repeats")
    want, last = {}, {}
    for key, ident, at in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1])):
        want[ident], last[key] = key in last and at - last[key] <= 600, at
    assert {r["id"]: r["duplicate"] for r in out.where("key <> ''").collect()} == want and 20 < sum(want.values()) < 290


def test_leases_run_out_between_batches(spark):
    state.with_state_store(spark)
    said = {
        "lost": [(0, "claim")],
        "saved": [(0, "claim"), (300, "done"), (400, "claim")],
        "late": [(0, "claim"), (301, "done"), (302, "claim"), (310, "done")],
        "failing": [(0, "claim"), (10, "failed"), (20, "claim"), (70, "claim"), (80, "failed"), (199, "claim"), (200, "claim"), (250, "failed"), (900, "claim")],
        "tired": [(0, "claim"), (1000, "claim"), (2000, "claim"), (3000, "claim")],
        "idle": [(0, "done"), (5, "failed"), (6, None)],
    }
    rows = [(task, i, BASE + at, signal) for task, own in said.items() for i, (at, signal) in enumerate(own)] + [(None, 1, BASE, "claim")]
    found = ordered.leased_tasks(stream(spark, rows, "task string, id long, at long, signal string", "task", 50_000), "50000 seconds", 300, 60, 3)
    out = sink.run_to_table(spark, found, "t-leases").where("task <> ''").collect()
    got = {t: [(r["at"] - BASE, r["status"], r["attempts"]) for r in sorted(out, key=lambda r: (r["at"], r["attempts"])) if r["task"] == t] for t in said}
    assert got == {
        "lost": [(0, "leased", 1), (300, "expired", 1)],
        "saved": [(0, "leased", 1), (300, "done", 1)],
        "late": [(0, "leased", 1), (300, "expired", 1), (302, "leased", 2), (310, "done", 2)],
        "failing": [(0, "leased", 1), (10, "retry", 1), (70, "leased", 2), (80, "retry", 2), (200, "leased", 3), (250, "dead", 3)],
        "tired": [(0, "leased", 1), (300, "expired", 1), (1000, "leased", 2), (1300, "expired", 2), (2000, "leased", 3), (2300, "dead", 3)],
        "idle": [],
    }


def test_rows_of_a_stream_in_no_order_are_made_once(spark):
    calls, n = spark.sparkContext.accumulator(0), 3000

    @F.udf("string")
    def signal(i):
        calls.add(1)
        return f"s{i % 7}"

    rows = spark.range(n).select(F.col("id").cast("string").alias("task"), "id", F.timestamp_seconds(F.lit(BASE) + F.col("id")).alias("event_time"), signal("id").alias("signal"))
    mixed = sink.out_of_order(spark, rows, "task", "event_time", 10_000, rows_per_file=500)
    assert calls.value == n
    got = sink.run_to_table(spark, mixed.withColumn("at", F.col("event_time").cast("long") - BASE), "t-mixed").collect()
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r)
    *parts, end = (batches[b] for b in sorted(batches))
    assert len(parts) == 3 and all(min(r["at"] for r in p) < n / 4 and max(r["at"] for r in p) > n * 3 / 4 for p in parts)
    assert sorted((r["id"], r["task"], r["at"], r["signal"]) for p in parts for r in p) == [(i, str(i), i, f"s{i % 7}") for i in range(n)]
    assert [(r["id"], r["task"], r["at"], r["signal"]) for r in end] == [(None, "", n - 1 + 20_000, None)]
