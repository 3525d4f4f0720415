"""Stream queries: each runs its stream over a table's files and returns what the sink holds; the twins are batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as t
from ..streaming import ordered, sink, state


def stream_repeats(spark, d):
    """Messages by user and category, marked as repeats within half an hour of the last sighting."""
    state.with_state_store(spark)
    e = sink.events_stream(spark, d).select(F.col("id").alias("message_id"), F.concat_ws(" ", "layer", "user_id").alias("key"), "at")
    return sink.run_to_table(spark, state.sliding_repeats(e), "repeats").groupBy("duplicate").agg(F.count("*").alias("n"))


def stream_latest(spark, d):
    """The newest event of each user, from the updates of every batch."""
    state.with_state_store(spark)
    rows = sink.run_to_table(spark, state.latest_rows(sink.events_stream(spark, d)), "latest", mode="update")
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct("id", "layer"), "revision").alias("r"))
    return newest.select("user_id", "r.id", "r.layer")


def stream_limits(spark, d):
    state.with_state_store(spark)
    rows = sink.run_to_table(spark, state.limited(sink.events_stream(spark, d), 3, 86400), "limits")
    return rows.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if("passed").alias("passed"))


def stream_late_split(spark, d):
    rows = sink.run_to_table(spark, sink.split_late(sink.events_stream(spark, d), "2024-01-15 12:00:00", past=1440, future=60), "late")
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def stream_hourly(spark, d):
    """Events per hour and category under a watermark."""
    e = sink.events_stream(spark, d).withWatermark("event_time", "60 minutes")
    counted = e.groupBy(F.window("event_time", "1 hour").alias("w"), "layer").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "layer", "n")
    rows = sink.run_to_table(spark, counted, "hourly", mode="update")
    return rows.groupBy("hour", "layer").agg(F.max("n").alias("n"))


def stream_once_per_key(spark, d):
    """Insert-if-absent on (id, event_time): both copies of a doubled stream, each key once."""
    e = sink.events_stream(spark, d).withWatermark("event_time", "60 minutes")
    once = e.union(sink.events_stream(spark, d).withWatermark("event_time", "60 minutes")).dropDuplicatesWithinWatermark(["id", "event_time"])
    return sink.run_to_table(spark, once.select("id", "layer"), "once").groupBy("layer").agg(F.count("*").alias("n"))


def stream_meta(spark, d):
    """The change counter after all batches."""
    rows = sink.run_to_table(spark, sink.events_stream(spark, d), "meta", each=sink.meta)
    return rows.agg(F.sum("rows").alias("rows"), F.max("max_event_id").alias("max_event_id"), (F.max("version") + 1).alias("versions"))


SPAN = 400 * 86400


def stream_unordered_repeats(spark, d):
    """The repeats of stream_repeats from a stream in no order: the watermark waits for all of it."""
    state.with_state_store(spark)
    e = t.events_log(spark, d).select(F.concat_ws(" ", "layer", "user_id").alias("key"), "id", "event_time")
    found = ordered.unordered_repeats(sink.out_of_order(spark, e, "key", "event_time", SPAN), f"{SPAN} seconds")
    return sink.run_to_table(spark, found, "unordered").where("key <> ''").groupBy("duplicate").agg(F.count("*").alias("n"))


def stream_leases(spark, d):
    """Users as tasks, whose events claim, finish or fail them; leases of six hours run out as the watermark passes."""
    state.with_state_store(spark)
    signal = F.when(F.col("k") % 4 < 2, "claim").when(F.col("k") % 4 == 2, "done").otherwise("failed")
    e = t.events_log(spark, d).select(F.col("user_id").cast("string").alias("task"), "id", "event_time", signal.alias("signal"))
    found = ordered.leased_tasks(sink.out_of_order(spark, e, "task", "event_time", SPAN), f"{SPAN} seconds", 21600, 7200, 3)
    return sink.run_to_table(spark, found, "leases").groupBy("status", "attempts").agg(F.count("*").alias("n"))


#: One row a signal: what the task is before it (run out, if its lease ended), then after it.
_LEASES = """, signals AS (SELECT user_id, epoch(event_time) AS x, CASE WHEN k % 4 < 2 THEN 'claim' WHEN k % 4 = 2 THEN 'done' ELSE 'failed' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_time, id) AS rn FROM events_log),
 fold AS (SELECT user_id, 0::BIGINT AS rn, 'free' AS status, 0::BIGINT AS n, 0::DOUBLE AS until, NULL::VARCHAR AS ran_out, NULL::VARCHAR AS became FROM (SELECT DISTINCT user_id FROM events_log)
  UNION ALL SELECT user_id, rn, coalesce(became, status), CASE WHEN became = 'leased' THEN n + 1 ELSE n END,
    CASE became WHEN 'leased' THEN x + 21600 WHEN 'retry' THEN x + 7200 * pow(2, n - 1) ELSE until END, ran_out, became FROM (
    SELECT *, CASE WHEN s = 'claim' AND (status IN ('free', 'expired') OR (status = 'retry' AND until <= x)) THEN 'leased' WHEN s = 'done' AND status = 'leased' THEN 'done'
      WHEN s = 'failed' AND status = 'leased' THEN CASE WHEN n >= 3 THEN 'dead' ELSE 'retry' END END AS became FROM (
      SELECT f.user_id, o.rn, o.x, o.s, f.n, f.until, CASE WHEN f.status = 'leased' AND f.until < o.x THEN CASE WHEN f.n >= 3 THEN 'dead' ELSE 'expired' END END AS ran_out, coalesce(ran_out, f.status) AS status
      FROM (SELECT user_id, rn, status, n, until FROM fold) f JOIN signals o ON o.user_id = f.user_id AND o.rn = f.rn + 1))),
 ends AS (SELECT status, n FROM fold QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1),
 changes AS (SELECT ran_out AS status, CASE WHEN became = 'leased' THEN n - 1 ELSE n END AS attempts FROM fold WHERE ran_out IS NOT NULL UNION ALL SELECT became, n FROM fold WHERE became IS NOT NULL
  UNION ALL SELECT CASE WHEN n >= 3 THEN 'dead' ELSE 'expired' END, n FROM ends WHERE status = 'leased')
 SELECT status, attempts, count(*) AS n FROM changes GROUP BY ALL"""

_REPEATS = "SELECT coalesce(epoch(event_time) - epoch(b) <= 1800, false) AS duplicate, count(*) AS n FROM (SELECT event_time, lag(event_time) OVER (PARTITION BY description ORDER BY event_time, message_id) AS b FROM events_log) GROUP BY 1"
_all = {
    "stream_d01_repeats": (stream_repeats, _REPEATS),
    "stream_d01_any_order": (stream_unordered_repeats, _REPEATS),
    "stream_d07_leases": (stream_leases, _LEASES),
    "stream_d13_latest_row": (stream_latest, "SELECT user_id, id, layer FROM events_log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) = 1"),
    "stream_d14_limits": (stream_limits, """, ordered AS (SELECT user_id, epoch(event_time) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_time) AS rn FROM events_log),
      fold AS (SELECT user_id, rn, x AS start, 1 AS n, 1 AS passed FROM ordered WHERE rn = 1 UNION ALL
        SELECT o.user_id, o.rn, CASE WHEN x - start > 86400 THEN x ELSE start END, CASE WHEN x - start > 86400 THEN 1 ELSE n + 1 END, passed + CASE WHEN x - start > 86400 OR n + 1 <= 3 THEN 1 ELSE 0 END FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
      SELECT user_id, max(rn) AS requests, CAST(max(passed) AS BIGINT) AS passed FROM fold GROUP BY 1"""),
    "stream_d03_late_split": (stream_late_split, "SELECT CASE WHEN event_time < TIMESTAMP '2024-01-14 12:00:00' THEN 'late' WHEN event_time > TIMESTAMP '2024-01-15 13:00:00' THEN 'future' ELSE 'accepted' END AS verdict, count(*) AS n FROM events_log GROUP BY 1"),
    "stream_d05_hourly": (stream_hourly, "SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M') AS hour, layer, count(*) AS n FROM events_log GROUP BY ALL"),
    "stream_d02_once_per_key": (stream_once_per_key, "SELECT layer, count(*) AS n FROM events_log GROUP BY 1"),
    "stream_m03_change_counter": (stream_meta, "SELECT count(*) AS rows, max(id) AS max_event_id, 3::BIGINT AS versions FROM events_log"),
}
QUERIES = {k: f for k, (f, _) in _all.items()}
ORACLE_SQL = {k: f"WITH RECURSIVE {t.EVENTS_LOG}{'' if sql.startswith(',') else ' '}{sql}" for k, (_, sql) in _all.items()}
