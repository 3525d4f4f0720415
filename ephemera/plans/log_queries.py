"""Queries of the event log, the queue and their maintenance, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import limits
from ..operators import log as o
from ..operators import metrics as m
from ..operators.reports import rounded
from ..sources import tables as t
from .report_queries import r3

_SHOWN = ("id", "message_id", "layer", "strategy", "confidence")
SHOWN = "id, message_id, layer, strategy, confidence"
MARKS = (0, 1, 500, 5000, 9_999, 10_000, 99_999)


def _log(f):
    return lambda spark, d: f(t.events_log(spark, d), t.as_of(t.events_log(spark, d)))


def _queue(f):
    return lambda spark, d: f(t.queue(spark, d), t.as_of(t.events_log(spark, d)))


def _marks(spark):
    return spark.createDataFrame([(m,) for m in MARKS], "mark long")


def _subscriptions(spark):
    return spark.createDataFrame([("all", []), ("clicks", ["click"]), ("two", ["error", "view"]), ("none", ["absent"])], "subscriber string, layers array<string>")


def _placed(e):
    return e.withColumns({"lon": rounded("lon"), "lat": rounded("lat")})


def _twice(e):
    """Every row twice, the second time in another category."""
    return e.withColumn("seq", F.lit(0)).unionByName(e.withColumns({"layer": F.upper("layer"), "seq": F.lit(1)}))


def _resigned(e, n):
    """The whole table, with message ids that no other row has but for every n-th."""
    return e.withColumn("message_id", F.when(F.col("id") % n == 0, F.col("message_id")).otherwise(-F.col("message_id")))


def _wanted(e):
    """The whole table with some rows under new ids, and others in another category."""
    return e.select(F.when(F.col("id") % 7 == 0, F.col("id") + 10**9).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 5 == 0, F.lit("x")).otherwise(F.col("layer")).alias("layer"))


_H = "SELECT CASE WHEN id % 7 = 0 THEN id + 1000000000 ELSE id END AS id, CASE WHEN id % 5 = 0 THEN 'x' ELSE layer END AS layer FROM events_log"
_FEATURE = """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || floor(lon * 1000 + 0.5) / 1000 || ',' || floor(lat * 1000 + 0.5) / 1000 || ']},"properties":{"id":' || id || ',"message_id":' || message_id || ',"layer":"' || layer || '","description":"' || description || '","strategy":"' || strategy || '","confidence":' || confidence || '}}'"""
_EPOCH = "CAST(epoch(date_trunc('second', {})) AS BIGINT)"

_all = {
    "p01_recent_window": (_log(lambda e, n: o.recent(e, n, 1440).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log, as_of WHERE event_time >= t - INTERVAL 1440 MINUTE"),
    "p02_acceptance_window": (_log(lambda e, n: o.accepted(e, n).groupBy("verdict").agg(F.count("*").alias("n"))), "SELECT CASE WHEN event_time < t - INTERVAL 60 MINUTE THEN 'late' WHEN event_time > t + INTERVAL 5 MINUTE THEN 'future' ELSE 'accepted' END AS verdict, count(*) AS n FROM events_log, as_of GROUP BY 1"),
    "p03_dynamic_conditions": (_log(lambda e, n: o.recent(e, n, 10000, since="2024-01-25 00:00:00", after_id=100, layers=["click", "view"]).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log, as_of WHERE event_time >= t - INTERVAL 10000 MINUTE AND event_time > TIMESTAMP '2024-01-25 00:00:00' AND id > 100 AND layer IN ('click', 'view')"),
    "p04_category_membership": (_log(lambda e, n: e.where(F.col("layer").isin("error", "signup")).groupBy("layer").agg(F.count("*").alias("n"))), "SELECT layer, count(*) AS n FROM events_log WHERE layer IN ('error', 'signup') GROUP BY 1"),
    "p05_updates_after_watermark": (_log(lambda e, n: o.updates(e, after_id=50, after_message_id=9000, limit=500).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log WHERE message_id > 9000 ORDER BY id LIMIT 500"),
    "p06_resync_flags": (lambda s, d: o.resync_flags(t.events_log(s, d), _marks(s)), f"SELECT mark, mark > hi OR (lo > 0 AND mark < lo - 1) AS resync FROM (SELECT unnest({list(MARKS)})::BIGINT AS mark), (SELECT coalesce(min(message_id), 0) AS lo, coalesce(max(message_id), 0) AS hi FROM events_log)"),
    "p07_pattern_predicates": (_log(lambda e, n: e.where(F.col("description").like("click%") & ~F.col("description").like("%9") & F.col("description").rlike("[0-9]{2,}$")).agg(F.count("*").alias("n"))), "SELECT count(*) AS n FROM events_log WHERE description LIKE 'click%' AND description NOT LIKE '%9' AND regexp_matches(description, '[0-9]{2,}$')"),
    "p08_json_key_exists": (_log(lambda e, n: e.groupBy(F.expr("variant_get(parse_json(props), '$.k', 'int') IS NOT NULL").alias("has_k")).agg(F.count("*").alias("n"))), "SELECT json_extract(props, '$.k') IS NOT NULL AS has_k, count(*) AS n FROM events_log GROUP BY 1"),
    "p10_age_colours": (_log(lambda e, n: e.join(F.broadcast(n)).select(F.floor((F.unix_timestamp("t") - F.unix_timestamp("event_time")) / 60).alias("age")).groupBy(F.when(F.col("age").isNull() | (F.col("age") <= 15), "fresh").when(F.col("age") <= 30, "warm").otherwise("old").alias("colour")).agg(F.count("*").alias("n"))), f"SELECT CASE WHEN a <= 15 THEN 'fresh' WHEN a <= 30 THEN 'warm' ELSE 'old' END AS colour, count(*) AS n FROM (SELECT floor(({_EPOCH.format('t')} - {_EPOCH.format('event_time')}) / 60) AS a FROM events_log, as_of) GROUP BY 1"),
    "p11_null_defaults": (_log(lambda e, n: e.select("id", F.coalesce("reason", "strategy").alias("label"), F.greatest("scatter_m", "confidence").alias("most"), F.least("scatter_m", "confidence").alias("least"), F.nullif("candidate_count", F.lit(0)).alias("nonzero"))), "SELECT id, coalesce(reason, strategy) AS label, greatest(scatter_m, confidence) AS most, least(scatter_m, confidence) AS least, nullif(candidate_count, 0) AS nonzero FROM events_log"),
    "p12_optional_category_filter": (_log(lambda e, n: e.where(F.coalesce(F.when(F.col("id") % 7 > 0, F.col("layer")), F.col("reason"), F.lit("unknown")).isin("click", "unknown", "district_only")).agg(F.count("*").alias("n"))), "SELECT count(*) AS n FROM events_log WHERE coalesce(CASE WHEN id % 7 > 0 THEN layer END, reason, 'unknown') IN ('click', 'unknown', 'district_only')"),
    "p15_projections": (lambda s, d: t.places(s, d).select("id", F.element_at("names", 1).alias("canonical"), F.array_join("names", "|").alias("aliases"), F.substring(F.element_at("names", 2), 1, 5).alias("head")), "SELECT id, names[1] AS canonical, array_to_string(names, '|') AS aliases, left(names[2], 5) AS head FROM places"),
    "s06_oldest_pending": (_queue(lambda q, n: q.where("status = 'pending'").orderBy("created_at", "id").limit(20).select("id", "text")), "SELECT id, text FROM queue WHERE status = 'pending' ORDER BY created_at, id LIMIT 20"),
    "s07_projected_scan": (lambda s, d: t.places(s, d).where("lon IS NOT NULL").select("id", "type", F.size("names").alias("aliases")), "SELECT id, type, CAST(len(names) AS INT) AS aliases FROM places WHERE lon IS NOT NULL"),
    "s08_point_lookup": (_log(lambda e, n: e.where("id = 4242").select(*_SHOWN, "lon", "lat")), f"SELECT {SHOWN}, lon, lat FROM events_log WHERE id = 4242"),
    "s10_catalogue_shapes": (lambda s, d: t.table_stats(s, d).groupBy("parent").agg(F.count("*").alias("children"), F.max("relname").alias("newest")), "SELECT parent, count(*) AS children, max(relname) AS newest FROM table_stats GROUP BY 1"),
    "s11_values_relation": (lambda s, d: s.sql("SELECT * FROM VALUES ('Supplier#000000001'), ('absent') AS v(canon)").join(t.places(s, d).select(F.element_at("names", 1).alias("canon"), "id"), "canon", "left"), "SELECT canon, id FROM (VALUES ('Supplier#000000001'), ('absent')) v(canon) LEFT JOIN (SELECT names[1] AS canon, id FROM places) USING (canon)"),
    "s12_parallel_unnest": (lambda s, d: t.candidates(s, d).groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("geo_id", "score"))).alias("x")).select("msg_id", F.col("x.geo_id").alias("ids"), F.col("x.score").alias("scores")).select("msg_id", F.inline(F.arrays_zip("ids", "scores"))), "SELECT msg_id, geo_id AS ids, score AS scores FROM candidates"),
    "m01_insert_new": (_log(lambda e, n: o.insert_new(_resigned(e, 2), _twice(e), ["message_id", "event_time"], ["seq"]).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log WHERE id % 2 = 1"),
    "m02_upsert": (_log(lambda e, n: o.upsert(e.select("id", "layer"), _twice(e).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-F.col("id")).alias("id"), F.when(F.col("seq") == 0, "x").otherwise(F.col("layer")).alias("layer"), "seq"), "id", ["seq"])), "SELECT id, CASE WHEN id % 3 = 0 THEN upper(layer) ELSE layer END AS layer FROM events_log UNION ALL SELECT -id, upper(layer) FROM events_log WHERE id % 3 <> 0"),
    "m04_status_transitions": (_queue(lambda q, n: o.transitions(q, "text", "created_at")), "SELECT text, id, before, status FROM (SELECT text, id, status, lag(status) OVER (PARTITION BY text ORDER BY created_at, id) AS before FROM queue) WHERE before IS DISTINCT FROM status"),
    "m05_lease_expiry": (_queue(lambda q, n: o.requeued(q, n).groupBy("status").agg(F.count("*").alias("n"))), "SELECT CASE WHEN status = 'processing' AND locked_at < t - INTERVAL 5 MINUTE THEN 'pending' ELSE status END AS status, count(*) AS n FROM queue, as_of GROUP BY 1"),
    "m06_single_use_update": (_queue(lambda q, n: q.join(F.broadcast(n)).where("processed_at IS NULL AND status <> 'expired' AND created_at + INTERVAL 7 DAYS > t").select("id")), "SELECT id FROM queue, as_of WHERE processed_at IS NULL AND status <> 'expired' AND created_at + INTERVAL 7 DAY > t"),
    "m07_retention": (_log(o.expired_summary), "SELECT count(*) AS deleted, count(photo_url) AS files FROM events_log, as_of WHERE event_time < t - INTERVAL 60 MINUTE"),
    "m07_expired_files": (_log(o.expired_files), "SELECT DISTINCT regexp_replace(photo_url, '^.*/', '') AS name FROM events_log, as_of WHERE photo_url IS NOT NULL AND event_time < t - INTERVAL 60 MINUTE"),
    "m08_partitions_to_drop": (lambda s, d: o.partitions_to_drop(t.table_stats(s, d), t.as_of(t.events_log(s, d))), "SELECT relname FROM table_stats, as_of WHERE strptime(substring(relname, 6, 13), '%Y_%m_%d_%H') + INTERVAL 1 HOUR <= t - INTERVAL 60 MINUTE"),
    "m09_safety_drop": (lambda s, d: o.partitions_to_drop(t.table_stats(s, d), t.as_of(t.events_log(s, d)), 180), "SELECT relname FROM table_stats, as_of WHERE strptime(substring(relname, 6, 13), '%Y_%m_%d_%H') + INTERVAL 1 HOUR <= t - INTERVAL 180 MINUTE"),
    "o07_limited_json": (_log(lambda e, n: o.feature_collection(o.updates(_placed(e), after_id=7000, limit=100), ["id"])), f"SELECT '{{\"type\":\"FeatureCollection\",\"features\":[' || coalesce(string_agg(f, ',' ORDER BY id), '') || ']}}' AS geojson, CAST(count(*) AS INT) AS n FROM (SELECT id, {_FEATURE} AS f FROM events_log WHERE id > 7000 ORDER BY id LIMIT 100)"),
    "m09_partition_plan": (_log(lambda e, n: o.partition_plan(n)), "SELECT 'events_' || strftime(date_trunc('hour', t) + to_hours(i::INT), '%Y_%m_%d_%H') AS name FROM as_of, (SELECT unnest([-1, 0, 1]) AS i)"),
    "m10_queue_expiry": (_queue(o.queue_expiry), "SELECT count(*) FILTER (status = 'pending' AND (event_time < t - INTERVAL 60 MINUTE OR event_time > t + INTERVAL 5 MINUTE)) AS expired, count(*) FILTER (status IN ('done', 'error', 'expired') AND created_at < t - INTERVAL 60 MINUTE) AS purged FROM queue, as_of"),
    "m17_geometry_violations": (_log(lambda e, n: o.violations(e)), "SELECT id, v AS violation FROM (SELECT id, CASE WHEN strategy = 'street_segment' AND gtype IS DISTINCT FROM 'LINESTRING' THEN 'segment needs a line' WHEN strategy IN ('intersection', 'weighted_centroid') AND gtype IS DISTINCT FROM 'POINT' THEN 'needs a point' WHEN strategy = 'single_match' AND gtype IS NULL THEN 'needs a geometry' END AS v FROM events_log) WHERE v IS NOT NULL"),
    "m18_change_notifications": (_queue(lambda q, n: q.where("status = 'done'").join(q.where("photo_file_id IS NOT NULL").select("message_id", "event_time"), ["message_id", "event_time"], "left_semi").select("id", "photo_file_id")), "SELECT id, photo_file_id FROM queue WHERE status = 'done' AND photo_file_id IS NOT NULL"),
    "m19_value_migration": (_log(lambda e, n: e.select("id", F.regexp_replace("photo_url", "^.*/", "").alias("photo"), F.when(F.col("strategy") == "random", "fallback").otherwise(F.col("strategy")).alias("strategy"))), "SELECT id, regexp_replace(photo_url, '^.*/', '') AS photo, CASE WHEN strategy = 'random' THEN 'fallback' ELSE strategy END AS strategy FROM events_log"),
    "m20_orphan_files": (_log(lambda e, n: o.orphans(e.select(F.concat("id", F.lit(".jpg")).alias("name"), (F.col("id") % 200).alias("age_min")), e)), "SELECT concat(id, '.jpg') AS name, id % 200 AS age_min FROM events_log WHERE id % 200 > 70 AND NOT id % 6 = 0"),
    "m21_missing_attachments": (lambda s, d: t.queue(s, d).where("photo_file_id IS NOT NULL").select("message_id", "event_time", "photo_file_id").join(t.events_log(s, d).where("photo_url IS NULL").select("message_id", "event_time", "id"), ["message_id", "event_time"]).select("id", "photo_file_id"), "SELECT e.id, photo_file_id FROM queue q JOIN events_log e ON q.message_id = e.message_id AND q.event_time = e.event_time WHERE photo_file_id IS NOT NULL AND photo_url IS NULL"),
    "w05_latest_per_key": (_log(lambda e, n: o.latest(e.select("user_id", "event_time", "id", "layer"), "user_id", ["event_time", "id"]).select("user_id", "id", "layer")), "SELECT user_id, id, layer FROM events_log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) = 1"),
    "w06_repeats_within_gap": (_log(lambda e, n: o.repeats_within(e, F.when(F.length("description") >= 4, F.col("description")), "event_time").groupBy("duplicate").agg(F.count("*").alias("n"))), "SELECT coalesce(epoch(event_time) - epoch(b) <= 1800, false) AS duplicate, count(*) AS n FROM (SELECT event_time, lag(event_time) OVER (PARTITION BY description ORDER BY event_time, message_id) AS b FROM events_log) GROUP BY 1"),
    "d06_sessions": (_log(lambda e, n: e.groupBy(F.session_window("event_time", "30 minutes"), "description").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sessions"))), "SELECT n, count(*) AS sessions FROM (SELECT description, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY description ORDER BY event_time, id) AS s FROM (SELECT *, CASE WHEN epoch(event_time) - epoch(lag(event_time) OVER (PARTITION BY description ORDER BY event_time, id)) <= 1800 THEN 0 ELSE 1 END AS new FROM events_log)) GROUP BY ALL) GROUP BY 1"),
    "d05_hourly_windows": (_log(lambda e, n: e.groupBy(F.window("event_time", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "n")), "SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM events_log GROUP BY 1"),
    "d09_changes_or_resync": (lambda s, d: o.changes_after(t.events_log(s, d), _marks(s)), f"SELECT mark, count(*) AS n, max(id) AS last FROM (SELECT unnest({list(MARKS)})::BIGINT AS mark), (SELECT min(message_id) AS lo, max(message_id) AS hi FROM events_log), events_log WHERE NOT (mark > hi OR (lo > 0 AND mark < lo - 1)) AND message_id > mark GROUP BY 1"),
    "d11_subscriber_deliveries": (lambda s, d: o.deliveries(t.events_log(s, d), _subscriptions(s)).groupBy("subscriber").agg(F.count("*").alias("n")), "SELECT subscriber, count(*) AS n FROM (VALUES ('all', []::VARCHAR[]), ('clicks', ['click']), ('two', ['error', 'view']), ('none', ['absent'])) s(subscriber, layers) JOIN events_log ON len(layers) = 0 OR list_contains(layers, layer) GROUP BY 1"),
    "d14_spread_limits": (_log(lambda e, n: limits.passed_counts(e, "user_id", "event_time", "id", 3, 86400)), """, RECURSIVE ordered AS (SELECT user_id, epoch(event_time) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_time) AS rn FROM events_log),
      fold AS (SELECT user_id, rn, x AS start, 1 AS n, 1 AS passed FROM ordered WHERE rn = 1 UNION ALL
        SELECT o.user_id, o.rn, CASE WHEN x - start > 86400 THEN x ELSE start END, CASE WHEN x - start > 86400 THEN 1 ELSE n + 1 END, passed + CASE WHEN x - start > 86400 OR n + 1 <= 3 THEN 1 ELSE 0 END FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
      SELECT user_id, max(rn) AS requests, CAST(max(passed) AS BIGINT) AS passed FROM fold GROUP BY 1"""),
    "d14_fixed_window_limits": (_log(lambda e, n: m.fixed_window_limits(e, "user_id", "event_time", limit=3, window_s=86400)), """, RECURSIVE ordered AS (SELECT user_id, epoch(event_time) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_time) AS rn FROM events_log),
      fold AS (SELECT user_id, rn, x AS start, 1 AS n, 1 AS passed FROM ordered WHERE rn = 1 UNION ALL
        SELECT o.user_id, o.rn, CASE WHEN x - start > 86400 THEN x ELSE start END, CASE WHEN x - start > 86400 THEN 1 ELSE n + 1 END, passed + CASE WHEN x - start > 86400 OR n + 1 <= 3 THEN 1 ELSE 0 END FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
      SELECT user_id, max(rn) AS requests, CAST(max(passed) AS BIGINT) AS passed FROM fold GROUP BY 1"""),
    "o01_top_recent": (_log(lambda e, n: e.orderBy(F.desc("event_time"), "id").limit(50).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log ORDER BY event_time DESC, id LIMIT 50"),
    "o08_nearest_first": (_log(lambda e, n: e.where("gtype = 'POINT'").withColumn("far", F.pow(F.col("lon") - 30.5, 2) + F.pow(F.col("lat") - 46.5, 2)).orderBy("far", "id").limit(100).select("id", F.row_number().over(o.Window.orderBy("far", "id")).alias("place"))), "SELECT id, CAST(row_number() OVER (ORDER BY pow(lon - 30.5, 2) + pow(lat - 46.5, 2), id) AS INT) AS place FROM events_log WHERE gtype = 'POINT' QUALIFY place <= 100"),
    "o10_chunks": (_log(lambda e, n: o.numbered(e.select("id"), ["id"], "place").groupBy(F.floor(F.col("place") / 200).alias("chunk")).agg(F.count("*").alias("n"), F.min("id").alias("first"))), "SELECT CAST(floor((rn - 1) / 200) AS BIGINT) AS chunk, count(*) AS n, min(id) AS first FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM events_log) GROUP BY 1"),
    "o11_capped_store": (_log(lambda e, n: o.capped(e).select("id")), "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY event_time DESC, id DESC) AS rn, count(*) OVER () AS n FROM events_log) WHERE n <= 5000 OR rn <= 4500"),
    "u05_incremental_diff": (_log(lambda e, n: o.difference(e, _wanted(e), "id", "layer")), f"SELECT id, CASE WHEN a.layer IS NULL THEN 'added' WHEN b.layer IS NULL THEN 'removed' ELSE 'updated' END AS change FROM events_log a FULL JOIN ({_H}) b USING (id) WHERE a.layer IS DISTINCT FROM b.layer"),
    "u03_array_sets": (lambda s, d: t.training(s, d).select("event_id", F.array_sort(F.array_union("correct_geo_ids", "detected_geo_ids")).alias("all_ids"), F.arrays_overlap("correct_geo_ids", "detected_geo_ids").alias("overlap"), F.size(F.array_except("detected_geo_ids", "correct_geo_ids")).alias("extra"), F.array_contains("detected_geo_ids", 3).alias("has3"), F.array_repeat(F.lit(1.0), F.size("detected_geo_ids")).alias("ones")), "SELECT event_id, list_sort(list_distinct(list_concat(correct_geo_ids, detected_geo_ids))) AS all_ids, list_has_any(correct_geo_ids, detected_geo_ids) AS overlap, CAST(len(list_filter(list_distinct(detected_geo_ids), lambda x: NOT list_contains(correct_geo_ids, x))) AS INT) AS extra, list_contains(detected_geo_ids, 3) AS has3, list_transform(detected_geo_ids, lambda x: 1.0::DOUBLE) AS ones FROM training"),
    "e01_filtered_events": (_log(lambda e, n: o.recent(e, n, 60, layers=["click", "view", "error"]).select(*_SHOWN, "lon", "lat")), f"SELECT {SHOWN}, lon, lat FROM events_log, as_of WHERE event_time >= t - INTERVAL 60 MINUTE AND layer IN ('click', 'view', 'error')"),
    "e02_incremental_events": (_log(lambda e, n: o.recent(e, n, 2880, since="2024-01-29 12:00:00", inclusive=True).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log, as_of WHERE event_time >= t - INTERVAL 2880 MINUTE AND event_time >= TIMESTAMP '2024-01-29 12:00:00'"),
    "e03_updates_by_id": (_log(lambda e, n: o.updates(e, after_id=7000, limit=100).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log WHERE id > 7000 ORDER BY id LIMIT 100"),
    "e04_snapshot": (_log(lambda e, n: o.recent(e, n, 60).orderBy("id").limit(5000).select(*_SHOWN)), f"SELECT {SHOWN} FROM events_log, as_of WHERE event_time >= t - INTERVAL 60 MINUTE ORDER BY id LIMIT 5000"),
    "e05_latest_time": (_log(lambda e, n: n.select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("latest"))), "SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS latest FROM as_of"),
    "e06_log_meta": (_log(lambda e, n: e.agg(F.count("*").alias("version"), F.coalesce(F.max("id"), F.lit(0)).alias("max_event_id"))), "SELECT count(*) AS version, coalesce(max(id), 0) AS max_event_id FROM events_log"),
    "e07_id_ranges": (_log(lambda e, n: e.where("id > 100").agg(F.coalesce(F.min("id"), F.lit(0)).alias("min_id"), F.coalesce(F.min("message_id"), F.lit(0)).alias("min_message"), F.coalesce(F.max("message_id"), F.lit(0)).alias("max_message"))), "SELECT coalesce(min(id), 0) AS min_id, coalesce(min(message_id), 0) AS min_message, coalesce(max(message_id), 0) AS max_message FROM events_log WHERE id > 100"),
    "e09_dictionary_count": (lambda s, d: t.places(s, d).groupBy("type").agg(F.count("*").alias("n")), "SELECT type, count(*) AS n FROM places GROUP BY 1"),
    "e10_staleness": (_log(lambda e, n: o.staleness(n, e)), f"SELECT CAST(floor(a / 60) AS BIGINT) AS minutes_ago, a > 300 AS stale FROM (SELECT {_EPOCH.format('max(t)')} - {_EPOCH.format('max(event_time)')} AS a FROM events_log, as_of WHERE strategy <> 'random')"),
    "e11_queue_depth": (_queue(lambda q, n: q.agg(F.count_if(F.col("status") == "pending").alias("pending"))), "SELECT count(*) FILTER (status = 'pending') AS pending FROM queue"),
    "e12_client_aggregates": (_log(lambda e, n: e.agg(F.max("id").alias("max_id"), F.max(F.coalesce(F.when(F.col("id") % 9 > 0, F.col("message_id")), F.col("id"))).alias("max_message"), F.count("*").alias("n"))), "SELECT max(id) AS max_id, max(coalesce(CASE WHEN id % 9 > 0 THEN message_id END, id)) AS max_message, count(*) AS n FROM events_log"),
    "a20_histogram_buckets": (_log(lambda e, n: e.agg(*(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (1, 5, 10, 25, 50, 100, 250)), F.count("*").alias("le_inf"))), f"SELECT {', '.join(f'count(*) FILTER (value <= {b}) AS le_{b}' for b in (1, 5, 10, 25, 50, 100, 250))}, count(*) AS le_inf FROM events_log"),
    "a13_weighted_mean": (_log(lambda e, n: e.groupBy("layer").agg(rounded(F.sum(F.col("lon") * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("lon"), rounded(F.sum(F.col("lat") * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("lat"))), f"SELECT layer, {r3('sum(lon * confidence) / nullif(sum(confidence), 0)')} AS lon, {r3('sum(lat * confidence) / nullif(sum(confidence), 0)')} AS lat FROM events_log GROUP BY 1"),
    "a08_ordered_arrays": (lambda s, d: t.candidates(s, d).groupBy("msg_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "geo_id", "text"))).alias("x")).select("msg_id", F.col("x.geo_id").alias("ids"), F.transform("x.s", lambda v: -v).alias("scores"), F.col("x.text").alias("texts")), "SELECT msg_id, list(geo_id ORDER BY score DESC, geo_id, text) AS ids, list(score ORDER BY score DESC, geo_id, text) AS scores, list(text ORDER BY score DESC, geo_id, text) AS texts FROM candidates GROUP BY 1"),
    "w04_first_per_group": (lambda s, d: t.candidates(s, d).withColumn("rn", F.row_number().over(o.Window.partitionBy("msg_id", "geo_id").orderBy(F.desc("score"), "text"))).where("rn = 1").select("msg_id", "geo_id", "score", "text"), "SELECT msg_id, geo_id, score, text FROM candidates QUALIFY row_number() OVER (PARTITION BY msg_id, geo_id ORDER BY score DESC, text) = 1"),
    "o02_top_candidates": (lambda s, d: t.candidates(s, d).withColumn("rn", F.row_number().over(o.Window.partitionBy("msg_id").orderBy(F.desc("score"), "geo_id", "text"))).where("rn <= 2").select("msg_id", "geo_id", "score"), "SELECT msg_id, geo_id, score FROM candidates QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, geo_id, text) <= 2"),
    "j01_dictionary_join": (lambda s, d: t.candidates(s, d).join(t.places(s, d).select(F.col("id").alias("geo_id"), "type"), "geo_id").groupBy("type").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("avg_score")), f"SELECT type, count(*) AS n, {r3('avg(score)')} AS avg_score FROM candidates JOIN places ON geo_id = id GROUP BY 1"),
    "j12_unlabelled_events": (lambda s, d: t.events_log(s, d).join(t.read(s, d, "labels").where("doc_id IS NOT NULL").selectExpr("doc_id AS id"), "id", "left_anti").agg(F.count("*").alias("n"), F.min("id").alias("first")), "SELECT count(*) AS n, min(id) AS first FROM events_log WHERE id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"),
    "j13_semi_join": (lambda s, d: t.events_log(s, d).join(t.read(s, d, "labels").where("toxic = 1").selectExpr("doc_id AS id"), "id", "left_semi").select("id", "layer"), "SELECT id, layer FROM events_log WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "j03_singleton_join": (_log(lambda e, n: e.join(e.where("strategy = 'absent'").agg(F.max("id").alias("best")).where("best IS NOT NULL"), F.lit(True), "left").agg(F.count("*").alias("n"), F.count("best").alias("with_best"))), "SELECT count(*) AS n, count(best) AS with_best FROM events_log LEFT JOIN (SELECT best FROM (SELECT max(id) AS best FROM events_log WHERE strategy = 'absent') WHERE best IS NOT NULL) ON true"),
    "j08_lateral": (lambda s, d: t.places(s, d).alias("p").lateralJoin(s.range(1).select(F.length(F.col("p.names").outer()[0]).alias("alias_length"))).groupBy("type", "alias_length").agg(F.count("*").alias("n")), "SELECT type, CAST(length(names[1]) AS INT) AS alias_length, count(*) AS n FROM places GROUP BY ALL"),
    "e08_one_feature": (_log(lambda e, n: o.features(_placed(e.where("id = 4242")))), f"SELECT id, {_FEATURE} AS geojson FROM events_log WHERE id = 4242"),
    "e08_features": (_log(lambda e, n: o.features(_placed(e))), f"SELECT id, {_FEATURE} AS geojson FROM events_log"),
    "e08_feature_collection": (_log(lambda e, n: o.feature_collection(o.recent(_placed(e), n, 60), ["event_time", "id"])), f"SELECT '{{\"type\":\"FeatureCollection\",\"features\":[' || coalesce(string_agg(f, ',' ORDER BY event_time, id), '') || ']}}' AS geojson, CAST(count(*) AS INT) AS n FROM (SELECT event_time, id, {_FEATURE} AS f FROM events_log, as_of WHERE event_time >= t - INTERVAL 60 MINUTE ORDER BY event_time, id LIMIT 5000)"),
    "j16_catalogue_children": (lambda s, d: t.table_stats(s, d).alias("c").join(t.table_stats(s, d).groupBy("parent").agg(F.min("relid").alias("first")).alias("p"), "parent").join(t.table_stats(s, d).selectExpr("relid AS first", "relname AS first_name"), "first").groupBy("parent", "first_name").agg(F.count("*").alias("children")), "SELECT c.parent, f.relname AS first_name, count(*) AS children FROM table_stats c JOIN (SELECT parent, min(relid) AS first FROM table_stats GROUP BY 1) p ON c.parent = p.parent JOIN table_stats f ON f.relid = p.first GROUP BY ALL"),
    "f05_json_scalars": (_log(lambda e, n: e.select("id", F.get_json_object("props", "$.k").cast("double").alias("k"), F.expr("json_array_length(concat('[', k, ',', id, ']'))").alias("items"), F.expr("schema_of_variant(parse_json(props)) LIKE 'OBJECT%'").alias("is_object"))), "SELECT id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_array_length(concat('[', k, ',', id, ']')) AS INT) AS items, json_type(props) = 'OBJECT' AS is_object FROM events_log"),
    "f07_content_hash": (_log(lambda e, n: o.content_hash(e, "layer", "id")), f"SELECT layer, md5(string_agg(h, ',' ORDER BY o)) AS etag FROM (SELECT layer, floor(o / 4096) AS o, md5(string_agg(h, ',' ORDER BY o)) AS h FROM (SELECT layer, floor(o / 4096) AS o, md5(string_agg(h, ',' ORDER BY o)) AS h FROM (SELECT layer, floor(id / 4096) AS o, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS h FROM events_log GROUP BY ALL) GROUP BY layer, floor(o / 4096)) GROUP BY layer, floor(o / 4096)) GROUP BY layer"),
    "f02_time_functions": (_log(lambda e, n: e.select("id", F.date_format("event_time", "yyyy_MM_dd_HH").alias("slot"), F.date_format(F.from_utc_timestamp("event_time", "Europe/Paris"), "yyyy-MM-dd HH:mm:ss").alias("local"), F.dayofweek("event_time").alias("dow"))), "SELECT id, strftime(event_time, '%Y_%m_%d_%H') AS slot, strftime((event_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris', '%Y-%m-%d %H:%M:%S') AS local, CAST(dayofweek(event_time) + 1 AS INT) AS dow FROM events_log"),
}


QUERIES = {k: f for k, (f, _) in _all.items()}
_CTE = f"{t.QUEUE}, {t.PLACES}, {t.TABLE_STATS}, {t.TRAINING.removeprefix(t.EVENTS_LOG).lstrip(',')}, {t.CANDIDATES.removeprefix(t.PLACES).lstrip(',')}"
ORACLE_SQL = {k: f"WITH RECURSIVE {_CTE} {sql.replace(', RECURSIVE ', ', ', 1)}" for k, (_, sql) in _all.items()}
