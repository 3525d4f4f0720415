"""Logical tables over the driver's Parquet files, each with its DuckDB twin as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import spread

#: Minutes that an event lives, and that one may lie in the future.
TTL_MINUTES, FUTURE_MINUTES = 60, 5
STRATEGIES = ("random", "single_match", "intersection", "street_segment", "weighted_centroid")
PLACE_TYPES = ("street", "village", "station", "park", "market", "district")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their time as an instant. In UTC it is read as one, so that bounds of time reach the scan; a cast would keep them off."""
    e = read(spark, sf_dir, "events")
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC") or e.schema["ts"].dataType != T.TimestampNTZType():
        return e.withColumn("ts", F.col("ts").cast("timestamp"))
    fields = [T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in e.schema]
    return spark.read.schema(T.StructType(fields)).parquet(f"{sf_dir}/events.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The located-event log: one row per event with category, strategy, confidence, diagnostics and a point."""
    e = events(spark, sf_dir)
    names = ", ".join(f"'{s}'" for s in STRATEGIES)
    return e.selectExpr(
        "event_id AS id", "event_id AS message_id", "ts AS event_time", "event_type AS layer", "concat(event_type, ' ', user_id) AS description",
        "CAST(get_json_object(props, '$.k') AS INT) AS k", "user_id", "value", "event_type", "props",
    ).selectExpr(
        "*", "CAST(k AS DOUBLE) / 100 AS confidence", f"element_at(array({names}), CAST(id % 5 + 1 AS INT)) AS strategy", "CAST(id % 4 AS INT) AS candidate_count",
        "CASE id % 3 WHEN 0 THEN 'no_candidates' WHEN 1 THEN 'district_only' END AS reason", "CASE WHEN id % 3 = 2 THEN CAST(k AS DOUBLE) * 7 END AS scatter_m",
        "CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN NULL WHEN id % 5 = 3 THEN 'LINESTRING' ELSE 'POINT' END AS gtype",
        "CASE WHEN id % 6 = 0 THEN concat('/media/', id, '.jpg') END AS photo_url", "30 + CAST(id % 997 AS DOUBLE) / 997 AS lon", "46 + CAST(id % 991 AS DOUBLE) / 991 AS lat",
    )


EVENTS_LOG = """events_log AS (SELECT *, CAST(k AS DOUBLE) / 100 AS confidence,
  list_extract(['random','single_match','intersection','street_segment','weighted_centroid'], CAST(id % 5 + 1 AS INT)) AS strategy, CAST(id % 4 AS INT) AS candidate_count,
  CASE id % 3 WHEN 0 THEN 'no_candidates' WHEN 1 THEN 'district_only' END AS reason, CASE WHEN id % 3 = 2 THEN CAST(k AS DOUBLE) * 7 END AS scatter_m,
  CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN NULL WHEN id % 5 = 3 THEN 'LINESTRING' ELSE 'POINT' END AS gtype,
  CASE WHEN id % 6 = 0 THEN concat('/media/', id, '.jpg') END AS photo_url, 30 + CAST(id % 997 AS DOUBLE) / 997 AS lon, 46 + CAST(id % 991 AS DOUBLE) / 991 AS lat
  FROM (SELECT event_id AS id, event_id AS message_id, ts AS event_time, event_type AS layer, concat(event_type, ' ', user_id) AS description,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id, value, event_type, props FROM events)),
 as_of AS (SELECT max(ts) AS t FROM events)"""


def as_of(events: DataFrame, column: str = "event_time") -> DataFrame:
    """A one-row table with the newest time, which stands for the present in every time-relative operator."""
    return events.agg(F.max(column).alias("t"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work queue: a row per message with status, lease and file columns."""
    return events_log(spark, sf_dir).selectExpr(
        "id", "message_id", "description AS text", "event_time", "element_at(array('pending', 'processing', 'done', 'error', 'expired'), CAST(id % 5 + 1 AS INT)) AS status",
        "event_time + make_interval(0, 0, 0, 0, 0, CAST(id % 7 AS INT), 0) AS created_at", "CASE WHEN id % 5 = 1 THEN event_time + make_interval(0, 0, 0, 0, 0, CAST(id % 10 AS INT), 0) END AS locked_at",
        "CASE WHEN id % 5 IN (2, 3) THEN event_time + make_interval(0, 0, 0, 0, 0, CAST(id % 90 AS INT), 0) END AS processed_at", "CASE WHEN id % 4 = 0 THEN concat('file', id) END AS photo_file_id",
    )


QUEUE = (
    EVENTS_LOG
    + """,
 queue AS (SELECT id, message_id, description AS text, event_time, list_extract(['pending','processing','done','error','expired'], CAST(id % 5 + 1 AS INT)) AS status,
  event_time + to_minutes(CAST(id % 7 AS INT)) AS created_at, CASE WHEN id % 5 = 1 THEN event_time + to_minutes(CAST(id % 10 AS INT)) END AS locked_at,
  CASE WHEN id % 5 IN (2, 3) THEN event_time + to_minutes(CAST(id % 90 AS INT)) END AS processed_at, CASE WHEN id % 4 = 0 THEN concat('file', id) END AS photo_file_id FROM events_log)"""
)


def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement statistics: one row per order as a statement, with calls, times, rows and block counts."""
    o = read(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderkey AS queryid", "concat(CASE o_orderkey % 3 WHEN 0 THEN 'SELECT ' WHEN 1 THEN 'INSERT ' ELSE 'UPDATE ' END, o_orderpriority) AS query", "o_orderkey % 40 AS calls",
        "CAST(o_custkey % 1000 AS DOUBLE) AS mean_exec_time", "CAST(o_custkey % 1000 AS DOUBLE) * (o_orderkey % 40) AS total_exec_time", "CAST(o_custkey % 50 AS DOUBLE) AS stddev_exec_time",
        "CAST(o_custkey % 7 AS DOUBLE) AS min_exec_time", "CAST(o_custkey % 1000 AS DOUBLE) * 3 AS max_exec_time", "o_orderkey % 11 AS rows", "o_custkey % 900 AS shared_blks_hit",
        "o_custkey % 100 AS shared_blks_read", "o_orderkey % 5 AS temp_blks_written", "o_orderkey % 64 AS pid", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 20 END AS locked_rel", "o_orderstatus = 'F' AS granted",
    )


QUERY_STATS = """query_stats AS (SELECT o_orderkey AS queryid, concat(CASE o_orderkey % 3 WHEN 0 THEN 'SELECT ' WHEN 1 THEN 'INSERT ' ELSE 'UPDATE ' END, o_orderpriority) AS query, o_orderkey % 40 AS calls,
  CAST(o_custkey % 1000 AS DOUBLE) AS mean_exec_time, CAST(o_custkey % 1000 AS DOUBLE) * (o_orderkey % 40) AS total_exec_time, CAST(o_custkey % 50 AS DOUBLE) AS stddev_exec_time,
  CAST(o_custkey % 7 AS DOUBLE) AS min_exec_time, CAST(o_custkey % 1000 AS DOUBLE) * 3 AS max_exec_time, o_orderkey % 11 AS rows, o_custkey % 900 AS shared_blks_hit,
  o_custkey % 100 AS shared_blks_read, o_orderkey % 5 AS temp_blks_written, o_orderkey % 64 AS pid, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 20 END AS locked_rel, o_orderstatus = 'F' AS granted FROM orders)"""


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage statistics: a row per part as a partition of a table named after its brand."""
    p = read(spark, sf_dir, "part")
    return p.selectExpr(
        "p_partkey AS relid", "p_brand AS parent", "concat('part_', date_format(timestamp_seconds(1704067200 + p_partkey * 3600), 'yyyy_MM_dd_HH')) AS relname", "p_partkey % 1000 AS live_rows",
        "p_partkey % 130 AS dead_rows", "p_partkey * 8192 % 50000000 AS bytes", "p_partkey % 17 AS seq_scan", "p_partkey % 23 AS idx_scan", "p_partkey % 31 AS n_ins", "p_partkey % 37 AS n_upd", "p_partkey % 41 AS n_del", "p_size AS page_reads",
    )


TABLE_STATS = """table_stats AS (SELECT p_partkey AS relid, p_brand AS parent, concat('part_', strftime(make_timestamp((1704067200 + p_partkey * 3600) * 1000000), '%Y_%m_%d_%H')) AS relname, p_partkey % 1000 AS live_rows,
  p_partkey % 130 AS dead_rows, p_partkey * 8192 % 50000000 AS bytes, p_partkey % 17 AS seq_scan, p_partkey % 23 AS idx_scan, p_partkey % 31 AS n_ins, p_partkey % 37 AS n_upd, p_partkey % 41 AS n_del, p_size AS page_reads FROM part)"""


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples: labels over the event log, which carry the right and the detected category."""
    e = events_log(spark, sf_dir)
    lab = read(spark, sf_dir, "labels")
    return lab.join(e, lab.doc_id == e.id).selectExpr(
        "id AS event_id", "description AS text", "layer AS detected_layer", "CASE WHEN quality = 1 THEN layer ELSE 'other' END AS correct_layer", "strategy AS detected_strategy",
        "confidence AS detected_confidence", "toxic = 1 AS is_promotional", "candidate_count > 0 AS has_geo_reference", "array(CAST(id % 7 AS INT), CAST(id % 5 AS INT)) AS detected_geo_ids", "array(CAST(id % 7 AS INT)) AS correct_geo_ids",
    )


TRAINING = (
    EVENTS_LOG
    + """,
 training AS (SELECT id AS event_id, description AS text, layer AS detected_layer, CASE WHEN quality = 1 THEN layer ELSE 'other' END AS correct_layer, strategy AS detected_strategy,
  confidence AS detected_confidence, toxic = 1 AS is_promotional, candidate_count > 0 AS has_geo_reference, [CAST(id % 7 AS INT), CAST(id % 5 AS INT)] AS detected_geo_ids, [CAST(id % 7 AS INT)] AS correct_geo_ids
  FROM labels JOIN events_log ON labels.doc_id = events_log.id)"""
)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place dictionary: id, aliases (the first is canonical), type, point in degrees and metres. Few bytes, so that they are dealt out over all cores."""
    s = read(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS id", "s_name AS name")
    c = read(spark, sf_dir, "customer").selectExpr("CAST(c_custkey + 100000 AS BIGINT) AS id", "c_name AS name")
    types = ", ".join(f"'{t}'" for t in PLACE_TYPES)
    return spread(s.union(c), "id").selectExpr(
        "id", "array(name, lower(name), concat('at ', lower(name))) AS names", f"element_at(array({types}), CAST(id % 6 + 1 AS INT)) AS type",
        "30 + CAST(id % 997 AS DOUBLE) / 997 AS lon", "46 + CAST(id % 991 AS DOUBLE) / 991 AS lat",
    ).selectExpr("*", "lon * 20037508.342789244D / 180 AS mx", "ln(tan((90 + lat) * pi() / 360)) * 6378137 AS my")


PLACES = """places AS (SELECT *, lon * 20037508.342789244::DOUBLE / 180 AS mx, ln(tan((90 + lat) * pi() / 360)) * 6378137 AS my FROM (
  SELECT id, [name, lower(name), concat('at ', lower(name))] AS names, list_extract(['street','village','station','park','market','district'], CAST(id % 6 + 1 AS INT)) AS type,
   30 + CAST(id % 997 AS DOUBLE) / 997 AS lon, 46 + CAST(id % 991 AS DOUBLE) / 991 AS lat
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier UNION ALL SELECT CAST(c_custkey + 100000 AS BIGINT), c_name FROM customer)))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to five scored place candidates for each message (an order); the fifth part of messages has none."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 5 > 0")
    # all later work is by message
    n = spread(o.selectExpr("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("o_orderkey AS msg_id", "explode(sequence(1, CAST(o_orderkey % 5 AS INT))) AS i", "o_custkey AS base")
    return n.selectExpr("msg_id", "100001 + (base + i * (msg_id % 3)) % 1500 AS geo_id", "0.75D + CAST((msg_id * 7 + i * 5) % 25 AS DOUBLE) / 100 AS score", "concat('text ', i) AS text")


CANDIDATES = (
    PLACES
    + """,
 candidates AS (SELECT msg_id, 100001 + (base + i * (msg_id % 3)) % 1500 AS geo_id, 0.75::DOUBLE + CAST((msg_id * 7 + i * 5) % 25 AS DOUBLE) / 100 AS score, concat('text ', i) AS text
  FROM (SELECT o_orderkey AS msg_id, unnest(range(1, CAST(o_orderkey % 5 AS INT) + 1)) AS i, o_custkey AS base FROM orders WHERE o_orderkey % 5 > 0))"""
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text messages: turns of conversations, some with a marker, a link or a number."""
    return read(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS message_id", "conv_id", "turn", "role", "text")


MESSAGES = "messages AS (SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text FROM conversations)"
