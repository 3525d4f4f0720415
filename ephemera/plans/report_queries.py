"""Report queries over the driver tables, with their DuckDB twins."""

from __future__ import annotations

from ..operators import reports as r
from ..sources import tables as t

R3, R2 = "floor(({}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE", "floor(({}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"
HOUR = "strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M')"
BUCKET = "CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.95 THEN 'very_high' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END"


def r3(x: str) -> str:
    return R3.format(f"CAST({x} AS DOUBLE)")


def r2(x: str) -> str:
    return R2.format(f"CAST({x} AS DOUBLE)")


def pct(a: str, b: str) -> str:
    return R2.format(f"CAST({a} AS DOUBLE) * 100 / nullif(CAST({b} AS DOUBLE), 0)")


def size(b: str) -> str:
    part = lambda p, n: f"concat(CAST(CAST(floor(CAST({b} AS DOUBLE) / {1024**p} + 0.5) AS BIGINT) AS VARCHAR), ' {n}')"
    return f"CASE WHEN {b} < 10240 THEN concat({b}, ' bytes') WHEN {b} < {10240 * 1024} THEN {part(1, 'kB')} WHEN {b} < {10240 * 1024**2} THEN {part(2, 'MB')} ELSE {part(3, 'GB')} END"


STATS = f"{r3('avg(confidence)')} AS avg_confidence, {r3('min(confidence)')} AS min_confidence, {r3('max(confidence)')} AS max_confidence"
SUM = "CAST(sum({0}) AS BIGINT) AS {0}"

_events = {
    "qr1_quality_summary": (r.quality_summary, f"""SELECT strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS total, count(*) FILTER (strategy <> 'random') AS located, count(*) FILTER (gtype IS NULL) AS without_geometry, {pct("count(*) FILTER (strategy <> 'random')", "count(*)")} AS located_pct,
      {r3("avg(confidence) FILTER (strategy <> 'random')")} AS avg_confidence, {r3("min(confidence)")} AS min_confidence, {r3("max(confidence)")} AS max_confidence FROM events_log, as_of WHERE event_time >= t - INTERVAL 60 MINUTE"""),
    "qr2_strategy_by_geometry": (r.strategy_by_geometry, f"SELECT strategy, coalesce(gtype, 'NONE') AS gtype, count(*) AS n, {r3('avg(confidence)')} AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM events_log GROUP BY ALL"),
    "qr3_fallback_reasons": (r.fallback_reasons, f"SELECT coalesce(reason, 'unknown') AS reason, count(*) AS n, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM events_log, as_of WHERE strategy = 'random' AND event_time >= t - INTERVAL 60 MINUTE GROUP BY 1"),
    "qr4_unresolved_recent": (r.unresolved, f"SELECT id, {HOUR} AS hour, left(description, 120) AS description, layer, reason FROM events_log WHERE strategy = 'random' ORDER BY event_time DESC, id LIMIT 50"),
    "qr5_invariants": (r.invariants, """SELECT count(*) FILTER (strategy <> 'random' AND gtype IS NULL) AS located_without_geometry, count(*) FILTER (strategy = 'street_segment' AND coalesce(gtype, '') <> 'LINESTRING') AS segment_not_line,
      count(*) FILTER (NOT confidence BETWEEN 0 AND 1) AS confidence_out_of_range, count(*) FILTER (length(description) > 500) AS description_too_long,
      count(*) FILTER (strategy NOT IN ('random', 'single_match', 'intersection', 'street_segment', 'weighted_centroid')) AS unknown_strategy, count(*) FILTER (strategy <> 'random' AND candidate_count = 0) AS matched_without_candidates FROM events_log"""),
    "qr6_duplicate_ids": (lambda e: r.duplicate_ids(e, "user_id"), "SELECT user_id, count(*) AS n, count(DISTINCT event_time) AS times FROM events_log GROUP BY user_id HAVING count(*) > 1"),
    "qb1_strategy_distribution": (lambda e: r.distribution(e, "strategy"), f"SELECT strategy, count(*) AS n, {STATS}, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM events_log GROUP BY strategy"),
    "qb2_category_distribution": (lambda e: r.share_of_total(e, "layer"), f"SELECT layer, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM events_log)')} AS pct FROM events_log GROUP BY layer"),
    "qb3_confidence_buckets": (r.confidence_buckets, f"SELECT {BUCKET} AS bucket, count(*) AS n, row_number() OVER (ORDER BY min(confidence)) AS rank FROM events_log GROUP BY 1"),
    "qb4_candidate_counts": (r.candidate_counts, "SELECT candidate_count, count(*) AS n FROM events_log GROUP BY 1"),
    "qb5_daily_volume": (r.daily_volume, f"SELECT strftime(event_time, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CASE WHEN strategy = 'random' THEN 1 ELSE 0 END) AS BIGINT) AS fallback, {pct('sum(CASE WHEN strategy = $$random$$ THEN 1 ELSE 0 END)', 'count(*)')} AS fallback_pct FROM events_log GROUP BY 1"),
    "qb6_category_by_strategy": (r.cross_table, f"SELECT layer, strategy, count(*) AS n, {r3('avg(confidence)')} AS avg_confidence FROM events_log GROUP BY ALL"),
    "qb7_low_confidence": (r.low_confidence, "SELECT id, layer, strategy, confidence FROM events_log WHERE confidence < 0.5 AND strategy <> 'random' ORDER BY confidence, id LIMIT 100"),
    "qb8_fallback_share": (r.fallback_share, f"SELECT count(*) FILTER (strategy = 'random') AS fallback, count(*) AS total, {pct('count(*) FILTER (strategy = $$random$$)', 'count(*)')} AS pct FROM events_log"),
    "qb9_guard_count": (r.guard_count, "SELECT count(*) FILTER (list_contains(json_keys(props), 'anti_list')) AS guarded, count(*) FILTER (list_contains(json_keys(props), 'k')) AS with_k, count(*) AS total FROM events_log"),
    "qb10_match_rate": (r.match_rate, f"SELECT layer, count(*) AS n, count(*) FILTER (candidate_count > 0) AS matched, {pct('count(*) FILTER (candidate_count > 0)', 'count(*)')} AS match_pct FROM events_log GROUP BY layer"),
    "qm17_low_confidence_alert": (r.low_confidence_alert, f"SELECT {HOUR} AS hour, count(*) AS n, {r3('avg(confidence)')} AS avg_confidence, {r3('avg(scatter_m)')} AS avg_scatter FROM events_log WHERE confidence < 0.5 GROUP BY 1 HAVING count(*) > 1"),
    "qm18_strategy_share_by_hour": (r.strategy_share_by_hour, f"SELECT {HOUR} AS hour, strategy, count(*) AS n, {pct('count(*)', f'sum(count(*)) OVER (PARTITION BY {HOUR})')} AS pct FROM events_log GROUP BY 1, 2"),
    "qm19_bucket_share_by_strategy": (r.bucket_share_by_strategy, f"SELECT strategy, bucket, n, {pct('n', 'sum(n) OVER (PARTITION BY strategy)')} AS pct FROM (SELECT strategy, {BUCKET} AS bucket, count(*) AS n FROM events_log GROUP BY ALL)"),
    "qm20_hypothesis_rate": (r.hypothesis_rate, f"SELECT strategy, n, avg_k, {pct('n', 'sum(n) OVER ()')} AS pct FROM (SELECT strategy, count(*) AS n, {r3('avg(k)')} AS avg_k FROM events_log WHERE list_contains(json_keys(props), 'k') GROUP BY strategy)"),
}

_stats = {
    "qm1_slowest_statements": (r.slowest, f"SELECT queryid, left(query, 100) AS query, calls, {r2('mean_exec_time')} AS mean_ms, {pct('total_exec_time', 'sum(total_exec_time) OVER ()')} AS pct FROM query_stats ORDER BY mean_ms DESC, queryid LIMIT 20"),
    "qm2_frequent_statements": (r.frequent, "SELECT queryid, query, calls, total_exec_time, rows / nullif(calls, 0) AS rows_per_call FROM query_stats ORDER BY calls DESC, total_exec_time DESC, queryid LIMIT 20"),
    "qm5_lock_graph": (r.lock_graph, "SELECT w.pid AS waiting, h.pid AS holding, count(*) AS locks FROM query_stats w JOIN query_stats h ON w.locked_rel IS NOT DISTINCT FROM h.locked_rel AND w.rows IS NOT DISTINCT FROM h.rows AND w.shared_blks_read IS NOT DISTINCT FROM h.shared_blks_read AND w.pid <> h.pid WHERE NOT w.granted AND h.granted GROUP BY ALL"),
    "qm13_temp_files": (r.temp_files, "SELECT query, CAST(sum(temp_blks_written) AS BIGINT) AS blocks, count(*) AS n FROM query_stats WHERE temp_blks_written > 0 GROUP BY query"),
    "qm16_statement_timing": (r.statement_timing, f"SELECT regexp_replace(query, '^[A-Z]+ ', '') AS name, CAST(sum(calls) AS BIGINT) AS calls, {r2('sum(total_exec_time) / nullif(sum(calls), 0)')} AS mean_ms, max(max_exec_time) AS max_ms FROM query_stats WHERE query LIKE 'SELECT%' AND query NOT LIKE '%URGENT%' GROUP BY 1"),
    "qs1_slow_statement_view": (lambda s: r.slowest(s.where("mean_exec_time > 100"), 50), f"SELECT queryid, left(query, 100) AS query, calls, {r2('mean_exec_time')} AS mean_ms, {pct('total_exec_time', 'sum(total_exec_time) OVER ()')} AS pct FROM query_stats WHERE mean_exec_time > 100 ORDER BY mean_ms DESC, queryid LIMIT 50"),
    "qs2_statements_by_share": (r.statements_by_share, f"SELECT query, calls, total_ms, rows, {pct('total_ms', 'sum(total_ms) OVER ()')} AS pct FROM (SELECT query, CAST(sum(calls) AS BIGINT) AS calls, sum(total_exec_time) AS total_ms, CAST(sum(rows) AS BIGINT) AS rows FROM query_stats GROUP BY query HAVING sum(calls) > 10)"),
    "qs6_lock_waits": (lambda s: r.lock_graph(s).where("locks > 1"), "SELECT w.pid AS waiting, h.pid AS holding, count(*) AS locks FROM query_stats w JOIN query_stats h ON w.locked_rel IS NOT DISTINCT FROM h.locked_rel AND w.rows IS NOT DISTINCT FROM h.rows AND w.shared_blks_read IS NOT DISTINCT FROM h.shared_blks_read AND w.pid <> h.pid WHERE NOT w.granted AND h.granted GROUP BY ALL HAVING count(*) > 1"),
}

_tables = {
    "qr7_partition_sizes": (r.partition_sizes, f"SELECT relname, bytes, {size('bytes')} AS size, live_rows FROM table_stats ORDER BY bytes DESC, relname LIMIT 20"),
    "qm6_bloat": (r.bloat, f"SELECT relname, live_rows, dead_rows, {pct('dead_rows', 'live_rows + dead_rows')} AS dead_pct FROM table_stats WHERE dead_rows > 100 ORDER BY dead_rows DESC, relname LIMIT 20"),
    "qm7_unused_indexes": (r.unused_indexes, f"SELECT relname, {size('bytes')} AS size FROM table_stats WHERE idx_scan = 0"),
    "qm9_partition_stats": (r.partition_stats, f"SELECT parent, count(*) AS partitions, {', '.join(SUM.format(c) for c in ('live_rows', 'dead_rows', 'bytes'))} FROM table_stats GROUP BY parent"),
    "qm10_table_sizes": (r.table_sizes, f"SELECT parent, bytes, {size('bytes')} AS size FROM (SELECT parent, CAST(sum(bytes) AS BIGINT) AS bytes FROM table_stats GROUP BY parent)"),
    "qm12_sequential_scans": (r.sequential_scans, f"SELECT relname, seq_scan, idx_scan, {pct('seq_scan', 'seq_scan + idx_scan')} AS seq_pct FROM table_stats WHERE seq_scan > idx_scan ORDER BY seq_pct DESC, relname LIMIT 20"),
    "qm14_write_activity": (r.write_activity, f"SELECT parent, {', '.join(SUM.format(c) for c in ('n_ins', 'n_upd', 'n_del'))}, CAST(sum(n_ins + n_upd + n_del) AS BIGINT) AS writes FROM table_stats GROUP BY parent"),
    "qm15_partition_health": (r.partition_health, "SELECT strftime(x, '%Y-%m-%d') AS day, count(*) AS partitions, CAST(min(hour(x)) AS INT) AS first_hour, CAST(max(hour(x)) AS INT) AS last_hour FROM (SELECT strptime(substring(relname, 6, 13), '%Y_%m_%d_%H') AS x FROM table_stats WHERE regexp_matches(relname, '^part_\\d{4}_\\d{2}_\\d{2}_\\d{2}$')) GROUP BY 1"),
    "qs3_table_io": (r.table_io, f"SELECT parent, CAST(sum(page_reads) AS BIGINT) AS reads, {pct('sum(idx_scan)', 'sum(idx_scan + seq_scan)')} AS hit_pct, 'public.' || parent AS qualified FROM table_stats GROUP BY parent"),
    "qs4_index_usage": (r.index_usage, "SELECT CASE WHEN idx_scan = 0 THEN 'unused' WHEN idx_scan < 5 THEN 'rare' ELSE 'used' END AS usage, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM table_stats GROUP BY 1"),
}

_EPOCH = "CAST(epoch(date_trunc('second', {})) AS BIGINT)"
AGE = f"({_EPOCH.format('as_of.t')} - {_EPOCH.format('{}')})"
SECONDS = f"({_EPOCH.format('processed_at')} - {_EPOCH.format('created_at')})"
_queue = {
    "qr8_job_runs": (lambda q, now: r.job_runs(q), f"SELECT status, count(*) AS runs, {r3(f'avg({SECONDS})')} AS avg_seconds, {r3(f'max({SECONDS})')} AS max_seconds FROM queue GROUP BY status"),
    "qm3_connections": (lambda q, now: r.connections(q), f"SELECT status, count(*) AS n, CAST(max({SECONDS}) AS DOUBLE) AS longest_s FROM queue GROUP BY status"),
    "qm4_long_running": (r.long_running, f"SELECT id, {AGE.format('locked_at')} AS age_s FROM queue, as_of WHERE status = 'processing' AND {AGE.format('locked_at')} > 300"),
    "qm11_replication_lag": (r.replication_lag, f"SELECT {_EPOCH.format('max(as_of.t)')} - {_EPOCH.format('max(event_time)')} AS lag_s FROM queue, as_of WHERE status = 'done'"),
    "qs5_active_statements": (r.active_statements, f"SELECT id, status, left(text, 40) AS text, {AGE.format('created_at')} AS age_s FROM queue, as_of WHERE status IN ('pending', 'processing') AND {AGE.format('created_at')} >= 0 ORDER BY age_s, id LIMIT 100"),
}

_training = {
    "qc1_label_disagreement": (r.label_disagreement, "SELECT event_id, correct_layer, detected_layer, detected_confidence, correct_layer <> detected_layer AS layer_differs, NOT list_has_any(correct_geo_ids, detected_geo_ids) AS ids_differ FROM training WHERE correct_layer <> detected_layer OR NOT list_has_any(correct_geo_ids, detected_geo_ids)"),
    "qc2_label_summary": (r.label_summary, f"SELECT detected_layer, count(*) AS n, {pct('sum(CASE WHEN correct_layer = detected_layer THEN 1 ELSE 0 END)', 'count(*)')} AS accuracy_pct, {r3('avg(detected_confidence)')} AS avg_confidence, count(*) FILTER (is_promotional) AS promotional, count(*) FILTER (has_geo_reference) AS with_reference FROM training GROUP BY 1"),
}


def _queue_query(f):
    return lambda spark, d: f(t.queue(spark, d), t.as_of(t.events_log(spark, d)))


QUERIES = (
    {k: (lambda s, d, f=f: f(t.events_log(s, d))) for k, (f, _) in _events.items()}
    | {k: (lambda s, d, f=f: f(t.query_stats(s, d))) for k, (f, _) in _stats.items()}
    | {k: (lambda s, d, f=f: f(t.table_stats(s, d))) for k, (f, _) in _tables.items()}
    | {k: _queue_query(f) for k, (f, _) in _queue.items()}
    | {k: (lambda s, d, f=f: f(t.training(s, d))) for k, (f, _) in _training.items()}
    | {"qm8_hit_ratios": lambda s, d: r.hit_ratios(t.query_stats(s, d), t.table_stats(s, d))}
)
ORACLE_SQL = {
    k: f"WITH {cte} {sql}".replace("$$", "'")
    for own, cte in ((_events, t.EVENTS_LOG), (_stats, t.QUERY_STATS), (_tables, t.TABLE_STATS), (_queue, t.QUEUE), (_training, t.TRAINING))
    for k, (_, sql) in own.items()
} | {
    "qm8_hit_ratios": f"WITH {t.QUERY_STATS}, {t.TABLE_STATS} SELECT 'block' AS kind, {pct('sum(shared_blks_hit)', 'sum(shared_blks_hit + shared_blks_read)')} AS pct FROM query_stats UNION ALL SELECT 'index', {pct('sum(idx_scan)', 'sum(idx_scan + seq_scan)')} FROM table_stats"
}
