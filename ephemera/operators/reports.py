"""Data-quality, baseline, monitoring and calibration reports over the event log and statistics tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FALLBACK = "random"


def rounded(x: Column | str, digits: int = 3) -> Column:
    """Half-up rounding of doubles that every engine agrees on."""
    scale = float(10**digits)
    return F.floor((F.col(x) if isinstance(x, str) else x).cast("double") * scale + 0.5) / scale


def share(part: Column, whole: Column) -> Column:
    """Percentage with two digits; null where there is nothing to divide by."""
    return rounded(part.cast("double") * 100 / F.nullif(whole.cast("double"), F.lit(0.0)), 2)


def hour_text(column: str = "event_time") -> Column:
    return F.date_format(F.date_trunc("hour", column), "yyyy-MM-dd HH:mm")


def confidence_bucket(column: str = "confidence") -> Column:
    c = F.col(column)
    return F.when(c.isNull(), "none").when(c >= 0.95, "very_high").when(c >= 0.85, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("very_low")


def last_hour(events: DataFrame, minutes: int = 60) -> DataFrame:
    """The rows of the last minutes before the newest, which stands for the present."""
    return events.where(F.col("event_time") >= events.agg(F.max("event_time") - F.expr(f"INTERVAL {minutes} MINUTES")).scalar())


def quality_summary(events: DataFrame) -> DataFrame:
    """Over the last hour: counts, shares, confidence, and the oldest and newest time."""
    located = F.col("strategy") != FALLBACK
    return last_hour(events).agg(
        F.date_format(F.min("event_time"), "yyyy-MM-dd HH:mm:ss").alias("oldest"), F.date_format(F.max("event_time"), "yyyy-MM-dd HH:mm:ss").alias("newest"),
        F.count("*").alias("total"), F.count_if(located).alias("located"), F.count_if(F.col("gtype").isNull()).alias("without_geometry"), share(F.count_if(located), F.count("*")).alias("located_pct"),
        rounded(F.avg(F.when(located, F.col("confidence")))).alias("avg_confidence"), rounded(F.min("confidence")).alias("min_confidence"), rounded(F.max("confidence")).alias("max_confidence"),
    )


def strategy_by_geometry(events: DataFrame) -> DataFrame:
    return events.groupBy("strategy", F.coalesce("gtype", F.lit("NONE")).alias("gtype")).agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def fallback_reasons(events: DataFrame) -> DataFrame:
    """Over the last hour, with each reason's share."""
    n = last_hour(events).where(F.col("strategy") == FALLBACK).groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy())))


def unresolved(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest fallback events; the id breaks ties."""
    bad = events.where(F.col("strategy") == FALLBACK).select("id", hour_text().alias("hour"), F.substring("description", 1, 120).alias("description"), "layer", "reason", "event_time")
    return bad.orderBy(F.desc("event_time"), "id").limit(limit).drop("event_time")


def invariants(events: DataFrame) -> DataFrame:
    """How many rows break each rule of the log."""
    rules = {
        "located_without_geometry": (F.col("strategy") != FALLBACK) & F.col("gtype").isNull(),
        "segment_not_line": (F.col("strategy") == "street_segment") & (F.coalesce("gtype", F.lit("")) != "LINESTRING"),
        "confidence_out_of_range": ~F.col("confidence").between(0, 1),
        "description_too_long": F.length("description") > 500,
        "unknown_strategy": ~F.col("strategy").isin("random", "single_match", "intersection", "street_segment", "weighted_centroid"),
        "matched_without_candidates": (F.col("strategy") != FALLBACK) & (F.col("candidate_count") == 0),
    }
    return events.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))


def duplicate_ids(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("event_time").alias("times")).where("n > 1")


def size_text(bytes_: str) -> Column:
    b = F.col(bytes_).cast("double")
    unit = lambda power, name: F.concat(F.floor(b / 1024**power + 0.5).cast("string"), F.lit(f" {name}"))
    return F.when(b < 10240, F.concat(F.col(bytes_).cast("string"), F.lit(" bytes"))).when(b < 10240 * 1024, unit(1, "kB")).when(b < 10240 * 1024**2, unit(2, "MB")).otherwise(unit(3, "GB"))


def partition_sizes(tables: DataFrame, limit: int = 20) -> DataFrame:
    return tables.select("relname", "bytes", size_text("bytes").alias("size"), "live_rows").orderBy(F.desc("bytes"), "relname").limit(limit)


def job_runs(queue: DataFrame) -> DataFrame:
    """Runs by status, with the longest and mean seconds."""
    seconds = (F.unix_timestamp("processed_at") - F.unix_timestamp("created_at")).cast("double")
    return queue.groupBy("status").agg(F.count("*").alias("runs"), rounded(F.avg(seconds)).alias("avg_seconds"), rounded(F.max(seconds)).alias("max_seconds"))


def distribution(events: DataFrame, key: str) -> DataFrame:
    n = events.groupBy(key).agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("avg_confidence"), rounded(F.min("confidence")).alias("min_confidence"), rounded(F.max("confidence")).alias("max_confidence"))
    return n.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy())))


def share_of_total(events: DataFrame, key: str) -> DataFrame:
    """Each group's share of a total that is a scalar subquery of its own."""
    total = events.agg(F.count("*").alias("total"))
    return events.groupBy(key).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(key, "n", share(F.col("n"), F.col("total")).alias("pct"))


def confidence_buckets(events: DataFrame) -> DataFrame:
    """Counts by bucket; rank orders the buckets by their least confidence, which is not shown."""
    n = events.groupBy(confidence_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.min("confidence").alias("least"))
    return n.select("bucket", "n", F.row_number().over(Window.orderBy("least")).cast("long").alias("rank"))


def candidate_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("candidate_count").agg(F.count("*").alias("n"))


def daily_volume(events: DataFrame) -> DataFrame:
    fallback = F.sum(F.when(F.col("strategy") == FALLBACK, 1).otherwise(0))
    return events.groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), fallback.cast("long").alias("fallback"), share(fallback, F.count("*")).alias("fallback_pct"))


def cross_table(events: DataFrame) -> DataFrame:
    return events.groupBy("layer", "strategy").agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("avg_confidence"))


def low_confidence(events: DataFrame, below: float = 0.5, limit: int = 100) -> DataFrame:
    return events.where((F.col("confidence") < below) & (F.col("strategy") != FALLBACK)).select("id", "layer", "strategy", "confidence").orderBy("confidence", "id").limit(limit)


def fallback_share(events: DataFrame) -> DataFrame:
    fallback = F.count_if(F.col("strategy") == FALLBACK)
    return events.agg(fallback.alias("fallback"), F.count("*").alias("total"), share(fallback, F.count("*")).alias("pct"))


def guard_count(events: DataFrame) -> DataFrame:
    """Events whose diagnostics hold the key of the far-candidate guard, out of all with diagnostics."""
    keys = F.json_object_keys("props")
    return events.agg(F.count_if(F.array_contains(keys, "anti_list")).alias("guarded"), F.count_if(F.array_contains(keys, "k")).alias("with_k"), F.count("*").alias("total"))


def match_rate(events: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("candidate_count") > 0)
    return events.groupBy("layer").agg(F.count("*").alias("n"), hit.alias("matched"), share(hit, F.count("*")).alias("match_pct"))


def slowest(stats: DataFrame, limit: int = 20) -> DataFrame:
    total = stats.agg(F.sum("total_exec_time")).scalar()
    return stats.select("queryid", F.substring("query", 1, 100).alias("query"), "calls", rounded("mean_exec_time", 2).alias("mean_ms"), share(F.col("total_exec_time"), total).alias("pct")).orderBy(F.desc("mean_ms"), "queryid").limit(limit)


def frequent(stats: DataFrame, limit: int = 20) -> DataFrame:
    return stats.select("queryid", "query", "calls", "total_exec_time", (F.col("rows") / F.nullif("calls", F.lit(0))).alias("rows_per_call")).orderBy(F.desc("calls"), F.desc("total_exec_time"), "queryid").limit(limit)


def connections(queue: DataFrame) -> DataFrame:
    age = (F.unix_timestamp("processed_at") - F.unix_timestamp("created_at")).cast("double")
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.max(age).alias("longest_s"))


def long_running(queue: DataFrame, now: DataFrame, minutes: int = 5) -> DataFrame:
    """Rows in work whose lease began more than some minutes before the present."""
    age = F.unix_timestamp("t") - F.unix_timestamp("locked_at")
    return queue.where("status = 'processing'").join(F.broadcast(now)).select("id", age.alias("age_s")).where(F.col("age_s") > minutes * 60)


def lock_graph(stats: DataFrame) -> DataFrame:
    """Who waits for whom: an ungranted request and a granted one that agree null-safely in relation and rows, by other processes.

    Requests are counted by lock and process before they meet, so that a busy lock joins processes, not requests.
    """
    lock = ["locked_rel", "rows", "shared_blks_read"]
    of = lambda side: side.groupBy(*lock, "pid").agg(F.count("*").alias("n"))
    w, h = of(stats.where("NOT granted")).alias("w"), of(stats.where("granted")).alias("h")
    same = reduce(lambda a, b: a & b, [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in lock])
    pairs = w.join(h, same & (F.col("w.pid") != F.col("h.pid")))
    return pairs.groupBy(F.col("w.pid").alias("waiting"), F.col("h.pid").alias("holding")).agg(F.sum(F.col("w.n") * F.col("h.n")).alias("locks"))


def bloat(tables: DataFrame, limit: int = 20) -> DataFrame:
    rate = share(F.col("dead_rows"), F.col("live_rows") + F.col("dead_rows"))
    return tables.where("dead_rows > 100").select("relname", "live_rows", "dead_rows", rate.alias("dead_pct")).orderBy(F.desc("dead_rows"), "relname").limit(limit)


def unused_indexes(tables: DataFrame) -> DataFrame:
    return tables.where("idx_scan = 0").select("relname", size_text("bytes").alias("size"))


def hit_ratios(stats: DataFrame, tables: DataFrame) -> DataFrame:
    """Two aggregates one under the other: block and index hit ratios."""
    a = stats.agg(F.sum("shared_blks_hit").cast("double").alias("hit"), F.sum(F.col("shared_blks_hit") + F.col("shared_blks_read")).cast("double").alias("all")).withColumn("kind", F.lit("block"))
    b = tables.agg(F.sum("idx_scan").cast("double").alias("hit"), F.sum(F.col("idx_scan") + F.col("seq_scan")).cast("double").alias("all")).withColumn("kind", F.lit("index"))
    return a.unionByName(b).select("kind", share(F.col("hit"), F.col("all")).alias("pct"))


def partition_stats(tables: DataFrame) -> DataFrame:
    return tables.groupBy("parent").agg(F.count("*").alias("partitions"), F.sum("live_rows").alias("live_rows"), F.sum("dead_rows").alias("dead_rows"), F.sum("bytes").alias("bytes"))


def table_sizes(tables: DataFrame) -> DataFrame:
    return tables.groupBy("parent").agg(F.sum("bytes").alias("bytes")).select("parent", "bytes", size_text("bytes").alias("size"))


def replication_lag(queue: DataFrame, now: DataFrame) -> DataFrame:
    done = queue.where("status = 'done'").agg(F.max("event_time").alias("last"))
    return done.join(F.broadcast(now)).select((F.unix_timestamp("t") - F.unix_timestamp("last")).alias("lag_s"))


def sequential_scans(tables: DataFrame, limit: int = 20) -> DataFrame:
    rate = share(F.col("seq_scan"), F.col("seq_scan") + F.col("idx_scan"))
    return tables.where("seq_scan > idx_scan").select("relname", "seq_scan", "idx_scan", rate.alias("seq_pct")).orderBy(F.desc("seq_pct"), "relname").limit(limit)


def temp_files(stats: DataFrame) -> DataFrame:
    return stats.where("temp_blks_written > 0").groupBy("query").agg(F.sum("temp_blks_written").alias("blocks"), F.count("*").alias("n"))


def write_activity(tables: DataFrame) -> DataFrame:
    return tables.groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("n_ins", "n_upd", "n_del")), F.sum(F.col("n_ins") + F.col("n_upd") + F.col("n_del")).alias("writes"))


def partition_health(tables: DataFrame) -> DataFrame:
    """Names that carry an hour, read back from the name."""
    named = tables.where(F.col("relname").rlike(r"^part_\d{4}_\d{2}_\d{2}_\d{2}$"))
    at = F.to_timestamp(F.substring("relname", 6, 13), "yyyy_MM_dd_HH")
    return named.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("partitions"), F.min(F.hour(at)).alias("first_hour"), F.max(F.hour(at)).alias("last_hour"))


def statement_timing(stats: DataFrame, like: str = "SELECT%") -> DataFrame:
    own = stats.where(F.col("query").like(like) & ~F.col("query").like("%URGENT%"))
    name = F.regexp_replace("query", "^[A-Z]+ ", "")
    return own.groupBy(name.alias("name")).agg(F.sum("calls").alias("calls"), rounded(F.sum("total_exec_time") / F.nullif(F.sum("calls"), F.lit(0)), 2).alias("mean_ms"), F.max("max_exec_time").alias("max_ms"))


def low_confidence_alert(events: DataFrame, below: float = 0.5, more_than: int = 1) -> DataFrame:
    """Hours with more than some low-confidence events."""
    bad = events.where(F.col("confidence") < below).groupBy(hour_text().alias("hour"))
    return bad.agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("avg_confidence"), rounded(F.avg("scatter_m")).alias("avg_scatter")).where(F.col("n") > more_than)


def strategy_share_by_hour(events: DataFrame) -> DataFrame:
    n = events.groupBy(hour_text().alias("hour"), "strategy").agg(F.count("*").alias("n"))
    return n.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy("hour"))))


def bucket_share_by_strategy(events: DataFrame) -> DataFrame:
    n = events.groupBy("strategy", confidence_bucket().alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy("strategy"))))


def hypothesis_rate(events: DataFrame) -> DataFrame:
    with_key = events.where(F.array_contains(F.json_object_keys("props"), "k"))
    n = with_key.groupBy("strategy").agg(F.count("*").alias("n"), rounded(F.avg(F.get_json_object("props", "$.k").cast("double"))).alias("avg_k"))
    return n.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy())))


def statements_by_share(stats: DataFrame, least_calls: int = 10) -> DataFrame:
    n = stats.groupBy("query").agg(F.sum("calls").alias("calls"), F.sum("total_exec_time").alias("total_ms"), F.sum("rows").alias("rows")).where(F.col("calls") > least_calls)
    return n.withColumn("pct", share(F.col("total_ms"), F.sum("total_ms").over(Window.partitionBy())))


def table_io(tables: DataFrame) -> DataFrame:
    ratio = share(F.sum("idx_scan"), F.sum(F.col("idx_scan") + F.col("seq_scan")))
    return tables.groupBy("parent").agg(F.sum("page_reads").alias("reads"), ratio.alias("hit_pct"), F.concat_ws(".", F.lit("public"), F.col("parent")).alias("qualified"))


def index_usage(tables: DataFrame) -> DataFrame:
    kind = F.when(F.col("idx_scan") == 0, "unused").when(F.col("idx_scan") < 5, "rare").otherwise("used")
    return tables.groupBy(kind.alias("usage")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def active_statements(queue: DataFrame, now: DataFrame) -> DataFrame:
    age = F.unix_timestamp("t") - F.unix_timestamp("created_at")
    return queue.where("status IN ('pending', 'processing')").join(F.broadcast(now)).select("id", "status", F.substring("text", 1, 40).alias("text"), age.alias("age_s")).where("age_s >= 0").orderBy("age_s", "id").limit(100)


def label_disagreement(training: DataFrame) -> DataFrame:
    wrong = F.col("correct_layer") != F.col("detected_layer")
    same_ids = F.arrays_overlap("correct_geo_ids", "detected_geo_ids")
    return training.where(wrong | ~same_ids).select("event_id", "correct_layer", "detected_layer", "detected_confidence", wrong.alias("layer_differs"), (~same_ids).alias("ids_differ"))


def label_summary(training: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("correct_layer") == F.col("detected_layer"), 1).otherwise(0))
    return training.groupBy("detected_layer").agg(
        F.count("*").alias("n"), share(right, F.count("*")).alias("accuracy_pct"), rounded(F.avg("detected_confidence")).alias("avg_confidence"), F.count_if("is_promotional").alias("promotional"), F.count_if("has_geo_reference").alias("with_reference"),
    )
