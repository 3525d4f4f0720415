"""The event log as a table: filters, watermarks, snapshots, retention, upserts, diffs and queue states."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import FUTURE_MINUTES, TTL_MINUTES
from .lineage import cut


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL {n} MINUTES")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df as the broadcast side of a join if it has no more than most rows, which is looked at; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def all_of(conditions: Sequence[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def recent(events: DataFrame, now: DataFrame, window: int | None, since: str | None = None, after_id: int | None = None, after_message_id: int | None = None, layers: Sequence[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Rows of the last window minutes (None or 0: of all time) that fulfil every condition given; since excludes equal times."""
    time = F.col("event_time")
    return events.where(
        all_of([
            # a scalar subquery, so that the bound reaches the scan
            time >= now.select(F.col("t") - minutes(window)).scalar() if window else None,
            None if since is None else (time >= F.lit(since).cast("timestamp") if inclusive else time > F.lit(since).cast("timestamp")),
            None if after_id is None else F.col("id") > after_id,
            None if after_message_id is None else F.col("message_id") > after_message_id,
            None if layers is None else F.col("layer").isin(list(layers)),
        ])
    )


def updates(events: DataFrame, after_id: int = 0, after_message_id: int = 0, after_time: str | None = None, limit: int = 2000) -> DataFrame:
    """Rows after a watermark: the message id counts if given, else the id, else the time. The first limit rows by id."""
    mark = F.col("message_id") > after_message_id if after_message_id > 0 else F.col("id") > after_id if after_id > 0 else F.lit(True) if after_time is None else F.col("event_time") > F.lit(after_time).cast("timestamp")
    return events.where(mark).orderBy("id").limit(limit)


def resync_flags(events: DataFrame, marks: DataFrame) -> DataFrame:
    """For each watermark: whether the client must load everything anew, as the mark lies outside the log's ids."""
    span = events.agg(F.coalesce(F.min("message_id"), F.lit(0)).alias("lo"), F.coalesce(F.max("message_id"), F.lit(0)).alias("hi"))
    outside = (F.col("mark") > F.col("hi")) | ((F.col("lo") > 0) & (F.col("mark") < F.col("lo") - 1))
    return marks.join(F.broadcast(span)).select("mark", outside.alias("resync"))


def accepted(events: DataFrame, now: DataFrame, past: int = TTL_MINUTES, future: int = FUTURE_MINUTES) -> DataFrame:
    """events with verdict: accepted, late or future; a missing time is accepted."""
    t = F.col("event_time")
    verdict = F.when(t.isNull(), "accepted").when(t < F.col("t") - minutes(past), "late").when(t > F.col("t") + minutes(future), "future").otherwise("accepted")
    return events.join(F.broadcast(now)).withColumn("verdict", verdict).drop("t")


def expired_summary(events: DataFrame, now: DataFrame, window: int = TTL_MINUTES) -> DataFrame:
    """What retention removes: how many rows, and how many files go with them."""
    gone = expired(events, now, window)
    return gone.agg(F.count("*").alias("deleted"), F.count("photo_url").alias("files"))


def expired(events: DataFrame, now: DataFrame, window: int = TTL_MINUTES) -> DataFrame:
    return events.where(F.col("event_time") < now.select(F.col("t") - minutes(window)).scalar())


def expired_files(events: DataFrame, now: DataFrame, window: int = TTL_MINUTES) -> DataFrame:
    """name: the files that go with the rows that retention removes, a row each."""
    return expired(events, now, window).where("photo_url IS NOT NULL").select(F.regexp_replace("photo_url", "^.*/", "").alias("name")).distinct()


def insert_new(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of batch to append: the first of each key by order, if the table does not hold it. Null keys are distinct from all."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    rest = [c for c in batch.columns if c not in keys]
    first = batch.where(~null).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*batch.columns)
    return first.join(table.select(*keys), list(keys), "left_anti").unionByName(batch.where(null))


def upsert(table: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The table after batch replaced equal keys; of a key's rows in batch the last by order stays. Columns of order that the table lacks go."""
    rest = [c for c in table.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def latest(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each key by order."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def capped(events: DataFrame, most: int = 5000, keep: int = 4500) -> DataFrame:
    """Beyond most rows only the newest keep stay; ids break ties."""
    total = events.agg(F.count("*").alias("_n"))
    newest = events.orderBy(F.desc("event_time"), F.desc("id")).limit(keep)
    small = events.join(F.broadcast(total)).where(F.col("_n") <= most).drop("_n")
    large = newest.join(F.broadcast(total)).where(F.col("_n") > most).drop("_n")
    return small.unionByName(large)


def difference(shown: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """What takes one set of rows to the other: key and added, removed or updated."""
    a, b = shown.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ina")), wanted.select(key, F.col(value).alias("_b"), F.lit(1).alias("_inb"))
    kind = F.when(F.col("_ina").isNull(), "added").when(F.col("_inb").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "updated")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change IS NOT NULL")


def feature() -> Column:
    """An event as a GeoJSON feature; fields without a value are there as null."""
    return F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("id", "message_id", "layer", "description", "strategy", "confidence").alias("properties"),
    )


def features(events: DataFrame) -> DataFrame:
    """id, geojson: each event as a feature of its own, for exports of any size."""
    return events.select("id", F.to_json(feature(), {"ignoreNullFields": "false"}).alias("geojson"))


def feature_collection(events: DataFrame, order: Sequence[str], most: int = 5000) -> DataFrame:
    """One GeoJSON document of the first most rows in order; an empty table gives an empty list of features."""
    shown = events.orderBy(*order).limit(most)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, feature().alias("f")))), lambda x: x["f"])
    return shown.agg(rows.alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.coalesce("features", F.array()).alias("features")), {"ignoreNullFields": "false"}).alias("geojson"), F.size("features").alias("n"))


def requeued(queue: DataFrame, now: DataFrame, lease: int = 5) -> DataFrame:
    """Statuses after leases older than lease minutes ran out."""
    stuck = (F.col("status") == "processing") & (F.col("locked_at") < F.col("t") - minutes(lease))
    return queue.join(F.broadcast(now)).select("id", F.when(stuck, "pending").otherwise(F.col("status")).alias("status"))


def queue_expiry(queue: DataFrame, now: DataFrame) -> DataFrame:
    """Pending rows outside the window expire; finished ones older than it are purged: how many of each."""
    late = (F.col("event_time") < F.col("t") - minutes(TTL_MINUTES)) | (F.col("event_time") > F.col("t") + minutes(FUTURE_MINUTES))
    old = F.col("created_at") < F.col("t") - minutes(TTL_MINUTES)
    joined = queue.join(F.broadcast(now))
    return joined.agg(F.count_if((F.col("status") == "pending") & late).alias("expired"), F.count_if(F.col("status").isin("done", "error", "expired") & old).alias("purged"))


def transitions(history: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose status differs from the one before it, null-safely."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(order, "id"))
    return history.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("status"))).select(key, "id", "before", "status")


def partition_plan(now: DataFrame) -> DataFrame:
    """Hourly partitions to create around the present: the hour before, this one, the next."""
    hours = F.sequence(F.date_trunc("hour", "t") - F.expr("INTERVAL 1 HOUR"), F.date_trunc("hour", "t") + F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    return now.select(F.explode(hours).alias("h")).select(F.concat(F.lit("events_"), F.date_format("h", "yyyy_MM_dd_HH")).alias("name"))


def partitions_to_drop(partitions: DataFrame, now: DataFrame, window: int = TTL_MINUTES) -> DataFrame:
    """Partitions whose whole hour lies before the window, by the hour in their name."""
    at = F.to_timestamp(F.substring("relname", 6, 13), "yyyy_MM_dd_HH")
    return partitions.join(F.broadcast(now)).where(at + F.expr("INTERVAL 1 HOUR") <= F.col("t") - minutes(window)).select("relname")


def orphans(files: DataFrame, events: DataFrame, oldest: int = 70) -> DataFrame:
    """Files of some age (minutes) that no event refers to."""
    used = events.where("photo_url IS NOT NULL").select(F.regexp_replace("photo_url", "^.*/", "").alias("name"))
    return files.where(F.col("age_min") > oldest).join(used, "name", "left_anti")


def deliveries(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events for each subscriber; an empty subscription takes everything.

    Each event stands under its category and once under a name that all categories share, so that one equi-join serves both.
    """
    named = lambda c: F.concat(F.lit("="), c)
    asked = subscriptions.select("subscriber", F.explode(F.when(F.size("layers") == 0, F.array(F.lit("*"))).otherwise(F.transform("layers", named))).alias("topic")).distinct()
    each = events.select("id", "layer", F.explode(F.array(F.lit("*"), named(F.col("layer")))).alias("topic"))
    return each.join(asked, "topic").select("subscriber", "id", "layer")


def changes_after(events: DataFrame, marks: DataFrame) -> DataFrame:
    """mark, n, last: for each distinct watermark within the log how many rows came after it, and the greatest id of these.

    Marks and rows are sorted together, newest first, and dealt by ranges; counts run within a range, and only the ranges'
    totals, a row for each partition, go through one task. So any number of marks costs one sort.
    """
    known = resync_flags(events, marks).where("NOT resync").select(F.col("mark").alias("at")).distinct()
    rows = events.select(F.col("message_id").alias("at"), "id", F.lit(0).alias("is_mark")).unionByName(known.select("at", F.lit(None).cast("long").alias("id"), F.lit(1).alias("is_mark")))
    order = [F.desc("at"), F.desc("is_mark"), F.desc("id")]
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.count("id").alias("_n"), F.max("id").alias("_last"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.max("_last").over(earlier).alias("_last"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumns({"n": F.count("id").over(inside), "last": F.max("id").over(inside)}).where("is_mark = 1")
    met = run.join(F.broadcast(before), "_range").select(F.col("at").alias("mark"), (F.col("n") + F.col("_n")).alias("n"), F.greatest("last", "_last").alias("last"))
    return met.where("n > 0")


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with one more column: their place by order, from 0 on. Rows are dealt by ranges, so that no task sees them all.

    The order must tell all rows apart. Only the ranges' counts, a row for each partition, go through one task.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def content_hash(rows: DataFrame, group: str, ident: str, fan: int = 4096) -> DataFrame:
    """group, etag: a hash of each group's ids that changes with any of them.

    Ids are hashed in parts of fan numbers, the parts in parts again, and so on over three levels, in order.
    """
    level = rows.select(group, F.floor(F.col(ident) / fan).alias("_part"), F.format_string("%d", ident).alias("_h"), F.col(ident).alias("_o"))
    for _ in range(3):
        joined = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"]), ","))
        level = level.groupBy(group, "_part").agg(joined.alias("_h")).select(group, F.col("_part").alias("_o"), F.floor(F.col("_part") / fan).alias("_part"), "_h")
    return level.groupBy(group).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"]), ",")).alias("etag"))


def violations(events: DataFrame) -> DataFrame:
    """Rows that break the pairing of strategy and geometry type, with the rule's name."""
    rule = F.when((F.col("strategy") == "street_segment") & ~F.col("gtype").eqNullSafe("LINESTRING"), "segment needs a line").when(F.col("strategy").isin("intersection", "weighted_centroid") & ~F.col("gtype").eqNullSafe("POINT"), "needs a point").when((F.col("strategy") == "single_match") & F.col("gtype").isNull(), "needs a geometry")
    return events.select("id", rule.alias("violation")).where("violation IS NOT NULL")


def staleness(now: DataFrame, events: DataFrame, limit: int = 5) -> DataFrame:
    """Whole minutes since the newest located event, and whether that is too long ago."""
    last = events.where("strategy <> 'random'").agg(F.max("event_time").alias("last"))
    age = F.floor((F.unix_timestamp("t") - F.unix_timestamp("last")) / 60)
    return now.join(F.broadcast(last)).select(age.alias("minutes_ago"), (F.unix_timestamp("t") - F.unix_timestamp("last") > limit * 60).alias("stale"))


def repeats_within(messages: DataFrame, key: Column, order: str, window_s: int = 1800) -> DataFrame:
    """messages with duplicate: the same key was seen window_s seconds before at most; every sighting counts, so gaps chain.

    A null key is never a duplicate. One sorted pass per key, no state beyond the row before.
    """
    keyed = messages.withColumn("_key", key)
    before = F.lag(order).over(Window.partitionBy("_key").orderBy(order, "message_id"))
    close = F.col("_key").isNotNull() & (F.col(order).cast("double") - before.cast("double") <= window_s)
    return keyed.withColumn("duplicate", F.coalesce(close, F.lit(False))).drop("_key")


#: Widest time window in minutes, most rows of one answer, and the windows that a client may choose.
MOST_MINUTES, MOST_ROWS, WINDOWS = 1440, 5000, (15, 30, 60)


def checked_request(minutes: int | None = None, limit: int = MOST_ROWS, after_id: int = 0, layers: Sequence[str] | None = None, known: Sequence[str] | None = None) -> dict[str, object]:
    """The arguments of recent and updates after their bounds were checked; a ValueError names the first that breaks one."""
    if minutes is not None and not 0 <= minutes <= MOST_MINUTES:
        raise ValueError(f"minutes must lie between 0 and {MOST_MINUTES}")
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must lie between 1 and {MOST_ROWS}")
    if after_id < 0:
        raise ValueError("after_id must not be negative")
    wrong = [x for x in layers or () if not x or len(x) > 50 or (known is not None and x not in known)]
    if wrong:
        raise ValueError(f"unknown category {wrong[0]!r}")
    return {"minutes": minutes, "limit": limit, "after_id": after_id, "layers": list(dict.fromkeys(layers)) if layers else None}
