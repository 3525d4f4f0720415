"""Fixed-window request limits whose work spreads over tasks, however many requests one client makes.

A window begins with the first request after the last one ran out, so each request points to the one that would begin the
next window if it began one. Which requests do begin one follows by doubling these pointers: rounds grow with the logarithm
of a client's windows, and every round joins on the requests' numbers, which are dealt evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut
from .log import numbered


def running(rows: DataFrame, order: Sequence[str], count: str | None = None, most: str | None = None) -> DataFrame:
    """rows with _count, how many rows so far have a value in count, and _most, the greatest value of most so far.

    Rows are dealt by ranges of order; only the ranges' totals, a row for each partition, go through one task.
    """
    given = [f(F.col(c)).alias(n) for f, c, n in ((F.count, count, "_count"), (F.max, most, "_most")) if c]
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*given)
    before = totals.select("_range", *([F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_b")] if count else []), *([F.max("_most").over(earlier).alias("_m")] if most else []))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = {n: f(F.col(c)).over(inside) for f, c, n in ((F.count, count, "_count"), (F.max, most, "_most")) if c}
    # a row for each partition
    out = dealt.withColumns(here).join(F.broadcast(before), "_range")
    merged = ([(F.col("_count") + F.col("_b")).alias("_count")] if count else []) + ([F.greatest("_most", "_m").alias("_most")] if most else [])
    return out.select(*rows.columns, *merged)


def window_places(requests: DataFrame, keys: Sequence[str], time: str, ident: str, window_s: float) -> DataFrame:
    """requests with window_place: the number of each request in its window, from 1 on.

    Windows are those of a key; ident tells requests apart, and orders those of one time. Requests without a key or time
    have no place (null). Other columns pass through.
    """
    whole = [F.col(k).isNotNull() for k in (*keys, time)]
    known = whole[0]
    for c in whole[1:]:
        known = known & c
    order = [*keys, "_at", ident]
    rows = requests.where(known).select(*[F.col(k) for k in keys], F.col(ident), F.col(time).cast("double").alias("_at"))
    rows = cut(numbered(rows, order, "_place"))
    # the first request that comes more than a window after each one has as number how many stand before that moment
    probes = rows.select(*keys, (F.col("_at") + window_s).alias("_at"), F.lit(None).cast("long").alias("_one"), F.lit(1).alias("_probe"), F.col(ident), F.col("_place").alias("_owner"))
    both = rows.select(*keys, "_at", F.lit(1).cast("long").alias("_one"), F.lit(0).alias("_probe"), F.col(ident), "_place").withColumnRenamed("_place", "_owner").unionByName(probes)
    found = running(both, [*keys, "_at", "_probe", ident, "_owner"], count="_one").where("_probe = 1").select(*keys, F.col("_owner").alias("_from"), F.col("_count").alias("_to"))
    here = rows.select(F.col("_place").alias("_to"), *[F.col(k).alias(f"_{k}_") for k in keys])
    same = found.join(here, "_to")
    for k in keys:
        same = same.where(F.col(k) == F.col(f"_{k}_"))
    jump = cut(same.select("_from", "_to"))
    reach = cut(rows.groupBy(*keys).agg(F.min("_place").alias("_from")).select("_from"))
    while True:
        more = cut(reach.join(jump, "_from").select(F.col("_to").alias("_from")))
        if not more.limit(1).count():
            break
        reach = cut(reach.union(more))
        jump = cut(jump.join(jump.toDF("_to", "_far"), "_to").select("_from", F.col("_far").alias("_to")))
    begun = rows.join(reach.withColumnRenamed("_from", "_place").withColumn("_start", F.col("_place")), "_place", "left")
    placed = running(begun, ["_place"], most="_start").select(F.col(ident).alias("_ident"), (F.col("_place") - F.col("_most") + 1).alias("window_place"))
    return requests.join(placed, requests[ident] == placed["_ident"], "left").drop("_ident")


def two_levels(requests: DataFrame, client: str, path: str, time: str, ident: str, own: tuple[int, float], overall: tuple[int, float]) -> DataFrame:
    """requests with verdict: passed, overall or path. Each limit is a number of requests and seconds.

    The limit over all paths of a client comes first; a path's limit counts only what that one let through. Requests
    without a client, path or time pass.
    """
    every = cut(window_places(requests, [client], time, ident, overall[1]).withColumnRenamed("window_place", "_overall"))
    let = F.coalesce(F.col("_overall") <= overall[0], F.lit(True))
    of_path = window_places(every.where(let), [client, path], time, ident, own[1])
    passed = of_path.withColumn("verdict", F.when(F.col("window_place") > own[0], "path").otherwise("passed")).drop("_overall", "window_place")
    return passed.unionByName(every.where(~let).withColumn("verdict", F.lit("overall")).drop("_overall"))


def passed_counts(requests: DataFrame, key: str, time: str, ident: str, limit: int, window_s: float) -> DataFrame:
    """key, requests, passed: how many a fixed-window limiter lets through."""
    placed = window_places(requests.where(F.col(key).isNotNull()), [key], time, ident, window_s)
    ok: Column = F.col("window_place") <= limit
    return placed.groupBy(key).agg(F.count("*").alias("requests"), F.count_if(ok).alias("passed"))
