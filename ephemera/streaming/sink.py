"""Streams of the event log: sources, late-row split, and an idempotent sink with a change counter."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import shared_dir
from ..sources.tables import FUTURE_MINUTES, TTL_MINUTES


def file_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 64) -> DataFrame:
    """A table's files as a stream; the pattern makes a single file as good as a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet")


def in_order(spark: SparkSession, rows: DataFrame, order: str, parts: int = 3, rows_per_file: int = 250_000) -> DataFrame:
    """rows as a stream of parts that come one after the other in ranges of order, a batch each."""
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    bounds = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)
    files = max(1, rows.count() // (parts * rows_per_file))
    at = F.col(order)
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        held = F.lit(True) if low is None else at >= low
        held = (held | at.isNull()) if low is None else held
        part = rows.where(held if high is None else held & ((at < high) | at.isNull()))
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def out_of_order(spark: SparkSession, rows: DataFrame, key: str, time: str, delay_s: int, parts: int = 3, rows_per_file: int = 250_000) -> DataFrame:
    """rows as a stream of parts in no order of time, a batch each, then one row without a key that moves the watermark past them.

    That row's time is two delays after the newest, so that with a watermark of delay_s everything before it is over.
    """
    path = f"{shared_dir(spark)}/mixed-{uuid.uuid4().hex}"
    files = max(1, rows.count() // (parts * rows_per_file))
    # dealt by hash in one pass, as rows may be dear to make; the files of a batch hold rows of all times
    rows.repartition(parts * files, *rows.columns).write.mode("append").parquet(path)
    end = rows.agg((F.max(time) + F.make_dt_interval(secs=F.lit(2 * delay_s))).alias(time))
    blank = [F.col(time) if c == time else F.lit("").cast(rows.schema[c].dataType).alias(c) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    end.select(*blank).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, layer, event_time, at (seconds) of the events, in several batches in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp"))
    return shaped(in_order(spark, e.withColumn("_at", F.col("event_time").cast("double")), "_at"))


def shaped(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("layer"), "event_time", F.col("event_time").cast("double").alias("at"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there, and reads the table that it wrote.

    Every batch overwrites the folder of its own number, so a batch that is run again after a failure counts once.
    """
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        rows = each(batch, number) if each else batch
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/rows")


def split_late(events: DataFrame, now: str, past: int = TTL_MINUTES, future: int = FUTURE_MINUTES) -> DataFrame:
    """events with verdict, decided before any stateful operator, so that late rows are counted and not lost."""
    t, at = F.lit(now).cast("timestamp"), F.col("event_time")
    late, early = at < t - F.expr(f"INTERVAL {past} MINUTES"), at > t + F.expr(f"INTERVAL {future} MINUTES")
    return events.withColumn("verdict", F.when(late, "late").when(early, "future").otherwise("accepted"))


def meta(batch: DataFrame, number: int) -> DataFrame:
    """The change record of a batch: its number as version, its rows, and its greatest id. Versions count from 0 without gaps."""
    return batch.agg(F.lit(number).cast("long").alias("version"), F.count("*").alias("rows"), F.max("id").alias("max_event_id"))
