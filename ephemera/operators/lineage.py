"""Cutting a plan that later steps use many times, and dealing out rows of few bytes that are much work."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run in one process an own one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ephemera-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tasks(spark: SparkSession) -> int:
    """Tasks that keep every core busy, whatever the bytes: at least as many as shuffles have."""
    return max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over all cores. Files of few megabytes are one task otherwise, and adaptive execution joins small parts again."""
    return df.repartition(tasks(df.sparkSession), *keys)


def large(df: DataFrame) -> DataFrame:
    """df, never sent whole to every executor. What small files unfold to, and checkpoints of it, Spark takes for small and would gather on the driver."""
    return df.hint("merge")
