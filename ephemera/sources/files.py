"""Files of the dictionary and of snapshots: CSV with aliases and well-known text, GeoJSON lines, and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

DICTIONARY = "id long, names string, wkt string, type string"
FEATURE = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<id: long, name: string>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the rows of a CSV file of one text column with a header; empty ones go, and each word comes once."""
    rows = spark.read.schema("word string").option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id, names, type, geom: a CSV file with aliases between bars and well-known text; rows whose geometry is broken go."""
    rows = spark.read.schema(DICTIONARY).option("header", True).option("escape", '"').csv(path)
    names = F.filter(F.transform(F.split("names", r"\|"), lambda n: F.trim(n)), lambda n: n != "")
    return rows.select("id", names.alias("names"), "type", geo.from_wkt("wkt").alias("geom")).where("geom.gtype IS NOT NULL")


def read_point_features(spark: SparkSession, path: str) -> DataFrame:
    """id, name, lon, lat: GeoJSON lines, compressed or not; what is not a point feature goes.

    Spark unpacks by a file's ending; a row that cannot be read, as of a file with a wrong ending, is a null row and goes too.
    """
    rows = spark.read.schema(FEATURE).option("mode", "PERMISSIVE").json(path)
    return rows.where("type = 'Feature' AND geometry.type = 'Point' AND size(geometry.coordinates) = 2").select("properties.id", "properties.name", F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"))


def save_snapshot(rows: DataFrame, root: str, version: int) -> None:
    """rows as a version of a snapshot; writing a version again replaces it."""
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")


def newest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the snapshot with the greatest version."""
    every = spark.read.parquet(root)
    return every.where(F.col("version") == every.agg(F.max("version")).scalar()).drop("version")
