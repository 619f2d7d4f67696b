"""Search over entries that keep arriving, and the newest row of every path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathgrove.sources import schemas


def watch(spark: SparkSession, folder: str, condition: Column) -> DataFrame:
    """A streaming DataFrame of the matching entries of all Parquet files that arrive in folder."""
    return spark.readStream.schema(schemas.ENTRIES).parquet(folder).where(condition)


def newest(entries: DataFrame) -> DataFrame:
    """The latest state of every path, kept up to date (complete or update mode); batch tables work too."""
    row = F.struct("mtime", "mtime_ns", "size", "mode", "path")
    return entries.groupBy("id").agg(F.max(row).alias("row")).select("id", "row.*")
