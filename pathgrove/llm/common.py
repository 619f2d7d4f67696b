"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathgrove.sources.shared import materialise, release, shared_dir  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers in rows and bytes, so that very long texts don't pile up. All operators of
    this subpackage run under these two settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


_held: dict = {}


def held(key: tuple, make: Callable):
    """What a Python worker keeps between batches and tasks (models, caches): one thing at a time, so that operators which run one
    after another in the same worker don't add up."""
    if key not in _held:
        _held.clear()
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed buffers back
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
