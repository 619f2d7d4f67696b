import datetime as dt

import pytest
from pyspark.sql import SparkSession

from pathgrove.functions.modes import DIR
from pathgrove.sources import derived
from pathgrove.sources.snapshot import Snapshot

T0 = dt.datetime(2023, 10, 31, 5, 30, 42)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A snapshot from rows (path, size, mode or "d", mtime, hash)."""

    def run(rows, algo="sha1"):
        full = [(i, *r) for i, r in enumerate((*r, *(0, 0o644, T0, None)[len(r) - 1 :]) for r in rows)]
        df = spark.createDataFrame([(i, p, s, DIR | 0o755 if m == "d" else m, t) for i, p, s, m, t, _ in full], "idx long, path string, size long, mode long, mtime timestamp")
        hashes = spark.createDataFrame([(i, h) for i, _, _, m, _, h in full if m != "d"], "idx long, hash string")
        return Snapshot(derived.entries_of(df), hashes, "/root", algo)

    return run
