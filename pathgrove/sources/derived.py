"""Snapshots derived from other tables by rules that SQL can state too, so that every query has an independent check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathgrove.functions.modes import DIR

from .shared import materialise
from .snapshot import Snapshot

EPOCH = "2024-01-01 00:00:00"


def entries_of(rows: DataFrame) -> DataFrame:
    """Entries from (idx, path, size, mode, mtime)."""
    return rows.select(
        F.col("idx").cast("long"), F.sha1("path").alias("id"), "path", F.col("size").cast("long"), F.col("mode").cast("long"), "mtime",
        F.lit(0).cast("short").alias("mtime_ns"), F.lit(0).cast("short").alias("tz_min"),
    )


def _hours(n: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(hours=n.cast("int"))


def documents_snapshot(spark: SparkSession, sf_dir: str, largest: int | None = None) -> Snapshot:
    """A file source/lang/doc_id.txt per document with the digest of its text, and directories. largest: digests of longer texts are
    still pending, as while they are computed."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = d.select(F.col("doc_id").alias("idx"), path.alias("path"), F.col("n_chars").alias("size"), F.lit(0o644).alias("mode"), _hours(F.col("doc_id")).alias("mtime"))
    dirs = d.select(F.explode(F.array(F.lit("."), F.col("source"), F.concat_ws("/", "source", "lang"))).alias("path")).distinct()
    # an index below all files, by path hash, so that numbering needs no global order
    number = -1 - F.conv(F.substring(F.sha1("path"), 1, 12), 16, 10).cast("long")
    dirs = dirs.select(number.alias("idx"), "path", F.lit(4096).alias("size"), F.lit(DIR | 0o755).alias("mode"), F.lit(EPOCH).cast("timestamp").alias("mtime"))
    digest = F.sha2("text", 256)
    hashes = d.select(F.col("doc_id").alias("idx"), (digest if largest is None else F.when(F.col("n_chars") <= largest, digest)).alias("hash"))
    return Snapshot(entries_of(files.unionByName(dirs)), hashes, "/data/docs", "sha256")


def documents_later(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The documents' snapshot some time later: of ten files one is gone, one moved, and four changed in one respect each."""
    before = documents_snapshot(spark, sf_dir)
    kind = F.when(F.col("idx") < 0, 9).otherwise(F.col("idx") % 10)
    e = before.entries.where(kind != 0)
    path = F.when(kind == 1, F.regexp_replace("path", r"([^/]+)$", "moved-$1")).otherwise(F.col("path"))
    rows = e.select(
        "idx", path.alias("path"), F.when(kind == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(kind == 2, F.lit(0o755).cast("long")).otherwise(F.col("mode")).alias("mode"),
        F.when(kind == 4, F.col("mtime") + F.make_dt_interval(hours=F.lit(1))).otherwise(F.col("mtime")).alias("mtime"),
    )
    hashes = before.hashes.where(F.col("idx") % 10 != 0).select("idx", F.when((F.col("idx") % 10 == 5) & F.col("hash").isNotNull(), F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    return Snapshot(entries_of(rows), hashes, "/backup/docs", "sha256")


def events_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries live/user/date/type, and a copy of every third user below backup: only files, so parents are implied or dirs.

    Users, dates and the two tops are directories."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").distinct()
    e = materialise(e, "events")  # each level is dealt out from it on its own
    tops = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("live"), F.lit("backup"))).otherwise(F.array(F.lit("live")))
    below = lambda df, *names: df.select(F.concat_ws("/", "top", *(F.col(x).cast("string") for x in names)).alias("path"))
    both = lambda df: df.select("*", F.explode(tops).alias("top"))
    leaf = below(both(e), "user_id", "day", "event_type").withColumn("mode", F.lit(0o644))
    days = below(both(e.where("day IS NOT NULL").select("user_id", "day").distinct()), "user_id", "day")
    users = below(both(e.where("user_id IS NOT NULL").select("user_id").distinct()), "user_id")
    above = days.unionByName(users).unionByName(below(both(e).select("top").distinct()))
    rows = leaf.unionByName(above.withColumn("mode", F.lit(DIR | 0o755)))
    number = F.conv(F.substring(F.sha1("path"), 1, 12), 16, 10).cast("long")
    return entries_of(rows.select(number.alias("idx"), "path", F.lit(1).alias("size"), "mode", F.lit(EPOCH).cast("timestamp").alias("mtime")))


def pages_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per page, named by its url without scheme, query, fragment and last slash."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), "/+$", "")
    return entries_of(p.select(F.col("page_id").alias("idx"), path.alias("path"), F.length("html").alias("size"), F.lit(0o644).alias("mode"), _hours(F.col("page_id")).alias("mtime")))
