"""Totals of a snapshot, duplicate files, integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathgrove.functions.modes import is_dir, is_file
from pathgrove.functions.values import path_id
from pathgrove.sources.shared import materialise
from pathgrove.sources.snapshot import Snapshot, checksum

#: Files of one content that a task numbers at most.
HOT = 100_000


def file_stats(entries: DataFrame) -> DataFrame:
    """Counts of directories and files, and total, largest and mean size of regular files."""
    file = is_file(F.col("mode"))
    size = F.when(file, F.col("size"))
    total = F.coalesce(F.sum(size), F.lit(0))
    return entries.agg(
        F.count_if(is_dir(F.col("mode"))).alias("dir_count"), F.count_if(file).alias("file_count"), total.alias("total_size"), F.coalesce(F.max(size), F.lit(0)).alias("max_size"),
    ).withColumn("avg_size", F.expr("CASE WHEN file_count = 0 THEN 0 ELSE total_size div file_count END"))


def hash_stats(snapshot: Snapshot) -> DataFrame:
    """Computed and pending digests; files, bytes and savable bytes of contents that occur more than once."""
    counts = snapshot.hashes.agg(F.count("hash").alias("hashed"), F.count_if(F.col("hash").isNull()).alias("pending"))
    groups = snapshot.with_hashes().groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max_by("size", "idx").alias("last")).where("n > 1")
    dupes = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("dup_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("dup_bytes"), F.coalesce(F.sum(F.col("bytes") - F.col("last")), F.lit(0)).alias("savable_bytes"),
    )
    return counts.crossJoin(F.broadcast(dupes))  # one row by one row


def duplicate_files(snapshot: Snapshot) -> DataFrame:
    """grp, ord, hash, idx, path, size of files with the same content, without empty ones; groups are numbered by hash, from 0.

    The numbering counts groups of empty files too. Digests are spread evenly, so they are ranked within their first four hex digits
    and each such part adds the count of those before it: only these (65,536 at most) are ever ordered in one task. Files of a content
    are numbered by a window, but for contents of over HOT files: these are numbered within ranges of (hash, idx), so that one is
    spread over tasks, and a range adds the files of those before it."""
    hashed = snapshot.with_hashes()
    groups = hashed.groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("largest")).where("n > 1")
    groups = groups.withColumn("part", F.substring("hash", 1, 4))
    parts = groups.groupBy("part").agg(F.count("*").alias("own"))
    before = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("hash")) - 1
    numbered = groups.withColumn("nth", nth).join(F.broadcast(before), "part").where("largest > 0").select("hash", "n", (F.col("before") + F.col("nth")).alias("grp"))
    numbered = materialise(numbered, "numbered")  # a row per content that occurs more than once
    found = hashed.join(numbered, "hash").select("grp", "hash", "idx", "path", "size", "n")
    within = (F.row_number().over(Window.partitionBy("hash").orderBy("idx")) - 1).cast("long")
    out = found.where(F.col("n") <= HOT).select("grp", within.alias("ord"), "hash", "idx", "path", "size")
    if numbered.where(F.col("n") > HOT).isEmpty():
        return out
    return out.unionByName(_numbered_in_ranges(found.where(F.col("n") > HOT)))


def _numbered_in_ranges(found: DataFrame) -> DataFrame:
    found = materialise(found.repartitionByRange("hash", "idx").withColumn("range", F.spark_partition_id()), "duplicates")
    ranges = found.groupBy("hash", "range").agg(F.count("*").alias("own"))
    earlier = F.sum("own").over(Window.partitionBy("hash").orderBy("range")) - F.col("own")  # a row per range
    within = F.row_number().over(Window.partitionBy("hash", "range").orderBy("idx")) - 1
    numbered = found.withColumn("within", within).join(ranges.select("hash", "range", earlier.alias("earlier")), ["hash", "range"])
    return numbered.select("grp", (F.col("earlier") + F.col("within")).alias("ord"), "hash", "idx", "path", "size")


def content_index(snapshot: Snapshot) -> DataFrame:
    """hash, idx: each computed digest with the smallest index that has it."""
    return snapshot.hashes.where("hash IS NOT NULL").groupBy("hash").agg(F.min("idx").alias("idx"))


def duplicate_totals(dupes: DataFrame) -> DataFrame:
    return dupes.groupBy("grp", "hash").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def pending(snapshot: Snapshot) -> DataFrame:
    return snapshot.pending()


def pending_totals(snapshot: Snapshot) -> DataFrame:
    return pending(snapshot).agg(F.count("*").alias("todo"), F.coalesce(F.sum("size"), F.lit(0)).alias("todo_bytes"))


def check(snapshot: Snapshot, meta: DataFrame) -> DataFrame:
    """check, expected, actual, ok: one row for each integrity constraint of the snapshot."""
    e = snapshot.entries
    now = e.agg(F.count("*").cast("string").alias("entries_count"), F.count_if(is_file(F.col("mode"))).cast("string").alias("file_count"), checksum(e, "idx", "id", "path", "size", "mode", "mtime").cast("string").alias("checksum"))
    wrong_ids = e.agg(F.count_if(F.col("id") != path_id(F.col("path"))).cast("string").alias("wrong_ids"))
    held = meta.select(*[F.col(c).cast("string").alias(f"held_{c}") for c in ("entries_count", "file_count", "checksum")])
    row = now.crossJoin(F.broadcast(wrong_ids)).crossJoin(F.broadcast(held))  # one row each
    checks = [(c, F.col(f"held_{c}"), F.col(c)) for c in ("entries_count", "file_count", "checksum")] + [("wrong_ids", F.lit("0"), F.col("wrong_ids"))]
    if snapshot.hashes is not None:
        files = e.where(is_file(F.col("mode"))).select("idx")
        keys = snapshot.hashes.select(F.col("idx").alias("slot"))
        unequal = files.join(keys, files.idx == keys.slot, "full_outer").agg(F.count_if(F.col("idx").isNull() | F.col("slot").isNull()).cast("string").alias("unmatched_slots"))
        row = row.crossJoin(F.broadcast(unequal))
        checks.append(("unmatched_slots", F.lit("0"), F.col("unmatched_slots")))
    listed = F.array(*[F.struct(F.lit(n).alias("check"), a.alias("expected"), b.alias("actual"), a.eqNullSafe(b).alias("ok")) for n, a, b in checks])
    return row.select(F.explode(listed).alias("c")).select("c.*")


def carry_hashes(new_entries: DataFrame, old: Snapshot, strict: bool = False) -> DataFrame:
    """Hash slots of a rescan, with the old digests of the same ids; strict: only where size and time are the same too."""
    known = old.with_hashes().select("id", "hash", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    known = known.groupBy("id").agg(*[F.max_by(c, "hash").alias(c) for c in ("hash", "old_size", "old_mtime")])
    j = new_entries.where(is_file(F.col("mode"))).join(known, "id", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) if strict else F.lit(True)
    return j.select("idx", "id", F.when(same, F.col("hash")).alias("hash"))
