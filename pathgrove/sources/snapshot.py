"""Snapshots as folders of Parquet: meta, entries (a row per path), hashes (a row per regular file, null: pending), digest logs.

Tables are never changed once written. meta is a log of revisions, a file each, and the newest one names the tables that hold now. A
revision's file is created exclusively: of two writers one gets the number, and the other one is told (``ConcurrentChange``) or takes
the next. A crash before that leaves the snapshot as it was.

Layout. Entries and hashes are bucketed and sorted by id, with Bloom filters on idx: a read by id opens one bucket, a read by idx the
row groups whose filter has it, and two snapshots are compared bucket by bucket without a shuffle. Buckets are known to Spark's
catalogue only, so opening a snapshot declares its tables there as external ones, by a name that folder and table give.

Digest log. Digests that are computed are appended in rounds to the log that the revision names, a folder per round; they count at
once, whatever happens to the run. ``compact`` folds the log into a new hashes table.

Checksums. Each revision has a table of checksums for every range of ids (their first three hex digits), so that damage is found by its
range, and read and mended there: the tables are sorted by id, so a range is a few row groups.
"""

from __future__ import annotations

import hashlib
import platform
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from pathgrove.functions.modes import is_file

from . import schemas
from .shared import claim, listed, remove

#: Rows of a bucket; buckets at least; a power of 2, as Spark can join buckets of a multiple.
BUCKET_ROWS, BUCKETS = 1_000_000, 8


class ConcurrentChange(RuntimeError):
    """Another writer has made a revision in the meantime."""


@dataclass
class Snapshot:
    entries: DataFrame
    hashes: DataFrame | None = None
    root: str = "/"
    algo: str | None = None

    def _joined(self, hashes: DataFrame, how: str) -> DataFrame:
        """By id where stored hashes have it: both sides are bucketed by id. The index tells rows of a repeated path apart, in a form
        that is no join key, as it would ask for another partitioning."""
        if "id" not in hashes.columns:
            return self.entries.join(hashes, "idx", how)
        e, h = self.entries.alias("e"), hashes.alias("h")
        return e.join(h, (F.col("e.id") == F.col("h.id")) & (F.col("e.idx") - F.col("h.idx") == 0), how).select("e.*", "h.hash")

    def with_hashes(self) -> DataFrame:
        """Entries with their computed digests; directories and pending files drop out."""
        if self.hashes is None:
            return self.entries.withColumn("hash", F.lit(None).cast("string")).limit(0)
        return self._joined(self.hashes.where("hash IS NOT NULL"), "inner")

    def with_any_hash(self) -> DataFrame:
        """All entries, with a null hash where there is none."""
        if self.hashes is None:
            return self.entries.withColumn("hash", F.lit(None).cast("string"))
        return self._joined(self.hashes, "left")

    def pending(self) -> DataFrame:
        """The entries whose digest isn't computed."""
        return self._joined(self.hashes.where("hash IS NULL"), "inner").drop("hash")

    def by_index(self, idx: int) -> DataFrame:
        return self.entries.where(F.col("idx") == idx)

    def by_id(self, id: str) -> DataFrame:
        return self.entries.where(F.col("id") == id)


def checksum(df: DataFrame, *columns: str) -> Column:
    """An order-free content checksum: the sum of the rows' CRC-32."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.coalesce(F.sum(F.crc32(F.concat_ws("\x1f", *text).cast("binary")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


#: Columns that a checksum covers.
_ENTRY, _HASH, RANGE = ("idx", "id", "path", "size", "mode", "mtime"), ("idx", "hash"), 3


def range_sums(entries: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """part (entries, hashes), range, rows, files, checksum of every range of ids that has rows."""
    part = F.substring("id", 1, RANGE).alias("range")
    out = entries.groupBy(part).agg(F.count("*").alias("rows"), F.count_if(is_file(F.col("mode"))).alias("files"), checksum(entries, *_ENTRY).alias("checksum")).withColumn("part", F.lit("entries"))
    if hashes is not None:
        found = hashes.groupBy(part).agg(F.count("*").alias("rows"), F.count("hash").alias("files"), checksum(hashes, *_HASH).alias("checksum"))
        out = out.unionByName(found.withColumn("part", F.lit("hashes")))
    return out.select("part", "range", "rows", "files", "checksum")


def damaged_ranges(sums: DataFrame, entries: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """part, range, expected_rows, actual_rows of the ranges whose rows aren't those that sums has."""
    held, now = sums.alias("h"), range_sums(entries, hashes).alias("n")
    same = (F.col("h.part") == F.col("n.part")) & (F.col("h.range") == F.col("n.range"))
    fits = F.col("h.rows").eqNullSafe(F.col("n.rows")) & F.col("h.checksum").eqNullSafe(F.col("n.checksum")) & F.col("h.files").eqNullSafe(F.col("n.files"))
    rows = lambda side: F.coalesce(f"{side}.rows", F.lit(0).cast("long"))
    return held.join(now, same, "full_outer").where(~fits).select(
        F.coalesce("h.part", "n.part").alias("part"), F.coalesce("h.range", "n.range").alias("range"), rows("h").alias("expected_rows"), rows("n").alias("actual_rows")
    )


def in_ranges(rows: DataFrame, ranges: list[str]) -> DataFrame:
    """The rows of these ranges, by bounds of id that reach the scan."""
    test = F.lit(False)
    for r in ranges:
        test |= (F.col("id") >= r) & (F.col("id") < r + "g")  # behind all hex digits
    return rows.where(test)


def describe(snapshot: Snapshot, sums: DataFrame | None = None) -> DataFrame:
    """The meta row that fits the entries and hashes; sums: their range_sums, if they are known."""
    sums = (range_sums(snapshot.entries, None) if sums is None else sums).where("part = 'entries'")
    zero = lambda c, kind: F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)
    return sums.agg(
        zero("rows", "long").alias("entries_count"), zero("files", "long").alias("file_count"), zero("checksum", "decimal(38,0)")
    ).select(
        F.lit(1).alias("version"), F.lit(snapshot.root).alias("root"), F.lit("pathgrove").alias("tool"), F.lit(platform.system().lower()).alias("os"),
        F.lit(platform.machine()).alias("arch"), F.current_timestamp().alias("created_at"), F.lit(schemas.FEATURE_HASHES if snapshot.hashes is not None else 0).alias("features"),
        F.lit(snapshot.algo).cast("string").alias("hash_algo"), "entries_count", "file_count", "checksum",
    )


# revisions


def _file(revision: int) -> str:
    return f"rev-{revision:010d}.parquet"


def revisions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a snapshot's revisions, ascending."""
    return sorted(int(n[4:14]) for n, _ in listed(spark, f"{path}/meta") if n.startswith("rev-"))


def revision_rows(spark: SparkSession, path: str, numbers: list[int]) -> list[Row]:
    """The meta rows of these revisions, newest first."""
    if not numbers:
        return []
    return spark.read.schema(schemas.META).parquet(*[f"{path}/meta/{_file(n)}" for n in numbers]).orderBy(F.desc("revision")).collect()  # a row each


def current(spark: SparkSession, path: str) -> Row | None:
    """The newest meta row, None if path isn't a (finished) snapshot."""
    return next(iter(revision_rows(spark, path, revisions(spark, path)[-1:])), None)


def meta(spark: SparkSession, path: str) -> DataFrame:
    """The newest meta row as a table."""
    row = current(spark, path)
    return spark.createDataFrame([] if row is None else [row], schemas.META)


def put_revision(spark: SparkSession, path: str, row: dict, base: int | None = None) -> int:
    """Store a meta row as the newest revision and return its number. base: the revision that it follows from; if that isn't the newest
    one any more, ConcurrentChange is raised. Without base it takes the next number that is free."""
    while True:
        newest = (revisions(spark, path) or [0])[-1]
        if base is not None and newest != base:
            raise ConcurrentChange(f"{path} is at revision {newest}, not {base}")
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        values = row | {"revision": newest + 1}
        spark.createDataFrame([tuple(values[c.split()[0]] for c in schemas.META.split(", "))], schemas.META).coalesce(1).write.parquet(staged)
        part = next(n for n, _ in listed(spark, staged) if n.startswith("part-"))
        done = claim(spark, f"{staged}/{part}", f"{path}/meta/{_file(newest + 1)}")
        remove(spark, staged)
        if done:
            return newest + 1


# tables


def _declared(path: str, table: str) -> str:
    return f"pathgrove_{hashlib.sha1(path.encode()).hexdigest()[:12]}_{table.replace('-', '_')}"


def buckets_for(rows: int) -> int:
    n = BUCKETS
    while n * BUCKET_ROWS < rows:
        n *= 2
    return n


def put(df: DataFrame, path: str, name: str, buckets: int) -> str:
    """Write a table of a snapshot, a file per bucket; its name."""
    table = f"{name}-{uuid.uuid4().hex}"
    rows = df.repartition(buckets, "id").write.format("parquet").option("path", f"{path}/{table}")
    rows.option("parquet.bloom.filter.enabled#idx", "true").bucketBy(buckets, "id").sortBy("id").saveAsTable(_declared(path, table))
    return table


def _opened(spark: SparkSession, path: str, table: str, schema: str, buckets: int) -> DataFrame:
    name = _declared(path, table)
    where = f"{path}/{table}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def logged(spark: SparkSession, path: str, log: str | None) -> DataFrame | None:
    """idx, id, hash of a digest log, None while it is empty."""
    rounds = [n for n, _ in listed(spark, f"{path}/{log}")] if log else []
    done = [n for n in rounds if any(x.startswith("part-") for x, _ in listed(spark, f"{path}/{log}/{n}"))]
    return spark.read.schema(schemas.HASHES).parquet(*[f"{path}/{log}/{n}" for n in done]) if done else None


def append_digests(digests: DataFrame, path: str, log: str) -> None:
    """One round of the log: idx, id, hash of files that were digested. A round has a folder of its own, so that runs don't meet."""
    digests.where("hash IS NOT NULL").select("idx", "id", "hash").write.parquet(f"{path}/{log}/round-{uuid.uuid4().hex}")


def open_revision(spark: SparkSession, path: str, row: Row | dict) -> Snapshot:
    hashes = None
    if row["hashes_table"]:
        hashes = _opened(spark, path, row["hashes_table"], schemas.HASHES, row["buckets"])
        found = logged(spark, path, row["log_table"])
        if found is not None:  # runs that overlap may log a file twice
            found = found.groupBy("id", F.col("idx").alias("at")).agg(F.max("hash").alias("found"))
            hashes = hashes.join(found, (hashes.id == found.id) & (hashes.idx - found.at == 0), "left").select(hashes.idx, hashes.id, F.coalesce(hashes.hash, "found").alias("hash"))
    return Snapshot(_opened(spark, path, row["entries_table"], schemas.ENTRIES, row["buckets"]), hashes, row["root"], row["hash_algo"])


def parts(spark: SparkSession, path: str, row: Row | dict) -> tuple[DataFrame, DataFrame | None]:
    """The tables of entries and hashes as they are stored, without the log."""
    hashes = _opened(spark, path, row["hashes_table"], schemas.HASHES, row["buckets"]) if row["hashes_table"] else None
    return _opened(spark, path, row["entries_table"], schemas.ENTRIES, row["buckets"]), hashes


def sums(spark: SparkSession, path: str, row: Row | dict) -> DataFrame:
    return spark.read.schema(schemas.SUMS).parquet(f"{path}/{row['sums_table']}")


def put_sums(found: DataFrame, path: str) -> str:
    """Write a revision's checksums (some thousand rows); the table's name."""
    table = f"sums-{uuid.uuid4().hex}"
    found.coalesce(1).write.parquet(f"{path}/{table}")
    return table


def commit(spark: SparkSession, path: str, tables: dict, base: int | None = None) -> Snapshot:
    """Make a revision of tables: root, hash_algo, entries_table, hashes_table, log_table, buckets, and sums_table, if it is written."""
    stored = open_revision(spark, path, tables)
    if not tables.get("sums_table"):
        tables = tables | {"sums_table": put_sums(range_sums(*parts(spark, path, tables)), path)}
    put_revision(spark, path, describe(stored, sums(spark, path, tables)).first().asDict() | tables, base)
    return stored


def with_slots(spark: SparkSession, path: str, hashes: DataFrame, algo: str, base: Row) -> Snapshot:
    """A revision with other hashes (idx, id, hash) and an empty log."""
    tables = {k: base[k] for k in ("root", "entries_table", "buckets")}
    tables |= {"hash_algo": algo, "hashes_table": put(hashes, path, "hashes", base["buckets"]), "log_table": f"log-{uuid.uuid4().hex}"}
    return commit(spark, path, tables, base["revision"])


def compact(spark: SparkSession, path: str) -> Snapshot:
    """Fold the digest log into a new hashes table; without a log, nothing changes."""
    row = current(spark, path)
    stored = open_revision(spark, path, row)
    return stored if logged(spark, path, row["log_table"]) is None else with_slots(spark, path, stored.hashes, row["hash_algo"], row)


def write(snapshot: Snapshot, path: str, force: bool = False) -> Snapshot:
    """Write a snapshot; fails if there is one, unless force. What an unfinished write left behind is no snapshot."""
    spark = snapshot.entries.sparkSession
    if not force and revisions(spark, path):
        raise FileExistsError(f"{path} already exists")
    buckets = buckets_for(snapshot.entries.count())
    tables = {"root": snapshot.root, "hash_algo": snapshot.algo, "entries_table": put(snapshot.entries, path, "entries", buckets), "hashes_table": None, "log_table": None, "buckets": buckets}
    if snapshot.hashes is not None:
        hashes = snapshot.hashes if "id" in snapshot.hashes.columns else snapshot.hashes.join(snapshot.entries.select("idx", "id"), "idx")
        tables |= {"hashes_table": put(hashes.select("idx", "id", "hash"), path, "hashes", buckets), "log_table": f"log-{uuid.uuid4().hex}"}
    try:
        return commit(spark, path, tables, None if force else 0)
    except ConcurrentChange as e:
        raise FileExistsError(f"{path} already exists") from e


def read(spark: SparkSession, path: str) -> Snapshot:
    row = current(spark, path)
    if row is None or row["version"] != 1:
        raise ValueError(f"{path} isn't a snapshot of a known version")
    return open_revision(spark, path, row)


def vacuum(spark: SparkSession, path: str, keep: int = 2, grace: float = 86_400) -> list[str]:
    """Remove revisions but the newest ``keep`` ones, and the tables and logs that none of these names, if nothing in them has changed for
    ``grace`` seconds (a writer may not have committed them yet). Readers of a kept revision aren't affected. Returns the names."""
    numbers = revisions(spark, path)
    kept = revision_rows(spark, path, numbers[-max(1, keep) :])
    named = {r[k] for r in kept for k in ("entries_table", "hashes_table", "log_table", "sums_table")} | {"meta"}
    gone = [f"meta/{_file(n)}" for n in numbers[: -max(1, keep)]]
    for name, changed in listed(spark, path):
        inside = [t for _, t in listed(spark, f"{path}/{name}")] if name.startswith("log-") else []
        if name not in named and not name.startswith(".") and time.time() - max([changed, *inside]) / 1000 >= grace:
            gone.append(name)
    for name in gone:
        remove(spark, f"{path}/{name}")
        if not name.startswith(("meta/", "log-", "sums-", "_")):
            spark.sql(f"DROP TABLE IF EXISTS {_declared(path, name)}")
    return gone


def hash_slots(entries: DataFrame) -> DataFrame:
    """The empty hash table: a pending row per regular file."""
    return entries.where(is_file(F.col("mode"))).select("idx", "id", F.lit(None).cast("string").alias("hash"))
