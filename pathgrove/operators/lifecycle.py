"""Scan, resume, update, fix and comparison of stored snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathgrove.operators import diff, stats
from pathgrove.plans import dealing
from pathgrove.sources import filesystem, snapshot as store
from pathgrove.sources.shared import release
from pathgrove.sources.snapshot import Snapshot


def scan(spark: SparkSession, root: str, path: str, algo: str | None = None, force: bool = False, include=(), exclude=(), hash_now: bool = True) -> Snapshot:
    """Walk root into a new snapshot at path, with content digests if an algorithm is given. A scan that fails leaves no snapshot;
    one that fails while digests are computed keeps those it has, and leaves the others pending, for resume."""
    if not force and store.revisions(spark, path):
        raise FileExistsError(f"{path} already exists")
    stored = store.write(Snapshot(filesystem.scan(spark, root, include, exclude), None, root, None), path, force)
    if algo:
        stored = store.with_slots(spark, path, store.hash_slots(stored.entries), algo, store.current(spark, path))
        if hash_now:
            return resume(spark, path)
    return stored


@dataclass(frozen=True)
class Progress:
    """What is done after a round of digests, and what there was to do."""

    rounds: int
    tasks: int
    files: int
    bytes: int
    all_tasks: int
    all_files: int
    all_bytes: int


def resume(spark: SparkSession, path: str, task_bytes: int = dealing.TASK_BYTES, tasks: int | None = None, on_round: Callable[[Progress], None] | None = None) -> Snapshot:
    """Compute the digests that are pending; the ones that fail stay pending.

    Files are dealt to tasks by bytes, and tasks to rounds (``tasks`` of them, four for each core unless told otherwise). Each round
    appends its digests to the snapshot's log, where they count at once: a run that is killed loses its current round, and the next
    one goes on with what isn't in the log. At the end the log is folded into the hashes table. on_round hears of each round."""
    stored = store.read(spark, path)
    if stored.hashes is None:
        raise ValueError("Nothing to resume")
    log = store.current(spark, path)["log_table"]
    dealt, count = dealing.deal(stored.pending().select("idx", "id", "path", "size"), task_bytes)
    width = tasks or 4 * spark.sparkContext.defaultParallelism
    done = Progress(0, 0, 0, 0, count, *_amount(dealt))
    for first in range(0, count, width):
        now = dealt.where((F.col("task") >= first) & (F.col("task") < first + width))
        store.append_digests(filesystem.digest(now.repartitionById(width, (F.col("task") - first).cast("int")), stored.root, stored.algo), path, log)
        if on_round:
            files, size = _amount(now)
            done = replace(done, rounds=done.rounds + 1, tasks=min(first + width, count), files=done.files + files, bytes=done.bytes + size)
            on_round(done)
    release(dealt)
    return store.compact(spark, path)


def _amount(files: DataFrame) -> tuple[int, int]:
    return tuple(files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())


def update(spark: SparkSession, old_path: str, new_path: str, strict: bool = False, include=(), exclude=()) -> Snapshot:
    """A new version of a snapshot: rescan, carry over known digests by path, compute the others. The old one stays, and if the update
    fails while digests are computed, the new one has the carried digests and the others pending."""
    old = store.read(spark, old_path)
    fresh = scan(spark, old.root, new_path, include=include, exclude=exclude)
    if old.hashes is None:
        return fresh
    store.with_slots(spark, new_path, stats.carry_hashes(fresh.entries, old, strict), old.algo, store.current(spark, new_path))
    return resume(spark, new_path)


def check_ranges(spark: SparkSession, path: str) -> DataFrame:
    """part, range, expected_rows, actual_rows: the ranges of ids in which a stored snapshot isn't what was committed; none if it is whole."""
    row = store.current(spark, path)
    return store.damaged_ranges(store.sums(spark, path, row), *store.parts(spark, path, row))


def fix(spark: SparkSession, path: str, dry_run: bool = False) -> DataFrame:
    """The failed checks; without dry_run, a revision follows whose meta row and checksums fit the tables. Only ranges that are damaged
    are summed again."""
    stored, now = store.read(spark, path), store.current(spark, path)
    checked = stats.check(stored, store.meta(spark, path)).where("NOT ok")
    failed = spark.createDataFrame(checked.collect(), checked.schema)  # a row per failed constraint, before meta changes
    if not dry_run:
        tables = {"root": now["root"]} | {k: now[k] for k in ("hash_algo", "entries_table", "hashes_table", "log_table", "buckets", "sums_table")}
        ranges = [r["range"] for r in check_ranges(spark, path).select("range").distinct().collect()]  # 4096 at most
        if ranges:
            held = store.sums(spark, path, now).where(~F.col("range").isin(ranges))
            again = [None if t is None else store.in_ranges(t, ranges) for t in store.parts(spark, path, now)]
            tables["sums_table"] = store.put_sums(held.unionByName(store.range_sums(*again)), path)
        store.commit(spark, path, tables, now["revision"])
    return failed


def restore(spark: SparkSession, path: str) -> None:
    """Take back the last change: the meta row before the newest one becomes a new revision."""
    numbers = store.revisions(spark, path)
    if len(numbers) < 2:
        raise ValueError("Nothing to restore")
    before = store.revision_rows(spark, path, [numbers[-2]])[0]
    store.put_revision(spark, path, before.asDict(), numbers[-1])


def side(spark: SparkSession, path: str) -> Snapshot:
    """What path is as a side of a comparison: a stored snapshot, or else a live directory."""
    return store.read(spark, path) if store.revisions(spark, path) else Snapshot(filesystem.scan(spark, path), None, path, None)


def compare(spark: SparkSession, left: str, right: str | None = None) -> DataFrame:
    """The diff of two sides; without a right one, of a snapshot and the live tree it was taken of."""
    a = side(spark, left)
    return diff.diff(a, side(spark, a.root if right is None else right))


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row: the meta row, whether the tables fit its checksum, and the totals of files and digests."""
    stored, meta = store.read(spark, path), store.meta(spark, path)
    fits = stats.check(stored, meta).where("check = 'checksum'").select(F.col("ok").alias("checksum_ok"))
    out = meta.crossJoin(F.broadcast(fits)).crossJoin(F.broadcast(stats.file_stats(stored.entries).drop("file_count")))  # one row each
    return out if stored.hashes is None else out.crossJoin(F.broadcast(stats.hash_stats(stored)))
