"""Comparison of two snapshots: rows, filters, statistics, and what has to be synchronised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathgrove.functions.modes import is_dir
from pathgrove.plans.options import FILTER_BITS, HASH, MODE, MTIME, SIZE, filter_condition
from pathgrove.sources.snapshot import Snapshot


def _side(snapshot: Snapshot, hashed: bool) -> DataFrame:
    """A row per id, the last one written if a path occurs twice."""
    rows = snapshot.with_any_hash() if hashed else snapshot.entries.withColumn("hash", F.lit(None).cast("string"))
    row = F.struct("idx", "path", "size", "mode", "mtime", "mtime_ns", "hash")
    return rows.groupBy("id").agg(F.max_by(row, F.col("idx")).alias("row"))


def diff(left: Snapshot, right: Snapshot, only_left: bool = False, use_hashes: bool | None = None) -> DataFrame:
    """type (left, right, changed, nothing), id, path, is_dir, changed, size: one row per id of either side.

    Digests count when both sides have them by the same algorithm, and only for files whose digest is computed on both."""
    if use_hashes is None:
        use_hashes = left.hashes is not None and right.hashes is not None and left.algo == right.algo
    l, r = _side(left, use_hashes).alias("l"), _side(right, use_hashes).alias("r")
    j = l.join(r, F.col("l.id") == F.col("r.id"), "left_outer" if only_left else "full_outer")
    a, b = F.col("l.row"), F.col("r.row")
    both = a.isNotNull() & b.isNotNull()

    def flag(test: Column, bit: int) -> Column:
        return F.when(test, bit).otherwise(0)

    changed = (
        flag(a.mode != b.mode, MODE).bitwiseOR(flag(a.size != b.size, SIZE)).bitwiseOR(flag((a.mtime != b.mtime) | ~a.mtime_ns.eqNullSafe(b.mtime_ns), MTIME))
        .bitwiseOR(flag(~is_dir(a.mode) & (a.hash != b.hash), HASH))
    )
    shown = F.coalesce(a, b)
    return j.select(
        F.when(b.isNull(), "left").when(a.isNull(), "right").when(changed != 0, "changed").otherwise("nothing").alias("type"),
        F.coalesce("l.id", "r.id").alias("id"), shown.path.alias("path"), is_dir(shown.mode).alias("is_dir"),
        F.when(both, changed).otherwise(0).cast("int").alias("changed"), shown.size.alias("size"),
    )


def filter_mask(df: DataFrame) -> Column:
    """A diff row as filter bits: kind, side and changes."""
    kind = F.when(df.is_dir, FILTER_BITS["d"]).otherwise(FILTER_BITS["f"])
    side = F.when(df.type == "left", FILTER_BITS["-"]).when(df.type == "right", FILTER_BITS["+"]).when(df.type == "changed", FILTER_BITS["~"]).otherwise(0)
    return kind.bitwiseOR(side).bitwiseOR(F.shiftleft(df.changed, 5))


def filtered(rows: DataFrame, include=(), exclude=()) -> DataFrame:
    """Any filter at all drops the unchanged rows."""
    if not include and not exclude:
        return rows
    return rows.where((rows.type != "nothing") & filter_condition(filter_mask(rows), include, exclude))


def code(df: DataFrame) -> Column:
    """d----, f++++, or the changed letters of mslx with ~ for the rest."""
    letters = [F.when(df.changed.bitwiseAND(F.lit(bit)) != 0, letter).otherwise("~") for bit, letter in ((MODE, "m"), (SIZE, "s"), (MTIME, "l"), (HASH, "x"))]
    kind = F.when(df.is_dir, "d").otherwise("f")
    return F.concat(kind, F.when(df.type == "left", "----").when(df.type == "right", "++++").otherwise(F.concat(*letters)))


def report(rows: DataFrame) -> DataFrame:
    """Code and path of every difference: left only, right only, changed, each by path."""
    order = F.when(F.col("type") == "left", 0).when(F.col("type") == "right", 1).otherwise(2)
    return rows.where("type <> 'nothing'").orderBy(order, "path").select(code(rows).alias("code"), "path")


def stats(rows: DataFrame) -> DataFrame:
    has = lambda bit: F.count_if(F.col("changed").bitwiseAND(F.lit(bit)) != 0)
    left, right = F.col("type") == "left", F.col("type") == "right"
    return rows.agg(
        F.count_if(left & ~F.col("is_dir")).alias("left_files"), F.count_if(left & F.col("is_dir")).alias("left_dirs"),
        F.count_if(right & ~F.col("is_dir")).alias("right_files"), F.count_if(right & F.col("is_dir")).alias("right_dirs"),
        F.count_if(F.col("type") == "changed").alias("changed"), F.count_if(F.col("type") == "nothing").alias("not_changed"),
        has(MODE).alias("mode_changed"), has(SIZE).alias("size_changed"), has(MTIME).alias("mtime_changed"), has(HASH).alias("hash_changed"),
    )


def to_sync(left: Snapshot, right: Snapshot, use_hashes: bool = False) -> DataFrame:
    """Files that the right side lacks or has in another size (by path); with use_hashes also in another content."""
    d = diff(left, right, only_left=True, use_hashes=use_hashes)
    wanted = SIZE | HASH if use_hashes else SIZE
    return d.where(~d.is_dir & ((d.type == "left") | (d.changed.bitwiseAND(F.lit(wanted)) != 0))).select("type", "id", "path", "changed", "size")


def to_sync_by_content(left: Snapshot, right: Snapshot) -> DataFrame:
    """One file (of the smallest idx) for each content that the right side has nowhere."""
    if left.hashes is None or right.hashes is None:
        raise ValueError("both snapshots need content digests")
    if left.algo != right.algo:
        raise ValueError(f"different digests: {left.algo} and {right.algo}")
    known = right.hashes.where("hash IS NOT NULL").select("hash")
    missing = left.hashes.where("hash IS NOT NULL").join(known, "hash", "left_anti").groupBy("hash").agg(F.min("idx").alias("idx"))
    return left.entries.join(missing, "idx").select("hash", "idx", "id", "path", "size")


def sync_totals(rows: DataFrame) -> DataFrame:
    """Number and bytes of the files to synchronise."""
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
