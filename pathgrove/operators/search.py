"""Search: predicates over entries as columns, and the folded condition of all given options."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pathgrove.functions.modes import DEVICE, DIR, PIPE, SOCKET, SYMLINK, all_of, has_bits, is_file, mode_string
from pathgrove.functions.patterns import glob_to_java, re2_to_java
from pathgrove.functions.values import base_name, full_path, parse_size, parse_when, quoted, rfc3339, timestamp_literal
from pathgrove.sources.snapshot import Snapshot

always, never = F.lit, lambda: F.lit(False)


def regex(pattern: str, insensitive: bool = False) -> Column:
    """The pattern matches anywhere in the relative path."""
    return F.col("path").rlike(re2_to_java(pattern, insensitive))


def glob(pattern: str, base_only: bool = True, insensitive: bool = False) -> Column:
    """The pattern matches the whole base name, or the whole path."""
    value = base_name(F.col("path")) if base_only else F.col("path")
    if insensitive:
        value, pattern = F.lower(value), pattern.lower()
    return value.rlike(glob_to_java(pattern))


def type_of(letters: str) -> Column:
    """d, l, p, s combined; f (or nothing) means regular files and makes the others void."""
    masks = {"d": DIR, "l": SYMLINK, "p": PIPE, "s": SOCKET, "b": DEVICE}
    letters = letters.lower()
    if unknown := set(letters) - set(masks) - {"f"}:
        raise ValueError(f"unknown type {sorted(unknown)}")
    if not letters or "f" in letters:
        return is_file(F.col("mode"))
    return has_bits(F.col("mode"), sum(masks[c] for c in set(letters)))


def type_mask(mask: int) -> Column:
    """Any of the given mode bits is set."""
    return has_bits(F.col("mode"), mask)


def func(test: Callable[[pd.DataFrame], pd.Series]) -> Column:
    """A caller's own predicate over batches of (path, size, mode, mtime); the only predicate that leaves the JVM."""

    @F.pandas_udf("boolean")
    def run(path: pd.Series, size: pd.Series, mode: pd.Series, mtime: pd.Series) -> pd.Series:
        return test(pd.DataFrame({"path": path, "size": size, "mode": mode, "mtime": mtime}))

    return run("path", "size", "mode", "mtime")


def size(text: str) -> Column:
    comparison, n = parse_size(text)
    value = F.lit(n).cast("long")
    return {">": F.col("size") > value, "<": F.col("size") < value, "=": F.col("size") == value}[comparison]


def hash_prefix(prefix: str) -> Column:
    return F.col("hash").startswith(prefix.lower())


def id_prefix(prefix: str) -> Column:
    return F.col("id").startswith(prefix.lower())


def before(text: str, now: dt.datetime) -> Column:
    return F.col("mtime") < timestamp_literal(parse_when(text, now))


def after(text: str, now: dt.datetime) -> Column:
    when = timestamp_literal(parse_when(text, now, relative=False))
    return (F.col("mtime") > when) | ((F.col("mtime") == when) & (F.col("mtime_ns") > 0))


def search(snapshot: Snapshot, condition: Column, with_hash: bool = False) -> DataFrame:
    """The entries that match; with_hash: joined with computed digests (needed by conditions on hash)."""
    rows = snapshot.with_hashes() if with_hash else snapshot.entries
    return rows.where(condition)


def listing(snapshot: Snapshot, full: bool = False, with_hash: bool = False) -> DataFrame:
    """Paths only, or all of a row; with hashes only hashed files."""
    if with_hash:
        return snapshot.with_hashes().select("id", "size", full_path(F.lit(snapshot.root), F.col("path")).alias("path"), "mode", "mtime", "hash")
    if full:
        return snapshot.entries.select("id", "size", full_path(F.lit(snapshot.root), F.col("path")).alias("path"), "mode", "mtime")
    return snapshot.entries.select("path")


def found_lines(rows: DataFrame, root: str | None = None, minimal: bool = False) -> DataFrame:
    """idx, line: found entries as they are printed, {id}, size, "path", mode, time, with the digest behind the id if rows have it; minimal:
    the path, or digest and path. root: for full paths."""
    path = F.col("path") if root is None else full_path(F.lit(root), F.col("path"))
    hashed = [F.col("hash")] if "hash" in rows.columns else []
    if minimal:
        line = F.concat_ws(", ", *hashed, quoted(path)) if hashed else path
    else:
        when = rfc3339(F.col("mtime"), F.col("mtime_ns"))
        line = F.concat_ws(", ", F.concat(F.lit("{"), "id", F.lit("}")), *hashed, F.col("size").cast("string"), quoted(path), mode_string(F.col("mode")), when)
    return rows.select("idx", line.alias("line"))


#: Fixed value: the file name that scans leave out by default.
EXCLUDED = ".DS_Store"


def scan_condition(include_files=(), include_dirs=(), exclude_files=(), exclude_dirs=(), default: bool = True) -> Column:
    """What a scan keeps of path and mode, for itself: exclusion wins over inclusion, the root always stays. default: EXCLUDED goes."""

    def hit(patterns):
        return ~all_of([~regex(p) for p in patterns])

    def ok(include, exclude):
        return (hit(include) if include else F.lit(True)) & (~hit(exclude) if exclude else F.lit(True))

    by_kind = F.when(has_bits(F.col("mode"), DIR), ok(include_dirs, exclude_dirs)).otherwise(ok(include_files, exclude_files))
    return (F.col("path") == ".") | (((base_name(F.col("path")) != EXCLUDED) | F.lit(not default)) & by_kind)


def kept_by_filters(entries: DataFrame, include_files=(), include_dirs=(), exclude_files=(), exclude_dirs=()) -> DataFrame:
    """Scan filters on a stored snapshot: a rejected directory takes all below it along."""
    ok = scan_condition(include_files, include_dirs, exclude_files, exclude_dirs)
    rejected = entries.where(has_bits(F.col("mode"), DIR) & ~ok).select(F.col("path").alias("ancestor"))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = entries.select("idx", F.explode(ancestors).alias("ancestor")).join(rejected, "ancestor", "left_semi").select("idx").distinct()
    return entries.where(ok).join(below, "idx", "left_anti")
