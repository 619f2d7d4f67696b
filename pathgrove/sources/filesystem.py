"""A live directory tree as entries, and the content digests of its files.

A name is bytes: its id is the SHA-1 of these, and its path is text from which they can be had back (``values.raw_of``).

A tree is listed level by level: the directories that a level kept are dealt to tasks, which list them with os.scandir and stream
rows out. Each level is a table, so a lost executor costs a part of one level. The tree must be mounted on every executor.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathgrove.functions.modes import CHAR_DEVICE, DEVICE, DIR, IRREGULAR, PIPE, SOCKET, SYMLINK, is_dir
from pathgrove.functions.values import path_of, raw_of
from pathgrove.operators.search import scan_condition
from pathgrove.plans.options import scan_filters

from .shared import materialise

_KINDS = ((stat.S_ISDIR, DIR), (stat.S_ISLNK, SYMLINK), (stat.S_ISFIFO, PIPE), (stat.S_ISSOCK, SOCKET), (stat.S_ISBLK, DEVICE), (stat.S_ISCHR, DEVICE | CHAR_DEVICE))
_FLAGS = ((stat.S_ISUID, 1 << 23), (stat.S_ISGID, 1 << 22), (stat.S_ISVTX, 1 << 20))


def entry_mode(st_mode: int) -> int:
    kind = 0 if stat.S_ISREG(st_mode) else next((bit for test, bit in _KINDS if test(st_mode)), IRREGULAR)
    return kind | st_mode & 0o777 | sum(bit for flag, bit in _FLAGS if st_mode & flag)


_LISTED = "path string, raw binary, size long, mode long, ns long"


def _row(path: bytes, st: os.stat_result) -> tuple:
    return path_of(path), path, st.st_size, entry_mode(st.st_mode), st.st_mtime_ns


def children(root: bytes, directory: bytes) -> Iterator[tuple]:
    """Rows of what directory (relative to root) holds. A directory that can't be listed holds nothing; what has gone since has no row."""
    try:
        listing = os.scandir(os.path.join(root, directory))
    except OSError:
        return
    with listing:
        for x in listing:
            try:
                yield _row(x.name if directory == b"." else directory + b"/" + x.name, x.stat(follow_symlinks=False))
            except FileNotFoundError:
                continue


def scan(spark: SparkSession, root: str, include=(), exclude=(), dry_run: bool = False) -> DataFrame:
    """Entries of the tree at root (or, with dry_run, the paths only, without the default exclusion). Filters are RE2 patterns, as for
    stored snapshots; nothing below a rejected directory is listed. Symbolic links aren't followed. A missing root is an error."""
    root = os.path.abspath(root)
    top = os.fsencode(root)
    kept = scan_condition(**scan_filters(include, exclude), default=not dry_run)

    def run(batches):
        rows: list[tuple] = []
        for pdf in batches:
            for directory in pdf["raw"]:
                for row in children(top, bytes(directory)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "raw", "size", "mode", "ns"])
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["path", "raw", "size", "mode", "ns"])

    if not stat.S_ISDIR(os.stat(top).st_mode):
        raise NotADirectoryError(root)
    levels = [spark.createDataFrame([_row(b".", os.stat(top))], _LISTED)]
    while True:
        directories = levels[-1].where(is_dir(F.col("mode"))).select("raw")
        count = directories.count()
        if not count:
            break
        # some hundred directories a task; one of any size is read as a stream
        listed = directories.repartition(max(1, min(count, spark.sparkContext.defaultParallelism * 4, 10_000))).mapInPandas(run, _LISTED)
        levels.append(materialise(listed.where(kept), "listing"))
    found = reduce(DataFrame.unionByName, levels)
    if dry_run:
        return found.select("path")
    micros = F.timestamp_micros(F.expr("(ns - pmod(ns, 1000)) div 1000"))  # down, before 1970 as well
    return found.select(
        F.monotonically_increasing_id().alias("idx"), F.sha1("raw").alias("id"), "path", "size", "mode", micros.alias("mtime"),
        F.expr("pmod(ns, 1000)").cast("short").alias("mtime_ns"), F.lit(0).cast("short").alias("tz_min"),
    )


#: Files that a task digests before it passes their digests on.
PASSED = 1_000


def digest(files: DataFrame, root: str, algo: str = "sha256") -> DataFrame:
    """idx, id, hash of files (idx, id, path), read in chunks where their partition is; hash is null where a file can't be read."""
    top = os.fsencode(root)

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), PASSED):
                part = pdf.iloc[i : i + PASSED]
                yield pd.DataFrame({"idx": part["idx"], "id": part["id"], "hash": [file_digest(os.path.join(top, raw_of(p)), algo) for p in part["path"]]})

    return files.select("idx", "id", "path").mapInPandas(run, "idx long, id string, hash string")


def file_digest(path: str | bytes, algo: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, algo).hexdigest()
    except OSError:
        return None
