"""Live trees and hashdeep files as formats of spark.read: ``pathgrove_tree`` and ``pathgrove_hashdeep``.

A tree's columns are those of ``filesystem.scan`` but for the numbering: id, path, size, mode, mtime, mtime_ns. The planner lists directories from
the root down until there are ``partitions`` of them to be walked (option, 256), or none; they are dealt to as many tasks, which walk what is below
with os.scandir and stream rows out. What the planner holds is bounded by that and the widest directory that it lists. A tree most of which
lies below one directory is one task's work for that part: ``filesystem.scan`` deals every level anew.

Conditions on path reach the reader: where nothing below a directory can fulfil ``path = x``, ``path IN (...)``, ``startswith(path, x)`` or ``NOT
startswith(path, x)``, it isn't listed. Spark applies them to the rows all the same. The tree or file must be mounted on every executor and on the driver.

A hashdeep file's columns are size, hash, path; it is read by ranges of ``bytes`` (option, 64 MB), each from its first whole line on.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringStartsWith

from pathgrove.functions.values import path_of

from .filesystem import _row, children
from .schemas import ENTRIES

TREE = ", ".join(c for c in ENTRIES.split(", ") if c.split()[0] not in ("idx", "tz_min"))
HASHDEEP = "size BIGINT, hash STRING, path STRING"
BATCH = 10_000


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let it push filters down to Python sources (spark.sql.python.filterPushdown.enabled)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TreeSource, HashdeepSource):
        spark.dataSource.register(source)


def _needed(options: dict, what: str) -> str:
    if not options.get("path"):
        raise ValueError(f"load() needs the path of a {what}")
    return os.path.abspath(options["path"].removeprefix("file://"))


# trees


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pathgrove_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(_needed(self.options, "directory"), int(self.options.get("partitions", 256)))


@dataclass
class Walk(InputPartition):
    """Directories that were listed before, of which only the children are rows, and others, with all that is below them."""

    listed: list[bytes]
    walked: list[bytes]
    root: bool = False


class TreeReader(DataSourceReader):
    def __init__(self, root: str, width: int):
        self.root, self.width, self.conditions = os.fsencode(root), max(width, 1), []
        if not stat.S_ISDIR(os.stat(self.root).st_mode):
            raise NotADirectoryError(root)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            kinds = (StringStartsWith,) if isinstance(f, Not) else (StringStartsWith, EqualTo, In)
            if isinstance(inner, kinds) and inner.attribute == ("path",):
                self.conditions.append(f)
            yield f

    def may_hold(self, directory: bytes) -> bool:
        """Whether something below a directory can fulfil all conditions."""
        below = "" if directory == b"." else path_of(directory) + "/"

        def ok(f: Filter) -> bool:
            if isinstance(f, Not):
                return not below.startswith(f.child.value)
            if isinstance(f, StringStartsWith):
                return below.startswith(f.value) or f.value.startswith(below)
            return any(isinstance(v, str) and v.startswith(below) for v in (f.value if isinstance(f, In) else [f.value]))

        return all(map(ok, self.conditions))

    def directories(self, of: bytes) -> list[bytes]:
        """Those in a directory that are to be listed."""
        return [row[1] for row in children(self.root, of) if row[3] >> 31 & 1 and self.may_hold(row[1])]

    def partitions(self) -> list[Walk]:
        listed, waiting = [], [b"."] if self.may_hold(b".") else []
        while waiting and len(waiting) < self.width:
            level = [(d, self.directories(d)) for d in waiting]
            listed += [d for d, _ in level]
            waiting = [x for _, inner in level for x in inner]
        n = max(1, min(self.width, max(len(listed), len(waiting))))
        return [Walk(listed[i::n], waiting[i::n], root=i == 0) for i in range(n)]

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = [_row(b".", os.stat(self.root))] if partition.root else []
        waiting = [(d, False) for d in partition.listed] + [(d, True) for d in partition.walked]
        while waiting:
            directory, descend = waiting.pop()
            for row in children(self.root, directory):
                rows.append(row)
                if descend and row[3] >> 31 & 1 and self.may_hold(row[1]):
                    waiting.append((row[1], True))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, raw, size, mode, ns = zip(*rows, strict=True)
    columns = {
        "id": pa.array([sha1(r).hexdigest() for r in raw]), "path": pa.array(path), "size": pa.array(size, pa.int64()), "mode": pa.array(mode, pa.int64()),
        "mtime": pa.array([n // 1000 for n in ns], pa.int64()).cast(pa.timestamp("us", "UTC")), "mtime_ns": pa.array([n % 1000 for n in ns], pa.int16()),
    }
    return pa.RecordBatch.from_pydict(columns)


# hashdeep files


class HashdeepSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pathgrove_hashdeep"

    def schema(self) -> str:
        return HASHDEEP

    def reader(self, schema) -> HashdeepReader:
        return HashdeepReader(_needed(self.options, "file"), int(self.options.get("bytes", 64 << 20)))


@dataclass
class Range(InputPartition):
    start: int
    end: int


class HashdeepReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, max(width, 1)
        with open(path, "rb") as f:
            if f.read(16) != b"%%%% HASHDEEP-1.":
                raise ValueError(f"{path} isn't a hashdeep file")

    def partitions(self) -> list[Range]:
        size = os.stat(self.path).st_size
        return [Range(at, min(at + self.width, size)) for at in range(0, size, self.width)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with open(self.path, "rb") as f:
            if partition.start:  # the line that the byte before belongs to is another range's
                f.seek(partition.start - 1)
                f.readline()
            while f.tell() < partition.end and (line := f.readline()):
                line = line.rstrip(b"\r\n")
                if not line or line.startswith((b"%%", b"##")):
                    continue
                parts = line.split(b",", 2)
                if len(parts) < 3 or not parts[0].isdigit():
                    raise ValueError(f"not a line of a hashdeep file: {path_of(line[:200])!r}")
                rows.append((int(parts[0]), parts[1].decode("ascii"), path_of(parts[2].removeprefix(b"./"))))
                if len(rows) == BATCH:
                    yield _lines(rows)
                    rows = []
        if rows:
            yield _lines(rows)


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    size, digest, path = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"size": pa.array(size, pa.int64()), "hash": pa.array(digest), "path": pa.array(path)})
