"""Export of a snapshot as CSV, JSON or hashdeep, and the hashdeep reader.

An export is a folder whose every file is complete in its format (``write``), or one file in the order of idx (``write_file``). One
file is written by many tasks: rows are sorted into ranges, the sizes of the ranges give each its offset, and a task writes the bytes of
its range there, so nothing holds the whole. A task that runs again writes the same bytes to the same place. The file gets its name when
it is complete; its folder must be mounted on every executor, as a scan's root.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from pathgrove.functions.modes import is_dir, mode_string
from pathgrove.functions.values import full_path, raw_of, rfc3339
from pathgrove.sources.shared import materialise, release
from pathgrove.sources.snapshot import Snapshot


def csv_rows(snapshot: Snapshot) -> DataFrame:
    """Id, Size, Mode, ModTime, IsDir, Hash (if the snapshot has digests), Path."""
    rows = snapshot.with_any_hash()
    hashed = [F.coalesce("hash", F.lit("")).alias(f"Hash ({snapshot.algo})")] if snapshot.hashes is not None else []
    return rows.select(
        F.col("id").alias("Id"), F.col("size").alias("Size"), mode_string(F.col("mode")).alias("Mode"), rfc3339(F.col("mtime"), F.col("mtime_ns")).alias("ModTime"),
        is_dir(F.col("mode")).alias("IsDir"), *hashed, full_path(F.lit(snapshot.root), F.col("path")).alias("Path"),
    )


def write_csv(snapshot: Snapshot, path: str) -> None:
    """A folder of CSV parts, each with the header; fails if there is one."""
    csv_rows(snapshot).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def json_rows(snapshot: Snapshot) -> DataFrame:
    """One JSON document per entry; an absent digest is left out."""
    row = F.struct(
        "id", full_path(F.lit(snapshot.root), F.col("path")).alias("path"), "size", "mode", mode_string(F.col("mode")).alias("modeStr"),
        rfc3339(F.col("mtime"), F.col("mtime_ns")).alias("modTime"), is_dir(F.col("mode")).alias("isDir"), "hash",
    )
    return snapshot.with_any_hash().select(F.to_json(row).alias("value"))


def _framed(rows: DataFrame, head: list[str], tail: list[str], comma: bool = False) -> DataFrame:
    """The lines of rows (value) with head and tail around those of each partition; comma: between rows."""

    def run(batches):
        first = True
        lines = lambda x: pa.RecordBatch.from_pydict({"value": pa.array(x, pa.string())})
        yield lines(head)
        for b in batches:
            found = b.column(0).to_pylist()
            if comma:
                found = [v if first and not i else "," + v for i, v in enumerate(found)]
                first = first and not found
            yield lines(found)
        yield lines(tail)

    return rows.select("value").mapInArrow(run, "value string")


def write_json(snapshot: Snapshot, meta: DataFrame, path: str) -> None:
    """A folder of JSON documents {database, entries}, each with a part of the entries; fails if there is one."""
    database = meta.select(F.to_json(F.struct("*"))).first()[0]  # one row
    _framed(json_rows(snapshot), [f'{{"database":{database},"entries":['], ["]}"], comma=True).write.mode("errorifexists").text(path)


def hashdeep_rows(snapshot: Snapshot) -> DataFrame:
    """size,hash,./path of hashed files; SHA-1 and SHA-256 only."""
    if snapshot.algo not in ("sha1", "sha256"):
        raise ValueError(f"hashdeep has no {snapshot.algo}")
    return snapshot.with_hashes().select(F.concat_ws(",", F.col("size").cast("string"), "hash", F.concat(F.lit("./"), "path")).alias("value"))


def write_hashdeep(snapshot: Snapshot, path: str) -> None:
    """A folder of hashdeep files, each with a part of the rows; fails if there is one."""
    head = ["%%%% HASHDEEP-1.0", f"%%%% size,{snapshot.algo},filename", f"## Invoked from: {snapshot.root}", "## $ pathgrove export", "##"]
    _framed(hashdeep_rows(snapshot), head, []).write.mode("errorifexists").text(path)


def write(snapshot: Snapshot, meta: DataFrame, path: str, form: str = "csv") -> None:
    """Export as "csv", "json" or "hashdeep"."""
    if form == "csv":
        write_csv(snapshot, path)
    elif form == "json":
        write_json(snapshot, meta, path)
    elif form == "hashdeep":
        write_hashdeep(snapshot, path)
    else:
        raise ValueError(f"no export as {form}")


def read_hashdeep(spark: SparkSession, path: str) -> DataFrame:
    """size, hash, path of a hashdeep file; a path may hold commas."""
    rows = spark.read.text(path, recursiveFileLookup=True).where(~F.col("value").startswith("%%") & ~F.col("value").startswith("##") & (F.col("value") != ""))
    parts = F.split("value", ",", 3)
    return rows.select(parts[0].cast("long").alias("size"), parts[1].alias("hash"), F.regexp_replace(parts[2], r"^\./", "").alias("path"))


# one file


def _shown(snapshot: Snapshot, full: bool) -> Column:
    return full_path(F.lit(snapshot.root), F.col("path")) if full else F.col("path")


def csv_lines(snapshot: Snapshot, full: bool = False) -> tuple[str, DataFrame, str]:
    """Head, rows (idx, text) and tail. Quotes stand around fields with a comma, a quote or a line break, or a space at the start."""
    names = ["Id", "Size", "Mode", "ModTime", "IsDir", *([f"Hash ({snapshot.algo})"] if snapshot.hashes is not None else []), "Path"]
    path = _shown(snapshot, full)
    path = F.when(path.rlike(r'[,"\r\n]|^[ \t]|^\\\.$'), F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(path)
    hashed = [F.coalesce("hash", F.lit(""))] if snapshot.hashes is not None else []
    fields = [F.col("id"), F.col("size").cast("string"), mode_string(F.col("mode")), rfc3339(F.col("mtime"), F.col("mtime_ns")), is_dir(F.col("mode")).cast("string"), *hashed, path]
    return ",".join(names) + "\n", snapshot.with_any_hash().select("idx", F.concat(F.concat_ws(",", *fields), F.lit("\n")).alias("text")), ""


#: Characters that JSON for the web has escaped besides those that it must.
WEB = {"<": r"\u003c", ">": r"\u003e", "&": r"\u0026", "\u2028": r"\u2028", "\u2029": r"\u2029"}


def _json_text(text: Column) -> Column:
    """text as a JSON string."""
    out = F.to_json(F.struct(text.alias("t")))
    out = F.substring(out, F.lit(6), F.length(out) - 6)  # within {"t":}
    for char, escaped in WEB.items():
        out = F.replace(out, F.lit(char), F.lit(escaped))
    return out


def json_lines(snapshot: Snapshot, meta: Row, path: str, full: bool = False) -> tuple[str, DataFrame, str]:
    """Head, rows (idx, text) and tail of a document {database, entries}, indented by tabs; path: where the snapshot is stored. Rows
    stand in the order of idx, and commas behind all but the last."""
    created = meta["created_at"].isoformat(timespec="microseconds" if meta["created_at"].microsecond else "seconds") + "Z"
    database = {
        "version": meta["version"], "dbPath": path, "root": meta["root"], "features": meta["features"], "entriesCount": meta["entries_count"], "fileCount": meta["file_count"],
        "meta": {"tool": meta["tool"], "os": meta["os"], "arch": meta["arch"], "createdAt": created},
    }
    if snapshot.algo:
        database["hashTableAlgo"] = snapshot.algo
    head = '{\n\t"database": ' + json.dumps(database, indent="\t", ensure_ascii=False).replace("\n", "\n\t") + ',\n\t"entries": [\n\t\t'
    for char, escaped in WEB.items():
        head = head.replace(char, escaped)
    rows = snapshot.with_any_hash()
    last = rows.agg(F.max("idx")).first()[0]  # one number
    fields = {
        "id": _json_text(F.col("id")), "path": _json_text(_shown(snapshot, full)), "size": F.col("size").cast("string"), "mode": F.col("mode").cast("string"),
        "modeStr": _json_text(mode_string(F.col("mode"))), "modTime": _json_text(rfc3339(F.col("mtime"), F.col("mtime_ns"))),
    }
    lines = [F.concat(F.lit(f'\t\t\t"{k}": '), v) for k, v in fields.items()]
    hashed = F.when(F.col("hash").isNotNull(), F.concat(F.lit('\t\t\t"hash": "'), "hash", F.lit('"')))  # a null is left out by concat_ws
    end = F.when(F.col("idx") == last, "\n\t\t}").otherwise("\n\t\t},\n\t\t")
    return head, rows.select("idx", F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines, hashed), end).alias("text")), "\n\t]\n}\n"


def hashdeep_lines(snapshot: Snapshot, path: str, full: bool = False) -> tuple[str, DataFrame, str]:
    """Head, rows (idx, text) and tail; path: where the snapshot is stored."""
    if snapshot.algo not in ("sha1", "sha256"):
        raise ValueError(f"hashdeep has no {snapshot.algo}")
    head = f"%%%% HASHDEEP-1.0\n%%%% size,{snapshot.algo},filename\n## Generated by: pathgrove export {path}\n## Invoked from: {snapshot.root}\n##\n"
    shown = _shown(snapshot, full) if full else F.concat(F.lit("./"), "path")
    return head, snapshot.with_hashes().select("idx", F.concat(F.concat_ws(",", F.col("size").cast("string"), "hash", shown), F.lit("\n")).alias("text")), ""


def _placed(head: int, rows: DataFrame) -> tuple[DataFrame, int]:
    """range, idx, raw, offset: the bytes of each row (in UTF-8, or as they are in a name that isn't) in ranges of idx, and where the range
    begins behind head bytes; the end of the last one."""

    def encoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw_of(t) for t in b.column(1).to_pylist()], pa.binary())], ["idx", "raw"])

    raw = rows.select("idx", "text").mapInArrow(encoded, "idx long, raw binary")
    ranged = materialise(raw.repartitionByRange("idx").withColumn("range", F.spark_partition_id()), "export")
    sizes = ranged.groupBy("range").agg(F.sum(F.octet_length("raw")).alias("own"))  # a row per partition
    offsets = sizes.select("range", (F.lit(head) + F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
    end = head + (sizes.agg(F.sum("own")).first()[0] or 0)
    out = ranged.join(F.broadcast(offsets), "range")
    out._written_to = ranged._written_to
    return out, end


def _put_ranges(placed: DataFrame, target: str) -> int:
    """Write each range at its offset; how many bytes were written."""

    def run(batches):
        of, file, done = None, None, 0
        try:
            for b in batches:
                for range_, offset, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if range_ != of:
                        if file:
                            file.close()
                        of, file = range_, open(target, "r+b")  # noqa: SIM115
                        file.seek(offset)
                    file.write(raw)
                    done += len(raw)
        finally:
            if file:
                file.close()
        yield pa.RecordBatch.from_pydict({"done": [done]})

    ordered = placed.repartition("range").sortWithinPartitions("range", "idx").select("range", "offset", "raw")
    return ordered.mapInArrow(run, "done long").agg(F.sum("done")).first()[0] or 0


def write_file(lines: tuple[str, DataFrame, str], target: str) -> int:
    """One file of what csv_lines, json_lines or hashdeep_lines give, at a local or mounted path; its bytes. Fails if there is one."""
    head, rows, tail = raw_of(lines[0]), lines[1], raw_of(lines[2])
    placed, end = _placed(len(head), rows)
    staged = f"{target}.{uuid.uuid4().hex}"
    with open(staged, "xb") as f:
        f.write(head)
        f.seek(end)
        f.write(tail)
        f.truncate()
    try:
        written = _put_ranges(placed, os.path.abspath(staged))
        if len(head) + written != end:
            raise OSError(f"{written} bytes were written instead of {end - len(head)}")
        os.link(staged, target)  # fails if the name is taken
    finally:
        os.unlink(staged)
        release(placed)
    return end + len(tail)
