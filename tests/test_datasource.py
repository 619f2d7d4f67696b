"""Live trees and hashdeep files through spark.read."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

from pathgrove.operators import diff as d, export
from pathgrove.sources import datasource, filesystem
from pathgrove.sources.snapshot import Snapshot

COLUMNS = ["id", "path", "size", "mode", "mtime", "mtime_ns"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "root"
    for folder in ("a/a1/a1a", "a/a2", "ab/x", "b/b1/b1a/deep/deeper", "empty", "wide"):
        (root / folder).mkdir(parents=True)
    for name in ("1.txt", "a/2.txt", "a/a1/a1a/3.txt", "ab/x/4.txt", "b/b1/b1a/deep/deeper/5,6.txt", *(f"wide/{i}" for i in range(30))):
        (root / name).write_text(name)
    with open(os.fsencode(root / "a") + b"/\xff.bin", "wb") as f:
        f.write(b"odd")
    os.symlink("a", root / "link")
    os.utime(root / "1.txt", ns=(0, -1))
    os.utime(root / "a" / "2.txt", ns=(0, 1_700_000_000_123_456_789))
    return str(root)


@pytest.fixture(scope="module")
def formats(spark):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    datasource.register(spark)
    yield
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


CONDITIONS = ["true", "path LIKE 'a/%'", "path LIKE 'a/a1/a1a/3%'", "path = 'b/b1/b1a/deep'", "path IN ('1.txt', 'ab/x/4.txt', 'none')", "NOT path LIKE 'b/%' AND size > 3", "path LIKE 'a/%' OR path LIKE 'b/%'", "path = '.'", "path IS NULL"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_tree_as_the_scan(spark, formats, root, condition):
    want = sorted(filesystem.scan(spark, root).where(condition).select(COLUMNS).collect())
    for partitions in (1, 4, 256):
        read = spark.read.format("pathgrove_tree").option("partitions", partitions).load(root)
        assert read.columns == COLUMNS
        assert sorted(read.where(condition).collect()) == want, partitions


def listings(root, filters, width, monkeypatch):
    """The directories that are listed below pushed filters, and the paths that are found."""
    reader, seen = datasource.TreeReader(root, width), []
    assert list(reader.pushFilters(filters)) == filters  # Spark goes on applying them
    real = datasource.children
    monkeypatch.setattr(datasource, "children", lambda top, directory: seen.append(directory.decode()) or real(top, directory))
    found = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    monkeypatch.undo()
    assert len(found) == len(set(found))
    return set(seen), found


def test_rejected_directories_are_not_listed(root, monkeypatch):
    path = ("path",)
    for width in (1, 3, 100):
        everything, found = listings(root, [], width, monkeypatch)
        assert everything == {".", "a", "a/a1", "a/a1/a1a", "a/a2", "ab", "ab/x", "b", "b/b1", "b/b1/b1a", "b/b1/b1a/deep", "b/b1/b1a/deep/deeper", "empty", "wide"}
        assert len(found) == 51
        assert listings(root, [StringStartsWith(path, "a/a1")], width, monkeypatch)[0] == {".", "a", "a/a1", "a/a1/a1a"}
        assert listings(root, [EqualTo(path, "ab/x/4.txt")], width, monkeypatch)[0] == {".", "ab", "ab/x"}
        assert listings(root, [In(path, ("1.txt", "b/b1/none"))], width, monkeypatch)[0] == {".", "b", "b/b1"}
        assert listings(root, [Not(StringStartsWith(path, "b/b1/")), Not(StringStartsWith(path, "a"))], width, monkeypatch)[0] == {".", "b", "empty", "wide"}
        assert listings(root, [EqualTo(("id",), "x"), Not(EqualTo(path, "a"))], width, monkeypatch)[0] == everything


def test_a_tree_is_a_side_of_a_diff(spark, formats, root):
    live = spark.read.format("pathgrove_tree").load(root).withColumns({"idx": F.monotonically_increasing_id(), "tz_min": F.lit(0).cast("short")})
    stored = filesystem.scan(spark, root)
    assert {r.type for r in d.diff(Snapshot(live, None, root, None), Snapshot(stored, None, root, None)).collect()} == {"nothing"}


def test_missing_tree(spark, formats, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        spark.read.format("pathgrove_tree").load(str(tmp_path / "none")).collect()


def test_hashdeep_in_ranges(spark, formats, make, tmp_path):
    rows = [(f"d/{i},{'x' * (i % 50)}.txt", i, 0o644, None, f"{i:040x}") for i in range(500)] + [(".bin", 7, 0o644, None, "f" * 40), ("dir", 0, "d", None, None)]
    target = str(tmp_path / "all.hashdeep")
    export.write_file(export.hashdeep_lines(make(rows), "/snapshots/x"), target)
    want = sorted((r[1], r[4], r[0]) for r in rows if r[4])
    for width in (1, 37, 1000, 64 << 20):
        reader = datasource.HashdeepReader(target, width)
        found = [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert sorted(found) == want, width
    read = spark.read.format("pathgrove_hashdeep").option("bytes", 5000).load(target)
    assert read.rdd.getNumPartitions() > 5 and sorted(map(tuple, read.collect())) == want
    plain = sorted(map(tuple, export.read_hashdeep(spark, target).where("NOT path LIKE '%.bin'").collect()))
    assert sorted(map(tuple, read.where("NOT path LIKE '%.bin'").collect())) == plain


def test_other_files_are_refused(spark, formats, tmp_path):
    (tmp_path / "x").write_text("1,2,3\n")
    with pytest.raises(Exception, match="isn't a hashdeep file"):
        spark.read.format("pathgrove_hashdeep").load(str(tmp_path / "x")).collect()
