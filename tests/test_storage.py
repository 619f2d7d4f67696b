"""Stored snapshots: revisions of several writers, digests that survive a kill, work dealt by bytes, layout by id, names of any bytes."""

import hashlib
import os
import random
import signal
import subprocess
import sys
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathgrove.functions import values
from pathgrove.operators import diff as d, export, lifecycle, stats
from pathgrove.plans import dealing
from pathgrove.sources import derived, filesystem, shared, snapshot as store

DATA = "/root/testdata/sf0.001"


def tree_of(root, n, size=50):
    root.mkdir()
    for i in range(n):
        (root / f"{i:03}.txt").write_text(f"{i} " * size)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# revisions


def test_of_two_writers_one_is_told(spark, tmp_path, make):
    path = str(tmp_path / "s")
    store.write(make([("a", 1)]), path)
    row = store.current(spark, path)
    assert row["revision"] == 1
    outcomes = []

    def writer():
        try:
            outcomes.append(store.put_revision(spark, path, row.asDict(), base=1))
        except store.ConcurrentChange:
            outcomes.append("told")

    threads = [threading.Thread(target=writer) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, outcomes)) == ["2", "told", "told", "told"]
    threads = [threading.Thread(target=lambda: outcomes.append(store.put_revision(spark, path, row.asDict()))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(outcomes[4:]) == [3, 4, 5] and store.revisions(spark, path) == [1, 2, 3, 4, 5]
    with pytest.raises(FileExistsError):
        store.write(make([("b", 1)]), path)
    assert store.write(make([("b", 1)]), path, force=True).entries.first()["path"] == "b"


@pytest.mark.parametrize("local", [True, False])
def test_a_name_is_claimed_once(spark, tmp_path, monkeypatch, local):
    """By a hard link, and by the rename that stores other than local ones have."""
    if not local:
        spark.conf.set("spark.hadoop.fs.viewfs.mounttable.t.link./in", f"file://{tmp_path}")
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./in", f"file://{tmp_path}")
    base = f"file://{tmp_path}" if local else "viewfs://t/in"
    for name in ("one", "two"):
        (tmp_path / name).write_text(name)
    assert shared.claim(spark, f"{base}/one", f"{base}/deep/target") and not shared.claim(spark, f"{base}/two", f"{base}/deep/target")
    assert (tmp_path / "deep" / "target").read_text() == "one"


def test_vacuum_leaves_what_readers_use(spark, tmp_path):
    tree_of(tmp_path / "tree", 3)
    path = str(tmp_path / "s")
    lifecycle.scan(spark, str(tmp_path / "tree"), path, algo="sha1")
    reader = store.read(spark, path)
    assert store.vacuum(spark, path, keep=1) == ["meta/rev-0000000001.parquet", "meta/rev-0000000002.parquet"]  # tables are too young
    gone = store.vacuum(spark, path, keep=1, grace=0)
    assert any(n.startswith("log-") for n in gone) and any(n.startswith("hashes-") for n in gone) and not any(n.startswith("entries-") for n in gone)
    assert reader.hashes.where("hash IS NOT NULL").count() == 3 and store.read(spark, path).with_hashes().count() == 3
    assert not store.vacuum(spark, path, keep=1, grace=0)
    with pytest.raises(ValueError):
        lifecycle.restore(spark, path)


def test_damage_is_found_and_mended_by_its_range(spark, tmp_path, make):
    """A bucket's file is written anew with one other row: check names that row's range, and fix sums that range only."""
    path = str(tmp_path / "s")
    store.write(make([(f"f{i:04}", i, 0o644, None, f"h{i}") for i in range(300)]), path)
    assert lifecycle.check_ranges(spark, path).count() == 0
    row = store.current(spark, path)
    one = store.read(spark, path).entries.where("path = 'f0042'").first()
    folder = tmp_path / "s" / row["entries_table"]
    for part in folder.glob("part-*.parquet"):
        table = pq.read_table(part)
        if one["id"] in table["id"].to_pylist():
            sizes = [-1 if i == one["id"] else n for i, n in zip(table["id"].to_pylist(), table["size"].to_pylist())]
            pq.write_table(table.set_column(table.schema.get_field_index("size"), "size", pa.array(sizes, pa.int64())), part, use_deprecated_int96_timestamps=True)
            (folder / f".{part.name}.crc").unlink()
    spark.catalog.refreshByPath(str(folder))
    spark.catalog.refreshTable(store._declared(path, row["entries_table"]))
    n = len([i for i in store.read(spark, path).entries.collect() if i["id"][:3] == one["id"][:3]])
    assert [tuple(r) for r in lifecycle.check_ranges(spark, path).collect()] == [("entries", one["id"][:3], n, n)]
    assert [r["check"] for r in lifecycle.fix(spark, path, dry_run=True).collect()] == ["checksum"]
    before = {tuple(r) for r in store.sums(spark, path, row).collect()}
    lifecycle.fix(spark, path)
    after = {tuple(r) for r in store.sums(spark, path, store.current(spark, path)).collect()}
    assert {r[:2] for r in after - before} == {("entries", one["id"][:3])} and len(after) == len(before)
    assert lifecycle.check_ranges(spark, path).count() == 0 and lifecycle.info(spark, path).first()["checksum_ok"]


# digests


def test_digests_of_a_killed_run_count(spark, tmp_path):
    """A process that computes digests is killed; what it had finished is never read again, as those files are gone."""
    root, path = tmp_path / "tree", str(tmp_path / "s")
    tree_of(root, 40, 30_000)
    lifecycle.scan(spark, str(root), path, algo="sha1", hash_now=False)
    expected = {f.name: hashlib.sha1(f.read_bytes()).hexdigest() for f in root.iterdir()}
    code = f"""
import sys, time
from pyspark.sql import SparkSession
from pathgrove.operators import lifecycle
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
spark.sparkContext.setCheckpointDir({str(tmp_path / "shared")!r})
lifecycle.resume(spark, {path!r}, task_bytes=300_000, tasks=2, on_round=lambda p: (print("ROUND", p.rounds, flush=True), time.sleep(1000 if p.rounds == 3 else 0)))
"""
    monkey = f"import pathgrove.plans.dealing as dl; dl.LEAST_BYTES = 1\n{code}"
    env = os.environ | {"PYTHONPATH": os.getcwd()}
    run = subprocess.Popen([sys.executable, "-c", monkey], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
    for line in run.stdout:
        if line.startswith(b"ROUND 3"):
            break
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    stored = store.read(spark, path)
    done = {r["path"] for r in stored.with_hashes().collect()}
    assert 0 < len(done) < 40 and stats.pending_totals(stored).first()["todo"] == 40 - len(done)
    for name in done:
        (root / name).unlink()
    heard = []
    after = lifecycle.resume(spark, path, on_round=heard.append)
    assert {r["path"]: r["hash"] for r in after.with_hashes().collect()} == expected
    assert heard[-1].files == heard[-1].all_files == 40 - len(done) and heard[-1].bytes == heard[-1].all_bytes
    assert store.logged(spark, path, store.current(spark, path)["log_table"]) is None and after.hashes.count() == 40


def test_a_callback_that_stops_keeps_its_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dealing, "LEAST_BYTES", 1)
    root, path = tmp_path / "tree", str(tmp_path / "s")
    tree_of(root, 12)
    os.symlink("001.txt", root / "link")
    lifecycle.scan(spark, str(root), path, algo="sha256", hash_now=False)

    def stop(progress):
        if progress.rounds == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        lifecycle.resume(spark, path, task_bytes=70_000, tasks=2, on_round=stop)
    part = stats.pending_totals(store.read(spark, path)).first()["todo"]
    assert 0 < part < 12
    (root / "011.txt").unlink()
    (root / "000.txt").chmod(0o644)
    rounds = []
    lifecycle.resume(spark, path, task_bytes=70_000, tasks=2, on_round=rounds.append)
    left = {r["path"] for r in store.read(spark, path).pending().collect()}
    assert left <= {"011.txt"} and rounds[-1].all_files == part
    assert lifecycle.info(spark, path).first()["checksum_ok"]


def test_overlapping_runs_log_a_file_twice(spark, tmp_path):
    tree_of(tmp_path / "tree", 4)
    path = str(tmp_path / "s")
    snap = lifecycle.scan(spark, str(tmp_path / "tree"), path, algo="sha1", hash_now=False)
    log = store.current(spark, path)["log_table"]
    for _ in range(2):
        store.append_digests(filesystem.digest(snap.entries.where("path = '001.txt'"), snap.root, "sha1"), path, log)
    os.makedirs(f"{path}/{log}/round-lost/_temporary")  # a round that never ended
    stored = store.read(spark, path)
    assert stored.hashes.count() == 4 and stored.with_hashes().count() == 1
    assert store.compact(spark, path).with_hashes().count() == 1


# work by bytes


@pytest.mark.parametrize("most", [1 << 30, 1 << 40])
def test_tasks_have_equal_bytes(spark, most):
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 10**3, 10**6, 10**8, 10**9]) + rng.randint(0, 999) for _ in range(3000)] + [10**12, 3 * 10**11, 0, -1]
    files = spark.createDataFrame([(i, hashlib.sha1(str(i).encode()).hexdigest(), f"f{i}", s) for i, s in enumerate(sizes)], "idx long, id string, path string, size long")
    dealt, count = dealing.deal(files, most)
    tasks = {r["task"]: (r["n"], r["cost"]) for r in dealt.groupBy("task").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect()}
    assert sum(n for n, _ in tasks.values()) == len(sizes) and max(tasks) == count - 1
    share = dealing.task_size(sum(max(0, s) + dealing.OPENING for s in sizes), spark.sparkContext.defaultParallelism, most)
    assert all(cost < 2 * share or n == 1 for n, cost in tasks.values())
    mean = sum(cost for _, cost in tasks.values()) / count
    assert all(cost <= 2.5 * mean or n == 1 for n, cost in tasks.values())


def test_dealing_nothing(spark):
    assert dealing.deal(spark.createDataFrame([], "idx long, id string, path string, size long"))[1] == 0


# layout


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stored_snapshots_compare_without_a_shuffle(spark, tmp_path):
    before, later = derived.documents_snapshot(spark, DATA), derived.documents_later(spark, DATA)
    store.write(before, str(tmp_path / "a"))
    store.write(later, str(tmp_path / "b"))
    a, b = store.read(spark, str(tmp_path / "a")), store.read(spark, str(tmp_path / "b"))
    stored = d.diff(a, b)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(d.diff(a, b))
        assert text.count("Bucketed: true") == 4 and "Exchange" not in text
        assert "Exchange" not in plan(a.with_any_hash())
        assert "Exchange" in plan(d.diff(before, later))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(stored) == rows(d.diff(before, later))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_point_reads_open_one_bucket(spark, tmp_path):
    snap = derived.documents_snapshot(spark, DATA)
    store.write(snap, str(tmp_path / "a"))
    stored = store.read(spark, str(tmp_path / "a"))
    one = snap.entries.where("idx = 7").first()
    found = stored.by_id(one["id"])
    assert [tuple(r) for r in found.collect()] == [tuple(one)] == [tuple(r) for r in stored.by_index(7).collect()]
    assert rows_read(found) < stored.entries.count() / 4


def rows_read(df):
    """Rows that the scan of a plan gave when it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_repeated_paths_keep_their_own_digests(spark, tmp_path, make):
    """A path that is stored twice has two rows with a digest each."""
    store.write(make([("a", 1, 0o644, None, "h1"), ("a", 2, 0o644, None, "h2"), ("b", 3)]), str(tmp_path / "s"))
    stored = store.read(spark, str(tmp_path / "s"))
    assert sorted((r["size"], r["hash"]) for r in stored.with_hashes().collect()) == [(1, "h1"), (2, "h2")]
    assert stored.with_any_hash().count() == 3 and stored.pending().count() == 1


# names and times


def test_names_of_any_bytes_come_back(spark):
    rng = random.Random(1)
    names = [b"plain", "é中😀".encode(), b"a\xff", b"a\xfe", b"\xee\xbe\x80", b"\xee\xbf\xbf\xff", b"\xc3", b"\xed\xa0\x80", "".encode()]
    names += [bytes(rng.choice([0x61, 0x80, 0xBF, 0xC3, 0xEE, 0xBE, 0xBF, 0xEF, 0xFF]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    paths = [values.path_of(n) for n in names]
    assert [values.raw_of(p) for p in paths] == names and len(set(paths)) == len(set(names))
    assert paths[:2] == ["plain", "é中😀"]
    df = spark.createDataFrame(list(zip(range(len(names)), paths)), "i int, path string").select("i", values.raw_path(F.col("path")).alias("raw"), values.path_id(F.col("path")).alias("id"))
    assert {r["i"]: (bytes(r["raw"]), r["id"]) for r in df.collect()} == {i: (n, hashlib.sha1(n).hexdigest()) for i, n in enumerate(names)}


def test_files_with_odd_names_and_old_times(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    names = [b"a\xff.txt", b"a\xfe.txt", b"plain", b"line\nbreak"]
    for i, name in enumerate(names):
        (p := os.path.join(os.fsencode(root), name))
        with open(p, "w") as f:
            f.write(str(i))
    os.utime(os.path.join(os.fsencode(root), names[0]), ns=(-1, -1))
    os.utime(os.path.join(os.fsencode(root), names[2]), ns=(-1_500_000_001, -1_500_000_001))
    snap = lifecycle.scan(spark, str(root), str(tmp_path / "s"), algo="sha1")
    found = {values.raw_of(r["path"]): r for r in snap.with_hashes().collect()}
    assert {n: r["hash"] for n, r in found.items()} == {n: hashlib.sha1(str(i).encode()).hexdigest() for i, n in enumerate(names)}
    assert {n: r["id"] for n, r in found.items()} == {n: hashlib.sha1(n).hexdigest() for n in names}
    micros = {values.raw_of(r["path"]): (r["us"], r["mtime_ns"]) for r in snap.entries.select("path", F.unix_micros("mtime").alias("us"), "mtime_ns").collect()}
    assert micros[names[0]] == (-1, 999) and micros[names[2]] == (-1_500_001, 999)
    assert stats.check(snap, store.meta(spark, str(tmp_path / "s"))).where("NOT ok").count() == 0
    with open(os.path.join(os.fsencode(root), names[1]), "w") as f:
        f.write("changed")
    os.unlink(os.path.join(os.fsencode(root), names[0]))
    os.rename(root / "line\nbreak", tmp_path / "elsewhere")
    newer = lifecycle.scan(spark, str(root), str(tmp_path / "t"), algo="sha1")
    rows = {(r["code"][:3], r["path"]) for r in d.report(d.filtered(d.diff(snap, newer), ["f"])).collect()}
    assert rows == {("f--", values.path_of(names[0])), ("f~s", values.path_of(names[1])), ("f--", "line\nbreak")}
    export.write_hashdeep(newer, str(tmp_path / "deep"))
    assert {values.raw_of(r["path"]) for r in export.read_hashdeep(spark, str(tmp_path / "deep")).collect()} == {names[1], names[2]}


def test_quoted_text(spark):
    cases = {
        "plain é中": '"plain é中"', 'a"b\\c': '"a\\"b\\\\c"', "\a\b\f\n\r\t\v": '"\\a\\b\\f\\n\\r\\t\\v"', "\x00\x1f\x7f": '"\\x00\\x1f\\x7f"',
        "\x85  ​": '"\\u0085\\u00a0\\u2028\\u200b"', values.path_of(b"x\xff"): '"x\\xff"', "": '""', "\U000e0001😀": '"\\U000e0001😀"',
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", values.quoted(F.col("t")).alias("q"))
    assert {r["t"]: r["q"] for r in df.collect()} == cases
