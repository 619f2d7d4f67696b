import datetime as dt
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pathgrove.functions import values
from pathgrove.functions.modes import DIR
from pathgrove.operators import diff as d, export, intervals, lifecycle, merkle, search as s, stats, tree as t
from pathgrove.plans import options
from pathgrove.sources import derived, filesystem, snapshot as store

T0 = dt.datetime(2023, 10, 31, 5, 30, 42)
LATER = dt.datetime(2023, 11, 12, 6, 33, 24)

LEFT = [
    ("quick", 0, "d"), ("quick/1.txt", 19), ("quick/2.txt", 24), ("dir1", 0, "d"), ("dir1/lhs-only", 8), ("both", 0, "d"), ("both/5.txt", 17), ("both/6.txt", 11),
    ("both/7.txt", 21), ("both/8.txt", 33), ("both/9.txt", 24, 0o644, T0, "aa"),
]
RIGHT = [
    ("fox", 0, "d"), ("fox/3.txt", 14), ("hole", 0, "d"), ("hole/4.txt", 22), ("dir2", 0, "d"), ("dir2/rhs-only", 8), ("both", 0, "d"), ("both/5.txt", 17), ("both/6.txt", 21),
    ("both/7.txt", 21, 0o755), ("both/8.txt", 33, 0o644, LATER), ("both/9.txt", 24, 0o644, T0, "bb"),
]


def codes(rows):
    return {(r["code"], r["path"]) for r in d.report(rows).collect()}


def test_diff(make):
    rows = d.diff(make(LEFT), make(RIGHT))
    assert codes(rows) == {
        ("d----", "quick"), ("d----", "dir1"), ("f----", "quick/1.txt"), ("f----", "quick/2.txt"), ("f----", "dir1/lhs-only"), ("d++++", "fox"), ("d++++", "hole"), ("d++++", "dir2"),
        ("f++++", "fox/3.txt"), ("f++++", "hole/4.txt"), ("f++++", "dir2/rhs-only"), ("f~s~~", "both/6.txt"), ("fm~~~", "both/7.txt"), ("f~~l~", "both/8.txt"), ("f~~~x", "both/9.txt"),
    }
    order = [r["path"] for r in d.report(rows).collect()]
    assert order[:3] == ["dir1", "dir1/lhs-only", "quick"] and order[-1] == "both/9.txt"
    c = d.stats(rows).first().asDict()
    assert c == {"left_files": 3, "left_dirs": 2, "right_files": 3, "right_dirs": 3, "changed": 4, "not_changed": 2, "mode_changed": 1, "size_changed": 1, "mtime_changed": 1, "hash_changed": 1}
    assert {p for _, p in codes(d.filtered(rows, ["f-"]))} == {"quick/1.txt", "quick/2.txt", "dir1/lhs-only"}
    assert {p for _, p in codes(d.filtered(rows, ["~"], ["l", "x"]))} == {"both/6.txt", "both/7.txt"}
    assert d.filtered(rows, [""]).count() == 0
    assert not {p for _, p in codes(d.diff(make(LEFT), make(RIGHT, algo="sha256")))} & {"both/9.txt"}


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as many as there are shuffle partitions, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("text", ["-+", "-m", "+s", "z", "+~"])
def test_bad_filters(text):
    with pytest.raises(ValueError):
        options.parse_filter(text)


def test_repeated_path_counts_once(make):
    rows = d.diff(make([("a", 1), ("a", 2)]), make([("a", 2)]))
    assert [r["type"] for r in rows.collect()] == ["nothing"]


def test_to_sync(make):
    a, b = make(LEFT), make(RIGHT)
    assert {r["path"] for r in d.to_sync(a, b).collect()} == {"quick/1.txt", "quick/2.txt", "dir1/lhs-only", "both/6.txt"}
    assert d.to_sync(a, a).count() == 0
    x, y = make([("1", 1, 0o644, T0, "aa"), ("2", 1, 0o644, T0, "aa"), ("3", 1, 0o644, T0, "cc")]), make([("z", 1, 0o644, T0, "cc")])
    assert [(r["path"], r["hash"]) for r in d.to_sync_by_content(x, y).collect()] == [("1", "aa")]
    with pytest.raises(ValueError):
        d.to_sync_by_content(x, make([("z", 1)], algo="sha256"))


def test_duplicates_and_totals(make):
    rows = [("1.txt", 484), ("a/x", 484), ("b/y", 484), ("c", 793), ("e1", 0), ("e2", 0), ("dir", 10, "d")]
    hashes = ["e3", "e3", "e3", "c7", "da", "da", None]
    snap = make([(*r, *(0o644, T0)[len(r) - 2 :], h) if len(r) == 2 else (*r, T0, None) for r, h in zip(rows, hashes)])
    dupes = stats.duplicate_files(snap).orderBy("ord").collect()
    assert [(r["grp"], r["ord"], r["path"]) for r in dupes] == [(1, 0, "1.txt"), (1, 1, "a/x"), (1, 2, "b/y")]
    assert stats.duplicate_totals(stats.duplicate_files(snap)).first()["bytes"] == 1452
    assert stats.hash_stats(snap).first().asDict() == {"hashed": 6, "pending": 0, "dup_files": 5, "dup_bytes": 1452, "savable_bytes": 968}
    assert stats.file_stats(snap.entries).first().asDict() == {"dir_count": 1, "file_count": 6, "total_size": 2245, "max_size": 793, "avg_size": 374}
    assert stats.file_stats(snap.entries.limit(0)).first()["avg_size"] == 0


@pytest.mark.parametrize("hot", [2, 100_000])
def test_files_of_a_frequent_content(make, monkeypatch, many_ranges, hot):
    """Contents above and below the size from which on they are numbered in ranges."""
    monkeypatch.setattr(stats, "HOT", hot)
    rng = random.Random(5)
    rows = [(f"f{i:03}", 1, 0o644, None, rng.choice(["aa", "aa", "aa", "bb", "cc", "dd" + str(i)])) for i in range(150)]
    got = sorted((r["grp"], r["ord"], r["hash"], r["path"]) for r in stats.duplicate_files(make(rows)).collect())
    files = {h: sorted(r[0] for r in rows if r[4] == h) for h in ("aa", "bb", "cc")}
    assert got == [(g, n, h, p) for g, h in enumerate(files) for n, p in enumerate(files[h])]


def test_search_options(make):
    snap = make([("a/1.txt", 1500), ("a/2.TXT", 10), ("a", 0, "d"), ("b1a/blank.txt", 0), ("c/c.txt", 616)])
    found = lambda **k: {r["path"] for r in s.search(snap, *options.search_condition(now=T0, **k)).collect()}
    assert found(iname=["*.txt"], size=["+1k"]) == {"a/1.txt"}
    assert found(type=["d"]) == {"a"} and found(type=["df"]) == {"a/1.txt", "a/2.TXT", "b1a/blank.txt", "c/c.txt"}
    assert found() == set()
    assert {r["path"] for r in s.search(snap, s.regex("b1a/blank") | s.regex("^c/c.txt$")).collect()} == {"b1a/blank.txt", "c/c.txt"}
    assert found(hash=["a"]) == set()


def test_scan_filters_prune(make):
    snap = make([(".", 0, "d"), ("a", 0, "d"), ("a/x", 1), ("a/b", 0, "d"), ("a/b/y", 1), ("b", 0, "d"), ("b/z", 1), ("top", 1), (".DS_Store", 1)])
    keep = lambda **k: {r["path"] for r in s.kept_by_filters(snap.entries, **k).collect()}
    assert keep() == {".", "a", "a/x", "a/b", "a/b/y", "b", "b/z", "top"}
    assert keep(include_dirs=["b"]) == {".", "b", "b/z", "top"}
    assert keep(exclude_dirs=["^a$"]) == {".", "b", "b/z", "top"}
    assert keep(exclude_files=["y$"]) == {".", "a", "a/x", "a/b", "b", "b/z", "top"}


def test_signature_goldens(make):
    paths = ["a/2.txt", "a/3.txt", "a/a1/1.txt", "a/a2/6.txt", "a/a2/same-as-1.txt", "b/b1/b1a/1.txt", "b/b1/b1a/7.txt", "b/b1/b1a/same-as-1.txt", "dupes/c/c.txt", "dupes/c/a2/6.txt", "dupes/c/a2/same-as-1.txt"]
    dirs = sorted({p.rsplit("/", k)[0] for p in paths for k in range(1, p.count("/") + 1)})
    signed = merkle.signatures(intervals.labelled(make([(p, 0, "d") for p in dirs] + [(p, 1) for p in paths]).entries))
    found = merkle.duplicate_subtrees(signed).collect()
    assert {(r["signature"], r["path"]) for r in found} == {("5c09ba250cd65d1d4e244c268346af99b77209ba", "a/a2"), ("5c09ba250cd65d1d4e244c268346af99b77209ba", "dupes/c/a2")}
    report = merkle.duplicate_report(merkle.duplicate_subtrees(signed)).collect()
    assert [(r["signature"], r["members"]) for r in report] == [("5c09ba250cd65d1d4e244c268346af99b77209ba", ["a/a2", "dupes/c/a2"])]
    assert any(r["line"].endswith("a2    [5c09ba250cd65d1d4e244c268346af99b77209ba]") for r in t.signed_lines(signed).collect())
    small = merkle.signatures(intervals.labelled(make([("a/b/c.txt",), ("a/d/e.txt",)]).entries))
    got = {r["path"]: r["signature"] for r in small.collect()}
    assert got["a"] == "738f85b5fb947ee653004952949083d597e1da45" and got["a/b"] == "f08d52d8c5774306baf4203c859efb1666e18df6" and got["a/d"] == "c9fc6719efc1551cdcae31a81c1d251019ce08fe"


def test_intervals_against_recursion(spark, make, many_ranges):
    """Labels, implied parents and rendered lines of random trees that are cut into ranges at any place."""
    rng = random.Random(7)
    for size in (1, 30, 120):
        paths = {"/".join(rng.choice(["a", "b", "b.c", ".h", "ä"]) for _ in range(rng.randint(1, 6))) for _ in range(size)}
        tree = intervals.labelled(make([(p, 1) for p in sorted(paths)] + [("x//y/", 1), (".", 0, "d")]).entries)
        every = sorted({tuple(p.split("/")[:k]) for p in paths | {"x/y"} for k in range(1, p.count("/") + 2)})
        rows = {tuple(r["parts"]): r for r in tree.collect()}
        assert sorted(rows) == every
        for i, parts in enumerate(every):
            r = rows[parts]
            last = max(j for j, q in enumerate(every) if q[: len(parts)] == parts)
            assert (r["pre"], r["last"], r["depth"], r["implied"], r["path"], r["parent"]) == (i + 1, last + 1, len(parts), "/".join(parts) not in paths | {"x/y"}, "/".join(parts), "/".join(parts[:-1]) or ".")
        greatest = lambda parts: max(q for q in every if q[:-1] == parts[:-1] and len(q) == len(parts)) == parts
        drawn = [
            "".join("    " if greatest(p[:k]) else "│   " for k in range(1, len(p))) + ("└── " if greatest(p) else "├── ") + p[-1] for p in every if not any(x.startswith(".") for x in p)
        ]
        assert [r["line"] for r in t.lines(tree).orderBy("pre").collect()] == drawn
        assert intervals.labelled(make([(".", 0, "d")]).entries).count() == 0


def test_refreshed_signatures_equal_a_full_fold(make):
    """After random edits; what is read are children of directories above an edit."""
    paths = {f"d{a}/e{b}/f{c}" for a in range(6) for b in range(6) for c in range(6)}
    entries = lambda ps: make([(p, 0, "d") for p in sorted({q.rsplit("/", k)[0] for q in ps for k in range(1, q.count("/") + 1)})] + [(p, 1) for p in sorted(ps)]).entries
    full = lambda ps: {(r["path"], r["signature"], r["is_dir"]) for r in merkle.signatures(intervals.labelled(entries(ps))).collect()}
    old = merkle.materialise(merkle.signatures(intervals.labelled(entries(paths))), "old")
    edits = [paths - {"d1/e1/f1"}, paths - {p for p in paths if p.startswith(("d2/e3", "d4"))} | {"d0/new/x/y", "top", "d5/e5/f5/deeper"}]
    for after in edits:
        after = {p for p in after if not any(q.startswith(p + "/") for q in after)}
        added, removed = merkle.changes(old, t.nodes(entries(after)))
        delta = merkle.refresh(old, added, removed)
        assert {(r["path"], r["signature"], r["is_dir"]) for r in merkle.refreshed(old, delta, removed).collect()} == full(after)
    added, removed = merkle.changes(old, t.nodes(entries(edits[0])))
    dirs = merkle.affected(added, removed)
    assert {r["path"] for r in dirs.collect()} == {"d1", "d1/e1"} and merkle.read_for(old, added, removed, dirs).count() == 1 + 6 + 5
    assert merkle.refresh(old, added, removed).count() == 2
    added, removed = merkle.changes(old, t.nodes(entries(paths)))
    assert merkle.refresh(old, added, removed).count() == 0


@pytest.mark.parametrize("places", [1, 3, 7])
def test_signatures_against_recursion(make, monkeypatch, many_ranges, places):
    """Trees that are cut into ranges at any place, with names that sort around the separator and its escapes."""
    monkeypatch.setattr(intervals, "PLACES", places)
    rng = random.Random(places)
    names = ["a", "a.b", "a b", "a\0", "a\1", "a\1\2", "a\0\1", "\1", "\0", "ä", chr(values.KEPT + 0x80)]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(60)}
    every = sorted({tuple(p.split("/")[:k]) for p in paths for k in range(1, p.count("/") + 2)}, key=lambda parts: [x.encode() for x in parts])
    raw = lambda name: name.encode().replace(b"\xee\xbe\x80", b"\x80")
    below = lambda parts: [q for q in every if q[:-1] == parts]

    def sig(parts):
        return hashlib.sha1(b"".join(sig(q) for q in below(parts)) + raw(parts[-1])).digest()

    signed = merkle.signatures(intervals.labelled(make([(p, 1) for p in sorted(paths)]).entries))
    assert signed.columns == ["path", "parent", "name", "depth", "parts", "is_dir", "implied", "pre", "last", "signature"]
    got = {tuple(r["parts"]): (r["pre"], r["signature"]) for r in signed.collect()}
    assert got == {q: (i, sig(q).hex()) for i, q in enumerate(every, 1)}


def _counted(spark, df):
    """df, and an accumulator of the rows that are read of it."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), read


def test_a_refresh_reads_both_trees_seldom(spark, make):
    """The nodes once, the old tree once for the comparison, twice for the children of affected directories, once for the rest."""
    paths = sorted(f"d{a}/e{b}/f{c}" for a in range(6) for b in range(6) for c in range(6))
    entries = lambda ps: make([(p, 1) for p in ps]).entries
    signed = merkle.materialise(merkle.signatures(intervals.labelled(entries(paths))), "old")
    after = merkle.materialise(t.nodes(entries([p for p in paths if p != "d1/e1/f1"] + ["d0/new/x"])), "after")
    (old, old_read), (nodes, nodes_read) = _counted(spark, signed), _counted(spark, after)
    added, removed = merkle.changes(old, nodes)
    delta = merkle.refresh(old, added, removed)
    got = {(r["path"], r["signature"]) for r in merkle.refreshed(old, delta, removed).collect()}
    assert got == {(r["path"], r["signature"]) for r in merkle.signatures(intervals.labelled(entries([p for p in paths if p != "d1/e1/f1"] + ["d0/new/x"]))).collect()}
    assert nodes_read.value == after.count() and old_read.value <= 4 * signed.count()


def test_signatures_read_the_tree_once(spark, make):
    tree = intervals.labelled(make([(f"d{a}/e{b}/f{c}", 1) for a in range(5) for b in range(5) for c in range(5)]).entries)
    nodes, read = _counted(spark, tree)
    assert merkle.signatures(nodes).count() == 5 + 25 + 125 and read.value == 155


def test_duplicates_read_the_tree_twice(spark, make, many_ranges):
    """Once for the last place of each signature, once to mark what repeats."""
    tree = merkle.materialise(merkle.signatures(intervals.labelled(make([(f"d{a}", 0, "d") for a in range(9)] + [(f"d{a}/f{b}/same", 1) for a in range(9) for b in range(3)]).entries)), "tree")
    signed, read = _counted(spark, tree.withColumn("is_dir", F.lit(True)))
    lines = [r["line"] for r in merkle.duplicate_lines(signed).collect()]
    assert sum(x.startswith("Signature: ") for x in lines) == 4 and read.value <= 2 * tree.count()


def test_the_tree_of_events(spark, tmp_path):
    """Every level once, where users or times are null too."""
    rows = [(3, dt.datetime(2024, 1, 1), "view"), (3, dt.datetime(2024, 1, 1), "view"), (4, dt.datetime(2024, 1, 1), "click"), (3, None, "view"), (None, dt.datetime(2024, 1, 2), "view"), (4, None, None)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["path"], bool(r["mode"] & DIR)) for r in derived.events_tree(spark, str(tmp_path)).collect()]
    dirs = {"live", "live/3", "live/3/2024-01-01", "live/4", "live/4/2024-01-01", "live/2024-01-02", "backup", "backup/3", "backup/3/2024-01-01"}
    files = {"live/3/2024-01-01/view", "live/4/2024-01-01/click", "live/3/view", "live/2024-01-02/view", "live/4", "backup/3/2024-01-01/view", "backup/3/view"}
    assert sorted(got) == sorted([(p, True) for p in dirs] + [(p, False) for p in files])


def test_a_rendered_subtree(make, many_ranges):
    tree = intervals.labelled(make([("a/x/1", 1), ("a/x/2", 1), ("a/y/3", 1), ("b", 1)]).entries)
    assert [r["line"] for r in t.lines(t.within(tree, "a")).orderBy("pre").collect()] == ["└── a", "    ├── x", "    │   ├── 1", "    │   └── 2", "    └── y", "        └── 3"]
    assert [r["line"] for r in t.lines(t.limited(tree, 2)).orderBy("pre").collect()] == ["├── a", "│   ├── x", "│   └── y", "└── b"]


def test_duplicate_subtrees_against_recursion(make, many_ranges):
    rng = random.Random(4)
    for _ in range(3):
        paths = {"/".join(rng.choice("xyz") + str(rng.randint(0, 1)) for _ in range(rng.randint(2, 4))) for _ in range(25)}
        paths = {p for p in paths if not any(q.startswith(p + "/") for q in paths)}
        dirs = {p.rsplit("/", k)[0] for p in paths for k in range(1, p.count("/") + 1)}
        signed = merkle.signatures(intervals.labelled(make([(p, 0, "d") for p in sorted(dirs)] + [(p, 1) for p in sorted(paths)]).entries))
        sig = {r["path"]: r["signature"] for r in signed.collect()}
        seen: dict[str, list[str]] = {}

        def visit(parent, dirs=dirs, sig=sig, seen=seen):
            for name in sorted((q for q in dirs if (q.rpartition("/")[0] or ".") == parent), reverse=True):
                seen.setdefault(sig[name], []).append(name)
                if len(seen[sig[name]]) == 1:
                    visit(name)

        visit(".")
        expected = {(k, p) for k, v in seen.items() if len(v) > 1 for p in v}
        assert {(r["signature"], r["path"]) for r in merkle.duplicate_subtrees(signed).collect()} == expected


def test_tree_render(make):
    snap = make([("a", 0, "d"), ("a/1.txt", 1), ("a/.hidden", 1), ("b/c/2.txt", 1), ("z.txt", 1)])
    text = t.render(intervals.labelled(snap.entries), "/root")
    assert text.splitlines() == ["/root", "├── a", "│   └── 1.txt", "├── b", "│   └── c", "│       └── 2.txt", "└── z.txt", "", "2 directories, 5 files"]
    assert t.counts(t.limited(t.nodes(snap.entries), 1)).first()[:] == (2, 2)
    assert {r["path"] for r in t.within(intervals.labelled(snap.entries), "b/").collect()} == {"b", "b/c", "b/c/2.txt"}
    assert t.within(intervals.labelled(snap.entries), ".").count() == 7
    with pytest.raises(ValueError):
        t.within(intervals.labelled(snap.entries), "b/x")


def test_report_on_duplicate_subtrees(make, many_ranges):
    """Members of a group, and what is below them, once; groups inside of members that are first are groups of their own."""
    paths = [f"{top}/{x}" for top in ("a/one", "b/one", "z/deep/one") for x in ("d/1", "d/.h", "e/f/2", "g")] + ["a/other", "q/f/2", "r/1"]
    dirs = sorted({p.rsplit("/", k)[0] for p in paths for k in range(1, p.count("/") + 1)})
    signed = merkle.signatures(intervals.labelled(make([(p, 0, "d") for p in dirs] + [(p, 1) for p in paths]).entries))
    sig = {r["path"]: r["signature"] for r in signed.collect()}
    got = [r["line"] for r in merkle.duplicate_lines(signed, with_trees=True).orderBy("signature", "part", "path", "pre").collect()]
    mark = lambda p: f"    [{sig[p]}]"
    one = ["Signature: " + sig["a/one"], "  a/one", "  b/one", "  z/deep/one", "  ├── d" + mark("a/one/d"), "  │   └── 1" + mark("a/one/d/1"), "  ├── e" + mark("a/one/e")]
    one += ["  │   └── f" + mark("q/f"), "  │       └── 2" + mark("q/f/2"), "  └── g" + mark("a/one/g"), ""]
    f = ["Signature: " + sig["q/f"], "  q/f", "  z/deep/one/e/f", "  └── 2" + mark("q/f/2"), ""]
    assert got == sum(sorted([one, f]), [])
    text = t.render(signed, "/root", signed=True).splitlines()
    assert text[0] == "/root" and text[1] == "├── a" + mark("a") and text[-1] == "19 directories, 12 files"


def test_found_lines(make):
    snap = make([("a", 0, "d"), ('b "q".txt', 7, 0o644, T0, "ab")])
    ids = {r["path"]: r["id"] for r in snap.entries.collect()}
    rows = [r["line"] for r in s.found_lines(snap.entries).orderBy("idx").collect()]
    assert rows == [f'{{{ids["a"]}}}, 0, "a", drwxr-xr-x, 2023-10-31T05:30:42Z', f'{{{ids[chr(98) + " " + chr(34) + "q" + chr(34) + ".txt"]}}}, 7, "b \\"q\\".txt", -rw-r--r--, 2023-10-31T05:30:42Z']
    assert [r["line"] for r in s.found_lines(snap.with_hashes(), "/r", minimal=True).collect()] == ['ab, "/r/b \\"q\\".txt"']
    assert [r["line"] for r in s.found_lines(snap.entries, minimal=True).orderBy("idx").collect()] == ["a", 'b "q".txt']


def test_one_file_exports(spark, make, tmp_path, many_ranges):
    rows = [("a.txt", 42, 0o740, T0, "h1"), ("some/dir", 142, "d"), ('odd, "name"', 442, 0o740, T0, None), (" <&>\u2028", 1, 0o644, T0, "h3"), (values.path_of(b"x\xff"), 2, 0o644, T0, "h4")]
    snap = make(rows)
    ids = [r["id"] for r in snap.entries.orderBy("idx").collect()]
    assert export.write_file(export.csv_lines(snap), str(tmp_path / "one.csv")) == (tmp_path / "one.csv").stat().st_size
    assert (tmp_path / "one.csv").read_bytes() == (
        f"Id,Size,Mode,ModTime,IsDir,Hash (sha1),Path\n{ids[0]},42,-rwxr-----,2023-10-31T05:30:42Z,false,h1,a.txt\n{ids[1]},142,drwxr-xr-x,2023-10-31T05:30:42Z,true,,some/dir\n"
        f'{ids[2]},442,-rwxr-----,2023-10-31T05:30:42Z,false,,"odd, ""name"""\n{ids[3]},1,-rw-r--r--,2023-10-31T05:30:42Z,false,h3," <&>\u2028"\n'
    ).encode() + f"{ids[4]},2,-rw-r--r--,2023-10-31T05:30:42Z,false,h4,x".encode() + b"\xff\n"
    export.write_file(export.hashdeep_lines(snap, "/s", full=True), str(tmp_path / "one.deep"))
    assert (tmp_path / "one.deep").read_bytes().split(b"\n")[2:] == [b"## Generated by: pathgrove export /s", b"## Invoked from: /root", b"##", b"42,h1,/root/a.txt", "1,h3,/root/ <&>\u2028".encode(), b"2,h4,/root/x\xff", b""]
    meta = store.describe(make(rows[:4])).first()
    export.write_file(export.json_lines(make(rows[:4]), meta, "/s"), str(tmp_path / "one.json"))
    text = (tmp_path / "one.json").read_text()
    assert text.startswith('{\n\t"database": {\n\t\t"version": 1,\n\t\t"dbPath": "/s",\n') and text.endswith('\n\t\t\t"hash": "h3"\n\t\t}\n\t]\n}\n') and '\t\t\t"path": " \\u003c\\u0026\\u003e\\u2028",\n' in text
    document = json.loads(text)
    assert [(e["path"], e["size"], e.get("hash")) for e in document["entries"]] == [(r[0], r[1], r[4] if len(r) > 4 else None) for r in rows[:4]]
    assert document["database"]["entriesCount"] == 4 and document["database"]["hashTableAlgo"] == "sha1"
    with pytest.raises(FileExistsError):
        export.write_file(export.csv_lines(snap), str(tmp_path / "one.csv"))
    none = make([("a", 1)])
    none.entries = none.entries.limit(0)
    assert json.loads("".join([export.json_lines(none, store.describe(none).first(), "/s")[0], "]}"]))["entries"] == []
    assert len(list(tmp_path.iterdir())) == 3


def test_a_range_that_is_written_again(make, tmp_path, many_ranges):
    """What a task of a lost executor wrote, in part, is written over by the same bytes."""
    snap = make([(f"f{i:03}", i) for i in range(100)])
    head, rows, _ = export.csv_lines(snap)
    placed, end = export._placed(len(head), rows)
    target = tmp_path / "x"
    target.write_bytes(head.encode() + b"?" * (end - len(head)))
    for _ in range(2):
        assert export._put_ranges(placed, str(target)) == end - len(head)
    lines = target.read_text().splitlines()
    assert len(lines) == 101 and [x.rsplit(",", 1)[1] for x in lines[1:]] == [f"f{i:03}" for i in range(100)]


def test_file_tree_lifecycle(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "sub" / "b.txt").write_text("two")
    (root / "sub" / ".DS_Store").write_text("x")
    snap = lifecycle.scan(spark, str(root), str(tmp_path / "s1"), algo="sha1")
    assert {r["path"] for r in snap.entries.collect()} == {".", "a.txt", "sub", "sub/b.txt"}
    assert snap.hashes.where("hash IS NULL").count() == 0 and snap.hashes.count() == 2
    with pytest.raises(Exception, match="exist"):
        lifecycle.scan(spark, str(root), str(tmp_path / "s1"))
    (root / "sub" / "c.txt").write_text("three")
    newer = lifecycle.update(spark, str(tmp_path / "s1"), str(tmp_path / "s2"))
    assert newer.hashes.where("hash IS NULL").count() == 0 and newer.hashes.count() == 3
    assert {(r["code"][0], r["path"]) for r in d.report(d.filtered(d.diff(snap, newer), ["f"])).collect()} == {("f", "sub/c.txt")}
    meta = store.meta(spark, str(tmp_path / "s2"))
    assert stats.check(newer, meta).where("NOT ok").count() == 0
    broken = meta.withColumn("entries_count", F.lit(99).cast("long"))
    assert [r["check"] for r in stats.check(newer, broken).where("NOT ok").collect()] == ["entries_count"]
    assert lifecycle.fix(spark, str(tmp_path / "s2")).count() == 0
    lifecycle.restore(spark, str(tmp_path / "s2"))
    assert lifecycle.info(spark, str(tmp_path / "s2")).first()["checksum_ok"]
    (root / "sub" / "c.txt").write_text("longer than before")
    assert {(r["code"][0], r["path"]) for r in d.report(d.filtered(lifecycle.compare(spark, str(tmp_path / "s2")), ["fs"])).collect()} == {("f", "sub/c.txt")}
    export.write_hashdeep(newer, str(tmp_path / "deep"))
    assert {r["path"] for r in export.read_hashdeep(spark, str(tmp_path / "deep")).collect()} == {"a.txt", "sub/b.txt", "sub/c.txt"}
    export.write_csv(newer, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5
    export.write(newer, meta, str(tmp_path / "json"), "json")
    documents = [json.loads(p.read_text()) for p in (tmp_path / "json").glob("part-*")]
    assert sum(e["isDir"] for x in documents for e in x["entries"]) == 2 and {x["database"]["entries_count"] for x in documents} == {5}
    assert all(p.read_text().startswith("%%%% HASHDEEP-1.0\n") for p in (tmp_path / "deep").glob("part-*"))
    with pytest.raises(ValueError):
        export.write(newer, meta, str(tmp_path / "xml"), "xml")


def test_failed_digests_leave_the_snapshot(spark, tmp_path, monkeypatch):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a").write_text("one")
    path = str(tmp_path / "s")

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(filesystem, "digest", broken)
        with pytest.raises(RuntimeError):
            lifecycle.scan(spark, str(tmp_path / "tree"), path, algo="sha1")
        assert stats.pending_totals(store.read(spark, path)).first()[:] == (1, 3)
    assert lifecycle.resume(spark, path).hashes.where("hash IS NULL").count() == 0
    with monkeypatch.context() as m:
        m.setattr(filesystem, "scan", broken)
        with pytest.raises(RuntimeError):
            lifecycle.scan(spark, str(tmp_path / "tree"), str(tmp_path / "none"))
        assert store.current(spark, str(tmp_path / "none")) is None


def test_pending_and_resume(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a").write_text("one")
    (root / "b").write_text("two")
    snap = lifecycle.scan(spark, str(root), str(tmp_path / "s"), algo="sha256", hash_now=False)
    assert stats.pending_totals(snap).first()[:] == (2, 6)
    assert lifecycle.resume(spark, str(tmp_path / "s")).hashes.where("hash IS NULL").count() == 0
    assert filesystem.file_digest(str(root / "missing"), "sha1") is None


def test_walk_filters(spark, tmp_path):
    for p in ("a/a1/1", "b/b1/2", "c/3", "top"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    found = {r["path"] for r in filesystem.scan(spark, str(tmp_path), include=["d:b"], dry_run=True).collect()}
    assert found == {".", "b", "b/b1", "b/b1/2", "top"}
    found = {r["path"] for r in filesystem.scan(spark, str(tmp_path), exclude=["d:a", "d:b"], dry_run=True).collect()}
    assert found == {".", "c", "c/3", "top"}
    assert filesystem.entry_mode(0o040755) == DIR | 0o755
    found = {r["path"] for r in filesystem.scan(spark, str(tmp_path), include=[r"f:[[:digit:]]\z"], dry_run=True).collect()}
    assert found == {".", "a", "a/a1", "a/a1/1", "b", "b/b1", "b/b1/2", "c", "c/3"}
    (tmp_path / "c" / ".DS_Store").write_text("x")
    os.symlink("missing", tmp_path / "c" / "link")
    (tmp_path / "none").mkdir()
    found = {r["path"] for r in filesystem.scan(spark, str(tmp_path), exclude=["^[ab]$"]).collect()}
    assert found == {".", "c", "c/3", "c/link", "none", "top"}
    assert "c/.DS_Store" in {r["path"] for r in filesystem.scan(spark, str(tmp_path), dry_run=True).collect()}
    with pytest.raises(FileNotFoundError):
        filesystem.scan(spark, str(tmp_path / "gone"))
