"""Interval labels of a hierarchy: pre is a node's place in the traversal of the tree by names, last the place of the last node below it.

Then a subtree is a range of places, and what is above a node are the intervals around its place: neither needs the paths of ancestors.

Paths are sorted once, as lists of names, over range partitions. A task goes through its range with a stack of one open node per
depth: a path gives the implied parents that it doesn't share with the path before it, and closes the intervals that it isn't in. What
is repeated at the beginnings of ranges or open at their ends is settled from small tables of a row per range and depth.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathgrove.functions.modes import is_dir
from pathgrove.sources.shared import materialise, release


def parts_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def listed(columns) -> list[list]:
    """Columns of a batch that hold no nulls, as lists."""
    return [c.to_numpy(zero_copy_only=False).tolist() for c in columns]


def _before(per_range: DataFrame, value: Column) -> DataFrame:
    """range, before: value folded over the ranges in front of each, for tables of a row per range."""
    return per_range.select("range", value.over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))


_NODES = pa.schema([("range", pa.int32()), ("within", pa.int64()), ("ends", pa.int64()), ("path", pa.string()), ("depth", pa.int32()), ("is_dir", pa.bool_()), ("implied", pa.bool_())])


def _key(path: Column) -> Column:
    """A text that sorts as the list of a clean path's names does: names end in the least character, which is escaped inside of them."""
    return F.replace(F.replace(F.replace(path, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1")), F.lit("/"), F.lit("\0"))


def _of_key(key: Column) -> Column:
    return F.replace(F.replace(F.replace(key, F.lit("\0"), F.lit("/")), F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))


def _walked(batches):
    """The nodes of rows (range, path, is_dir) in order of range and names, when their intervals end: their place within the range and
    that of the last node below, null for those that are open at the end of the range. A range begins with all that is above its first
    row, even if a range in front has it too."""
    stack, done, of, place, before = [], [], None, 0, []  # stack: (range, within, path, depth, is_dir, implied) of the open nodes

    def close(ends):
        range_, within, path, depth, is_dir, implied = stack.pop()
        done.append((range_, within, ends, path, depth, is_dir, implied))

    def passed():
        columns = zip(*done, strict=True) if done else [()] * len(_NODES)
        out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _NODES, strict=True)], schema=_NODES)
        done.clear()
        return out

    for b in batches:
        for range_, path, is_dir in zip(*listed(b.columns), strict=True):
            parts = path.split("/")
            if range_ != of:
                while stack:
                    close(None)
                of, place, before = range_, 0, []
            alike = 0
            for x, y in zip(parts, before):
                if x != y:
                    break
                alike += 1
            while stack and stack[-1][3] > alike:
                close(place)
            for depth in range(alike + 1, len(parts)):
                place += 1
                stack.append((range_, place, "/".join(parts[:depth]), depth, False, True))
            place += 1
            stack.append((range_, place, path, len(parts), is_dir, False))
            before = parts
        yield passed()
    while stack:
        close(None)
    yield passed()


def labelled(entries: DataFrame, only_dirs: bool = False) -> DataFrame:
    """The nodes of ``tree.nodes`` with pre (from 1) and last, as a stored table whose files are ranges of pre."""
    rows = entries.where(F.col("path") != ".").groupBy("path").agg(F.max_by("mode", "idx").alias("mode"))
    if only_dirs:
        rows = rows.where(is_dir(F.col("mode")))
    rows = rows.select(F.array_join(parts_of(F.col("path")), "/").alias("clean"), is_dir(F.col("mode")).alias("is_dir")).where("clean <> ''")
    # a//b and a/b are one node: equal keys are in one range
    rows = rows.select(_key(F.col("clean")).alias("key"), "is_dir").repartitionByRange("key").groupBy("key").agg(F.max("is_dir").alias("is_dir"))
    given = rows.withColumn("range", F.spark_partition_id()).sortWithinPartitions("key").select("range", _of_key(F.col("key")).alias("path"), "is_dir")
    walked = materialise(given.mapInArrow(_walked, "range int, within long, ends long, path string, depth int, is_dir boolean, implied boolean"), "walked")

    # a range repeats what is above its first row; of that, what is above the end of the range in front is left out
    counts = walked.groupBy("range").agg(F.max("within").alias("own"))
    bounds = walked.join(F.broadcast(counts), "range").where("within = own").select("range", "own", F.lag("path").over(Window.orderBy("range")).alias("behind"))  # a row per range
    twice = walked.where("within = depth").join(F.broadcast(bounds), "range").where(F.startswith(F.concat("behind", F.lit("/")), F.concat("path", F.lit("/"))))
    bounds = bounds.join(F.broadcast(twice.groupBy("range").agg(F.count("*").alias("twice"))), "range", "left").withColumn("twice", F.coalesce("twice", F.lit(0)))
    offset = F.coalesce(F.sum(F.col("own") - F.col("twice")).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("twice")
    offsets = materialise(bounds.select("range", "twice", offset.alias("offset"), (F.col("own") + offset).alias("end")), "offsets")
    total = offsets.agg(F.max("end")).first()[0] or 0
    placed = walked.join(F.broadcast(offsets), "range").where("within > twice").withColumn("pre", F.col("offset") + F.col("within"))
    # an interval that is open at the end of its range ends before the next node that is no deeper
    open_ = placed.where("ends IS NULL").select("range", "pre", "depth")  # one per range and depth
    firsts = placed.groupBy(F.col("range").alias("later"), F.col("depth").alias("level")).agg(F.min("pre").alias("first"))
    settled = open_.join(F.broadcast(firsts), (F.col("later") > F.col("range")) & (F.col("level") <= F.col("depth"))).groupBy(F.col("pre").alias("place")).agg((F.min("first") - 1).alias("settled"))
    nodes = placed.join(F.broadcast(settled), F.col("pre") == F.col("place"), "left")
    last = F.coalesce(F.col("offset") + F.col("ends"), "settled", F.lit(total).cast("long"))
    parts = F.split("path", "/")
    out = nodes.select(
        "path", F.when(F.col("depth") > 1, F.array_join(F.slice(parts, 1, F.col("depth") - 1), "/")).otherwise(".").alias("parent"), F.element_at(parts, -1).alias("name"), "depth",
        "is_dir", "implied", "pre", last.alias("last"),
    )
    out = materialise(out.sortWithinPartitions("pre"), "labelled")
    out = out.select("path", "parent", "name", "depth", parts.alias("parts"), "is_dir", "implied", "pre", "last")  # parts aren't stored beside path
    release(walked, offsets)
    return out


def below(tree: DataFrame, pre: int, last: int) -> DataFrame:
    """The node with that interval and all below it; as literals, so that the scan of a stored tree skips what lies outside."""
    return tree.where((F.col("pre") >= pre) & (F.col("pre") <= last))


#: Places of a range that is cut by places alone.
PLACES = 1 << 14


def range_of(pre: Column) -> Column:
    """The range of a place, for work that needs no more of a range than where it ends: neither a sample nor a table of ranges."""
    return F.call_function("div", pre, F.lit(PLACES))


def uncovered(tree: DataFrame, covers: Column) -> DataFrame:
    """The nodes that are below none for which covers holds: a running maximum of the ends of these, within ranges of places."""
    ranged = materialise(tree.withColumn("until", F.when(covers, F.col("last"))).withColumn("range", range_of(F.col("pre"))), "covered")
    until = _before(ranged.groupBy("range").agg(F.max("until").alias("own")), F.max("own"))
    near = F.max("until").over(Window.partitionBy("range").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    marked = ranged.withColumn("near", near).join(F.broadcast(until), "range")
    return marked.where(F.coalesce(F.greatest("near", "before"), F.lit(0)) < F.col("pre")).select(*tree.columns)


def covered(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes with of and start: whose interval they are in, and where it begins, of tops (of, pre, until), which don't overlap; null if
    in none. The newest top in front of a node is found by a running maximum, within ranges of places."""
    mark = tops.select("of", F.col("pre").alias("start"), "until")
    ranged = materialise(tree.join(mark, F.col("pre") == F.col("start"), "left").repartitionByRange("pre").withColumn("range", F.spark_partition_id()), "covered")
    top = F.struct("start", "of", "until")
    newest = ranged.where("start IS NOT NULL").groupBy("range").agg(F.max(top).alias("own"))
    ranges = ranged.select("range").distinct().join(F.broadcast(newest), "range", "left")
    before = _before(ranges, F.max("own"))
    near = F.max(F.when(F.col("start").isNotNull(), top)).over(Window.partitionBy("range").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("near", near).join(F.broadcast(before), "range").withColumn("at", F.coalesce("near", "before"))
    inside = F.col("at.until") >= F.col("pre")
    return found.select(*tree.columns, F.when(inside, F.col("at.of")).alias("of"), F.when(inside, F.col("at.start")).alias("start"))


def _stacks(tree: DataFrame) -> DataFrame:
    """range, open: for each range of a tree in ranges the intervals (depth, last) that are open when it begins, outermost first."""
    latest = tree.groupBy("range", "depth").agg(F.max_by(F.struct("pre", "last"), "pre").alias("at"))  # a row per range and depth
    starts = tree.groupBy("range").agg(F.min("pre").alias("start"))
    earlier = latest.select(F.col("range").alias("from"), F.col("depth"), F.col("at.pre").alias("pre"), F.col("at.last").alias("last"))
    pairs = starts.join(F.broadcast(earlier), (F.col("from") < F.col("range")) & (F.col("last") >= F.col("start")) & (F.col("pre") < F.col("start")))
    newest = pairs.groupBy("range", "depth").agg(F.max_by("last", "pre").alias("last"))
    return newest.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("depth", "last"))).alias("open"))


def lines(tree: DataFrame) -> DataFrame:
    """parts, pre, line, hidden: the rendered rows of a labelled tree or a subtree of it, in any order; sort by pre.

    A node is the last of its siblings if its interval ends where its parent's does, so a task draws the bars in front of a row from the
    ends of the intervals around it, which are a stack while it goes through its range."""
    ranged = materialise(tree.select("pre", "last", "depth", "name", "parts").repartitionByRange("pre").withColumn("range", F.spark_partition_id()), "lines")
    most = ranged.agg(F.max("last")).first()[0]  # where the last top node ends
    given = ranged.join(F.broadcast(_stacks(ranged)), "range", "left").repartition("range").sortWithinPartitions("range", "pre")

    def run(batches):
        of, stack = None, []  # (depth, last) around the present row
        for b in batches:
            places, drawn = b.column(1).to_pylist(), []
            for i, (range_, pre, last, depth, name) in enumerate(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)):
                if range_ != of:
                    of, stack = range_, [(x["depth"], x["last"]) for x in b.column(5)[i].as_py() or []]
                while stack and (stack[-1][1] < pre or stack[-1][0] >= depth):
                    stack.pop()
                ends = [most, *(e for _, e in stack), last]
                bars = ["    " if a == e else "│   " for a, e in zip(ends, ends[1:-1])]
                drawn.append("".join(bars) + ("└── " if ends[-2] == last else "├── ") + name)
                stack.append((depth, last))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(drawn, pa.string())], ["place", "line"])

    drawn = given.select("range", "pre", "last", "depth", "name", "open").mapInArrow(run, "place long, line string")
    return tree.join(drawn, F.col("pre") == F.col("place")).drop("place")
