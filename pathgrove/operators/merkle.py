"""Signatures of directory structure, bottom up, and duplicate subtrees.

sig(node) = SHA-1(signatures of its children, by name, as bytes; then its name as bytes). Content, size and mode play no part.

A labelled tree is folded in one pass over ranges of its traversal: a task holds a digest for each node around the present one, and
closes it where its interval ends. Left over are the nodes whose intervals cross the end of a range, at most one per range and depth;
these are folded level by level from the signatures of their children. The digest of such a directory is sequential: its children
pass through one task, in order, as a stream of which the task holds one batch.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pathgrove.functions.values import raw_of, raw_path
from pathgrove.sources.shared import materialise

from . import intervals, tree


def _directories(children: DataFrame, name: str | None = None) -> DataFrame:
    """of, digest: the signature of every parent of children (parent, name, signature); name replaces the parents' own names."""

    def run(batches):
        of, digest = None, None

        def ended():
            digest.update(raw_of(of.rpartition("/")[2] if name is None else name))
            return of, digest.hexdigest()

        for b in batches:
            done = []
            for parent, signature in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if parent != of:
                    if of is not None:
                        done.append(ended())
                    of, digest = parent, hashlib.sha1()
                digest.update(bytes.fromhex(signature))
            yield pa.RecordBatch.from_pydict({"of": [x for x, _ in done], "digest": [x for _, x in done]}, pa.schema([("of", pa.string()), ("digest", pa.string())]))
        if of is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(("of", "digest"), ([x] for x in ended()), strict=True)))

    return children.repartition("parent").sortWithinPartitions("parent", "name").select("parent", "signature").mapInArrow(run, "of string, digest string")


def _folding(columns: list[str]):
    """A pass over nodes with the columns given, by range and pre, whose range ends at end: gives them signature, null where the
    interval crosses the end of the range, and loose, whether the parent isn't folded with it. Nodes come out when their intervals end;
    a task holds those around the present one."""

    def run(batches):
        stack, held, of = [], None, None  # (row, depth, name, digest or None) around the present row, whose rows are held first
        closed, signatures, loose = [], [], []

        def fold(row, name, digest, parent):
            signature = None
            if digest is not None:
                digest.update(raw_of(name))
                signature = digest.hexdigest()
                if parent is not None:
                    parent.update(digest.digest())
            closed.append(row)
            signatures.append(signature)
            loose.append(signature is None or parent is None)

        def close():
            row, _, name, digest = stack.pop()
            fold(row, name, digest, stack[-1][3] if stack else None)

        def passed(rows):
            out = rows.take(pa.array(closed, pa.int64())).append_column("signature", pa.array(signatures, pa.string())).append_column("loose", pa.array(loose, pa.bool_()))
            for x in (closed, signatures, loose):
                x.clear()
            return out.combine_chunks().to_batches()

        for b in batches:
            walk = intervals.listed(b.column(k) for k in ("range", "pre", "last", "depth", "name", "end"))
            rows = pa.Table.from_batches([b]).select(columns)
            start = 0 if held is None else held.num_rows
            rows = rows if not start else pa.concat_tables([held, rows]).combine_chunks()
            for row, (range_, pre, last, depth, name, end) in enumerate(zip(*walk, strict=True), start):
                while stack and (range_ != of or stack[-1][1] >= depth):
                    close()
                of = range_
                if pre == last:
                    fold(row, name, hashlib.sha1(), stack[-1][3] if stack else None)
                else:
                    stack.append((row, depth, name, hashlib.sha1() if last <= end else None))
            held = rows.take(pa.array([x[0] for x in stack], pa.int64())).combine_chunks()
            yield from passed(rows)
            stack = [(i, *x[1:]) for i, x in enumerate(stack)]
        while stack:
            close()
        if held is not None:
            yield from passed(held)

    return run


def signatures(nodes: DataFrame) -> DataFrame:
    """The nodes of a labelled tree with a column signature (hex)."""
    columns = [*nodes.columns, "signature"]
    given = nodes.drop("parts").withColumn("range", intervals.range_of(F.col("pre"))).withColumn("end", (F.col("range") + 1) * intervals.PLACES - 1)
    kept = [f for f in nodes.schema if f.name != "parts"]
    folding = given.repartition("range").sortWithinPartitions("range", "pre").mapInArrow(
        _folding([f.name for f in kept]), T.StructType([*kept, T.StructField("signature", T.StringType()), T.StructField("loose", T.BooleanType())])
    )
    signed = materialise(folding, "folded")
    if "parts" in columns:
        signed = signed.withColumn("parts", F.split("path", "/"))
    levels = [r["depth"] for r in signed.where("signature IS NULL").groupBy("depth").count().orderBy(F.desc("depth")).collect()]  # a row per depth
    loose, out = signed.where("loose AND signature IS NOT NULL"), signed.where("signature IS NOT NULL").select(columns)
    above = None
    for depth in levels:
        children = loose.where(F.col("depth") == depth + 1).select("parent", "name", "signature")
        if above is not None:
            children = children.unionByName(above.where(F.col("depth") == depth + 1).select("parent", "name", "signature"))
        level = signed.where(F.col("signature").isNull() & (F.col("depth") == depth)).drop("signature")
        above = materialise(level.join(_directories(children), F.col("path") == F.col("of")).withColumnRenamed("digest", "signature").select(columns), "level")
        out = out.unionByName(above)
    return out


_SIGNED = ("path", "parent", "name", "depth", "is_dir", "signature")


def changes(old: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (as of ``tree.nodes``) that a tree with signatures lacks, and the rows of it that aren't nodes any more, as stored
    tables. A file that has become a directory, or the other way round, is both.

    Both trees meet once, by path."""
    was, now = (df.select("path", "is_dir", F.lit(True).alias(side), *more) for df, side, more in ((old, "was", ["signature"]), (nodes, "now", [])))
    both = was.join(now, ["path", "is_dir"], "full_outer")
    changed = materialise(both.where("was IS NULL OR now IS NULL").select("path", "is_dir", "signature", F.col("now").isNotNull().alias("added")), "changed")
    parts = F.split("path", "/")
    depth, above = F.size(parts), F.slice(parts, 1, F.size(parts) - 1)
    placed = changed.withColumns({"depth": depth, "parent": F.when(depth > 1, F.array_join(above, "/")).otherwise("."), "name": F.element_at(parts, -1)})
    return placed.where("added").select(*_SIGNED[:-1]), placed.where("NOT added").select(*_SIGNED)


def affected(added: DataFrame, removed: DataFrame) -> DataFrame:
    """path, depth of the directories above what was added or removed, which are there still."""
    gone = removed.select("path").join(added.select("path"), "path", "left_anti")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), n.alias("depth")))
    changed = added.select("path", "depth").unionByName(removed.select("path", "depth")).where("depth > 1")
    return changed.select(F.explode(above).alias("a")).select("a.path", "a.depth").distinct().join(gone, "path", "left_anti")


def read_for(old: DataFrame, added: DataFrame, removed: DataFrame, dirs: DataFrame) -> DataFrame:
    """What a refresh reads of a tree with signatures, and what is added: the children of affected directories, and those of them that
    are at the top. held: their signature, null for added ones; own: whether they are affected."""
    new = added.select("path").join(removed.select("path"), "path", "left_anti")  # the old tree has nothing below them
    near = materialise(dirs.join(new, "path", "left_anti").select(F.col("path").alias("of")), "near")
    kids = old.join(near, old.parent == near.of, "left_semi").unionByName(old.where("depth = 1").join(near, old.path == near.of, "left_semi"))
    kids = kids.join(removed.select("path"), "path", "left_anti").select(*_SIGNED[:-1], F.col("signature").alias("held"))
    kids = kids.unionByName(added.withColumn("held", F.lit(None).cast("string")))
    own = dirs.select("path", F.lit(True).alias("own"))
    return kids.join(own, "path", "left").withColumn("own", F.coalesce("own", F.lit(False)))


def refresh(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows (path, parent, name, depth, is_dir, signature) in which signatures differ after nodes were added and removed: added nodes
    and the directories above a change.

    Only these directories are folded again, level by level from the deepest, from the signatures of their children; what is read of the old
    tree is their children, so work follows the changes and their depth, not the tree. A directory that loses all children is a leaf."""
    dirs = materialise(affected(added, removed), "affected")
    kids = materialise(read_for(old, added, removed, dirs), "kids")
    leaf = F.sha1(raw_path(F.col("name")))
    plain = kids.where("NOT own").withColumn("signature", F.coalesce("held", leaf))
    out, below = plain.where("held IS NULL").select(*_SIGNED), None
    for depth in range(dirs.agg(F.max("depth")).first()[0] or 0, 0, -1):
        children = plain.where(F.col("depth") == depth + 1).select("parent", "name", "signature")
        if below is not None:
            children = children.unionByName(below.select("parent", "name", "signature"))
        level = kids.where(F.col("own") & (F.col("depth") == depth))
        digests = _directories(children)
        folded = level.join(digests, level.path == digests.of, "left").withColumn("signature", F.coalesce("digest", leaf))
        below = materialise(folded.select(*_SIGNED), "level")
        out = out.unionByName(below)
    return out


def refreshed(old: DataFrame, delta: DataFrame, removed: DataFrame) -> DataFrame:
    """The tree with signatures after a refresh: old rows but for those that were removed or differ."""
    gone = removed.select("path").unionByName(delta.select("path"))
    return old.select(*_SIGNED).join(gone, "path", "left_anti").unionByName(delta)


def duplicate_subtrees(signed: DataFrame) -> DataFrame:
    """signature, path of directories with the same signature, where no directory above is itself a repetition.

    A traversal with siblings by name descending decides which is first. A directory is visited when each directory above it is
    the first of its signature. No directory has the signature of one above it, so the first is the one of the last place: a maximum
    per signature, combined before the shuffle."""
    return _members(signed).select("signature", "path")


def _members(signed: DataFrame) -> DataFrame:
    """signature, path, pre, last, first of duplicate_subtrees. Places are in the order of parts."""
    dirs = signed.where("is_dir").select("path", "signature", "pre", "last")
    first = dirs.groupBy("signature").agg(F.max("pre").alias("greatest"))
    marked = dirs.join(first, "signature").select("path", "signature", "pre", "last", (F.col("pre") == F.col("greatest")).alias("first"))
    visited = materialise(intervals.uncovered(marked, ~F.col("first")), "visited")
    shared = visited.groupBy("signature").count().where("count > 1").select("signature")
    return visited.join(shared, "signature")


def duplicate_lines(signed: DataFrame, with_trees: bool = False) -> DataFrame:
    """signature, part, path, pre, line: the printed report on duplicate subtrees; sort by the first four. with_trees: behind the paths of
    a group stands what is below its members.

    All members of a group look alike below, so that one is drawn which is no first of its signature: nothing below such a one is a member
    of a group, so the intervals that are drawn are apart from each other."""
    members = materialise(_members(signed), "members")
    row = lambda df, part, path, pre, line: df.select("signature", F.lit(part).alias("part"), path.alias("path"), pre.alias("pre"), line.alias("line"))
    none, zero = F.lit(""), F.lit(0).cast("long")
    groups = members.select("signature").distinct()
    out = row(groups, 0, none, zero, F.concat(F.lit("Signature: "), "signature")).unionByName(row(members, 1, F.col("path"), F.col("pre"), F.concat(F.lit("  "), "path")))
    out = out.unionByName(row(groups, 3, none, zero, none))
    if with_trees:
        drawn = members.where("NOT first").groupBy("signature").agg(F.min_by(F.struct("pre", "last"), "pre").alias("top"))
        tops = drawn.select(F.col("signature").alias("of"), F.col("top.pre").alias("pre"), F.col("top.last").alias("until"))
        inside = intervals.covered(signed, tops).where(F.col("of").isNotNull())
        below = tree.signed_lines(inside).where(F.col("pre") > F.col("start"))
        text = F.concat(F.lit("  "), F.substring("line", F.lit(5), F.length("line")))  # without the bar of the top itself
        out = out.unionByName(row(below.drop("signature").withColumnRenamed("of", "signature"), 2, none, F.col("pre"), text))
    return out


def root_signature(signed: DataFrame, name: str) -> DataFrame:
    """signature of a root of that name."""
    return _directories(signed.where("depth = 1"), name).select(F.col("digest").alias("signature"))


def duplicate_report(duplicates: DataFrame) -> DataFrame:
    """signature, members (paths ascending): one row per group of duplicate subtrees, by signature."""
    return duplicates.groupBy("signature").agg(F.array_sort(F.collect_list("path")).alias("members")).orderBy("signature")
