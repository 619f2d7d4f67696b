"""The hierarchy of a snapshot: nodes with implied parents, subtrees, depth limits, counts and the rendered tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathgrove.functions.modes import is_dir

from . import intervals


def nodes(entries: DataFrame, only_dirs: bool = False) -> DataFrame:
    """path, parent, name, depth, parts, is_dir, implied: a node per path below the root, and per parent that has no row.

    Implied parents are no directories, as they have no mode. A path that occurs twice is one node (the last row's)."""
    rows = entries.where(F.col("path") != ".").groupBy("path").agg(F.max_by("mode", "idx").alias("mode"))
    if only_dirs:
        rows = rows.where(is_dir(F.col("mode")))
    rows = rows.select(intervals.parts_of(F.col("path")).alias("parts"), is_dir(F.col("mode")).alias("is_dir"))
    depths = F.sequence(F.lit(1), F.size("parts") - 1)
    above = rows.where(F.size("parts") > 1).select(F.explode(F.transform(depths, lambda n: F.slice("parts", 1, n))).alias("parts"))
    # one aggregate instead of an anti-join: a real row outranks an implied one
    both = rows.withColumn("real", F.lit(True)).unionByName(above.select("parts", F.lit(False).alias("is_dir"), F.lit(False).alias("real")))
    merged = both.groupBy("parts").agg(F.max("real").alias("real"), F.max("is_dir").alias("is_dir"))
    return merged.select(
        F.array_join("parts", "/").alias("path"),
        F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/")).otherwise(".").alias("parent"),
        F.element_at("parts", -1).alias("name"), F.size("parts").alias("depth"), "parts", "is_dir", (~F.col("real")).alias("implied"),
    )


def hidden(parts: Column) -> Column:
    return F.exists(parts, lambda x: x.startswith("."))


def within(tree: DataFrame, path: str, must_exist: bool = True) -> DataFrame:
    """The node at path and all below it, in a labelled tree; "." and "/" are the whole tree. A path that isn't there is an error, or,
    without must_exist, gives no rows."""
    path = "/".join(p for p in path.split("/") if p not in ("", "."))
    if not path:
        return tree
    top = tree.where(F.col("path") == path).select("pre", "last").first()
    if top is None and must_exist:
        raise ValueError(f"no such path: {path}")
    return intervals.below(tree, *(top or (1, 0)))


def limited(tree: DataFrame, limit: int) -> DataFrame:
    return tree if limit <= 0 else tree.where(F.col("depth") <= limit)


def counts(tree: DataFrame, with_root: bool = True) -> DataFrame:
    """Directories and others that a rendered tree shows; the root counts as a directory."""
    shown = tree.where(~hidden(F.col("parts")))
    return shown.agg((F.count_if(F.col("is_dir")) + int(with_root)).alias("directories"), F.count_if(~F.col("is_dir")).alias("files"))


def lines(tree: DataFrame) -> DataFrame:
    """The rows of a labelled tree with a column line, as they are rendered, in any order; sort by pre. A last child is marked before
    hidden ones are left out."""
    return intervals.lines(tree).where(~hidden(F.col("parts")))


def signed_lines(signed: DataFrame) -> DataFrame:
    """The rendered rows with each node's signature behind its name."""
    return lines(signed).withColumn("line", F.concat("line", F.lit("    ["), "signature", F.lit("]")))


def render(tree: DataFrame, root: str, signed: bool = False) -> str:
    """The text of a tree for display, with signatures if they are asked for: the rows come to the driver one by one, in order. The
    footer of a tree with signatures doesn't count the root."""
    rows = signed_lines(tree) if signed else lines(tree)
    text = [root, *(r["line"] for r in rows.orderBy("pre").toLocalIterator())]
    c = counts(tree, with_root=not signed).first()
    noun = lambda n, one, many: f"{n} {one if n == 1 else many}"
    return "\n".join([*text, "", f"{noun(c['directories'], 'directory', 'directories')}, {noun(c['files'], 'file', 'files')}"])
