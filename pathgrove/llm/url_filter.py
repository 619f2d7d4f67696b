"""URL filters by a path-template tree, with DataFrame functions only.

Every url is split into host and path, explicit rules are applied first, and pages that no rule fits are judged by the
template their path falls into:

1. Shapes. Each path segment is replaced by a wildcard for its kind when it is variable by form (numbers, numbers
   with a file ending, hexadecimal ids, mixed tokens); words stay literal. Pages are pre-aggregated per (host, shape path).
2. Generalisation. Level by level, where a node of a host's tree has many distinct literal children and no child
   is common (``max_children``, ``common_share``), its children become ``*``.
3. Merging. Sibling branches with the same child structure whose smoothed labelled rates fall in the same band
   (or that both lack labels) are merged to one branch.
4. Purity. A template's share of good labels, smoothed towards the overall share by ``smoothing`` pseudo-pages, rejects the
   template when it is under ``min_purity`` and ``min_labels`` labels stand behind it.

Labels are the pages that a rule decides (block: bad, allow: good), so the tree carries the rules' verdicts over to
look-alike paths of the same host, but only where step 2 pools them or their branches have labels of their own: a branch
without labels isn't merged with a labelled one. Templates without labels keep the overall share.

Null url or no "://": host and path are empty, no rule fits, and the row is judged by the template of the empty path.
Repeated rows each get their own row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, materialise

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Levels of the tree in the SQL check; judge_urls goes on to the tree's own depth.
LEVELS = 4
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (null where none does)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))

    def fits(r):
        own = (host == r[1]) | host.endswith("." + r[1])
        return own & path.startswith(r[2])

    def pick(value):
        return F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ordered]) if ordered else F.lit(None).cast("string")

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"\A[0-9]+\z"), "<num>")
        .when(segment.rlike(r"\A[0-9]+\.[A-Za-z]+\z"), "<num>.<ext>")
        .when(segment.rlike(r"\A[0-9a-fA-F-]{8,}\z"), "<hex>")
        .when(segment.rlike(r"[0-9]"), "<mixed>")
        .otherwise(segment)
    )


def judge_urls(
    pages: DataFrame, rules=RULES, max_children: int = 20, common_share: float = 0.05, min_labels: int = 5,
    smoothing: float = 4.0, min_purity: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = rows.withColumn("shapes", F.concat_ws("/", F.transform(parts, shape)))

    tree = rows.groupBy("host", "shapes").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("ruled") == "allow").alias("good"),
        F.count_if(F.col("ruled") == "block").alias("bad"),
    )
    tree = tree.select("*", F.split("shapes", "/").alias("parts"), F.lit("").alias("node"))
    tree = materialise(tree, "url-tree")
    depth = tree.agg(F.max(F.size("parts"))).first()[0] or 0
    ended = []  # an ended path is its parent's child without a name for one level more, then alone in its node
    for level in range(1, depth + 1):  # written per level: the tree is read several times, and the plan would grow as a power of the levels
        ended.append(tree.where(F.size("parts") < level - 1))
        tree = materialise(_level(tree.where(F.size("parts") >= level - 1), level, max_children, common_share, min_labels), "url-tree")
    tree = materialise(functools.reduce(DataFrame.unionByName, ended, tree), "url-tree")
    leaves = tree.groupBy("host", "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    prior = leaves.agg(F.coalesce(F.sum("good") / F.nullif(F.sum(F.col("good") + F.col("bad")), F.lit(0)), F.lit(1.0)).alias("prior"))
    # one row of prior: bounded by construction
    leaves = leaves.crossJoin(F.broadcast(prior)).select(
        "host", "node", ((F.col("good") + smoothing * F.col("prior")) / (F.col("good") + F.col("bad") + smoothing)).alias("purity"),
        (F.col("good") + F.col("bad")).alias("labels"),
    )
    judged = tree.select("host", "shapes", "node").join(leaves, ["host", "node"])
    # a host or template may hold a third of all pages: the small side is repeated for every salt
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(judged, ["host", "shapes", "salt"])
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when((F.col("purity") < min_purity) & (F.col("labels") >= min_labels), "block").otherwise("allow")).alias("verdict"),
        F.concat(F.col("host"), F.col("node")).alias("template"), "purity",
    )


def _level(tree: DataFrame, level: int, max_children: int, common_share: float, min_labels: int) -> DataFrame:
    """Extend every row's node by its branch at this level: a literal, a wildcard, or the name of a merged branch."""
    own = F.when(F.size("parts") >= level, F.get("parts", F.lit(level - 1))).otherwise("")
    after = F.when(F.size("parts") > level, F.get("parts", F.lit(level))).otherwise("")
    tree = tree.withColumns({"part": own, "kind": F.when(after.rlike(r"\A[<*]"), after).when(after == "", "").otherwise("word")})
    children = tree.groupBy("host", "node", "part").agg(
        F.sum("pages").alias("p"), F.sum("good").alias("g"), F.sum("bad").alias("b"),
        F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("below"),
    )
    parents = children.groupBy("host", "node").agg(
        F.count("*").alias("n_children"), (F.max("p") / F.sum("p")).alias("top_share"),
    )
    labels = F.col("g") + F.col("b")
    band = F.when(labels < min_labels, F.lit("?")).otherwise(F.floor((F.col("b") + 1) * 5 / (labels + 2)).cast("string"))
    literal = F.col("part").rlike(r"\A[^<*]")
    branch = (
        F.when(F.col("part") == "", "")
        .when(literal & (F.col("n_children") > max_children) & (F.col("top_share") < common_share), "/*")
        .when(literal, F.concat(F.lit("/["), F.col("below"), F.lit("~"), band, F.lit("]")))
        .otherwise(F.concat(F.lit("/"), F.col("part")))
    )
    named = children.join(parents, ["host", "node"]).select("host", "node", "part", branch.alias("branch"))
    return tree.join(named, ["host", "node", "part"]).select(
        "host", "shapes", "pages", "good", "bad", "parts", F.concat("node", "branch").alias("node")
    )
