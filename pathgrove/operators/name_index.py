"""An index of names for glob and regex searches: postings of the trigrams of distinct base names and of distinct directories.

A glob's literal runs behind its last "/" must occur in the base name, so their trigrams must too. The rarest of these give candidate names
by their postings; names that the pattern can't match fall away before entries are read, and entries are read from the buckets
of the remaining names only. The pattern is applied to what is left, so results are those of a scan.

A regular expression may match anywhere in the path, but texts that it needs (``patterns.regex_needs``) and that hold no "/" lie within one name:
the entry's own or a directory's above it. So each entry is stored twice, bucketed by its base name and by its directory; for the need
that the fewest entries can meet, candidate names and candidate directories are looked up in their postings, and the entries of both are read. What
has the text in both is taken from the directories' side only.

Patterns without a trigram, or whose rarest trigrams are in more than SHARE of the names (globs) or of the entries (regular expressions), scan. Trigrams are
of names with their case folded as Java's (?iu) folds ASCII letters, so one index serves all kinds of search; only ASCII runs of a pattern are used,
as these keep their place in that. Up to LITERALS candidates are literals of the read, so that row groups and pages of others are skipped.
The postings of directories grow with the lengths of distinct directory paths. Conditions on other columns scan as before.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from pathgrove.functions.modes import any_of
from pathgrove.functions.patterns import glob_runs, regex_needs
from pathgrove.functions.values import base_name
from pathgrove.operators.search import glob, regex

GRAM, RAREST, SHARE, BUCKETS, LITERALS, PAGE_ROWS = 3, 4, 0.2, 64, 200, 1000
KEYS = ("base", "dir")


@dataclass(frozen=True)
class Side:
    """The entries by one of KEYS."""

    key: str
    entries: DataFrame  # the snapshot's, with the key and its bucket
    postings: DataFrame  # gram, key, bucket
    grams: DataFrame  # gram, names: in how many distinct keys; rows: of how many entries
    names: int


@dataclass(frozen=True)
class NameIndex:
    base: Side
    dir: Side
    columns: tuple[str, ...]  # of the snapshot's entries
    rows: int

    @property
    def entries(self) -> DataFrame:
        return self.base.entries


def folded(text: Column) -> Column:
    """In lower case; the four other characters that match an ASCII letter when case is ignored are that letter."""
    return F.lower(F.translate(text, "ſİıK", "siik"))


def directory(path: Column) -> Column:
    """What stands before the base name, without the "/"; empty if there is none."""
    return F.when(path.contains("/"), F.substr(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)).otherwise("")


def _grams_of(text: Column) -> Column:
    """The distinct trigrams of a text of three characters or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM))))


def build(entries: DataFrame, path: str) -> NameIndex:
    """Write the index of entries to a folder that the cluster shares. Buckets are dealt by ranges of (bucket, key, idx), so a name or a directory that
    very many entries have is in the files of several tasks."""
    spark = entries.sparkSession
    totals = {}
    for key, value in zip(KEYS, (base_name(F.col("path")), directory(F.col("path"))), strict=True):
        at = f"{path}/{key}"
        keyed = entries.withColumn(key, value).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        dealt = keyed.repartitionByRange("bucket", key, "idx").sortWithinPartitions("bucket", key)
        dealt.write.option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("bucket").parquet(f"{at}/entries")
        names = spark.read.schema(keyed.schema).parquet(f"{at}/entries").groupBy(key, "bucket").agg(F.count("*").alias("rows"))
        text = folded(F.col(key))
        postings = names.where(F.length(text) >= GRAM).select(F.explode(_grams_of(text)).alias("gram"), key, "bucket", "rows").where("NOT contains(gram, '/')")
        postings.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{at}/postings")
        counts = spark.read.schema(postings.schema).parquet(f"{at}/postings").groupBy("gram").agg(F.count("*").alias("names"), F.sum("rows").alias("rows"))
        counts.write.parquet(f"{at}/grams")
        totals[key] = names.agg(F.count("*").alias(key), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    about = [(totals["base"]["base"], totals["dir"]["dir"], totals["base"]["rows"], entries.schema.json())]
    spark.createDataFrame(about, "base long, dir long, rows long, schema string").write.parquet(f"{path}/about")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> NameIndex:
    about = spark.read.parquet(f"{path}/about").first()  # the schema is kept, as folders of no rows have no files
    stored = StructType.fromJson(json.loads(about["schema"]))
    sides = []
    for key in KEYS:
        entries = spark.read.schema(StructType(list(stored.fields)).add(key, StringType()).add("bucket", IntegerType())).parquet(f"{path}/{key}/entries")
        postings = spark.read.schema(f"gram string, {key} string, bucket int, rows long").parquet(f"{path}/{key}/postings")
        sides.append(Side(key, entries, postings, spark.read.schema("gram string, names long, rows long").parquet(f"{path}/{key}/grams"), about[key]))
    return NameIndex(*sides, tuple(stored.names), about["rows"])


def needed(pattern: str, base_only: bool = True, insensitive: bool = False) -> set[str]:
    """Trigrams that the folded base name of every match of a glob has."""
    runs = glob_runs(pattern.lower() if insensitive else pattern, base_only)
    return {g for run in runs for g in _grams(run.lower()) if g.isascii()}


def _grams(text: str) -> list[str]:
    return [text[k : k + GRAM] for k in range(len(text) - GRAM + 1)]


def candidates(index: NameIndex, grams: set[str]) -> DataFrame | None:
    """The names (base, bucket) with the rarest of the trigrams; None: a scan is as good."""
    if not grams:
        return None
    side = index.base
    known = {r.gram: r.names for r in side.grams.where(F.col("gram").isin(*grams)).collect()}  # at most a row per trigram of the pattern
    rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:RAREST]
    if known.get(rarest[0], 0) > SHARE * side.names:
        return None
    hits = side.postings.where(F.col("gram").isin(*rarest)).groupBy("base", "bucket").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") == len(rarest)).select("base", "bucket")


def _entries_of(side: Side, names: DataFrame) -> DataFrame:
    """The entries of the names given (key, bucket)."""
    few = names.limit(LITERALS + 1).collect()
    if len(few) <= LITERALS:
        return side.entries.where(F.col("bucket").isin(*{r["bucket"] for r in few}) & F.col(side.key).isin(*[r[side.key] for r in few]))
    buckets = [r.bucket for r in names.select("bucket").distinct().collect()]  # at most BUCKETS
    return side.entries.where(F.col("bucket").isin(*buckets)).join(names, ["bucket", side.key], "left_semi")


def find(index: NameIndex, pattern: str, base_only: bool = True, insensitive: bool = False) -> DataFrame:
    """The entries whose base name (or whole path) the glob matches, as ``search`` with ``glob`` finds them."""
    condition = glob(pattern, base_only, insensitive)
    rows, names = index.entries, candidates(index, needed(pattern, base_only, insensitive))
    if names is not None:
        if base_only:
            names = names.withColumn("path", F.col("base")).where(condition).drop("path")  # a base name is the base name of itself
        rows = _entries_of(index.base, names)
    return rows.where(condition).select(*index.columns)


def rarest_need(index: NameIndex, pattern: str) -> frozenset[str] | None:
    """Of what a regular expression needs, the texts that the fewest entries can have; None: a scan is as good."""
    needs = regex_needs(pattern, GRAM)
    grams = {g for need in needs for text in need for g in _grams(text)}
    if not grams:
        return None
    held = [{r.gram: r.rows for r in side.grams.where(F.col("gram").isin(*grams)).collect()} for side in (index.base, index.dir)]
    # an entry counts for each text and side, so this is a bound from above
    rows = {need: sum(min(of.get(g, 0) for g in _grams(text)) for text in need for of in held) for need in needs}
    best = min(needs, key=lambda need: (rows[need], sorted(need)))
    return None if rows[best] > SHARE * index.rows else best


def _holding(side: Side, need: frozenset[str]) -> DataFrame:
    """The names (key, bucket) that hold a text of the need."""
    held = [set(_grams(text)) for text in need]
    found = side.postings.where(F.col("gram").isin(*set().union(*held))).groupBy(side.key, "bucket").agg(F.collect_set("gram").alias("grams"))  # at most the pattern's
    likely = any_of([F.size(F.array_intersect("grams", F.array(*map(F.lit, sorted(g))))) == len(g) for g in held])
    return found.where(likely & _holds(F.col(side.key), need)).select(side.key, "bucket")


def _holds(names: Column, need: frozenset[str]) -> Column:
    return any_of([folded(names).contains(text) for text in sorted(need)])


def find_regex(index: NameIndex, pattern: str, insensitive: bool = False) -> DataFrame:
    """The entries whose path the RE2 pattern matches, as ``search`` with ``regex`` finds them."""
    condition = regex(pattern, insensitive)
    need = rarest_need(index, pattern)
    if need is None:
        return index.entries.where(condition).select(*index.columns)
    below = _entries_of(index.dir, _holding(index.dir, need)).where(condition).select(*index.columns)
    own = _entries_of(index.base, _holding(index.base, need)).where(condition & ~_holds(directory(F.col("path")), need)).select(*index.columns)
    return below.unionByName(own)
