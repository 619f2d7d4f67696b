"""Source divergence audit: how far the term shares of the sources of a language are from each other, exactly.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that at least ``least``
of its documents hold. Every (lang, source) group and every language has counts over the language's kept terms, and from these
shares p in billionths, with 5 added to each count. Two parts come out: ``pair``, the sum of |p - q| for each two sources of a
language, and ``term``, the terms that a group uses more than its language, the first ``top`` of them.

* Counting: tasks split whole texts and count per group and term; the counts of a task are combined before the shuffle, in a table
  that is passed on when it is full. A hot source is many partial rows, never one task.
* Pairs: kept terms are numbered within chunks of the vocabulary, by hash; a group's counts in a chunk are one packed vector. Groups
  are dealt to blocks, by hash, and each vector is replicated to the tiles (block by block) of its block's row and column. A tile's
  task takes its vectors chunk by chunk, turns them to shares and adds to its submatrix of sums; it holds the vectors of one chunk.
  Long vocabularies are cut into spans of chunks whose submatrices are added. Terms that neither block holds in a chunk have two
  constant shares, so they are added at the end, by their number.
* Terms: shares by decimals in the plan, the best of a group by a window whose limit Spark applies before the shuffle.

Null text, lang or source: empty. Texts without terms: their group exists, with counts of 0. A language without kept terms has pairs of
value 0 and no terms. Ties: by item. Repeated rows count again. doc_id isn't used. An empty table gives no rows. Other columns are
ignored. Counts may reach 9 * 10^15 for shares in 64-bit integers; above, tiles compute in Python's integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, materialise, release

#: Counted entries that a task holds before it passes them on.
HELD = 200_000
#: Terms in a chunk, groups in a block, chunks in a span.
CHUNK, BLOCK, SPAN = 16_384, 64, 64
SCALE = 1_000_000_000
#: Upper case to lower case, all that is no part of a term to a space.
_TERMS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def _count(batches):
    """Rows (lang, source, term, count, docs) of a task's texts; each group also has a row of the empty term."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def passed():
        for (lang, source), found in counts.items():
            terms, held = list(found), docs[lang, source]
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                same = [[lang] * len(part), [source] * len(part), [t.decode() for t in part], [found[t] for t in part], [held[t] for t in part]]
                yield pa.RecordBatch.from_pydict(dict(zip(_COUNTED.names, same, strict=True)), _COUNTED)
        counts.clear()
        docs.clear()

    for b in batches:
        texts = b.column(2).cast(pa.binary()).to_pylist()
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
            group = lang, source
            if group not in counts:
                counts[group], docs[group] = Counter({b"": 0}), Counter()
            terms = text.translate(_TERMS).split()
            counts[group].update(terms)
            docs[group].update(set(terms))
        if sum(map(len, counts.values())) > HELD:
            yield from passed()
    yield from passed()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences and documents of each term in each group, and a row of term '' per group."""
    bounded_batches(docs.sparkSession)
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = given.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 5) / total), digit groups of a thousand at a time, so that nothing overflows; counts + 5 <= total."""
    if int(total.max(initial=0)) >= 2**63 // 1000:
        counts, total = counts.astype(object), total.astype(object)
    rest, share = counts + 5, counts * 0
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // total
        rest = rest % total
    return share + 1


class _Tile:
    """The submatrix of one tile: rows are the groups of its first block, columns those of its second one."""

    def __init__(self, key: tuple):
        self.key, self.names, self.blocks, self.totals, self.terms = key, [], [], [], 0
        self.place: dict[str, int] = {}
        self.sums = None

    def group(self, source: str, block: int, n: int, terms: int) -> None:
        self.place[source] = len(self.names)
        self.names.append(source)
        self.blocks.append(block)
        self.totals.append(n + 5 * terms)
        self.terms = terms

    def begin(self) -> None:
        blocks = np.array(self.blocks)
        self.rows, self.columns = np.flatnonzero(blocks == self.key[1]), np.flatnonzero(blocks == self.key[2])
        self.total = np.array(self.totals, dtype=object if max(self.totals, default=0) >= 2**63 else np.int64)[:, None]
        self.sums, self.present = np.zeros((len(self.rows), len(self.columns)), dtype=np.int64), 0

    def add(self, vectors: list[tuple]) -> None:
        """The vectors (source, slots, counts) of one chunk."""
        if self.sums is None:
            self.begin()
        slots, where = np.unique(np.concatenate([s for _, s, _ in vectors]), return_inverse=True)
        counts, at = np.zeros((len(self.names), len(slots)), dtype=np.int64), 0
        for source, s, c in vectors:
            counts[self.place[source], where[at : at + len(s)]] = c
            at += len(s)
        p = shares(counts, self.total).astype(np.int64)  # up to 1,000,000,001
        columns = p[self.columns]
        for i, row in enumerate(self.rows):
            self.sums[i] += np.abs(columns - p[row]).sum(axis=1)
        self.present += len(slots)

    def pairs(self):
        if self.sums is None:
            self.begin()
        flat = shares(np.zeros_like(self.total), self.total).astype(np.int64)[:, 0] if self.terms else np.zeros(len(self.names), dtype=np.int64)
        for i, row in enumerate(self.rows):
            keep = self.columns > row if self.key[1] == self.key[2] else np.full(len(self.columns), True)
            columns, n = self.columns[keep], int(keep.sum())
            if n:
                data = [[self.key[0]] * n, [self.names[row]] * n, [self.names[j] for j in columns], self.sums[i][keep], [self.present] * n, np.abs(flat[columns] - flat[row]), [self.terms] * n]
                yield pa.RecordBatch.from_pydict(dict(zip(_SUMS.names, data, strict=True)), _SUMS)


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("near", pa.int64()), ("present", pa.int64()), ("flat", pa.int64()), ("terms", pa.int64())])


def _tiles(batches):
    """Submatrices of rows (lang, x, y, span, chunk, source, block, n, terms, slots, counts) in the order of tile and chunk; a tile's
    groups come first, as chunk -1."""
    tile, chunk, vectors = None, None, []
    for b in batches:
        named = [b.column(i).to_pylist() for i in range(9)]
        for i, (lang, x, y, span, c, source, block, n, terms) in enumerate(zip(*named, strict=True)):
            key = lang, x, y, span
            if vectors and (tile.key != key or c != chunk):
                tile.add(vectors)
                vectors = []
            if tile is None or tile.key != key:
                if tile is not None:
                    yield from tile.pairs()
                tile = _Tile(key)
            chunk = c
            if c < 0:
                tile.group(source, block, n, terms)
            else:
                vectors.append((source, b.column(9)[i].values.to_numpy(zero_copy_only=False), b.column(10)[i].values.to_numpy(zero_copy_only=False)))
    if vectors:
        tile.add(vectors)
    if tile is not None:
        yield from tile.pairs()


def _parts(df: DataFrame, by: str, most: int) -> int:
    """Of how many parts of ``most`` rows the largest group of df is."""
    largest = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0  # one number
    return max(1, -(-largest // most))


def pair_sums(kept: DataFrame, groups: DataFrame, vocabulary: int) -> DataFrame:
    """lang, source, item, value for each two sources of a language, in both orders. kept: lang, source, chunk, slot, count;
    groups: lang, source, n, terms; vocabulary: chunks of the largest language."""
    blocks, spans = _parts(groups, "lang", BLOCK), -(-vocabulary // SPAN)
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
    vectors = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("slot", "count")).alias("v"))  # a chunk at most
    vectors = vectors.join(groups.select("lang", "source", "block"), ["lang", "source"]).select(
        "lang", "chunk", F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "source", "block", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("terms"), F.col("v.slot").alias("slots"), F.col("v.count").alias("counts"),
    )
    heads = groups.select(
        "lang", F.lit(-1).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), "source", "block", "n", "terms",
        F.array().cast("array<int>").alias("slots"), F.array().cast("array<long>").alias("counts"),
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = heads.unionByName(vectors).withColumn("other", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    dealt = dealt.repartition("lang", "x", "y", "span").sortWithinPartitions("lang", "x", "y", "span", "chunk")
    sums = dealt.select("lang", "x", "y", "span", "chunk", "source", "block", "n", "terms", "slots", "counts").mapInArrow(_tiles, "lang string, source string, item string, near long, present long, flat long, terms long")
    added = sums.groupBy("lang", "source", "item").agg(F.sum("near").alias("near"), F.sum("present").alias("present"), F.max("flat").alias("flat"), F.max("terms").alias("terms"))
    value = (F.col("near") + (F.col("terms") - F.col("present")) * F.col("flat")).alias("value")
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    return added.select("lang", ways, value).select("lang", "way.source", "way.item", "value")


def _share(count: Column, total: Column) -> Column:
    scaled = (count + 5).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, total.cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: every other source of a group's language by distance, and the group's
    first ``top`` terms by how much their share is above the language's."""
    counted = materialise(count_terms(docs), "counted")
    terms = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang")).where(F.col("docs") >= least)
    terms = materialise(terms.drop("docs"), "terms")
    chunks = _parts(terms, "lang", CHUNK)
    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")
    numbered = terms.withColumn("chunk", chunk).withColumn("slot", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    kept = materialise(counted.where("term <> ''").drop("docs").join(numbered, ["lang", "term"]), "kept")
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_n"))
    zero = F.lit(0).cast("long")
    groups = counted.where("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = materialise(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "terms", "lang_n")]), "groups")
    release(terms)

    pairs = pair_sums(kept, groups.select("lang", "source", "n", "terms"), chunks)
    p, q = _share(F.col("count"), F.col("n") + 5 * F.col("terms")), _share(F.col("in_lang"), F.col("lang_n") + 5 * F.col("terms"))
    above = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top))
