"""N-gram Jaccard join in the metric space of shingle sets (distance 1 - Jaccard), exact, as components of linked documents.

With threshold T and radius r = 1 - T, two documents link when their distance is at most r.

1. Classes. Documents with the same shingle set (128-bit fingerprint) are one point of the space.
2. Pivots. The ``pivots`` documents of a bounded sample that share most shingles with the rest of it, and at most
   APART of them with each other, lie in the dense parts of the space. Every point gets its exact distances to all pivots it shares shingles with. Its
   Voronoi region is the nearest pivot's if that is within CUT, else the open region. Points within r of a pivot are linked
   to it there and then.
3. Windows. By the triangle inequality, a point also goes to each region whose pivot is at most 2r farther than the
   nearest one, and to the open region if its nearest pivot is farther than CUT - r. So any two linked points meet.
4. Sub-regions. Distances between unrelated texts are all near 1, so no document divides them; a region is divided by rare
   shingles, in the order of (count in the sample, counts of its words in the sample, hash). A shingle that the sample doesn't have is as
   rare as its words, so that those of few documents come first in a corpus of any size. A point of n shingles goes to the sub-regions of
   its first n - ceil(T n) + 1 shingles: two linked points share one of these. Two points of each sub-region are its pivots, and all others
   are tested against them. Sub-regions whose points are then all connected fall away.
5. In the others, points of different components meet if their places in the order allow a link: the first shingle they
   share is at places i and j, so they share at most min(n - i, m - j); and if sketches of MARKS bits do.
6. Recursion. In sub-regions of over CROWD points, each point has its exact distance to a document of the sub-region, and only points
   meet whose distances differ by at most r (triangle inequality).
7. Pairs that meet are tested with odd sketches (parities of hashed shingles), whose Hamming distance never exceeds the
   symmetric difference, and pairs that pass are compared by their words.
8. Components of the links, labelled by the smallest doc_id.

The sample sets the order of shingles and the pivots, so it affects speed only, never results.

Words are runs of characters other than white space, A-Z in lower case. A document with fewer words than ``size`` has its whole
word sequence as one shingle; with none (or null text) it has no shingles and links with nothing. Documents with a null
doc_id link with nothing and have a null component. Repeated rows and rows with the same set share a component.
Equal doc_ids with different texts: each row by its own text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathgrove.sources.shared import outlasting, scratch

from .chat import batched
from .common import bounded_batches, held, materialise, release
from .components import components

SAMPLE, COMMON, CUT, CROWD, MARKS, APART = 12_000, 300_000, 0.7, 64, 512, 0.3
WORDS = 1 << 20  # buckets of word hashes
PIVOT_SHINGLES = (8, 4096)  # sizes of the documents that may be pivots: bounds what is broadcast


class _Words(dict):
    """Hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(held(("word hashes",), _Words).__getitem__, words), np.uint64, len(words))


def buckets(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(WORDS - 1)).astype(np.int32)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a text's shingles in its order, by the hashes of its words (one at least)."""
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = h[:n] + np.uint64(width)
    for i in range(1, width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending."""
    h = word_hashes(text)
    return np.unique(rolled(h, size)) if len(h) else np.zeros(0, np.uint64)


def ranked_shingles(text: str | None, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingles(), and for each how frequent its words are: the sum of their ranks."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, first = np.unique(rolled(h, size), return_index=True)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(ranks[buckets(h)], dtype=np.int64)])
    return out, sums[first + min(size, len(h))] - sums[first]


def exact_shingles(text: str | None, size: int) -> set[tuple]:
    words = words_of(text)
    return {tuple(words)} if 0 < len(words) < size else set(zip(*(words[i:] for i in range(size)), strict=False))


def sketch(h: np.ndarray) -> bytes:
    """Parities of the shingles per bucket; the number of buckets is a power of two, at least twice the shingles."""
    bits = max(64, 1 << int(2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def marks(h: np.ndarray) -> np.ndarray:
    """A sketch of the same size for every set."""
    return np.packbits((np.bincount((h & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1).astype(bool)).view(np.int64)


def fold(s: np.ndarray, size: int) -> np.ndarray:
    while s.shape[-1] > size:
        half = s.shape[-1] // 2
        s = s[..., :half] ^ s[..., half:]
    return s


@dataclass
class Space:
    """What every task knows: the order of common shingles, and the pivots by their shingles."""

    size: int
    num: int
    den: int
    tokens: np.ndarray  # ascending
    counts: np.ndarray  # in the sample, per token
    starts: np.ndarray  # per token, into pivot_of
    pivot_of: np.ndarray
    pivot_sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros(WORDS, np.uint8))  # of words, per bucket: 8 log2 of the count in the sample

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den

    def locate(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in tokens, and which of h are there."""
        if not len(self.tokens):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        return at, self.tokens[at] == h

    def first_keys(self, h: np.ndarray, words: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The shingles of the sub-regions that a point goes to, in order."""
        n = len(h)
        keep = n + (-n * self.num // self.den) + 1
        count = np.where(there, self.counts[at] if len(self.counts) else 0, 0)
        return h[np.lexsort((h, words, count))[:keep]]

    def regions(self, n: int, at: np.ndarray, there: np.ndarray) -> tuple[list[int], list[int]]:
        """Regions that the point goes to (-1: open), and the pivots that it links to."""
        own = at[there]
        if not len(own) or not len(self.pivot_sizes):
            return [-1], []
        span = self.starts[own + 1] - self.starts[own]
        own, span = own[span > 0], span[span > 0]
        if not len(own):
            return [-1], []
        index = np.repeat(self.starts[own] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        both = np.bincount(self.pivot_of[index], minlength=len(self.pivot_sizes))
        union = n + self.pivot_sizes - both
        distance = 1 - both / union
        nearest = distance.min()
        links = np.flatnonzero(self.den * both >= self.num * union)
        if nearest > CUT:
            return [-1], links.tolist()
        out = np.flatnonzero((distance <= nearest + 2 * self.radius + 1e-9) & (distance < 1)).tolist()
        return out + [-1] * bool(nearest > CUT - self.radius - 1e-9), links.tolist()


def sample_space(docs: DataFrame, size: int, num: int, den: int, pivots: int) -> tuple[Space, list[bytes]]:
    """The space from a bounded sample of distinct texts, and the pivots' fingerprints."""
    every = max(1, docs.count() // SAMPLE)
    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").where("text IS NOT NULL").distinct()

    def run(batches):
        schema = pa.schema([("fp", pa.binary()), ("n", pa.int64()), ("h", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])
        for b in batches:
            found = ((shingles(t, size), buckets(word_hashes(t))) for t in b.column(0).to_pylist())
            yield from batched(((fingerprint(h), len(h), h.view(np.int64), words) for h, words in found), schema, 200)

    sets = materialise(texts.mapInArrow(run, "fp binary, n long, h array<long>, words array<int>"), "sample")
    # at most WORDS rows; a word that the sample has once ranks as one that it doesn't have
    repeated = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("count")).where("count > 1").toArrow()
    ranks = np.zeros(WORDS, np.uint8)
    ranks[repeated.column("word").to_numpy()] = np.round(8 * np.log2(repeated.column("count").to_numpy())).clip(0, 255)
    # at most COMMON rows
    common = sets.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    # the densest: most shingles that others have too; sets with the same least shingle are mostly copies of each other
    seen = sets.select("fp", "n", F.explode("h").alias("h")).where(F.col("n").between(*PIVOT_SHINGLES))
    shared = sets.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 2")
    dense = seen.join(shared, "h").groupBy("fp", "n").agg((F.count("*") / F.col("n")).alias("share"), F.min("h").alias("least"))
    dense = dense.groupBy("least").agg(F.max(F.struct("share", "fp")).alias("best")).orderBy(F.desc("best")).limit(2 * pivots).select("best.*")
    found = sets.dropDuplicates(["fp"]).join(dense, "fp").orderBy(F.desc("share"), "fp").select("fp", "n", "h").toArrow()  # at most 2 * `pivots` rows
    hashes, prints, taken = [], [], np.zeros(0, np.uint64)
    for fp, h in zip(found.column("fp").to_pylist(), found.column("h").combine_chunks() if found.num_rows else (), strict=True):
        own = h.values.to_numpy().view(np.uint64)
        if len(hashes) < pivots and np.isin(own, taken).sum() <= APART * len(own):
            hashes.append(own.copy())
            prints.append(fp)
            taken = np.union1d(taken, own)
    release(sets)
    known = np.asarray(common.column("h").to_numpy(), np.int64).view(np.uint64)
    tokens = np.unique(np.concatenate([known, *hashes])) if len(known) or hashes else np.zeros(0, np.uint64)
    counts = np.zeros(len(tokens), np.int64)
    counts[np.searchsorted(tokens, known)] = common.column("count").to_numpy()
    at = np.concatenate([np.searchsorted(tokens, h) for h in hashes]) if hashes else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tokens)))]).astype(np.int64)
    return Space(size, num, den, tokens, counts.astype(np.int32), starts.astype(np.int32), owner[order].astype(np.int16), np.array([len(h) for h in hashes], np.int64), ranks), prints


def fingerprint(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


POINTS = "doc_id long, n long, fp binary, keys array<long>, sketch binary, marks array<long>, regions array<int>, links array<int>"
_POINTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("marks", pa.list_(pa.int64())), ("regions", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))])


def points(docs: DataFrame, space) -> DataFrame:
    def run(batches):
        s: Space = space.value

        def row(doc_id, text):
            h, words = ranked_shingles(text, s.size, s.ranks)
            if not len(h):
                return doc_id, 0, fingerprint(h), [], b"", [], [], []
            at, there = s.locate(h)
            return doc_id, len(h), fingerprint(h), s.first_keys(h, words, at, there).view(np.int64), sketch(h), marks(h), *s.regions(len(h), at, there)

        for b in batches:
            yield from batched((row(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), _POINTS, 500)

    return docs.mapInArrow(run, POINTS)


def may_link(a_n, b_n, a_sketch: np.ndarray, b_sketch: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sketches allow a link: J >= T means symmetric difference * (den + num) <= (den - num) * (sum of sizes)."""
    apart = np.bitwise_count(a_sketch ^ b_sketch).sum(axis=-1, dtype=np.int64)
    return apart * (den + num) <= (den - num) * (a_n + b_n)


def _sketch_filter(num: int, den: int):
    def run(batches):
        for b in batches:
            n = zip(*(b.column(c).to_pylist() for c in ("a_n", "b_n", "a_sketch", "b_sketch")), strict=True)
            keep = []
            for a_n, b_n, x, y in n:
                size = min(len(x), len(y))
                keep.append(bool(may_link(a_n, b_n, fold(np.frombuffer(x, np.uint8), size), fold(np.frombuffer(y, np.uint8), size), num, den)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(size: int, num: int, den: int):
    def run(batches):
        cached = functools.lru_cache(maxsize=8)(lambda t: exact_shingles(t, size))
        for b in batches:
            keep = []
            for x, y in zip(b.column("a_text").to_pylist(), b.column("b_text").to_pylist(), strict=True):
                p, q = cached(x), cached(y)
                both = len(p & q)
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _labelled(points: DataFrame, known: DataFrame) -> DataFrame:
    """points with their component so far as comp."""
    return points.join(known, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _shared(own: DataFrame) -> DataFrame:
    """The rows (region, key, node, n, pos, comp, size) of sub-regions whose points aren't all of one component yet."""
    shared = own.groupBy("region", "key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return materialise(own.join(shared.select("region", "key", "size"), ["region", "key"]), "members")


def _sized(num: int, den: int):
    """Whether the sizes of x and y allow a link."""
    return (den * F.col("x.n") >= num * F.col("y.n")) & (den * F.col("y.n") >= num * F.col("x.n"))


def _meetings(cells: DataFrame, num: int, den: int, window: float | None = None) -> DataFrame:
    """The pairs (a, b) of points of a sub-region (region, key) that may link through its shingle. cells: also node, n, pos, comp,
    marks and, with ``window``, distance (to the sub-region's pivot). The smaller point of a pair must have the shingle among its first
    n - ceil(2 T n / (1 + T)) + 1."""
    early = cells.where((num + den) * (F.col("n") - F.col("pos")) >= 2 * num * F.col("n"))
    shared = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = (F.struct("x.n", "x.node") < F.struct("y.n", "y.node")) & (F.col("x.comp") != F.col("y.comp")) & _sized(num, den)
    fits &= (num + den) * shared >= num * (F.col("x.n") + F.col("y.n"))
    if window is not None:
        fits &= F.abs(F.col("x.distance") - F.col("y.distance")) <= window + 1e-9
    apart = [F.bit_count(F.col("x.marks")[i].bitwiseXOR(F.col("y.marks")[i])) for i in range(MARKS // 64)]
    fits &= functools.reduce(lambda p, q: p + q, apart) * (den + num) <= (den - num) * (F.col("x.n") + F.col("y.n"))
    met = early.alias("x").join(cells.alias("y"), (F.col("x.region") == F.col("y.region")) & (F.col("x.key") == F.col("y.key")) & fits)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _crowded(docs: DataFrame, classes: DataFrame, members: DataFrame, space, num: int, den: int) -> DataFrame:
    """Pairs of the sub-regions of over CROWD points (step 6)."""
    pivots = materialise(members.groupBy("region", "key").agg(F.min("node").alias("pivot")), "pivots")
    zones = members.join(pivots, ["region", "key"]).groupBy("node").agg(F.collect_set("pivot").alias("pivots"))  # a pivot is a point of its own zone

    def sets_of(batches):
        schema = pa.schema([("node", pa.int64()), ("pivots", pa.list_(pa.int64())), ("h", pa.list_(pa.int64()))])
        for b in batches:
            sets = ((i, p, shingles(t, space.value.size), fp) for i, p, fp, t in zip(*(b.column(c).to_pylist() for c in ("node", "pivots", "fp", "text")), strict=True))
            yield from batched(((i, p, h.view(np.int64)) for i, p, h, fp in sets if fingerprint(h) == fp), schema, 200)

    def distances(batches):
        for b in batches:
            pairs = zip(b.column("h"), b.column("g"), strict=True)
            both = [(len(h), len(g), len(np.intersect1d(h.values.to_numpy(), g.values.to_numpy(), assume_unique=True))) for h, g in pairs]
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("node"), pa.array([1 - x / (n + m - x) for n, m, x in both], pa.float64())], ["pivot", "node", "distance"])

    sets = _own_texts(docs, classes.select("node", "fp").join(zones, "node")).mapInArrow(sets_of, "node long, pivots array<long>, h array<long>")
    sets = materialise(sets, "shingles")
    own = sets.join(pivots.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("node").alias("pivot")).agg(F.first("h").alias("g"))
    measured = sets.select("node", F.explode("pivots").alias("pivot"), "h").join(own, "pivot").mapInArrow(distances, "pivot long, node long, distance double")
    measured = materialise(measured.distinct(), "distances")
    release(sets)
    cells = members.join(pivots, ["region", "key"]).join(measured, ["pivot", "node"])
    pairs = materialise(_meetings(cells, num, den, 1 - num / den).distinct(), "crowded")
    release(pivots, measured)
    return pairs


def _own_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node, fp, more) with the texts of the rows whose doc_id is node: once each, also those whose set isn't of that fingerprint, as
    equal ids may have other texts. Dealt once, by doc_id."""
    return docs.join(wanted, docs.doc_id == wanted.node).drop("doc_id").dropDuplicates(["node", "text"])


def _links(docs: DataFrame, classes: DataFrame, size: int, num: int, den: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: first by sketches, then by the words of both texts."""
    sketches = classes.select("node", "n", "sketch")
    pairs = (
        pairs.join(sketches.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch")), "b")
        .select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(_sketch_filter(num, den), "a long, b long")
    )
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # a class's text: of a row that gave the class its number
    texts = _own_texts(docs, classes.select("node", "fp").join(wanted, "node", "left_semi")).mapInArrow(_of_fingerprint(size), "node long, text string")
    texts = materialise(texts, "texts")
    compared = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
        .select("a", "b", "a_text", "b_text").mapInArrow(_verify(size, num, den), "a long, b long")
    )
    links = materialise(compared, "links")
    release(pairs, texts)
    return links


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are deleted with the job that made them, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def link_documents(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, pivots: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs (doc_id, text). Linked when den * |A & B| >= num * |A | B|."""
    with _swept(docs.sparkSession):
        return _link_documents(docs, size, num, den, pivots)


def _link_documents(docs: DataFrame, size: int, num: int, den: int, pivots: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known, pivot_prints = sample_space(docs, size, num, den, pivots)
    space = spark.sparkContext.broadcast(known)  # bounded by COMMON and pivots * PIVOT_SHINGLES
    rows = materialise(points(docs, space), "points")
    classes = (
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp")
        .agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n", "keys", "sketch", "marks", "regions", "links")))
    )
    classes = materialise(classes, "classes")
    # one row per pivot
    homes = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pivot_prints)], "pivot int, fp binary").join(classes.select("fp", F.col("node").alias("home")), "fp")
    direct = classes.select("node", F.explode("links").alias("pivot")).join(F.broadcast(homes), "pivot").where("node <> home")
    direct = materialise(direct.select(F.least("node", "home").alias("a"), F.greatest("node", "home").alias("b")).distinct(), "pivot-links")
    first = components(direct)

    members = _labelled(classes.select("node", "n", "keys", "regions"), first).select("node", "n", "keys", "comp", F.explode("regions").alias("region"))
    members = _shared(members.select("region", "node", "n", "comp", F.posexplode("keys").alias("pos", "key")))
    test = functools.partial(_links, docs, classes, size, num, den)

    # the first and last point of a sub-region are its pivots: a group of copies is linked here, by a pair per point and pivot
    point = F.struct("node", "n", "comp")
    heads = members.groupBy("region", "key").agg(F.explode(F.array(F.min(point), F.max(point))).alias("y")).select("region", "key", "y.*")
    same = (F.col("x.region") == F.col("y.region")) & (F.col("x.key") == F.col("y.key"))
    stars = members.alias("x").join(heads.alias("y"), same & (F.col("x.comp") != F.col("y.comp")) & _sized(num, den))
    stars = materialise(stars.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "stars")
    linked = direct.union(test(stars))

    # then all others that are not connected yet
    rest = _shared(_labelled(members.select("region", "key", "node", "n", "pos"), components(linked)))
    release(members)
    cells = rest.join(classes.select("node", "marks"), "node")
    met = _meetings(cells.where(F.col("size") <= CROWD), num, den)
    met = met.union(_crowded(docs, classes, cells.where(F.col("size") > CROWD), space, num, den))
    labels = components(linked.union(test(met.distinct().join(stars, ["a", "b"], "left_anti"))))
    release(rest, stars)
    numbered = classes.select("fp", "node").join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(numbered, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with the document of the smallest doc_id of each group of linked documents.

    Rows without shingles or without a doc_id stay. Rows that share a doc_id are one document; equal rows stay once."""
    with scratch():
        links = outlasting(link_documents(docs, size, num, den), "links")
    stays = F.col("component_id").isNull() | (F.col("n_shingles") == 0) | (F.col("component_id") == F.col("doc_id"))
    ids = links.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("rows"))
    gone = ids.where("NOT stays").select("doc_id")
    kept = docs.join(gone, docs.doc_id.cast("long") == gone.doc_id, "left_anti")
    if ids.where("stays AND rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def _of_fingerprint(size: int):
    def run(batches):
        for b in batches:
            fits = [fingerprint(shingles(t, size)) == fp for t, fp in zip(b.column("text").to_pylist(), b.column("fp").to_pylist(), strict=True)]
            yield b.select(["node", "text"]).filter(pa.array(fits, pa.bool_()))

    return run
