"""Removal of repeated passages (suffix-array dedup) by distributed prefix doubling over sampled positions.

A byte goes when it is covered by a string of LENGTH = 200 bytes that also starts anywhere else, in the same document or another;
strings are judged on the input, in UTF-8 bytes, and never cross documents.

1. Distinct texts (by 96 bits of two hashes) are written once, bucketed by them, with their number of copies. A text of
   LENGTH bytes or more with copies is covered whole; one of each stays as a possible match of others.
2. Ranks of BLOCK = 100 bytes. Each window of LENGTH bytes selects its block of the least hash (leftmost on ties). The choice
   depends on the window's bytes alone, so equal windows select equal blocks at equal offsets: only the selected
   positions (about one in 51) are sorted by rank, and those whose rank is unique are done.
3. Doubling. The rest are reranked by the pairs of ranks at offsets -100 and 0, and 0 and 100 (200 bytes), and by the pair of
   these (300 bytes, the farthest that a window reaches). Positions with an equal rank of 300 bytes have all their
   windows repeated; one of them stays as a possible match of others.
4. For the rest, a window is a block with a bytes on its left and 100 - a on its right. For each rank of 100 bytes that still has
   two positions, the a for which both ends occur twice are found: within one task for ranks of up to GROUP positions,
   else as rows of a shuffle.
5. The covered intervals are merged per text, and the text is cut.

Ranks are 64-bit hashes. They only find candidates: two positions or windows count as equal when a second, independent 64-bit
hash of their bytes is equal too (128 bits together), so a collision of ranks costs time and changes nothing. Null text: empty. Texts under LENGTH bytes are left as they are. Repeated rows are copies of each
other. Null doc_id: kept as null. An empty table gives an empty result. Very long texts are scanned in segments.
``cut_documents`` keeps all other columns; a character that is cut in two is dropped from the text with its cut part.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathgrove.sources.shared import outlasting, remove, scratch, shared_dir

from .chat import batched
from .common import bounded_batches, fresh, materialise

LENGTH, BLOCK = 200, 100
WINDOW = LENGTH - BLOCK + 1
GROUP, SEGMENT = 4096, 1 << 20
_POSITION = (1 << 24) - 1
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(SEGMENT + 1024, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
_INVERSE = np.cumprod(np.full(SEGMENT + 1024, pow(_BASE, -1, 1 << 64), np.uint64)) * np.uint64(_BASE)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS_2 = np.cumprod(np.full(BLOCK, 0xD1342543DE82EF95, np.uint64))
_BYTES_2 = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def block_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of the block at every position."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _POWERS[: len(data)])])
    return mix((sums[BLOCK:] - sums[:-BLOCK]) * _INVERSE[: len(data) - BLOCK + 1])


def selected(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that some window selects, ascending, and their ranks."""
    positions, ranks = [], []
    for start in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        rank = block_ranks(data[start : start + SEGMENT + LENGTH - 1])
        n = len(rank) - WINDOW + 1
        key = np.full(-(-len(rank) // WINDOW) * WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[: len(rank)] = rank & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(rank), dtype=np.uint64)
        rows = key.reshape(-1, WINDOW)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        behind = np.minimum.accumulate(rows, axis=1).ravel()[WINDOW - 1 : WINDOW - 1 + n]
        least = np.minimum(ahead, behind)
        at = (least[np.concatenate([[True], least[1:] != least[:-1]])] & np.uint64(_POSITION)).astype(np.int64)
        at = np.unique(at)
        positions.append(at + start)
        ranks.append(rank[at])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(positions), return_index=True)
    return at, np.concatenate(ranks)[first]


def around(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks and second hashes of the blocks at offsets -BLOCK, 0 and BLOCK as [position, block], and which of them lie within the text."""
    starts = at[:, None] + np.arange(-1, 2) * BLOCK
    inside = (starts >= 0) & (starts + BLOCK <= len(data))
    index = np.where(inside, starts, 0)[:, :, None] + np.arange(BLOCK)
    block = data[index]
    rank = mix((_BYTES[block] * _POWERS[:BLOCK]).sum(axis=2, dtype=np.uint64))
    return rank, mix((_BYTES_2[block] * _POWERS_2).sum(axis=2, dtype=np.uint64)), inside


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))))


def ends_of(data: np.ndarray, start: int) -> tuple[bytes, bytes]:
    """Up to BLOCK bytes in front of the block at start (nearest first) and up to BLOCK behind it."""
    return data[max(0, start - BLOCK) : start][::-1].tobytes(), data[start + BLOCK : start + 2 * BLOCK].tobytes()


def window_keys(t, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of t (rank, second, left, right), every window of LENGTH bytes that lies within the text: its row, the number a
    of its bytes in front of the block, its key and its second key. Equal windows around equal blocks have both keys equal."""

    def padded(parts):
        data = np.zeros((len(parts), BLOCK), np.uint8)
        for i, p in enumerate(parts):
            data[i, : len(p)] = np.frombuffer(p, np.uint8)
        return data, np.array([len(p) for p in parts], np.int64)

    def sums(data, values, powers):
        return mix(np.pad(np.cumsum(values[data] * powers, axis=1, dtype=np.uint64), ((0, 0), (1, 0))))

    (left, n_left), (right, n_right) = padded(t.column("left").to_pylist()), padded(t.column("right").to_pylist())
    a = np.arange(BLOCK + 1)
    row, a = np.nonzero((n_left[:, None] >= a) & (n_right[:, None] >= BLOCK - a))
    keys = []
    for name, values, powers in (("rank", _BYTES, _POWERS[:BLOCK]), ("second", _BYTES_2, _POWERS_2)):
        ends = paired(sums(left, values, powers)[row, a], sums(right, values, powers)[row, BLOCK - a])
        block = t.column(name).to_numpy().view(np.uint64)
        keys.append(paired(paired(block[row], a.astype(np.uint64)), ends))
    return row, a, keys[0] & mask, keys[1]


def spans(found: np.ndarray, start: int) -> list[tuple[int, int]]:
    """The byte intervals covered by the windows that begin a bytes in front of start, for the a that are found."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    return [(start - int(z) + 1, start - int(a) + LENGTH) for a, z in edge.reshape(-1, 2)]


KEY = ["k1", "k2"]
_KEY = [("k1", pa.int64()), ("k2", pa.int32())]


def _texts(docs: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """The distinct texts (k1, k2, text, copies) as a table bucketed by its key, so that joins on it leave the texts where they are. Its files
    are in the shared folder; the catalogue only knows its buckets, until ``_dropped``."""
    name = f"pathgrove_texts_{uuid.uuid4().hex}"
    rows = docs.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    path = f"{shared_dir(docs.sparkSession)}/{name}"
    rows.write.format("parquet").option("path", path).bucketBy(parts, *KEY).option("compression", "zstd").saveAsTable(name)
    return docs.sparkSession.table(name), name


def _dropped(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    remove(spark, f"{shared_dir(spark)}/{name}")


def _twice(df: DataFrame, *columns: str) -> DataFrame:
    """The rows whose values in columns occur twice. Counted by partial aggregates; the values are a table of their own, so that Spark
    can split the join's partitions where a value is common."""
    values = materialise(df.groupBy(*columns).count().where("count > 1").select(*columns), "twice")
    return df.join(values, list(columns), "left_semi")


def covered_intervals(texts: DataFrame, bits: int = 64) -> DataFrame:
    """k1, k2, spans: the covered byte intervals of every text (k1, k2, text, copies) that has any, but for whole copies. Ranks and
    keys keep their lowest ``bits`` bits; with few of them they collide, which must not change the result."""
    mask = np.uint64((1 << bits) - 1)
    long = texts.where(F.octet_length("text") >= LENGTH)

    def anchors(batches):
        schema = pa.schema([*_KEY, ("pos", pa.int32()), ("rank", pa.int64())])
        for b in batches:
            for k1, k2, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, rank = selected(np.frombuffer(text.encode(), np.uint8))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k1)), pa.array(np.full(len(at), k2, np.int32)), pa.array(at.astype(np.int32)), pa.array((rank & mask).view(np.int64))], schema=schema)

    places = materialise(long.select(*KEY, "text").mapInArrow(anchors, "k1 long, k2 int, pos int, rank long"), "anchors")
    repeated = materialise(_twice(places, "rank").groupBy(*KEY).agg(F.collect_list("pos").alias("at")), "repeated")

    def blocks(batches):
        schema = pa.schema([*_KEY, ("pos", pa.int32()), ("before", pa.int64()), ("rank", pa.int64()), ("after", pa.int64()), ("second", pa.int64()), ("second_full", pa.int64())])
        for b in batches:
            for k1, k2, text, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.array(at)
                rank, second, inside = around(np.frombuffer(text.encode(), np.uint8), at)
                sides = [pa.array((rank[:, j] & mask).view(np.int64), mask=~inside[:, j]) for j in range(3)]
                sides += [pa.array(h.view(np.int64)) for h in (second[:, 1].copy(), paired(paired(second[:, 0], second[:, 1]), second[:, 2]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k1)), pa.array(np.full(len(at), k2, np.int32)), pa.array(at.astype(np.int32)), *sides], schema=schema)

    ranked = long.join(repeated, KEY).select(*KEY, "text", "at").mapInArrow(blocks, "k1 long, k2 int, pos int, before long, rank long, after long, second long, second_full long")
    # doubling: ranks of 200 bytes by pairs at offset 100, then of 300; a position too near the text's edge has a rank of its own
    pairs = ranked.select(*KEY, "pos", "rank", "second", "second_full", F.xxhash64("before", "rank").alias("low"), F.xxhash64("rank", "after").alias("high"), (F.col("before").isNull() | F.col("after").isNull()).alias("edge"))
    full = pairs.select(*KEY, "pos", "rank", "second", F.when(F.col("edge"), F.xxhash64(F.lit("edge"), *KEY, "pos")).otherwise(F.col("second_full")).alias("second_full"), F.when(F.col("edge"), F.xxhash64(*KEY, "pos", F.lit("edge"))).otherwise(F.xxhash64("low", "high")).alias("full"))
    full = materialise(full.withColumn("place", F.xxhash64(*KEY, "pos")), "ranks")
    same = materialise(full.groupBy("full", "second_full").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1"), "same")
    marked = full.join(same, ["full", "second_full"], "left").select(*KEY, "pos", "rank", "second", F.col("n").isNotNull().alias("all"), (F.col("n").isNull() | (F.col("first") == F.col("place"))).alias("one"))
    marked = materialise(marked, "marked")
    whole = marked.where("all").select(*KEY, (F.col("pos") - BLOCK).cast("long").alias("start"), (F.col("pos") + LENGTH).cast("long").alias("end"))

    still = marked.where("one")
    still = still.join(still.groupBy("rank", "second").agg(F.count("*").alias("size")).where("size > 1"), ["rank", "second"])
    place = F.struct("pos", "rank", "second", "all", (F.col("size") > GROUP).alias("large"))
    still = still.groupBy(*KEY).agg(F.collect_list(place).alias("xs"))
    kind = "rank long, second long, k1 long, k2 int, start int, all boolean, large boolean, left binary, right binary"
    names = pa.schema([("rank", pa.int64()), ("second", pa.int64()), *_KEY, ("start", pa.int32()), ("all", pa.bool_()), ("large", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])

    def ends(batches):
        def rows():
            for b in batches:
                for k1, k2, text, xs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = np.frombuffer(text.encode(), np.uint8)
                    for x in xs:
                        yield x["rank"], x["second"], k1, k2, x["pos"], x["all"], x["large"], *ends_of(data, x["pos"])

        yield from batched(rows(), names, 4000)

    edges = materialise(long.join(still, KEY).select(*KEY, "text", "xs").mapInArrow(ends, kind), "ends")
    small = edges.where("NOT large").repartition("rank", "second").sortWithinPartitions("rank", "second").mapInArrow(partial(_small_groups, mask=mask), "k1 long, k2 int, start long, end long")
    covered = whole.union(small).union(_large_groups(edges.where("large"), mask))
    return covered.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _small_groups(batches, mask: np.uint64):
    """The covered intervals of every rank's positions; the rows come sorted by (rank, second), which have at most GROUP rows."""
    schema = pa.schema([*_KEY, ("start", pa.int64()), ("end", pa.int64())])

    names = ("rank", "second", "k1", "k2", "start", "all", "left", "right")

    def groups():
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b.select(names)])
            t = t if rest is None else pa.concat_tables([rest, t])
            if t.num_rows:
                rank, second = t.column("rank").to_numpy(), t.column("second").to_numpy()
                cut = int(np.searchsorted((rank == rank[-1]) & (second == second[-1]), True))  # the last rank may go on in the next batch
                rest = t.slice(cut)
                if cut:
                    yield t.slice(0, cut)
        if rest is not None and rest.num_rows:
            yield rest

    def intervals():
        for t in groups():
            k1, k2, at = (t.column(c).to_pylist() for c in ("k1", "k2", "start"))
            # equal keys in two rows: the window occurs twice
            row, a, key, second = window_keys(t, mask)
            order = np.lexsort((second, key))
            same = (key[order][1:] == key[order][:-1]) & (second[order][1:] == second[order][:-1])
            twice = np.zeros(len(key), bool)
            if len(key):
                twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            found = np.zeros((t.num_rows, BLOCK + 1), bool)
            found[row[twice], a[twice]] = True
            for i in np.flatnonzero(found.any(axis=1) & ~t.column("all").to_numpy(zero_copy_only=False)):
                for start, end in spans(found[i], at[i]):
                    yield k1[i], k2[i], start, end

    yield from batched(intervals(), schema, 4000)


def _large_groups(rows: DataFrame, mask: np.uint64) -> DataFrame:
    """The same for ranks of any number of positions, as rows of a shuffle."""

    def explode(batches):
        for b in batches:
            row, a, key, second = window_keys(b, mask)
            own = b.select(["k1", "k2", "all"]).take(pa.array(row))
            start = b.column("start").to_numpy()[row].astype(np.int64) - a
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(start), pa.array(key.view(np.int64)), pa.array(second.view(np.int64))], [*own.schema.names, "start", "key", "second"])

    each = rows.select("rank", "second", *KEY, "start", "all", "left", "right").mapInArrow(explode, "k1 long, k2 int, all boolean, start long, key long, second long")
    return _twice(each, "key", "second").where("NOT all").select(*KEY, "start", (F.col("start") + LENGTH).alias("end"))


def merge(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of intervals; touching ones become one."""
    out: list[list[int]] = []
    for a, z in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


_CUTS = pa.schema([*_KEY, ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def cut_texts(texts: DataFrame, covered: DataFrame, keep_text: bool) -> DataFrame:
    """k1, k2, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, the kept text of every distinct text."""

    def run(batches):
        def row(k1, k2, text, copies, found):
            data = text.encode()
            if copies > 1 and len(data) >= LENGTH:
                cut = [(0, len(data))]
            else:
                cut = merge([s["start"] for s in found or ()], [s["end"] for s in found or ()])
            kept, at = [], 0
            for a, z in cut:
                kept.append(data[at:a])
                at = z
            kept = b"".join([*kept, data[at:]])
            return k1, k2, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if keep_text else None

        for b in batches:
            yield from batched((row(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), _CUTS)

    rows = texts.join(covered, KEY, "left").select(*KEY, "text", "copies", "spans")
    return rows.mapInArrow(run, "k1 long, k2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def repeated_passages(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs (doc_id, text). bits: as in covered_intervals."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", _text().alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))
    texts, name = _texts(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        with scratch():
            cuts = outlasting(cut_texts(texts, covered_intervals(texts, bits), False).drop("kept"), "cuts")
    finally:
        _dropped(spark, name)
    return rows.select(F.col("doc_id").cast("long"), *KEY).join(cuts, KEY).drop(*KEY)


def cut_documents(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut from text, and n_chars (if there) set to the new length."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(_text().alias("text")).select("text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))
    texts, name = _texts(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    k1, k2, cut = (fresh(docs, c) for c in ("_k1", "_k2", "_cut"))
    try:
        with scratch():
            cuts = cut_texts(texts, covered_intervals(texts), True).where("n_removed > 0")
            cuts = outlasting(cuts.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("kept").alias(cut)), "cuts")
    finally:
        _dropped(spark, name)
    joined = docs.withColumns({k1: F.xxhash64(_text()), k2: F.hash(_text())}).join(cuts, [k1, k2], "left")
    out = {"text": F.coalesce(cut, F.col("text").cast("string"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(cut).isNotNull(), F.length(cut)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in docs.columns])
