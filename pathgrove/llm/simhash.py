"""SimHash near-duplicates: 64-bit fingerprints, and the groups of documents that links of a few differing bits connect.

A document's shingles (runs of ``size`` words, repeats included; fewer words: the whole sequence) are hashed with XXH64; a fingerprint
bit is set where over half of the hashes have it. Equal fingerprints are one node (the smallest doc_id), so copies cost nothing
further. Different ones that differ in at most ``radius`` bits are found exactly:

* Buckets. 64 bits fall into radius + 1 fields, and two linked fingerprints agree in one of these at least: each node goes to a bucket
  per field value. A bucket of over ``CROWD`` nodes is divided by its other bits in the same way, up to ``LEVELS`` times; buckets that
  are crowded still are cut into strips, and each two strips meet in a bucket of their own. So no bucket exceeds some CROWD nodes, none
  is capped, and no link is lost.
* Comparison, bit-sliced. A task stores the fingerprints of its buckets as 64 vertical planes, a word of 64 nodes each. The differences
  of a query to 64 nodes are one xor per plane; a carry-save counter adds eight planes at a time to three vertical count bits. A block
  (one query by one word) is abandoned as soon as all its nodes exceed the radius, mostly after half of the planes.
* Links leave a task as a forest, at most one per node of a bucket, however many pairs are near; components are written rounds of
  smallest labels.

``signatures`` returns doc_id, fp (long); ``link_documents`` returns doc_id, fingerprint, component_id. Null or empty text, or no word:
fingerprint 0, linked like any other. Null doc_id: names no node; its row gets the component of rows with the same fingerprint, null if there
is none. Repeated rows: equal results. Very long texts are hashed in pieces. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, materialise, release
from .components import components

BITS, SEED = 64, 42
#: Nodes of a bucket from which on it is divided; how often; nodes that a task gathers before it compares; queries at a time.
CROWD, LEVELS, GATHER, QUERIES = 16_384, 3, 4_096, 256
PIECE = 50_000  # hashes counted at a time
_ALL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, size: int) -> int:
    """bytes.lower and bytes.split know ASCII only: A-Z, and space with the controls 09 to 0D."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = [x - 1 for x in starts[min(size, len(words)) :]]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, PIECE):
        hashes = [xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in zip(starts[at : min(at + PIECE, n)], ends[at : at + PIECE], strict=False)]
        ones += planes_of(np.array(hashes, dtype="<u8"))[0].sum(axis=1, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def planes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of values by plane (64 x values, as 0 and 1), and these packed to words of 64 values, padded with zeros."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = -(-len(values) // 64)
    padded = np.zeros((BITS, words * 64), dtype=np.uint8)
    padded[:, : len(values)] = bits
    return bits, np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _sum3(a, b, c):
    """A carry-save adder: sum and carry of three words, bit by bit."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _above(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the vertical counts (lowest bit first) exceed radius."""
    over, equal = np.zeros_like(counts[0]), np.full_like(counts[0], _ALL)
    for k in range(len(counts) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counts[k]
        else:
            over |= equal & counts[k]
            equal &= ~counts[k]
    return over


def near(masks: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, word, bits: the nodes of planes (64 x words) within radius of each query (masks: 64 x queries, a plane's bit as 0 or all
    ones); blocks without any are left out. radius is at most 7."""
    queries, words = masks.shape[1], planes.shape[1]
    q, w = np.divmod(np.arange(queries * words), words)
    ones = twos = fours = gone = np.zeros(len(q), dtype=np.uint64)
    for p in range(0, BITS, 8):
        if len(q) == queries * words:
            d = [(planes[k] ^ masks[k][:, None]).ravel() for k in range(p, p + 8)]
        else:
            d = [planes[k][w] ^ masks[k][q] for k in range(p, p + 8)]
        ones, a = _sum3(ones, d[0], d[1])
        ones, b = _sum3(ones, d[2], d[3])
        ones, c = _sum3(ones, d[4], d[5])
        ones, e = _sum3(ones, d[6], d[7])
        twos, f = _sum3(twos, a, b)
        twos, g = _sum3(twos, c, e)
        fours, eights = _sum3(fours, f, g)
        gone = gone | eights | _above([ones, twos, fours], radius)
        if p >= 16 or p + 8 == BITS:  # few blocks end sooner
            left = np.flatnonzero(gone != _ALL)
            if len(left) < len(q):
                q, w, ones, twos, fours, gone = (x[left] for x in (q, w, ones, twos, fours, gone))
            if not len(q):
                break
    return q, w, ~gone


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its tree) after links between places a and b."""
    while True:
        x, y = labels[a], labels[b]
        differ = np.flatnonzero(x != y)
        if not len(differ):
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while len(np.flatnonzero(labels[labels] != labels)):
            labels = labels[labels]


def forest(values: np.ndarray, last: np.ndarray, radius: int) -> np.ndarray:
    """The label of each value: the first place that links within radius lead to. last: the end of each value's bucket; buckets lie one
    after another, and pairs across them that happen to be compared count as well."""
    labels = np.arange(len(values))
    bits, planes = planes_of(values)
    for a in range(0, len(values), QUERIES):
        z = min(a + QUERIES, len(values))
        first, until = a // 64, -(-int(last[z - 1]) // 64)
        masks = (bits[:, a:z].astype(np.uint64) * _ALL).astype(np.uint64)
        q, w, found = near(masks, planes[:, first:until], radius)
        if len(q):
            block, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(found).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = q[block] + a, (w[block] + first) * 64 + bit
            keep = (j > i) & (j < len(values))
            labels = _merge(labels, i[keep], j[keep])
    return labels


def signatures(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint of every row's whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(t, size) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _fields(used: int, fields: int) -> list[int]:
    """The bits that aren't used, in so many masks of nearly equal length."""
    free = [b for b in range(BITS) if not used >> b & 1]
    return [sum(1 << b for b in free[k * len(free) // fields : (k + 1) * len(free) // fields]) for k in range(fields)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _divided(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """fp, node, used, bucket: each row of a bucket in a bucket for each field of the bits that its bucket doesn't use."""
    known = [0]
    for _ in range(level):
        known = [u | f for u in known for f in _fields(u, radius + 1)]
    choice = F.create_map(*[x for u in known for x in (F.lit(_signed(u)), F.array(*[F.lit(_signed(f)) for f in _fields(u, radius + 1)]))])
    rows = rows.withColumn("field", F.explode(choice[F.col("used")]))
    bucket = F.xxhash64("bucket", "field", F.col("fp").bitwiseAND(F.col("field")))  # buckets that collide are compared together
    return rows.select("fp", "node", F.col("used").bitwiseOR(F.col("field")).alias("used"), bucket.alias("bucket"))


def buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, node, bucket: the buckets in which all links are found, none of much over CROWD nodes."""
    rows, parts = nodes.withColumns({"used": F.lit(0).cast("long"), "bucket": F.lit(0).cast("long")}), []
    for level in range(LEVELS):
        rows = _divided(rows, level, radius)
        sizes = materialise(rows.groupBy("bucket").count().where(F.col("count") > CROWD), "sizes")
        if sizes.isEmpty():
            return _all([*parts, rows])
        parts.append(rows.join(sizes, "bucket", "left_anti"))
        rows = materialise(rows.join(sizes, "bucket"), "crowded")
    # strips of half a bucket, by a hash; a row is in a bucket with each other strip
    strips = F.ceil(2 * F.col("count") / CROWD)
    strip = F.pmod(F.xxhash64("fp", F.lit(1)), strips)
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), strips - 1), lambda x: x != F.col("strip")))
    rows = rows.withColumn("strip", strip).withColumn("other", other)
    return _all([*parts, rows.withColumn("bucket", F.xxhash64("bucket", F.least("strip", "other"), F.greatest("strip", "other")))])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("fp", "node", "bucket")
    for df in parts[1:]:
        out = out.unionByName(df.select("fp", "node", "bucket"))
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(dealt: DataFrame, radius: int) -> DataFrame:
    """a, b: links between nodes of the same bucket, as a forest of what each task compares at once."""

    def compared(held):
        values, nodes, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        labels = forest(values.view(np.uint64), ends[np.searchsorted(ends, np.arange(len(bucket)), side="right")], radius)
        linked = np.flatnonzero((labels != np.arange(len(labels))) & (nodes != nodes[labels]))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[labels[linked]])], schema=_LINKS)

    def run(batches):
        held, count = [], 0
        for b in batches:
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            while len(rows[0]):
                # up to GATHER nodes, and then to the end of a bucket
                cut = len(rows[0])
                if count + cut >= GATHER:
                    change = np.flatnonzero(rows[2][1:] != rows[2][:-1]) + 1
                    if held and held[-1][2][-1] != rows[2][0]:
                        change = np.insert(change, 0, 0)
                    change = change[count + change >= GATHER]
                    if len(change):
                        cut = int(change[0])
                        held.append([x[:cut] for x in rows])
                        yield compared(held)
                        held, count, rows = [], 0, [x[cut:] for x in rows]
                        continue
                held.append(rows)
                count += cut
                break
        if held:
            yield compared(held)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").select("fp", "node", "bucket").mapInArrow(run, "a long, b long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def link_documents(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id that links lead to)."""
    if not 0 <= radius <= 7:
        raise ValueError("three count bits hold a radius of 0 to 7")
    signed = materialise(signatures(docs, size), "fingerprints")
    nodes = materialise(signed.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = materialise(links(buckets(nodes, radius), radius), "links")
    linked = components(found)
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    release(found)
    return signed.join(named, "fp", "left").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
