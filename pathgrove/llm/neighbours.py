"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking, for the largest inner product.

Vectors are mapped to the unit sphere (scaled by the largest norm, one component added), where the largest inner product is the
smallest Euclidean distance. Each of ``tables`` tables hashes a vector by Gaussian (2-stable) projections, cut into INTERVALS
intervals of width ``width``; the number of projections grows with the logarithm of the rows, so that a bucket holds about FILL rows,
up to INTERVALS ** MOST buckets, whose counts the driver holds. Buckets are dealt into cells of about ``cell`` rows; a
bucket with more rows is split over cells.

A query visits buckets in order of estimated success: given its projections, a neighbour at the expected closeness falls into
each interval with a normal probability, and a bucket's success is the product, over the sum of those of all buckets that
hold rows. Buckets are visited until the success reaches a target in every table. The query goes once to each cell that holds a visited
bucket, is compared exactly (double precision, on the original vectors) with the rows of the visited buckets only, and returns its
best k; the tables' candidates are merged and ranked. The expected closeness, and the target at which ``share`` of the
neighbours are found, are measured on a bounded sample (SAMPLE vectors, 256 of them as queries). Every row is indexed.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor do
rows with a null id. Rows with the same id and vector count once, with other vectors by the better score; ties go to the smaller id. No rows or no queries: empty
result. Fewer than k candidates: all that were found. Queries in a cell are handled in blocks of about QUERIES rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, materialise

INTERVALS, MOST, FILL, SAMPLE, QUERIES = 3, 10, 16, 4096, 65_536


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), norm of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(whole).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("norm > 0").dropDuplicates(["vec_id", "v"])


class Tables:
    """The hash functions of all tables."""

    def __init__(self, dim: int, scale: float, tables: int, functions: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim + 1, functions))
        self.b = rng.uniform(0, width, (tables, functions))
        self.scale, self.width = scale, width
        self.places = INTERVALS ** np.arange(functions)

    def project(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections as [table, row, function]."""
        if query:
            unit = np.pad(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), ((0, 0), (0, 1)))
        else:
            unit = vectors / self.scale
            unit = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1, keepdims=True)))])
        return np.einsum("nd,tdf->tnf", unit, self.a)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket numbers as [table, row]."""
        cut = np.floor((self.project(vectors, False) + self.b[:, None, :]) / self.width).astype(int) + INTERVALS // 2
        return np.clip(cut, 0, INTERVALS - 1) @ self.places

    def visits(self, projections: np.ndarray, table: int, closeness: float, buckets: np.ndarray):
        """Per query, the positions in buckets (those that hold rows) in the order of success, and the success reached.
        projections: [query, function] of one table."""
        edges = (np.arange(1, INTERVALS) - INTERVALS // 2) * self.width
        spread = math.sqrt(max(1e-4, 1 - closeness * closeness))
        # as floor((p + b) / width) cuts at edges - b; the outer intervals are open
        z = (edges[None, None, :] - self.b[table][None, :, None] - closeness * projections[:, :, None]) / spread
        below = np.concatenate([np.zeros((*z.shape[:2], 1)), _normal(z), np.ones((*z.shape[:2], 1))], axis=2)
        mass = np.diff(below, axis=2)
        digits = buckets[:, None] // self.places % INTERVALS
        for row in mass:
            success = np.prod(row[np.arange(len(self.places)), digits], axis=1)
            order = np.argsort(-success, kind="stable")
            reached = np.cumsum(success[order])
            yield order, reached / max(reached[-1], 1e-300)


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function (logistic form, good to 2e-4)."""
    return 1 / (1 + np.exp(np.clip(-1.5976 * z - 0.070566 * z**3, -500, 500)))


def tuned(sample: np.ndarray, hashes: Tables, total: int, k: int, share: float) -> tuple[float, float]:
    """From the sample's own neighbours: the cosine, on the sphere, that the k-th neighbour is expected to have, and the success
    to be reached in every table so that `share` of the neighbours are found in some table."""
    if len(sample) < 2:
        return 0.5, 1.0
    unit = sample / hashes.scale
    asked = np.arange(min(len(sample), 256))
    queries = sample[asked] / np.linalg.norm(sample[asked], axis=1, keepdims=True)
    cosine = queries @ unit.T
    cosine[asked, asked] = -2
    rank = min(max(1, round(k * len(sample) / max(total, 1))), len(sample) - 1)
    near = np.argpartition(-cosine, rank - 1, axis=1)[:, :rank]
    close = float(np.clip(np.median(np.take_along_axis(cosine, near, 1).min(axis=1)), 0.05, 0.999))
    buckets, projections = hashes.buckets(sample), hashes.project(sample[asked], True)
    needed = np.ones(near.shape)
    for t in range(len(hashes.a)):
        held, own = np.unique(buckets[t], return_inverse=True)
        for i, (order, reached) in enumerate(hashes.visits(projections[t], t, close, held)):
            at = np.empty(len(held))
            at[order] = reached
            needed[i] = np.minimum(needed[i], at[own[near[i]]])
    return close, float(np.quantile(needed, share))


def functions_for(rows: int) -> int:
    """Projections per table: as many as leave about FILL rows to a bucket."""
    return int(np.clip(round(math.log(max(rows / FILL, 1), INTERVALS)), 1, MOST))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 2, width: float = 1.2, share: float = 0.92, cell: int = 16_384, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score for the queries vec_id % every == 0 against all rows of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.count_if(F.col("vec_id") % every == 0).alias("queries"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top or not top[0]["queries"]:
        return spark.createDataFrame([], schema)
    dim, total, scale, n_queries = top[0]["dim"], top[0]["n"], top[0]["norm"], top[0]["queries"]
    hashes = Tables(dim, scale, tables, functions_for(total), width, seed)
    rows = rows.where(F.size("v") == dim)
    sample = np.array([r[0] for r in rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    close, target = tuned(sample, hashes, total, k, share)
    if total <= k + 1:  # all candidates are among the nearest k
        target = 2.0

    def index(batches):
        for b in batches:
            v = _matrix(b.column("v"), dim)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(list(hashes.buckets(v).T), pa.list_(pa.int32()))], ["vec_id", "v", "buckets"])

    indexed = materialise(rows.select("vec_id", "v").mapInArrow(index, "vec_id long, v array<double>, buckets array<int>"), "vectors")
    placed = indexed.select("vec_id", "v", F.posexplode("buckets").alias("tab", "bucket"))
    # at most tables * INTERVALS ** functions rows
    counts = placed.groupBy("tab", "bucket").count().toArrow().to_pandas().sort_values(["tab", "bucket"])
    layout = {}
    for t, own in counts.groupby("tab"):
        ends = np.cumsum(own["count"].to_numpy())
        layout[int(t)] = own["bucket"].to_numpy(), (ends - own["count"].to_numpy()) // cell, (ends - 1) // cell  # bucket, first cell, last cell
    shared = spark.sparkContext.broadcast(layout)
    spans = spark.createDataFrame([(t, int(b), int(a), int(z)) for t, own in layout.items() for b, a, z in zip(*own, strict=True)], "tab int, bucket int, first int, last int")
    blocks = -(-n_queries // QUERIES)

    def probe(batches):
        for b in batches:
            v = _matrix(b.column("v"), dim)
            p = hashes.project(v, True)
            out = {"query_id": [], "tab": [], "cell": [], "visited": [], "v": []}
            for t, (buckets, first, last) in shared.value.items():
                for i, (order, reached) in enumerate(hashes.visits(p[t], t, close, buckets)):
                    at = order[: int(np.searchsorted(reached, target)) + 1]
                    at = np.sort(at)
                    spread = last[at] - first[at] + 1  # a bucket with many rows is in several cells
                    own = np.repeat(buckets[at], spread)
                    into = np.repeat(first[at], spread) + np.arange(len(own)) - np.repeat(np.cumsum(spread) - spread, spread)
                    into, own = into[(order := np.argsort(into, kind="stable"))], own[order]
                    numbers, starts = np.unique(into, return_index=True)
                    for c, part in zip(numbers.tolist(), np.split(own, starts[1:]), strict=True):
                        for name, x in zip(out, (b.column("vec_id")[i].as_py(), t, c, part, v[i]), strict=True):
                            out[name].append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))

    queries = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(probe, "query_id long, tab int, cell int, visited array<int>, v array<double>")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    cells = placed.join(F.broadcast(spans), ["tab", "bucket"]).select(
        "tab", "bucket", "vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("last") - F.col("first") + 1)).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def compare(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asked.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        held = held.sort_values("bucket", kind="stable")
        v, ids, bucket = np.stack(held["v"]), held["vec_id"].to_numpy(), held["bucket"].to_numpy()
        own_buckets, first = np.unique(bucket, return_index=True)
        last = np.append(first[1:], len(bucket))
        found = []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            q = np.stack(part["v"])
            visits = np.zeros((len(own_buckets), len(part)), bool)
            for i, visited in enumerate(part["visited"]):
                visits[:, i] = np.isin(own_buckets, visited, assume_unique=True)
            rough = np.full((len(part), len(ids)), -np.inf)
            for j in np.flatnonzero(visits.any(axis=1)):  # only the rows of visited buckets
                i = np.flatnonzero(visits[j])
                rough[i, first[j] : last[j]] = q[i] @ v[first[j] : last[j]].T
            for i, own in enumerate(part["query_id"]):
                scores = rough[i]
                scores[ids == own] = -np.inf
                least = np.partition(scores, -min(k, len(ids)))[-min(k, len(ids))]
                # equal vectors must score equally: candidates near the k-th are summed again, one by one
                near = np.flatnonzero(scores >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else np.isfinite(scores))
                if len(near):
                    score = (v[near] * q[i]).sum(axis=1)
                    keep = best(score, ids[near], k)
                    found.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][keep], "score": score[keep]}))
        if not found:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(found)

    by = ("tab", "cell", "block")
    found = cells.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dim)
