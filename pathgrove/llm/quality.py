"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text features.

A document's grade is 0 (poor), 1 (fair but toxic) or 2 (good). One weight vector w over hashed features is shared by all
grades, with ordered thresholds t0 < t1: P(grade <= k) = sigmoid(t_k - w.x). The model gives the expected grade and the tail
probability P(grade >= 2), by which documents are selected.

Features of the whole text, hashed to 2**bits slots: words in lower case, their first four letters, runs of punctuation,
and coarse shares (capitals, punctuation, repeated words, length). A feature is present or not, however often.

Fitting takes a bounded sample of labelled rows (``max_rows``, the smallest hashes of doc_id), whose hashed features (not texts)
are a table. Features are selected by their association with the grades (a z-score that rises with the sample, so that chance
doesn't select more of them in larger samples); the rows' selected features go to the driver, which trains weights and
thresholds with AdaGrad. Every document is scored on the executors.

Other columns are ignored by the scores and kept by the selection. Null label values: the row isn't used. Several labels of a document: each is a training row. No usable labels: every document
is kept with probability 1. Null or empty text: has the length feature only. Null doc_id, repeated rows: scored row by row.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, held, materialise

GRADES = 3
#: Documents of at least this tail probability are selected.
KEEP = 0.7
_TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]+|\d")


def changed(text: str) -> int:
    """How many characters lower-casing changes."""
    lower = text.lower()
    if text == lower:
        return 0
    if len(lower) != len(text):  # some characters become two
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (text, lower))
    return int((a != b).sum())


class Features:
    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.cache: dict[str, tuple[int, ...]] = {}

    def slot(self, name: str) -> int:
        return zlib.crc32(name.encode()) & self.mask

    def slots(self, token: str) -> tuple[int, ...]:
        if token[0].isalpha():
            return self.slot(token), self.slot("^" + token[:4])
        return (self.slot("!" + token),)

    def of(self, text: str | None) -> np.ndarray:
        """The slots of the features that are present, ascending."""
        text = text or ""
        cache = self.cache
        if len(cache) > 200_000:
            cache.clear()
        counts = Counter(_TOKENS.findall(text.lower()))
        slots: list[int] = []
        punctuation = total = 0
        for token, n in counts.items():
            known = cache.get(token)
            if known is None:
                known = cache[token] = self.slots(token)
            total += n
            punctuation += n * (len(known) == 1)
            slots += known
        capitals = changed(text) / max(1, len(text))
        for name, share in (("capitals", capitals), ("punctuation", punctuation / max(1, total)), ("repeats", 1 - len(counts) / max(1, total))):
            slots.append(self.slot(f"#{name}{int(share * 10)}"))
        slots.append(self.slot(f"#length{total.bit_length()}"))
        return np.unique(np.array(slots, np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0..GRADES - 2, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def associated(training: DataFrame, rows: int, shares: list[float], least: int) -> list[int]:
    """The slots that are in at least `least` training rows and are bound to the lower grades, or kept from them, beyond chance."""
    lower = [F.count_if(F.col("grade") <= k).alias(f"low{k}") for k in range(GRADES - 1)]
    counts = training.select("grade", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("seen"), *lower).where(F.col("seen") >= least)
    bound = 0.75 * rows**0.25
    bent = [F.abs(F.col(f"low{k}") - F.col("seen") * p) >= bound * F.sqrt(F.col("seen") * (p * (1 - p))) for k, p in enumerate(shares) if 0 < p < 1]
    if not bent:
        return []
    return sorted(r[0] for r in counts.where(functools.reduce(lambda x, y: x | y, bent)).select("slot").collect())  # at most 2**bits


def fit(rows: list[np.ndarray], grades: np.ndarray, bits: int, epochs: int = 20, rate: float = 0.2, l2: float = 1e-2) -> OrdinalModel:
    """AdaGrad on the negative log likelihood of the cumulative-link model, one row at a time in a fixed random order."""
    w, squares = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
    t, t_squares = np.arange(1 - GRADES, 0) * 4.0 + 2, np.ones(GRADES - 1)
    rng = np.random.default_rng(7)
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, y = rows[i], grades[i]
            s = float(w[slots].sum())
            upper = sigmoid(t[y] - s) if y < GRADES - 1 else 1.0
            lower = sigmoid(t[y - 1] - s) if y else 0.0
            p = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            gradient = (du - dl) / p + l2 * w[slots]
            squares[slots] += gradient * gradient
            w[slots] -= rate * gradient / np.sqrt(squares[slots])
            gt = np.zeros(GRADES - 1)
            if y < GRADES - 1:
                gt[y] -= du / p
            if y:
                gt[y - 1] += dl / p
            t_squares += gt * gt
            t = t - 0.05 * gt / np.sqrt(t_squares)
            t = np.minimum(t, t[-1] - np.arange(GRADES - 2, -1, -1))  # stay in order, at least 1 apart
    return OrdinalModel(w, t, bits)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels (doc_id, quality 0/1, toxic 0/1)."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").cast("long"), grade.alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")


def fit_on(docs: DataFrame, ratings: DataFrame, bits: int = 18, max_rows: int = 30_000, least: int = 3) -> OrdinalModel | None:
    """Fit on at most max_rows of ratings (doc_id, grade), with the text of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    sample = ratings.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rows)

    def run(batches):
        features = held(("features", bits), lambda: Features(bits))
        for b in batches:
            rows = [features.of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "grade", "slots"])

    # the sample is bounded by max_rows; a doc_id of many rows is one training row
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    training = joined.mapInArrow(run, "doc_id long, grade int, slots array<int>").groupBy("doc_id", "grade").agg(F.first("slots").alias("slots"))
    training = materialise(training, "training")
    total = training.agg(F.count("*").alias("n"), *[F.count_if(F.col("grade") <= k).alias(f"low{k}") for k in range(GRADES - 1)]).first()
    if not total["n"]:
        return None
    chosen = associated(training, total["n"], [total[f"low{k}"] / total["n"] for k in range(GRADES - 1)], least)
    mask = np.zeros(1 << bits, bool)
    mask[chosen] = True

    def select(batches):
        for b in batches:
            slots = (np.asarray(x.values.to_numpy(), np.int32) for x in b.column("slots"))
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([s[mask[s]] for s in slots], pa.list_(pa.int32()))], ["grade", "slots"])

    # only selected features come to the driver
    table = training.select("grade", "slots").mapInArrow(select, "grade int, slots array<int>").toArrow()
    slots = [np.asarray(x.values.to_numpy(), np.int32) for x in table.column("slots")]
    rows = sorted(zip(table.column("grade").to_pylist(), slots, strict=True), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return fit([s for _, s in rows], np.array([g for g, _ in rows]), bits)


def _tails(model: OrdinalModel, texts: list[str | None]) -> np.ndarray:
    features = held(("features", model.bits), lambda: Features(model.bits))
    return model.tails(np.array([model.weights[k].sum() for k in map(features.of, texts)], float))


def score_documents(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """doc_id, expected_grade, p_good: row by row."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(float(GRADES - 1)).alias("expected_grade"), F.lit(1.0).alias("p_good"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights

    def run(batches):
        for b in batches:
            tails = _tails(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["doc_id", "expected_grade", "p_good"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_grade double, p_good double")


def select_documents(docs: DataFrame, model: OrdinalModel | None, least: float = KEEP) -> DataFrame:
    """The rows of docs whose tail probability is at least `least`, with all columns of docs."""
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_tails(shared.value, b.column(at).to_pylist())[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)
