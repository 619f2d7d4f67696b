"""Best-fit packing of documents into sequences by a configuration linear program over the length histogram.

1. Every document becomes token ids plus an end id; only what is longer than the capacity is cut into pieces of the capacity.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver.
3. A configuration is a multiset of lengths that fits a sequence. The covering program (fewest sequences that cover the
   histogram) is solved by multiplicative weights until every length is covered: each round prices the lengths by their
   weights and finds the best configurations by a knapsack dynamic program; rounding takes whole sequences of them, and what
   is left goes best-fit into their gaps and into new sequences, still by length and count only. Two ways of rounding are
   tried and the fewest sequences win.
4. The plan is a bounded table of runs (length, first rank, sequences, copies, offset). Pieces are ranked per length,
   with the length split over buckets so that a common length doesn't land in one task, and look up their place.

Null text: only the end id. Null doc_id: kept as null, packed like any other. Repeated rows and ties: a piece each; equal pieces are interchangeable. Empty table: no rows.
The document table may hold other columns; they are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .chat import batched
from .common import bounded_batches, materialise
from .word_ids import crc_bytes, word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bucket", pa.int32())])


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, buckets: int) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches):
        model = word_ids(tokenizer)
        end = np.array([end_id], model.dtype).tobytes()

        def pieces():
            number = 0
            for b in batches:
                for doc_id, packed in zip(b.column(0).to_pylist(), model.encode(b.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(packed + end, model.dtype)
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        yield doc_id, k, at, len(part), zlib.crc32(crc_bytes(part)), number % buckets
                        number += 1

        return batched(pieces(), _PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fills(lengths: np.ndarray, prices: np.ndarray, capacity: int, bonus=0.0, draws: np.ndarray | None = None, shifts: np.ndarray | None = None) -> np.ndarray:
    """Knapsack by dynamic programming: for every room, the last piece (index into the ascending lengths, -1: none) of the multiset
    of the highest price. ``bonus`` and the draws, shifted for every room, only decide which of nearly equal multisets is taken."""
    liked = prices + bonus
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fitting[c]:
            rest = best[c - lengths[:k]]
            i = int((rest + liked[:k] if draws is None else rest + liked[:k] + draws[shifts[c] : shifts[c] + k]).argmax())
            if rest[i] + prices[i] > best[c]:
                best[c], last[c] = rest[i] + prices[i], i
    return last


def filled(last: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of a room, as index and copies."""
    out: dict[int, int] = {}
    while room > 0:
        i = int(last[room])
        if i < 0:
            room -= 1
            continue
        out[i] = out.get(i, 0) + 1
        room -= int(lengths[i])
    return out


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths (ascending) of the highest price that fits."""
    return {int(lengths[i]): a for i, a in filled(best_fills(lengths, prices, capacity), lengths, capacity).items()}


def fractional_plan(histogram: dict[int, int], capacity: int, rounds: int | None, eta: float, near: float = 1e-4) -> list[tuple[dict[int, int], float]]:
    """Configurations with their fractional number of sequences, by multiplicative weights on the covering program.

    A round solves one knapsack and takes, for every length that isn't covered yet, the best configuration that holds it; none
    of them takes more than its lengths still need. So each round covers a length at least, and ``rounds`` (None: until all are
    covered) only bounds it further. Equal prices would give all configurations the same filling, so multisets within about
    ``near`` of the best are drawn in proportion to what their lengths still need."""
    rng = np.random.default_rng(7)
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths], float)
    covered = np.zeros(len(lengths))
    plan: dict[tuple, float] = {}
    for _ in range(len(lengths) if rounds is None else rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        own, needed = lengths[open_], counts[open_] * (1 - covered[open_])
        # the dual price of a piece: its share of the capacity, less by the factor of its weight
        prices = own / capacity * np.exp(-eta * covered[open_])
        draws = near * rng.gumbel(size=2 * len(own))
        last = best_fills(own, prices, capacity, near * np.log(needed), draws, rng.integers(0, len(own), capacity + 1))
        for i in range(len(own) - 1, -1, -1):
            if needed[i] <= 1e-9 * counts[open_[i]]:
                continue
            config = filled(last, own, capacity - int(own[i]))
            config[i] = config.get(i, 0) + 1
            step = min(needed[j] / a for j, a in config.items())
            if step <= 1e-9:
                continue
            key = tuple(sorted(((int(own[j]), a) for j, a in config.items()), reverse=True))
            plan[key] = plan.get(key, 0.0) + step
            for j, a in config.items():
                needed[j] -= a * step
        covered[open_] = 1 - needed / counts[open_]
    return [(dict(k), x) for k, x in plan.items()]


#: A group of equal sequences: content in order as (length, copies), how many sequences, room left.
Group = tuple[list[tuple[int, int]], int, int]


def rounded(fractional, histogram: dict[int, int], capacity: int, carry: bool) -> tuple[list, dict[int, int]]:
    """The configurations' whole sequences, sorted by room, and the pieces that are left.

    Rounded down, or with ``carry`` the fractions of neighbouring configurations (in the order of their lengths) add up to whole
    sequences; what a configuration lacks by then stays a gap for best fit."""
    left = dict(histogram)
    room: list[tuple[int, int, list[tuple[int, int]], int]] = []  # sorted by room; a number breaks ties
    serial = 0
    due = 0.0
    for config, x in sorted(fractional, key=lambda p: sorted(p[0].items(), reverse=True), reverse=True):
        due = due + x if carry else x
        m = int(due + 1e-6)
        due -= m
        while m > 0:
            content = [(n, min(a, left[n])) for n, a in sorted(config.items(), reverse=True) if left[n]]
            if not content:
                break
            k = min([m, *(left[n] // a for n, a in content)])
            for n, a in content:
                left[n] -= a * k
            m -= k
            serial += 1
            bisect.insort(room, (capacity - sum(n * a for n, a in content), serial, content, k))
    return room, left


def round_plan(fractional, histogram: dict[int, int], capacity: int, carry: bool) -> list[Group]:
    """Whole sequences: the rounded configurations, then best fit in descending length by counts for what is left."""
    room, left = rounded(fractional, histogram, capacity, carry)
    serial = len(room)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(room, (n,))
            if at < len(room):
                free, _, content, m = room.pop(at)
            else:
                free, content, m = capacity, [], count
            k = free // n
            full = min(m, count // k)
            rest = count % k if full < m and full == count // k else 0
            count -= full * k + rest
            for copies, number in ((k, full), (rest, 1 if rest else 0), (0, m - full - (1 if rest else 0) if content else 0)):
                if number:
                    serial += 1
                    bisect.insort(room, (free - copies * n, serial, content + [(n, copies)] if copies else content, number))
    return [(content, m, free) for free, _, content, m in room]


def solve(histogram: dict[int, int], capacity: int, rounds: int | None = None, eta: float = 0.3) -> list[Group]:
    fractional = fractional_plan(histogram, capacity, rounds, eta) if histogram else []
    plans = [round_plan(fractional, histogram, capacity, carry) for carry in (True, False)]
    return min(plans, key=lambda p: sum(m for _, m, _ in p))


def runs_of(plan: list[Group]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first sequence, copies in a sequence, offset of the first copy), ranks ascending."""
    ranks: dict[int, int] = {}
    runs: dict[int, list] = {}
    sequence = 0
    for content, m, _ in plan:
        at = 0
        for n, a in content:
            runs.setdefault(n, []).append((ranks.get(n, 0), sequence, a, at))
            ranks[n] = ranks.get(n, 0) + a * m
            at += a * n
        sequence += m
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, capacity, buckets), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(runs_of(solve(histogram, capacity)))  # bounded by lengths and rounds, not by documents

    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("length", "bucket", (F.sum("n").over(order) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    placed = pa.schema([*list(_PIECES)[:5], pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])

    def place(batches):
        table = runs.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                n = int(length[own[0]])
                run = table[n]
                row = run[np.searchsorted(run[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).cast(f.type) for f in list(placed)[:5]), pa.array(sequence), pa.array(offset)], schema=placed)

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).cast("long").alias("rank"))
    return out.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
