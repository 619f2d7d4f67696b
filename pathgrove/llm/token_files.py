"""Token-ID output: Simple-8b word-aligned files, written in ascending document order and read back.

A file is one partition of a Parquet table whose rows are chunks of whole documents (at least CHUNK ids, or the last one).
In a chunk, blocks of BLOCK ids are coded apart: each 64-bit word holds a 4-bit selector and as many ids as fit by the
selector's width. ``offsets`` has the first word of every block, so that blocks decode vectorised and on their own.
Ids of over 60 bits are escapes: the word holds 0, and (position, id) is kept beside the words.

Documents are dealt by ranges of (doc_id, hash of the text) and sorted, so the files in order of ``file`` hold ascending
doc_ids, and a doc_id with very many rows is split over files. The number of ids in front of a document is its file's
base (a running sum over one total per file) plus the position kept in the file.

Null text: only the end id. Null doc_id: sorts first. Repeated rows: one document each. Empty table: no rows. A very long
document makes a chunk of its own. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .chat import batched
from .common import bounded_batches, shared_dir
from .word_ids import crc_bytes, word_ids

#: Fixed values of the coding: ids in a word, bits of each, by selector (selector 0 is not used).
COUNTS = np.array([0, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK, CHUNK = 4096, 65_536
_POWERS = np.uint64(1) << np.arange(60, dtype=np.uint64)
_LEAST = np.searchsorted(WIDTHS[1:], np.arange(61)).astype(np.int8) + 1  # the first selector that is wide enough
_SMALL = _LEAST[np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right")]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, first word of every block, positions and values of escapes."""
    values = values.astype(np.uint64)
    n = len(values)
    at = np.flatnonzero(values >> np.uint64(60))
    escaped = values[at]
    values[at] = 0
    least = _SMALL[values] if n and values.max() < 1 << 16 else _LEAST[np.searchsorted(_POWERS, values, side="right")]
    selector = least.copy()  # a word of one id at least
    narrow = np.zeros(n + 241, np.int32)
    for s in range(15, 0, -1):
        count = COUNTS[s]
        np.cumsum(least > s, out=narrow[1 : n + 1])  # ids too wide so far; what lies behind the end always fits
        narrow[n + 1 :] = narrow[n]
        fits = narrow[count : count + n] == narrow[:n]
        if not fits.any():  # then no longer run of narrower ids fits either
            break
        np.copyto(selector, s, where=fits)
    step = COUNTS[selector].astype(np.uint8).tolist()
    starts, firsts = [], []
    for block in range(0, n, BLOCK):
        firsts.append(len(starts))
        i, end = block, min(block + BLOCK, n)
        while i < end:
            starts.append(i)
            i += step[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(256, np.uint64)])
    ends = np.minimum((starts // BLOCK + 1) * BLOCK, n)
    for s in np.unique(chosen):
        if WIDTHS[s]:
            own = np.flatnonzero(chosen == s)
            lanes = np.arange(COUNTS[s])
            index = starts[own, None] + lanes
            part = np.where(index < ends[own, None], padded[index], np.uint64(0))
            words[own] |= np.bitwise_or.reduce(part << (lanes * WIDTHS[s]).astype(np.uint64), axis=1)
    return words, np.array(firsts, np.int32), at.astype(np.int32), escaped


def decode(words: np.ndarray, n: int, offsets: np.ndarray, at: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.concatenate([[0], np.cumsum(counts)])
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    starts = before[:-1] - before[offsets][block] + block * BLOCK if len(words) else before[:-1]
    ends = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        if WIDTHS[s]:
            own = np.flatnonzero(selector == s)
            lanes = np.arange(COUNTS[s])
            index = starts[own, None] + lanes
            part = (words[own, None] >> (lanes * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
            inside = index < ends[own, None]
            out[index[inside]] = part[inside]
    out[at] = escaped
    return out


CHUNKS = "file int, chunk int, start long, doc_ids array<long>, counts array<int>, n int, offsets array<int>, words binary, escape_at array<int>, escapes array<long>"
_CHUNKS = pa.schema([("file", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n", pa.int32()), ("offsets", pa.list_(pa.int32())), ("words", pa.binary()), ("escape_at", pa.list_(pa.int32())), ("escapes", pa.list_(pa.int64()))])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Tokenise docs (doc_id, text), append end_id to each, write the files to path (a new shared folder); returns path."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"

    def run(batches):
        model, file = word_ids(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], model.dtype).tobytes()

        def chunks():
            ids, held, start, n, number = [], [], 0, 0, 0
            for b in batches:
                for doc_id, packed in zip(b.column(0).to_pylist(), model.encode(b.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    held.append(packed + end)
                    n += len(held[-1])
                    if n >= CHUNK * model.dtype.itemsize:
                        row = chunk(number, start, ids, held)
                        yield row
                        ids, held, start, n, number = [], [], start + row[5], 0, number + 1
            if ids:
                yield chunk(number, start, ids, held)

        def chunk(number, start, ids, held):
            values = np.frombuffer(b"".join(held), model.dtype)
            words, offsets, at, escaped = encode(values)
            counts = [len(x) // model.dtype.itemsize for x in held]
            return file, number, start, ids, counts, len(values), offsets, words.astype("<u8").tobytes(), at, escaped.astype(np.int64)

        yield from batched(chunks(), _CHUNKS, 64)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, CHUNKS).write.parquet(path)
    return path


DOCS = "file int, doc_id long, at long, n_tokens long, ids_crc32 long"
_DOCS = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.schema(CHUNKS).parquet(path)

    def run(batches):
        def documents():
            for b in batches:
                for r in b.to_pylist():
                    words = np.frombuffer(r["words"], "<u8")
                    ids = decode(words, r["n"], np.array(r["offsets"], np.int64), np.array(r["escape_at"], np.int64), np.array(r["escapes"], np.int64).astype(np.uint64))
                    plain, at = crc_bytes(ids), 0
                    for doc_id, n in zip(r["doc_ids"], r["counts"], strict=True):
                        yield r["file"], doc_id, r["start"] + at, n, zlib.crc32(plain[4 * at : 4 * (at + n)])
                        at += n

        return batched(documents(), _DOCS)

    bounded_batches(spark)
    docs = files.select(*_CHUNKS.names).mapInArrow(run, DOCS)
    totals = files.groupBy("file").agg(F.sum("n").cast("long").alias("total"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = totals.select("file", (F.sum("total").over(order) - F.col("total")).alias("base"))  # one row per file
    return docs.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
