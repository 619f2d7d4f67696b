"""Media columns: ISO base media files (boxes), written, walked and described without decoding payloads.

``write_container`` stores a payload losslessly as 8-bit audio samples ("raw ", one channel) in an ISO media file: ftyp,
moov with one track and its sample tables, mdat with the payload. ``describe`` walks the nested boxes of any such file,
decodes the sample tables (stsd, stts, stsc, stsz, stco/co64, stss) and returns codec, duration and the byte ranges
of the sync samples (keyframes) from the tables alone; the payload bytes are only sliced, never decoded.

One sample of the track is a block of 64 bytes (64 8-bit audio samples), and every 16th block is a sync sample.
Fragments (moof) hold their own sample runs (trun), which are added to their track's samples. Samples of one size that follow each other
and are all sync samples are one range. Work and memory are bounded by the bytes of the tables in the file, whatever they declare; a file
that nests boxes too deep, or whose samples lie outside of any file, isn't readable. A text is taken as UTF-8 (null: empty)
and padded with bytes 0 to a positive multiple of 64. Very long texts are one row
each. Null doc_id: kept. Repeated rows get equal values; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chat import batched
from .common import bounded_batches

BLOCK, SYNC_EVERY, RATE = 64, 16, 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 1 << 32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def full(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), body)


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def write_container(payload: bytes) -> bytes:
    """payload: a positive multiple of BLOCK bytes."""
    n = len(payload) // BLOCK
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = len(payload)
    sync = range(1, n + 1, SYNC_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(at: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1) + entry),
            full(b"stts", struct.pack(">III", 1, n, BLOCK)),
            full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            full(b"stsz", struct.pack(">II", BLOCK, n)),
            full(b"co64", struct.pack(">IQ", 1, at)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1) + full(b"url ", b"", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", struct.pack(">I4s", 0, b"soun") + bytes(12) + b"text bytes\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration) + bytes(8) + struct.pack(">HHHH", 0, 0, 0x100, 0) + matrix + bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, duration, 0x10000, 0x100) + bytes(10) + matrix + bytes(24) + struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + box(b"mdat", payload)


#: Boxes within boxes at most; no real file has nearly as many.
NESTED = 32


def walk(data: bytes | memoryview) -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of the body of every box, in file order, going into the containers."""
    levels = [("", 0, len(data))]  # what is left of each box around the present place
    while levels:
        path, start, end = levels.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, start + head, start + size
        levels.append((path, start + size, end))
        if kind in CONTAINERS:
            if len(levels) > NESTED:
                raise ValueError("boxes are nested too deep")
            levels.append((name, start + head, start + size))


def describe(data: bytes) -> list[dict]:
    """Per track: codec, timescale, duration, samples, chunk byte ranges and keyframe byte ranges (start, length)."""
    view, tracks, fragments, defaults = memoryview(data), [], [], {}
    for path, a, b in walk(view):
        kind = path.rpartition("/")[2]
        if path == "/moov/trak":
            tracks.append({})
        elif tracks and path.startswith("/moov/trak/"):
            tracks[-1][kind] = (a, b)
        elif kind == "trex":
            number, _, _, size, flags = struct.unpack_from(">5I", view, a + 4)
            defaults[number] = size, flags
        elif path == "/moof":
            moof = a - 8
        elif path == "/moof/traf":
            fragments.append({"moof": moof, "runs": []})
        elif path == "/moof/traf/tfhd":
            fragments[-1]["tfhd"] = a
        elif path == "/moof/traf/trun":
            fragments[-1]["runs"].append(a)
    out = {}
    for t in tracks:
        at = t["tkhd"][0]
        out[struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))[0]] = _track(view, t)
    for f in fragments:
        _add_fragment(view, f, out, defaults)
    return list(out.values())


def _add_fragment(view: memoryview, fragment: dict, tracks: dict, defaults: dict) -> None:
    """Add the samples of a track fragment. Sample flags with bit 16 mark what is no sync sample."""
    head = fragment["tfhd"]
    options, number = struct.unpack_from(">II", view, head)
    at, base = head + 8, fragment["moof"]
    size, flags = defaults.get(number, (0, 0))
    if options & 1:
        base = struct.unpack_from(">Q", view, at)[0]
        at += 8
    at += 4 * bool(options & 2) + 4 * bool(options & 8)
    if options & 16:
        size = struct.unpack_from(">I", view, at)[0]
        at += 4
    if options & 32:
        flags = struct.unpack_from(">I", view, at)[0]
    track, place = tracks[number], base
    for run in fragment["runs"]:
        own, n = struct.unpack_from(">II", view, run)
        at, first = run + 8, flags
        if own & 1:
            place = base + struct.unpack_from(">i", view, at)[0]
            at += 4
        if own & 4:
            first = struct.unpack_from(">I", view, at)[0]
            at += 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if own & bit]
        begin = place
        if 0x200 in fields or 0x400 in fields:
            table = _numbers(view, at, n * len(fields), "I")
            for i in range(n):
                values = dict(zip(fields, table[i * len(fields) : (i + 1) * len(fields)], strict=True))
                length = values.get(0x200, size)
                if not values.get(0x400, flags if i else first) & 0x10000:
                    track["keyframes"].append(_range(place, length))
                place += length
        else:  # samples of one size and kind, however many are declared
            if n and not first & 0x10000:
                track["keyframes"].append(_range(place, size))
            if n > 1 and not flags & 0x10000:
                track["keyframes"].append(_range(place + size, (n - 1) * size))
            place += n * size
        track["samples"] += n
        track["spans"].append(_range(begin, place - begin))


def _range(start: int, length: int) -> tuple[int, int]:
    if start < 0 or start + length >= 1 << 63:
        raise ValueError("a sample lies outside of any file")
    return start, length


def _numbers(view, at: int, n: int, code: str) -> tuple:
    if struct.calcsize(f">{code}") * n > len(view) - at:
        raise ValueError("a sample table is longer than its file")
    return struct.unpack_from(f">{n}{code}", view, at)


def _count(view, span: tuple[int, int] | None) -> int:
    return struct.unpack_from(">I", view, span[0] + 4)[0] if span else 0


def _track(view: memoryview, t: dict) -> dict:
    a = t["mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", view, a + 20) if view[a] == 1 else struct.unpack_from(">II", view, a + 12)
    codec = bytes(view[t["stsd"][0] + 12 : t["stsd"][0] + 16]).decode("latin-1")
    fixed, n = struct.unpack_from(">II", view, t["stsz"][0] + 4)
    # a size that all samples share stays one number, however many are declared: only tables that are in the file are gone through
    sizes = None if fixed else _numbers(view, t["stsz"][0] + 12, n, "I")
    wide = "co64" in t
    span = t["co64" if wide else "stco"]
    chunks = _numbers(view, span[0] + 8, _count(view, span), "Q" if wide else "I")
    runs = _numbers(view, t["stsc"][0] + 8, 3 * _count(view, t["stsc"]), "I")
    sync = sorted(set(_numbers(view, t["stss"][0] + 8, _count(view, t["stss"]), "I"))) if "stss" in t else None
    firsts, pers = runs[::3], runs[1::3]
    if any(x >= y for x, y in zip(firsts, firsts[1:])):
        raise ValueError("runs of chunks are out of order")
    if sizes:
        places = [0, *accumulate(sizes)]
    keys, spans, sample = [], [], 0
    for i, at in enumerate(chunks, 1):
        k = bisect_right(firsts, i) - 1
        if k < 0:
            raise ValueError("a chunk belongs to no run")
        until = min(sample + pers[k], n)
        size = (lambda a, z: places[z] - places[a]) if sizes else (lambda a, z: (z - a) * fixed)
        spans.append(_range(at, size(sample, until)))
        if sync is None and until > sample:
            keys += [_range(at + size(sample, j), size(j, j + 1)) for j in range(sample, until)] if sizes else [spans[-1]]
        elif sync:
            keys += [_range(at + size(sample, j - 1), size(j - 1, j)) for j in sync[bisect_right(sync, sample) : bisect_right(sync, until)]]
        sample = until
    return {"codec": codec, "timescale": scale, "duration": duration, "samples": n, "spans": spans, "keyframes": keys}


COLUMNS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, codec string, duration_s double, keyframe_ranges array<struct<offset: long, length: long>>, "
    "tracks array<struct<codec: string, duration_s: double, samples: long, keyframe_ranges: array<struct<offset: long, length: long>>>>, error string"
)
_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframe_ranges", _RANGES)]))
_COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("keyframe_ranges", _RANGES), ("tracks", _TRACKS), ("error", pa.string())])


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary): every text as a container file."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            texts = ((i, (t or "").encode()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield from batched(((i, len(t), write_container(pad(t))) for i, t in texts), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_columns(media: DataFrame) -> DataFrame:
    """The columns of COLUMNS, read back from the stored files of (doc_id, n_bytes, media).

    ``keyframe_ranges`` and the other single columns are of the first track, ``tracks`` has all. A null value has null columns, one
    that can't be read as a media file has its size and digest and says why in ``error``."""

    def ranges(t):
        return [{"offset": a, "length": n} for a, n in t["keyframes"]]

    def row(doc_id, n_bytes, data):
        if data is None:
            return doc_id, n_bytes, *[None] * 10, "null"
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            found = describe(data)
            t = found[0]
        except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
            return doc_id, n_bytes, None, None, None, *stored, None, None, None, None, None, f"not a readable media file: {e!r}"
        payload = b"".join(data[a : a + n] for a, n in t["spans"])
        digest = zlib.crc32(",".join(f"{a}+{n}" for a, n in t["keyframes"]).encode())
        feature = f"{t['codec'].strip()};{t['duration']}/{t['timescale']};samples={t['samples']};keyframes={len(t['keyframes'])};ranges={digest:08x}"
        tracks = [{"codec": x["codec"], "duration_s": seconds(x), "samples": x["samples"], "keyframe_ranges": ranges(x)} for x in found]
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), *stored, feature, t["codec"], seconds(t), ranges(t), tracks, None

    def seconds(t):
        return t["duration"] / t["timescale"] if t["timescale"] else None

    def run(batches):
        for b in batches:
            yield from batched((row(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), _COLUMNS)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, COLUMNS)
