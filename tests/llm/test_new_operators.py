"""Fill-in-the-middle, SimHash and source audit against brute force, and their queries against SQL."""

import collections
import hashlib
import os
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathgrove.llm import chat, fill_middle, media, queries, repeats, simhash, source_audit
from pathgrove.llm.common import materialise
from pathgrove.sources import shared

from .test_operators import CLASH, DOCS, none, odd, odd_rows, rows_of, same  # noqa: F401

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{table}')")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert found and same(rows_of(df), found)


# fill in the middle


def cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark, odd, none):  # noqa: F811
    rng = random.Random(4)
    rows = odd_rows() + [(200 + i, "".join(rng.choice("<PSM>a\n\r é中😀") for _ in range(rng.randint(0, 9)))) for i in range(400)]
    rows += [(700, "<P>"), (701, "x<M"), (702, "<<S"), (703, "very long " * 200_000)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in [*CLASH, "form", "output", "h1"]})
    formed = fill_middle.form_texts(df)
    expected = [cut(*r) for r in rows]
    assert same(rows_of(formed), expected)
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    texts = collections.Counter((i, sha(t or "")) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["restored_sha256"]) for r in fill_middle.form_digests(formed).collect()) == texts
    assert fill_middle.form_texts(none).count() == 0
    assert fill_middle.form_texts(odd).count() == len(odd_rows())


def test_units_of_a_pattern():
    """Cuts fall behind units; what no unit covers stays where it is."""
    unit, text = re.compile(r"\w+"), " one two\nthree"
    assert fill_middle.count_units(unit, text) == 3 and fill_middle.count_units(unit, " ") == 0
    assert list(fill_middle.ends_at(unit, text, (0, 0, 1, 1, 3))) == [0, 0, 4, 4, 14]
    n, form, prefix, middle, output = fill_middle.form_text(unit, text, (1, 2, 0, 50), 90, 20)
    assert (n, form, prefix, middle, output) == (3, "psm", 4, 4, "<P> one<S>\nthree<M> two")


# simhash


def brute_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(values, radius):
    labels = list(range(len(values)))

    def top(i):
        while labels[i] != i:
            i = labels[i]
        return i

    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                labels[b] = a
    return [top(i) for i in range(len(values))]


def clustered(n, seed, centres=5, flips=5):
    rng = random.Random(seed)
    tops = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        v = rng.choice(tops)
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out, key=lambda v: (v * 0x9E3779B97F4A7C15) % 2**64)


def test_fingerprints(spark, odd, none, monkeypatch):  # noqa: F811
    monkeypatch.setattr(simhash, "PIECE", 1000)
    for _, text in odd_rows():
        assert simhash.fingerprint((text or "").encode(), 4) == brute_print(text)
    assert simhash.link_documents(none).count() == 0


@pytest.mark.parametrize("radius", range(8))
def test_bit_sliced_comparison(radius):
    """Distances by carry-save counters equal counted ones for all pairs of clustered and random values."""
    values = np.array(clustered(150, radius, flips=9), dtype=np.uint64)
    bits, planes = simhash.planes_of(values)
    masks = bits[:, :70].astype(np.uint64) * np.uint64(2**64 - 1)
    q, w, found = simhash.near(masks, planes, radius)
    got = {(int(a), int(b) * 64 + k) for a, b, f in zip(q, w, found) for k in range(64) if int(f) >> k & 1 and int(b) * 64 + k < 150}
    assert got == {(i, j) for i in range(70) for j in range(150) if int(values[i] ^ values[j]).bit_count() <= radius}


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_forest(radius):
    values = clustered(700, 3)
    labels = simhash.forest(np.array(values, dtype=np.uint64), np.full(700, 700), radius)
    assert labels.tolist() == brute_labels(values, radius)


def test_simhash_links(spark, odd):  # noqa: F811
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.link_documents(odd).collect()}
    rows = [(i, brute_print(t)) for i, t in odd_rows()]
    named = sorted({p for i, p in rows if i is not None})
    top = brute_labels(named, 4)
    least = collections.defaultdict(lambda: 10**9)
    for i, p in rows:
        if i is not None:
            least[top[named.index(p)]] = min(least[top[named.index(p)]], i)
    assert got == {(i, f"{p:016x}"): least[top[named.index(p)]] if p in named else None for i, p in rows}


@pytest.mark.parametrize("crowd", [8, 60, 16_384])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, crowd):
    """With buckets of few nodes every level divides and strips meet; the components stay those of all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "GATHER", 40)
    values = clustered(500, 9)
    nodes = spark.createDataFrame([(v - 2**64 if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, node long")
    dealt = simhash.buckets(nodes, 4)
    found = simhash.components(simhash.links(dealt, 4))
    labels = {r["node"]: r["component"] for r in found.collect()}
    assert [labels.get(i, i) for i in range(500)] == brute_labels(values, 4)


# source audit


def brute_audit(rows, least, top):
    groups, docs, counts = set(), collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (l, t), n in docs.items() if l == lang and n >= least]
        sources = sorted(s for l, s in groups if l == lang)
        table = {s: [counts[lang, s, t] for t in kept] for s in sources}
        whole = [sum(c) for c in zip(*table.values())]
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        q = share(whole)
        for s in sources:
            p = share(table[s])
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p, share(table[o]))), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted((b - a, t.encode()) for a, b, t, c in zip(p, q, kept, table[s]) if c and a > b)[:top]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)]
    return out


@pytest.mark.parametrize("sizes", [(16_384, 64, 64, 200_000), (7, 2, 2, 20)])
def test_source_audit(spark, monkeypatch, sizes):
    """Whole and with tiny chunks, blocks, spans and task tables, so that all of them are many."""
    for name, value in zip(("CHUNK", "BLOCK", "SPAN", "HELD"), sizes):
        monkeypatch.setattr(source_audit, name, value)
    rng = random.Random(6)
    words = ["alpha", "Beta", "GAMMA", "délta", "Ωmega", "中文", "İx", "a1b", "it's", "x\x00y", " z", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    rows = []
    for lang in ("en", "de", None, "fr"):
        for i in range(90):
            source = rng.choice(["a", "a", "a", "b", "c", "é", None, "Z"])
            rows.append((lang, source, " ".join(rng.choice(words[: 10 + ord((source or "q")[0]) % 60]) for _ in range(rng.randint(0, 40)))))
    rows += [("en", "empty", None), ("en", "empty", ""), ("en", "blank", " 12 \n"), ("few", "one", "a b"), ("few", "two", "a"), ("alone", "s", "x " * 100)] + rows[:5]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("x") for c in [*CLASH, "term", "terms", "chunk", "docs"]})
    assert same(rows_of(source_audit.audit(df, least=5, top=7)), brute_audit(rows, 5, 7))


def test_source_audit_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert source_audit.audit(none).count() == 0


def test_shares_are_exact():
    for most in (10**3, 10**12, 9 * 10**15, 10**17):
        rng = random.Random(most)
        counts = [rng.randint(0, most) for _ in range(50)]
        total = sum(counts) + 250
        if total < 2**63:
            got = source_audit.shares(np.array([counts], dtype=np.int64), np.array([[total]], dtype=np.int64))
            assert got.tolist() == [[1 + 10**9 * (c + 5) // total for c in counts]]


# stored outputs and hostile files


def test_stored_segments_dealt_over_partitions(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {t} " * 50) for c in (1, 2, None) for t in range(40)]
    segments = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    dealt = materialise(segments.repartition(5), "dealt")
    assert dealt.rdd.getNumPartitions() > 1
    assert same(rows_of(chat.read_back(dealt)), rows_of(chat.read_back(segments)))


def media_row(spark, data):
    return media.media_columns(spark.createDataFrame([(1, 0, bytearray(data))], "doc_id long, n_bytes long, media binary")).first()


def hostile_track(stsz, stco, sync=None):
    full, box, u = media.full, media.box, (lambda *x: struct.pack(f">{len(x)}I", *x))
    tables = [full(b"stsd", u(1) + box(b"avc1", bytes(8))), full(b"stsc", u(1, 1, 2**32 - 1, 1)), full(b"stsz", stsz), stco, *([full(b"stss", u(len(sync), *sync))] if sync else [])]
    trak = box(b"trak", full(b"tkhd", u(0, 0, 1, 0, 30) + bytes(60)), box(b"mdia", full(b"mdhd", u(0, 0, 10, 30, 0)), box(b"minf", box(b"stbl", *tables))))
    return box(b"ftyp", b"isom") + box(b"moov", trak)


def test_hostile_media(spark):
    """Deep nesting, offsets past any file, samples by the billion, runs in front of the file: an error or few ranges, never a lost task."""
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    nested = b""
    for _ in range(1500):
        nested = media.box(b"moov", nested)
    assert "too deep" in media_row(spark, nested)["error"]
    chunk = media.full(b"co64", u(1) + struct.pack(">Q", 2**63))
    assert "outside" in media_row(spark, hostile_track(u(7, 3), chunk))["error"]
    near = media.full(b"stco", u(1, 100))
    row = media_row(spark, hostile_track(u(7, 2**32 - 1), near))
    assert row["error"] is None and row["tracks"][0]["samples"] == 2**32 - 1 and [tuple(r) for r in row["keyframe_ranges"]] == [(100, 7 * (2**32 - 1))]
    row = media_row(spark, hostile_track(u(7, 2**32 - 1), near, sync=[1, 3, 2**32 - 1]))
    assert [tuple(r) for r in row["keyframe_ranges"]] == [(100, 7), (114, 7), (100 + 7 * (2**32 - 2), 7)]
    assert "longer than its file" in media_row(spark, hostile_track(u(0, 2**32 - 1), near))["error"]
    moof = lambda offset, n, flags: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u(1, 9, flags), flags=0x30), media.full(b"trun", struct.pack(">Ii", n, offset), flags=1)))
    base = hostile_track(u(7, 2), near)
    row = media_row(spark, base + moof(50, 2**32 - 1, 0))
    assert row["tracks"][0]["samples"] == 2**32 + 1 and [tuple(r) for r in row["keyframe_ranges"]] == [(100, 14), (len(base) + 50, 9), (len(base) + 59, 9 * (2**32 - 2))]
    assert len(media_row(spark, base + moof(50, 2**32 - 1, 0x10000))["keyframe_ranges"]) == 1
    assert "outside" in media_row(spark, base + moof(-100_000, 3, 0))["error"]
    assert media_row(spark, random.Random(3).randbytes(5000))["error"]


def test_repeats_leave_one_table(spark, odd, tmp_path, monkeypatch):  # noqa: F811
    """Of all tables that are written on the way only the one that the result reads is left, in the shared folder."""
    for module in (shared, repeats):
        monkeypatch.setattr(module, "shared_dir", lambda _: str(tmp_path))
    for operator in (repeats.cut_documents, repeats.repeated_passages):
        assert operator(odd).count() == len(odd_rows())
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["cuts", "cuts"]
