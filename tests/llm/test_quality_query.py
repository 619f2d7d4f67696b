"""The query of the quality classifier against a computation of its features, selection and scores from the files, without Spark."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from pathgrove.llm import quality, queries

DATA = "/root/testdata/sf0.001"
BITS = 18


def slots(text):
    lower, tokens = (text or "").lower(), []
    for run in re.finditer(r"(?P<word>[^\W\d_]+)|(?P<marks>[^\w\s]+)|(?P<digit>\d)", lower):
        tokens.append((run.lastgroup, run[0]))
    n, names = max(1, len(tokens)), set()
    for kind, token in tokens:
        names |= {token, "^" + token[:4]} if kind == "word" else {"!" + token}
    capitals = sum(c != c.lower() for c in text or "") / max(1, len(text or ""))
    marks = sum(kind != "word" for kind, _ in tokens) / n
    names |= {f"#capitals{int(capitals * 10)}", f"#punctuation{int(marks * 10)}", f"#repeats{int((1 - len({t for _, t in tokens}) / n) * 10)}", f"#length{len(tokens).bit_length()}"}
    return {zlib.crc32(x.encode()) % (1 << BITS) for x in names}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_against_direct_computation(spark):
    docs = {r["doc_id"]: slots(r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    grades = {(r["doc_id"], 0 if r["quality"] == 0 else 1 if r["toxic"] else 2) for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    training = [(g, docs[i]) for i, g in grades if i in docs]
    seen = [collections.Counter(s for g, own in training if g <= k for s in own) for k in range(3)]
    kept = set()
    for k in (0, 1):
        p = sum(g <= k for g, _ in training) / len(training)
        for s, n in seen[2].items():
            spread = math.sqrt(n * p * (1 - p))
            if 0 < p < 1 and n >= 3 and abs(seen[k][s] - n * p) >= 0.75 * len(training) ** 0.25 * spread:
                kept.add(s)
    assert kept
    chosen = [(g, np.array(sorted(own & kept), np.int32)) for g, own in training]
    chosen.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the order that the fit's permutations start from
    model = quality.fit([own for _, own in chosen], np.array([g for g, _ in chosen]), BITS)
    want = {}
    for i, own in docs.items():
        tails = [1 / (1 + math.exp(t - sum(model.weights[s] for s in own))) for t in model.thresholds]
        want[i] = (sum(tails), tails[-1])
    scores = {r["doc_id"]: (r["expected_grade"], r["p_good"]) for r in queries.quality_scores(spark, DATA).collect()}
    assert scores.keys() == want.keys()
    for i, found in scores.items():
        assert found == pytest.approx(want[i], abs=1e-6), i
    selected = {r["doc_id"]: r["p_good"] for r in queries.op2_quality_classifier(spark, DATA).collect()}
    assert selected.keys() == {i for i, (_, p) in want.items() if p >= quality.KEEP} and 0 < len(selected) < len(docs)
    assert all(p == pytest.approx(want[i][1], abs=1e-6) for i, p in selected.items())
