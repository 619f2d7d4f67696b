"""Fill-in-the-middle transformation: prefix, middle and suffix of a text, put in another order between markers.

A text is matched left to right into units by a pattern (a code point each, unless told otherwise). Two passes of lazy matches cut
it in constant memory: the first counts the units, the second advances one match iterator to the lower and then to the higher
rank and takes the ends of the matches there. No list of units exists at any time, so a text of any length needs its own
characters and its output only.

The ranks come from the SHA-256 of ``seed:doc_id``, so a rerun of a lost task cuts alike. A text without units, one that holds a
marker, and a share of the others stay plain; a small share is written suffix first (spm), the rest prefix first (psm).
``restore`` rebuilds the text from output and form alone: as the text holds no marker, and no marker overlaps itself or another,
each marker occurs once.

``form_texts`` returns doc_id, n, form, prefix_chars, middle_chars (code points, null if plain), output. Null text: empty, so plain.
Null doc_id: hashed as the empty string. Repeated rows: equal results. Characters that no match covers stay with the part that they
stand in. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches

#: Any code point, line breaks too.
UNIT = "(?s:.)"
#: What opens prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def count_units(unit: re.Pattern, text: str) -> int:
    """The first pass: how many matches there are; only the last one is held."""
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends_at(unit: re.Pattern, text: str, ranks: tuple[int, ...]) -> Iterator[int]:
    """The second pass: where the match of each rank ends (rank 0: at 0), for ascending ranks."""
    matches, passed, end = unit.finditer(text), 0, 0
    for rank in ranks:
        if rank > passed:
            end = next(islice(matches, rank - passed - 1, None)).end()
            passed = rank
        yield end


def form_text(unit: re.Pattern, text: str, h: tuple[int, int, int, int], plain_from: int, spm_below: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    n = count_units(unit, text)
    if not n or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = ends_at(unit, text, tuple(sorted((h[0] % (n + 1), h[1] % (n + 1)))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_below:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _groups(seed: str) -> list[Column]:
    """The first four 8-digit groups of the hash, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def form_texts(docs: DataFrame, seed: str = "1", unit: str = UNIT, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Every document's form and output; of 100 values of the third group those from plain_from on stay plain, of the fourth those
    under spm_below are suffix first."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        pattern = re.compile(unit)
        for b in batches:
            ids, texts, *groups = (c.to_pylist() for c in b.columns)
            formed = [form_text(pattern, text, h, plain_from, spm_below) for text, h in zip(texts, zip(*groups, strict=True), strict=True)]
            columns = zip(*formed, strict=True) if formed else [()] * 5
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, [ids, *columns], strict=True)), schema)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.select("doc_id", "text", *_groups(seed)).mapInArrow(run, FORMED)


def restore(output: Column, form: Column) -> Column:
    """The text that output was formed from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def form_digests(formed: DataFrame) -> DataFrame:
    """The rows of form_texts with digests of the output and of the text that is restored from it."""
    out, back = F.sha2("output", 256), F.sha2(restore(F.col("output"), F.col("form")), 256)
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", out.alias("output_sha256"), back.alias("restored_sha256"))
