"""Search options and diff filters as conditions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from pathgrove.functions.modes import all_of, any_of
from pathgrove.operators import search as s

#: The bits of a diff filter by its letter, and of the change flags.
FILTER_BITS = {"d": 2, "f": 4, "-": 8, "+": 16, "~": 32, "m": 64, "s": 128, "l": 256, "x": 512}
MODE, SIZE, MTIME, HASH = 2, 4, 8, 16
CHANGES = FILTER_BITS["m"] | FILTER_BITS["s"] | FILTER_BITS["l"] | FILTER_BITS["x"]


def scan_filters(include=(), exclude=()) -> dict[str, list[str]]:
    """The four lists of patterns for search.scan_condition and kept_by_filters: "f:" for files, "d:" for directories, bare for both."""
    out: dict[str, list[str]] = {f"{what}_{kind}": [] for what in ("include", "exclude") for kind in ("files", "dirs")}
    for what, patterns in (("include", include), ("exclude", exclude)):
        for p in filter(None, patterns):
            kinds, rest = ({"f": ("files",), "d": ("dirs",)}[p[0]], p[2:]) if p[:2] in ("f:", "d:") and len(p) > 2 else (("files", "dirs"), p)
            for kind in kinds:
                out[f"{what}_{kind}"].append(rest)
    return out


def search_condition(
    regex=(), iregex=(), name=(), iname=(), path=(), ipath=(), size=(), type=(), hash=(), id=(), before=(), after=(), now: dt.datetime | None = None,
) -> tuple[Column, bool]:
    """All given options joined by AND, in a fixed order, and whether digests are needed. No option matches nothing."""
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    parts = [
        *map(s.regex, regex), *(s.regex(p, True) for p in iregex), *map(s.glob, name), *(s.glob(p, True, True) for p in iname),
        *(s.glob(p, False) for p in path), *(s.glob(p, False, True) for p in ipath), *map(s.size, size), *map(s.type_of, type),
        *map(s.hash_prefix, hash), *map(s.id_prefix, id), *(s.before(t, now) for t in before), *(s.after(t, now) for t in after),
    ]
    return all_of(parts, empty=False), bool(hash)


def parse_filter(text: str) -> int:
    """A filter's letters as bits; - and + exclude each other and any change letter."""
    bits = 0
    for c in text.lower():
        if c not in FILTER_BITS:
            raise ValueError(f"unknown filter letter {c!r} in {text!r}")
        bits |= FILTER_BITS[c]
    one_sided = bits & (FILTER_BITS["-"] | FILTER_BITS["+"])
    if one_sided == FILTER_BITS["-"] | FILTER_BITS["+"] or one_sided and bits & (CHANGES | FILTER_BITS["~"]):
        raise ValueError(f"{text!r} can match nothing")
    return bits


def filter_condition(mask: Column, include=(), exclude=()) -> Column:
    """Rows that match any include filter and no exclude filter; a filter matches when all its bits are set; one without bits never does."""

    def hit(text):
        bits = parse_filter(text)
        return mask.bitwiseAND(F.lit(bits)) == bits if bits else F.lit(False)

    wanted = any_of([hit(t) for t in include]) if include else F.lit(True)
    return wanted & ~any_of([hit(t) for t in exclude])
