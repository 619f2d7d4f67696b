"""Sizes, times and text forms: small driver-side parsers that give literals, and column formatters."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

#: Decimal size units.
UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15}


def parse_size(text: str) -> tuple[str, int]:
    """(comparison, bytes) of [+-]n[kmgtp]: + is over, - is under, none is equal; empty is equal to 0."""
    m = re.fullmatch(r"([+-]?)(\d*)([kmgtp]?)", text.strip().lower())
    if not m or (not m[2] and text.strip()):
        raise ValueError(f"not a size: {text!r}")
    value = int(m[2] or 0) * UNITS[m[3]]
    if value >= 1 << 63:
        raise ValueError(f"too large a size: {text!r}")
    return {"+": ">", "-": "<", "": "="}[m[1]], value


def add_months(when: dt.datetime, months: int) -> dt.datetime:
    """Calendar arithmetic that carries days over: a month before 31 March is 3 March (or 2)."""
    total = when.year * 12 + when.month - 1 + months
    first = when.replace(year=total // 12, month=total % 12 + 1, day=1)
    return first + dt.timedelta(days=when.day - 1)


def parse_when(text: str, now: dt.datetime, relative: bool = True) -> dt.datetime:
    """A point in time, UTC, rounded to the second: a date, a date and time, a time of today, or n with s m h D M Y before now."""
    text = text.strip()
    if len(text) < 2:
        raise ValueError(f"not a time: {text!r}")
    if m := re.fullmatch(r"(\d+)([smhDMY])", text):
        if not relative:
            raise ValueError(f"a relative time isn't allowed here: {text!r}")
        n, unit = int(m[1]), m[2]
        if unit in "MY":
            when = add_months(now, -n * (12 if unit == "Y" else 1))
        else:
            when = now - dt.timedelta(seconds=n * {"s": 1, "m": 60, "h": 3600, "D": 86400}[unit])
        return (when + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
    for form in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"):
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            continue
    try:
        time = dt.datetime.strptime(text, "%H:%M:%S").time()
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None
    return dt.datetime.combine(now.date(), time)


def timestamp_literal(when: dt.datetime) -> Column:
    return F.to_timestamp(F.lit(when.strftime("%Y-%m-%d %H:%M:%S.%f")))


def human_bytes(size: Column) -> Column:
    """484 B, 2.4 kB, 11 MB: one decimal under 10, steps of 1000."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for unit, power in (("kB", 1), ("MB", 2), ("GB", 3), ("TB", 4), ("PB", 5), ("EB", 6)):
        tenths = F.round(size / F.lit(10.0 ** (3 * power)) * 10)
        value = F.when(tenths < 100, F.format_string("%.1f", tenths / 10)).otherwise(F.format_string("%.0f", F.round(size / F.lit(10.0 ** (3 * power)))))
        text = F.when(size >= 10 ** (3 * power), F.concat(value, F.lit(f" {unit}"))).otherwise(text)
    return text


def rfc3339(ts: Column, ns: Column | None = None) -> Column:
    """RFC 3339 in UTC with as many decimals as are needed; ns: nanoseconds below the microsecond."""
    digits = F.concat(F.date_format(ts, "SSSSSS"), F.lpad((ns if ns is not None else F.lit(0)).cast("string"), 3, "0"))
    fraction = F.rtrim(F.concat(F.lit("."), F.regexp_replace(digits, "0+$", "")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".", "").otherwise(fraction), F.lit("Z"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def full_path(root: Column, path: Column) -> Column:
    return F.when(path == ".", root).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))


#: A byte b from 80 to FF that isn't part of UTF-8 stands as the private character EF00 + b in a path.
KEPT = 0xEF00


def path_of(raw: bytes) -> str:
    """A file name of any bytes as text, so that ``raw_of`` gives the bytes back. Names that are UTF-8 stay as they are, but for the
    private characters themselves, whose bytes are kept one by one."""
    text = raw.decode("utf-8", "surrogateescape")
    if text.isascii():
        return text
    return "".join(
        chr(ord(c) - 0xDC00 + KEPT) if "\udc80" <= c <= "\udcff" else "".join(chr(KEPT + b) for b in c.encode()) if KEPT + 0x80 <= ord(c) <= KEPT + 0xFF else c
        for c in text
    )


def raw_of(path: str) -> bytes:
    if path.isascii():
        return path.encode()
    return "".join(chr(ord(c) - KEPT + 0xDC00) if KEPT + 0x80 <= ord(c) <= KEPT + 0xFF else c for c in path).encode("utf-8", "surrogateescape")


def raw_path(path: Column) -> Column:
    """raw_of as a column: in UTF-8 the private characters are EE BE xx (80 to BF) and EE BF xx (C0 to FF)."""
    tokens = F.regexp_extract_all(F.hex(path.cast("binary")), F.lit("(EEB[EF]..|..)"), F.lit(1))
    byte = lambda t: F.when(t.startswith("EEBE"), F.substring(t, 5, 2)).when(t.startswith("EEBF"), F.concat(F.translate(F.substring(t, 5, 1), "89AB", "CDEF"), F.substring(t, 6, 1))).otherwise(t)
    return F.when(path.rlike(f"[{chr(KEPT + 0x80)}-{chr(KEPT + 0xFF)}]"), F.unhex(F.array_join(F.transform(tokens, byte), ""))).otherwise(path.cast("binary"))


def path_id(path: Column) -> Column:
    """The SHA-1 of a path's bytes."""
    return F.sha1(raw_path(path))


def quoted(text: Column) -> Column:
    """text in double quotes with backslash escapes, as Go's %q has it: printable characters stay, other ones are \\a \\b \\f \\n \\r \\t \\v,
    \\x7f and the like below 80, \\u0085 or \\U0010ffff above; a byte that isn't UTF-8 is \\xff."""
    named = {"\a": "a", "\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t", "\v": "v", '"': '"', "\\": "\\"}

    def one(c: Column) -> Column:
        code = F.ascii(c)  # of any code point
        kept = code.between(KEPT + 0x80, KEPT + 0xFF)
        out = F.when(kept, F.format_string("\\x%02x", code - KEPT))
        for char, letter in named.items():
            out = out.when(c == char, "\\" + letter)
        out = out.when((code < 0x20) | (code == 0x7F), F.format_string("\\x%02x", code))
        odd = c.rlike(r"[\p{C}\p{Z}]") & (c != " ")
        return out.when(odd & (code < 0x10000), F.format_string("\\u%04x", code)).when(odd, F.format_string("\\U%08x", code)).otherwise(c)

    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), one), ""), F.lit('"'))
