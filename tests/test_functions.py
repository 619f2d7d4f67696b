import datetime as dt

import pytest
from pyspark.sql import functions as F

from pathgrove.functions import modes, patterns, values

NOW = dt.datetime(2024, 3, 31, 12, 0, 0, 400_000)


@pytest.mark.parametrize("text,expected", [("", ("=", 0)), ("5", ("=", 5)), ("+2k", (">", 2000)), ("-3M", ("<", 3_000_000)), ("1g", ("=", 10**9)), ("4T", ("=", 4 * 10**12)), ("+1p", (">", 10**15))])
def test_sizes(text, expected):
    assert values.parse_size(text) == expected


@pytest.mark.parametrize("text", ["k", "+-5", "++5", "5kb", "x", "1.5k", "99999p"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        values.parse_size(text)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-02", dt.datetime(2024, 1, 2)), ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("03:04:05", dt.datetime(2024, 3, 31, 3, 4, 5)), ("10D", dt.datetime(2024, 3, 21, 12)), ("1M", dt.datetime(2024, 3, 2, 12)), ("1Y", dt.datetime(2023, 3, 31, 12)),
        ("5m", dt.datetime(2024, 3, 31, 11, 55)), ("30s", dt.datetime(2024, 3, 31, 11, 59, 30)), ("2h", dt.datetime(2024, 3, 31, 10)),
    ],
)
def test_times(text, expected):
    assert values.parse_when(text, NOW) == expected


@pytest.mark.parametrize("text", ["", "1", "10X", "2024-13-01", "yesterday"])
def test_bad_times(text):
    with pytest.raises(ValueError):
        values.parse_when(text, NOW)
    with pytest.raises(ValueError):
        values.parse_when("10D", NOW, relative=False)


def test_regular_expressions(spark):
    cases = [
        (r"\.txt$", "a.txt", True), (r"\.txt$", "a.txt\n", False), (r"(?P<ext>txt)", "a.txt", True), (r"[[:digit:]]+", "a1", True), (r"[[:digit:]]+", "ab:", False),
        (r"[[^:alpha:]]", "a", False), (r"a[&&b]", "a&", True), (r"a[[]", "a[", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False), ("a.b", "a\rb", True), ("a.b", "a\nb", False), (r"(?m)^b$", "a\nb\nc", True),
    ]
    for pattern, text, expected in cases:
        assert spark.createDataFrame([(text,)], "x string").select(F.col("x").rlike(patterns.re2_to_java(pattern))).first()[0] is expected, pattern
    assert spark.createDataFrame([("É",)], "x string").select(F.col("x").rlike(patterns.re2_to_java("é", True))).first()[0]


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)", r"(a)\1", "a++", "a**", "a*?*", "a{2}{3}", "a{2}*", "a+?{2}", "a???", "*a", "(+)", "a|?", "(?i)*", "a{3,2}", "a{1001}", "(", "a)", "[a", "[[:nope:]]", "a\\"])
def test_rejected_expressions(pattern):
    with pytest.raises(patterns.PatternError):
        patterns.re2_to_java(pattern)


def test_globs(spark):
    cases = [
        ("*.txt", "a.txt", True), ("*.txt", "a/b.txt", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a-c]x", "dx", True),
        (r"\*", "*", True), (r"\*", "a", False), ("a*/b", "abc/b", True), ("*", "", True), ("a.c", "abc", False), ("[!a]", "!", True), (r"[\]]", "]", True), ("é*", "éa", True),
    ]
    for pattern, text, expected in cases:
        assert spark.createDataFrame([(text,)], "x string").select(F.col("x").rlike(patterns.glob_to_java(pattern))).first()[0] is expected, pattern
    for bad in ("[", "[a", "[]a]", "a\\", "[a-", "[-a]"):
        with pytest.raises(patterns.PatternError):
            patterns.glob_to_java(bad)


def test_formats(spark):
    row = spark.sql("SELECT 2147484141L AS d, 420L AS f, 134218239L AS l, timestamp'2024-01-02 03:04:05.120' AS t, 7 AS ns")
    m = row.select(*[modes.mode_string(F.col(c)) for c in "dfl"]).first()
    assert tuple(m) == ("drwxr-xr-x", "-rw-r--r--", "Lrwxrwxrwx")
    assert row.select(values.rfc3339(F.col("t")), values.rfc3339(F.col("t"), F.col("ns"))).first()[:] == ("2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05.120000007Z")
    sizes = {0: "0 B", 484: "484 B", 2420: "2.4 kB", 11_000_000: "11 MB", 1000: "1.0 kB", 15_000_000_000_000: "15 TB"}
    for n, text in sizes.items():
        assert spark.range(1).select(values.human_bytes(F.lit(n))).first()[0] == text
    assert spark.range(1).select(values.path_id(F.lit("/usr/bin"))).first()[0] == "cf1fd72ca142fdde2149707cf56e2816a7fb71e6"


RE2_CASES = [
    (r"a\vb", "a\rb"), (r"a\vb", "a\x0bb"), (r"^a\sb$", "a\x0bb"), (r"^a\sb$", "a\fb"), (r"^a\Sb$", "a\x0bb"), (r"^a[\s_]b$", "a\x0bb"), (r"^a[\S]b$", "a\x0bb"), (r"^a[^\s]b$", "a b"),
    (r"\bé", "xé"), (r"\be", "ée"), (r"\be", "xe"), (r"e\b", "e x"), (r"x\Be", "xe"), (r"\Bé", " é"), (r"a{2,3}$", "aaa"), (r"a{,3}", "a{,3}"), (r"a\x41", "aA"), (r"a\x{42}", "aB"), (r"\101", "A"),
    (r"\pL", "é"), (r"^\PL$", "é"), (r"\p{Greek}", "Ω"), (r"\p{^Greek}", "Ω"), (r"\a", "\x07"), (r"[\x41-\x43]", "B"), (r"\.txt$", "a.txt\n"), (r"\e", "x"), (r"\cA", "x"), (r"a{1001}", "a"), (r"[\b]", "x"), (r"\1", "x"), (r"\z", ""), (r"\Z", ""),
    (r"\_", "_"), (r"\-", "-"), (r"[[:^alpha:]\d]", "1"), (r"(?i)É", "é"), (r"a\Q.b\E", "a.b"),
]


def test_re2_patterns_match_as_in_re2(spark):
    con = pytest.importorskip("duckdb").connect()
    rows = []
    for i, (pattern, text) in enumerate(RE2_CASES):
        try:
            expected = con.execute("SELECT regexp_matches(?, ?)", [text, pattern]).fetchone()[0]
        except Exception:
            with pytest.raises(patterns.PatternError):
                patterns.re2_to_java(pattern)
            continue
        rows.append((i, text, patterns.re2_to_java(pattern), expected))
    one = spark.range(1).select(*[F.lit(text).rlike(java).alias(str(i)) for i, text, java, _ in rows]).first()
    assert [(RE2_CASES[i], one[str(i)]) for i, *_ in rows] == [(RE2_CASES[i], e) for i, _, _, e in rows]
