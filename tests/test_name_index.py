"""The index of names gives what a scan gives, from fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from pathgrove.functions.patterns import glob_runs, regex_needs
from pathgrove.operators import name_index, search

PATTERNS = ["report-0[0-4]7.txt", "*rt-12*", "REPORT-*9.TXT", "a*c", "*", "?", "no-such-name", "*Kelvin*", "*kelvin.md", "*Été.txt", "hot.bin", "x/hot.bin", "d1/*/report-1?3.txt", "d[/0-9]*hot.bin", "*\\*star*", "d?/e1", "abc", "*.txt"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    paths = [".", "abc", "ab", "d1", "d1/e1", "d2/e1", "d1/x/a*star.txt", "d1/Kelvin.md", "d2/Kelvin.md", "d2/Été.txt", "d2/été.TXT", "d2/ΣΑΣ.txt", "d1\nb/line\nend.txt"]
    paths += [f"d{rng.randint(0, 3)}/e{k % 3}/report-{k:03}.{'TXT' if k % 5 == 0 else 'txt'}" for k in range(300)]
    paths += [f"d{k % 4}/x{k}/hot.bin" for k in range(150)]  # a third of all rows
    entries = spark.createDataFrame([(i, p, len(p)) for i, p in enumerate(paths)], "idx long, path string, size long")
    return entries, name_index.build(entries, str(tmp_path_factory.mktemp("index") / "names"))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_as_a_scan(index, pattern):
    entries, built = index
    for base_only, insensitive in ((True, False), (True, True), (False, False), (False, True)):
        want = entries.where(search.glob(pattern, base_only, insensitive)).collect()
        found = name_index.find(built, pattern, base_only, insensitive)
        assert found.columns == entries.columns
        assert sorted(found.collect()) == sorted(want), (base_only, insensitive)


def test_selective_patterns_read_few_names(index):
    _, built = index
    names = name_index.candidates(built, name_index.needed("report-0[0-4]7.txt"))
    assert {f"report-0{k}7.txt" for k in (0, 1, 3, 4)} <= {r.base for r in names.collect()} and names.count() < 20
    assert name_index.candidates(built, name_index.needed("*.txt")) is None  # over SHARE of the names have these
    names = name_index.candidates(built, name_index.needed("*t-123*"))
    assert [r.base for r in names.collect()] == ["report-123.txt"]
    assert name_index.candidates(built, name_index.needed("a*c")) is None
    assert name_index.candidates(built, name_index.needed("no-such-name")).count() == 0
    plan = name_index.find(built, "*t-123*")._jdf.queryExecution().executedPlan().toString()
    bucket = built.entries.where(F.col("base") == "report-123.txt").first().bucket
    assert f"(bucket#" in plan and f" = {bucket})" in plan  # the other buckets' folders aren't read


def test_runs_of_a_pattern():
    assert glob_runs("ab*cd?e[x-z]fg\\*h") == ["ab", "cd", "e", "fg*h"]
    assert glob_runs("top/ab*cd", False) == ["ab", "cd"]
    assert glob_runs("ab[/]cd", False) == ["cd"]
    assert glob_runs("ab\\/cd", False) == ["cd"]
    assert glob_runs("***") == []


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "idx long, path string, size long")
    built = name_index.build(none, str(tmp_path / "names"))
    assert name_index.find(built, "abc*").count() == 0 and name_index.find(built, "*").count() == 0


REGEXES = ["report-0[0-4]7", "e1/report-12", r"(?:report-1|hot\.b)", "rep+ort-[12]", r"d3/x1\d+/hot", "kelvin", "^d1/", "line.end", "x{3}", r"d\d/e1$", "KELVIN|\\*STAR", "star|", "(d2/(kelvin|été))", "d1.b/line", "no-such", r"\Qreport\E-27", "e2/rep"]


@pytest.mark.parametrize("pattern", REGEXES)
def test_regex_same_as_a_scan(index, pattern):
    entries, built = index
    for insensitive in (False, True):
        found = name_index.find_regex(built, pattern, insensitive)
        assert found.columns == entries.columns
        assert sorted(found.collect()) == sorted(entries.where(search.regex(pattern, insensitive)).collect()), insensitive


def test_many_candidates_are_joined(index, monkeypatch):
    entries, built = index
    monkeypatch.setattr(name_index, "LITERALS", 2)
    for pattern in ("report-12", "x1./hot|report-27"):
        assert sorted(name_index.find_regex(built, pattern).collect()) == sorted(entries.where(search.regex(pattern)).collect())
    assert sorted(name_index.find(built, "*t-12*").collect()) == sorted(entries.where(search.glob("*t-12*")).collect())


def test_needs_of_a_regular_expression():
    def needs(pattern):
        return sorted(sorted(n) for n in regex_needs(pattern, 3))

    assert needs(r"abc/Defg\.h") == [["abc"], ["defg.h"]]
    assert needs("abcd?ef+gh") == [["abc"]]
    assert needs("abcx+def") == [["abcx"], ["def"]]
    assert needs("abc{2}def{0,3}ghi") == [["abc"], ["ghi"]]
    assert needs("abc|xyz12|q[ab]rst") == [["abc", "rst", "xyz12"]]
    assert needs("abc|.*") == needs("(abc)?") == needs("(abc|x)") == needs("[abc]abc*") == needs("") == []
    assert needs("(?i)(?P<n>abc)(?:def|ghi)+(jkl){0}") == [["abc"], ["def", "ghi"]]
    assert needs(r"abc\ddef\x41ghi\pLjkl") == [["abc"], ["def"], ["ghi"], ["jkl"]]
    assert needs("abcédef") == [["abc"], ["def"]]


def test_folding_is_that_of_searches(spark):
    """No other character than those folded matches an ASCII letter when case is ignored."""
    chars = spark.createDataFrame([(chr(c),) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000], "path string")
    for letter in "abiks":
        matching = {r.path for r in chars.where(search.regex(f"^{letter}$", True)).collect()}
        assert matching == {r.path for r in chars.where(F.substr(name_index.folded(F.col("path")), F.lit(1), F.lit(1)) == letter).collect()}
    assert chars.where(search.regex("^[a-z]$", True) & ~name_index.folded(F.col("path")).rlike("^[a-z]")).count() == 0
