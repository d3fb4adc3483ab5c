"""Regular expressions that backtracking takes exponential time for, and the texts that matches hold."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions import patterns
from quarry.functions.values import checked_regex
from quarry.plans.query import QueryError
from quarry.sources import files as S

#: Pattern, and a line that it fails on only after trying everything.
HOSTILE = [
    ("^(a+)+$", "a" * 40 + "!"),
    ("^(a|a)*$", "a" * 40 + "!"),
    ("^(a|ab|b)*c$", "ab" * 30),
    ("^([A-Za-z]+[ ,.]?)+$", "abcdefghij" * 6 + ";"),
    (r"^(\w|[a-z]+ )*[.]$", "abcdefghij" * 6),
    ("^(x+x+)+y", "x" * 60),
    ("^(?i)(a|A)*$", "aA" * 30 + "!"),
    ("^(([a-z])+.)+[A-Z]([a-z])+$", "a" * 60 + "!"),
    ("([a-z]+,? ?){12}[0-9]", "abcdef" * 20),
    ("^(a|a){40}b", "a" * 60),
    (r"^(\s*\S+\s*)+:$", "word " * 20),
    ("^((ab)*|(a|b)*)*c", "ab" * 40),
]
PLAIN = ["[0-9]{6}", r"^[A-Z][^,]*,\s[a-z]", r"(\d+,)*\d+$", "(ab|cd)+e", r"(?:\w+\s)*\w+$", "a{3,5}b?", r"\bfn\s+\w+", "(?P<name>[a-z]+)=(1|2)", r"[\w.]+@[\w.]+", "(?x) a b # note\n c", r"\p{Lu}\p{Ll}+", "[[:a]]|[^]x]|\\x41|\\u0042|\\x{43}"]


@pytest.fixture(scope="module")
def members(spark):
    return patterns.java_members(spark)


@pytest.fixture(scope="module")
def find(spark):
    return lambda pattern, text: spark._jvm.java.util.regex.Pattern.compile(pattern).matcher(text).find()


@pytest.mark.parametrize("pattern, line", HOSTILE)
def test_hostile_patterns_end_soon(spark, find, pattern, line):
    regex = checked_regex(spark, pattern)
    assert regex.java != "(?dU)" + pattern
    began = time.monotonic()
    if regex.java:
        assert not find(regex.java, line)
    else:
        assert not spark.createDataFrame([(line,)], "line string").select(patterns.accepted(F.col("line"), regex.table)).first()[0]
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("pattern", PLAIN)
def test_plain_patterns_stay(spark, members, pattern):
    assert patterns.bounded(pattern, members)[0] == pattern


@pytest.mark.parametrize("pattern", [r"(\b\w+\b ?)+;", "((a{1,60}){1,60}){1,60}x", "(a{3000}){3000}"])
def test_what_cannot_be_bounded_is_refused(spark, members, pattern):
    with pytest.raises(QueryError, match="Invalid regular expression"):
        patterns.bounded(pattern, members)


def some_pattern(r: random.Random, depth: int = 0) -> str:
    kind = r.random()
    if depth > 3 or kind < 0.35:
        return r.choice(["a", "b", "ab", "[ab]", "[^a]", ".", "c", r"\w", "", "[b-c]"])
    if kind < 0.6:
        return some_pattern(r, depth + 1) + some_pattern(r, depth + 1)
    if kind < 0.75:
        return f"(?:{some_pattern(r, depth + 1)}|{some_pattern(r, depth + 1)})"
    return f"(?:{some_pattern(r, depth + 1)})" + r.choice(["*", "+", "?", "{2}", "{1,3}", "{2,}", "{5}", "*?"])


def test_rewritten_patterns_match_the_same(members, find):
    r = random.Random(7)
    words = ["".join(r.choice("abc-") for _ in range(r.randint(0, 9))) for _ in range(80)]
    changed = refused = 0
    for _ in range(150):
        pattern = f"^(?:{some_pattern(r)})$"
        try:
            safe, literal, _ = patterns.bounded(pattern, members)
        except QueryError:
            refused += 1
            continue
        changed += safe != pattern
        want = [bool(re.search(pattern, w)) for w in words]
        assert all(literal in w for w, ok in zip(words, want) if ok), (pattern, literal)
        if safe not in (pattern, None):
            assert [find("(?dU)" + safe, w) for w in words] == want, (pattern, safe)
    assert changed > 12 and refused < 12


TABLED = ["(ab|cd)+e", "^([a-z]+,? ?)+$", "(a|b)*c$", "^(?:é|[^a-c])*x", r"(\d+,)*\d+;", "(?i)^(foo|bar)+!", "((a|b)c){2,}d?", "^(x|y)*$", "(a|$)*b", r"([\\$]|a)+\$", "(|a)+b|c(d|e)*f"]


@pytest.mark.parametrize("pattern", TABLED)
def test_tables_decide_as_java_does(spark, members, pattern):
    r = random.Random(pattern)
    lines = ["".join(r.choice("abcdefxyz,é 1;!$\\FOobar") for _ in range(r.randint(0, 12))) for _ in range(300)] + ["ababcde", "a b, c ", "foobarFOO!", "acbcd", "1,2,3;", "é中x", "xyxy", "", "bbac"]
    t = checked_regex(spark, pattern).table
    if "|$" in pattern:  # a place in the line within a loop
        assert t is None
        return
    df = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    got = df.select("line", patterns.accepted(F.col("line"), t).alias("a"), F.regexp_like("line", F.lit(checked_regex(spark, pattern).java)).alias("b")).collect()
    assert [(x["line"], x["a"]) for x in got] == [(x["line"], x["b"]) for x in got] and len({x["a"] for x in got}) == 2


def test_long_lines_do_not_exhaust_the_stack(spark):
    texts = {"a.txt": "word, " * 40_000 + "end", "b.txt": "word, " * 40_000 + "!\nshort one", "c.txt": "ab" * 30_000 + "c"}
    e = Engine(spark, S.from_rows(spark, list(texts.items())))
    names = lambda q: sorted(r[0] for r in e.search(q).paths.collect())
    assert names("matches:'^([a-z]+,? ?)+$'") == ["a.txt", "b.txt", "c.txt"] and names("matches:'^([a-z]+, )+!$'") == ["b.txt"] and names("matches:'^(a|b)+c'") == ["c.txt"]
    assert [r["start_row"] for r in e.search("matches:'^([a-z]+,? ?)+$' & name:b*").results.selectExpr("inline(hunks)").collect()] == [1]


def test_required_texts(members):
    for pattern, want in {"^.*licen[cs]e: x+$": "licen", "abc|abd": "", "(foo)?barbaz": "barbaz", "(?i)abc": "", "x(hello world)+y": "hello world", "a.bcd": "bcd", r"\d+": "", "[a]": "", r"fn\s+main\(\)": "main()", "ab{2}cd": "cd"}.items():
        assert patterns.bounded(pattern, members)[1] == want, pattern


def test_the_literal_is_looked_for_first(spark):
    corpus = S.documents(spark, "/root/testdata/sf0.001")
    found = Engine(spark, corpus).search(r"matches:'^.*\\bLicen[cs]e\\b'")
    plan = found.matched._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(low" in plan and "licen" in plan
    both = Engine(spark, corpus).search(r"!matches:'^.*\\bLicen[cs]e\\b'")
    n = found.matched.count()
    assert n and n + both.matched.count() == corpus.files.count()
    assert n == corpus.files.where(F.expr(r"exists(split(text, '\n'), x -> x rlike '\\bLicen[cs]e\\b')")).count()
