"""The query language: parsing, canonical text, rewrites, value parsing, presets."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions.globs import name_regex, path_regex, plain_name
from quarry.functions.values import line_regex, size_value, time_value
from quarry.plans import query as Q
from quarry.plans.explain import lint_query, value_plan
from quarry.plans.presets import Presets, effective_query, load
from quarry.plans.query import And, Not, Or, Predicate, QueryError, canonical, parse
from quarry.plans.rewrite import cost_sorted, metadata_part, simplified, unsound_metadata_part, weakened


def P(key, value):
    return Predicate(key, value)


PARSED = {
    "ext:rs": P("ext", "rs"),
    "ext : rs": P("ext", "rs"),
    "ext:rs & name:a | path:b": Or(And(P("ext", "rs"), P("name", "a")), P("path", "b")),
    "a:1 | b:2 & c:3": Or(P("a", "1"), And(P("b", "2"), P("contains", "3"))),
    "ext:rs AND NOT path:t": And(P("ext", "rs"), Not(P("path", "t"))),
    "ext:rs&name:x": P("ext", "rs&name:x"),
    "!(!ext:rs)": Not(Not(P("ext", "rs"))),
    "notext:rs": Not(P("ext", "rs")),
    'name:"foo bar"': P("name", "foo bar"),
    "name:'foo bar'": P("name", "foo bar"),
    'contains:"a & b | c"': P("contains", "a & b | c"),
    r"matches:'\d+'": P("matches", "d+"),
    r"matches:\d+": P("matches", r"\d+"),
    r"matches:'\\d+'": P("matches", r"\d+"),
    "contains:''": P("contains", ""),
    'name:"foo': P("name", "fo"),
    "c:x": P("contains", "x"),
    "content:x": P("contains", "x"),
    "m:x": P("matches", "x"),
    "EXT:rs": P("EXT", "rs"),
    "size:>=10kb": P("size", ">=10kb"),
    "(a:1 | b:2) & x:3": And(Or(P("a", "1"), P("b", "2")), P("x", "3")),
    "a:1 or b:2 And x:3": Or(P("a", "1"), And(P("b", "2"), P("x", "3"))),
    "\n ext:rs\t&\r\n name:x ": And(P("ext", "rs"), P("name", "x")),
    "android:1": P("android", "1"),
    r"name:'a\'bc'": P("name", "a'bc"),
    "contains:foo'bar": P("contains", "foo'bar"),
}


@pytest.mark.parametrize("text", PARSED)
def test_parse(text):
    assert parse(text) == PARSED[text]


@pytest.mark.parametrize("text", ["ext:rs name:x", "& ext:rs", "ext:rs &", "ext:rs & & name:x", "!!ext:rs", "(ext:rs", "()", "", "  \n", 'contains:"', "func:f(x)", "not:x", "ext:", ":rs", "ext:rs)", "a:1 ! b:2 &"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_canonical():
    for text, want in {"c:x": "contains:x", "(a:1 | b:2) & x:3": "(a:1 | b:2) & x:3", "a:1 & (b:2 & x:3)": "a:1 & b:2 & x:3", "!(a:1 & b:2)": "!(a:1 & b:2)", "!a:1": "!a:1", "name:'a b'": 'name:"a b"', "x:''": 'x:""'}.items():
        assert Q.normalize(text) == want
    assert Q.stable(parse("a:1 & b:2 & !(x:3 | y:4)")) == {"kind": "and", "children": [{"kind": "predicate", "key": "a", "value": "1"}, {"kind": "predicate", "key": "b", "value": "2"}, {"kind": "not", "child": {"kind": "or", "children": [{"kind": "predicate", "key": "x", "value": "3"}, {"kind": "predicate", "key": "y", "value": "4"}]}}]}


def test_token_soup_never_fails_oddly():
    rng = random.Random(11)
    tokens = ["ext:rs", "&", "|", "!", "(", ")", "not", "AND", "or", "'", '"', "\\", "contains:'a b'", ":", "name", " ", "é"]
    for _ in range(2000):
        text = rng.choice(["", " "]).join(rng.choice(tokens) for _ in range(rng.randint(0, 12)))
        try:
            parse(text)
        except QueryError:
            pass


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_parses_or_is_refused(text):
    try:
        parse(text)
    except QueryError:
        pass


KEYS = st.sampled_from(["ext", "path", "contains", "func", "zzz"])
NODES = st.recursive(st.builds(Predicate, KEYS, st.sampled_from(["a", "b", "x y", "&"])), lambda c: st.one_of(st.builds(And, c, c), st.builds(Or, c, c), st.builds(Not, c)), max_leaves=10)


def evaluate(node, truth) -> bool:
    match node:
        case bool():
            return node
        case Predicate():
            return truth[node.key, node.value]
        case Not(child):
            return not evaluate(child, truth)
        case And(left, right):
            return evaluate(left, truth) and evaluate(right, truth)
        case Or(left, right):
            return evaluate(left, truth) or evaluate(right, truth)


@given(NODES, st.integers(0, 1 << 20))
@settings(max_examples=400, deadline=None)
def test_rewrites_keep_the_meaning(node, seed):
    rng = random.Random(seed)
    truth = {(k, v): rng.random() < 0.5 for k in ("ext", "path", "contains", "func", "zzz") for v in ("a", "b", "x y", "&")}
    want = evaluate(node, truth)
    assert evaluate(cost_sorted(node), truth) == want
    assert evaluate(simplified(node), truth) == want
    assert evaluate(parse(canonical(node)), truth) == want
    assert evaluate(metadata_part(node), truth) or not want  # a bound from above
    assert {p.key for p in Q.predicates(metadata_part(node))} <= {"ext", "path"} if not isinstance(metadata_part(node), bool) else True


def test_weakening():
    assert metadata_part(parse("!(contains:a | contains:b)")) is True
    assert unsound_metadata_part(parse("!(contains:a | contains:b)")) is False
    assert unsound_metadata_part(parse("!contains:a")) is True
    assert metadata_part(parse("!(ext:rs & contains:x)")) is True
    assert metadata_part(parse("!(ext:rs | contains:x)")) == Not(P("ext", "rs"))
    assert metadata_part(parse("ext:rs & (func:x | size:>1)")) == P("ext", "rs")
    assert weakened(parse("a:1 | b:2"), lambda p: p) == parse("a:1 | b:2")


def test_cost_order():
    assert canonical(cost_sorted(parse("component:a & func:x & contains:y & zz:1 & !ext:rs & (ext:a | ext:b) & name:z"))) == "name:z & !ext:rs & contains:y & func:x & component:a & zz:1 & (ext:a | ext:b)"


def test_sizes_and_times():
    assert (size_value(">10kb").bytes, size_value("1.5m").bytes, size_value("=7").operator, size_value("< 2 G").bytes) == (10240, 1572864, "=", 2 * 1024**3)
    for bad in (">=10kb", "x", "10xb", "", ">", "1.2.3"):
        with pytest.raises(QueryError):
            size_value(bad)
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    assert time_value(">2d").threshold(now) == datetime(2024, 1, 30, tzinfo=timezone.utc)
    assert time_value("<2024-01-05 10:00:00").at == datetime(2024, 1, 5, 10, tzinfo=timezone.utc)
    assert time_value("2024-01-05").day and time_value("2024-01-05", "Europe/Berlin").at.hour == 23
    for bad in ("2", "2x", "2024-13-01", "1969-01-01", "", ">"):
        with pytest.raises(QueryError):
            time_value(bad)
    assert value_plan(P("size", ">1k")) == {"kind": "size", "operator": ">", "bytes": 1024}


def test_regex_flavour():
    assert line_regex(r"(?P<y>\d+)x") == r"(?dU)(?<y>\d+)x"
    for bad in (r"(?=x)", r"(?!x)", r"(?<=x)", r"(a)\1", r"a++", r"(?>a)"):
        with pytest.raises(QueryError):
            line_regex(bad)
    assert line_regex(r"[(?=]\\1") and line_regex("a+")


@pytest.mark.parametrize(("pattern", "yes", "no"), [("*.rs", ["a.rs", ".rs", "A.RS"], ["a.rsx"]), ("[!a]?.txt", ["bx.txt"], ["ax.txt"]), ("[a-c]*", ["Cat"], ["dog"]), ("a[]]b", ["a]b"], ["ab"]), ("**", ["anything"], []), ("a{b", ["a{b"], [])])
def test_name_globs(spark, pattern, yes, no):
    check(spark, name_regex(pattern), yes, no)


@pytest.mark.parametrize(("pattern", "yes", "no"), [("src/*.rs", ["src/a.rs", "src/b/a.rs"], ["x/src/a.rs"]), ("**/*.rs", ["a.rs", "x/y/a.rs"], ["a.rsx"]), ("src/**", ["src/a", "src/b/c"], ["src"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]), ("{a,b}/x[!0-9]", ["a/xy", "b/x_"], ["c/xy", "a/x1"]), (r"a\*b", ["a*b"], ["axb"]), ("A*", ["Ab"], ["ab"])])
def test_path_globs(spark, pattern, yes, no):
    check(spark, path_regex(pattern), yes, no)


def check(spark, regex, yes, no):
    java = spark._jvm.java.util.regex.Pattern.compile(regex)
    assert [x for x in yes if not java.matcher(x).find()] == [] and [x for x in no if java.matcher(x).find()] == []


def test_bad_globs():
    for bad in ("", "a**b", "***", "[a", "[z-a]"):
        with pytest.raises(QueryError):
            name_regex(bad)
    for bad in ("[a", "{a", "a}", "a\\"):
        with pytest.raises(QueryError):
            path_regex(bad)
    assert plain_name("*.RS") == ("endswith", ".rs") and plain_name("a?b") is None and plain_name("*x*") == ("contains", "x") and plain_name("Makefile") == ("equals", "makefile")


def test_presets(tmp_path):
    p = Presets().add_text('[presets]\nrust = "ext:rs"\n[presets.app]\nquery = "path:src"\nincludes = ["rust"]\n[presets.loop]\nextends = "loop2"\n[presets.loop2]\nextends = "loop"\n')
    assert p.resolve("app") == "(ext:rs) & (path:src)"
    assert effective_query("func:x", ("app",), p) == "(((ext:rs) & (path:src))) & (func:x)"
    for bad in ("loop", "none"):
        with pytest.raises(QueryError):
            p.resolve(bad)
    (tmp_path / ".quarry.toml").write_text('schema_version = 9\n[presets]\nx = "ext:a"\n')
    (tmp_path / "global.toml").write_text('[presets]\nx = "ext:b"\ny = "ext:c"\n')
    (tmp_path / "sub").mkdir()
    got = load(tmp_path / "sub", tmp_path / "global.toml")
    assert got.resolve("x") == "ext:a" and got.resolve("y") == "ext:c" and len(got.diagnostics) == 1


def test_lint():
    assert len(lint_query("content:x")) == 1
    assert len(lint_query("ext:a & ext:b & name:x & name:y")) == 2
    assert len(lint_query("func:x & contains:y")) == 1 and lint_query("func:x & ext:rs") == []
