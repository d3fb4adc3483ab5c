"""The engine against a plain interpreter, and its surfaces over small corpora."""

from __future__ import annotations

import os
import random
from collections import Counter
from dataclasses import replace
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine, Options, SearchError
from quarry.operators import formats, stats
from quarry.operators import results as R
from quarry.plans.explain import explain, why_file, why_no_results
from quarry.plans.query import And, Not, Or, Predicate, QueryError, canonical
from quarry.request import Limits, Request, Sessions, classify_error, describe, digest, languages, predicate_catalog, run
from quarry.sources import files as S
from quarry.streaming import continuous

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
T = lambda d: datetime(2024, 1, d)
FILES = [
    ("src/a.rs", "alpha\nbeta\nalpha beta\n", T(1)),
    ("src/B.RS", "fn main() { call(); }\n// alpha note\n", T(10)),
    ("src/deep/c.py", "import os\ndef alpha():\n    return beta('x')\n", T(20)),
    ("docs/read me.md", "ALPHA\r\nbeta\r\n\r\nalpha\rlast", T(30)),
    (".bashrc", "alias x=y\n", T(31)),
    ("_under/__init__.py", "", T(2)),
    ("blank.txt", "\n\n", T(3)),
    ("unicode.txt", "Ünïcode ÀLPHA\nstraße\n", T(4)),
    ("latin.bin", b"alpha \xff beta\n", T(5)),
    ("nul.bin", b"alpha\x00beta", T(6)),
    ("far.bin", b"a" * 9000 + b"\x00alpha", T(7)),
    ("key.txt", "alpha\nAWS_SECRET_ACCESS_KEY here\n", T(8)),
    ("script", "#!/usr/bin/env python\ndef beta(): pass\n", T(9)),
    ("none.xyz", "beta alpha", None),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, S.from_rows(spark, FILES), Options(now=NOW))


def paths(search) -> list[str]:
    return sorted(r[0] for r in search.paths.collect())


def test_metadata(engine):
    for query, want in {
        "ext:rs": ["src/B.RS", "src/a.rs"],
        "ext:bashrc": [],
        "name:__*": ["_under/__init__.py"],
        "name:'read me.MD'": ["docs/read me.md"],
        "path:deep": ["src/deep/c.py"],
        "path:SRC": [],
        "path:src/*.py": ["src/deep/c.py"],
        "in:src": ["src/B.RS", "src/a.rs"],
        "in:.": sorted(p for p, *_ in FILES if "/" not in p),
        "in:src/**": ["src/B.RS", "src/a.rs", "src/deep/c.py"],
        "in:nowhere": [],
        "path_exact:src/../src/a.rs": ["src/a.rs"],
        "size:0": ["_under/__init__.py"],
        "size:>9kb": [],
        "size:>8.5k": ["far.bin"],
        "modified:>3d": [".bashrc", "docs/read me.md"],
        "modified:2024-01-10": ["src/B.RS"],
        "modified:<2024-01-02": ["none.xyz", "src/a.rs"],
    }.items():
        assert paths(engine.search(query)) == sorted(want), query


def test_policy(engine):
    state = {r["display_path"]: (r["content_state"], r["text"]) for r in engine.search("!ext:zzz").results.collect()}
    assert state["latin.bin"] == ("loaded_lossy", "alpha � beta\n")
    assert state["nul.bin"] == ("skipped:binary", "") and state["key.txt"] == ("skipped:secret_like", "")
    assert state["far.bin"][0] == "loaded" and state["src/a.rs"][0] == "loaded"
    assert "key.txt" in paths(engine.search("!contains:alpha")) and "key.txt" not in paths(engine.search("contains:alpha"))
    for mark in ("-----BEGIN PRIVATE KEY-----", "aws_access_key_id", "Secret_Key=", "secret-key=", "Authorization: Bearer", "keyJson", "PRIVATE_KEY"):
        corpus = S.from_rows(engine.spark, [("x.txt", f"a {mark} b")])
        assert Engine(engine.spark, corpus).search("ext:txt").results.first()["content_state"] == "skipped:secret_like"
    assert Engine(engine.spark, S.from_rows(engine.spark, [("x.txt", b"a" * 10485760), ("y.txt", b"a" * 10485761)])).search("contains:a").matched.select("name").collect() == [("x.txt",)]


def ranges(search) -> dict[str, list[tuple]]:
    return {r["display_path"]: (r["whole"], [tuple(h) for h in r["hunks"]]) for r in search.results.collect()}


def test_examples(engine):
    a = {"alpha": (0, 5, 0, 0, 0, 5), "beta": (6, 10, 1, 0, 1, 4), "both": (11, 21, 2, 0, 2, 10)}
    for query, want in {
        "ext:rs": (True, []),
        "contains:alpha": (False, [a["alpha"], a["both"]]),
        "contains:alpha & contains:beta": (False, [a["alpha"], a["beta"], a["both"]]),
        "contains:alpha & ext:rs": (False, [a["alpha"], a["both"]]),
        "contains:alpha | ext:rs": (True, []),
        "contains:alpha | ext:py": (False, [a["alpha"], a["both"]]),
        "!contains:zzz": (True, []),
        "!contains:alpha | contains:beta": (False, [a["beta"], a["both"]]),
        "!(contains:zzz | contains:yyy)": (True, []),
        "!(ext:py & contains:alpha)": (True, []),
        "!(!contains:alpha)": (True, []),
        "!func:x": (True, []),
    }.items():
        assert ranges(engine.search(query)).get("src/a.rs") == want, query
    assert "src/a.rs" not in ranges(engine.search("contains:zzz | ext:py"))
    assert "src/a.rs" not in ranges(engine.search("!(contains:zzz | contains:yyy)", unsound_prefilter=True))
    assert "src/a.rs" not in ranges(engine.search("!(!contains:alpha)", unsound_prefilter=True))


def test_line_offsets(engine):
    query = "contains:alpha & path:docs"
    assert ranges(engine.search(query))["docs/read me.md"][1] == [(0, 5, 0, 0, 0, 5), (15, 25, 3, 0, 3, 10)]
    assert ranges(engine.search(query, drift=True))["docs/read me.md"][1] == [(0, 5, 0, 0, 0, 5), (12, 22, 3, 0, 3, 10)]
    assert ranges(engine.search("contains:STRAßE | contains:'ünïcode à'"))["unicode.txt"][1] == [(0, 16, 0, 0, 0, 16), (17, 24, 1, 0, 1, 7)]
    assert ranges(engine.search('contains:"" & name:blank*'))["blank.txt"][1] == [(0, 0, 0, 0, 0, 0), (1, 1, 1, 0, 1, 0)]
    assert paths(engine.search('contains:"" & size:0')) == []


# --- a plain interpreter of the algebra, over the loaded texts


def leaf(p: Predicate, path: str, text: str):
    if p.key == "ext":
        name = path.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[1] if "." in name[1:] else None
        return ext is not None and ext.lower() == p.value.lower()
    if p.key == "path":
        return p.value in path
    out, at = [], 0
    pieces = text.split("\n")
    for row, piece in enumerate(pieces):
        if row == len(pieces) - 1 and not piece:
            break
        line = piece[:-1] if row < len(pieces) - 1 and piece.endswith("\r") else piece
        size = len(line.encode())
        if p.value.lower() in line.lower():
            out.append((at, at + size, row, 0, row, size))
        at += len(piece.encode()) + 1
    return out


def hit(x) -> bool:
    return x is True or isinstance(x, list) and bool(x)


def merge(a: list, b: list) -> list:
    out = []
    for x in sorted(a + b, key=lambda x: x[0]):
        if not out or out[-1] != x:
            out.append(x)
    return out


def interpret(node, path: str, text: str):
    match node:
        case Predicate():
            return leaf(node, path, text)
        case Not(child):
            return not hit(interpret(child, path, text))
        case And(left, right):
            a, b = interpret(left, path, text), interpret(right, path, text)
            if not (hit(a) and hit(b)):
                return False
            return b if a is True else a if b is True else merge(a, b)
        case Or(left, right):
            a, b = interpret(left, path, text), interpret(right, path, text)
            if a is True or b is True:
                return True
            return b if a is False else a if b is False else merge(a, b)


def made(rng, depth: int):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice([Predicate("ext", "rs"), Predicate("ext", "py"), Predicate("path", "src"), Predicate("contains", "alpha"), Predicate("contains", "beta"), Predicate("contains", "zzz"), Predicate("contains", "a")])
    kind = rng.choice([And, Or, Not])
    return Not(made(rng, depth - 1)) if kind is Not else kind(made(rng, depth - 1), made(rng, depth - 1))


def test_random_queries_equal_the_interpreter(engine):
    texts = {r["display_path"]: r["text"] for r in engine.search("!ext:zzz").results.collect()}
    rng = random.Random(5)
    for _ in range(25):
        node = made(rng, 3)
        search = engine.search(canonical(node))
        want = {p: interpret(search.ast, p, t) for p, t in texts.items()}
        want = {p: (x is True, [] if x is True else x) for p, x in want.items() if hit(x)}
        assert ranges(search) == want, canonical(node)
        assert paths(search) == sorted(want)


def test_validation(engine):
    for bad in ("EXT:rs", "zzz:1", "size:>=10kb", "modified:soon", "matches:'('", "matches:(?=x)", "name:''", "in:[a", "matches:['\\w'"):
        with pytest.raises(QueryError):
            engine.search(bad)


def test_semantic_modes(engine):
    assert paths(engine.search("func:alpha")) == ["src/deep/c.py"]
    assert paths(engine.search("def:beta")) == ["script"]
    assert paths(engine.search("call:bet")) == ["src/deep/c.py"] and paths(engine.search("func:alph")) == []
    assert paths(engine.search("func:alph", semantic_match="prefix")) == ["src/deep/c.py"]
    assert paths(engine.search("func:^a.*a$", semantic_match="regex")) == ["src/deep/c.py"]
    assert paths(engine.search("func:a*a", semantic_match="wildcard")) == ["src/deep/c.py"]
    assert paths(engine.search("func:ALPHA", semantic_match="case_insensitive")) == ["src/deep/c.py"]
    assert paths(engine.search("func:.")) == ["script", "src/B.RS", "src/deep/c.py"]
    assert "import os" not in [m["text"] for m in R.matches(engine.search("import:.").results).collect()]
    assert ranges(engine.search("call:beta"))["src/deep/c.py"][1] == [(34, 38, 2, 11, 2, 15)]
    skipped = {r["display_path"]: r["skip_reasons"] for r in engine.search("!func:x").results.collect()}
    assert skipped["blank.txt"] == ["unsupported_language"] and skipped["src/a.rs"] == []
    assert paths(engine.search("func:alpha & ext:md", language="python")) == []
    with pytest.raises(QueryError):
        engine.search("func:x", semantic_match="odd").results  # noqa: B018
    with pytest.raises(SearchError):
        engine.search("func:x", semantic_strict=True).strict_check()
    engine.search("func:x & ext:py", semantic_strict=True).strict_check()


def test_sql_dialect_override(spark):
    corpus = S.from_rows(spark, [("a.sql", "CREATE TABLE t (a int);"), ("b.SQL", "delimiter //\ncreate function f() returns int return 1;")])
    e = Engine(spark, corpus)
    assert paths(e.search("def:t")) == ["a.sql"] and paths(e.search("func:f")) == ["b.SQL"]
    assert paths(e.search("def:t", sql_dialect="postgres")) == ["a.sql"]


def test_results(engine):
    s = engine.search("contains:alpha & path:src/a.rs")
    m = R.matches(s.results).collect()
    assert [(x["start_line"], x["end_line"], x["start_column"], x["end_column"], x["text"]) for x in m] == [(1, 1, 0, 5, "alpha"), (3, 3, 0, 10, "alpha beta")]
    assert [tuple(x)[2:] for x in R.blocks(s.results, 0).collect()] == [(0, 0, 1), (1, 2, 3)]
    assert [tuple(x)[2:] for x in R.blocks(s.results, 1).collect()] == [(0, 0, 3)]
    snip = R.snippets(s.results, 1).collect()
    assert [(x["start_line"], x["end_line"], x["text"]) for x in snip] == [(1, 2, "alpha\nbeta"), (2, 3, "beta\nalpha beta")]
    assert R.snippets(s.results, 1, max_bytes=3).first()["text_truncated"]
    one = R.limited_matches(s.results, 1, 3).first()
    assert one["matches_truncated"] and [(x["text"], x["text_truncated"]) for x in one["matches"]] == [("alp", True)]
    crlf = engine.search("contains:beta & path:docs").results
    assert R.snippets(crlf, 1).first()["line_ending"] == "crlf" and R.snippets(crlf, 1, normalise=True).first()["line_ending"] == "lf"
    assert R.full_content(crlf, 3).first()["content"] == "ALP"


def test_page(engine):
    items = engine.search("!ext:zzz").matched.select("display_path", "resolved_path")
    order = sorted(p for p, *_ in FILES)
    assert [r["display_path"] for r in R.page(items, 3).orderBy("position").collect()] == order[:3]
    assert [(r["position"], r["display_path"]) for r in R.page(items, 2, 4).orderBy("position").collect()] == [(4, order[4]), (5, order[5])]
    assert R.page(items, 5, 0, 1).count() == 1 and R.page(items, None, 0, None).count() == len(FILES)


def test_stats(engine):
    c = stats.counters(engine.search("path:src & contains:alpha")).first().asDict()
    assert (c["candidate_files"], c["prefiltered_files"], c["matched_files"], c["matched_ranges"]) == (len(FILES), 3, 3, 4)
    assert stats.counters(engine.search("!ext:zzz")).first()["suppressed_binary"] == 1
    assert stats.hotspots(engine.corpus.files).first()["path"] == "src"
    known = {r["ext"]: (r["files"], r["semantic_profile"]) for r in stats.inventory(engine.corpus.files).collect()}
    assert known["rs"] == (2, "rs") and known["md"] == (1, None)


def test_drift(engine):
    before = engine.corpus.files
    after = before.where("name <> 'a.rs'").withColumn("size_bytes", F.when(F.col("name") == "c.py", 1).otherwise(F.col("size_bytes")))
    assert sorted(map(tuple, R.drift(before, after).collect())) == [("/made/src/a.rs", "gone"), ("/made/src/deep/c.py", "changed")]


def test_formats(engine):
    s = engine.search("contains:alpha & ext:rs")
    shown = {form: formats.render(s, form) for form in formats.FORMATS}
    assert shown["paths"] == "src/B.RS\nsrc/a.rs"
    assert shown["summary"].splitlines()[1] == "src/a.rs\t2\tfalse\tloaded\t-"
    assert "  3:1-3:11 alpha beta" in shown["matches"] and "@@ 1-3 @@" in shown["snippets"]
    assert "```rs" in shown["markdown"] and "fn main" in shown["cat"] and "2024-01-01" in shown["find"]
    assert '"display_path":"src/a.rs"' in shown["json"] and "files: 2" in shown["diagnostics"]
    assert formats.render(s, "hunks", context=0).count("...") == 1
    assert (formats.human_size(5), formats.human_size(1536), formats.human_size(5 << 30)) == ("5B", "1.5K", "5.0G")
    assert formats.escaped("a\tb\x07") == "a\\tb\\x07"
    with pytest.raises(ValueError):
        formats.render(s, "odd")


def test_requests(engine):
    q = "!ext:zzz"
    first = run(engine, Request(q, "paths", limits=Limits(max_results=5)))
    assert (len(first["items"]), first["status"], first["next_offset"]) == (5, "truncated", 5) and first["continuation"].startswith("after:")
    by_number = run(engine, Request(q, "paths", continuation="offset:5", limits=Limits(max_results=50)))
    second = run(engine, Request(q, "paths", continuation=first["continuation"], limits=Limits(max_results=50)))
    assert second["items"] == by_number["items"] and len(second["items"]) == len(FILES) - 5 and second["continuation"] is None and second["status"] == "full"
    exact = Request(q, "paths", limits=Limits(max_results=len(FILES)))
    assert not run(engine, exact)["truncated"] and run(engine, replace(exact, eager_truncation=True))["truncated"]
    small = run(engine, Request(q, "summary", limits=Limits(max_total_bytes=1)))
    assert len(small["items"]) == 1 and small["truncation_reason"] == "max_total_bytes"
    for mode in ("summary", "matches", "snippets", "full"):
        assert run(engine, Request("contains:alpha", mode))["items"]
    assert run(engine, Request("name:nul.bin", "full"))["status"] == "policy_suppressed"
    with pytest.raises(QueryError):
        run(engine, Request(q, "odd"))
    with pytest.raises(QueryError):
        run(engine, Request(q, continuation="x"))


def test_sessions(engine):
    clock = [0.0]
    s = Sessions(engine, ttl=10, most=2, clock=lambda: clock[0])
    request = Request("!ext:zzz", "paths", limits=Limits(max_results=6))
    seen, page = [], s.start(request)
    first = page["continuation"]
    while True:
        seen += [x["display_path"] for x in page["items"]]
        if not page["continuation"]:
            break
        page = s.next(page["continuation"])
    assert seen == sorted(p for p, *_ in FILES)
    page = s.start(request)
    for bad in (first, "x", page["continuation"][:-1] + "z"):
        with pytest.raises(QueryError):
            s.next(bad)
    clock[0] = 11
    with pytest.raises(QueryError):
        s.next(page["continuation"])


def test_catalogs():
    assert len(predicate_catalog()) == 31 and len(languages()) == 26 and describe("C++")["id"] == "cpp"
    with pytest.raises(QueryError):
        describe("klingon")
    assert classify_error(QueryError("x"))["code"] == "query_validation" and classify_error(ValueError("x"))["code"] == "execution"


def test_explain_and_why(engine):
    text = "func:alpha & contains:beta & ext:py"
    s = engine.search(text)
    e = explain(s, text)
    assert e["estimated_cost"] == "high" and e["metadata_predicates"] == ["ext"] and e["normalized_query"] == text
    assert e["preflight"]["semantic_candidate_files"] > 0
    assert why_file(s, "src/deep/c.py") == {"path": "src/deep/c.py", "known": True, "metadata": True, "matches": True}
    assert not why_file(s, "src/a.rs")["metadata"]
    assert "metadata" in why_no_results(engine.search("ext:zzz")) and "none matches" in why_no_results(engine.search("ext:rs & contains:zzz"))


def test_plans_prune_and_push(spark):
    corpus = S.documents(spark, "/root/testdata/sf0.001")
    plan = Engine(spark, corpus).search("path:en/src1/ & size:>1kb").paths._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    light = Engine(spark, corpus).search("path:en/src1/ & ext:txt").paths._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in light.split("ReadSchema")[0] or "text:string" not in light.split("ReadSchema")[-1]
    content = Engine(spark, corpus).search("path:en/ & contains:the").matched._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in content and "Exchange" not in content


def test_directory(spark, tmp_path):
    tree = {
        "a.py": "x", "_b.py": "x", ".hidden/c.py": "x", "node_modules/d.js": "x", "src/node_modules/e.js": "x", "src/__pycache__/f.py": "x", "g.pyc": "x",
        "src/h.log": "x", "src/keep.log": "x", "build/i.txt": "x", "dist/j.txt": "x", "src/sub/k.tmp": "x", "src/sub/l.txt": "alpha\n",
        ".gitignore": "*.log\n!keep.log\n# note\n/src/only/\n", "src/only/m.txt": "x", "src/sub/.gitignore": "*.tmp\n", ".quarryignore": "!dist/\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    e = Engine(spark, S.directory(spark, str(tmp_path)))
    rel = sorted(r[0] for r in e.search("!ext:zzz").matched.select("root_relative_path").collect())
    assert rel == ["_b.py", "a.py", "dist/j.txt", "src/keep.log", "src/node_modules/e.js", "src/sub/l.txt"]
    assert [r["name"] for r in e.search("contains:alpha").results.collect()] == ["l.txt"]
    assert Counter(r["skip_reason"] for r in e.corpus.listing.collect())["hidden"] == 4
    assert {r["skip_reason"]: r["files"] for r in stats.skip_counts(e.corpus.listing).collect()}["ignored"] == 7
    everything = S.directory(spark, str(tmp_path), hidden=True, no_ignore=True)
    assert everything.files.count() == len(tree)
    assert S.directory(spark, str(tmp_path), max_depth=1).files.count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    adapt = lambda df: S.from_table(df, F.concat_ws("/", "lang", F.col("doc_id").cast("string")), F.col("text"), S.synthetic_time(F.col("doc_id")), file_id=F.col("doc_id"))
    corpus = continuous.stream_table(spark, str(tmp_path / "in"), src.schema, adapt, files_per_trigger=1)
    out = str(tmp_path / "out")
    q = continuous.start(continuous.continuous(spark, corpus, "path:en/ & contains:the").select("file_id"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "check"))
    q.awaitTermination()
    got = {r[0] for r in spark.read.parquet(f"{out}/*").collect()}
    assert got == {r[0] for r in Engine(spark, adapt(src)).search("path:en/ & contains:the").matched.select("file_id").collect()}
    assert continuous.hotspots(corpus.files).isStreaming


def test_command_line(spark, tmp_path):
    from quarry.cli import run as cli

    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    (tmp_path / ".quarry.toml").write_text('[presets]\npy = "ext:py"\n')
    session = lambda: spark
    root = ["--root", str(tmp_path)]
    assert cli(["search", "func:f", "--preset", "py", "--format", "paths", *root], session).endswith("a.py")
    assert cli(["search", "", "--preset", "py", "--format", "cat", "--output", str(tmp_path / "out"), *root], session) == ""
    assert (tmp_path / "out").read_text() == "def f():\n    pass"
    assert cli(["query", "normalize", "c:x"], session) == "contains:x" and cli(["query", "validate", "ext:x"], session) == "valid"
    assert cli(["preset", "list", *root], session) == "py" and cli(["preset", "show", "py", *root], session) == "ext:py"
    assert '"Python"' in cli(["lang", "describe", "py"], session) and "metadata" in cli(["query", "reference"], session)
    assert '"matches": true' in cli(["query", "why-file", "func:f", "--file", str(tmp_path / "a.py"), *root], session)
    with pytest.raises(QueryError):
        cli(["query", "validate", "zz:x"], session)


def test_sql_functions(spark):
    from quarry.functions.sql import register, search_view

    register(spark)
    rows = [(1, "a/b.py", "def f(): pass"), (2, "a/b.txt", "def f(): pass"), (3, "c.py", "x = f()"), (4, None, None)]
    spark.createDataFrame(rows, "id long, p string, t string").createOrReplaceTempView("texts")
    for query, want in {"ext:py & func:f": [1], "call:f | path:b.txt": [2, 3], "!contains:def": [3], "matches:'^x'": [3]}.items():
        search_view(spark, "hits", "texts", "p", "t", query, ("id",))
        assert [r["id"] for r in spark.sql("SELECT id FROM hits WHERE display_path IS NOT NULL ORDER BY id").collect()] == want, query
    search_view(spark, "hits", "texts", "p", "t", "contains:'F('", ("id",))
    assert spark.sql("SELECT id, m.start_line FROM hits LATERAL VIEW explode(matches) AS m WHERE id > 1 ORDER BY id").collect() == [(2, 1), (3, 1)]
    got = spark.sql("SELECT text, start_row FROM query_captures('py', 'func', 'x\ndef g(): pass')").collect()
    assert [tuple(r) for r in got] == [("g", 1)]


def test_unreadable_files(spark, tmp_path):
    """A file that goes after it was listed: a result without content, or the end of the search."""
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("alpha\n")
    e = Engine(spark, S.directory(spark, str(tmp_path)))
    (tmp_path / "b.txt").unlink()
    assert {r["name"]: r["content_state"] for r in e.search("ext:txt").results.collect()} == {"a.txt": "loaded", "b.txt": "skipped:unreadable"}
    assert [r["name"] for r in e.search("contains:alpha").matched.collect()] == ["a.txt"]
    got = run(e, Request("ext:txt"))
    assert got["status"] == "partial" and [x["kind"] for x in got["diagnostics"]] == ["unreadable"]
    assert run(e, Request("ext:txt", limits=Limits(max_errors=0)))["errors_left_out"] == 1
    with pytest.raises(Exception, match="Unreadable file"):
        run(e, Request("ext:txt", error_mode="fail_fast"))
    assert "alpha" not in digest(e, Request("ext:txt"), got) and "b.txt" in digest(e, Request("ext:txt"), got)
    assert run(e, Request("ext:txt", "paths", path_display="absolute"))["items"][0]["path"].startswith("/")


def test_islands_of_many_files():
    a, z, n = R.islands(np.array([0, 2, 9, 5, 0]), np.array([3, 4, 12, 6, 1]), np.array([3, 0, 1, 1]))
    assert (a.tolist(), z.tolist(), n.tolist()) == ([0, 9, 5, 0], [4, 12, 6, 1], [2, 0, 1, 1])
