"""Directories as a table, and conditions on paths as conditions on columns."""

from __future__ import annotations

import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine, Options
from quarry.operators import stats
from quarry.plans.query import parse
from quarry.sources import files as S
from quarry.sources import inversion, tree
from quarry.sources.ignore import Rules

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)


def write(root, names: dict[str, str]) -> None:
    for name, text in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def rel(df) -> list[str]:
    return sorted(r[0] for r in df.select("root_relative_path").collect())


def load(spark, root, **options):
    S.directory(spark, str(root))  # registers the format
    return spark.read.format(tree.FORMAT).options(root=str(root), **{k: str(v) for k, v in options.items()}).load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def forest(tmp_path):
    write(tmp_path, {f"{a}/{b}/{c}.{e}": "x" * k for a in "pqr" for b in ("s", "t") for k, (c, e) in enumerate((("one", "py"), ("Two", "TXT"), ("three", "rs")))})
    write(tmp_path, {"top.py": "x", "p/mid.py": "x", "p/s/deep/er/low.py": "x", "node_modules/a/b.js": "x", ".git/config": "x", ".cache/z": "x", "q/.gitignore": "*.rs\n!three.rs\n", "r/.gitignore": "t/\n"})
    return tmp_path


def test_shares_hold_every_file_once(spark, forest):
    whole = rel(load(spark, forest, no_ignore=True, hidden=True))
    assert whole == sorted(os.path.relpath(os.path.join(d, f), forest) for d, _, fs in os.walk(forest) for f in fs)
    for shares in (1, 2, 5, 1000):
        assert rel(load(spark, forest, no_ignore=True, hidden=True, shares=shares)) == whole
        assert rel(load(spark, forest, shares=shares).where("skip_reason IS NULL")) == rel(S.directory(spark, str(forest)).files)


def test_the_driver_lists_no_wide_directory(forest, monkeypatch):
    monkeypatch.setattr(tree, "LOOK", 2)
    walk = tree.Walk(str(forest), str(forest), False, False, 100, ())
    parts = tree.TreeReader(walk, 256).partitions()
    assert [(p.where, p.below) for p in parts] == [("", True)]
    monkeypatch.undo()
    alone = [p for p in tree.TreeReader(walk, 256).partitions() if not p.below]
    assert {"", "p", "p/s", "q/t"} <= {p.where for p in alone} and "node_modules" in {p.where for p in tree.TreeReader(walk, 256).partitions()}


def reader(forest, *filters, **walk) -> tree.TreeReader:
    options = {"hidden": False, "no_ignore": False, "max_depth": 100, "global_rules": ()} | walk
    out = tree.TreeReader(tree.Walk(str(forest), str(forest), **options), 256)
    assert list(out.pushFilters(list(filters))) == []
    return out


def rows(r: tree.TreeReader) -> list[dict]:
    return [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]


def test_filters_keep_directories_shut(forest, monkeypatch):
    opened = []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(os.path.relpath(path, forest)) or scandir(path))
    D = tree.D
    got = rows(reader(forest, D.EqualTo(("parent_rel",), "p/s"), D.IsNull(("skip_reason",))))
    assert sorted(x["name"] for x in got) == ["Two.TXT", "one.py", "three.rs"] and set(opened) == {".", "p", "p/s"}
    opened.clear()
    assert [x["root_relative_path"] for x in rows(reader(forest, D.EqualTo(("resolved_path",), str(forest / "q/t/one.py"))))] == ["q/t/one.py"]
    assert set(opened) == {".", "q", "q/t"}
    opened.clear()
    assert [x["name"] for x in rows(reader(forest, D.StringStartsWith(("root_relative_path",), "p/s/de")))] == ["low.py"]
    assert set(opened) == {".", "p", "p/s", "p/s/deep", "p/s/deep/er"}
    opened.clear()
    assert {x["root_relative_path"] for x in rows(reader(forest, D.LessThanOrEqual(("depth",), 2), D.EqualTo(("ext_low",), "py")))} == {"top.py", "p/mid.py"}
    assert "p/s" not in opened
    opened.clear()
    rows(reader(forest, D.IsNull(("skip_reason",))))
    assert not {"node_modules", ".git", ".cache"} & set(opened)
    assert rows(reader(forest, D.EqualTo(("resolved_path",), "/elsewhere/x"))) == []


def test_queries_push_what_they_can(spark, forest):
    e = Engine(spark, S.directory(spark, str(forest), pinned=False))
    for query, pushed in {"in:p/s": "parent_rel", "path:p/s/*": "root_relative_path", f"path_exact:{forest}/top.py": "resolved_path", "ext:PY & size:>0": "ext_low", "path:deep": "root_relative_path"}.items():
        s = e.search(query)
        assert f"EqualTo({pushed}" in plan(s.matched) or f"StartsWith({pushed}" in plan(s.matched) or f"Contains({pushed}" in plan(s.matched) or pushed in plan(s.matched).split("PushedFilters")[-1], query
        assert rel(s.matched) == rel(Engine(spark, S.directory(spark, str(forest))).search(query).matched)
    assert rel(e.search("in:p/s").matched) == ["p/s/Two.TXT", "p/s/one.py", "p/s/three.rs"]
    assert "skip_reason" not in e.search("ext:py").matched.columns


def test_skips_are_counted_and_explained(spark, forest):
    corpus = S.directory(spark, str(forest))
    counts = {r["skip_reason"]: r["files"] for r in stats.skip_counts(corpus.listing).collect()}
    assert counts == {"hidden": 4, "ignored": 4}
    told = {r["path"]: (r["source"], r["rule"]) for r in stats.exclusions(corpus.listing).collect()}
    assert told["node_modules/a/b.js"] == ("default", "node_modules/**") and told["r/t/one.py"] == ("r/.gitignore", "t/") and told[".git/config"][0] == "hidden"
    assert "q/s/three.rs" not in told  # taken back in
    assert stats.exclusions(corpus.listing, 2).count() == 2
    deep = S.directory(spark, str(forest), max_depth=2)
    assert {r["skip_reason"]: r["files"] for r in stats.skip_counts(deep.listing).collect()}["max_depth"] == 20 and rel(deep.files) == ["p/mid.py", "top.py"]


def test_at_most_25_exclusions(spark, tmp_path):
    write(tmp_path, {f"build/{k:03}.o": "x" for k in range(60)})
    told = stats.exclusions(S.directory(spark, str(tmp_path)).listing).collect()
    assert len(told) == 25 and told[0]["path"] == "build/000.o"


def test_links_and_unreadable_places(spark, tmp_path, monkeypatch):
    inside, outside = tmp_path / "in", tmp_path / "out"
    write(tmp_path, {"in/a.txt": "alpha", "out/secret.txt": "alpha", "in/shut/b.txt": "x"})
    os.symlink(outside, inside / "linked")
    os.symlink(outside / "secret.txt", inside / "file.txt")
    os.symlink(inside, inside / "loop")
    assert rel(S.directory(spark, str(inside)).files) == ["a.txt", "shut/b.txt"]
    scandir = os.scandir

    def refusing(path):
        if str(path).endswith("shut"):
            raise PermissionError(13, "Permission denied")
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refusing)
    got = {x["root_relative_path"]: (x["skip_reason"], x["skip_rule"]) for x in rows(reader(inside))}
    assert got == {"a.txt": (None, None), "shut": ("unreadable", "Permission denied")}
    with pytest.raises(FileNotFoundError):
        S.directory(spark, str(tmp_path / "absent"))


def test_invalid_text_is_read_lossily(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"alpha \xff\xfe beta\n")
    r = Engine(spark, S.directory(spark, str(tmp_path))).search("contains:alpha").results.first()
    assert r["content_state"] == "loaded_lossy" and "beta" in r["text"]


def test_a_file_that_changes_after_it_was_listed(spark, tmp_path):
    write(tmp_path, {"a.txt": "alpha\n", "b.txt": "alpha\n", "c.txt": "alpha\n"})
    corpus = S.directory(spark, str(tmp_path))
    (tmp_path / "b.txt").write_text("alpha and more\n")
    os.chmod(tmp_path / "c.txt", 0o444)
    got = {r["name"]: r["changed"] for r in Engine(spark, corpus).search("contains:alpha").results.collect()}
    assert got["a.txt"] is None and got["b.txt"].startswith("size") and got["c.txt"] == "readonly,mode"


def test_rules_of_directories_left_behind_are_dropped(tmp_path):
    write(tmp_path, {"a/.gitignore": "x\n", "a/b/.gitignore": "y\n", "c/.gitignore": "z\n"})
    r = Rules(str(tmp_path))
    for where in ("", "a", "a/b"):
        r.enter(where)
    assert set(r.rules) == {"a", "a/b"} and r.ignoring("a/b/y") == ("a/b/.gitignore", "y")
    r.enter("c")
    assert set(r.rules) == {"c"}


# --- conditions on paths


TABLE = [
    (1, "en", "src1"), (10, "en", "src2"), (100, "fr", "src1"), (-1, "de", "src12"), (0, "en/us", "src1"), (7, None, "src1"), (8, "en", None), (None, "en", "src1"), (21, "%2F", "F"),
    (12, "en%2Fus", "src1"), (13, "", "src1"), (2, "2", "en"), (3, "src1", "en"), (1000, "en", "1.txt"), (4, "EN", "SRC1"),
]
WORDS = ["en", "fr", "src1", "src12", "src", "1", "10", "1.txt", "10.txt", ".txt", "txt", "md", "/", "//", "en/src1", "n/s", "/src1/", "src1/1", "en/src1/1.txt", "%2F", "2F", "F", "2", "%", "en%2Fus", "", "-1.txt", "*", "en/*", "en/**", "{en,fr}/src1/*", "e?/src1/*", "en/src[12]/1*.txt", "**/src1/*", "/documents/en/src1/1.txt", "/documents/en", "en/us", "./en/src1", "../documents/en/src1", "01.txt", "1.TXT", "*.txt"]


def test_bounds_lose_no_file(spark):
    """With the conditions on columns and without them: the same files."""
    df = spark.createDataFrame(TABLE, "doc_id long, lang string, source string").withColumn("text", F.lit("x"))
    df.createOrReplaceTempView("bounds_documents")
    path = F.concat_ws("/", S.component(F.col("lang")), S.component(F.col("source")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    layout = inversion.Paths(("lang", "source"), "doc_id", ".txt")
    made = [S.from_table(df.coalesce(1), path, F.col("text"), S.synthetic_time(F.col("doc_id")), "/documents", F.col("doc_id"), layout=x) for x in (layout, None)]
    with_, without = (Engine(spark, c, Options(now=NOW)) for c in made)
    r = random.Random(1)
    leaves = [f"{k}:'{w}'" for k in ("path", "in", "path_exact", "name", "ext") for w in WORDS if w or k in ("path", "ext")]
    leaves += [f"modified:{x}" for x in (">2024-01-01", "<2024-01-02", "2024-01-01", "'=2024-01-01 10:00:00'", ">31d", "<30d", "'>2024-01-01 09:59:59'")]
    queries = leaves + [f"{r.choice(leaves)} {r.choice('&|')} {r.choice(['', '!'])}({r.choice(leaves)} {r.choice('&|')} {r.choice(leaves)})" for _ in range(60)]
    narrowed, seen = 0, 0
    tests = []
    for q in queries:
        a, b = with_.search(q), without.search(q)
        condition = inversion.narrowed(a._metadata(), layout, a.context)
        narrowed += condition is not None
        tests.append((q, a._prefilter(), condition))
    files = made[0].build(df.select("*")).withColumns({c: F.col("file_id") for c in ()})
    both = made[1].build(df).select("file_id", *(F.coalesce(p, F.lit(False)).alias(f"p{k}") for k, (_, p, _) in enumerate(tests)))
    held = df.select(F.col("doc_id").cast("string").alias("file_id"), F.col("lang"), F.col("source"), *(F.coalesce(c if c is not None else F.lit(True), F.lit(False)).alias(f"c{k}") for k, (_, _, c) in enumerate(tests)))
    assert files.count() == len(TABLE)
    matches = {(r["file_id"], i): r for i, r in enumerate(both.collect())}
    for (i, m), h in zip(enumerate(matches.values()), held.collect()):
        assert m["file_id"] == h["file_id"]
        for k, (q, _, _) in enumerate(tests):
            seen += m[f"p{k}"]
            assert h[f"c{k}"] or not m[f"p{k}"], (q, TABLE[i])
    assert narrowed > 100 and seen > 300
    one = with_.search("path_exact:en/src1/1.txt")
    assert [r["file_id"] for r in one.matched.collect()] == ["1"] and rel(without.search("path_exact:en/src1/1.txt").matched) == ["en/src1/1.txt"]


@pytest.mark.parametrize(
    "query, pushed",
    {
        "path_exact:en/src1/21.txt": ("EqualTo(lang,en)", "EqualTo(source,src1)", "EqualTo(doc_id,21)"),
        "in:en/src1": ("EqualTo(lang,en)", "EqualTo(source,src1)"),
        "path:en/*/1*.txt": ("EqualTo(lang,en)",),
        "path:{en,fr}/src[1-3]/**": ("EqualTo(lang,en)", "EqualTo(lang,fr)", "StringStartsWith(source,src)"),
        "in:en/**": ("EqualTo(lang,en)",),
        "name:17.txt": ("EqualTo(doc_id,17)",),
        "modified:>2024-01-03 & contains:the": ("GreaterThan(doc_id,48)",),
        "path:en/src1": ("StringEndsWith(lang,en)", "StringStartsWith(source,src1)"),
    }.items(),
)
def test_conditions_reach_the_scan(spark, query, pushed):
    found = Engine(spark, S.documents(spark, "/root/testdata/sf0.001"), Options(now=NOW)).search(query).matched
    text = found._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert all(p in text for p in pushed), text[:400]


def test_rows_read_fall(spark, tmp_path):
    """Row groups whose statistics rule a query out are not read."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    e = Engine(spark, S.documents(spark, str(tmp_path)), Options(now=NOW))

    def read(search) -> int:
        node = search.matched
        node.collect()
        scans = []
        todo = [node._jdf.queryExecution().executedPlan()]
        while todo:
            p = todo.pop()
            if p.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(p.executedPlan())
            if p.metrics().contains("numOutputRows") and "Scan parquet" in p.nodeName():
                scans.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(k) for k in range(p.children().size())]
        return sum(scans)

    everything = read(e.search("ext:txt"))
    row = df.where("doc_id = 500").first()
    assert read(e.search(f"path_exact:{row['lang']}/{row['source']}/500.txt")) < everything / 4
    assert read(e.search("modified:>2024-01-20 & modified:<2024-01-23")) < everything


def test_a_tree_of_predicates_is_told_as_one():
    layout = inversion.TreePaths()

    class C:
        root, now, zone = "/r", NOW, "UTC"

    assert inversion.narrowed(parse("ext:a | name:b"), layout, C) is None
    assert inversion.narrowed(True, layout, C) is None
    assert inversion.literal_prefixes("a/{b,c[de]}/x*") == ["a/b/x", "a/c"] and inversion.literal_prefixes("a\\*b*") == ["a*b"]
