"""Pages by key, ranges of written rows, budgets that leave files, and sessions."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.capture import extract, profiles
from quarry.engine import Engine
from quarry.execution import setting
from quarry.operators import results as R
from quarry.operators.ranged import Ranged
from quarry.plans.query import QueryError
from quarry.request import Limits, Place, Request, Sessions, place, run
from quarry.sources import files as S

MANY = [(f"d{k % 7}/f{k:03}.txt", f"alpha {k}\nbeta\n" * (k % 4)) for k in range(60)]
NAMES = sorted(p for p, _ in MANY)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, S.from_rows(spark, MANY))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [(f"p{r.randrange(40):02}", k, r.randrange(0, 50)) for k in range(300)]
    return sorted(data), spark.createDataFrame(data, "a string, b int, w int")


def test_ranged_pages(rows):
    data, df = rows
    stored = Ranged(df, ("a", "b"), F.col("w"), 6)
    assert len(stored) == 300 and [tuple(p["first"]) for p in stored.parts] == sorted(tuple(p["first"]) for p in stored.parts) and len(stored.parts) > 1
    key, seen = None, []
    while page := [tuple(r) for r in stored.page(37, key).collect()]:
        seen += page
        key = page[-1][:2]
    assert seen == data
    text = stored.page(5, data[250][:2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part_" in text or "PartitionFilters: [part_" in text or "part_" in text.split("PartitionFilters")[1][:80]
    stored.drop()


@pytest.mark.parametrize("offset, most", [(0, None), (0, 500), (17, 900), (299, 5), (300, None), (120, 0), (5, 10**6)])
def test_running_sums_over_ranges(rows, offset, most):
    data, df = rows
    got = Ranged(df, ("a", "b"), F.col("w"), 6).numbered(offset, most)
    want, total = [], 0
    for k, row in enumerate(data[offset:], offset):
        total += row[2]
        if most is None or k == offset or total <= most:
            want.append((*row, k))
    assert [tuple(r) for r in got.orderBy("position").collect()] == want
    assert "SinglePartition" not in plan(got)


def test_pages_without_a_number_of_results(rows):
    data, df = rows
    whole = R.page(df, None, 0, None, ("a", "b"))
    assert [tuple(r) for r in whole.orderBy("position").collect()] == [(*d, k) for k, d in enumerate(data)]
    assert "SinglePartition" not in plan(whole)
    after = R.page(df, None, 40, 300, ("a", "b"), F.col("w"), key=data[39][:2])
    assert [r["position"] for r in after.orderBy("position").collect()][:3] == [40, 41, 42] and "SinglePartition" not in plan(after)
    assert R.page(df.limit(0), None, 0, None, ("a", "b")).collect() == []


def test_pages_by_key(engine):
    for mode in ("paths", "summary", "matches", "full"):
        seen, token = [], None
        while True:
            page = run(engine, Request("ext:txt", mode, continuation=token, limits=Limits(max_results=13)))
            assert [x["position"] for x in page["items"]] == list(range(len(seen), len(seen) + len(page["items"])))
            seen += [x["display_path"] for x in page["items"]]
            token = page["continuation"]
            if token is None:
                break
        assert seen == NAMES
    lines, token = [], None
    while True:
        page = run(engine, Request("contains:alpha", "snippets", continuation=token, limits=Limits(max_results=10)))
        lines += [(x["display_path"], x["ord"]) for x in page["items"]]
        token = page["continuation"]
        if token is None:
            break
    assert lines == sorted((p, k) for p, t in MANY for k in range(t.count("alpha")))


def test_a_page_by_key_takes_no_more_rows_than_the_first(engine):
    """No row before the key is kept, sorted or numbered."""
    found = engine.search("ext:txt").matched
    first, far = (plan(R.page(found, 11, offset, None, key=key)) for offset, key in ((0, None), (9000, (NAMES[40], "/made/" + NAMES[40]))))
    assert "TakeOrderedAndProject(limit=11" in first.replace("TakeOrderedAndProject(limit=11,", "TakeOrderedAndProject(limit=11,") and "limit=11" in far and "limit=90" not in far
    assert "GreaterThanOrEqual(" in far or ">= " in far


def test_tokens():
    for p in (Place(5), Place(7, ("a/ü.txt", "/r/a/ü.txt")), Place(9, ("a", "b", 3))):
        assert place(p.token) == p
    for bad in ("x", "offset:-1", "offset:", "after:", "after:e30=", "after:WzFd", "after:!!", "after:WyJhIiwiYiIsImMiXQ=="):
        with pytest.raises(QueryError):
            place(bad)


def test_bytes_cut_a_page_without_a_second_search(engine):
    page = run(engine, Request("ext:txt", "summary", limits=Limits(max_results=50, max_total_bytes=1000)))
    assert page["truncation_reason"] == "max_total_bytes" and 1 < len(page["items"]) < 50
    rest = run(engine, Request("ext:txt", "summary", continuation=page["continuation"], limits=Limits(max_results=None, max_total_bytes=None)))
    assert [x["display_path"] for x in page["items"] + rest["items"]] == NAMES and not rest["truncated"]
    some = run(engine, Request("ext:txt", "summary", limits=Limits(max_results=None, max_total_bytes=1000)))
    assert [x["display_path"] for x in some["items"]] == [x["display_path"] for x in page["items"]] and some["truncation_reason"] == "max_total_bytes"


def test_every_mode_shows_the_path_asked_for(engine):
    for mode in ("paths", "summary", "matches", "snippets", "full"):
        for shown, want in (("relative", "d1/f001.txt"), ("absolute", "/made/d1/f001.txt"), ("root_relative", "d1/f001.txt")):
            (item,) = run(engine, Request("name:f001.txt & contains:beta", mode, path_display=shown))["items"]
            assert item["path"] == want and item["resolved_path"] == "/made/d1/f001.txt", (mode, shown)


def test_snippets_of_held_files(spark):
    e = Engine(spark, S.from_rows(spark, [("a.txt", b"\x00alpha"), ("b.txt", "alpha")]))
    page = run(e, Request("!contains:zzz", "snippets"))
    assert [(x["display_path"], x["ord"], x["text"]) for x in page["items"]] == [("a.txt", -1, None)] and page["status"] == "policy_suppressed"
    assert [x["kind"] for x in page["diagnostics"]] == ["binary"]
    assert run(e, Request("contains:alpha", "snippets"))["status"] == "full"


# --- budgets


def test_a_budget_that_is_not_used_up_changes_nothing(engine):
    for mode in ("paths", "summary", "snippets"):
        a, b = (run(engine, Request("contains:alpha", mode, budget=x)) for x in (None, 600))
        assert a["items"] == b["items"] and a["status"] == b["status"] and not b["diagnostics"]
    assert run(engine, Request("contains:alpha", execution="agent"))["items"] == run(engine, Request("contains:alpha"))["items"]


@pytest.mark.parametrize("query", ["contains:alpha", "!contains:alpha", "contains:alpha | func:x"])
def test_files_beyond_the_budget_are_errors(engine, query):
    for mode in ("paths", "summary", "matches", "full"):
        page = run(engine, Request(query, mode, budget=0.0, limits=Limits(max_errors=4)))
        assert page["items"] == [] and page["status"] == "partial"
        assert [(x["kind"], x["path"]) for x in page["diagnostics"]] == [("deadline", p) for p in NAMES[:4]] and page["errors_left_out"] == 56


def test_what_was_done_in_time_is_returned(spark):
    """Two files are looked into before the deadline, whose clock stands in the rows here; the rest is told."""
    from quarry.operators import lowering  # noqa: F401
    from quarry.sources.policy import LEFT, gated

    files = S.from_rows(spark, MANY[:6]).files
    got = gated(files, late=F.col("display_path") > "d2").select("display_path", "content_state", "text").collect()
    assert {r["display_path"] for r in got if r["content_state"] == LEFT} == {p for p, _ in MANY[:6] if p > "d2"}
    assert all(r["text"] == "" for r in got if r["content_state"] == LEFT) and any(r["text"] for r in got)


def test_a_directory_read_against_the_clock(spark, tmp_path):
    for p, t in MANY[:5]:
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    e = Engine(spark, S.directory(spark, str(tmp_path)))
    page = run(e, Request("contains:alpha", budget=0.0))
    assert page["status"] == "partial" and len(page["diagnostics"]) == 5 and {x["kind"] for x in page["diagnostics"]} == {"deadline"}
    assert len(run(e, Request("contains:alpha", budget=300.0))["items"]) == 3


def test_captures_have_a_budget_for_each_file(monkeypatch):
    text = "def f(): pass\n" * 50
    clock = extract.Clock(0.0)
    time.sleep(0.001)
    assert profiles.extract(profiles.find_profile("py"), text, ("func",), clock) == [] and clock.over
    left = iter([False, False, False, True])
    assert len(profiles.extract(profiles.find_profile("py"), text, ("func",), lambda: next(left))) == 3


def test_an_exhausted_file_says_so(spark):
    e = Engine(spark, S.from_rows(spark, [("a.py", "def f(): pass\n"), ("b.py", "x = 1\n")]))
    got = {r["name"]: r["skip_reasons"] for r in e.search("func:. | name:*", semantic_budget=0.0).results.collect()}
    assert got["a.py"] == ["budget_exhausted"]
    assert all(r["skip_reasons"] == [] for r in e.search("func:. | name:*", semantic_budget=60.0).results.collect())


# --- sessions


def test_later_pages_run_no_search(engine, monkeypatch):
    s = Sessions(engine)
    page = s.start(Request("contains:alpha", "matches", limits=Limits(max_results=20)))
    monkeypatch.setattr(Engine, "search", lambda *a, **k: pytest.fail("a search"))
    seen = [x["display_path"] for x in page["items"]]
    while page["continuation"]:
        page = s.next(page["continuation"])
        seen += [x["display_path"] for x in page["items"]]
    assert seen == sorted(p for p, t in MANY if t) and not s.open


def test_settings_of_the_environment(engine, monkeypatch):
    monkeypatch.setenv("QUARRY_SESSION_TTL", "7.5")
    monkeypatch.setenv("QUARRY_SESSIONS", "3")
    assert (Sessions(engine).ttl, Sessions(engine).most, Sessions(engine, 1.0).ttl) == (7.5, 3, 1.0)
    monkeypatch.setenv("QUARRY_STREAMS", "many")
    with pytest.raises(ValueError, match="QUARRY_STREAMS"):
        setting("QUARRY_STREAMS", 4)


def test_texts_of_a_page_are_bounded(engine, monkeypatch):
    from quarry.operators import formats

    monkeypatch.setattr(formats, "DRIVER_BYTES", 100)
    text = formats.render(engine.search("contains:alpha"), "cat", 1000)
    names = sorted(p for p, t in MANY if t)
    assert text.endswith("--offset 3") and [x for x in text.splitlines() if x.startswith("alpha")] == [x for p in names[:3] for x in dict(MANY)[p].splitlines() if x.startswith("alpha")]
    whole = formats.render(engine.search("contains:alpha"), "cat", 2)
    assert "--offset" not in whole
