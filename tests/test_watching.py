"""Figures taken while a search runs, and drift over listings that follow each other."""

from __future__ import annotations

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import stats
from quarry.request import Request, run
from quarry.sources import files as S
from quarry.streaming.drift import SNAPSHOT, drift

FILES = [("a.py", "def f(): pass\n"), ("b.py", "x = f()\n"), ("c.rs", "fn f() {}\n"), ("d.txt", "alpha f\n"), ("e.bin", b"\x00f"), ("g.txt", b"\xff f"), ("k.txt", "private_key f")]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, S.from_rows(spark, FILES))


def test_figures_come_with_the_results(engine):
    s = engine.search("func:f | contains:alpha")
    seen = s.watched()
    assert len(s.results.collect()) == 3
    got = stats.told(seen.get)
    assert got["evaluated_files"] == 7 and (got["binary_files"], got["secret_like_files"], got["loaded_lossy_files"], got["unreadable_files"]) == (1, 1, 1, 0)
    assert got["languages"] == {"py": {"files": 2, "captures": 1, "exhausted": 0}, "rs": {"files": 1, "captures": 1, "exhausted": 0}} and got["files_without_language"] == 4


def test_only_files_that_are_looked_into_count(engine):
    s = engine.search("ext:txt & contains:f")
    seen = s.watched()
    s.matched.collect()
    assert stats.told(seen.get)["evaluated_files"] == 3 and "languages" not in stats.told(seen.get)


def test_figures_of_a_request(engine, spark, tmp_path):
    page = run(engine, Request("func:.", "matches", telemetry=True))
    assert len(page["items"]) == 2 and page["telemetry"]["evaluated_files"] == 7 and page["telemetry"]["languages"]["py"]["captures"] == 1
    late = run(engine, Request("contains:f", telemetry=True, budget=0.0))
    assert late["telemetry"]["deadline_files"] == 7 and late["status"] == "partial"
    assert "telemetry" not in run(engine, Request("contains:f"))
    for name in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / name).write_text("alpha\n")
    e = Engine(spark, S.directory(spark, str(tmp_path)))
    (tmp_path / "a.txt").unlink()
    (tmp_path / "b.txt").write_text("alpha beta\n")
    page = run(e, Request("ext:txt", telemetry=True))
    assert (page["telemetry"]["unreadable_files"], page["telemetry"]["changed_files"]) == (1, 1)
    assert {(x["kind"], os.path.basename(x["path"])) for x in page["diagnostics"]} == {("unreadable", "a.txt"), ("snapshot_drift", "b.txt")}


def listing(spark, where, number: int, files: dict[str, int]) -> None:
    at = datetime(2024, 1, 1, number, tzinfo=timezone.utc)
    rows = [(f"/r/{p}", at, size, 0, False, "-rw-r--r--", None, 1, 2) for p, size in files.items()]
    schema = "resolved_path string, listed_at timestamp, " + ", ".join(f"{n} {k}" for n, k in zip(SNAPSHOT, ("long", "long", "boolean", "string", "string", "long", "long")))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")


def reports(spark, where) -> list[tuple]:
    schema = spark.read.parquet(f"{where}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    q = drift(stream).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((os.path.basename(r["resolved_path"]), r["drift"], r["listed_at"].hour) for r in spark.read.parquet(f"{where}/out").select("resolved_path", "drift", F.col("listed_at")).collect())


def test_drift_of_listings(spark, tmp_path):
    where = str(tmp_path)
    listing(spark, where, 1, {"a": 1, "b": 1, "c": 1})
    listing(spark, where, 2, {"a": 1, "b": 2, "c": 1})
    first = reports(spark, where)
    assert first == [("a", "new", 1), ("b", "changed", 2), ("b", "new", 1), ("c", "new", 1)]
    # The stream starts anew from its checkpoint: what it knew is not new, and what goes is told once.
    listing(spark, where, 3, {"a": 1, "b": 2, "d": 5})
    listing(spark, where, 4, {"a": 9, "b": 2, "d": 5})
    second = [r for r in reports(spark, where) if r not in first]
    assert second == [("a", "changed", 4), ("c", "gone", 2), ("d", "new", 3)]
    listing(spark, where, 5, {"a": 9, "b": 2, "c": 1, "d": 5})
    listing(spark, where, 6, {"a": 9, "b": 2, "c": 1, "d": 5})
    assert [r for r in reports(spark, where) if r not in first + second] == [("c", "new", 5)]
