"""Iterators, streams, cancellation and budgets."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quarry.execution import Cancelled, Stream, Token, rows, within


def slow(spark):
    @F.pandas_udf("long")
    def wait(x):
        time.sleep(60)
        return x

    return spark.range(4, numPartitions=1).select(wait("id"))


def test_rows_and_stream(spark):
    df = spark.range(500, numPartitions=5)
    assert [r[0] for r in rows(df)] == list(range(500))
    events = []
    with Stream(df, capacity=10, progress=events.append) as stream:
        assert [r[0] for r in stream] == list(range(500))
    assert events[0] == {"kind": "started"} and events[-1]["kind"] == "finished" and events[-1]["count"] == 500


def test_a_reader_may_stop_early(spark):
    with Stream(spark.range(100_000, numPartitions=4), capacity=5) as stream:
        assert next(iter(stream))[0] == 0
    stream._thread.join(20)
    assert not stream._thread.is_alive()


def test_budget_and_cancellation(spark):
    assert within(spark, 30, spark.range(7).count) == 7
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        within(spark, 1.0, slow(spark).collect)
    assert time.monotonic() - began < 30
    token = Token(spark)
    token.cancel()
    with pytest.raises(Cancelled):
        within(spark, None, spark.range(7).count, token)
    spark.sparkContext.setJobGroup("tests", "tests")


def test_errors_reach_the_reader(spark):
    with pytest.raises(Exception, match="boom"):
        list(Stream(spark.range(3).select(F.raise_error(F.lit("boom")))))
