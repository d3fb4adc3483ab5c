"""Rows written once in order, so that pages and running sums need neither the query nor one task for all rows.

The rows are dealt out by ranges of their order and sorted within them; each range is a folder of its own, and a row for
each range says how many rows and bytes it has and where it begins and ends. A page reads the ranges that it lies in.
Numbers and sums over all rows are those within a range plus the totals of the ranges before it.

The query itself runs once: ranges are found by reading rows twice, so the rows are written as they come before.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.execution import remove, scratch_dir

PART, BYTES = "part_", "bytes_"


def after(order: tuple[str, ...], key: tuple) -> Column:
    """Rows that come after a key. The first column is compared by itself, too, which statistics of files can be held against."""
    later = F.struct(*order) > F.struct(*(F.lit(k).alias(c) for c, k in zip(order, key)))
    return (F.col(order[0]) >= F.lit(key[0])) & later


class Ranged:
    """``items`` ordered by ``order``, whose columns are never null; ``size``: what a row counts with; ``ranges``: how many
    there are at most (None: as Spark deals by bytes)."""

    def __init__(self, items: DataFrame, order: tuple[str, ...], size: Column, ranges: int | None = None):
        self.spark, self.order, self.columns = items.sparkSession, order, items.columns
        self.path = f"{scratch_dir(self.spark)}/quarry-ranged-{uuid.uuid4().hex}"
        raw = f"{self.path}-raw"
        sized = items.withColumn(BYTES, size.cast("long"))
        sized.write.option("compression", "zstd").parquet(raw)
        made = self.spark.read.schema(sized.schema).parquet(raw)
        dealt = made.repartitionByRange(*(() if ranges is None else (ranges,)), *order).withColumn(PART, F.spark_partition_id())
        dealt.sortWithinPartitions(PART, *order).write.partitionBy(PART).option("compression", "zstd").parquet(self.path)
        self.rows = self.spark.read.schema(dealt.schema).option("basePath", self.path).parquet(self.path)
        remove(self.spark, raw)
        atexit.register(self.drop)
        ends = F.struct(*order)
        totals = self.rows.groupBy(PART).agg(F.count("*").alias("n"), F.coalesce(F.sum(BYTES), F.lit(0)).alias("bytes"), F.min(ends).alias("first"), F.max(ends).alias("last"))
        #: One row for each range; there are no more of them than a shuffle has partitions.
        self.parts = sorted(totals.collect(), key=lambda r: tuple(r["first"]))

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            remove(self.spark, self.path)

    def __len__(self) -> int:
        return sum(p["n"] for p in self.parts)

    def _of(self, parts: list) -> DataFrame:
        return self.rows.where(F.col(PART).isin([p[PART] for p in parts])) if parts else self.rows.where("false")

    def page(self, max_results: int, key: tuple | None = None) -> DataFrame:
        """The rows after a key, in order, at most so many; from the ranges that they are in, and no others."""
        first = 0 if key is None else next((k for k, p in enumerate(self.parts) if tuple(p["last"]) > tuple(key)), len(self.parts))
        rows, taken = 0, []
        for p in self.parts[first:]:
            taken.append(p)
            rows += p["n"] if key is None or tuple(p["first"]) > tuple(key) else 0
            if rows >= max_results:
                break
        found = self._of(taken)
        return (found if key is None else found.where(after(self.order, key))).orderBy(*self.order).limit(max_results).drop(PART, BYTES)

    def numbered(self, offset: int = 0, max_bytes: int | None = None) -> DataFrame:
        """All rows from an offset on with their ``position``, as long as their bytes together stay within ``max_bytes``; the
        first one is always there."""
        starts = [0, *accumulate(p["n"] for p in self.parts)]
        sums = [0, *accumulate(p["bytes"] for p in self.parts)]
        begin = max(0, bisect_right(starts, offset) - 1)
        parts = [(p, n, b) for p, n, b in zip(self.parts, starts, sums)][begin:]
        before = 0 if max_bytes is None else sums[begin] + self._skipped(begin, offset)
        if max_bytes is not None:  # ranges that begin beyond the budget are not read
            parts = [(p, n, b) for p, n, b in parts if n <= offset or b - before <= max_bytes]
        inside = Window.partitionBy(PART).orderBy(*self.order)
        base = F.create_map(*(F.lit(x) for p, n, _ in parts for x in (p[PART], n))) if parts else None
        found = self._of([p for p, _, _ in parts])
        if base is None:
            return found.withColumn("position", F.lit(0)).drop(PART, BYTES)
        out = found.withColumn("position", (F.row_number().over(inside) - 1 + base[F.col(PART)]).cast("int"))
        if max_bytes is not None:
            total = F.create_map(*(F.lit(x) for p, _, b in parts for x in (p[PART], b)))
            out = out.withColumn("total_", F.sum(BYTES).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + total[F.col(PART)] - F.lit(before))
            out = out.where((F.col("position") == offset) | (F.col("total_") <= max_bytes)).drop("total_")
        return out.where(F.col("position") >= offset).drop(PART, BYTES)

    def _skipped(self, part: int, offset: int) -> int:
        """The bytes of a range's rows before an offset."""
        before = offset - sum(p["n"] for p in self.parts[:part])
        if before <= 0 or part >= len(self.parts):
            return 0
        rows = self._of([self.parts[part]]).orderBy(*self.order).limit(before)
        return rows.agg(F.coalesce(F.sum(BYTES), F.lit(0))).first()[0]
