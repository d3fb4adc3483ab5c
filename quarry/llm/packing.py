"""Best-fit packing by exact complements.

Only the lengths of the pieces decide the packing, and there are at most ``capacity`` lengths, so the driver packs a
histogram. The longest length left opens a sequence; the gap is filled exactly by one length, a pair or a triple that
sums to it, under the counts that are left, as often as they allow. What no combination fills exactly is filled best:
with the lengths that leave the least room. The plan gives, for each length, runs of sequences; every piece finds its sequence from
its number among the pieces of its length. The plan's size depends on the capacity, not on the documents.

Rows that stand in an order, as a mix of sources, are packed in windows of ``WINDOW`` tokens of it (``pack_in_order``):
each window by its own histogram, and the numbers of sequences ascend with the order.

Defined results: a null or empty text is its end id alone; equal and repeated rows are packed one by one; an empty table
gives no rows; a null id is carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small, strings, task
from .tokenizing import encoder

CAPACITY, END = 2048, 0
#: Tokens of an order that are packed together: 2,048 whole sequences.
WINDOW = 1 << 22


class Sums:
    """Which lengths are left, as the bits of two integers, one of them mirrored, so that a sum is one shift and one and."""

    def __init__(self, counts: list[int]):
        self.counts, self.top = counts, len(counts) - 1
        self.has = sum(1 << n for n, c in enumerate(counts) if c)
        self.mirror = sum(1 << self.top - n for n, c in enumerate(counts) if c)

    def take(self, n: int, times: int) -> None:
        self.counts[n] -= times
        if not self.counts[n]:
            self.has &= ~(1 << n)
            self.mirror &= ~(1 << self.top - n)

    def give(self, n: int) -> None:
        self.counts[n] += 1
        self.has |= 1 << n
        self.mirror |= 1 << self.top - n

    def use(self, whole: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """Takes the combination as often as the counts allow."""
        times = min(self.counts[x] // whole.count(x) for x in set(whole))
        for x in set(whole):
            self.take(x, times * whole.count(x))
        return whole, times

    def around(self, n: int, capacity: int, exact: bool) -> tuple[int, ...] | None:
        """A sequence that the length n opens: filled exactly by up to three others, or else best.

        Best: the longest that fits goes in while three such don't reach the end, then the one, two or three that leave
        the least."""
        whole, gap = [n], capacity - n
        self.take(n, 1)
        if exact:
            found = self.fill(gap) if gap else ()
            self.give(n)
            return None if found is None else (n, *found)
        while fits := self.has & ((1 << gap + 1) - 1):
            longest = fits.bit_length() - 1
            if 3 * longest < gap:
                found: tuple[int, ...] | None = (longest,)
            else:
                found = next(x for g in range(gap, 0, -1) if (x := self.fill(g)))
            for x in found:
                self.take(x, 1)
            whole += found
            gap -= sum(found)
        for x in whole:
            self.give(x)
        return tuple(whole)

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths left that sum to the gap, the longer as long as can be."""
        both = self.has & (self.mirror >> self.top - gap if gap <= self.top else self.mirror << gap - self.top)
        both &= (1 << gap) - 2
        while both:
            a = both.bit_length() - 1
            if 2 * a < gap:
                return None
            if 2 * a > gap or self.counts[a] > 1:
                return a, gap - a
            both ^= 1 << a
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that fill the gap exactly."""
        if self.counts[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        rest = self.has & ((1 << gap - 1) - 1)
        while rest:
            a = rest.bit_length() - 1
            rest ^= 1 << a
            if 3 * a < gap:
                return None
            self.counts[a] -= 1
            if not self.counts[a]:
                self.has ^= 1 << a
                self.mirror ^= 1 << self.top - a
            found = self.pair(gap - a)
            if not self.counts[a]:
                self.has |= 1 << a
                self.mirror |= 1 << self.top - a
            self.counts[a] += 1
            if found:
                return (a, *found)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): that many sequences of these lengths. All pieces of the histogram, once each.

    Lengths over half the capacity never share a sequence, so their gaps are filled first: exactly while combinations
    last, then as tightly as can be. The shorter ones that are left open sequences of their own in the same way.
    """
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        out.append(((capacity,), counts[capacity]))
        counts[capacity] = 0
    sums, half = Sums(counts), capacity // 2
    for n in range(capacity - 1, half, -1):
        while counts[n] and (whole := sums.around(n, capacity, exact=True)):
            out.append(sums.use(whole))
    for n in range(capacity - 1, 0, -1):
        while n <= half and counts[n] and (whole := sums.around(n, capacity, exact=True)):
            out.append(sums.use(whole))
        while counts[n]:
            out.append(sums.use(sums.around(n, capacity, exact=False)))
    return out


def runs(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, in the order of its pieces: first piece's number, sequence and offset of each run."""
    rows, used, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def place(p: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these numbers among those of their length."""
    wide = 1 << 50
    at = np.searchsorted(p["length"] * wide + p["first"], length * wide + number, "right") - 1
    return p["sequence"][at] + number - p["first"][at], p["offset"][at]


PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, lane long, nth long"


def cut(docs: list, texts: list[str], e, capacity: int) -> Iterator[tuple]:
    """Of each document in turn: its row, its id, and number, start and ids of each piece."""
    for k, (doc, ids) in enumerate(zip(docs, e.encode(texts))):
        ids = np.append(np.frombuffer(ids, e.dtype), np.array(END, e.dtype)).astype("<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            yield k, doc, piece, start, ids[start : start + capacity]


def pieces(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, joined_space: bool = False) -> DataFrame:
    """The pieces of every document, numbered within their task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, lane, seen = encoder(file, joined_space), task(), [0] * (capacity + 1)
        for b in small(batches):
            rows = []
            for _, doc, piece, start, part in cut(b.column(0).to_pylist(), strings(b.column(1)), e, capacity):
                rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), lane, seen[len(part)]))
                seen[len(part)] += 1
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for every piece with its sequence and its offset in it."""
    written = materialise(pieces(docs, file, id_col, text_col, capacity), "pieces")
    lanes = written.groupBy("length", "lane").agg(F.count("*").alias("n"))
    lanes = lanes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("lane")) - F.col("n")).select("length", "lane", "base")
    lanes = materialise(lanes, "lanes")
    histogram = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(runs(plan(histogram, capacity), capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            doc, piece, start, length, crc, number = b.columns
            sequence, offset = place(shared.value, length.to_numpy(), number.to_numpy())
            yield pa.RecordBatch.from_arrays([doc, piece.cast(pa.int32()), start, length, crc, pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    numbered = written.join(lanes, ["length", "lane"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("number"))
    return numbered.mapInArrow(run, SCHEMA)


ORDERED = "doc_id long, piece long, start long, length long, ids_crc32 long, file string, lane long, before long"


def lanes_of(docs: DataFrame) -> tuple[Column, Column]:
    """Two columns whose order is that of the rows, but for the rows that they are equal for. Spark reads files by size, so
    for a table of files these are the file, which is named by its number, and the start of the split; else the partition."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
            docs.select(file, start)
            return file, start
        except AnalysisException:  # a table that is not of files
            pass
    return F.lit(""), F.spark_partition_id()


def pack_in_order(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """As ``pack``, but a sequence holds pieces of one window of the rows' order only, and the numbers of sequences ascend
    with it: by windows, and within them by the first of their pieces. Numbers of windows are ``window`` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen = encoder(file, False), {}
        for b in small(batches):
            rows, lanes = [], list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            for k, doc, piece, start, part in cut(b.column(0).to_pylist(), strings(b.column(1)), e, capacity):
                before = seen.get(lanes[k], 0)
                rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), *lanes[k], before))
                seen[lanes[k]] = before + len(part)
            types = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=[x.split()[0] for x in ORDERED.split(", ")])

    name, lane = lanes_of(docs)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), name.alias("file"), lane.cast("long").alias("lane"))
    written = materialise(slim.mapInArrow(run, ORDERED), "pieces")
    totals = sorted(tuple(r) for r in written.groupBy("file", "lane").agg(F.sum("length").alias("n")).collect())
    bases = {(f, k): base for (f, k, _), base in zip(totals, accumulate((n for *_, n in totals), initial=0))}
    shared = docs.sparkSession.sparkContext.broadcast(bases)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            *columns, files, lanes, before = b.columns
            base = np.array([shared.value[x] for x in zip(files.to_pylist(), lanes.to_pylist())], np.int64)
            at = base + before.to_numpy()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(at // window)], names=[*b.schema.names[:5], "at", "window"])

    def packed(t: pa.Table) -> pa.Table:
        length, at = t["length"].to_numpy(), t["at"].to_numpy()
        lengths, counts = np.unique(length, return_counts=True)
        number = np.empty(len(at), np.int64)
        number[np.lexsort((at, length))] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        sequence, offset = place(runs(plan(dict(zip(lengths.tolist(), counts.tolist())), capacity), capacity), length, number)
        first = np.full(sequence.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, at)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        columns = [t["doc_id"], t["piece"].cast(pa.int32()), *(t[c] for c in ("start", "length", "ids_crc32")), t["window"].to_numpy() * window + rank[sequence], offset]
        return pa.table(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return written.mapInArrow(numbered, "doc_id long, piece long, start long, length long, ids_crc32 long, at long, window long").groupBy("window").applyInArrow(packed, SCHEMA)
