"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of its tasks, are cut into blocks of about ``block_bytes``. One block is due in each
slot. Block i of a source of weight w is released at slot floor(i / w) and has its deadline at slot ceil((i + 1) / w);
the earliest deadline among the released blocks is served. After t slots a source has got w * t blocks but for less
than one block.

Weights are exact fractions of their sum, so the schedule repeats after as many slots as their common denominator: a
frame. When a source runs out, the others share its part in proportion, from the next slot on: a new phase. The driver
schedules one frame, or what is left if that is less, for each phase, and every row finds its slot in
it. What the driver holds grows with sources times the frame, not with the documents. No document is dropped or
repeated.

Defined results: a null source is a source of its own; a null text has no bytes, and a document's own byte more places
it; a document longer than a block makes the blocks it covers one, so its later slots stay empty; equal rows keep their
places of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, number_rows

BLOCK_BYTES = 64 * 1024
#: Bytes of texts of a partition of the mixed rows, and the fewest where that leaves cores without any.
PART_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
#: Target weights where none are given: a source's bytes to this power, in whole parts of ``PARTS``, one at least. Small
#: sources are then seen more often than in proportion to their size, and large ones less.
POWER, PARTS = 0.5, 10_000


def shares(weights: dict) -> dict:
    """Whole numbers in the exact proportion of the weights, as small as can be; decimals are taken as written."""
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    whole = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * whole) for s, w in exact.items()}
    common = math.gcd(*parts.values())
    return {s: n // common for s, n in parts.items()}


def schedule(parts: dict, horizon: int | None = None) -> dict:
    """Of one frame, or its first ``horizon`` slots: for each source the slots of its blocks, by earliest deadline first
    among the released. Every source has one block at a time in one of two heaps: by release, then by deadline."""
    frame = sum(parts.values())
    names = sorted(parts, key=lambda s: (s is None, str(s)))
    slots: dict = {s: [] for s in names}
    waiting, ready = [(0, n) for n in range(len(names))], []
    heapq.heapify(waiting)
    for t in range(frame if horizon is None else min(frame, horizon)):
        while waiting and waiting[0][0] <= t:
            n = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[names[n]]) + 1) * frame // parts[names[n]]), n))
        n = heapq.heappop(ready)[1]  # full use: a block is always ready, and none is late
        mine = slots[names[n]]
        mine.append(t)
        heapq.heappush(waiting, (len(mine) * frame // parts[names[n]], n))
    return slots


def phases(blocks: dict, weights: dict) -> list[dict]:
    """Each phase: its first slot, the slots of a frame, and source -> (first block, slots in a frame).

    A phase ends at the slot for which a source has no block left."""
    left, done, out, base = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), [], 0
    while left:
        parts = shares({s: weights[s] for s in left})
        frame, frames = sum(parts.values()), min(n // parts[s] for s, n in left.items())
        slots = schedule(parts, None if frames else sum(left.values()))
        rest = {s: n - frames * parts[s] for s, n in left.items()}
        end = min((x[rest[s]] for s, x in slots.items() if rest[s] < len(x)), default=sum(rest.values()))
        out.append({"base": base, "frame": frame, "sources": {s: (done[s], x) for s, x in slots.items()}})
        base += frames * frame + end
        for s, x in slots.items():
            took = frames * parts[s] + bisect_left(x, end)
            left[s] -= took
            done[s] += took
        left = {s: n for s, n in left.items() if n}
    return out


def target_weights(sizes: dict, given: dict | None) -> dict:
    """As given for named sources, the mean of these for others; by size where none are given."""
    if given:
        exact = {s: Fraction(str(w)) for s, w in given.items()}
        mean = sum(exact.values()) / len(exact)
        return {s: exact.get(s, mean) for s in sizes}
    tempered = {s: max(n, 1) ** POWER for s, n in sizes.items()}
    total = sum(tempered[s] for s in sorted(tempered, key=str))
    return {s: max(1, round(PARTS * x / total)) for s, x in tempered.items()}


def frames_of(plan: list[dict]) -> pa.Table:
    """A row for each source and phase in which it is served: its blocks there, and the slots of a frame."""
    rows, last = [], {}
    for p in reversed(plan):
        for s, (first, slots) in p["sources"].items():
            upto = last.get(s, np.iinfo(np.int64).max)
            if first < upto and slots:
                rows.append((s, first, upto, p["base"], p["frame"], slots))
            last[s] = first
    kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["of", "first", "upto", "base", "width", "slots"])


def mix(docs: DataFrame, columns: list[str] | None = None, weights: dict | None = None, block_bytes: int = BLOCK_BYTES, source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, str, str, int]:
    """The rows with ``columns`` and two more: their slot, and their place within the source; returned with the two names
    and the number of slots. Each row finds its slot by a broadcast join, so no text goes through Python for it."""
    columns = columns or docs.columns
    size, source = fresh("size", docs.columns), fresh("mix_source", docs.columns)
    keep = [*columns, size, source]
    start, slot = fresh("place", keep), fresh("slot", keep)
    sized = docs.withColumn(size, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).withColumn(source, F.col(source_col).cast("string"))
    placed = number_rows(sized, source, size, keep, start, "mix")
    totals = {r[0]: r[1] for r in placed.groupBy(source).agg(F.max(start)).collect()}
    blocks = {s: last // block_bytes + 1 for s, last in totals.items()}
    frames = F.broadcast(docs.sparkSession.createDataFrame(frames_of(phases(blocks, target_weights(totals, weights)))))
    block = F.call_function("div", placed[start], F.lit(block_bytes).cast("long"))
    joined = placed.join(frames, placed[source].eqNullSafe(frames["of"]) & (block >= frames["first"]) & (block < frames["upto"]), "left")
    nth, served = block - frames["first"], F.size(frames["slots"]).cast("long")
    at = frames["base"] + F.call_function("div", nth, served) * frames["width"] + F.get(frames["slots"], (nth % served).cast("int"))
    return joined.select(*[placed[c] for c in columns], at.alias(slot), placed[start]), slot, start, sum(blocks.values())


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns, dealt to the partitions, and so to the files written, in the order of the mix.

    Slots are filled evenly, so a partition is a range of slots; nothing has to be sampled for it."""
    mixed, slot, start, slots = mix(docs, **options)
    block = options.get("block_bytes", BLOCK_BYTES)
    each = min(PART_BYTES // block, max(LEAST_BYTES // block, slots // docs.sparkSession.sparkContext.defaultParallelism)) or 1
    part = F.call_function("div", F.col(slot), F.lit(each).cast("long")).cast("int")
    return mixed.repartitionById(-(-slots // each) or 1, part).sortWithinPartitions(slot, start).select(*docs.columns)


def positions(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, slot, place) for every row of documents."""
    mixed, slot, start, _ = mix(docs.select("doc_id", "source", "text"), columns=["doc_id", "source"], **options)
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(slot).alias("slot"), F.col(start).alias("place"))
