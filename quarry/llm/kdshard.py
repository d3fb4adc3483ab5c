"""Sharding by k-d tree partitioning at distributed weighted medians.

A document is a point: its language, its source and the logarithm of its size, each as a number of 32 bits. A node that
has to become n shards is cut along its widest dimension so that the two sides weigh as floor(n/2) to ceil(n/2); this goes
on until every leaf is one shard, so that leaves weigh the target bytes. Widths of different dimensions are compared by
rank: the share of all bytes that lies between a node's least and greatest value.

The cut is found by narrowing: every pass sums the weights of ``BINS`` bins of each open node, keeps the bin with the cut
in it and divides it in the next pass, until a window of at most ``MANY`` documents around the cut is left. Points that are
equal in the dimension are told apart by the hash of the text and then of the id, so that a value, or a text, of any
number of copies can be cut through. The window's texts are parted where the weights come nearest to the target, and then
exchanged over the cut until a fraction of a document is missing, so a long document at a cut doesn't make shards uneven.
Copies lie next to each other in the order and stay together within a window, unless they outweigh its longest document.

A pass sends the driver nodes x bins sums, and a cut a window, whatever the size of the table. All passes run over a
narrow table without texts in the shared folder.

Defined results: a null text has no bytes and weighs 16 all the same; a null language, source or id is a value of its
own; equal rows may part only at a cut; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import statistics
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_rows

SHARDS, EXTRA, BINS = 40, 16, 4096
#: Documents of a window at most; and how many on each side of the bin with the cut, if there are bins of so few.
MANY, AROUND = 1024, 64
DIMENSIONS = ("d_lang", "d_source", "d_size")
#: A key is the dimension's value, the text's hash and the id's hash: 32 bits each, cut in this order.
LEVELS, BITS = 3, 32


@dataclass
class Node:
    """The shards from ``first`` on; cut at ``cut``, level by level: points up to it go left, but for ``moved`` ones, which
    are on the other side each."""

    first: int
    shards: int
    dimension: int = 0
    cut: list[int] = field(default_factory=list)
    moved: list[int] = field(default_factory=list)
    #: While the cut is sought: the range of the level's key that holds it, and the weight still to go left.
    low: int = 0
    high: int = 0
    target: float = 0.0


def of_node(nodes: list[Node], shards: int, value) -> Column:
    """A value of the row's node, looked up in a literal array; null for other nodes."""
    by = {n.first: value(n) for n in nodes}
    return F.get(F.array(*(F.lit(by.get(k)).cast("long") for k in range(shards))), F.col("node"))


def keys(nodes: list[Node], shards: int) -> list[Column]:
    return [F.get(F.array(*map(F.col, DIMENSIONS)), of_node(nodes, shards, lambda n: n.dimension).cast("int")), F.col("k1"), F.col("k2")]


def cuts(nodes: list[Node], shards: int) -> list[Column]:
    return [of_node(nodes, shards, lambda n, k=k: n.cut[k] if k < len(n.cut) else None) for k in range(LEVELS)]


def moved_key(key: int, after: int) -> int:
    """Two numbers of 32 bits as a signed one of 64."""
    both = key << 32 | after
    return both - (1 << 64) if both >> 63 else both


def beyond(nodes: list[Node], shards: int) -> Column:
    """Right of the cut of the row's node."""
    out = F.lit(False)
    dimension, text, row = keys(nodes, shards)
    for key, cut in reversed(list(zip((dimension, text, row), cuts(nodes, shards)))):
        out = cut.isNotNull() & ((key > cut) | ((key == cut) & out))
    by = {n.first: n for n in nodes if n.moved}
    if not by:
        return out
    lists = F.array(*(F.array(*map(F.lit, by[k].moved if k in by else [])).cast("array<long>") for k in range(shards)))
    moved = F.array_contains(F.get(lists, F.col("node")), F.shiftleft(text.cast("long"), 32).bitwiseOR(row.cast("long")))
    return out != F.coalesce(moved, F.lit(False))


def narrow(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + EXTRA
    mark = lambda c: F.crc32(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    hash32 = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 32)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        mark(lang_col).alias("d_lang"),
        mark(source_col).alias("d_source"),
        F.floor(F.log2(size.cast("double")) * (1 << 26)).cast("long").alias("d_size"),
        hash32(F.col(text_col)).alias("k1"),
        hash32(F.col(id_col), F.monotonically_increasing_id()).alias("k2"),
        F.lit(0).alias("node"),
    )


def ranks(rows: DataFrame) -> list[dict[int, float]]:
    """For each dimension, the share of all bytes below the middle of each of 4096 bins."""
    values = rows.select("size", F.posexplode(F.array(*map(F.col, DIMENSIONS))).alias("d", "v"))
    out: list[dict[int, float]] = [{} for _ in DIMENSIONS]
    sums = sorted(map(tuple, values.groupBy("d", F.shiftright("v", 20).alias("bin")).agg(F.sum("size")).collect()))
    for d, bins in itertools.groupby(sums, key=lambda r: r[0]):
        below, part = 0, list(bins)
        for _, k, w in part:
            out[d][k] = below + w / 2
            below += w
        out[d] = {k: x / below for k, x in out[d].items()}
    return out


def cut_all(t: Scratch, shards: int) -> Scratch:
    """The narrow table with the column ``node``, which ends as the shard; all nodes of a level are cut together."""
    open_ = [Node(0, shards)] if shards > 1 else []
    rank = ranks(t.df) if open_ else []
    while open_:
        rows = t.df
        spans = rows.groupBy("node").agg(F.sum("size").alias("w"), *(f(d).alias(f"{k}{i}") for i, d in enumerate(DIMENSIONS) for k, f in (("a", F.min), ("z", F.max)))).collect()
        by = {r["node"]: r for r in spans}
        open_ = [n for n in open_ if n.first in by]  # without points there is nothing to cut
        for n in open_:
            r = by[n.first]
            width = [(rank[d][r[f"z{d}"] >> 20] - rank[d][r[f"a{d}"] >> 20], r[f"z{d}"] - r[f"a{d}"], d) for d in range(len(DIMENSIONS))]
            n.dimension = max(width)[2]
            n.low, n.high = r[f"a{n.dimension}"], r[f"z{n.dimension}"] + 1
            n.target = r["w"] * (n.shards // 2) / n.shards
        live, found = open_, []
        while live:
            live = narrowed(rows, live, shards, found)
        if found:
            dealt(rows, found, shards)
        if open_:
            right = of_node(open_, shards, lambda n: n.first + n.shards // 2).cast("int")
            after = Scratch(rows.withColumn("node", F.when(right.isNotNull() & beyond(open_, shards), right).otherwise(F.col("node"))), "points")
            t.drop()
            t = after
        sides = [x for n in open_ for x in (Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2))]
        open_ = [x for x in sides if x.shards > 1]
    return t


def ranged(rows: DataFrame, nodes: list[Node], shards: int) -> DataFrame:
    """The rows between ``low`` and ``high`` of their node's level, with that level's ``key``, and ``low``."""
    chosen, key = F.lit(True), F.lit(None).cast("long")
    low, high = of_node(nodes, shards, lambda n: n.low), of_node(nodes, shards, lambda n: n.high)
    dimension, *_ = columns = keys(nodes, shards)
    for level, (k, cut) in enumerate(zip(columns, cuts(nodes, shards))):
        chosen = chosen & (cut.isNull() | (k == cut))
        key = F.when(of_node(nodes, shards, lambda n: len(n.cut)) == level, k.cast("long")).otherwise(key)
    picked = rows.where(low.isNotNull() & chosen).select("node", "size", dimension.alias("dimension"), "k1", "k2", key.alias("key"), low.alias("low"), high.alias("high"))
    return picked.where("key >= low and key < high")


def narrowed(rows: DataFrame, live: list[Node], shards: int, found: list[Node]) -> list[Node]:
    """One pass: moves every node to the bin in which its cut falls. Returns those whose bin has too many documents; the
    others, with their windows, are added to ``found``."""
    width = of_node(live, shards, lambda n: -(-(n.high - n.low) // BINS))
    binned = ranged(rows, live, shards).withColumn("bin", F.floor((F.col("key") - F.col("low")) / width).cast("long"))
    sums: dict[int, list] = {}
    for r in binned.groupBy("node", "bin").agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key")).collect():
        sums.setdefault(r[0], []).append(tuple(r[1:]))
    still = []
    for n in live:
        got = sorted(sums[n.first])
        k = 0
        while got[k][1] <= n.target and k < len(got) - 1:
            n.target -= got[k][1]
            k += 1
        _, _, points, least, most = got[k]
        if points <= MANY:
            first = last = k
            beside = 0
            while beside < AROUND and last + 1 < len(got) and points + got[last + 1][2] <= MANY:
                last += 1
                beside += got[last][2]
                points += got[last][2]
            beside = 0
            while beside < AROUND and first and points + got[first - 1][2] <= MANY:
                first -= 1
                beside += got[first][2]
                points += got[first][2]
                n.target += got[first][1]
            n.low, n.high = got[first][3], got[last][4] + 1
            found.append(n)
        elif least < most:
            n.low, n.high = least, most + 1
            still.append(n)
        else:
            n.cut.append(least)
            if len(n.cut) < LEVELS:
                n.low, n.high = 0, 1 << BITS
                still.append(n)
    return still


def dealt(rows: DataFrame, found: list[Node], shards: int) -> None:
    """Sets the cuts of nodes with a window, and what is moved over them."""
    windows: dict[int, list] = {n.first: [] for n in found}
    for r in ranged(rows, found, shards).select("node", "dimension", "k1", "k2", "size").collect():
        windows[r[0]].append(tuple(r[1:]))
    for n in found:
        window = sorted(windows[n.first])
        longest, units = max(r[3] for r in window), []
        for _, same in itertools.groupby(window, key=lambda r: r[:2]):
            copies = list(same)
            units += [copies] if sum(r[3] for r in copies) <= longest else [[r] for r in copies]
        left = divided([sum(r[3] for r in unit) for unit in units], n.target, statistics.median(r[3] for r in window) / 8)
        over = [left.count(True)]  # moved units, were the cut before the first, after the first, ...
        for side in left:
            over.append(over[-1] + (-1 if side else 1))
        at = over.index(min(over))
        n.moved = [moved_key(*r[1:3]) for j, unit in enumerate(units) if left[j] != (j < at) for r in unit]
        n.cut = list(units[at - 1][-1][:3]) if at else [*n.cut, n.low - 1]


def pairs(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of none, one or two of the weights, in order, and which two: the place after the last is none."""
    w = np.r_[weights, 0.0]
    a, b = np.triu_indices(len(w), 1)
    a, b = np.r_[a, len(w) - 1], np.r_[b, len(w) - 1]
    order = np.argsort(w[a] + w[b], kind="stable")
    return (w[a] + w[b])[order], a[order], b[order]


def divided(weights: list[int], target: float, slack: float) -> list[bool]:
    """For each weight, in order, whether it goes left, where ``target`` is to be: the first ones that come nearest, then
    as long as more than ``slack`` is missing or too much and it helps, the best exchange of up to two for up to two."""
    w = np.array(weights, np.float64)
    left = np.arange(len(w)) < int(np.argmin(np.abs(np.r_[0, np.cumsum(w)] - target)))
    missing = target - w[left].sum()
    while abs(missing) > slack:
        here, there = np.flatnonzero(left), np.flatnonzero(~left)
        gone, *out = pairs(w[here])
        come, *into = pairs(w[there])
        at = np.searchsorted(come, gone + missing)
        near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(come) - 1)])
        after = np.abs(missing + gone - come[near])
        side, i = np.unravel_index(int(np.argmin(after)), after.shape)
        if after[side, i] >= abs(missing):
            break
        left[[here[x[i]] for x in out if x[i] < len(here)]] = False
        left[[there[x[near[side, i]]] for x in into if x[near[side, i]] < len(there)]] = True
        missing = target - w[left].sum()
    return left.tolist()


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for every document with its shard and its slot in it."""
    t = cut_all(Scratch(narrow(docs, id_col, text_col, lang_col, source_col), "points"), shards).df
    placed = t.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    return number_rows(placed, "shard", None, ["doc_id", "size", "text_crc32", "shard"], "slot", "shards").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
