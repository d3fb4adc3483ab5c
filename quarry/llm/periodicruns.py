"""Runs of periodic words within texts: stretches whose words repeat at a distance, at least ``exponent`` times over.

Words outside repeated k-grams are masked first. A run of length L and period q shares L - q words with its own copy one
period on, so it is covered by stretches of ``overlap(...)`` words that stand twice in the text, no further than L / exponent
apart; a word in no such k-gram is in no run, nor is a neighbour that would prolong one. Equal k-grams are found for a whole
batch by sorted hashes; a collision can only leave a word unmasked. Segments that remain are searched by the divide and
conquer of Main and Lorentz: runs over a segment's middle follow, for each period, from how far the text agrees with
itself to the left and to the right, which prefix tables tell; what lies on one side is left to that half. Tables are exact,
so are the runs. Time grows with n log n, memory with a batch's words.

A run has its smallest period and can't be prolonged by a neighbouring word. Of each run all words after its first period
are dropped from ``collapsed``, which has the words that stay with one space between them.

Defined results: a null, empty or blank text has no runs and an empty ``collapsed``. Every row counts for itself, repeated
rows and null ids too. Runs may overlap; they come by start, then period. All columns of the table stay; names of new
columns that are taken get an underscore. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_bytes, fresh, utf8

#: Runs of 24 words or more that hold their period three times.
MIN_LENGTH, EXPONENT = 24, 3
#: Bytes of text that are searched at once.
BATCH_BYTES = 4 << 20
#: Rounds in which segments that got shorter are masked again; more would only mask more.
ROUNDS = 6

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def overlap(min_length: int, exponent: int) -> int:
    """The fewest words that a run shares with its copy one period on, over all periods."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place; equal k-grams have equal hashes."""
    h, width = _mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    while width < k:
        step = min(width, k - width)  # two shorter grams cover one of width + step words
        if len(h) <= step:
            return h[:0]
        h, width = _mixed(h[:-step] * np.uint64(3) + h[step:]), width + step
    return h


def nearest_repeat(hashes: np.ndarray) -> np.ndarray:
    """How far the nearest equal hash is; a number beyond all places if there is none."""
    far = np.full(len(hashes), 1 << 62, np.int64)
    order = np.argsort(hashes, kind="stable")
    gap = np.where(hashes[order][1:] == hashes[order][:-1], np.diff(order), 1 << 62)
    far[order[1:]] = gap
    far[order[:-1]] = np.minimum(far[order[:-1]], gap)
    return far


def segments(codes: np.ndarray, sizes: np.ndarray, min_length: int, exponent: int) -> list[tuple[int, int]]:
    """(first word, word past the end) of what repeated k-grams cover, over the words of many texts one after the other."""
    k = overlap(min_length, exponent)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = gram_hashes(codes, k)
    at = np.flatnonzero(owner[: len(h)] == owner[k - 1 : k - 1 + len(h)])  # within one text
    gap = nearest_repeat(h[at] ^ _mixed(owner[at].astype(np.uint64) + np.uint64(1 << 40)))
    gap_of = np.full(len(codes), 1 << 62, np.int64)
    gap_of[at] = gap  # a text's k-grams lie side by side, so their numbers are as far apart as their words
    grams = at[gap_of[at] < 1 << 61]
    out: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        cover = np.zeros(len(codes) + 1, np.int32)
        np.add.at(cover, grams, 1)
        np.add.at(cover, grams + k, -1)
        inside = np.cumsum(cover[:-1]) > 0
        new = inside & ~np.r_[False, inside[:-1] & (owner[1:] == owner[:-1])]
        firsts = np.flatnonzero(new)
        label = np.cumsum(new) - 1
        length = np.bincount(label[inside], minlength=len(firsts))
        out = [(int(a), int(a + n)) for a, n in zip(firsts, length) if n >= min_length]
        room = length[label[grams]] if len(grams) else length
        stay = (room >= min_length) & (gap_of[grams] * exponent <= room)
        if stay.all():
            break
        grams = grams[stay]
    return out


def prefix_table(s: Sequence[int], most: int | None = None) -> list[int]:
    """For each place (the first ``most``), how many words from there agree with those from the start."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n if most is None else min(n, most)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def agreement(pattern: Sequence[int], text: Sequence[int], most: int) -> list[int]:
    """For each of the first ``most`` places of a text, how many words from there agree with a pattern's start."""
    z = prefix_table([*pattern, -1, *text], len(pattern) + 1 + most)
    return z[len(pattern) + 1 : len(pattern) + 1 + most]


def runs(words: Sequence[int], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a sequence of numbers >= 0, by start, then period."""
    w, n = list(words), len(words)
    found: dict[tuple[int, int], int] = {}
    halves = [(0, n)]
    while halves:
        lo, hi = halves.pop()
        if hi - lo < min_length:
            continue
        mid = (lo + hi) // 2
        halves += [(lo, mid), (mid, hi)]
        # A run over the middle holds the period before it or the one after it, and no longer one than a share of both sides.
        most = (hi - lo) // exponent
        left, right = w[lo:mid], w[mid:hi]
        back, ahead = left[::-1], right
        before = min(most, len(left))  # periods that fit before the middle
        after = min(most, len(right))
        ahead_own = prefix_table(ahead, after + 1) + [0]
        back_own = prefix_table(back, before + 1) + [0]
        back_of = agreement(back, w[lo : mid + after][::-1], after)  # place 0: period ``after``
        ahead_of = agreement(ahead, w[mid - before : hi], before)  # place 0: period ``before``
        near = [(mid - back_of[after - p], mid + p + ahead_own[p], p) for p in range(1, after + 1)]
        near += [(mid - p - back_own[p], mid + ahead_of[before - p], p) for p in range(1, before + 1)]
        for a, z, p in near:
            if z - a >= min_length and z - a >= exponent * p and (a == 0 or w[a - 1] != w[a - 1 + p]) and (z == n or w[z] != w[z - p]):
                found[a, z] = min(p, found.get((a, z), p))
    return sorted((a, z - a, p) for (a, z), p in found.items())


def find_in(texts: list[bytes], min_length: int, exponent: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text how many words it has, its runs and what is left of it."""
    words = [t.split() for t in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    codes = pa.array([x for ws in words for x in ws], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = segments(codes, sizes, min_length, exponent)
    owners = np.searchsorted(starts, [a for a, _ in parts], "right") - 1 if parts else []
    for k, (a, z) in zip(owners, parts):
        found[k] += [(int(a - starts[k]) + s, n, p) for s, n, p in runs(codes[a:z].tolist(), min_length, exponent)]
    left = []
    for ws, rs in zip(words, found):
        if rs:
            dropped = np.zeros(len(ws) + 1, np.int64)
            for s, n, p in rs:
                dropped[s + p] += 1
                dropped[s + n] -= 1
            ws = [x for x, gone in zip(ws, np.cumsum(dropped).tolist()) if not gone]
        left.append(b" ".join(ws))
    return sizes, found, left


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Adds ``n_words`` (long), ``runs`` (array of start, length, period) and ``collapsed`` (text) to every row.

    Words are what ASCII white space parts. ``min_length`` and ``exponent``: whole numbers of 2 or more."""
    if min_length < 2 or exponent < 2:
        raise ValueError("min_length and exponent are 2 or more")
    taken = list(docs.columns)
    names = [fresh(x, taken) for x in ("n_words", "runs", "collapsed")]
    kinds = (T.LongType(), T.ArrayType(RUN), T.StringType())
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            texts = utf8(b.column(b.schema.get_field_index("text")))
            sizes, found, left = find_in(texts, min_length, exponent)
            made = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found]
            new = [pa.array(sizes), pa.array(made, _ARROW_RUNS), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
