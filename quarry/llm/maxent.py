"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

    log P(token) = log P(class | features) + log P(token | class, features)

Features are the word before (bigram), the word two before (skip) and both (trigram). The ``HEAD`` most frequent tokens
of the training texts are outcomes of their own and fall into classes of about equal square-root frequency; all others
are the last class, within which each has its add-half share of the counts, and one share stands for unknown tokens.
So P is a distribution over the training vocabulary and one unknown token.

The first softmax has a weight for each bigram or skip row and class, and for each trigram that was seen with the class;
the second one for each bigram and trigram that was seen with the token. A weight that isn't there is zero, so a
normaliser is a sum over shares, corrected by the few outcomes that the context has weights for.

Tokens are shuffled once, to blocks by the word before; all that a bigram or a trigram row of weights depends on is then
in one block, and the rows grow with the training texts. The number of blocks grows with the tokens, so tasks send on
shelves of up to ``SHELF`` blocks and many tokens at once, and blocks are made where a shelf arrives. A fit takes ``STEPS`` gradient steps on the likelihood of a
block's tokens, less a Gaussian prior, each step scaled by its weight's curvature. Weights of the skip feature are shared
by all blocks: each round sums their gradient over the next share of the blocks, the driver takes the step, and rounds go
on until a step has not raised the likelihood of a sixteenth of the training documents, which is kept out of the rounds.
The last fit, of all blocks, takes these in. Words in over ``HEAVY`` tokens have their rows divided by a hash of the word before them, and pairs of words
that may be in over ``HEAVY_PAIR`` tokens by document, so that no block holds more than its share.

Token counts are exact over all training texts; those of the head are broadcast, all others are joined.

Defined results: a null or empty text, or one of white space, is its end token alone; a null id is no id of a held-out
document; equal rows are scored each; without any training token every count is zero and all tokens are unknown.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, task, utf8

HEAD, CLASSES, SKIP_ROWS = 1 << 17, 16, 1 << 10
BLOCK_TOKENS, HEAVY, HEAVY_PAIR = 1 << 19, 1 << 17, 1 << 21
#: Rounds at most, what a round has to gain (share of the likelihood), steps of a block in a round, and the part of a
#: step that is taken, as several features of a token move at once.
ROUNDS, GAIN, STEPS, RATE = 4, 1e-3, 4, 0.7
#: Inverse variances of the priors.
SKIP_PRIOR, CLASS_PRIORS, MEMBER_PRIORS = 20.0, (2.0, 1.0), (0.5, 0.25)
KEPT_OUT = 16
END = b""
#: Ids: ranks of the head, a mark for the text's start, hashes of all others above.
START, TAIL = np.uint32(0x7FFFFFFF), 0x80000000
#: Bytes of texts handled at once, and distinct tokens a task holds before it hands them on.
STEP, HELD = 1 << 21, 400_000
WIDE = np.int64(1 << 18)
#: Tokens that a task sorts and sends on at once, blocks of a shelf at most, and shelves there are at least, if blocks do.
GATHER, SHELF, SHELVES = 1 << 20, 8, 64
#: Contexts handled at once where all classes of them are; bigram rows of more than ``MANY`` contexts meet all skip rows,
#: ``ROWS`` of them at once.
PART, MANY, ROWS = 1 << 11, 32, 1 << 8


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def steps(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in groups of about ``STEP`` bytes."""
    group, n = [], 0
    for k, data in enumerate(texts):
        group.append(data)
        n += len(data)
        if n >= STEP or k == len(texts) - 1:
            yield group
            group, n = [], 0


def tokens_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the texts, and how many each has: lower-cased in A-Z; words end at space and U+0009 to U+000D; then
    the end token. No token is an object of its own."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    space = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, length = edges[::2], edges[1::2] - edges[::2]
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    sizes = np.diff(ends, prepend=0) + 1
    word = np.ones(len(starts) + len(texts), bool)
    word[np.cumsum(sizes) - 1] = False
    offsets = np.zeros(len(word) + 1, np.int32)
    offsets[1:][word] = length
    np.cumsum(offsets, out=offsets)
    return pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]), sizes


def contexts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the one before that, within each text."""
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    sizes = np.asarray(sizes)
    first = np.cumsum(sizes) - sizes
    one[first] = two[first] = START
    two[first[sizes > 1] + 1] = START
    return one, two


def hashed(*columns: np.ndarray) -> np.ndarray:
    out = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for b in small(batches):
            for data in utf8(b.column(0)):
                words.update(data.lower().split())
            words[END] += b.num_rows
            if len(words) > HELD:
                yield out()
                words.clear()
        if words:
            yield out()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(words: DataFrame, most: int) -> dict[bytes, int]:
    """Tokens by falling count, as many whole bins of the counts' logarithms as hold at most ``most``.

    The driver sees the bins, about a thousand at most, and then that many tokens; no task gathers or sorts the table.
    """
    size = F.floor(F.log2(F.col("c").cast("double")) * 32)
    least, n = None, 0
    for r in sorted(words.groupBy(size.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["bin"]):
        n += r["n"]
        if n > most:
            break
        least = r["least"]
    if least is None:
        return {}
    top = words.where(F.col("c") >= least).toArrow()
    return dict(sorted(zip(top["word"].to_pylist(), top["c"].to_pylist()), key=lambda x: (-x[1], x[0])))


class Vocabulary:
    """The head's counts and classes, and the shares that the model starts from."""

    def __init__(self, counts: np.ndarray, total: int, distinct: int):
        self.counts, self.n = counts, len(counts)
        root = np.cumsum(np.sqrt(counts))
        self.cls = np.minimum((root / (root[-1] if self.n else 1) * (CLASSES - 1)).astype(np.int64), CLASSES - 2)
        mass = np.bincount(self.cls, counts + 0.5, CLASSES).astype(np.float64)
        mass[-1] = self.tail = total - int(counts.sum()) + 0.5 * (distinct - self.n + 1)
        with np.errstate(divide="ignore"):  # a class without tokens
            self.bias = np.log(mass / mass.sum())
        self.share = (counts + 0.5) / np.maximum(mass[self.cls], 0.5)
        #: The tail's tokens are one outcome here.
        self.cls = np.r_[self.cls, CLASSES - 1]
        self.share = np.r_[self.share, 1.0]


def packed(base: int, one: np.ndarray, two: np.ndarray, code: np.ndarray, row: np.ndarray, times: np.ndarray) -> bytes:
    """By planes of bytes, most of which are zeros or repeat; ``one`` is sorted, so it is kept as differences."""
    one = np.diff(one.astype("<u4"), prepend=np.uint32(0))
    raw = b"".join((x >> np.uint32(k)).astype(np.uint8).tobytes() for x in (y.astype("<u4") for y in (one, two, code, row, times)) for k in (0, 8, 16, 24))
    return np.array([base, len(one)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def planes(blob: bytes) -> tuple[np.ndarray, ...]:
    """one, two, code, row, times of a blob, in its order."""
    base, n = np.frombuffer(blob, "<i8", 2).tolist()
    raw = np.frombuffer(pa.decompress(blob[16:], 20 * n, codec="zstd", asbytes=True), np.uint8).reshape(5, 4, n)
    x = raw[:, 3].astype(np.uint32)
    for k in (2, 1, 0):
        x <<= np.uint32(8)
        x |= raw[:, k]
    return np.cumsum(x[0], dtype=np.uint32), *x[1:3], x[3].astype(np.int64) + base, x[4]


def ordered(key: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers below ``most``: with their places beside them they are sorted as they are, where both fit."""
    wide = len(key).bit_length()
    if most << wide >= 1 << 64:
        return np.argsort(key, kind="stable")
    both = key.astype(np.uint64) << np.uint64(wide)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << wide) - 1)
    return both.view(np.int64)


def in_order(one: np.ndarray, two: np.ndarray, code: np.ndarray, row: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by the first three. Arrays put together from sorted ones are merged."""
    out = one, two, code, row, times
    key = one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64)
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, out = key[order], tuple(x[order] for x in out)
    key = np.cumsum(np.diff(key, prepend=key[:1]) != 0) * (4 * WIDE) + out[2]
    if (key[1:] < key[:-1]).any():
        order = ordered(key, int(key.max()) + 1)
        out = tuple(x[order] for x in out)
    return out


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """one, two, code, row, times of all blobs, sorted by the first three."""
    return in_order(*(planes(blobs[0]) if len(blobs) == 1 else (np.concatenate(c) for c in zip(*map(planes, blobs)))))


def narrowed(two: np.ndarray) -> np.ndarray:
    """Frequent words have skip rows and trigram rows of their own; others share 16 bits, per word before."""
    own = SKIP_ROWS - 1
    return np.where(two < own, two, own + (hashed(two) % np.uint64((1 << 16) - own)).astype(np.int64))


def cells(one: np.ndarray, two: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of all that must be in one block together. ``a``, ``b``: how often ``one`` and ``two`` are."""
    pair, apart = np.minimum(a, b) // HEAVY_PAIR, np.zeros(len(one), np.int64)
    heavy = np.flatnonzero(pair)
    apart[heavy] = rows[heavy] % (pair[heavy] + 1)
    return hashed(one, np.where(a > HEAVY, two, 0), apart)


class Contexts:
    """Contexts, in the order of their bigram rows, and sums over them. It costs less to multiply a bigram row with all
    skip rows than to pick those of more than ``MANY`` contexts."""

    def __init__(self, g: np.ndarray, s: np.ndarray, n_g: int):
        self.n, self.n_g = len(g), n_g
        per = np.bincount(g, minlength=n_g)
        many = per > MANY
        self.many, self.ends = np.flatnonzero(many), np.cumsum(np.r_[0, per[many]])
        among = many[g]
        self.dense, self.light = np.flatnonzero(among), np.flatnonzero(~among)
        self.cell = (np.cumsum(many) - 1)[g[self.dense]] * SKIP_ROWS + s[self.dense]
        self.g, self.s = g[self.light], s[self.light]

    def tables(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some bigram rows of many contexts; these contexts, and their places among all cells of those rows."""
        for a in range(0, len(self.many), ROWS):
            rows = self.many[a : a + ROWS]
            at = slice(self.ends[a], self.ends[a + len(rows)])
            yield rows, self.dense[at], self.cell[at] - a * SKIP_ROWS

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some of the other contexts, their bigram rows and skip rows."""
        for a in range(0, len(self.light), PART):
            yield self.light[a : a + PART], self.g[a : a + PART], self.s[a : a + PART]

    def sums(self, rows: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Of each context, over the classes."""
        out = np.empty(self.n)
        for many, at, cell in self.tables():
            out[at] = np.matmul(rows[many], skips.T).reshape(-1).take(cell)
        for at, g, s in self.parts():
            out[at] = np.einsum("hc,hc->h", rows.take(g, axis=0), skips.take(s, axis=0))
        return out

    def by_bigram(self, rate: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """[bigram row, class]"""
        out = np.zeros((self.n_g, CLASSES))
        for many, at, cell in self.tables():
            rates = np.bincount(cell, rate[at], len(many) * SKIP_ROWS).astype(np.float32)
            out[many] = np.matmul(rates.reshape(-1, SKIP_ROWS), skips)
        for at, g, s in self.parts():
            x = skips.take(s, axis=0)
            x *= rate[at].astype(np.float32)[:, None]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            out[g[first]] += np.add.reduceat(x, first, axis=0)
        return out

    def by_skip(self, rate: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """[skip row, class]"""
        out = np.zeros((SKIP_ROWS, CLASSES))
        for many, at, cell in self.tables():
            rates = np.bincount(cell, rate[at], len(many) * SKIP_ROWS).astype(np.float32)
            out += np.matmul(rates.reshape(-1, SKIP_ROWS).T, rows[many])
        light = rate[self.light]
        for c in range(CLASSES):
            out[:, c] += np.bincount(self.s, light * rows[:, c].take(self.g), SKIP_ROWS)
        return out


class Block:
    """The tokens of a block, fitted and scored. ``kept_out``: whether the sixteenth is left out of the fit; ``members``:
    whether the second softmax is wanted, not the first alone."""

    def __init__(self, blobs: list[bytes], v: Vocabulary, skip: np.ndarray, kept_out: bool, members: bool = True):
        self.v, self.skip, self.members = v, skip, members
        one, two, code, self.row, times = unpacked(blobs)
        self.w, self.times, flags = (code >> 2).astype(np.int32), times, code & 3
        self.out = flags == 2
        t = (times * ((flags == 0) | (flags == 2) & (not kept_out))).astype(np.float64)
        new_g = np.r_[True, one[1:] != one[:-1]]
        new_h = new_g | np.r_[True, two[1:] != two[:-1]]
        self.g, self.h = (np.cumsum(x, dtype=np.int32) - 1 for x in (new_g, new_h))
        self.n_g, self.n_h = int(self.g[-1]) + 1, int(self.h[-1]) + 1
        first = np.flatnonzero(new_h)
        self.g_of_h, before = self.g[first].astype(np.int64), two[first]
        del one, two, code, flags
        self.skip_row = np.where(before < SKIP_ROWS - 1, before, hashed(before) % np.uint64(SKIP_ROWS)).astype(np.int64)
        self.c = v.cls[self.w].astype(np.int8)
        self.n_of_h = np.bincount(self.h, t, self.n_h)
        #: Contexts that the fit sees, and their places among these.
        on = np.flatnonzero(self.n_of_h)
        place = np.cumsum(self.n_of_h > 0) - 1
        self.seen_contexts, self.n_of_seen = Contexts(self.g_of_h[on], self.skip_row[on], self.n_g), self.n_of_h[on]
        self.seen = np.bincount(self.g * CLASSES + self.c, t, self.n_g * CLASSES).reshape(self.n_g, CLASSES).T
        # Classes rise with tokens, which rise within a context.
        first, self.pair_n, self.pair_of = runs(new_h | np.r_[True, self.c[1:] != self.c[:-1]], t)
        self.pair_keys = self.h[first] * np.int64(CLASSES) + self.c[first]
        self.pair_gc = self.g[first] * np.int64(CLASSES) + self.c[first]
        self.pair_at, self.pair_sc = place[self.h[first]], self.skip_row[self.h[first]] * CLASSES + self.c[first]
        #: [class, bigram row]; the classes of a row lie together.
        self.bigram, self.trigram = np.zeros((self.n_g, CLASSES)).T, np.zeros(len(self.pair_keys))
        self.of_skip = np.exp(skip)
        if members:
            self._members(new_h | np.r_[True, self.w[1:] != self.w[:-1]], t)

    def class_masses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[bigram row, class] without trigrams and skips; of each pair its mass without its trigram, and what the trigram adds."""
        of_bigram = np.exp(self.bigram.T + self.v.bias)
        mass = of_bigram.reshape(-1).take(self.pair_gc)
        mass *= np.ascontiguousarray(self.of_skip.T).reshape(-1).take(self.pair_sc)
        return of_bigram, mass, mass * np.expm1(self.trigram)

    def class_rates(self) -> tuple[np.ndarray, ...]:
        """As above; by context of the fit its tokens over its normaliser."""
        of_bigram, mass, more = self.class_masses()
        z = np.bincount(self.pair_at, more, len(self.n_of_seen))
        z += self.seen_contexts.sums(of_bigram.astype(np.float32), by_row(self.of_skip))
        return of_bigram, mass, more, self.n_of_seen / z

    def class_gradients(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seen less expected, and expected, of the bigram rows and of the trigram pairs."""
        of_bigram, mass, more, rate = self.class_rates()
        bi = self.seen_contexts.by_bigram(rate, by_row(self.of_skip))
        bi *= of_bigram
        of_pair = rate.take(self.pair_at)
        more *= of_pair
        bi += np.bincount(self.pair_gc, more, bi.size).reshape(bi.shape)
        mass *= of_pair
        mass += more
        return self.seen - bi.T, bi.T, self.pair_n - mass, mass

    def class_step(self) -> None:
        bi, bi_mass, tri, tri_mass = self.class_gradients()
        a, b = CLASS_PRIORS
        self.bigram += moved(bi, self.bigram, bi_mass, a)
        self.trigram += moved(tri, self.trigram, tri_mass, b)

    def skip_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """[class, skip row]: seen less expected, and expected."""
        of_bigram, _, more, rate = self.class_rates()
        expected = self.seen_contexts.by_skip(rate, of_bigram.astype(np.float32)) * self.of_skip.T
        expected += np.bincount(self.pair_sc, rate.take(self.pair_at) * more, expected.size).reshape(expected.shape)
        return (np.bincount(self.pair_sc, self.pair_n, expected.size).reshape(expected.shape) - expected).T, expected.T

    def _members(self, new: np.ndarray, t: np.ndarray) -> None:
        """The pairs that have weights: (bigram row, token) and (trigram row, token), and the (context, class) that they are in."""
        first, self.tri_n, self.tri_of = runs(new, t * (self.w < self.v.n))
        w, g = self.w[first], self.g[first]
        self.tri_keys, self.share_tri = self.h[first] * WIDE + w, self.v.share[w]
        key = g * WIDE + w
        order = ordered(key, self.n_g * int(WIDE))
        key = key[order]
        new = np.diff(key, prepend=-1) != 0
        self.bi_of_tri = np.empty(len(key), np.int64)
        self.bi_of_tri[order] = np.cumsum(new) - 1
        self.bi_keys = key[new]
        self.bi_n = np.bincount(self.bi_of_tri, self.tri_n, len(self.bi_keys))
        w = self.bi_keys % WIDE
        self.share_bi = self.v.share[w]
        gc = self.bi_keys // WIDE * CLASSES + self.v.cls[w]
        new = np.diff(gc, prepend=-1) != 0
        self.gc_keys, self.gc_of_bi = gc[new], np.cumsum(new) - 1
        # Those of the first softmax, but for the tail's.
        head = self.pair_keys % CLASSES < CLASSES - 1
        number = np.r_[np.where(head, np.cumsum(head) - 1, head.sum()), head.sum()].astype(np.int32)
        self.hc_n, self.hc_of = self.pair_n[head], number[self.pair_of]
        self.hc_of_tri = self.hc_of[first].astype(np.int64)
        self.gc_of_hc = np.empty(len(self.hc_n), np.int64)
        self.gc_of_hc[self.hc_of_tri] = self.gc_of_bi[self.bi_of_tri]
        self.vb, self.vt = np.zeros(len(self.bi_keys)), np.zeros(len(self.tri_keys))

    def member_masses(self) -> tuple[np.ndarray, ...]:
        """By (bigram row, class) the normaliser; what a (context, class) adds; the masses of the bigram pairs, and of the
        trigram pairs without their trigrams; what these add to one."""
        more_bi, more_tri = np.expm1(self.vb), np.expm1(self.vt)
        more_bi *= self.share_bi
        row = 1 + np.bincount(self.gc_of_bi, more_bi, len(self.gc_keys))
        more_bi += self.share_bi
        mass = more_bi.take(self.bi_of_tri)
        return row, np.bincount(self.hc_of_tri, mass * more_tri, len(self.hc_n)), more_bi, mass, more_tri

    def member_gradients(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seen less expected, and expected, of the bigram pairs and of the trigram pairs."""
        row, more, bi, tri, more_tri = self.member_masses()
        rate = self.hc_n / (row.take(self.gc_of_hc) + more)
        of_pair = rate.take(self.hc_of_tri)
        tri *= of_pair
        of_pair *= more_tri
        extra = np.bincount(self.bi_of_tri, of_pair, len(self.bi_keys))
        extra += np.bincount(self.gc_of_hc, rate, len(self.gc_keys)).take(self.gc_of_bi)
        bi *= extra
        more_tri += 1
        tri *= more_tri
        return self.bi_n - bi, bi, self.tri_n - tri, tri

    def member_step(self) -> None:
        bi, bi_mass, tri, tri_mass = self.member_gradients()
        a, b = MEMBER_PRIORS
        self.vb += moved(bi, self.vb, bi_mass, a)
        self.vt += moved(tri, self.vt, tri_mass, b)

    def fit(self) -> Block:
        for _ in range(STEPS):
            self.class_step()
            if self.members and len(self.tri_keys):
                self.member_step()
        return self

    def class_logs(self, at: np.ndarray | None = None) -> np.ndarray:
        """Of all tokens, or of those at some places."""
        h, g, c, pair = (x if at is None else x[at] for x in (self.h, self.g, self.c, self.pair_of))
        new = np.diff(h, prepend=-1) != 0
        of = h[new]
        of_bigram, _, more = self.class_masses()
        z = np.bincount(self.pair_keys // CLASSES, more, self.n_h)[of]
        z += Contexts(self.g_of_h[of], self.skip_row[of], self.n_g).sums(of_bigram.astype(np.float32), by_row(self.of_skip))
        out = (self.bigram.T + self.v.bias).reshape(-1).take(g * CLASSES + c) + np.log(self.of_skip)[c, self.skip_row[h]]
        return out - np.log(z)[np.cumsum(new) - 1] + np.r_[self.trigram, 0.0].take(pair)

    def logs(self) -> np.ndarray:
        """Of each token, natural; of a tail token that of its class."""
        out = self.class_logs() + np.log(self.v.share)[self.w]
        if len(self.tri_keys):
            row, more, *_ = self.member_masses()
            rows = np.ones(self.n_g * CLASSES)
            rows[self.gc_keys] = row
            out -= np.log(rows.take(self.g * CLASSES + self.c) + np.r_[more, 0.0].take(self.hc_of))
            out += np.r_[self.vt + self.vb.take(self.bi_of_tri), 0.0].take(self.tri_of)
            rest = np.flatnonzero(self.tri_of == len(self.tri_keys))
            out[rest] += found(self.bi_keys, self.g[rest] * WIDE + self.w[rest], self.vb)
        return out


def runs(new: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs that begin where ``new`` is and have some ``t``: where they begin, and their ``t``. And the run of each
    place, their number for one that is in none."""
    first = np.flatnonzero(new)
    n = np.add.reduceat(t, first)
    on = n > 0
    number = np.where(on, np.cumsum(on) - 1, on.sum()).astype(np.int32)
    return first[on], n[on], np.repeat(number, np.diff(np.r_[first, len(t)]))


def by_row(table: np.ndarray) -> np.ndarray:
    """[class, row] as [row, class], so that what is read together lies together."""
    return np.ascontiguousarray(table.T, dtype=np.float32)


def moved(rest: np.ndarray, weight: np.ndarray, expected: np.ndarray, prior: float) -> np.ndarray:
    """A step up the gradient, scaled by the curvature, and bounded. It takes the place of ``rest``."""
    rest -= prior * weight
    rest /= expected + prior
    rest *= RATE
    return np.clip(rest, -1, 1, out=rest)


def found(keys: np.ndarray, asked: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


BLOCKS = "block long, row long, doc_id long, held_out boolean, n_tokens long, known long, part double, words array<binary>, times array<int>, blobs array<binary>, rows binary"
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]


def blocks(slim: DataFrame, head: dict[bytes, int], v: Vocabulary, n: int) -> DataFrame:
    """The tokens of all texts in ``n`` blocks, a row each, and beside them a row for each document. A block's tokens name
    their documents by places in its ``rows``."""
    wide = min(SHELF, max(1, n // SHELVES))
    shelves = -(-n // wide)
    shared = slim.sparkSession.sparkContext.broadcast(({w: k for k, w in enumerate(head)}, v.counts, head.get(END, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, counts, texts = shared.value
        get, base = rank.get, task() << 40
        pending: list[tuple[np.ndarray, ...]] = []
        since, tokens = base, 0

        def sent() -> pa.RecordBatch:
            """The pending tokens, by shelf, block and context; equal neighbours are one."""
            at, one, two, code, row = (np.concatenate(c) for c in zip(*pending))
            pending.clear()
            order = np.argsort(two, kind="stable")
            order = order[ordered(one[order], 1 << 32)]
            order = order[np.argsort(at[order].astype(np.uint16) if n <= 1 << 16 else at[order], kind="stable")]
            at, one, two, code, row = at[order], one[order], two[order], code[order], row[order]
            first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (code[1:] != code[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
            times = np.diff(np.r_[first, len(at)])
            at, one, two, code, row = at[first], one[first], two[first], code[first], row[first]
            shelf = at // wide
            cut = np.flatnonzero(np.r_[True, np.diff(shelf) != 0])
            blobs = [[np.bincount(at[a:z] % wide, minlength=wide).astype("<i8").tobytes(), packed(since, *(x[a:z] for x in (one, two, code, row, times)))] for a, z in zip(cut, [*cut[1:], len(at)])]
            return row_of(shelf[cut], blobs)

        logs, often = np.r_[np.log10(counts + 0.5), 0.0], np.r_[counts, 0]
        for b in small(batches):
            done = 0
            for group in steps(utf8(b.column(2))):
                m = len(group)
                words, sizes = tokens_of(group)
                words = words.dictionary_encode()
                # Looked up once for all that are equal.
                distinct, codes = words.dictionary, words.indices.to_numpy()
                each = distinct.to_pylist()
                ids = np.fromiter(map(get, each, itertools.repeat(-1)), np.int64, len(each))
                rare = ids < 0
                w = np.where(rare, len(counts), ids)
                ids[rare] = [TAIL | zlib.crc32(each[k]) & 0x7FFFFFFF for k in np.flatnonzero(rare).tolist()]
                owner = np.repeat(np.arange(m), sizes)
                part = np.bincount(owner, logs[w][codes], m)
                tail = np.flatnonzero(rare[codes])
                known = sizes - np.bincount(owner[tail], minlength=m)
                tails, times = np.unique(owner[tail] * len(each) + codes[tail], return_counts=True)
                cuts = pa.array(np.searchsorted(tails, np.arange(m + 1) * len(each)), pa.int32())
                out, doc = b.column(1).slice(done, m), b.column(0).slice(done, m)
                rows = base + np.arange(m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows % shelves), pa.array(rows), doc, out, pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(part),
                        pa.ListArray.from_arrays(cuts, distinct.take(pa.array(tails % len(each)))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())), *(pa.nulls(m, t) for t in TYPES[-2:]),
                    ],
                    names=NAMES,
                )
                one, two = contexts(ids.astype(np.uint32)[codes], sizes)
                a, c = (np.where(x == START, texts, y) for x, y in zip((one, two), contexts(often[w][codes], sizes)))
                flags = np.where(out.to_numpy(zero_copy_only=False).astype(bool), 1, np.where(hashed(rows) % np.uint64(KEPT_OUT) == 0, 2, 0))
                at = (cells(one, two, rows[owner], a, c) % np.uint64(n)).astype(np.int32)
                pending.append((at, one, narrowed(two).astype(np.uint16), ((w << 2).astype(np.uint32)[codes] | flags.astype(np.uint32)[owner]), (owner + (base - since)).astype(np.uint32)))
                done += m
                base += m
                tokens += len(codes)
                if tokens >= GATHER:
                    yield sent()
                    since, tokens = base, 0
        if pending:
            yield sent()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[bytes]]] = {}
        for b in batches:
            blobs = b.column(NAMES.index("blobs"))
            docs = b.filter(blobs.is_null())
            if docs.num_rows:
                yield docs
            for k, x in zip(b.column(0).to_pylist(), blobs.to_pylist()):
                if x:
                    held.setdefault(k, []).append(x)
        for k in list(held):
            parts: list[list] = [[] for _ in range(wide)]
            for counts, blob in held.pop(k):
                arrays, ends = planes(blob), np.cumsum(np.frombuffer(counts, "<i8"))
                for part, a, z in zip(parts, [0, *ends[:-1]], ends):
                    if a < z:
                        part.append([x[a:z] for x in arrays])
            for j, part in enumerate(parts):
                if part:
                    rows = placed(part)
                    one, two, code, place, times = in_order(*(np.concatenate(c) for c in zip(*part)))
                    part.clear()
                    yield row_of(np.array([k * wide + j]), [[packed(0, one, two, code, place, times)]], [packed_rows(rows)])

    made = slim.select("doc_id", "held_out", "text").mapInArrow(run, BLOCKS)
    return made.repartitionById(shelves, F.col("block").cast("int")).mapInArrow(gather, BLOCKS)


def placed(parts: list[list[np.ndarray]]) -> np.ndarray:
    """The rows of all parts, ascending; each part names them by their places in it. No two parts share a row."""
    found, n = [], 0
    for part in sorted(parts, key=lambda x: int(x[3][0])):
        least = part[3].min()
        at = part[3] - least
        there = np.zeros(int(at.max()) + 1, bool)
        there[at] = True
        found.append(np.flatnonzero(there) + least)
        part[3] = (np.cumsum(there) - 1 + n)[at]
        n += len(found[-1])
    return np.concatenate(found)


def packed_rows(rows: np.ndarray) -> bytes:
    """Ascending numbers, as differences."""
    return np.int64(len(rows)).tobytes() + pa.compress(np.diff(rows, prepend=0).astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unpacked_rows(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    return np.cumsum(np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), "<i8"))


def row_of(at: np.ndarray, blobs: list[list[bytes]], rows: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.nulls(len(at), t) for t in TYPES[1:-2]), pa.array(blobs, TYPES[-2]), pa.array(rows or [None] * len(at), TYPES[-1])], names=NAMES)


def skip_round(stored: DataFrame, v: Vocabulary, skip: np.ndarray, before: np.ndarray) -> tuple[float, float, np.ndarray]:
    """One round over some blocks: the likelihood of the sixteenth with these weights and with those before, and the
    weights after the step."""
    shared = stored.sparkSession.sparkContext.broadcast((v, skip, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, skip, before = shared.value
        rest, expected, likely = np.zeros(skip.shape), np.zeros(skip.shape), np.zeros(2)
        for b in batches:
            for blobs in b.column(0):
                block = Block(blobs.as_py(), v, skip, kept_out=True, members=False).fit()
                out = np.flatnonzero(block.out)
                likely[0] += float((block.class_logs(out) * block.times[out]).sum())
                r, e = block.skip_sums()
                rest += r
                expected += e
                block.of_skip = np.exp(before)
                likely[1] += float((block.class_logs(out) * block.times[out]).sum())
        at = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, at]), pa.array(np.r_[likely, rest.ravel()[at]]), pa.array(np.r_[0.0, 0.0, expected.ravel()[at]])], names=["weight", "rest", "expected"])

    got = stored.mapInArrow(run, "weight long, rest double, expected double").groupBy("weight").agg(F.sum("rest").alias("rest"), F.sum("expected").alias("expected")).toArrow()
    at, rest, expected = (got[c].to_numpy() for c in ("weight", "rest", "expected"))
    after, on = skip.ravel().copy(), at >= 0
    after[at[on]] += moved(rest[on], after[at[on]], expected[on], SKIP_PRIOR) / RATE
    return float(rest[at == -1].sum()), float(rest[at == -2].sum()), after.reshape(skip.shape)


def skip_weights(stored: DataFrame, v: Vocabulary, n: int, rounds: int = ROUNDS, told: list | None = None) -> np.ndarray:
    """Rounds, each over the next share of the ``n`` blocks, until the last step has not raised the likelihood."""
    skip = before = np.zeros((CLASSES, SKIP_ROWS))
    shares = min(rounds, n)
    for k in range(rounds):
        likely, earlier, after = skip_round(stored.where(F.col("block") % shares == k % shares).select("blobs"), v, skip, before)
        if told is not None:
            told.append((likely, earlier))
        if k and likely <= earlier + GAIN * abs(earlier):
            return skip if likely > earlier else before
        before, skip = skip, after
    return skip


#: Rows of documents whose sums travel together, and rows whose sums a task holds before it sends them on.
TOGETHER, HELD_ROWS = 1 << 12, 1 << 23


def block_logs(stored: DataFrame, v: Vocabulary, skip: np.ndarray) -> DataFrame:
    """(row, log): the sums of each document's tokens over all blocks. Tasks send on one array for ``TOGETHER`` rows."""
    shared = stored.sparkSession.sparkContext.broadcast((v, skip))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, skip = shared.value
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names = ["part", "logs"]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([pa.compress(x.astype("<f4").tobytes(), codec="zstd", asbytes=True) for x in held.values()], pa.binary())], names=names)

        for b in batches:
            for blobs, rows in zip(b.column(0), b.column(1)):
                block = Block(blobs.as_py(), v, skip, kept_out=False).fit()
                rows = unpacked_rows(rows.as_py())
                sums = np.bincount(block.row, block.logs() * block.times, len(rows))
                part, at = rows // TOGETHER, rows % TOGETHER
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
                for a, z in zip(first, [*first[1:], len(rows)]):
                    k = int(part[a])
                    if k not in held:
                        held[k] = np.zeros(TOGETHER)
                    held[k][at[a:z]] += sums[a:z]
                if len(held) * TOGETHER > HELD_ROWS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(pa.decompress(data, 4 * TOGETHER, codec="zstd", asbytes=True), "<f4").astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(k * TOGETHER + at), pa.array(x[at])], names=["row", "log"])

    return stored.mapInArrow(run, "part long, logs binary").repartition("part").mapInArrow(add, "row long, log double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, told: list | None = None) -> DataFrame:
    """A row for every document: n_tokens, n_known, train_tokens, base_score (unigram) and score (the model's). ``told``
    is given the likelihoods of the rounds."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    words = Scratch(counted(slim.where(~F.col("held_out")).select("text")), "words").df
    total, distinct = (x or 0 for x in words.agg(F.sum("c"), F.count("*")).first())
    head = frequent(words, HEAD)
    v = Vocabulary(np.array(list(head.values()), np.int64), total, distinct)
    n = max(1, -(-total // BLOCK_TOKENS))
    both = Scratch(blocks(slim, head, v, n), "blocks").df
    stored = both.where("blobs is not null").select("block", "blobs", "rows")
    logs = Scratch(block_logs(stored.select("blobs", "rows"), v, skip_weights(stored, v, n, rounds, told)), "logs").df
    scored = both.where("blobs is null").drop("block", "blobs", "rows")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(words, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum("times").alias("n"))
    each = scored.drop("words", "times").join(Scratch(rare, "rare").df, "row", "left").join(logs, "row", "left")
    n_known = F.col("known") + F.coalesce("n", F.lit(0))
    beyond = F.coalesce("more", F.lit(0.0)) + (F.col("n_tokens") - n_known) * F.lit(float(np.log10(0.5)))
    return each.select(
        "doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + beyond - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"),
        (F.coalesce("log", F.lit(0.0)) / F.lit(float(np.log(10))) + beyond - (F.col("n_tokens") - F.col("known")) * F.lit(float(np.log10(v.tail)))).alias("score"),
    )
