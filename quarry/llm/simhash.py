"""SimHash near-duplicates: a byte-position inverted index with count filtering, then verification.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most ``BITS`` = 2 bits differ in at most
two bytes, so they share at least six positional bytes: the guaranteed minimum. The index posts every distinct
fingerprint under each choice of six positions with their bytes; two fingerprints meet in a list exactly if their tally
of shared positional bytes reaches six. The members of a list differ in the two other bytes only, so a list holds at
most 65,536 of them whatever the size of the table. Within a list each member is looked up against the members whose
two free bytes differ in one or two bits; a list then yields the links of a spanning forest, not all its pairs.

For a similarity of word shingles (``similar``: five words, 0.8) 64 bits are too few: texts that alike differ in up to a
dozen of them, which guarantees no shared byte. There the sets of shingles are joined by prefix filtering, which is exact:
with all shingles in one order, rare ones first, two sets of the similarity have in common one of the first
n - ceil(0.8 n) + 1 of each. Every set is posted under those, and the members of a list are compared by their own
shingles, but for pairs that their sizes and places in the order rule out.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; equal
fingerprints are linked; a null id takes part in linking and is never a component's smallest id unless there is no
other (then null); repeated rows each give a row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small, task, utf8

BITS, SHINGLE, SEED = 2, 3, 42
POSITIONS = tuple(itertools.combinations(range(8), 8 - BITS))


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """Of the text's bytes; only A-Z are lower-cased, words end at space and U+0009 to U+000D."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])], np.uint64)
    return majority(h)


_SPREAD = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)


def majority(h: np.ndarray) -> int:
    """Bit k is set if it is set in over half the hashes."""
    n = len(h)
    if n < 512:
        ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        by = h.astype("<u8").view(np.uint8).reshape(n, 8)
        ones = np.concatenate([np.bincount(by[:, k], minlength=256) @ _SPREAD for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), signed([fingerprint(x, size) for x in utf8(b.column(1))])], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


#: The differences of one or two bits between two pairs of bytes.
FLIPS = np.array([1 << a for a in range(16)] + [1 << a | 1 << b for a in range(16) for b in range(a)], np.int64)


def forest(members: np.ndarray, free: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Links that connect what one posting list's members connect by pairs of at most two differing bits."""
    low, high = (8 * p for p in free)
    bits = members.view(np.uint64)
    rest = ((bits >> np.uint64(low) & np.uint64(255)) | (bits >> np.uint64(high) & np.uint64(255)) << np.uint64(8)).astype(np.int64)
    if len(members) == 2:
        return ([int(members[0])], [int(members[1])]) if int(rest[0] ^ rest[1]).bit_count() <= BITS else ([], [])
    where = np.full(1 << 16, -1, np.int64)
    where[rest] = np.arange(len(members))
    parent = list(range(len(members)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right = [], []
    if len(members) <= 64:
        near = np.bitwise_count(rest[:, None] ^ rest[None, :]) <= BITS
        pairs = zip(*np.nonzero(np.triu(near, 1)))
    else:
        pairs = ((k, j) for k in range(len(members)) for j in where[rest[k] ^ FLIPS] if j > k)
    for a, b in pairs:
        x, y = root(int(a)), root(int(b))
        if x != y:
            parent[max(x, y)] = min(x, y)
            left.append(int(members[a]))
            right.append(int(members[b]))
    return left, right


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints ``fp``: verified links whose components are those of all linked pairs."""

    def key(positions: tuple[int, ...]):
        mask = sum(255 << 8 * p for p in positions)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    posted = distinct.select("fp", F.posexplode(F.array(*[key(p) for p in POSITIONS])).alias("choice", "key"))
    lists = posted.groupBy("choice", "key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("choice", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            a, z = [], []
            choice, members = b.column(0).to_pylist(), b.column(1)
            values, offsets = members.flatten().to_numpy(), np.r_[0, np.cumsum(pa.compute.list_value_length(members).to_numpy())]
            for k, c in enumerate(choice):
                x, y = forest(values[offsets[k] : offsets[k + 1]], tuple(sorted(set(range(8)) - set(POSITIONS[c]))))
                a += x
                z += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps over tables in the shared folder; every step moves each node's links to a
    smaller node, so the number of rounds grows with the logarithm of the longest chain and no task gathers a component:
    a node's neighbours are only ever reduced to their minimum. The minima are written before they are joined, so that
    both sides of the join are plain exchanges, of which Spark splits those of a node with very many links.
    """
    now = Scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Scratch(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        half = Scratch(large, name)
        low = Scratch(half.df.groupBy("u").agg(F.min("v").alias("m")), name)
        small = half.df.join(low.df, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = Scratch(small, name)
        sums = after.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        for old in (least, half, low, now):
            old.drop()
        now = after
        if sums == before:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sums


SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Shingles are counted in so many bins, over all sets, in parts that are summed apart. Candidates are complete in any
#: order that all sets share; in the order of these counts their lists are short.
BINS, PARTS = 1 << 22, 256
#: Rows of whole lists that are handled at once.
LIST_ROWS = 1 << 17
_ODD = np.uint64(int(np.random.default_rng(64).integers(0, 1 << 63, 16, dtype=np.uint64)[8]) * 2 + 1)


def mixed(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, of all words if there are fewer."""
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


SKETCH = "row long, doc_id long, fp long, shingle_set long, shingles array<int>"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints, and the distinct shingles of five words as 32-bit hashes in order, with a 64-bit hash of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = task() << 40
        for b in small(batches):
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                prints, sets, shingles = [], [], []
                for data in utf8(part.column(1)):
                    prints.append(fingerprint(data))
                    words = data.lower().split()
                    w = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, len(words))
                    shingles.append(np.unique((mixed(w, SIMILAR_WORDS) >> np.uint64(32)).astype(np.uint32).view(np.int32)) if len(w) else np.zeros(0, np.int32))
                    sets.append(xxhash.xxh64_intdigest(shingles[-1].tobytes(), SEED))
                at = pa.array(np.cumsum([0, *map(len, shingles)]), pa.int32())
                lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(shingles) if shingles else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column(0), signed(prints), signed(sets), lists], names=[x.split()[0] for x in SKETCH.split(", ")])
                row += part.num_rows

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SKETCH)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """For each bin of shingles, how often they are in the sets: eight steps to a doubling, in a byte.

    Every task counts its own sets; the parts of the bins are summed apart, and a byte of each bin reaches the driver.
    """
    width = BINS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.uint32)
        seen = False
        for b in small(batches):
            for k in range(0, b.num_rows, 256):
                bins = b.column(0).slice(k, 256).flatten().to_numpy() & (BINS - 1)
                seen = seen or len(bins) > 0
                np.add.at(counts, bins, np.uint32(1))
        if seen:
            blobs = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in counts.reshape(PARTS, width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(pa.decompress(data, 4 * width, codec="zstd", asbytes=True), np.uint32).astype(np.int64)
                sums[part] = sums[part] + x if part in sums else x
        if sums:
            steps = [np.minimum(8 * np.log2(x + 1.0), 255).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(steps, pa.binary())], names=["part", "counts"])

    out = np.zeros((PARTS, width), np.uint8)
    got = sets.select("shingles").mapInArrow(run, "part long, counts binary").repartition("part").mapInArrow(add, "part long, counts binary").toArrow()
    for part, data in zip(got["part"].to_pylist(), got["counts"].to_pylist()):
        out[part] = np.frombuffer(data, np.uint8)
    return out.ravel()


POSTING = "key int, shingle_set long, n int, place int"


def postings(sets: DataFrame, similarity: float) -> DataFrame:
    """Each set under the first of its shingles, with its size and the shingle's place in the order."""
    shared = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in small(batches):
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                lists = part.column(1)
                flat, sizes = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()
                rank = flat.view(np.uint32).astype(np.int64) | counts[flat & (BINS - 1)].astype(np.int64) << 32
                keys, posted, start = [np.zeros(0, np.int64)], np.zeros(len(sizes), np.int64), 0
                for j, n in enumerate(sizes.tolist()):
                    if n:
                        posted[j] = m = n - math.ceil(similarity * n - 1e-9) + 1
                        own = rank[start : start + n]
                        keys.append(np.sort(np.partition(own, m - 1)[:m] if m < n else own))
                    start += n
                place = np.arange(posted.sum()) - np.repeat(np.cumsum(posted) - posted, posted)
                key = (np.concatenate(keys) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(part.column(0).to_numpy(), posted)), pa.array(np.repeat(sizes, posted).astype(np.int32)), pa.array(place.astype(np.int32))], names=["key", "shingle_set", "n", "place"])

    return sets.select("shingle_set", "shingles").mapInArrow(run, POSTING)


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of rows in the order of the first one, cut between its values, and where its values begin and end."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
            rows += b.num_rows
        if not held or b is not None and (rows < LIST_ROWS or held[0].column(0)[0] == held[-1].column(0)[-1]):
            continue
        columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
        bounds = np.r_[0, np.flatnonzero(np.diff(columns[0])) + 1, rows]
        if b is not None:
            last = b.slice(b.num_rows - min(b.num_rows, rows - int(bounds[-2])))
            held, over = [last], rows - int(bounds[-2]) - last.num_rows
            if over:  # the last list began in an earlier batch
                held = pa.Table.from_arrays([pa.array(c[bounds[-2] :]) for c in columns], schema=b.schema).to_batches()
            bounds, rows = bounds[:-1], sum(x.num_rows for x in held)
        yield [c[: bounds[-1]] for c in columns], bounds
        if b is None:
            return


def possible(n: np.ndarray, place: np.ndarray, n_other: np.ndarray, place_other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets whose first common shingle is at these places can have the similarity."""
    return np.minimum(n - place, n_other - place_other) >= similarity / (1 + similarity) * (n + n_other) - 1e-6


LISTED = "key int, shingle_set long, n int, place int, size int, hub long, near boolean"


def starred(posted: DataFrame, similarity: float) -> DataFrame:
    """The lists of two sets or more: their postings with the list's size, its hub, and whether hub and set can be similar.

    The hub has the fewest shingles that are rarer: of variants of one text, that text if it is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, sets, n, place), bounds in whole_lists(batches):
            sizes = np.diff(bounds)
            size, first = np.repeat(sizes, sizes), np.repeat(bounds[:-1], sizes)
            near = possible(n, place, n[first], place[first], similarity) & (first != np.arange(len(key)))
            more = size > 1
            columns = [key, sets, n, place, size.astype(np.int32), sets[first], near]
            yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in columns], names=[x.split()[0] for x in LISTED.split(", ")])

    return posted.repartition("key").sortWithinPartitions("key", "place", "shingle_set").mapInArrow(run, LISTED)


def unlinked(listed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of lists (key, root, shingle_set, n, place) all pairs of different roots that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, roots, sets, n, place), bounds in whole_lists(batches):
            ends = bounds[1:]
            end = np.repeat(ends, np.diff(bounds))
            group = np.flatnonzero(np.r_[np.diff(roots) != 0, True] | np.r_[np.diff(key) != 0, True]) + 1
            own = np.repeat(group, np.diff(np.r_[0, group]))  # a list's sets of one root stand together
            left, right, held = [], [], 0
            for k in np.flatnonzero(own < end).tolist():
                j = np.arange(own[k], end[k])
                j = j[possible(n[k], place[k], n[j], place[j], similarity)]
                if len(j):
                    left.append(np.full(len(j), sets[k]))
                    right.append(sets[j])
                    held += len(j)
                if held > LIST_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
                    left, right, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    rows = listed.select("key", "root", "shingle_set", "n", "place").repartition("key").sortWithinPartitions("key", "root", "shingle_set")
    return rows.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Bits that mark hashes, in buckets of as many as Spark's bitmaps have.
MARKS, BUCKET = 1 << 25, 1 << 15


def marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a hash, may be in ``wanted``: all that are, and few others as long as few bits are set.

    Wide rows that a join would drop are dropped before they are shuffled for it; the bits are 4 MB whatever the tables.
    """
    place = F.col(key).bitwiseAND(F.lit(MARKS - 1))
    bucket, bit = F.floor(place / BUCKET), place.bitwiseAND(F.lit(BUCKET - 1))
    marks = wanted.select(bucket.alias("mark_bucket"), bit.alias("bit")).groupBy("mark_bucket").agg(F.bitmap_construct_agg("bit").alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(marks), bucket == F.col("mark_bucket")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, used: list[Scratch]) -> DataFrame:
    """Those of the pairs (a, b) that have the similarity by their own shingles."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(Scratch(df, name))
        return used[-1].df

    asked = keep(pairs.select(F.col("a").alias("shingle_set")).union(pairs.select(F.col("b").alias("shingle_set"))).distinct(), "asked")
    known = keep(marked(sets, asked, "shingle_set").join(asked, "shingle_set").select("shingle_set", "shingles"), "known")
    a, b = (known.select(F.col("shingle_set").alias(x), F.col("shingles").alias(f"shingles_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for k in range(batch.num_rows):
                p, q = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                n = len(np.intersect1d(p, q, assume_unique=True))
                hit.append(n >= similarity * (len(p) + len(q) - n))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return keep(both.mapInArrow(run, "a long, b long"), "verified")


def similar(sketched: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between fingerprints, whose components are those of all texts with at least the similarity.

    Sets of shingles are compared, not fingerprints: texts with one fingerprint may differ. No list is gathered in a row.
    First each list's members are compared with its hub. Then all pairs of a list are compared that this has not linked,
    over whatever others, so a large group is linked at little more than a comparison a member, and no link is lost.
    """
    used: list[Scratch] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(Scratch(df, name))
        return used[-1].df

    named = keep(sketched.groupBy("shingle_set").agg(F.min("row").alias("least"), F.min("fp").alias("first")), "sets")
    copies = keep(sketched.select("shingle_set", "row", "fp").join(named, "shingle_set").where("row <> least").select("row", "fp", "first"), "copies")
    sets = sketched.join(copies.select("row"), "row", "left_anti").select("shingle_set", "shingles")
    listed = keep(starred(postings(sets, similarity), similarity), "lists")
    pairs = keep(listed.where("near").select(F.least("hub", "shingle_set").alias("a"), F.greatest("hub", "shingle_set").alias("b")).distinct(), "pairs")
    found = verified(pairs, sets, similarity, used)
    roots = keep(components(found), "roots")
    rooted = listed.where("size > 2").join(roots, F.col("shingle_set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "shingle_set"))
    rest = keep(unlinked(rooted, similarity).join(pairs, ["a", "b"], "left_anti"), "rest")
    found = found.unionByName(verified(rest, sets, similarity, used))
    a, b = (named.select(F.col("shingle_set").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    between = found.join(a, "a").join(b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    within = sketched.select("shingle_set", "fp").join(named, "shingle_set").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    links = Scratch(between.unionByName(within).where("a <> b").distinct(), "similar").df
    for x in used:
        x.drop()
    return links


def classes(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, first) for each distinct fingerprint of ``prints`` (doc_id, fp): the smallest id, and the
    smallest fingerprint, of its component. ``more``: further links (a, b)."""
    distinct = Scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints").df
    found = links(distinct.select("fp"))
    roots = Scratch(components(found if more is None else found.unionByName(more)), "roots").df
    rooted = Scratch(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("first")), "rooted").df
    named = Scratch(rooted.groupBy("first").agg(F.min("least").alias("component_id")), "named").df
    return rooted.join(named, "first").select("fp", "component_id", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = Scratch(fingerprints(docs, id_col, text_col), "documents").df
    found = Scratch(classes(prints), "classes").df
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = SIMILARITY) -> DataFrame:
    """One row of each component, with all its columns: the row of the smallest id.

    Links are those of fingerprints at two differing bits and, with a similarity, of texts with that similarity.

    Rows with the id in common, or with none, are told apart by their fingerprints; only they are compared whole.
    """
    columns = docs.columns
    if similarity is None:
        prints = Scratch(fingerprints(docs, id_col, text_col), "documents").df
        found = Scratch(classes(prints), "classes").df
    else:
        sketched = Scratch(sketches(docs, id_col, text_col), "sketches")
        prints = Scratch(sketched.df.select("doc_id", "fp"), "documents").df
        near = similar(sketched.df, similarity)
        sketched.drop()
        found = Scratch(classes(prints, near), "classes").df
    ids = Scratch(prints.groupBy("doc_id").agg(F.min("fp").alias("fp"), F.count("*").alias("n")), "ids").df
    kept, fp = fresh("kept", columns), fresh("fp", columns)
    single = ids.where("n = 1 and doc_id is not null").join(found, "fp").where("doc_id = component_id").select(F.col("doc_id").alias(kept))
    rows = docs.join(single, docs[id_col].cast("long") == F.col(kept), "left_semi")
    several = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(kept))
    if several.isEmpty():
        return rows.select(*columns)
    again = docs.join(several, docs[id_col].cast("long").eqNullSafe(F.col(kept)), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, signed([fingerprint(x) for x in utf8(b.column(b.schema.get_field_index(text_col)))])], names=[*b.schema.names, fp])

    again = again.mapInArrow(run, again.select("*", F.lit(0).cast("long").alias(fp)).schema)
    group, least = fresh("first", [*columns, fp]), fresh("component_id", [*columns, fp])
    named = found.select(F.col("fp").alias(kept), F.col("first").alias(group), F.col("component_id").alias(least))
    again = again.join(named, again[fp] == F.col(kept)).where(F.col(id_col).cast("long").eqNullSafe(F.col(least)))
    return rows.select(*columns).unionByName(again.dropDuplicates([group]).select(*columns))
