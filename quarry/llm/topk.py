"""Exact top-k search by inner product over a pivot-distance index.

Vectors of whole numbers are taken from a common centre, which shifts all scores of a query alike, and lifted by one
more component to the same length, M: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the nearest lifted vectors are those of
the highest inner product; a query may be scaled to the vectors' usual length first, which keeps its order. Every vector
is keyed by its nearest pivot and its distance to it. The index is sorted by that key and cut into blocks; the vectors
of a pivot fall into rings (annuli) of distances between quantiles that the driver fixes from a bounded sample.

A query takes its rings in the order of the least distance that the triangle inequality allows,
|d(q, pivot) - d(x, pivot)| <= d(q, x). It first searches the nearest rings that hold k vectors together; the k-th score
found there is its floor. Then it expands to every other ring that could still hold as high a score, and within a ring
skips the blocks that can't, the floor rising from block to block. Rings beyond that are not visited.

Both searches are one job each, however many queries there are: groups of queries are joined with the blocks of the
rings that they visit. Rings are at most ``PIVOTS`` x ``RINGS``; a task keeps k results of a query.

Results are exact whatever the components. Scores are float64 products where no sum can leave the whole numbers that
float64 holds; vectors of length ``EXACT`` or more, and those of unusual lengths, form a ring of their own, which is
visited always, and are scored by whole numbers of any size.

Defined results: a null vector, and one with a null or non-finite component, takes no part; a score beyond the range of
a long is the end of that range; vectors of another length than the query's are no candidates; ties go to the smaller
id; rows that share an id are separate rows, and a query's own row alone is left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small

K, SCALE, PIVOTS, RINGS, SAMPLE, BLOCK = 5, 256, 32, 32, 4096, 2048
#: Numbers of components that get pivots, the most usual ones.
USUAL = 256
#: Two vectors shorter than this have a product, and partial sums, below 2^52.
EXACT = float(1 << 26)
#: The ring of what has no pivot.
APART = -1
#: Stands for a null id within the search: it is the smallest.
NO_ID = -(1 << 62)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def components(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """From the lifted rows to the lifted pivots."""
    squared = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T + (lift[:, None] - pivot_lift[None, :]) ** 2
    return np.sqrt(np.maximum(squared, 0))


def spread(x: np.ndarray, lift: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample far from each other: each next one is the farthest from those before."""
    chosen, far = [0], distances(x, lift, x[:1], lift[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, distances(x, lift, x[k : k + 1], lift[k : k + 1])[:, 0])
    return np.array(chosen)


class Space:
    """What one number of components needs: the centre, M, the pivots and the rings' borders. A ring holds a block or more."""

    def __init__(self, sample: np.ndarray, n: int, longest: float):
        self.centre = sample.mean(axis=0)
        #: No vector is farther from the centre.
        self.most = (longest + float(np.linalg.norm(self.centre))) * (1 + 1e-9) + 1e-9
        x = sample - self.centre
        self.usual = max(float(np.sqrt((x * x).sum(1).mean())), 1e-9)
        cells = max(1, min(PIVOTS * RINGS, n // BLOCK))
        pivots = min(PIVOTS, cells)
        lift = self.lift(x)
        at = spread(x, lift, pivots)
        self.pivots, self.pivot_lift = x[at], lift[at]
        near, far = self.key(sample)
        rings = max(1, min(RINGS, cells // pivots))
        self.borders = [np.unique(np.quantile(far[near == p], np.arange(1, rings) / rings)) if rings > 1 and (near == p).any() else np.zeros(0) for p in range(len(at))]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most**2 - (x * x).sum(1), 0))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors - self.centre
        return distances(x, self.lift(x), self.pivots, self.pivot_lift)

    def key(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(vectors)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    def ring(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(self.borders[p], d, "right") for p, d in zip(near, far)], np.int64) + near * RINGS


FLOATS = pa.list_(pa.float64())
VECTORS = "uid long, vec_id long, dim int, norm double, v array<double>"
KEYED = "uid long, vec_id long, dim int, ring int, dist double, v array<double>"


def of_length(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each batch by their number of components, which is column ``at``."""
    for b in small(batches):
        dims = b.column(at).to_numpy()
        for d in np.unique(dims):
            yield int(d), b.filter(pa.array(dims == d))


def floored(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Every row that takes part: floor(256 x) of every component, as double, and the vector's length."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dim"), v.alias("v")).where(v.isNotNull() & ~bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in of_length(batches, 2):
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(components(b.column(3), d) * SCALE)) if d else np.zeros((b.num_rows, 0))
                norm = np.nan_to_num(np.sqrt((x * x).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(norm), lists(x)], names=[c.split()[0] for c in VECTORS.split(", ")])

    return rows.mapInArrow(run, VECTORS)


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def index(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, dict[int, Space]]:
    """Every row that takes part, with its key; and the spaces by number of components."""
    rows = Scratch(floored(vectors, id_col, vector_col), "vectors").df
    near = rows.where((F.col("norm") < EXACT) & (F.col("dim") > 0))
    facts = {r["dim"]: r for r in near.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.desc("n"), "dim").limit(USUAL).collect()}
    most = SAMPLE if len(facts) < 16 else 16 * SAMPLE // len(facts)
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", "uid"), "uid")
    chosen = near.where(F.col("dim").isin(list(facts))).select("uid", "dim", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("uid")
    sample: dict[int, list] = {}
    for r in rows.join(F.broadcast(chosen), "uid", "left_semi").select("uid", "dim", "v").orderBy("uid").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    spaces = {d: Space(np.array(v), facts[d]["n"], facts[d]["most"]) for d, v in sample.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in of_length(batches, 2):
            ring, far = np.full(b.num_rows, APART), np.zeros(b.num_rows)
            rows = np.flatnonzero(b.column(3).to_numpy() < EXACT)
            if d in shared.value and len(rows):
                near, far[rows] = shared.value[d].key(components(b.column(4), d)[rows])
                ring[rows] = shared.value[d].ring(near, far[rows])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ring.astype(np.int32)), pa.array(far), b.column(4)], names=[c.split()[0] for c in KEYED.split(", ")])

    return Scratch(rows.mapInArrow(run, KEYED), "keyed").df, spaces


BLOCKS = "dim int, ring int, lows array<double>, highs array<double>, n int, uids binary, ids binary, vectors binary"


def blocks(keyed: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """Rows sorted by ring and distance, up to ``BLOCK`` of a ring in one, and how near and far they are to each pivot."""
    shared = keyed.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0

        def flush() -> pa.RecordBatch:
            uids, ids, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            low = high = np.zeros(0)
            if key[1] != APART:
                far = shared.value[key[0]].distances(x.reshape(n, key[0]))
                low, high = far.min(axis=0), far.max(axis=0)
            row = (*key, low.tolist(), high.tolist(), n, uids.tobytes(), ids.tobytes(), x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), FLOATS, FLOATS, pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for b in small(batches):
            dims, rings = b.column(2).to_numpy(), b.column(3).to_numpy()
            edges = np.flatnonzero(np.r_[True, (np.diff(dims) != 0) | (np.diff(rings) != 0)]) if len(dims) else []
            for a, z in zip(edges, [*edges[1:], len(dims)]):
                for s in range(a, z, BLOCK):
                    part = b.slice(s, min(BLOCK, z - s))
                    if held and (key != (int(dims[a]), int(rings[a])) or n + part.num_rows > BLOCK):
                        yield flush()
                        held, n = [], 0
                    key, n = (int(dims[a]), int(rings[a])), n + part.num_rows
                    held.append((part.column(0).to_numpy(), part.column(1).fill_null(NO_ID).to_numpy(), part.column(5).flatten().to_numpy()))
        if held:
            yield flush()

    order = ["dim", "ring", "dist", "vec_id", "uid"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


class Bounds:
    """Of some queries, by ring: the highest score that the triangle inequality allows."""

    def __init__(self, x: np.ndarray, space: Space):
        #: The vectors are less the centre, the query is not: q.x = q.(x - centre) + q.centre. Its last component is 0.
        length = np.sqrt((x * x).sum(1))
        self.scale = np.where(length > 0, space.usual / np.maximum(length, 1e-12), 1.0)
        q = x * self.scale[:, None]
        self.base = x @ space.centre
        self.reach = (q * q).sum(1) + space.most**2
        self.far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (space.pivots**2).sum(1)[None, :] - 2 * (q @ space.pivots.T) + space.pivot_lift[None, :] ** 2, 0))

    def above(self, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """[query, ring]: for rings [ring, pivot] no vector of which is nearer or farther to the pivots. The pivot whose
        ring excludes most counts. With slack for rounding, in units of the score, which is a whole number."""
        gap = np.zeros((len(self.far), len(lows)))
        for p in range(lows.shape[1]):
            far, low, high = self.far[:, p, None], lows[None, :, p], highs[None, :, p]
            np.maximum(gap, np.maximum(far - high, low - far) - 1e-9 * (far + high), out=gap)
        reach, scale, base = self.reach[:, None], self.scale[:, None], self.base[:, None]
        return (reach - gap * gap) / 2 / scale + base + 1e-9 * (np.abs(reach) / scale + np.abs(base)) + 0.5


VISITS = "dim int, ring int, asked binary"
FOUND = "query_uid long, query_id long, vec_id long, score long, pairs long"


def packed(uids: np.ndarray, ids: np.ndarray, floors: np.ndarray, x: np.ndarray) -> bytes:
    return b"".join((np.int64(len(uids)).tobytes(), uids.tobytes(), ids.tobytes(), floors.tobytes(), x.tobytes()))


def unpacked(data: bytes, dim: int) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    columns = [np.frombuffer(data, t, n, 8 + 8 * n * k) for k, t in enumerate((np.int64, np.int64, np.float64))]
    return *columns, np.frombuffer(data, np.float64, n * dim, 8 + 24 * n).reshape(n, dim)


def visits(queries: DataFrame, spaces: dict[int, Space], rings: dict[int, tuple[np.ndarray, ...]], k: int, seeds: bool) -> DataFrame:
    """For groups of queries (uid, vec_id, dim, v, floor) the rings that they visit: first, or after their floors are known."""
    shared = queries.sparkSession.sparkContext.broadcast((spaces, rings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, rings = shared.value
        for d, b in of_length(batches, 2):
            uids, ids, floors = b.column(0).to_numpy(), b.column(1).fill_null(NO_ID).to_numpy(), b.column(4).fill_null(-np.inf).to_numpy()
            x = components(b.column(3), d) if d else np.zeros((b.num_rows, 0))
            if d not in rings:
                continue
            ring, n, lows, highs = rings[d]
            go = np.full((len(x), len(ring)), seeds)
            own = np.flatnonzero(ring != APART)
            tame = np.flatnonzero((x * x).sum(1) < EXACT**2) if d in spaces else np.zeros(0, np.int64)
            if len(tame) and len(own):
                ceiling = Bounds(x[tame], spaces[d]).above(lows, highs)
                order = np.argsort(-ceiling, axis=1, kind="stable")
                enough = np.cumsum(n[own][order], axis=1) > k
                last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(own) - 1)
                first = np.zeros(ceiling.shape, bool)
                np.put_along_axis(first, order, np.arange(len(own))[None, :] <= last[:, None], axis=1)
                go[np.ix_(tame, own)] = first if seeds else ~first & (ceiling >= floors[tame, None])
            for j in np.flatnonzero(go.any(axis=0)):
                rows = np.flatnonzero(go[:, j])
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ring[j]], pa.int32()), pa.array([packed(uids[rows], ids[rows], floors[rows], x[rows])], pa.binary())], names=["dim", "ring", "asked"])

    return queries.select("uid", "vec_id", "dim", "v", "floor").mapInArrow(run, VISITS)


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def floor(self, query: int) -> float:
        scores = self.of[query][0] if query in self.of else ()
        return float(scores[-1]) if len(scores) == self.k else -np.inf

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if query in self.of:
            s, i = self.of[query]
            if len(s) == self.k:
                fits = scores >= s[-1]
                scores, ids = scores[fits], ids[fits]
            scores, ids = np.r_[s, scores], np.r_[i, ids]
        elif len(scores) > 4 * self.k:
            least = np.partition(scores, -self.k)[-self.k]
            fits = scores >= least
            scores, ids = scores[fits], ids[fits]
        order = np.lexsort((ids, ~scores))  # unlike -scores, ~scores can't leave the range
        self.of[query] = scores[order[: self.k]], ids[order[: self.k]]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By whole numbers of any size, cut to the range of a long."""
    mine = [int(a) for a in q]
    return np.array([min(HIGHEST, max(LOWEST, sum(a * int(b) for a, b in zip(mine, row)))) for row in x], np.int64)


def search(visited: DataFrame, stored: DataFrame, spaces: dict[int, Space], k: int) -> DataFrame:
    """The k best rows of each query in each task, over the blocks of visited rings; and a row that says how many pairs
    were scored."""
    shared = visited.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names, pairs, asked, last = Best(k), {}, 0, None, None
        for b in batches:
            for dim, ring, data, lows, highs, n, uids, ids, vectors in zip(*(c for c in b.columns)):
                dim, ring, n, data = dim.as_py(), ring.as_py(), n.as_py(), data.as_buffer()
                if last is None or not data.equals(last):
                    last, asked = data, unpacked(data, dim)
                    tame = bool((np.linalg.norm(asked[3], axis=1) < EXACT).all())
                    bounds = Bounds(asked[3], shared.value[dim]) if ring != APART else None
                q_uid, q_id, floor, q = asked
                if bounds is None:
                    rows = np.arange(len(q))
                else:
                    now = np.maximum(floor, [best.floor(int(u)) for u in q_uid])
                    rows = np.flatnonzero(bounds.above(np.array([lows.as_py()]), np.array([highs.as_py()]))[:, 0] >= now)
                x, uid, vec = np.frombuffer(vectors.as_buffer(), np.float64).reshape(n, dim), np.frombuffer(uids.as_buffer(), np.int64), np.frombuffer(ids.as_buffer(), np.int64)
                plain = tame and (bounds is not None or bool((np.linalg.norm(x, axis=1) < EXACT).all()))
                pairs += len(rows) * n
                for some in np.array_split(rows, len(rows) // 256 + 1):
                    scores = np.rint(q[some] @ x.T).astype(np.int64) if plain else [exact_scores(q[j], x) for j in some]
                    for j, mine in zip(some, scores):
                        others = uid != q_uid[j]
                        names[int(q_uid[j])] = int(q_id[j])
                        best.add(int(q_uid[j]), *((mine, vec) if others.all() else (mine[others], vec[others])))
        rows = [(u, names[u], int(i), int(s), None) for u, (scores, got) in best.of.items() for s, i in zip(scores, got)]
        if pairs:
            rows.append((None, None, None, None, pairs))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 5)], names=[c.split()[0] for c in FOUND.split(", ")])

    both = visited.join(stored, ["dim", "ring"]).select("dim", "ring", "asked", "lows", "highs", "n", "uids", "ids", "vectors")
    return both.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    return found.where("query_uid is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ring_facts(stored: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """By number of components: the rings, how many vectors they hold, and [ring, pivot] the least and the greatest
    distances. The ring without pivots comes first and has no distances."""
    sizes = {(r["dim"], r["ring"]): r["n"] for r in stored.groupBy("dim", "ring").agg(F.sum("n").alias("n")).collect()}
    each = stored.select("dim", "ring", F.posexplode(F.arrays_zip("lows", "highs")).alias("pivot", "x"))
    spans: dict = {}
    for r in each.groupBy("dim", "ring", "pivot").agg(F.min("x.lows").alias("low"), F.max("x.highs").alias("high")).collect():
        spans.setdefault((r["dim"], r["ring"]), {})[r["pivot"]] = (r["low"], r["high"])
    out = {}
    for dim in {d for d, _ in sizes}:
        rings = sorted(r for d, r in sizes if d == dim)
        far = np.array([[spans[dim, r][p] for p in range(len(spans[dim, r]))] for r in rings if r != APART]).reshape(-1, 2)
        own = sum(r != APART for r in rings)
        out[dim] = np.array(rings), np.array([sizes[dim, r] for r in rings]), *far.T.reshape(2, own, -1 if own else 0)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", told: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score). ``is_query`` is a condition on the id, named vec_id. ``told`` is given the numbers
    of queries, of vectors and of pairs that were scored."""
    keyed, spaces = index(vectors, id_col, vector_col)
    stored = Scratch(blocks(keyed, spaces), "blocks").df
    plan = ring_facts(stored)
    queries = Scratch(keyed.where(is_query).select("uid", "vec_id", "dim", "ring", "v").repartitionByRange("dim", "ring", "uid").sortWithinPartitions("dim", "ring", "uid"), "queries").df
    one = Scratch(search(visits(queries.withColumn("floor", F.lit(None).cast("double")), spaces, plan, k, True), stored, spaces, k), "seeds").df
    floors = Scratch(ranked(one, k).where(F.col("rank") == k).select(F.col("query_uid").alias("uid"), F.col("score").cast("double").alias("floor")), "floors").df
    two = Scratch(search(visits(queries.join(floors, "uid", "left"), spaces, plan, k, False), stored, spaces, k), "rest").df
    if told is not None:
        told |= {"queries": queries.count(), "vectors": keyed.count(), "pairs": one.unionByName(two).agg(F.sum("pairs")).first()[0] or 0}
    none = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return ranked(one.unionByName(two), k).select(none("query_id"), F.col("rank").cast("int").alias("rank"), none("vec_id"), "score")
