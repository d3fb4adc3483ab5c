"""What the operators share: scratch tables, Arrow helpers, distributed numbering."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_own: dict[str, str] = {}


#: Rows of a batch that are worked on at once: texts are long, and what is made of them stands beside them.
BATCH_ROWS = 2000


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``BATCH_ROWS`` at most. Spark bounds a batch's bytes itself."""
    for b in batches:
        for k in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(k, BATCH_ROWS)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of a text column: a longer text is a batch of its own."""
    for b in batches:
        texts = b.column(b.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            stop = max(stop, at + 1)
            yield b.slice(at, stop - at)
            at = stop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


#: Lets Spark delete the files of a write's shuffles once the write has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Within: shuffles go with the query that made them. The session's own setting comes back afterwards."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """A written table: cuts the lineage, so that a lost executor repeats one stage at most. It replaces the shuffles that
    it was made by. ``codec``: wide rows that are read once or twice are written faster by one lighter than zstd."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/quarry-{name}-{uuid.uuid4().hex}"
        with cleaning(self.spark):
            df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_remove_at_exit, self.spark, self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    return Scratch(df, name, codec).df


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, whatever the case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def number_rows(df: DataFrame, key: str, weight: str | None, columns: list[str], start: str, name: str) -> DataFrame:
    """Adds ``start``: for every row, the sum of ``weight`` (null: each row weighs 1) over the rows of the same key before it.

    A key may hold any share of the rows: each task numbers its own rows while the result is written, and only the
    totals of (key, task) are summed over tasks, so no task gathers the rows of a key. The order is that of the tasks
    and of the rows in them; it is fixed by the written table.
    """
    lane, local = fresh("lane", columns), fresh("local", columns)
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(lane, T.LongType()), T.StructField(local, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = task(), {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            codes = b.column(b.schema.get_field_index(key)).dictionary_encode()
            values, idx = codes.dictionary.to_pylist(), codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            values = [*values, None]
            w = np.ones(n, np.int64) if weight is None else b.column(b.schema.get_field_index(weight)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(idx, kind="stable")
            total = np.concatenate([[0], np.cumsum(w[order])])
            edges = np.flatnonzero(np.r_[True, np.diff(idx[order]) != 0])
            out = np.empty(n, np.int64)
            for a, z in zip(edges, [*edges[1:], n]):
                k = values[idx[order[a]]]
                base = seen.get(k, 0)
                out[order[a:z]] = base + total[a:z] - total[a]
                seen[k] = base + int(total[z] - total[a])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, at, np.int64)), pa.array(out)], names=[*b.schema.names, lane, local])

    t = materialise(df.select(*columns).mapInArrow(run, schema), name, "snappy")
    step = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    sums = t.groupBy(key, lane).agg(F.sum(step).cast("long").alias("total"))
    # Written, so that its size is known: else the wide rows are shuffled for the join before it is seen to be small.
    sums = materialise(sums.select(F.col(key).alias("k"), F.col(lane).alias("l"), (F.sum("total").over(Window.partitionBy(key).orderBy(lane)) - F.col("total")).alias("base")), f"{name}-sums")
    joined = t.join(sums, t[key].eqNullSafe(sums["k"]) & (t[lane] == sums["l"]), "left")
    return joined.select(*[t[c] for c in columns], (t[local] + sums["base"]).alias(start))


def pass_through(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """All columns in and out, whatever they are called; ``change`` filters or replaces within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield change(b)

    return df.mapInArrow(run, df.schema)
