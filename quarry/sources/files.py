"""The one table that queries run over: files, real or made from rows of a table."""

from __future__ import annotations

import json
import os
import stat
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.query import Node

from .ignore import global_rules
from .inversion import EPOCH, STEP, Layout, Paths, TreePaths, component, narrowed
from .policy import MAX_BYTES, TOO_LATE
from .tree import FILES, FORMAT, PUSHDOWN, Tree

DEFAULT_DEPTH = 100


@dataclass(frozen=True)
class Corpus:
    """``files`` has the columns of ``FILES``, and ``content`` (binary) or ``text``, or ``load`` to add ``content``. What is
    given as a function is made anew at each use."""

    made: DataFrame | Callable[[], DataFrame]
    root: str
    load: Callable[[DataFrame, float | None, int | None], DataFrame] | None = None
    #: Of a real directory: every file found with the reason why it was left out, or null.
    found: Callable[[], DataFrame] | None = None
    #: What conditions on paths say about the columns of ``source``, and how files are made of it.
    layout: Layout | None = None
    source: DataFrame | None = None
    build: Callable[[DataFrame], DataFrame] | None = None
    #: Columns of ``files`` that no result shows.
    internal: tuple[str, ...] = ()

    @property
    def files(self) -> DataFrame:
        return self.made() if callable(self.made) else self.made

    @property
    def listing(self) -> DataFrame | None:
        return self.found() if self.found else None

    def narrowed(self, node: Node | bool, context) -> DataFrame:
        """The files that a tree of metadata predicates can hold for, or more: those that scans can tell from the rest."""
        condition = narrowed(node, self.layout, context) if self.layout else None
        if condition is None:
            return self.files
        return self.build(self.source.where(condition)) if self.build else self.files.where(condition)

    def with_content(self, files: DataFrame, deadline: float | None = None, limit: int | None = MAX_BYTES) -> DataFrame:
        return self.load(files, deadline, limit) if self.load else files

    @property
    def has_text(self) -> bool:
        return "text" in self.files.columns


def path_columns(path: Column, root: str) -> dict[str, Column]:
    """What follows from a path relative to the root."""
    name = F.substring_index(path, "/", -1)
    return {
        "root": F.lit(root),
        "display_path": path,
        "resolved_path": F.concat(F.lit(root.rstrip("/") + "/"), path),
        "root_relative_path": path,
        "resolution": F.lit("canonical"),
        "name": name,
        "ext": F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0, F.substring_index(name, ".", -1)),
        "parent_rel": F.when(F.instr(path, "/") > 0, F.left(path, F.length(path) - F.length(name) - 1)).otherwise(""),
        "depth": F.size(F.split(path, "/")),
    }


def from_table(df: DataFrame, path: Column, text: Column, modified: Column | None = None, root: str = "/corpus", file_id: Column | None = None, keep: tuple[str, ...] = (), layout: Layout | None = None) -> Corpus:
    """Rows of a table as text files. The columns of a query that are not asked for are not read. ``layout``: what paths say
    about the table's columns."""
    stamp = F.lit(None).cast("timestamp") if modified is None else modified.cast("timestamp")
    made = {
        "file_id": (path if file_id is None else file_id).cast("string"),
        **path_columns(path, root),
        "size_bytes": F.octet_length(text).cast("long"),
        "modified_at": stamp,
        "modified_unix_millis": F.unix_millis(stamp),
        "readonly": F.lit(False),
        "permissions": F.lit("-rw-r--r--"),
        "file_type": F.lit("file"),
        "stable_token": F.lit(None).cast("string"),
        "device_id": F.lit(None).cast("long"),
        "inode": F.lit(None).cast("long"),
        "text": text,
    }
    build = lambda rows: rows.select(*(c.alias(n) for n, c in made.items()), *keep)
    return Corpus(build(df), root, layout=layout, source=df, build=build)


def synthetic_time(number: Column) -> Column:
    """A fixed time for a row without one: hours after the first of January 2024, UTC."""
    return F.timestamp_seconds(F.lit(EPOCH) + number * STEP)


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", component(F.col("lang")), component(F.col("source")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return from_table(df, path, F.col("text"), synthetic_time(F.col("doc_id")), "/documents", F.col("doc_id"), layout=Paths(("lang", "source"), "doc_id", ".txt"))


def pages(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return from_table(df, F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), synthetic_time(F.col("page_id")), "/web", F.col("page_id"), layout=Paths(("=pages",), "page_id", ".html"))


def conversations(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = F.concat(F.col("turn").cast("string"), F.lit("_"), "role", F.lit(".md"))
    return from_table(df, F.concat_ws("/", F.col("conv_id").cast("string"), name), F.col("text"), synthetic_time(F.col("conv_id")), "/conversations")


def benchmark(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return from_table(df, F.concat(F.lit("benchmark/"), F.col("item_id").cast("string"), F.lit(".txt")), F.col("text"), synthetic_time(F.col("item_id")), "/benchmark", F.col("item_id"), layout=Paths(("=benchmark",), "item_id", ".txt"))


def events(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = F.concat_ws("/", component(F.col("event_type")), F.concat(F.col("event_id").cast("string"), F.lit(".json")))
    return from_table(df, path, F.col("props"), F.col("ts"), "/events", F.col("event_id"), layout=Paths(("event_type",), "event_id", ".json", "ts"))


def from_rows(spark: SparkSession, rows: list[tuple], root: str = "/made") -> Corpus:
    """(path, text or bytes[, time]) tuples as files."""
    data = [(p, c if isinstance(c, bytes) else c.encode(), t[0] if t else None) for p, c, *t in rows]
    df = spark.createDataFrame(data, "p string, content binary, t timestamp")
    made = from_table(df.withColumn("x", F.lit("")), F.col("p"), F.col("content"), F.col("t"), root).files
    return Corpus(made.withColumnRenamed("text", "content"), root)


def snapshot(info: os.stat_result) -> tuple:
    return info.st_size, info.st_mtime_ns // 1_000_000, not info.st_mode & 0o222, stat.filemode(info.st_mode), info.st_dev, info.st_ino


SNAPSHOT = ("size", "time", "readonly", "mode", "device", "node")


def read_small(path: str, listed: tuple | None = None, limit: int | None = MAX_BYTES) -> tuple[bytes | None, str | None, str | None]:
    """The content, or why it can't be read, and what is not as it was listed or changed meanwhile. What has grown beyond
    the limit since it was listed is read no further; None: there is no limit."""
    try:
        with open(path, "rb") as f:
            before = snapshot(os.fstat(f.fileno()))
            content = f.read(-1 if limit is None else limit + 1)
            after = snapshot(os.fstat(f.fileno()))
    except OSError as e:
        return None, e.strerror or type(e).__name__, None
    changed = [n for n, was, x, y in zip(SNAPSHOT, listed or before, before, after) if not was == x == y]
    return content, None, ",".join(changed) or None


def directory(spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False, max_depth: int = DEFAULT_DEPTH, pinned: bool = True) -> Corpus:
    """A directory that the driver and the executors can read; tasks list it (Spark's own listing leaves out names in _ and
    dots). ``pinned``: it is listed once and kept for all searches. Otherwise every search lists it anew, but only what its
    metadata predicates ask for."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"The root '{root}' does not exist or can't be read.")
    spark.dataSource.register(Tree)
    spark.conf.set(PUSHDOWN, "true")
    options = {"root": os.path.realpath(root), "shown": root, "hidden": str(hidden), "no_ignore": str(no_ignore), "max_depth": str(max_depth), "global_rules": json.dumps(() if no_ignore else global_rules())}
    # Spark keeps pushed filters with the relation that they were pushed to, so no two uses share one.
    listing = lambda: spark.read.format(FORMAT).options(**options).load()
    files = lambda: listing().where("skip_reason IS NULL")
    if pinned:
        files = files().persist(StorageLevel.DISK_ONLY)
        files.count()
    return Corpus(files, os.path.realpath(root), read_files, listing, TreePaths(), internal=("ext_low", "skip_reason", "skip_source", "skip_rule"))


def read_files(df: DataFrame, deadline: float | None = None, limit: int | None = MAX_BYTES) -> DataFrame:
    """Adds ``content`` and ``load_error``, and ``changed``: what differs from the listing. What has changed between the
    first look at an open file and the last, or since it was listed, is told apart by size, time, node and mode. Files whose
    turn comes after the deadline, in seconds of the clock, stay unread."""
    import pyarrow as pa

    listed = ("size_bytes", "modified_unix_millis", "readonly", "permissions", "device_id", "inode")

    def run(batches):
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            read = [(None, TOO_LATE, None) if deadline and time.time() > deadline else read_small(p, tuple(was), limit) if limit is None or was[0] <= limit else (None, None, None) for p, was in zip(column("resolved_path"), zip(*map(column, listed)))]
            made = [pa.array([x for x, _, _ in read], pa.binary()), *(pa.array([r[k] for r in read], pa.string()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "content", "load_error", "changed"])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField("content", T.BinaryType()), T.StructField("load_error", T.StringType()), T.StructField("changed", T.StringType())]))
