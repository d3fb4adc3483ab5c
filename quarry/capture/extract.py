"""Captures of many files, in Arrow batches: one pass over each text for all keys of a query."""

from __future__ import annotations

import time
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.lines import RANGE
from quarry.sources.policy import LEFT

from .profiles import captures, select, supported_keys

CAPTURES = f"array<struct<key:string,text:string,range:{RANGE}>>"
FIELDS = ("start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col")
ARROW_RANGE = pa.struct([(n, pa.int64() if n.endswith("byte") else pa.int32()) for n in FIELDS])
ARROW_CAPTURE = pa.struct([("key", pa.string()), ("text", pa.string()), ("range", ARROW_RANGE)])
ARROW = pa.list_(ARROW_CAPTURE)
#: Bytes of text and files that are tokenized at a time; what Python holds doesn't grow with Spark's batches.
SLICE_BYTES, SLICE_FILES = 1 << 20, 1000


class Clock:
    """Says whether a file's seconds are used up, and keeps that it has said so."""

    def __init__(self, budget: float | None):
        self.end, self.over = None if budget is None else time.monotonic() + budget, False

    def __call__(self) -> bool:
        self.over = self.over or self.end is not None and time.monotonic() > self.end
        return self.over


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The files of a batch, as many at a time as fit the limits; one at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        size = max(1, min(SLICE_FILES, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at))
        yield batch.slice(at, size)
        at += size


class Found:
    """Captures of files that follow each other, by column: numbers take their bytes, no objects."""

    def __init__(self) -> None:
        self.keys, self.texts, self.ends = [], [], [0]
        self.ranges = [array("q" if n.endswith("byte") else "i") for n in FIELDS]

    def add(self, found: Iterator[tuple]) -> None:
        """Of the next file."""
        for key, text, numbers in found:
            self.keys.append(key)
            self.texts.append(text)
            for column, n in zip(self.ranges, numbers):
                column.append(n)
        self.ends.append(len(self.keys))

    def arrow(self) -> pa.Array:
        ranges = pa.StructArray.from_arrays([pa.array(np.asarray(x), f.type) for x, f in zip(self.ranges, ARROW_RANGE)], fields=list(ARROW_RANGE))
        flat = pa.StructArray.from_arrays([pa.array(self.keys, pa.string()), pa.array(self.texts, pa.string()), ranges], fields=list(ARROW_CAPTURE))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), flat, type=ARROW)


def with_captures(files: DataFrame, keys: tuple[str, ...], override: str | None = None, strict: bool = False, budget: float | None = None, deadline: float | None = None) -> DataFrame:
    """Adds ``profile``, ``supported`` (the keys that the file's language has), ``captures`` and ``exhausted``. ``strict``: a
    file without a language ends the search. ``budget``: seconds for a file; what it has given until then counts, and it is
    exhausted. ``deadline``, in seconds of the clock: files whose turn comes later are left."""
    schema = T.StructType([*files.schema, *T.StructType.fromDDL(f"profile string, supported array<string>, captures {CAPTURES}, exhausted boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text")):
            names = b.schema.names
            profiles, supported, found, exhausted = [], [], Found(), []
            states = b.column(names.index("content_state")).to_pylist()
            for k, (path, ext, text) in enumerate(zip(*(b.column(names.index(c)).to_pylist() for c in ("display_path", "ext", "text")))):
                if deadline and time.time() > deadline:
                    states[k], text = LEFT, ""
                clock = Clock(budget)
                p = select(ext, text or "", override)
                if strict and p is None:
                    raise ValueError(f"Unsupported language for semantic predicates: {path}")
                profiles.append(p and p.id)
                supported.append([k for k in keys if k in supported_keys(p)] if p else [])
                found.add(captures(p, text or "", keys, None if budget is None else clock) if p else ())
                exhausted.append(clock.over)
            columns = [pa.array(states, c.type) if n == "content_state" else c for n, c in zip(names, b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(profiles, pa.string()), pa.array(supported, pa.list_(pa.string())), found.arrow(), pa.array(exhausted, pa.bool_())], names=[*names, "profile", "supported", "captures", "exhausted"])

    return files.mapInArrow(run, schema)


def catalog(spark) -> DataFrame:
    """A row for each language key and what it captures."""
    from .profiles import PROFILES

    rows = [(p.id, p.name, p.tier, k) for p in PROFILES for k in sorted(supported_keys(p))]
    return spark.createDataFrame(rows, "profile string, name string, tier string, key string").select("profile", "name", "tier", F.col("key"))
