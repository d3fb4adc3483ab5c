"""Lines of a text as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<start_byte:bigint,end_byte:bigint,start_row:int,start_col:int,end_row:int,end_col:int>"
HUNKS = f"array<{RANGE}>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: what a lambda refers to from outside would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines(text: Column) -> Column:
    """Split at line feeds; one carriage return before a line feed goes; no empty line after the last line feed."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    inner = F.when(F.endswith(plain, F.lit("\n")), F.left(plain, F.length(plain) - 1)).otherwise(plain)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(inner, "\n", -1))


def line_count(text: Column) -> Column:
    """How many there are, without making them."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def starts_of(data: bytes, drift: bool) -> np.ndarray:
    """Byte offsets at which lines start. ``drift``: as if each line's end took one byte, whatever it took."""
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    starts = np.r_[0, feeds + 1]
    if len(starts) and starts[-1] == len(data):
        starts = starts[:-1]
    if drift and b"\r\n" in data:
        raw = np.frombuffer(data, np.uint8)
        returns = np.r_[0, np.cumsum([k > 0 and raw[k - 1] == 13 for k in feeds])][: len(starts)]
        starts = starts - returns
    return starts


def line_starts(text: Column, drift: bool = False) -> Column:
    """The only part of line search that leaves the JVM: offsets as a running sum, in one pass over the bytes."""

    @F.arrow_udf("array<bigint>")
    def starts(column: pa.Array) -> pa.Array:
        return pa.array([starts_of((t or "").encode(), drift) for t in column.to_pylist()], pa.list_(pa.int64()))

    return starts(text)


def line_range(row: Column, start: Column, line: Column) -> Column:
    size = F.octet_length(line)
    return F.struct(start.alias("start_byte"), (start + size).alias("end_byte"), row.cast("int").alias("start_row"), F.lit(0).alias("start_col"), row.cast("int").alias("end_row"), size.cast("int").alias("end_col"))


def no_hunks() -> Column:
    return F.array().cast(HUNKS)


def truncated(text: Column, size: int) -> Column:
    """At most ``size`` bytes, ending with a whole character."""
    data = text.cast("binary")
    cut = [F.substring(data, 1, max(0, size - k)).cast("string") for k in range(4)]
    whole = F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cut), F.lit(""))
    return F.when(F.octet_length(text) <= size, text).otherwise(whole)


def line_ending(text: Column) -> Column:
    return F.when(text.contains("\r\n"), "crlf").when(text.contains("\n"), "lf").when(text.contains("\r"), "cr").otherwise("none")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")
