"""What is made of matching files: matches, snippets, context blocks, pages, limits and statuses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.lines import bound, line_count, line_ending, normalised, truncated

from .ranged import Ranged, after

#: Default limits.
MAX_RESULTS, MAX_TOTAL_BYTES, MATCHES_PER_FILE, MATCH_BYTES, SNIPPET_BYTES, CONTENT_BYTES, CONTEXT = 50, 200_000, 20, 200, 2000, 20_000, 2
ORDER = ("display_path", "resolved_path")


def range_text(hunk: Column, raw: Column) -> Column:
    """The bytes of a range as text; null if they don't start and end with whole characters."""
    data = F.substring(raw, (hunk.start_byte + 1).cast("int"), (hunk.end_byte - hunk.start_byte).cast("int")).cast("string")
    inside = (hunk.start_byte >= 0) & (hunk.end_byte <= F.octet_length(raw)) & (hunk.start_byte <= hunk.end_byte)
    return F.when(inside & F.is_valid_utf8(data), data)


def each(df: DataFrame, keep: tuple[str, ...], array: Column | str, at: str, item: str) -> DataFrame:
    """A row for each element. Outer, so that no condition on the array's size is inferred and computes it again below."""
    return df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())


def public_matches(results: DataFrame) -> DataFrame:
    """Adds ``matches``: lines from 1, columns from 0, texts; ranges that can't be cut out are left out."""
    made = lambda raw: F.transform(
        "hunks",
        lambda h: F.struct(
            (h.start_row + 1).alias("start_line"), (h.end_row + 1).alias("end_line"), h.start_col.alias("start_column"), h.end_col.alias("end_column"),
            h.start_byte.alias("byte_start"), h.end_byte.alias("byte_end"), range_text(h, raw).alias("text"),
        ),
    )
    return results.withColumn("matches", F.filter(bound(F.col("text").cast("binary"), made), lambda m: m.text.isNotNull()))


def matches(results: DataFrame) -> DataFrame:
    """A row for each match, in order."""
    return each(public_matches(results), ("file_id", "display_path"), "matches", "ord", "m").select("file_id", "display_path", "ord", "m.*")


def match_facts(matches: DataFrame) -> DataFrame:
    """Adds to matches, a row each, how many lines and bytes they have, whether more than one line, and their first line."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return matches.withColumns({"line_count": lines, "is_multiline": lines > 1, "byte_len": F.col("byte_end") - F.col("byte_start"), "first_line": F.regexp_replace(F.substring_index("text", "\n", 1), "\r$", "")})


#: What a path is shown as.
PATHS = ("relative", "absolute", "root_relative")


def shown_path(mode: str) -> Column:
    if mode not in PATHS:
        raise ValueError(f"Unknown path display: '{mode}'")
    return {"relative": F.col("display_path"), "absolute": F.col("resolved_path"), "root_relative": F.coalesce("root_relative_path", "display_path")}[mode]


def matched_lines(hunks: Column) -> Column:
    """The distinct lines, from 1, of all ranges."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hunks, lambda h: F.sequence(h.start_row + 1, h.end_row + 1)))))


def summary(results: DataFrame) -> DataFrame:
    return results.select("file_id", "display_path", F.size("hunks").cast("long").alias("matches"), F.size(matched_lines(F.col("hunks"))).cast("long").alias("lines_matched"), "whole", "content_state")


def islands(first: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the half-open ranges of many files, one file after the other: those that touch as one; and how many a file has."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((end, first, owner))
    owner, first, end = owner[order], first[order].astype(np.int64), end[order].astype(np.int64)
    wide = owner * (int(end.max(initial=0)) + 1)  # each file's ranges lie beyond those of the files before
    reach = np.maximum.accumulate(wide + end)
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (wide[1:] + first[1:] > reach[:-1])][: len(owner)]
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:], len(owner)][: len(at)] - 1
    return first[at], reach[last] - wide[last], np.bincount(owner[at], minlength=len(sizes))


def blocks(results: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Line ranges (first row, row past the end) of the matches with their context; ranges that touch are one.

    A batch's files are merged in one pass over their row numbers alone: nothing is shuffled.
    """
    rows = results.select("file_id", "display_path", "hunks", line_count(F.col("text")).alias("n"))
    first = F.transform("hunks", lambda h: F.greatest(h.start_row - context, F.lit(0)))
    end = F.transform("hunks", lambda h: F.least(h.end_row + 1 + context, F.col("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            a, z, n = islands(b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), sizes)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            nth = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), *(pa.array(x.astype(np.int32)) for x in (nth, a, z))], names=["file_id", "display_path", "block", "first_row", "end_row"])

    wanted = "file_id string, display_path string, block int, first_row int, end_row int"
    return rows.select("file_id", "display_path", first.alias("first"), end.alias("end")).mapInArrow(run, wanted)


def snippets(results: DataFrame, context: int = CONTEXT, max_bytes: int = SNIPPET_BYTES, per_file: int | None = MATCHES_PER_FILE, normalise: bool = False, keep: tuple[str, ...] = ("file_id", "display_path"), held: Column | None = None) -> DataFrame:
    """A row for each match: the lines around it. Only they, and the columns to keep, leave the file's row. ``held``: files
    that have a row without lines, number -1, if they have no match."""
    some = F.slice("hunks", 1, per_file) if per_file is not None else F.col("hunks")

    def around(h: Column, all_lines: Column, n: Column) -> Column:
        first, last = F.greatest(h.start_row - context, F.lit(0)), F.least(h.end_row + context, n - 1)
        body = F.array_join(F.slice(all_lines, first + 1, last - first + 1), "\n")
        return F.struct(
            (first + 1).alias("start_line"), (last + 1).alias("end_line"), (h.start_row + 1).alias("match_start_line"), (h.end_row + 1).alias("match_end_line"),
            (normalised(body) if normalise else body).alias("body"),
        )

    made = bound(F.split("text", "\n", -1), lambda x: bound(line_count(F.col("text")), lambda n: F.transform(some, lambda h: around(h, x, n))))
    made = made if held is None else F.when(held & (F.size("hunks") == 0), F.array(F.lit(None))).otherwise(made)
    out = each(results, keep, made, "ord", "s").select(*keep, F.when(F.col("s").isNull(), -1).otherwise(F.col("ord")).alias("ord"), "s.*")
    return out.select("*", F.when(F.col("body").isNotNull(), truncated(F.col("body"), max_bytes)).alias("text"), (F.octet_length("body") > max_bytes).alias("text_truncated"), line_ending(F.col("body")).alias("line_ending")).drop("body")


def limited_matches(results: DataFrame, per_file: int = MATCHES_PER_FILE, max_bytes: int = MATCH_BYTES) -> DataFrame:
    """``matches`` with both limits applied, and whether they cut anything."""
    full = public_matches(results)
    short = F.transform(F.slice("matches", 1, per_file), lambda m: m.withField("text_truncated", F.octet_length(m.text) > max_bytes).withField("text", truncated(m.text, max_bytes)))
    return full.withColumn("matches_truncated", F.size("matches") > per_file).withColumn("matches", short)


def full_content(results: DataFrame, max_bytes: int = CONTENT_BYTES) -> DataFrame:
    return results.select("file_id", "display_path", truncated(F.col("text"), max_bytes).alias("content"), (F.octet_length("text") > max_bytes).alias("content_truncated"), "content_state")


def item_bytes(items: DataFrame) -> Column:
    """The size an item is counted with: that of its JSON form."""
    return F.octet_length(F.to_json(F.struct(*items.columns)))


def page(items: DataFrame, max_results: int | None = MAX_RESULTS, offset: int = 0, max_total_bytes: int | None = MAX_TOTAL_BYTES, order: tuple[str, ...] = ORDER, size: Column | None = None, key: tuple | None = None) -> DataFrame:
    """The items of a page in order, with ``position`` from 0; the first is always there, whatever its size.

    ``key``: the page begins after the item with this key, at position ``offset``; else it begins with item ``offset``.
    Only the page's rows, or those before them where no key is given, reach the window: they are taken by a top-k before.
    Without ``max_results`` there may be any number: they are written in ranges, and each range is numbered for itself.
    """
    weight = item_bytes(items) if size is None else size
    rest = items if key is None else items.where(after(order, key))
    skip = offset if key is None else 0
    if max_results is None:
        out = Ranged(rest, order, weight).numbered(skip, max_total_bytes)
        return out if key is None else out.withColumn("position", F.col("position") + offset)
    top = rest.orderBy(*order).limit(skip + max_results)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("position") >= skip)
    if max_total_bytes is not None:
        sized = numbered.withColumn("bytes_", weight)
        total = F.sum("bytes_").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        numbered = sized.withColumn("total_", total).where((F.col("position") == skip) | (F.col("total_") <= max_total_bytes)).drop("bytes_", "total_")
    return numbered if key is None else numbered.withColumn("position", F.col("position") + offset)


def status(truncated_: Column, errors: Column, results: Column, suppressed: Column) -> Column:
    return F.when(truncated_, "truncated").when(errors > 0, "partial").when((results > 0) & (suppressed == results), "policy_suppressed").otherwise("full")


def fingerprint(files: DataFrame) -> DataFrame:
    """A token of the state that a file was seen in."""
    parts = F.concat_ws(":", "size_bytes", F.coalesce(F.col("modified_unix_millis").cast("string"), F.lit("")), "readonly", F.coalesce(F.col("device_id").cast("string"), F.lit("")), F.coalesce(F.col("inode").cast("string"), F.lit("")))
    return files.withColumn("fingerprint", F.coalesce("stable_token", parts))


def content_fingerprint(text: Column) -> Column:
    """A token of a content, whatever file it is in."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose snapshot differs between two listings: changed, gone or new."""
    snapshot = ["size_bytes", "modified_unix_millis", "readonly", "permissions", "stable_token", "device_id", "inode"]
    a = before.select("resolved_path", F.struct(*snapshot).alias("was"))
    b = after.select("resolved_path", F.struct(*snapshot).alias("is_"))
    both = a.join(b, "resolved_path", "full_outer")
    kind = F.when(F.col("is_").isNull(), "gone").when(F.col("was").isNull(), "new").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("is_"))).select("resolved_path", kind.alias("drift"))
