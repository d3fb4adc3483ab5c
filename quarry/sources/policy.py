"""What is read of a file's content: gates for size, binary data, invalid text and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.lines import bound

#: Limits in bytes, and the texts that mark a file as secret, lower-cased.
MAX_BYTES, PROBE_BYTES = 10 * 1024 * 1024, 8192
SECRET_MARKS = (
    "-----begin private key-----",
    "aws_secret_access_key",
    "aws_access_key_id",
    "secret_key=",
    "secret-key=",
    "authorization: bearer",
    "eyj",
    "private_key",
)
LOADED, LOSSY, TOO_LARGE, BINARY, SECRET = "loaded", "loaded_lossy", "skipped:too_large", "skipped:binary", "skipped:secret_like"
#: A file that could not be read when its turn came; one whose turn came when the deadline was over.
UNREADABLE, LEFT = "skipped:unreadable", "skipped:deadline"
#: What the reader says of a file that it left for the deadline.
TOO_LATE = "the deadline was over"


def looks_secret(low: Column) -> Column:
    """Of a lower-cased text."""
    out = F.lit(False)
    for mark in SECRET_MARKS:
        out = out | low.contains(mark)
    return out


def has_nul(content: Column) -> Column:
    head = F.decode(F.substring(content.cast("binary"), 1, PROBE_BYTES), "ISO-8859-1")
    return F.instr(head, "\x00") > 0


def gated(files: DataFrame, fail_fast: bool = False, late: Column | None = None, policy: bool = True) -> DataFrame:
    """Adds ``text``, which is empty where the content is held back, ``low``, the same lower-cased, and ``content_state``.

    Each is computed once: a value that a lambda takes is bound, and what is generated stays where it is, so that no
    condition on it is pushed below and computed again. The size gate comes first. ``late``: rows that are left as they
    are, a condition that may differ from row to row. ``policy``: False leaves out the gates for size, binary data and secrets.
    """
    if late is not None:
        files = files.withColumn("late_", late)
    textual = "text" in files.columns
    raw = F.coalesce(F.col("text"), F.lit("")) if textual else F.coalesce(F.col("content"), F.lit(b""))
    error = F.col("load_error") if "load_error" in files.columns else F.lit(None).cast("string")
    left = F.coalesce(error == TOO_LATE, F.lit(False)) | (F.col("late_") if late is not None else F.lit(False))
    if fail_fast and "load_error" in files.columns:
        error = F.when(error.isNotNull() & (error != TOO_LATE), F.raise_error(F.concat(F.lit("Unreadable file "), "display_path", F.lit(": "), error)).cast("string"))
    held = F.when((F.col("size_bytes") <= MAX_BYTES) & ~left if policy else ~left, raw)

    def states(decoded: Column, valid: Column) -> Column:
        whole = F.when(valid, decoded).otherwise(F.make_valid_utf8(decoded))
        return bound(whole, lambda text: bound(F.lower(text), lambda low: state(text, low, valid)))

    def state(text: Column, low: Column, valid: Column) -> Column:
        out = F.when(left, LEFT).when(error.isNotNull(), UNREADABLE).when(text.isNull(), TOO_LARGE)
        if policy and not textual:
            out = out.when(has_nul(held), BINARY)
        elif policy:
            out = out.when(F.instr(F.substring(text, 1, PROBE_BYTES), "\x00") > 0, BINARY)
        out = (out.when(looks_secret(low), SECRET) if policy else out).when(~valid, LOSSY).otherwise(LOADED)
        return bound(out, lambda x: F.struct(F.when(x.startswith("loaded"), text).otherwise("").alias("text"), F.when(x.startswith("loaded"), low).otherwise("").alias("low"), x.alias("content_state")))

    made = bound(held.cast("string"), lambda decoded: bound(F.coalesce(F.is_valid_utf8(decoded), F.lit(True)), lambda valid: states(decoded, valid)))
    rest = [c for c in files.columns if c not in ("text", "content", "load_error", "late_")]
    return files.select(*rest, F.inline(F.array(made)))
