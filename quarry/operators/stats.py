"""Counters over the stages of a search, hotspots and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.capture.profiles import BY_KEY, PROFILES
from quarry.operators.results import matched_lines
from quarry.sources.policy import BINARY, LEFT, LOSSY, SECRET, TOO_LARGE, UNREADABLE


def counters(search) -> DataFrame:
    """One row. Candidates and prefiltered files are counted over the listing alone, without reading content."""
    listing = search.candidates.agg(F.count("*").alias("candidate_files"), F.count_if(search._prefilter()).alias("prefiltered_files"))
    r = search.results
    n = F.size("hunks")
    found = r.agg(
        F.count("*").alias("matched_files"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("matched_ranges"),
        F.count_if(n == 0).alias("whole_file_results"),
        F.count_if(n > 0).alias("ranged_results"),
        F.coalesce(F.sum(F.size(matched_lines(F.col("hunks")))), F.lit(0)).cast("long").alias("matched_lines"),
        F.count_if(F.col("content_state") == "skipped:too_large").alias("suppressed_too_large"),
        F.count_if(F.col("content_state") == "skipped:binary").alias("suppressed_binary"),
        F.count_if(F.col("content_state") == "skipped:secret_like").alias("suppressed_secret_like"),
    )
    both = listing.unionByName(found, allowMissingColumns=True)  # one row each
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def hotspots(files: DataFrame, top: int = 10) -> DataFrame:
    """The directories of the first level, and files of the root, with the most files."""
    first = F.substring_index(F.coalesce("root_relative_path", "display_path"), "/", 1)
    return files.groupBy(first.alias("path")).agg(F.count("*").alias("candidate_files")).orderBy(F.desc("candidate_files"), "path").limit(top)


def inventory(files: DataFrame) -> DataFrame:
    """Files by extension, with the language that captures come from."""
    known = files.sparkSession.createDataFrame([(k, p.id) for k, p in BY_KEY.items()], "ext string, semantic_profile string")
    by = files.where("ext is not null").groupBy(F.lower("ext").alias("ext")).agg(F.count("*").alias("files"))
    return by.join(F.broadcast(known), "ext", "left")  # one row for each language key


def dominant_extensions(files: DataFrame, top: int = 10) -> DataFrame:
    """The first extensions in alphabetical order."""
    return inventory(files).orderBy("ext").limit(top)


def skip_counts(listing: DataFrame) -> DataFrame:
    """Files of a directory that discovery left out, by reason."""
    return listing.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("files"))


STATES = {"loaded_lossy": LOSSY, "too_large": TOO_LARGE, "binary": BINARY, "secret_like": SECRET, "unreadable": UNREADABLE, "deadline": LEFT}


def telemetry(columns: list[str]) -> list[Column]:
    """Figures of the files that a search looks into, taken while it does. With captures: of each language the files, the
    captures and the files whose seconds were used up."""
    out = [F.count("*").alias("evaluated_files"), *(F.count_if(F.col("content_state") == state).alias(f"{name}_files") for name, state in STATES.items())]
    if "changed" in columns:
        out.append(F.count_if(F.col("changed").isNotNull()).alias("changed_files"))
    if "profile" in columns:
        out.append(F.count_if(F.col("profile").isNull()).alias("files_without_language"))
        for p in PROFILES:
            mine = F.col("profile") == p.id
            out += [F.count_if(mine).alias(f"files_{p.id}"), F.coalesce(F.sum(F.when(mine, F.size("captures"))), F.lit(0)).alias(f"captures_{p.id}"), F.count_if(mine & F.col("exhausted")).alias(f"exhausted_{p.id}")]
    return out


def told(figures: dict) -> dict:
    """The same as a tree; languages without files are left out."""
    out = {k: v for k, v in figures.items() if not k.startswith(("files_", "captures_", "exhausted_")) or k == "files_without_language"}
    by = {p.id: {k: figures[f"{k}_{p.id}"] for k in ("files", "captures", "exhausted")} for p in PROFILES if figures.get(f"files_{p.id}")}
    return out | ({"languages": by} if "files_without_language" in figures else {})


#: Fixed value: exclusions that are told one by one.
EXCLUSIONS = 25


def exclusions(listing: DataFrame, most: int = EXCLUSIONS) -> DataFrame:
    """The first files, by path, that discovery left out or couldn't read: why, where the rule stands, and the rule."""
    told = listing.where("skip_reason IS NOT NULL").select(F.col("root_relative_path").alias("path"), F.col("skip_reason").alias("reason"), F.col("skip_source").alias("source"), F.col("skip_rule").alias("rule"))
    return told.orderBy("path").limit(most)


def tokenized(search) -> DataFrame:
    """Files that captures were sought in, by language, and how many captures there were; null: files without a language."""
    each = search._evaluated(search.prefiltered, strict=False)
    return each.groupBy("profile").agg(F.count("*").alias("files"), F.sum(F.size("captures")).cast("long").alias("captures"))
