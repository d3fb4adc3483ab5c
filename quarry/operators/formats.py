"""Rendering of a page of results on the driver, and writing of whole results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.lines import lines

from . import results as R

FORMATS = ("hunks", "summary", "diagnostics", "matches", "snippets", "markdown", "json", "paths", "cat", "find")
UNITS = ("B", "K", "M", "G")


def human_size(n: int) -> str:
    if n < 1024:
        return f"{n}B"
    size, unit = float(n), 0
    while size >= 1024 and unit < 3:
        size, unit = size / 1024, unit + 1
    return f"{size:.1f}{UNITS[unit]}"


def escaped(text: str) -> str:
    """Control characters made visible."""
    return "".join(c if c.isprintable() else {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, f"\\x{ord(c):02x}") for c in text)


def notice(state: str) -> str:
    return f"[content {state}]"


def time_text(millis: int | None, style: str = "utc") -> str:
    if millis is None:
        return "-"
    if style == "unix":
        return str(millis // 1000)
    at = datetime.fromtimestamp(millis / 1000, timezone.utc)
    at = at.astimezone() if style == "local" else at
    return at.isoformat() if style == "iso" else at.strftime("%Y-%m-%d %H:%M:%S")


def render(search, form: str = "hunks", max_results: int | None = R.MAX_RESULTS, offset: int = 0, context: int = R.CONTEXT, line_numbers: bool = False, time_style: str = "utc") -> str:
    """One page as text: only its rows come to the driver."""
    if form not in FORMATS:
        raise ValueError(f"Unknown format: '{form}'")
    return "\n".join([*_lines(search, form, max_results, offset, context, line_numbers, time_style), *(footer(search, max_results, offset) if form in FOOTED else [])])


#: Bytes of text of a page that the driver takes.
DRIVER_BYTES = 64 << 20
#: Formats for people, which end with what the page leaves out.
FOOTED = ("hunks", "summary", "matches", "snippets")


def footer(search, max_results: int | None, offset: int) -> list[str]:
    """Whether there is more than the page, and how much of it was held back."""
    out = []
    if max_results is not None and R.page(search.matched, 1, offset + max_results, None).head(1):
        out.append(f"-- more files match: --offset {offset + max_results}")
    states = R.page(search.results.select(*R.ORDER, "content_state"), max_results, offset, None).groupBy("content_state").count().orderBy("content_state").collect()
    return out + [f"-- {r['count']} files {r['content_state']}" for r in states if r["content_state"] != "loaded"]


def _lines(search, form: str, max_results: int | None, offset: int, context: int, numbers: bool, time_style: str) -> Iterator[str]:
    if form in ("paths", "find"):
        for r in R.page(search.matched, max_results, offset, None).orderBy("position").collect():
            yield r["display_path"] if form == "paths" else f"{r['permissions']} {human_size(r['size_bytes']):>8} {time_text(r['modified_unix_millis'], time_style)} {r['display_path']}"
        return
    page = R.page(search.results, max_results, offset, None)
    if form == "summary":
        for r in page.select("position", "display_path", F.size("hunks").alias("n"), "whole", "content_state", "skip_reasons", "changed").orderBy("position").collect():
            yield "\t".join((r["display_path"], str(r["n"]), str(r["whole"]).lower(), r["content_state"], ",".join(remarks(r)) or "-"))
    elif form == "diagnostics":
        rows = page.select("position", "display_path", "content_state", "skip_reasons", "changed").orderBy("position").collect()
        told = [(r["display_path"], x) for r in rows for x in [*([r["content_state"]] if r["content_state"] != "loaded" else []), *remarks(r)]]
        yield f"files: {len(rows)}, diagnostics: {len(told)}"
        yield from (f"{p}: {x}" for p, x in told)
    elif form == "matches":
        for r in R.public_matches(page).orderBy("position").collect():
            yield r["display_path"] if r["matches"] else f"{r['display_path']} [whole file]"
            for m in r["matches"]:
                yield f"  {m['start_line']}:{m['start_column'] + 1}-{m['end_line']}:{m['end_column'] + 1} {escaped(m['text'])}"
    elif form == "snippets":
        last = None
        for r in R.snippets(page.withColumn("display_path", F.col("display_path")), context).orderBy(*R.ORDER[:1], "ord").collect():
            if r["display_path"] != last:
                last = r["display_path"]
                yield last
            yield f"@@ {r['start_line']}-{r['end_line']} @@"
            yield r["text"]
    elif form == "json":
        rows = R.limited_matches(page).select("position", "display_path", "content_state", "whole", "matches", "matches_truncated").orderBy("position").collect()
        more = max_results is not None and bool(R.page(search.matched, 1, offset + max_results, None).head(1))
        yield envelope([{k: v for k, v in r.asDict(recursive=True).items() if k != "position"} for r in rows], truncated=more, next_offset=offset + len(rows) if more else None)
    else:
        # Whole texts come to the driver, so their bytes are bounded as well as their number; the first is always there.
        page = R.page(search.results, max_results, offset, DRIVER_BYTES, size=F.octet_length("text"))
        rows = page.select("position", "display_path", "resolved_path", "ext", "content_state", "hunks", lines(F.col("text")).alias("lines_")).orderBy("position").collect()
        for r in rows:
            yield from _file(r, form, context, numbers)
        if rows and (max_results is None or len(rows) < max_results) and R.page(search.matched, 1, offset + len(rows), None).head(1):
            yield f"-- cut at {human_size(DRIVER_BYTES)} of text: --offset {offset + len(rows)}"


def remarks(r) -> list[str]:
    """What is to be said about a file beside the state of its content."""
    return [*r["skip_reasons"], *([f"changed:{r['changed']}"] if r["changed"] else [])]


def _file(r, form: str, context: int, numbers: bool) -> Iterator[str]:
    shown = [f"{k + 1:>5} | {x}" if numbers else x for k, x in enumerate(r["lines_"])] if r["content_state"].startswith("loaded") else [notice(r["content_state"])]
    if form == "cat":
        yield from shown
    elif form == "markdown":
        yield from (f"File: {r['display_path']}", "---", f"```{r['ext'] or ''}", *shown, "```", "")
    else:
        yield f"File: {r['display_path']}"
        yield "---"
        parts = merged_blocks([(h["start_row"], h["end_row"]) for h in r["hunks"]], len(shown), context) or [(0, len(shown))]
        for k, (a, z) in enumerate(parts):
            if k:
                yield "..."
            yield from shown[a:z]
        yield ""


def merged_blocks(rows: list[tuple[int, int]], total: int, context: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted((max(0, a - context), min(total, z + 1 + context)) for a, z in rows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def envelope(items: list[dict], **more) -> str:
    return json.dumps({"schema_version": 1, "items": items, **more}, default=str, separators=(",", ":"), ensure_ascii=False)


def write(results: DataFrame, path: str, form: str = "json") -> None:
    """Whole results by Spark's writers, with nothing on the driver."""
    flat = R.public_matches(results).select("file_id", "display_path", "whole", "content_state", "matches")
    if form == "paths":
        flat.select(F.col("display_path").alias("value")).write.text(path)
    else:
        flat.write.format(form).save(path)
