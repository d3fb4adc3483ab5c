"""Paged requests: limits, status, continuation tokens, sessions, errors."""

from __future__ import annotations

import base64
import json
import time
import zlib
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.capture.profiles import PROFILES, find_profile, supported_keys
from quarry.engine import Engine, SearchError
from quarry.execution import Cancelled, Token, setting, within
from quarry.operators import results as R
from quarry.operators import stats
from quarry.operators.ranged import Ranged, after
from quarry.plans.query import CONTENT_KEYS, KEYS, METADATA_KEYS, REACT_KEYS, QueryError
from quarry.sources.policy import LEFT, UNREADABLE

MODES = ("paths", "summary", "matches", "snippets", "full")


@dataclass(frozen=True)
class Limits:
    """None: without limit."""

    max_results: int | None = R.MAX_RESULTS
    max_total_bytes: int | None = R.MAX_TOTAL_BYTES
    matches_per_file: int | None = R.MATCHES_PER_FILE
    match_bytes: int = R.MATCH_BYTES
    snippet_bytes: int = R.SNIPPET_BYTES
    content_bytes: int = R.CONTENT_BYTES
    max_errors: int = 10


@dataclass(frozen=True)
class Execution:
    """How a request runs: whether an unreadable file ends it, seconds in all, seconds and number of captures of a file."""

    fail_fast: bool = False
    seconds: float | None = None
    capture_seconds: float | None = None
    captures: int | None = None


#: Execution profiles.
EXECUTION = {"interactive": Execution(), "batch": Execution(True, 60.0, 5.0), "agent": Execution(False, 15.0, 1.5, 25)}
#: Seconds beyond its budget after which a request that hasn't ended by itself is cancelled.
GRACE = 20.0


@dataclass(frozen=True)
class Request:
    query: str
    mode: str = "summary"
    offset: int = 0
    context: int = R.CONTEXT
    continuation: str | None = None
    execution: str = "interactive"
    #: "skip_errors" or "fail_fast"; None: as the execution profile says.
    error_mode: str | None = None
    #: Seconds for the whole request; None: as the execution profile says. Files whose turn comes later are errors.
    budget: float | None = None
    #: Seconds for the captures of a file; None: as the execution profile says.
    capture_budget: float | None = None
    path_display: str = "relative"
    #: Whether the response has figures of the files that were looked into, by state and language.
    telemetry: bool = False
    #: Truncated also when exactly max_results items exist, as engines say that don't look one item further.
    eager_truncation: bool = False
    limits: Limits = field(default_factory=Limits)
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Place:
    """Where a page begins: at an item's number, and if it is known after which key."""

    offset: int = 0
    key: tuple | None = None

    @property
    def token(self) -> str:
        if self.key is None:
            return f"offset:{self.offset}"
        return "after:" + base64.urlsafe_b64encode(json.dumps([self.offset, *self.key]).encode()).decode()


def place(token: str) -> Place:
    """Of a continuation token: ``offset:<number>``, or ``after:`` and an item's number and key."""
    head, _, rest = token.partition(":")
    try:
        if head == "offset" and rest.isdigit():
            return Place(int(rest))
        if head == "after":
            offset, *key = json.loads(base64.urlsafe_b64decode(rest.encode()))
            if isinstance(offset, int) and len(key) in (2, 3) and all(isinstance(k, str) for k in key[:2]) and all(isinstance(k, int) for k in key[2:]):
                return Place(offset, tuple(key))
    except ValueError:
        pass
    raise QueryError(f"Invalid continuation token: '{token}'")


def order_of(request: Request) -> tuple[str, ...]:
    return (*R.ORDER, "ord") if request.mode == "snippets" else R.ORDER


def items(search, request: Request) -> DataFrame:
    """The items of the request's mode. Each has a path as the request shows it, and where content was read its state."""
    n = request.limits
    shown = R.shown_path(request.path_display).alias("path")
    told = ("content_state", "changed")
    if request.mode == "paths":
        found = R.fingerprint(search.found)
        return found.select("file_id", shown, "display_path", "resolved_path", "fingerprint", *(c for c in told if c in found.columns))
    r = search.results
    base = ("file_id", shown, "display_path", "resolved_path", *told)
    if request.mode == "summary":
        return r.select(*base, F.size("hunks").alias("match_count"), F.size(R.matched_lines(F.col("hunks"))).alias("total_lines_matched"), "whole")
    if request.mode == "full":
        content = R.truncated(F.col("text"), n.content_bytes)
        return r.select(*base, content.alias("content"), R.content_fingerprint(F.col("text")).alias("fingerprint"), "whole", "skip_reasons")
    per_file = n.matches_per_file if n.matches_per_file is not None else 1 << 30
    if request.mode == "matches":
        return R.limited_matches(r, per_file, n.match_bytes).select(*base, "whole", "matches", "matches_truncated", "skip_reasons")
    held = F.col("content_state").startswith("skipped")
    return R.snippets(r.withColumn("path", shown), request.context, n.snippet_bytes, n.matches_per_file, keep=("file_id", "path", "display_path", "resolved_path", *told), held=held)


def prepared(engine: Engine, request: Request):
    """The search of a request."""
    if request.mode not in MODES:
        raise QueryError(f"Unknown output mode: '{request.mode}'")
    e = EXECUTION[request.execution]
    mode = request.error_mode or ("fail_fast" if e.fail_fast else "skip_errors")
    if mode not in ("skip_errors", "fail_fast"):
        raise QueryError(f"Unknown error mode: '{mode}'")
    seconds = budget_of(request)
    limits = {"max_semantic_matches": e.captures, "semantic_budget": e.capture_seconds if request.capture_budget is None else request.capture_budget, "deadline": None if seconds is None else time.time() + seconds}
    return engine.search(request.query, **{"error_mode": mode, **{k: v for k, v in limits.items() if v is not None}, **request.options})


def budget_of(request: Request) -> float | None:
    return EXECUTION[request.execution].seconds if request.budget is None else request.budget


def run(engine: Engine, request: Request, token: Token | None = None) -> dict:
    """One page as a dict. One item more than the page holds is asked for, which tells whether there is a next page.

    With a budget the items are written first: those of the files that were looked into in time, and which files were not.
    """
    began = time.monotonic()
    start = place(request.continuation) if request.continuation else Place(request.offset)
    search, seconds = prepared(engine, request), budget_of(request)
    # Figures are taken by the first action alone, and whole only if it reads everything: so the items are written first.
    figures = search.watched() if request.telemetry and (search.reads or request.mode != "paths") else None

    def work() -> dict:
        if seconds is None and figures is None:
            return _page(items(search, request), request, start, began)
        stored = written(search, request)
        try:
            out = _page(stored.rows.select(*stored.columns), request, start, began, None if seconds is None else left_of(stored))
        finally:
            stored.drop()
        return out if figures is None else out | {"telemetry": stats.told(figures.get)}

    return within(engine.spark, None if seconds is None else seconds + GRACE, work, token)


def written(search, request: Request) -> Ranged:
    made = items(search, request)
    return Ranged(made, order_of(request), R.item_bytes(made))


def left_of(stored: Ranged) -> DataFrame | None:
    """The files that a deadline left."""
    return stored.rows.where(F.col("content_state") == LEFT) if "content_state" in stored.columns else None


def diagnostics(rows: list, most: int, left: DataFrame | None = None) -> tuple[list[dict], int]:
    """What is to be said about a page's files: errors, then what was held back; at most so many errors, and how many more.
    ``left``: files that a deadline left, page or not."""
    errors, notes, more, seen = [], [], 0, set()
    for r in rows:
        d = r.asDict()
        if d["resolved_path"] in seen:
            continue
        seen.add(d["resolved_path"])
        state = d.get("content_state") or "loaded"
        if state == UNREADABLE:
            errors.append({"level": "error", "kind": "unreadable", "path": d["display_path"], "message": "The file could not be read."})
        elif state != "loaded":
            notes.append({"level": "warn", "kind": state.removeprefix("skipped:"), "path": d["display_path"], "message": f"Content is {state}."})
        if d.get("changed"):
            notes.append({"level": "warn", "kind": "snapshot_drift", "path": d["display_path"], "message": f"The file is not as it was listed: {d['changed']}."})
    if left is not None:
        late = left.select("display_path").distinct()
        some = [r[0] for r in late.orderBy("display_path").limit(most).collect()]
        more = (late.count() if len(some) == most else len(some)) - len(some)
        errors += [{"level": "error", "kind": "deadline", "path": p, "message": "The budget was used up before the file was looked into."} for p in some]
    return errors[:most] + notes, max(0, len(errors) - most) + more


def _page(made: DataFrame, request: Request, start: Place, began: float, left: DataFrame | None = None) -> dict:
    n, order = request.limits, order_of(request)
    if "content_state" in made.columns and budget_of(request) is not None:
        made = made.where(F.col("content_state").isNull() | (F.col("content_state") != LEFT))
    if n.max_results is None:
        rows = R.page(made, None, start.offset, n.max_total_bytes, order, key=start.key).orderBy("position").collect()
        last = tuple(rows[-1][c] for c in order) if rows else None
        cut = "max_total_bytes" if rows and n.max_total_bytes is not None and made.where(after(order, last)).head(1) else None
    else:
        sized = made.withColumn("bytes_", R.item_bytes(made))
        rows = R.page(sized, n.max_results + 1, start.offset, None, order, key=start.key).orderBy("position").collect()
        cut = "max_results" if len(rows) >= n.max_results + (not request.eager_truncation) else None
        rows, total = rows[: n.max_results], 0
        for k, r in enumerate(rows):
            total += r["bytes_"]
            if n.max_total_bytes is not None and k and total > n.max_total_bytes:
                rows, cut = rows[:k], "max_total_bytes"
                break
    suppressed = sum(str(r.asDict().get("content_state", "")).startswith("skipped") for r in rows)
    told, more_errors = diagnostics(rows, n.max_errors, left)
    failed = more_errors or any(x["level"] == "error" for x in told)
    status = "truncated" if cut else "partial" if failed else "policy_suppressed" if rows and suppressed == len(rows) else "full"
    following = Place(start.offset + len(rows), tuple(rows[-1][c] for c in order) if rows else start.key) if cut else None
    return {
        "items": [{k: v for k, v in r.asDict(recursive=True).items() if k != "bytes_"} for r in rows],
        "status": status,
        "diagnostics": told,
        "errors_left_out": more_errors,
        "truncated": cut is not None,
        "truncation_reason": cut,
        "next_offset": following and following.offset,
        "continuation": following and following.token,
        "elapsed_seconds": time.monotonic() - began,
    }


@dataclass
class _Open:
    """A session: when it was used last, its items, and where its next page begins."""

    used: float
    request: Request
    stored: Ranged
    left: DataFrame | None
    next: Place


class Sessions:
    """Pages of a request one after the other; tokens carry a check and must come in order.

    The first page runs the search and writes its items in ranges of their order; all pages are read from those ranges.
    """

    def __init__(self, engine: Engine, ttl: float | None = None, most: int | None = None, clock=time.monotonic):
        self.engine, self.clock = engine, clock
        self.ttl, self.most = setting("QUARRY_SESSION_TTL", 900.0) if ttl is None else ttl, int(setting("QUARRY_SESSIONS", 16)) if most is None else most
        self.open: OrderedDict[str, _Open] = OrderedDict()
        self.made = 0

    def _token(self, name: str, offset: int) -> str:
        body = f"{name}:{offset}"
        return f"{body}:{zlib.crc32(body.encode()):08x}"

    def _page(self, name: str, s: _Open) -> dict:
        began = time.monotonic()
        n = s.request.limits.max_results
        rows = s.stored.rows.select(*s.stored.columns) if n is None else s.stored.page(n + 1, s.next.key)
        if n is not None and s.left is not None:  # items of files that were left are no items, so more rows may be asked for
            rows = s.stored.rows.select(*s.stored.columns)
        out = _page(rows, s.request, s.next, began, s.left)
        if out["continuation"] is None:
            self._close(name)
        else:
            s.used, s.next = self.clock(), place(out["continuation"])
            out["continuation"] = self._token(name, s.next.offset)
        return out

    def _close(self, name: str) -> None:
        self.open.pop(name).stored.drop()

    def _expire(self) -> None:
        now = self.clock()
        for name in [k for k, s in self.open.items() if now - s.used > self.ttl]:
            self._close(name)

    def start(self, request: Request) -> dict:
        self._expire()
        self.made += 1
        while len(self.open) >= self.most:
            self._close(next(iter(self.open)))
        search, seconds = prepared(self.engine, request), budget_of(request)
        stored = within(self.engine.spark, None if seconds is None else seconds + GRACE, lambda: written(search, request))
        begin = place(request.continuation) if request.continuation else Place(request.offset)
        name = f"s{self.made}"
        self.open[name] = _Open(self.clock(), request, stored, None if seconds is None else left_of(stored), begin)
        return self._page(name, self.open[name])

    def next(self, token: str) -> dict:
        self._expire()
        name, _, rest = token.partition(":")
        offset, _, check = rest.partition(":")
        if name not in self.open or not offset.isdigit() or self._token(name, int(offset)) != token:
            raise QueryError("Invalid or expired session token")
        if self.open[name].next.offset != int(offset):
            raise QueryError("The session token does not fit the session's cursor")
        self.open.move_to_end(name)
        return self._page(name, self.open[name])


def classify_error(error: Exception) -> dict:
    """A code and what to do."""
    if isinstance(error, QueryError):
        return {"code": "query_validation", "message": str(error), "remediation": "Correct the query."}
    if isinstance(error, TimeoutError):
        return {"code": "budget_exceeded", "message": str(error), "remediation": "Narrow the query or raise the budget."}
    if isinstance(error, (Cancelled, KeyboardInterrupt)):
        return {"code": "cancelled", "message": str(error), "remediation": "Run it again."}
    return {"code": "execution", "message": str(error), "remediation": "See the message." if isinstance(error, SearchError) else "See Spark's log."}


def digest(engine: Engine, request: Request, response: dict, paths: int = 10, directories: int = 5) -> str:
    """A response in a few lines: its status, the first paths, and the directories that most files are in."""
    out = [f"{request.query}: {len(response['items'])} items, {response['status']}"]
    out += [f"  {x['display_path']}" for x in response["items"][:paths]]
    if len(response["items"]) > paths or response["truncated"]:
        out.append(f"  more: offset {response['next_offset'] if response['truncated'] else paths}")
    out += [f"  {r['path']}/: {r['candidate_files']} files" for r in stats.hotspots(engine.corpus.files, directories).collect()]
    return "\n".join([*out, *(f"  {x['level']}: {x['path']}: {x['message']}" for x in response["diagnostics"])])


def capabilities() -> dict:
    """What the engine takes and gives."""
    return {"modes": list(MODES), "path_display": list(R.PATHS), "execution": sorted(EXECUTION), "error_modes": ["skip_errors", "fail_fast"], "limits": {k: getattr(Limits(), k) for k in Limits.__dataclass_fields__}, "predicates": predicate_catalog(), "languages": [p.id for p in PROFILES]}


def predicate_catalog() -> list[dict]:
    return [{"key": k, "class": "metadata" if k in METADATA_KEYS else "content" if k in CONTENT_KEYS else "react" if k in REACT_KEYS else "semantic"} for k in KEYS]


def languages() -> list[dict]:
    return [describe(p.id) for p in sorted(PROFILES, key=lambda p: (p.name, p.id))]


def describe(word: str) -> dict:
    p = find_profile(word)
    if p is None:
        raise QueryError(f"Unknown language: '{word}'")
    return {"id": p.id, "name": p.name, "aliases": sorted(p.extensions), "extensions": sorted({*p.extensions, *p.listed}), "tier": p.tier, "keys": sorted(supported_keys(p))}
