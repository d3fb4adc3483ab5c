"""A directory tree as a table: each task walks subtrees, and what a query asks of paths keeps it out of the others.

The driver opens directories breadth first only until there are enough of them to share out, and looks at no file. A task
gets one directory, alone or with all that is below it. It reads the ignore files from the root down to its directory
again, decides for every file whether and why it is left out, and sends rows in Arrow batches.

Filters that Spark pushes here are decided before a row is made, and where they are about places or depths, before a
directory is opened. With ``skip_reason IS NULL`` pushed, hidden, ignored and too deep directories aren't opened either;
without it every file is listed with the reason why it is left out, the rule and where the rule stands.
"""

from __future__ import annotations

import json
import os
import posixpath
import stat
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .ignore import Rules

FILES = (
    "file_id string, root string, display_path string, resolved_path string, root_relative_path string, resolution string, name string, ext string, parent_rel string, depth int, "
    "size_bytes long, modified_at timestamp, modified_unix_millis long, readonly boolean, permissions string, file_type string, stable_token string, device_id long, inode long"
)
#: Beside the columns of files: the extension in lower case, why a file is left out, and the rule that says so.
EXTRA = "ext_low string, skip_reason string, skip_source string, skip_rule string"
_KINDS = {"string": (T.StringType(), pa.string()), "int": (T.IntegerType(), pa.int32()), "long": (T.LongType(), pa.int64()), "boolean": (T.BooleanType(), pa.bool_()), "timestamp": (T.TimestampType(), pa.timestamp("us", "UTC"))}
_COLUMNS = [x.split() for x in f"{FILES}, {EXTRA}".split(", ")]
SCHEMA = T.StructType([T.StructField(n, _KINDS[k][0]) for n, k in _COLUMNS])
ARROW = pa.schema([(n, _KINDS[k][1]) for n, k in _COLUMNS])
NAMES = SCHEMA.names
#: Reasons for leaving a file out.
HIDDEN, IGNORED, DEEP, UNREADABLE = "hidden", "ignored", "max_depth", "unreadable"
#: Directories to share out, entries of one directory that the driver looks at before it leaves it to a task, rows a batch.
SHARES, LOOK, ROWS = 256, 20_000, 4096
FORMAT = "quarry_tree"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Share(D.InputPartition):
    """A directory for one task, alone or with all below it."""

    where: str
    depth: int
    below: bool


@dataclass(frozen=True)
class Walk:
    """What is walked and how."""

    root: str
    shown: str
    hidden: bool
    no_ignore: bool
    max_depth: int
    global_rules: tuple[str, ...]

    def rules(self, where: str) -> Rules:
        """With the ignore files from the root down to a directory's parent."""
        out = Rules(self.root, self.no_ignore, self.global_rules)
        parts = where.split("/") if where else []
        for k in range(len(parts)):
            out.enter("/".join(parts[:k]))
        return out

    def reason(self, rel: str, depth: int, rules: Rules) -> tuple[str, str, str] | None:
        """Why a file is left out, where the rule stands, and the rule."""
        if depth > self.max_depth:
            return DEEP, "max_depth", str(self.max_depth)
        if not self.hidden and is_hidden(rel):
            return HIDDEN, "hidden", "a part of the path begins with a dot"
        if not self.no_ignore and (found := rules.ignoring(rel)):
            return IGNORED, *found
        return None

    def open(self, rel: str, depth: int, rules: Rules) -> bool:
        """Whether a directory can hold files that are not left out."""
        return depth < self.max_depth and (self.hidden or not is_hidden(rel)) and (self.no_ignore or not rules.closed(rel))


def is_hidden(rel: str) -> bool:
    return any(p.startswith(".") and p not in (".", "..") for p in rel.split("/"))


# --- filters


def _compare(kind: str) -> Callable:
    return {"GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b}[kind]


def row_test(f: D.Filter) -> Callable[[dict], bool] | None:
    """A filter as a test of a row; None for those that are left to Spark."""
    if isinstance(f, D.Not):
        return None
    column = f.attribute[0] if len(f.attribute) == 1 else None
    if column not in NAMES or column == "modified_at":
        return None
    match f:
        case D.IsNull():
            return lambda r: r[column] is None
        case D.IsNotNull():
            return lambda r: r[column] is not None
        case D.EqualTo():
            return lambda r: r[column] is not None and r[column] == f.value
        case D.In():
            values = set(f.value)
            return lambda r: r[column] is not None and r[column] in values
        case D.StringStartsWith():
            return lambda r: r[column] is not None and r[column].startswith(f.value)
        case D.StringEndsWith():
            return lambda r: r[column] is not None and r[column].endswith(f.value)
        case D.StringContains():
            return lambda r: r[column] is not None and f.value in r[column]
        case D.GreaterThan() | D.GreaterThanOrEqual() | D.LessThan() | D.LessThanOrEqual():
            test = _compare(type(f).__name__)
            return lambda r: r[column] is not None and test(r[column], f.value)
    return None


def place_test(f: D.Filter, root: str) -> Callable[[str, int], bool] | None:
    """Whether files that pass a filter can lie in a directory or below it, by its path and depth; None: anywhere."""
    column = f.attribute[0] if not isinstance(f, D.Not) and len(f.attribute) == 1 else None

    def relative(path: str) -> str | None:
        return path.removeprefix(root.rstrip("/") + "/") if path.startswith(root.rstrip("/") + "/") else None

    match f, column:
        case (D.EqualTo(), "root_relative_path") | (D.EqualTo(), "resolved_path"):
            rel = f.value if column == "root_relative_path" else relative(f.value)
            parent = posixpath.dirname(rel) if rel else None
            return (lambda where, depth: False) if rel is None else lambda where, depth: not where or f"{parent}/".startswith(f"{where}/")
        case D.EqualTo(), "parent_rel":
            return lambda where, depth: not where or f"{f.value}/".startswith(f"{where}/")
        case (D.StringStartsWith(), "root_relative_path") | (D.StringStartsWith(), "resolved_path") | (D.StringStartsWith(), "parent_rel"):
            prefix = relative(f.value) if column == "resolved_path" else f.value
            return None if prefix is None else lambda where, depth: not where or f"{where}/".startswith(prefix) or prefix.startswith(f"{where}/") or column == "parent_rel" and where.startswith(prefix)
        case (D.LessThan() | D.LessThanOrEqual() | D.EqualTo()), "depth":
            most = f.value - isinstance(f, D.LessThan)
            return lambda where, depth: depth < most
    return None


class TreeReader(D.DataSourceReader):
    def __init__(self, walk: Walk, shares: int):
        self.walk, self.shares = walk, shares
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if row_test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def _tests(self) -> tuple[list[Callable], list[Callable], bool]:
        """Of rows, of places, and whether only files that stay are wanted."""
        places = [t for f in self.filters if (t := place_test(f, self.walk.root))]
        kept = any(isinstance(f, D.IsNull) and f.attribute == ("skip_reason",) for f in self.filters)
        return [row_test(f) for f in self.filters], places, kept

    def _goes(self, places: list[Callable], kept: bool) -> Callable[[str, int, Rules], bool]:
        return lambda rel, depth, rules: all(t(rel, depth) for t in places) and (not kept or self.walk.open(rel, depth, rules))

    def partitions(self) -> list[Share]:
        _, places, kept = self._tests()
        goes = self._goes(places, kept)
        rules = self.walk.rules("")
        todo, out, looked = deque([("", 0)]), [], 0
        while todo and len(todo) + len(out) < self.shares and looked < 4 * self.shares:
            where, depth = todo.popleft()
            looked += 1
            inner = self._directories(where)
            if inner is None:  # a task finds out why, or walks what is too wide for the driver
                out.append(Share(where, depth, True))
                continue
            rules.enter(where)
            out.append(Share(where, depth, False))
            todo += [(rel, depth + 1) for rel in inner if goes(rel, depth + 1, rules)]
        return [*out, *(Share(where, depth, True) for where, depth in todo)]

    def _directories(self, where: str) -> list[str] | None:
        out = []
        try:
            with os.scandir(posixpath.join(self.walk.root, where)) as entries:
                for k, e in enumerate(entries):
                    if k == LOOK:
                        return None
                    if e.is_dir(follow_symlinks=False):
                        out.append(posixpath.join(where, e.name))
        except OSError:
            return None
        return sorted(out)

    def read(self, share: Share):
        tests, places, kept = self._tests()
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

        for row in self._rows(share, self._goes(places, kept)):
            as_dict = dict(zip(NAMES, row))
            if all(t(as_dict) for t in tests):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    def _rows(self, share: Share, goes: Callable) -> Iterator[tuple]:
        walk = self.walk
        rules = walk.rules(share.where)
        todo = [(share.where, share.depth)]
        while todo:
            where, depth = todo.pop()
            try:
                with os.scandir(posixpath.join(walk.root, where)) as found:
                    entries = sorted(found, key=lambda e: e.name)
                rules.enter(where)
            except OSError as e:
                yield unreadable(walk, where or ".", depth, e)
                continue
            for e in entries:
                rel = posixpath.join(where, e.name)
                try:
                    if e.is_dir(follow_symlinks=False):
                        if share.below and goes(rel, depth + 1, rules):
                            todo.append((rel, depth + 1))
                    elif e.is_file(follow_symlinks=False):  # links are not followed
                        yield file_row(walk, rel, where, e.name, depth + 1, e.stat(follow_symlinks=False), walk.reason(rel, depth + 1, rules))
                except OSError as error:
                    yield unreadable(walk, rel, depth + 1, error)


def file_row(walk: Walk, rel: str, parent: str, name: str, depth: int, info: os.stat_result, skip: tuple[str, str, str] | None) -> tuple:
    real = posixpath.join(walk.root, rel)
    stem, dot, ext = name.rpartition(".")
    ext = ext if stem and dot else None
    return (
        real, walk.root, posixpath.join(walk.shown, rel), real, rel, "canonical", name, ext, parent, depth, info.st_size,
        datetime.fromtimestamp(info.st_mtime, timezone.utc), info.st_mtime_ns // 1_000_000, not info.st_mode & 0o222, stat.filemode(info.st_mode), "file", None, info.st_dev, info.st_ino,
        ext and ext.lower(), *(skip or (None, None, None)),
    )


def unreadable(walk: Walk, rel: str, depth: int, error: OSError) -> tuple:
    path = posixpath.join(walk.root, rel)
    known = {"file_id": path, "root": walk.root, "display_path": posixpath.join(walk.shown, rel), "resolved_path": path, "root_relative_path": rel, "resolution": "fallback", "name": posixpath.basename(rel), "parent_rel": posixpath.dirname(rel), "depth": depth, "file_type": "other"}
    known |= {"skip_reason": UNREADABLE, "skip_source": "walk", "skip_rule": error.strerror or type(error).__name__}
    return tuple(known.get(n) for n in NAMES)


class Tree(D.DataSource):
    """Options: root, shown, hidden, no_ignore, max_depth, shares, and global_rules (a list in JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> TreeReader:
        o = self.options
        yes = lambda k: str(o.get(k, "false")).lower() == "true"
        root = os.path.realpath(o["root"])
        walk = Walk(root, o.get("shown", o["root"]), yes("hidden"), yes("no_ignore"), int(o.get("max_depth", 100)), tuple(json.loads(o.get("global_rules", "[]"))))
        return TreeReader(walk, int(o.get("shares", SHARES)))
