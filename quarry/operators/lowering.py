"""Lowers a syntax tree to columns over files: a condition, and the ranges that a file matched in.

A node's result is a whole-file verdict or a list of ranges ("hunks"). Three columns say which:

    ok      the node matches: a true verdict, or at least one hunk
    whole   it is a true verdict
    ranged  it is a list of hunks, even an empty one; a false verdict is neither
    hunks   the ranges
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.capture.profiles import CONTAINS_KEYS
from quarry.functions.globs import has_glob, name_regex, path_regex, plain_name
from quarry.functions.lines import bound, line_range, no_hunks
from quarry.functions.patterns import accepted
from quarry.functions.values import Regex, checked_regex, size_value, time_value
from quarry.plans.query import CONTENT_KEYS, KEYS, METADATA_KEYS, REACT_KEYS, SEMANTIC_KEYS, And, Node, Not, Or, Predicate, QueryError, flatten, predicates


@dataclass(frozen=True)
class Context:
    """What values are read against."""

    spark: object
    root: str
    now: datetime
    zone: str = "UTC"
    semantic_match: str = "exact"
    regexes: dict = field(default_factory=dict)


def validate(node: Node, context: Context) -> None:
    """Every key is known and every value can be read, before anything is scanned."""
    for p in predicates(node):
        if p.key not in KEYS:
            raise QueryError(f"Unknown predicate key: '{p.key}'")
        if p.key == "matches":
            _regex(p, context)
        elif p.key in METADATA_KEYS:
            metadata(p, context)


def needed_captures(node: Node) -> tuple[str, ...]:
    return tuple(sorted({p.key for p in predicates(node) if p.key in SEMANTIC_KEYS + REACT_KEYS}))


def needs_content(node: Node) -> bool:
    return any(p.key not in METADATA_KEYS for p in predicates(node))


def _instant(at: datetime) -> Column:
    return F.timestamp_micros(F.lit(int(at.timestamp()) * 1_000_000 + at.microsecond))


def metadata(p: Predicate, c: Context) -> Column:
    """A verdict over columns of the listing; never null. Comparisons stay plain, so that scans can take them."""
    value, relative = p.value, F.coalesce("root_relative_path", "resolved_path")
    match p.key:
        case "ext":
            out = F.lower("ext") == value.lower()
        case "name":
            regex = name_regex(value)
            if plain := plain_name(value):
                low = F.lower("name")
                out = low == plain[1] if plain[0] == "equals" else getattr(low, plain[0])(plain[1])
            else:
                out = F.col("name").rlike(regex)
        case "path":
            target = F.col("resolved_path") if value.startswith("/") else relative
            out = target.rlike(path_regex(value)) if has_glob(value) else target.contains(value)
        case "path_exact":
            out = F.col("resolved_path") == posixpath.normpath(posixpath.join(c.root, value))
        case "in":
            if has_glob(value):
                regex = path_regex(value)
                out = relative.rlike(regex) | F.col("parent_rel").rlike(regex)
            else:
                where = posixpath.relpath(posixpath.normpath(posixpath.join(c.root, value)), c.root)
                out = F.col("parent_rel") == ("" if where == "." else where)
        case "size":
            v = size_value(value)
            out = _compare(F.col("size_bytes"), v.operator, F.lit(v.bytes))
        case "modified":
            v = time_value(value, c.zone)
            at, stamp = v.threshold(c.now), F.coalesce("modified_at", F.timestamp_seconds(F.lit(0)))
            if v.operator == "=" and v.day:
                local = at.astimezone(ZoneInfo(c.zone))
                out = (stamp >= _instant(at)) & (stamp < _instant((local + timedelta(days=1))))
            else:
                out = _compare(stamp, v.operator, _instant(at))
    return F.coalesce(out, F.lit(False))


def _compare(left: Column, operator: str, right: Column) -> Column:
    return left > right if operator == ">" else left < right if operator == "<" else left == right


#: Regular expressions that can't take a line's end or look for one: no anchors, dots, negated classes or escapes.
WITHIN_LINES = re.compile(r"(?:[A-Za-z0-9 _:;,<>=@#%&~\"'/!-]|\[[^\^\\\[\]\x00-\x1f][^\\\[\]\x00-\x1f]*\]|\\[dw]|[+*?|()]|\{[0-9,]+\})*")


#: Characters of a line up to which Java's stack holds any loop.
SHORT = 1000


def line_test(p: Predicate, c: Context):
    if p.key == "contains":
        needle = p.value
        return lambda line: F.contains(F.lower(line), F.lower(F.lit(needle)))
    regex = _regex(p, c)
    if regex.table is None:
        return lambda line: F.regexp_like(line, F.lit(regex.java))
    if regex.java is None:
        return lambda line: accepted(line, regex.table)
    return lambda line: F.when(F.length(line) <= SHORT, F.regexp_like(line, F.lit(regex.java))).otherwise(accepted(line, regex.table))


def _regex(p: Predicate, c: Context) -> Regex:
    if p.value not in c.regexes:
        c.regexes[p.value] = checked_regex(c.spark, p.value)
    return c.regexes[p.value]


def required_text(p: Predicate, c: Context) -> Predicate | None:
    """A predicate on the text as a whole that holds wherever a regular expression matches; None if nothing is known."""
    literal = _regex(p, c).literal if p.key == "matches" else ""
    return Predicate("contains", literal) if literal.strip() else None


def text_bound(p: Predicate, c: Context) -> Column | None:
    """What the whole text satisfies if and only if one of its lines passes; None if nothing simple."""
    if p.key == "matches" and WITHIN_LINES.fullmatch(p.value) and _regex(p, c).table is None:
        return (F.col("text") != "") & line_test(p, c)(F.col("text"))
    if p.key == "contains" and p.value and "\n" not in p.value and "\r" not in p.value:
        return F.contains("low", F.lower(F.lit(p.value)))
    return None


def capture_test(p: Predicate, mode: str):
    """Does a capture's text satisfy the value?"""
    key, value, contains = p.key, p.value, p.key in CONTAINS_KEYS
    if value == "." and not (contains and mode in ("exact", "case_insensitive", "prefix", "regex")):
        return lambda t: F.lit(True)
    match mode:
        case "exact":
            return (lambda t: F.contains(t, F.lit(value))) if contains else (lambda t: t == value)
        case "case_insensitive":
            folded = F.lit("".join(x.lower() if x.isascii() else x for x in value))
            upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            return (lambda t: F.contains(F.translate(t, upper, lower), folded)) if contains else (lambda t: F.translate(t, upper, lower) == folded)
        case "prefix":
            return lambda t: F.startswith(t, F.lit(value))
        case "regex":
            return lambda t: F.regexp_like(t, F.lit("(?dU)" + value))
        case "wildcard":
            if value == "*":
                return lambda t: F.lit(True)
            regex = "(?s)^" + ".*".join("\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" if x else "" for x in value.split("*")) + "$"
            return lambda t: F.regexp_like(t, F.lit(regex))
    raise QueryError(f"Unknown semantic match mode: '{mode}'")


@dataclass(frozen=True)
class Result:
    ok: Column
    whole: Column
    ranged: Column
    hunks: Column


def _verdict(condition: Column) -> Result:
    return Result(condition, condition, F.lit(False), no_hunks())


def merged(a: Column, b: Column) -> Column:
    """Both lists by start byte alone, ties in their order; then of neighbours that are equal only the first."""
    both = F.array_sort(F.concat(a, b), lambda x, y: F.when(x.start_byte < y.start_byte, -1).when(x.start_byte > y.start_byte, 1).otherwise(0))
    return bound(both, lambda s: F.filter(s, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))))


def capture_hits(p: Predicate, c: Context) -> Column:
    test = capture_test(p, c.semantic_match)
    hits = F.filter("captures", lambda x: (x.key == p.key) & test(x.text))
    return F.when(F.array_contains("supported", p.key), F.transform(hits, lambda x: x.range)).otherwise(no_hunks())


class Lowering:
    """Results of all nodes of a tree, over files with ``lines`` and ``starts`` for content predicates, ``captures`` and
    ``supported`` for captures. ``steps``: the columns to add, one node after the other, so that no expression nests
    deeper than one node however deep the tree is."""

    def __init__(self, context: Context):
        self.context = context
        self.steps: list[dict[str, Column]] = []

    def _keep(self, r: Result) -> Result:
        names = {part: f"n{len(self.steps)}_{part}" for part in ("ok", "whole", "ranged", "hunks")}
        self.steps.append({name: getattr(r, part) for part, name in names.items()})
        return Result(*(F.col(n) for n in names.values()))

    def node(self, node: Node) -> Result:
        match node:
            case Predicate(key, _) if key in METADATA_KEYS:
                return self._keep(_verdict(metadata(node, self.context)))
            case Predicate(key, _) if key in CONTENT_KEYS:
                test = line_test(node, self.context)
                numbered = F.transform("lines", lambda line, i: F.struct(i.alias("row"), line.alias("line")))
                hits = F.filter(numbered, lambda x: test(x.line))
                hunks = F.transform(hits, lambda x: line_range(x.row, F.get("starts", x.row), x.line))
                return self._ranges(hunks, F.lit(True))
            case Predicate(key, _):
                return self._ranges(capture_hits(node, self.context), F.array_contains("supported", key))
            case Not(child):
                return self._keep(_verdict(~self.node(child).ok))
            case And(left, right):
                a, b = self.node(left), self.node(right)
                ok = a.ok & b.ok
                whole = ok & a.whole & b.whole
                hunks = F.when(~ok, no_hunks()).when(a.whole, b.hunks).when(b.whole, a.hunks).otherwise(merged(a.hunks, b.hunks))
                return self._keep(Result(ok, whole, ok & ~whole, hunks))
            case Or(left, right):
                a, b = self.node(left), self.node(right)
                whole = a.whole | b.whole
                hunks = F.when(whole, no_hunks()).when(~b.ranged, a.hunks).when(~a.ranged, b.hunks).otherwise(merged(a.hunks, b.hunks))
                return self._keep(Result(a.ok | b.ok, whole, ~whole & (a.ranged | b.ranged), hunks))

    def _ranges(self, hunks: Column, ranged: Column) -> Result:
        name = f"n{len(self.steps)}_made"
        self.steps.append({name: hunks})
        return self._keep(Result(F.size(name) > 0, F.lit(False), ranged, F.col(name)))


def condition(node: Node, c: Context) -> Column:
    """``ok`` alone: no offsets and no ranges are made. Long chains of one key and operator become one comparison."""
    match node:
        case Predicate(key, _) if key in METADATA_KEYS:
            return metadata(node, c)
        case Predicate(key, _) if key in CONTENT_KEYS:
            test, bound = line_test(node, c), text_bound(node, c)
            if bound is not None:  # a text without line breaks in the value holds it if and only if a line does
                return bound
            return F.exists("lines", test)
        case Predicate():
            return F.size(capture_hits(node, c)) > 0
        case Not(child):
            return ~condition(child, c)
        case And():
            return reduce(lambda a, b: a & b, (condition(x, c) for x in flatten(node, And)))
        case Or():
            parts = flatten(node, Or)
            exts = [x.value.lower() for x in parts if isinstance(x, Predicate) and x.key == "ext"]
            rest = [condition(x, c) for x in parts if not (isinstance(x, Predicate) and x.key == "ext")]
            if exts:
                rest.insert(0, F.coalesce(F.lower("ext").isin(exts), F.lit(False)))
            return reduce(lambda a, b: a | b, rest)
