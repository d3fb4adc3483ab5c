"""What conditions on paths say about the columns that paths are made of.

A condition on a made-up path can't reach a scan: it is about an expression. Each metadata predicate is therefore also told
as a plain comparison of the columns below, that all files it selects satisfy; statistics of row groups, partitions or
directories can be tested against it. It stands beside the predicate, not instead of it, so it may be as weak as it likes
but never too strong.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from os.path import commonprefix
from typing import Protocol
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.globs import has_glob
from quarry.functions.values import size_value, time_value
from quarry.plans.query import And, Node, Or, Predicate

#: What a slash within a value becomes in a path: a value is one component.
SLASH = "%2F"
#: The time of number 0 among files without one, and the seconds between two numbers.
EPOCH, STEP = 1704067200, 3600


class Layout(Protocol):
    def bound(self, p: Predicate, context) -> Column | None:
        """A condition on the source that holds wherever a predicate does; None if nothing is known."""


def narrowed(node: Node | bool, layout: Layout, context) -> Column | None:
    """The same of a whole tree of metadata predicates."""
    match node:
        case bool():
            return None if node else F.lit(False)
        case Predicate():
            return layout.bound(node, context)
        case And(left, right):
            a, b = narrowed(left, layout, context), narrowed(right, layout, context)
            return b if a is None else a if b is None else a & b
        case Or(left, right):
            a, b = narrowed(left, layout, context), narrowed(right, layout, context)
            return None if a is None or b is None else a | b
    return None


def component(value: Column) -> Column:
    """A value as one component of a path."""
    return F.replace(value, F.lit("/"), F.lit(SLASH))


def literal_prefixes(glob: str) -> list[str]:
    """Texts, with one of which every path that a glob matches begins."""
    m = re.match(r"([^\\*?\[{}]*)\{([^\\{}]*)\}(.*)$", glob, re.S)
    if m:
        return [x for choice in m[2].split(",") for x in literal_prefixes(m[1] + choice + m[3])]
    out, at = "", 0
    while at < len(glob) and glob[at] not in "*?[{":
        at += glob[at] == "\\"
        out, at = out + glob[at : at + 1], at + 1
    return [out]


def relative_to(root: str, value: str) -> str:
    return posixpath.relpath(posixpath.normpath(posixpath.join(root, value)), root)


def compare(left: Column, operator: str, right) -> Column:
    return left > right if operator == ">" else left < right if operator == "<" else left == right


def instants(value: str, context) -> list[tuple[str, object]]:
    """(operator, instant) that a time has to satisfy, all of them."""
    v = time_value(value, context.zone)
    at = v.threshold(context.now)
    if v.operator == "=" and v.day:
        return [(">=", at), ("<", at.astimezone(ZoneInfo(context.zone)) + timedelta(days=1))]
    return [(v.operator, at)]


class TreePaths:
    """Of a directory's listing, whose columns are plain already."""

    def bound(self, p: Predicate, context) -> Column | None:
        value, path = p.value, F.col("root_relative_path")
        match p.key:
            case "ext":
                return F.col("ext_low") == value.lower()
            case "path_exact":
                return F.col("resolved_path") == posixpath.normpath(posixpath.join(context.root, value))
            case "path" if not has_glob(value):
                return (F.col("resolved_path") if value.startswith("/") else path).contains(value)
            case "in" if not has_glob(value):
                where = relative_to(context.root, value)
                return F.col("parent_rel") == ("" if where == "." else where)
            case "path" | "in":
                prefix = commonprefix(literal_prefixes(value))
                return path.startswith(prefix) if prefix and not value.startswith("/") else None
            case "size":
                v = size_value(value)
                return compare(F.col("size_bytes"), v.operator, v.bytes)
        return None


@dataclass(frozen=True)
class Paths:
    """Of a table: paths are the values of ``folders`` (names with '=' before them stand for themselves), then the value of
    ``number`` with ``suffix``. Times are those of the column ``stamp``, or go by ``number``."""

    folders: tuple[str, ...]
    number: str
    suffix: str
    stamp: str | None = None

    def _unknown(self) -> Column:
        """Rows whose path lacks a component."""
        columns = [c for c in (*self.folders, self.number) if not c.startswith("=")]
        return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))

    def _folder(self, k: int, how: str, text: str) -> Column | None:
        """A condition that a component is, begins with, ends with or contains a text; None: nothing is known."""
        name = self.folders[k]
        if name.startswith("="):
            fixed = name[1:]
            return F.lit({"is": fixed == text, "startswith": fixed.startswith(text), "endswith": fixed.endswith(text), "contains": text in fixed}[how])
        if SLASH in text or how != "is" and "%" in text or how in ("endswith", "contains") and (text[:1] == "F" or text[:2] in ("2", "2F")):
            return None  # may stand for a slash, or for a part of what does
        column = F.col(name)
        return column == text if how == "is" else getattr(column, how)(text) if text else None

    def _name(self, how: str, text: str) -> Column | None:
        """The same of the last component, which is the number with its suffix."""
        if how == "is":
            digits = text.removesuffix(self.suffix)
            known = text.endswith(self.suffix) and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", digits)
            return F.col(self.number) == int(digits) if known else F.lit(False)
        possible = set("-0123456789" + self.suffix)
        return None if set(text) <= possible else F.lit(False)

    def _component(self, k: int, how: str, text: str) -> Column | None:
        if k > len(self.folders):
            return F.lit(False)
        return self._name(how, text) if k == len(self.folders) else self._folder(k, how, text)

    def _all(self, conditions: list[Column | None]) -> Column | None:
        known = [c for c in conditions if c is not None]
        return reduce(lambda a, b: a & b, known) if known else None

    def _any(self, conditions: list[Column | None]) -> Column | None:
        return None if any(c is None for c in conditions) or not conditions else reduce(lambda a, b: a | b, conditions)

    def _from(self, first: int, parts: list[str], begin: str, end: str) -> Column | None:
        """Components from a place on: the first one ends with its text, the last one begins with its text, unless said
        otherwise; those between are whole."""
        how = ["is"] * len(parts)
        how[0], how[-1] = begin, end
        if len(parts) == 1:
            how = ["contains" if (begin, end) == ("endswith", "startswith") else end if begin == "is" else begin]
        return self._all([self._component(first + k, h, t) for k, (h, t) in enumerate(zip(how, parts))])

    def bound(self, p: Predicate, context) -> Column | None:
        got = self._bound(p, context)
        return None if got is None else got | self._unknown()

    def _bound(self, p: Predicate, context) -> Column | None:
        value = p.value
        match p.key:
            case "path_exact":
                parts = relative_to(context.root, value).split("/")
                return self._from(0, parts, "is", "is") if len(parts) == len(self.folders) + 1 else F.lit(False)
            case "in" if not has_glob(value):
                parts = relative_to(context.root, value).split("/")
                return self._from(0, parts, "is", "is") if len(parts) == len(self.folders) else F.lit(False)
            case ("path" | "in") if value.startswith("/"):
                return None
            case "path" if not has_glob(value):
                parts = value.split("/")
                return self._any([self._from(k, parts, "endswith", "startswith") for k in range(len(self.folders) + 1)])
            case "path" | "in":
                return self._any([self._from(0, x.split("/"), "is", "startswith") for x in literal_prefixes(value)])
            case "name" if value and not any(c in value for c in "*?[]"):
                return self._name("is", value.lower()) if self.suffix == self.suffix.lower() else None
            case "ext":
                return None if f".{value}".lower() == self.suffix.lower() else F.lit(False)
            case "modified":
                return self._all([self._time(operator, at) for operator, at in instants(value, context)])
        return None

    def _time(self, operator: str, at) -> Column | None:
        if self.stamp:
            other = F.timestamp_micros(F.lit(int(at.timestamp()) * 1_000_000 + at.microsecond))
            column = F.col(self.stamp)
            made = column >= other if operator == ">=" else compare(column, operator, other)
            return made | column.isNull()
        since, step = (at - datetime.fromtimestamp(EPOCH, timezone.utc)) // timedelta(microseconds=1), STEP * 1_000_000
        below, above = since // step, -(-since // step)
        number = F.col(self.number)
        match operator:
            case ">":
                return number > below
            case ">=":
                return number >= above
            case "<":
                return number < above
        return number == below if below == above else F.lit(False)
