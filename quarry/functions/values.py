"""Values of predicates: sizes, times and regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from quarry.functions.patterns import Table, bounded, java_members
from quarry.plans.query import QueryError

#: Units of sizes in bytes and of times in seconds.
SIZE_UNITS = {"": 1, "b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}
TIME_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 86400 * 7, "y": 86400 * 365}
OPERATORS = "><="


@dataclass(frozen=True)
class SizeValue:
    operator: str
    bytes: int


@dataclass(frozen=True)
class TimeValue:
    """Relative: ``seconds`` before now. Absolute: the instant ``at``; ``day`` if only a date was given."""

    operator: str
    seconds: int | None = None
    at: datetime | None = None
    day: bool = False

    def threshold(self, now: datetime) -> datetime:
        try:
            return self.at if self.at is not None else now - timedelta(seconds=self.seconds)
        except OverflowError:
            raise QueryError("The duration reaches back before all dates") from None


def _operator(text: str) -> tuple[str, str]:
    text = text.strip()
    return (text[0], text[1:].strip()) if text[:1] in OPERATORS and text else ("=", text)


def size_value(text: str) -> SizeValue:
    operator, rest = _operator(text)
    number, unit = re.match(r"([0-9.]*)(.*)", rest.lower(), re.S).groups()
    if unit.strip() not in SIZE_UNITS:
        raise QueryError(f"'{unit.strip()}' is no unit of size")
    try:
        return SizeValue(operator, int(float(number) * SIZE_UNITS[unit.strip()]))
    except ValueError:
        raise QueryError(f"Invalid size: '{text}'") from None


def time_value(text: str, zone: str = "UTC") -> TimeValue:
    operator, rest = _operator(text)
    number, unit = re.match(r"([0-9]*)(.*)", rest, re.S).groups()
    if number and unit.strip() in TIME_UNITS:
        return TimeValue(operator, seconds=int(number) * TIME_UNITS[unit.strip()])
    for form, day in (("%Y-%m-%d %H:%M:%S", False), ("%Y-%m-%d", True)):
        try:
            at = datetime.strptime(rest, form).replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
        except ValueError:
            continue
        if at.timestamp() < 0:
            raise QueryError("Dates before 1970 are not supported")
        return TimeValue(operator, at=at, day=day)
    raise QueryError(f"'{rest}' is neither a date nor a duration")


#: What a linear-time engine does not have, but Java does.
BEYOND_LINEAR = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+|\\[GZX]")
#: Lines end at line feeds alone, and classes are those of Unicode.
FLAGS = "(?dU)"


def without_escapes(pattern: str) -> str:
    """With a plain character for each escaped one."""
    return re.sub(r"\\[^1-9kGZX]", "x", pattern)


def line_regex(pattern: str) -> str:
    """As Java takes it; raises where a linear-time engine would refuse it."""
    if BEYOND_LINEAR.search(re.sub(r"\[[^\]]*\]", "x", without_escapes(pattern))):
        raise QueryError(f"Invalid regular expression: look-around, back-references and possessive quantifiers are not supported: '{pattern}'")
    return FLAGS + pattern.replace("(?P<", "(?<")


@dataclass(frozen=True)
class Regex:
    """``java``: as Java takes it, without repetitions that take exponential time; None: only the table decides. ``literal``:
    a text that every matching line holds, or empty. ``table``: decides long lines, for a pattern that Java might run out
    of stack over."""

    java: str | None
    literal: str
    table: Table | None = None


def checked_regex(spark, pattern: str) -> Regex:
    compiles = spark._jvm.java.util.regex.Pattern.compile
    try:
        compiles(line_regex(pattern))
    except QueryError:
        raise
    except Exception as e:
        raise QueryError(f"Invalid regular expression: '{pattern}'") from e
    safe, literal, table = bounded(pattern, java_members(spark))
    if safe is None:
        return Regex(None, literal, table)
    return Regex(line_regex(pattern) if safe == pattern else FLAGS + safe.replace("(?P<", "(?<"), literal, table)
