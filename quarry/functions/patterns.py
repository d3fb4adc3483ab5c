"""Regular expressions that a backtracking matcher takes exponential time for, and texts that every match must hold.

A repetition is explosive if its body can be walked through in two ways that read the same characters and come back to
where they began: then each such stretch doubles the ways that a failing match has to try. That is decided on the
positions of the expression: edges between positions are counted with the ways that lead over them (an inner and an outer
loop over the same edge are two), and pairs of positions tell whether two walks that part can meet again.

Only whether a line matches is asked for, not how. So an explosive repetition is replaced by an expression of the same
language in which every text has one walk: that of its smallest deterministic automaton. One that is too large, or that
rests on positions in the line, is refused. A matcher may still take polynomial time.

Characters are told apart by Java's own classes: each class of the pattern is asked for all code points, once.

Java also calls itself once more for every round of a loop over anything but single characters, so a long line exhausts its
stack, whatever the pattern. ``Table`` is a pattern's deterministic automaton for such lines: it is stepped through by a
fold over the line's characters, each first replaced by one that stands for its class.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

from quarry.plans.query import QueryError

#: Positions of a whole pattern, a fixed value that stands for ten mebibytes of compiled program; positions of one
#: repetition that is examined; states and characters of what replaces it.
STATE_LIMIT, EXAMINED, STATES, LENGTH = 262_144, 600, 80, 20_000
#: Characters of replacements up to which Java is given them; steps of a table.
BRIEF, STEPS = 400, 6000
EVERY = np.r_[np.arange(0xD800), np.arange(0xE000, 0x110000)]
#: members(class, flags) -> which of ``EVERY`` are in a class.
Members = Callable[[str, str], np.ndarray]


@dataclass(frozen=True)
class Chars:
    """One character: of a class of Java, or a literal one."""

    text: str
    flags: str = ""
    literal: str | None = None


@dataclass(frozen=True)
class Place:
    """Something without width: an anchor, a word boundary, or nothing at all."""

    anchor: bool = False


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    body: object
    low: int
    high: int | None
    span: tuple[int, int]


Part = Chars | Place | Seq | Either | Repeat
#: Classes that mean the same in either case.
NEUTRAL = re.compile(r"\\[dDwWsShHN]|\[\^\\n\]|\[\\x\{0\}-\\x\{10FFFF\}\]")
TIMES = re.compile(r"\{(\d+)(,?)(\d*)\}")
CHARACTERS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b", "v": "\v", "0": "\0"}


class Reader:
    """A pattern that Java has accepted, as parts."""

    def __init__(self, text: str):
        self.text, self.at, self.flags = text, 0, ""

    def read(self) -> Part:
        out = self.either()
        if self.at < len(self.text):
            raise QueryError(f"Invalid regular expression: '{self.text}'")
        return out

    def _take(self, size: int = 1) -> str:
        self.at += size
        return self.text[self.at - size : self.at]

    def _peek(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def either(self) -> Part:
        parts = [self.sequence()]
        while self._peek("|"):
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def sequence(self) -> Part:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            if "x" in self.flags and (m := re.compile(r"\s+|#[^\n]*\n?").match(self.text, self.at)):
                self.at = m.end()
                continue
            start = self.at
            part = self.atom()
            while part is not None and (times := self.times()) is not None:
                part = Repeat(part, *times, (start, self.at))
            if part is not None:
                parts.append(part)
        return parts[0] if len(parts) == 1 else Seq(tuple(parts))

    def times(self) -> tuple[int, int | None] | None:
        sign = self.text[self.at : self.at + 1]
        if sign and sign in "*+?":
            self.at += 1
            out = {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
        elif m := TIMES.match(self.text, self.at):
            self.at = m.end()
            low = int(m[1])
            out = (low, int(m[3]) if m[3] else None if m[2] else low)
        else:
            return None
        if self._peek("?"):  # lazy: the same language
            self.at += 1
        return out

    def atom(self) -> Part | None:
        c = self._take()
        if c == "(":
            return self.group()
        if c == "[":
            return Chars(self._class(), self._cased())
        if c == "\\":
            return self.escape()
        if c == ".":
            return Chars("[\\x{0}-\\x{10FFFF}]" if "s" in self.flags else "[^\\n]")
        if c in "^$":
            return Place(True)
        return self._literal(c)

    def _cased(self) -> str:
        return "i" if "i" in self.flags else ""

    def _literal(self, c: str) -> Chars:
        return Chars(f"\\x{{{ord(c):X}}}", self._cased(), c)

    def group(self) -> Part | None:
        before = self.flags
        if self._peek("?"):
            self.at += 1
            if self._peek("P<") or self._peek("<"):
                self.at = self.text.index(">", self.at) + 1
            else:
                m = re.compile(r"([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])").match(self.text, self.at)
                self.at = m.end()
                self.flags = "".join(sorted((set(self.flags) | set(m[1])) - set(m[2] or "")))
                if m[3] == ")":  # for the rest of the group around it
                    return None
        inner = self.either()
        self._take()
        self.flags = before
        return inner

    def escape(self) -> Part:
        c = self._take()
        if c in "pP":
            end = self.text.index("}", self.at) + 1 if self._peek("{") else self.at + 1
            return Chars("\\" + c + self._take(end - self.at), self._cased())
        if c in "dDwWsShHvVN" and c != "v":
            return Chars("\\" + c)
        if c in "bBAzZG":
            return Place(True)
        if c in "xu":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})" if c == "x" else r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{4})").match(self.text, self.at)
            self.at = m.end()
            return self._literal(chr(int(m[1] or m[2], 16)))
        return self._literal(CHARACTERS.get(c, c))

    def _class(self) -> str:
        """A bracketed class, the bracket already taken, whole, with classes inside it."""
        start, depth = self.at - 1, 1
        self.at += self._peek("^")
        self.at += self._peek("]")
        while depth:
            c = self._take()
            if not c:
                raise QueryError(f"Invalid regular expression: '{self.text}'")
            if c == "\\":
                self.at += 1
            depth += (c == "[") - (c == "]")
        return self.text[start : self.at]


def parts_of(part: Part) -> Iterable[Part]:
    yield part
    for x in part.parts if isinstance(part, Seq | Either) else (part.body,) if isinstance(part, Repeat) else ():
        yield from parts_of(x)


def size_of(part: Part) -> int:
    """Positions of the written-out pattern."""
    match part:
        case Chars():
            return 1
        case Seq(parts) | Either(parts):
            return sum(map(size_of, parts))
        case Repeat(body, low, high, _):
            return size_of(body) * max(low, 1 if high is None else high)
    return 0


def literal_of(part: Part) -> str:
    """The longest text that is in everything that the pattern matches; empty if none is known."""
    runs, now = [""], ""

    def walk(x: Part) -> None:
        nonlocal now
        match x:
            case Chars(_, "", str() as c) if c != "\n":
                now += c
                return
            case Place():
                return
            case Seq(parts):
                for y in parts:
                    walk(y)
                return
        runs.append(now)
        now = ""
        if isinstance(x, Repeat) and x.low:
            runs.append(literal_of(x.body))

    walk(part)
    return max([*runs, now], key=len)


# --- letters: sets of characters that the classes of a pattern don't tell apart


class Letters:
    """``mask[chars]``: the letters of a class as bits. ``text(mask)``: a class of Java for a set of letters."""

    def __init__(self, chars: list[Chars], members: Members):
        self.members = members
        self.flags = "i" if any(c.flags for c in chars) else ""
        kinds = list(dict.fromkeys(chars))
        if len(kinds) > 62:
            raise QueryError("Invalid regular expression: too many different classes in one repetition")
        plain = all(c.literal is not None and not c.flags for c in kinds)
        self.every = np.array(sorted({ord(c.literal) for c in kinds})) if plain else EVERY
        code = np.zeros(len(self.every), np.int64)
        for k, c in enumerate(kinds):
            code |= self._inside(c).astype(np.int64) << k
        seen, self.letter = np.unique(code, return_inverse=True)
        self.mask = {c: sum(1 << n for n, pattern in enumerate(seen.tolist()) if pattern >> k & 1) for k, c in enumerate(kinds)}
        self.used = [n for n, pattern in enumerate(seen.tolist()) if pattern]
        self.kinds, self.patterns = kinds, seen.tolist()

    def _inside(self, c: Chars) -> np.ndarray:
        if c.literal is not None and not c.flags:
            return ord(c.literal) == self.every
        return self.members(c.text, c.flags)

    def text(self, mask: int) -> str:
        for c, m in self.mask.items():
            if m == mask:
                return c.text
        atoms = []
        for n in self.used:
            if mask >> n & 1:
                inside = [c.text for k, c in enumerate(self.kinds) if self.patterns[n] >> k & 1]
                outside = [f"[^{c.text}]" for k, c in enumerate(self.kinds) if not self.patterns[n] >> k & 1]
                atoms.append("[" + "&&".join(inside + outside) + "]")
        out = atoms[0] if len(atoms) == 1 else "[" + "".join(atoms) + "]"
        want = np.isin(self.letter, [n for n in self.used if mask >> n & 1])
        if self.every is EVERY and not np.array_equal(self.members(out, self.flags), want):
            raise TooLarge
        return out


class TooLarge(Exception):
    """No replacement of a bearable size."""


# --- positions


class Positions:
    """The positions of a part written out: where it begins and ends, what follows what, each with its number of ways (two
    stand for more)."""

    def __init__(self, part: Part, mask: dict[Chars, int], limit: int, loop: bool):
        self.mask, self.limit = mask, limit
        self.letters: list[int] = []
        self.follow: dict[int, Counter] = defaultdict(Counter)
        self.first, self.last, self.empty = self._bag(part)
        if loop:
            self._join(self.last, self.first)

    def _join(self, ends: Counter, begins: Counter) -> None:
        for p, n in ends.items():
            for q, m in begins.items():
                self.follow[p][q] = min(2, self.follow[p][q] + n * m)

    def _then(self, a: tuple, b: tuple) -> tuple:
        self._join(a[1], b[0])
        return _sum(a[0], b[0], a[2]), _sum(b[1], a[1], b[2]), min(2, a[2] * b[2])

    def _bag(self, part: Part) -> tuple[Counter, Counter, int]:
        match part:
            case Chars():
                if len(self.letters) >= self.limit:
                    raise TooLarge
                self.letters.append(self.mask[part])
                here = Counter({len(self.letters) - 1: 1})
                return here, here, 0
            case Seq(parts):
                out = (Counter(), Counter(), 1)
                for x in parts:
                    out = self._then(out, self._bag(x))
                return out
            case Either(parts):
                bags = [self._bag(x) for x in parts]
                return sum((b[0] for b in bags), Counter()), sum((b[1] for b in bags), Counter()), min(2, sum(b[2] for b in bags))
            case Repeat(body, low, high, _):
                return self._repeated(body, low, high)
        return Counter(), Counter(), 1

    def _repeated(self, body: Part, low: int, high: int | None) -> tuple[Counter, Counter, int]:
        out = (Counter(), Counter(), 1)
        for _ in range(max(0, low - (high is None))):
            out = self._then(out, self._bag(body))
        if high is None:
            b = self._bag(body)
            self._join(b[1], b[0])
            return self._then(out, b if low else (b[0], b[1], min(2, b[2] + 1)))
        tail = (Counter(), Counter(), 1)
        for _ in range(high - low):  # the last copy first, as each holds those after it
            tail = self._then(self._bag(body), tail)
            tail = (tail[0], tail[1], min(2, tail[2] + 1))
        return self._then(out, tail)


def _sum(a: Counter, b: Counter, ways: int) -> Counter:
    out = Counter(a)
    for k, n in b.items():
        if ways:
            out[k] = min(2, out[k] + n * ways)
    return out


def components(graph: dict) -> dict:
    """The number of each node's strongly connected component."""
    index, low, out, stack, on = {}, {}, {}, [], set()
    for root in graph:
        if root in index:
            continue
        work = [(root, iter(graph[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in index:
                    index[x] = low[x] = len(index)
                    stack.append(x)
                    on.add(x)
                    work.append((x, iter(graph.get(x, ()))))
                    break
                if x in on:
                    low[node] = min(low[node], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        out[x] = index[node]
                        if x == node:
                            break
    return out


def explosive(p: Positions) -> bool:
    """Two walks over one text that part and meet again, in a loop."""
    graph = {n: list(p.follow[n]) for n in range(len(p.letters))}
    of = components(graph)
    inner = {n: [x for x in graph[n] if of[x] == of[n]] for n in graph}
    if any(p.follow[n][x] > 1 for n in inner for x in inner[n]):
        return True
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(n, n) for n in inner if inner[n]]
    while todo:
        pair = todo.pop()
        if pair in pairs:
            continue
        a, b = pair
        pairs[pair] = [(x, y) for x in inner[a] for y in inner[b] if p.letters[x] & p.letters[y]]
        todo += pairs[pair]
    of_pair = components(pairs)
    same = {of_pair[x] for x in pairs if x[0] == x[1]}
    return any(x[0] != x[1] and of_pair[x] in same for x in pairs)


# --- replacement


def deterministic(p: Positions, letters: Letters) -> tuple[list[dict[int, int]], list[bool]]:
    """The smallest automaton of a part: for each state, where each letter leads, and whether it accepts. State 0 begins."""
    start = frozenset({-1})
    ends = set(p.last)
    states, moves, todo = {start: 0}, [], [start]
    while todo:
        here = todo.pop(0)
        after = set(p.first) if here == start else {q for x in here for q in p.follow[x]}
        step = {}
        for n in letters.used:
            target = frozenset(q for q in after if p.letters[q] >> n & 1)
            if target:
                if target not in states:
                    if len(states) > 40 * STATES:
                        raise TooLarge
                    states[target] = len(states)
                    todo.append(target)
                step[n] = states[target]
        moves.append(step)
    accepts = [bool(p.empty) if s == start else bool(s & ends) for s in states]
    block = [int(a) for a in accepts]
    while True:
        keys = [(block[s], tuple(sorted((n, block[t]) for n, t in moves[s].items()))) for s in range(len(moves))]
        names: dict = {}
        new = [names.setdefault(k, len(names)) for k in keys]
        done = len(names) == len(set(block))
        block = new  # state 0 names its block first
        if done:
            break
    merged: list[dict[int, int]] = [{} for _ in set(block)]
    good = [False] * len(merged)
    for s, step in enumerate(moves):
        merged[block[s]] = {n: block[t] for n, t in step.items()}
        good[block[s]] = accepts[s]
    return merged, good


def expression(moves: list[dict[int, int]], accepts: list[bool], letters: Letters) -> str:
    """An expression of an automaton, by taking out one state after the other; each text has one walk through it."""
    if len(moves) > STATES:
        raise TooLarge
    begin, end = -1, -2
    edges: dict[tuple[int, int], str] = {(begin, 0): ""}
    for s, step in enumerate(moves):
        to: dict[int, int] = defaultdict(int)
        for n, t in step.items():
            to[t] |= 1 << n
        edges |= {(s, t): letters.text(mask) for t, mask in to.items()}
        if accepts[s]:
            edges[s, end] = ""
    left = set(range(len(moves)))
    while left:
        s = min(left, key=lambda s: sum(a == s != b for a, b in edges) * sum(b == s != a for a, b in edges))
        left.discard(s)
        loop = f"(?:{edges[s, s]})*" if (s, s) in edges else ""
        into = [(a, x) for (a, b), x in edges.items() if b == s != a]
        out = [(b, x) for (a, b), x in edges.items() if a == s != b]
        edges = {k: x for k, x in edges.items() if s not in k}
        for a, x in into:
            for b, y in out:
                new = x + loop + y
                edges[a, b] = f"(?:{edges[a, b]}|{new})" if (a, b) in edges else new
        if sum(map(len, edges.values())) > LENGTH:
            raise TooLarge
    return f"(?:{edges[begin, end]})"


def replacement(part: Repeat, letters: Letters) -> str:
    """An expression of the same language in which every text has one walk."""
    chars = [x for x in parts_of(part) if isinstance(x, Chars)]
    if any(isinstance(x, Place) and x.anchor for x in parts_of(part)) or letters.flags and any(not x.flags and not NEUTRAL.fullmatch(x.text) for x in chars):
        raise TooLarge
    out = expression(*deterministic(Positions(part, letters.mask, EXAMINED, False), letters), letters)
    made = Reader(out).read()
    again = Letters([x for x in parts_of(made) if isinstance(x, Chars)], letters.members)
    if any(explosive(Positions(x, again.mask, 4 * EXAMINED, False)) for x in parts_of(made) if isinstance(x, Repeat)):
        raise TooLarge
    return f"(?i:{out})" if letters.flags else out


# --- long lines


@dataclass(frozen=True)
class Table:
    """``classes``: a class of Java and the character that stands for its members. ``moves``: for each state the next one by
    the place of that character in ``letters``, place 0 for all others. State 0 begins. ``accepts``: states in which a line
    matches, by its end or once they are reached."""

    classes: tuple[tuple[str, str], ...]
    letters: str
    moves: tuple[int, ...]
    accepts: tuple[int, ...]


def loops(part: Part) -> bool:
    """Whether Java calls itself for every round of a loop."""
    return any(isinstance(x, Repeat) and (x.high is None or x.high > 100) and any(isinstance(y, Either | Repeat) for y in parts_of(x.body)) for x in parts_of(part))


def table(whole: Part, members: Members) -> Table | None:
    """None if there is none of a bearable size, or if the pattern looks at more than characters."""
    parts = list(whole.parts) if isinstance(whole, Seq) else [whole]
    at_start, at_end = isinstance(parts[0], Place), isinstance(parts[-1], Place) and len(parts) > 1
    parts = parts[at_start : len(parts) - at_end]
    every = Chars("[\\x{0}-\\x{10FFFF}]")
    body = Seq((*(() if at_start else (Repeat(every, 0, None, (0, 0)),)), *parts))
    chars = [x for x in parts_of(body) if isinstance(x, Chars)]
    if any(isinstance(x, Place) for p in parts for x in parts_of(p)) or any(c.flags for c in chars) and any(not c.flags and not NEUTRAL.fullmatch(c.text) for c in chars):
        return None
    try:
        letters = Letters(chars, members)
        moves, accepts = deterministic(Positions(body, letters.mask, 4 * EXAMINED, False), letters)
        flags = f"(?dU{letters.flags})"
        classes = tuple((flags + letters.text(1 << n), chr(int(letters.every[np.argmax(letters.letter == n)]))) for n in letters.used)
    except (TooLarge, QueryError):
        return None
    dead, width = len(moves), len(letters.used) + 1
    if dead * width > STEPS:
        return None
    steps = [dead] * ((dead + 1) * width)
    for s, step in enumerate(moves):
        for k, n in enumerate(letters.used, 1):
            steps[s * width + k] = step.get(n, dead)
        if accepts[s] and not at_end:
            steps[s * width : (s + 1) * width] = [s] * width
    return Table(classes, "".join(c for _, c in classes), tuple(steps), tuple(s for s, a in enumerate(accepts) if a))


def accepted(line, t: Table):
    """Whether a line, a column, is led to a state that accepts."""
    from pyspark.sql import functions as F

    shown, width = line, len(t.letters) + 1
    for text, stands in t.classes:
        shown = F.regexp_replace(shown, text, "\\" + stands if stands in "\\$" else stands)
    moves = F.array(*map(F.lit, t.moves))
    end = F.aggregate(F.split(shown, ""), F.lit(0), lambda state, c: F.when(c == "", state).otherwise(F.get(moves, state * width + F.instr(F.lit(t.letters), c))))
    return end.isin(*t.accepts) if t.accepts else F.lit(False)


def bounded(pattern: str, members: Members) -> tuple[str | None, str, Table | None]:
    """A pattern without explosive repetitions that matches the same lines, a text that each of them holds, and what is to
    be asked of long lines instead, if it is to be. Without a pattern: of all lines."""
    whole = Reader(pattern).read()
    if size_of(whole) > STATE_LIMIT:
        raise QueryError(f"Invalid regular expression: it is larger than {STATE_LIMIT} states: '{pattern}'")
    changes: list[tuple[tuple[int, int], str]] = []

    def visit(part: Part) -> None:
        if isinstance(part, Repeat) and (part.high is None or part.high > 1):
            inside = list(parts_of(part.body))
            if any(isinstance(x, Repeat | Either) for x in inside):
                change(part, [x for x in inside if isinstance(x, Chars)])
            return
        for x in part.parts if isinstance(part, Seq | Either) else (part.body,) if isinstance(part, Repeat) else ():
            visit(x)

    def change(part: Repeat, chars: list[Chars]) -> None:
        letters = Letters(chars, members)
        try:
            found = explosive(Positions(part.body, letters.mask, EXAMINED, True))
        except TooLarge:
            found = explosive(Positions(_loosened(part.body), letters.mask, 4 * EXAMINED, True))
        if found:
            changes.append((part.span, replacement(part, letters)))

    out: str | None = pattern
    try:
        visit(whole)
        if sum(len(text) for _, text in changes) > BRIEF:
            raise TooLarge
        for (a, z), text in reversed(changes):
            out = out[:a] + text + out[z:]
    except TooLarge:
        out = None
    steps = table(whole, members) if out is None or loops(whole) else None
    if out is None and steps is None:
        raise QueryError(f"Invalid regular expression: a repetition within it can be read in too many ways: '{pattern}'")
    return out, literal_of(whole), steps


def _loosened(part: Part) -> Part:
    """With large counts as loops: more can be read in more ways."""
    match part:
        case Seq(parts):
            return Seq(tuple(map(_loosened, parts)))
        case Either(parts):
            return Either(tuple(map(_loosened, parts)))
        case Repeat(body, low, high, span):
            return Repeat(_loosened(body), min(low, 2), None if high is None or high > 2 else high, span)
    return part


def java_members(spark) -> Members:
    """Asks Java which code points are in a class."""
    every = "".join(map(chr, EVERY.tolist()))
    known: dict[tuple[str, str], np.ndarray] = {}

    def members(text: str, flags: str) -> np.ndarray:
        if (text, flags) not in known:
            rest = spark._jvm.java.util.regex.Pattern.compile(f"(?dU{flags})" + text).matcher(every).replaceAll("")
            known[text, flags] = ~np.isin(EVERY, np.array([ord(c) for c in rest], np.int64))
        return known[text, flags]

    return members
