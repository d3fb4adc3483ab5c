"""Languages: which files are theirs, and what each key captures in them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from . import lexers as L
from .lexers import Lexer, Token

#: Keys whose value is looked for within the captured text; for the others it is compared with all of it.
CONTAINS_KEYS = ("import", "comment", "str", "call")
Span = tuple[int, int]


class Source:
    """One text and its tokens; ``code`` is the tokens without comments."""

    def __init__(self, text: str, lexer: Lexer):
        self.text = text
        self.tokens = lexer.tokens(text)
        self.code = [t for t in self.tokens if t.kind != "comment"]
        self._close: dict[int, int] | None = None

    @property
    def close(self) -> dict[int, int]:
        """Index of an opening bracket in the code -> index of its closing one."""
        if self._close is None:
            self._close, stack = {}, []
            for k, t in enumerate(self.code):
                if t.kind == "punct" and t.text in "([{":
                    stack.append((t.text, k))
                elif t.kind == "punct" and t.text in ")]}":
                    pair = {")": "(", "]": "[", "}": "{"}[t.text]
                    if any(x == pair for x, _ in stack):
                        while stack:
                            x, at = stack.pop()
                            if x == pair:
                                self._close[at] = k
                                break
        return self._close

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.code) and self.code[k].text in texts

    def ident(self, k: int) -> bool:
        return 0 <= k < len(self.code) and self.code[k].kind == "ident"


Finder = Callable[[Source], Iterator[Span]]


def kinds(*names: str) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        return ((t.start, t.end) for t in s.tokens if t.kind in names)

    return find


def span(t: Token) -> Span:
    return t.start, t.end


def after(*keywords: str, but: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> Finder:
    """The identifier that follows a keyword."""

    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.kind == "ident" and t.text in keywords and not s.is_(k - 1, ".", "::", *but):
                n = k + 1
                while s.is_(n, *skip):
                    n += 1
                if s.ident(n) and not s.is_(n, *keywords):
                    yield span(s.code[n])

    return find


def all_of(*finders: Finder) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        return iter(sorted({x for f in finders for x in f(s)}))

    return find


def filtered(finder: Finder, pattern: str) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        return ((a, z) for a, z in finder(s) if re.match(pattern, s.text[a:z]))

    return find


def statement(*keywords: str, end: str = ";", lines: bool = False) -> Finder:
    """From a keyword at the start of a statement to its end: the end mark included, or the end of the line."""

    def find(s: Source) -> Iterator[Span]:
        k = 0
        while k < len(s.code):
            t = s.code[k]
            first = k == 0 or s.code[k - 1].text in (";", "{", "}", "*/") or "\n" in s.text[s.code[k - 1].end : t.start] or s.is_(k - 1, "pub", "export", ")", "global")
            if t.kind == "ident" and t.text in keywords and first and not s.is_(k + 1, "(") and not s.is_(k - 1, "."):
                z, depth = k, 0
                while z + 1 < len(s.code):
                    n = s.code[z + 1]
                    if lines and not depth and "\n" in s.text[s.code[z].end : n.start] and not s.text[s.code[z].end : n.start].lstrip(" \t").startswith("\\"):
                        break
                    if n.text == end and not depth and end:
                        z += 0 if lines else 1
                        break
                    depth += {"(": 1, "{": 1, ")": -1, "}": -1}.get(n.text, 0) if n.kind == "punct" else 0
                    if depth < 0:
                        break
                    z += 1
                yield t.start, s.code[z].end
                k = z
            k += 1

    return find


BRACE_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "new", "else", "do", "throw", "case", "using", "lock", "foreach", "function", "synchronized", "try", "super", "this", "assert", "elif", "with", "fn", "match", "func", "def", "typeof", "nameof", "await", "and", "or", "not", "in", "is", "unless", "until", "when", "guard", "import", "async", "yield", "del", "lambda"}


MODIFIERS = {"public", "private", "protected", "internal"}


def calls(extra: tuple[str, ...] = (), definitions: Finder | None = None, generics: bool = False, after_new: bool = False, signatures: bool = False, keywords: frozenset[str] = frozenset(BRACE_KEYWORDS)) -> Finder:
    """Names right before an argument list that neither define nor are keywords; of a member its last part."""

    def find(s: Source) -> Iterator[Span]:
        defined = set(definitions(s)) if definitions else set()
        for k, t in enumerate(s.code):
            if t.kind != "ident" or t.text in keywords:
                continue
            n = k + 1
            if generics and s.is_(n, "<"):
                depth = 0
                for n in range(k + 1, min(k + 40, len(s.code))):
                    depth += {"<": 1, ">": -1}.get(s.code[n].text, 0)
                    if not depth or s.is_(n, ";", "{", "("):
                        break
                n += 1
            hit = s.is_(n, "(") or s.is_(k + 1, *extra) or s.is_(n, "?.") and s.is_(n + 1, "(")
            if extra == ("!",) and s.is_(k + 1, "!"):
                hit = s.is_(k + 2, "(", "[", "{")
            if signatures and hit and s.is_(n, "(") and n in s.close and s.is_(s.close[n] + 1, ":") and (s.is_(k - 1, "{", ";", "}", ",") or "\n" in s.text[s.code[k - 1].end : t.start]):
                continue  # a member of an interface
            if (hit or after_new and s.is_(k - 1, "new")) and span(t) not in defined:
                yield span(t)

    return find


def whole_calls(dots: tuple[str, ...], definitions: Finder | None = None) -> Finder:
    """The callee with its chain, and the arguments."""

    def find(s: Source) -> Iterator[Span]:
        defined = set(definitions(s)) if definitions else set()
        back, heads = {z: o for o, z in s.close.items()}, {}
        for k, t in enumerate(s.code):
            if t.kind not in ("ident", "name") or t.text in BRACE_KEYWORDS or span(t) in defined or not s.is_(k + 1, "(") or k + 1 not in s.close or s.is_(k - 1, "new", "def", "func", "function"):
                continue
            a = k
            while s.is_(a - 1, *dots) and a >= 2:
                a -= 2
                while a in back and a > 0:
                    a = back[a] - 1 if back[a] else 0
                if a in heads:  # the chain up to here has been walked before
                    a = heads[a]
                    break
            heads[k] = a
            yield s.code[a].start, s.code[s.close[k + 1]].end

    return find


def methods(types: bool = True, bodies: tuple[str, ...] = ("{",), prototypes: bool = False) -> Finder:
    """``name(...)`` followed by a body; ``types``: a type has to stand before the name, as in C and its kin."""
    between = {"throws", "const", "noexcept", "override", "final", ",", ".", "->", "&", "*", "<", ">", "[", "]", "?", ":", "|", "where", "new", "(", ")", "async", "::", "default", "volatile"}

    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.kind != "ident" or t.text in BRACE_KEYWORDS or not s.is_(k + 1, "(") or k + 1 not in s.close:
                continue
            before = s.code[k - 1] if k else None
            typed = before is not None and (before.kind == "ident" and before.text not in BRACE_KEYWORDS | MODIFIERS or before.text in (">", "]", "*", "&", "?", "::", "~"))
            if before is not None and before.text in (".", "->", "=", "(", ",", "!", "&&", "||", "?.", "return", "new", "+", "=>"):
                continue
            if types and not typed:
                continue
            n = s.close[k + 1] + 1
            while n < len(s.code) and not s.is_(n, *bodies) and (s.code[n].text in between or s.code[n].kind in ("ident", "str")):
                n += 1
            if s.is_(n, *bodies) or prototypes and typed and s.is_(n, ";") and n == s.close[k + 1] + 1:
                yield span(t)

    return find


def constructors() -> Finder:
    """``Name(...) {`` at class level, after a brace, a semicolon or a modifier."""

    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.kind == "ident" and t.text not in BRACE_KEYWORDS and s.is_(k + 1, "(") and k + 1 in s.close and (k == 0 or s.is_(k - 1, "{", "}", ";", ":", *MODIFIERS)):
                n = s.close[k + 1] + 1
                if s.is_(n, "throws", ":"):
                    while n < len(s.code) and not s.is_(n, "{", ";", "}"):
                        n += 1
                if s.is_(n, "{"):
                    yield span(t)

    return find


def any_of(*token_kinds: str, keywords: frozenset[str] = frozenset()) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        return (span(t) for t in s.code if t.kind in token_kinds and t.text not in keywords)

    return find


def arrow_consts(memo: bool = False) -> Finder:
    """Names of constants that hold an arrow function, or with ``memo`` the result of a ``.memo(...)`` call."""

    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if not (t.kind == "ident" and s.is_(k - 1, "const", "let")):
                continue
            n = k + 1
            while n < len(s.code) and not s.is_(n, "=", ";", "=>"):
                n = s.close.get(n, n) + 1
            if not s.is_(n, "="):
                continue
            n += 1
            if memo and s.ident(n) and s.is_(n + 1, ".") and s.is_(n + 2, "memo") and s.is_(n + 3, "("):
                yield span(t)
                continue
            n += s.is_(n, "async")
            if s.is_(n, "<"):
                while n < len(s.code) and not s.is_(n, "("):
                    n += 1
            if s.is_(n, "(") and n in s.close:
                z = s.close[n] + 1
                while z < len(s.code) and not s.is_(z, "=>", ";", "{", "=", ",", ")"):
                    z += 1
                if s.is_(z, "=>"):
                    yield span(t)
            elif s.ident(n) and s.is_(n + 1, "=>"):
                yield span(t)

    return find


def jsx(props: bool) -> Finder:
    """Tag names of opening and self-closing elements, or the names of their attributes."""

    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.text != "<" or not s.ident(k + 1) or s.code[k + 1].start != t.end:
                continue
            before = s.code[k - 1] if k else None
            if before and (before.kind in ("number", "str") or before.text in (")", "]") or before.kind == "ident" and before.text not in L.OPERAND_KEYWORDS | {"default"} and before.end == t.start):
                continue
            z = k + 1
            while s.is_(z + 1, ".", "-", ":") and s.ident(z + 2):
                z += 2
            if not props:
                yield s.code[k + 1].start, s.code[z].end
                continue
            n = z + 1
            while n < len(s.code) and not s.is_(n, ">", "/") and (n == z + 1 or not s.is_(n, "<")):
                if s.is_(n, "{") and n in s.close:
                    n = s.close[n] + 1
                elif s.ident(n):
                    a = n
                    while s.is_(n + 1, "-", ":") and s.ident(n + 2) and s.code[n + 1].start == s.code[n].end:
                        n += 2
                    yield s.code[a].start, s.code[n].end
                    n += 1
                    if s.is_(n, "="):
                        n = s.close.get(n + 1, n + 1) + 1
                else:
                    n += 1

    return find


def hooks() -> Finder:
    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.kind == "ident" and t.text.startswith("use") and not s.is_(k - 1, ".", "?.", "function") and (s.is_(k + 1, "(") or s.is_(k + 1, "<") and any(s.is_(n, ">") and s.is_(n + 1, "(") for n in range(k + 2, k + 12))):
                yield span(t)

    return find


def rust_impl(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.text != "impl" or t.kind != "ident" or s.is_(k - 1, "->", ":", "(", ",", "<", "&"):
            continue
        n, depth, name = k + 1, 0, None
        while n < len(s.code) and not (s.is_(n, "{", ";", "where") and not depth):
            x = s.code[n]
            depth += {"<": 1, ">": -1}.get(x.text, 0)
            if x.text == "for" and not depth:
                name = None
            elif x.kind == "ident" and not depth and name is None and x.text not in ("dyn", "mut", "const"):
                name = x
            elif x.kind == "ident" and not depth and s.is_(n - 1, "::"):
                name = x
            n += 1
        if name:
            yield span(name)


def go_types(kind: str | None) -> Finder:
    """Names in type declarations, single or grouped."""

    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.text != "type" or t.kind != "ident":
                continue
            if s.is_(k + 1, "(") and k + 1 in s.close:
                inside, depth, rows = range(k + 2, s.close[k + 1]), 0, []
                for n in inside:
                    if not depth and s.ident(n) and (n == k + 2 or "\n" in s.text[s.code[n - 1].end : s.code[n].start] or s.is_(n - 1, ";")):
                        rows.append(n)
                    depth += {"{": 1, "}": -1, "(": 1, ")": -1}.get(s.code[n].text, 0)
            else:
                rows = [k + 1] if s.ident(k + 1) else []
            for n in rows:
                z = s.close[n + 1] + 1 if s.is_(n + 1, "[") and n + 1 in s.close and s.ident(n + 2) and not s.is_(n + 2, "]") else n + 1
                if kind is None or s.is_(z, kind):
                    yield span(s.code[n])

    return find


def go_funcs(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.text == "func" and t.kind == "ident":
            n = s.close[k + 1] + 1 if s.is_(k + 1, "(") and k + 1 in s.close else k + 1
            if s.ident(n) and s.is_(n + 1, "(", "["):
                yield span(s.code[n])


def go_members(s: Source) -> Iterator[Span]:
    """Methods that interfaces ask for."""
    for k, t in enumerate(s.code):
        if t.text == "interface" and s.is_(k + 1, "{") and k + 1 in s.close:
            n = k + 2
            while n < s.close[k + 1]:
                if s.ident(n) and s.is_(n + 1, "("):
                    yield span(s.code[n])
                n = s.close.get(n + 1, n) + 1


GO_WORDS = frozenset({"type", "import", "const", "var", "struct", "interface", "map", "chan", "func", "if", "for", "switch", "return", "go", "defer", "select", "case", "range"})


def go_imports(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.text == "import" and t.kind == "ident":
            if s.is_(k + 1, "(") and k + 1 in s.close:
                yield t.start, s.code[s.close[k + 1]].end
            else:
                n = next((n for n in range(k + 1, min(k + 4, len(s.code))) if s.code[n].kind == "str"), None)
                if n:
                    yield t.start, s.code[n].end


def c_includes(s: Source) -> Iterator[Span]:
    for t in s.tokens:
        if t.kind == "include":
            yield t.start, t.end + (s.text[t.end : t.end + 1] == "\n")


def c_strings(*own: str) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        for t in s.tokens:
            if t.kind in own:
                yield span(t)
            elif t.kind == "include":
                yield t.start + min(x for x in (t.text.find("<"), t.text.find('"')) if x >= 0), t.end

    return find


def c_macros(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.kind == "define" and s.ident(k + 1):
            yield span(s.code[k + 1])


def c_tags(*keywords: str) -> Finder:
    """Names of tagged types, in definitions and uses."""

    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.kind == "ident" and t.text in keywords and not s.is_(k - 1, "enum"):
                n = k + 1 + s.is_(k + 1, "class", "struct")
                if s.ident(n) and (s.is_(n + 1, "{", ":") or s.is_(n + 1, "final")):
                    yield span(s.code[n])

    return find


def c_typedefs(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.text != "typedef":
            continue
        n, last, pointer = k + 1, None, None
        while n < len(s.code) and not s.is_(n, ";"):
            if s.is_(n, "(") and s.is_(n + 1, "*") and s.ident(n + 2):
                pointer = n + 2
            if s.ident(n):
                last = n
            n = s.close.get(n, n) + 1
        name = pointer if pointer is not None else last
        if name is not None:
            yield span(s.code[name])


def qualified(dots: str) -> Finder:
    """Whole qualified names before an argument list."""

    def find(s: Source) -> Iterator[Span]:
        for k in range(2, len(s.code)):
            if s.ident(k) and s.is_(k + 1, "(") and s.is_(k - 1, dots):
                a = k
                while s.is_(a - 1, dots) and s.ident(a - 2):
                    a -= 2
                yield s.code[a].start, s.code[k].end

    return find


def php_uses(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.text == "use":
            n = k + 1 + s.is_(k + 1, "function", "const")
            if n < len(s.code) and s.code[n].kind in ("name", "ident"):
                yield span(s.code[n])


def ruby_calls(s: Source) -> Iterator[Span]:
    defined = set(after("def", skip=("self", "."))(s))
    words = {"if", "unless", "while", "until", "end", "def", "class", "module", "do", "then", "else", "elsif", "return", "case", "when", "begin", "rescue", "ensure", "yield", "and", "or", "not", "in", "self", "nil", "true", "false", "super", "next", "break"}
    for k, t in enumerate(s.code):
        if t.kind == "ident" and t.text not in words and span(t) not in defined:
            n = s.code[k + 1] if k + 1 < len(s.code) else None
            same_line = n is not None and "\n" not in s.text[t.end : n.start]
            first = k == 0 or "\n" in s.text[s.code[k - 1].end : t.start]
            if s.is_(k - 1, ".") or n is not None and n.text == "(" and n.start == t.end or first and same_line and n.start > t.end and n.kind in ("str", "ident", "sym", "number", "ivar") and n.text not in words:
                yield span(t)


def bash_functions(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.kind == "ident" and (s.is_(k - 1, "function") or s.is_(k + 1, "(") and s.is_(k + 2, ")")) and t.text != "function":
            yield span(t)


def bash_commands(s: Source) -> Iterator[Span]:
    """A command with its arguments, from its name to the end of the line or an operator."""
    names, stop = set(bash_functions(s)), {";", "|", "&", "&&", "||", ")", "(", "`", "{", "}"}
    words = {"if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "select", "time", "[[", "return_"}
    k = 0
    while k < len(s.code):
        t = s.code[k]
        first = k == 0 or "\n" in s.text[s.code[k - 1].end : t.start] or s.code[k - 1].text in stop | {"then", "do", "else", "if", "while", "!", "elif"}
        if first and t.kind in ("ident", "var") and t.text not in words and span(t) not in names and not s.is_(k + 1, "="):
            z = k
            while z + 1 < len(s.code) and "\n" not in s.text[s.code[z].end : s.code[z + 1].start].replace("\\\n", "") and s.code[z + 1].text not in stop:
                z += 1
            yield t.start, s.code[z].end
            k = z
        k += 1


def lua_functions(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.text == "function" and s.ident(k + 1):
            z = k + 1
            while s.is_(z + 1, ".", ":") and s.ident(z + 2):
                z += 2
            yield s.code[k + 1].start, s.code[z].end


def lua_names(s: Source) -> Iterator[Span]:
    """The last parts of function names."""
    ends = {z for _, z in lua_functions(s)}
    return (span(t) for t in s.code if t.kind == "ident" and t.end in ends)


def let_names(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.text in ("let", "and") and t.kind == "ident":
            n = k + 1 + s.is_(k + 1, "rec", "%")
            if s.ident(n):
                yield span(s.code[n])


def module_names(*, header: bool) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.text == "module" and t.kind == "ident":
                z = k + 1 + s.is_(k + 1, "type", "rec")
                if s.ident(z):
                    while s.is_(z + 1, ".") and s.ident(z + 2):
                        z += 2
                    yield (s.code[k + 1].start, s.code[z].end) if header else (t.start, _module_end(s, z))

    return find


def _module_end(s: Source, z: int) -> int:
    depth = 0
    for n in range(z, len(s.code)):
        x = s.code[n].text
        depth += x in ("struct", "sig", "object", "begin")
        if x == "end":
            depth -= 1
            if depth <= 0:
                return s.code[n].end
    return s.code[-1].end


def python_imports(s: Source) -> Iterator[Span]:
    return statement("import", "from", end=";", lines=True)(s)


def nothing(s: Source) -> Iterator[Span]:
    return iter(())


def _sql_name(s: Source, k: int) -> int | None:
    """The last index of a possibly qualified name at k."""
    if not (0 <= k < len(s.code) and s.code[k].kind in ("ident", "name")):
        return None
    while s.is_(k + 1, ".") and k + 2 < len(s.code) and s.code[k + 2].kind in ("ident", "name"):
        k += 2
    return k


def sql_created(*things: str) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        for k, t in enumerate(s.code):
            if t.text.lower() != "create":
                continue
            n, thing = k + 1, None
            while n < len(s.code) and s.code[n].kind == "ident" and s.code[n].text.lower() in ("or", "replace", "temp", "temporary", "materialized", "unique", "if", "not", "exists", "table", "view", "function", "unlogged", "global", "local", "recursive"):
                thing = s.code[n].text.lower() if s.code[n].text.lower() in ("table", "view", "function") else thing
                n += 1
            z = _sql_name(s, n)
            if thing in things and z is not None:
                yield s.code[n].start, s.code[z].end

    return find


def sql_references(s: Source) -> Iterator[Span]:
    """Names after the words that objects follow, and those that are created."""
    leads = {"from", "join", "into", "update", "table", "view", "references", "exists", "on", "function"}
    skip = {"if", "not", "exists", "only", "select", "lateral", "where", "set"}
    for k, t in enumerate(s.code):
        if t.kind == "ident" and t.text.lower() in leads - {"on"}:
            n = k + 1
            while n < len(s.code) and s.code[n].text.lower() in ("if", "not", "exists", "only", "lateral"):
                n += 1
            z = _sql_name(s, n)
            if z is not None and s.code[n].text.lower() not in skip:
                yield s.code[n].start, s.code[z].end
    yield from sql_calls(s)


SQL_WORDS = {"values", "in", "and", "or", "not", "exists", "table", "primary", "foreign", "unique", "check", "references", "key", "over", "as", "using", "on", "where", "select", "from", "returns", "numeric", "decimal", "varchar", "char", "with", "into", "set", "by", "partition", "when", "then", "else", "any", "all", "index", "limit"}


def sql_calls(s: Source) -> Iterator[Span]:
    created = {z for _, z in sql_created("table", "view", "function")(s)}
    for k, t in enumerate(s.code):
        if t.kind in ("ident", "name") and s.is_(k + 1, "(") and t.text.lower() not in SQL_WORDS and t.end not in created and not (k and s.code[k - 1].text.lower() in ("into", "references", "table", "as", "on", "index")):
            a = k
            while s.is_(a - 1, ".") and a >= 2:
                a -= 2
            yield s.code[a].start, t.end


# HTML and CSS have their own scans.

TAG = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<![^>]*>|</([A-Za-z][\w:-]*)\s*>|<([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'/]|/(?!>))*+)(/?)>")


def html_parts(text: str) -> Iterator[tuple[str, int, int]]:
    """(tag | selfclosing | comment | text, start, end); script and style contents are raw text, not parts."""
    at = 0
    for_text = lambda a, z: [("text", a + len(text[a:z]) - len(text[a:z].lstrip()), a + len(text[a:z].rstrip()))] if text[a:z].strip() else []
    while (text.find(">", at) >= 0 or text.find("<!--", at) >= 0) and (m := TAG.search(text, at)):
        yield from for_text(at, m.start())
        at = m.end()
        if m[0].startswith("<!--"):
            yield "comment", m.start(), m.end()
        elif m[2]:
            yield ("selfclosing" if m[4] else "tag"), m.start(2), m.end(2)
            if m[2].lower() in ("script", "style") and not m[4]:
                close = re.compile(rf"</{m[2]}\s*>", re.I).search(text, at)
                at = close.start() if close else len(text)
    yield from for_text(at, len(text))


def html(*wanted: str, names: tuple[str, ...] = ()) -> Finder:
    def find(s: Source) -> Iterator[Span]:
        return ((a, z) for kind, a, z in html_parts(s.text) if kind in wanted and (not names or s.text[a:z].lower() in names))

    return find


def css_selectors(ids: bool) -> Finder:
    """Class names, and with ``ids`` id names, in the heads of rules."""

    def find(s: Source) -> Iterator[Span]:
        start = 0
        for k, t in enumerate(s.code):
            if t.text in ("{", "}", ";"):
                if t.text == "{":
                    for n in range(start, k):
                        x = s.code[n]
                        if x.text == "." and s.ident(n + 1) and s.code[n + 1].start == x.end and n + 1 < k:
                            yield span(s.code[n + 1])
                        elif ids and x.kind == "hash":
                            yield x.start + 1, x.end
                start = k + 1

    return find


def css_imports(s: Source) -> Iterator[Span]:
    for k, t in enumerate(s.code):
        if t.kind == "at" and t.text == "@import":
            z = next((n for n in range(k, len(s.code)) if s.is_(n, ";")), len(s.code) - 1)
            yield t.start, s.code[z].end


def css_values(s: Source) -> Iterator[Span]:
    inside = {n for a, z in s.close.items() if s.is_(a, "(") for n in range(a + 1, z)}
    for k, t in enumerate(s.code):
        if t.kind == "str":
            yield span(t)
        elif t.kind == "ident" and k and k not in inside and not s.is_(k + 1, "(", ":", "{"):
            n = k - 1
            while n >= 0 and not s.is_(n, ";", "{", "}", ":"):
                n -= 1
            if s.is_(n, ":") and any(s.is_(m, "{") for m in range(n, -1, -1)) and not _opens(s, k):
                yield span(t)


def _opens(s: Source, k: int) -> bool:
    n = next((n for n in range(k, len(s.code)) if s.is_(n, "{", ";", "}")), None)
    return n is not None and s.is_(n, "{")


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    extensions: tuple[str, ...]
    lexer: Lexer | None
    finders: dict[str, Finder]
    tier: str = "stable"
    #: Extensions that only an override reaches.
    listed: tuple[str, ...] = ()


comment, string = kinds("comment"), kinds("str")
_rust_def = after("struct", "enum", "trait", "type", "mod", "union", but=("as",))
_py_class, _py_func = after("class"), after("def")
_js_func = all_of(after("function", skip=("*",)), filtered(methods(types=False), r"(?!(?:if|for|while|switch|catch|function)\b)"))
_js_names = all_of(after("function", skip=("*",)), arrow_consts())
_custom_hook = filtered(_js_names, r"use[A-Z]")
_ts_def = all_of(after("class"), after("interface"), after("type"), after("enum"))
_java_func = all_of(methods(prototypes=True), constructors())
_java_def = after("class", "interface", "enum", "record")
_c_func = methods()
_cs_func = all_of(methods(bodies=("{", "=>"), prototypes=True))
_cs_def = all_of(after("class"), after("struct"), after("enum"), after("interface"))
_php_func = after("function", but=("public", "private", "protected", "static", "abstract", "final"), skip=("&",))
_rb_func = after("def", skip=("self", "."))
_scala_func, _swift_func = after("def"), after("func")
_id_words = frozenset()


def _sql(id_: str, name: str, listed: tuple[str, ...]) -> Profile:
    finders = {"def": sql_created("table", "view", "function"), "func": sql_created("function"), "import": sql_references, "call": sql_calls, "comment": comment, "str": string}
    return Profile(id_, name, (id_,), L.SQL, finders, "partial", listed)


PROFILES = (
    Profile("rs", "Rust", ("rs",), L.RUST, {"struct": after("struct"), "enum": after("enum"), "trait": after("trait"), "type": after("type"), "impl": rust_impl, "macro": filtered(after("macro_rules", skip=("!",)), r"."), "module": after("mod"), "def": after("struct", "enum", "trait", "type", "mod"), "func": after("fn"), "import": statement("use"), "call": calls(("!",), all_of(after("fn"), after("macro_rules", skip=("!",)), after("struct")), generics=False), "comment": comment, "str": string}),
    Profile("py", "Python", ("py",), L.PYTHON, {"class": _py_class, "func": _py_func, "def": all_of(_py_class, _py_func), "import": python_imports, "call": calls((), all_of(_py_class, _py_func), keywords=frozenset(BRACE_KEYWORDS - {"match", "super", "func", "fn", "this"})), "comment": comment, "str": string}),
    Profile("js", "JavaScript", ("js",), L.SCRIPT, {"class": after("class"), "func": _js_func, "def": all_of(after("class"), _js_func), "import": statement("import"), "call": calls((), _js_func, after_new=True), "comment": kinds("comment", "regex"), "str": kinds("str", "template"), "hook": hooks(), "customhook": _custom_hook}),
    Profile("ts", "TypeScript", ("ts",), L.SCRIPT, {"class": after("class"), "interface": after("interface"), "type": after("type"), "enum": after("enum"), "def": _ts_def, "func": _js_func, "import": statement("import"), "call": calls((), _js_func, generics=True, after_new=True, signatures=True), "comment": comment, "str": kinds("str", "template"), "hook": hooks(), "customhook": _custom_hook}),
    Profile("tsx", "React", ("jsx", "tsx"), L.SCRIPT, {"component": all_of(after("class"), after("function", skip=("*",)), arrow_consts(memo=True)), "element": jsx(props=False), "hook": hooks(), "customhook": _custom_hook, "prop": jsx(props=True), "import": statement("import"), "comment": comment, "str": kinds("str", "template")}),
    Profile("go", "Go", ("go",), L.GO, {"type": go_types(None), "struct": go_types("struct"), "interface": go_types("interface"), "func": go_funcs, "def": all_of(go_types(None), go_funcs), "import": go_imports, "call": calls((), all_of(go_funcs, go_members), keywords=GO_WORDS), "comment": comment, "str": string}),
    Profile("java", "Java", ("java",), L.JAVA, {"class": after("class"), "interface": after("interface"), "enum": after("enum"), "def": _java_def, "func": _java_func, "import": statement("import"), "call": calls((), _java_func, generics=False, after_new=True), "comment": comment, "str": string}),
    Profile("c", "C", ("c",), L.C, {"func": _c_func, "struct": c_tags("struct", "union"), "enum": c_tags("enum"), "type": c_typedefs, "macro": c_macros, "def": all_of(_c_func, c_tags("struct", "union", "enum"), c_typedefs), "import": c_includes, "call": calls((), all_of(_c_func, c_macros)), "comment": comment, "str": c_strings("str")}, listed=("h",)),
    Profile("cpp", "C++", ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), L.CPP, {"class": c_tags("class"), "struct": c_tags("struct"), "enum": c_tags("enum"), "func": all_of(_c_func, constructors()), "macro": c_macros, "def": all_of(c_tags("class", "struct", "enum"), _c_func, constructors()), "import": c_includes, "call": all_of(calls((), all_of(_c_func, c_macros, constructors())), qualified("::")), "comment": comment, "str": c_strings("str", "raw")}),
    Profile("cs", "C#", ("cs", "csx"), L.CSHARP, {"class": after("class"), "struct": after("struct"), "enum": after("enum"), "interface": after("interface"), "type": after("namespace"), "func": _cs_func, "def": all_of(_cs_def, after("namespace"), _cs_func), "import": statement("using"), "call": calls((), all_of(_cs_func, constructors())), "comment": comment, "str": string}),
    Profile("php", "PHP", ("php",), L.PHP, {"class": after("class", but=("new",)), "interface": after("interface"), "trait": after("trait"), "func": _php_func, "def": all_of(after("class"), after("interface"), after("trait"), _php_func), "import": php_uses, "call": whole_calls(("->", "::", "?->"), after("function")), "comment": comment, "str": string}, listed=("phtml",)),
    Profile("rb", "Ruby", ("rb",), L.RUBY, {"class": after("class"), "module": after("module"), "type": after("module"), "func": _rb_func, "def": all_of(after("class"), after("module"), _rb_func), "import": any_of("ident"), "call": ruby_calls, "comment": comment, "str": string}),
    Profile("sh", "Bash", ("sh", "bash"), L.BASH, {"func": bash_functions, "def": bash_functions, "import": bash_commands, "call": bash_commands, "comment": comment, "str": kinds("str", "raw")}),
    Profile("lua", "Lua", ("lua",), L.LUA, {"func": lua_functions, "def": lua_functions, "import": calls((), lua_names), "call": calls((), lua_names), "comment": comment, "str": string}),
    Profile("scala", "Scala", ("scala",), L.SCALA, {"class": after("class"), "object": after("object"), "type": after("object"), "trait": after("trait"), "func": _scala_func, "def": all_of(after("class"), after("object"), after("trait"), _scala_func), "import": statement("import", end=";", lines=True), "call": whole_calls((".",), all_of(_scala_func, after("class"), after("object"), after("trait"))), "comment": comment}, "experimental"),
    Profile("swift", "Swift", ("swift",), L.SWIFT, {"class": after("class", "struct", "enum", "actor"), "protocol": after("protocol"), "func": _swift_func, "def": all_of(after("class", "struct", "enum", "actor"), after("protocol"), _swift_func), "import": statement("import", end=";", lines=True), "call": whole_calls((".", "?."), _swift_func), "comment": comment, "str": string}, "experimental"),
    Profile("ex", "Elixir", ("ex", "exs"), L.ELIXIR, {**dict.fromkeys(("def", "func", "call", "import", "module", "protocol"), any_of("ident", "sym")), "comment": comment, "str": string}),
    Profile("hs", "Haskell", ("hs", "lhs"), L.HASKELL, {**dict.fromkeys(("def", "func", "type", "import", "call"), filtered(any_of("ident", keywords=frozenset({"where", "let", "in", "do", "case", "of", "if", "then", "else", "module", "import", "data", "type", "newtype", "class", "instance", "deriving", "qualified"})), r"[a-z_]")), "module": module_names(header=True), "comment": comment, "str": string}, "experimental"),
    Profile("ml", "OCaml", ("ml", "mli"), L.OCAML, {"def": let_names, "func": let_names, **dict.fromkeys(("type", "import", "call"), any_of("ident", keywords=frozenset({"let", "in", "rec", "and", "match", "with", "fun", "function", "if", "then", "else", "begin", "end", "struct", "sig", "module", "open", "type", "of", "val"}))), "module": module_names(header=False), "comment": comment, "str": string}, "experimental"),
    Profile("zig", "Zig", ("zig",), L.ZIG, {**dict.fromkeys(("def", "func", "struct", "enum", "type", "call"), any_of("ident", keywords=frozenset({"const", "var", "fn", "pub", "return", "if", "else", "while", "for", "struct", "enum", "union", "try", "defer", "switch", "comptime", "export", "extern", "error", "test", "and", "or", "void", "bool"}))), "import": kinds("builtin"), "comment": comment, "str": string}),
    Profile("html", "HTML", ("html",), None, {"def": html("tag"), "import": html("tag", names=("script", "link")), "call": nothing, "comment": html("comment"), "str": html("text")}, "partial", ("htm",)),
    Profile("css", "CSS", ("css",), L.CSS, {"def": css_selectors(ids=True), "type": css_selectors(ids=False), "import": css_imports, "call": nothing, "comment": comment, "str": css_values}, "partial"),
    _sql("sql", "SQL (generic)", ()),
    _sql("sqlpg", "SQL (PostgreSQL)", ("psql", "pgsql")),
    _sql("sqlmysql", "SQL (MySQL)", ("mysql",)),
    _sql("sqlsqlite", "SQL (SQLite)", ("sqlite",)),
)
BY_KEY = {x: p for p in PROFILES for x in p.extensions}
#: Keys that a language has but whose finder never finds: they count as not supported.
EMPTY = {"html": ("call",), "css": ("call",)}

#: Interpreters named in the first line of a file without extension.
SHEBANGS = (("bash", "sh"), ("/sh", "sh"), ("python", "py"), ("node", "js"), ("deno", "js"), ("ruby", "rb"), ("php", "php"), ("lua", "lua"))


def find_profile(word: str) -> Profile | None:
    """By key, id, name or extension."""
    low = word.lower()
    return BY_KEY.get(low) or next((p for p in PROFILES if low in (p.id, p.name.lower(), *p.extensions, *p.listed)), None)


def sql_dialect(text: str) -> tuple[str, str]:
    """The dialect's key and why."""
    low = text.lower()
    if re.search(r"delimiter\s+//", low):
        return "sqlmysql", "delimiter statement"
    if re.search(r"begin\s+atomic", low):
        return "sqlsqlite", "begin atomic"
    if re.search(r"returns\s+table", low):
        return "sqlpg", "returns table"
    if "language plpgsql" in text:
        return "sqlpg", "language plpgsql"
    return "sql", "no mark of a dialect"


def select(ext: str | None, text: str, override: str | None = None) -> Profile | None:
    if override:
        return find_profile(override)
    if ext and ext.lower() == "sql":
        return BY_KEY[sql_dialect(text)[0]]
    if ext:
        return BY_KEY.get(ext.lower())
    first = text.split("\n", 1)[0]
    if first.startswith("#!"):
        for mark, key in SHEBANGS:
            if mark in first:
                return BY_KEY[key]
    return None


def supported_keys(profile: Profile) -> list[str]:
    return [k for k in profile.finders if k not in EMPTY.get(profile.id, ())]


def extract(profile: Profile, text: str, keys: tuple[str, ...], over: Callable[[], bool] | None = None) -> list[tuple]:
    """All of ``captures``."""
    return list(captures(profile, text, keys, over))


def captures(profile: Profile, text: str, keys: tuple[str, ...], over: Callable[[], bool] | None = None) -> Iterator[tuple]:
    """(key, text, (start byte, end byte, start row, start column, end row, end column)) of all captures for the keys, one
    after the other; of those found before ``over`` says that time is up."""
    own = [k for k in keys if k in supported_keys(profile)]
    if not own or not text:
        return
    source = Source(text, profile.lexer or L.CSS) if profile.lexer else _Plain(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    offset = None if text.isascii() else np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]
    byte = (lambda k: k) if offset is None else (lambda k: int(offset[k]))
    starts = [0, *(k + 1 for k in np.flatnonzero(points == 10).tolist())]
    for key in own:
        for a, z in profile.finders[key](source):
            if over and over():
                return
            r, s = bisect_right(starts, a) - 1, bisect_right(starts, z) - 1
            yield key, text[a:z], (byte(a), byte(z), r, byte(a) - byte(starts[r]), s, byte(z) - byte(starts[s]))


class _Plain:
    """A source without tokens."""

    def __init__(self, text: str):
        self.text, self.tokens, self.code = text, [], []
