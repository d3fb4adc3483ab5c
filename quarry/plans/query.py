"""The query language: text to syntax tree and back.

A query is predicates ``key:value`` joined by AND (``&``), OR (``|``) and NOT (``!``), with parentheses. AND binds
tighter than OR; NOT stands at most once before a predicate or a group. White space may stand between all tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """The query can't be parsed or validated."""


#: The keys by class, and other names of keys.
METADATA_KEYS = ("ext", "name", "path", "path_exact", "in", "size", "modified")
CONTENT_KEYS = ("contains", "matches")
SEMANTIC_KEYS = ("def", "func", "import", "class", "struct", "enum", "interface", "trait", "type", "impl", "macro", "module", "object", "protocol", "comment", "str", "call")
REACT_KEYS = ("component", "element", "hook", "customhook", "prop")
ALIASES = {"c": "contains", "content": "contains", "m": "matches"}
KEYS = METADATA_KEYS + CONTENT_KEYS + SEMANTIC_KEYS + REACT_KEYS


@dataclass(frozen=True)
class Predicate:
    key: str
    value: str


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    child: Node


Node = Predicate | And | Or | Not

SPACE = " \t\r\n"
IDENTIFIER = re.compile(r"[A-Za-z0-9_]+")
BARE = re.compile(r"[^ \t\r\n()]+")
WORD_OPERATORS = {"and": "&", "or": "|"}


class _Reader:
    """Recursive descent with ordered choice: what has matched is not taken back by a later failure within a term."""

    def __init__(self, text: str):
        self.text = text

    def space(self, at: int) -> int:
        while at < len(self.text) and self.text[at] in SPACE:
            at += 1
        return at

    def expression(self, at: int) -> tuple[list, int] | None:
        items: list = []
        while True:
            start = self.space(at) if items else at
            found = self.term(start) or self.operator(start)
            if not found:
                return (items, at) if items else None
            item, at = found
            items.append(item)

    def operator(self, at: int) -> tuple[str, int] | None:
        if self.text[at : at + 1] in ("&", "|"):
            return self.text[at], at + 1
        for word, sign in WORD_OPERATORS.items():
            if self.text[at : at + len(word)].lower() == word:
                return sign, at + len(word)
        return None

    def term(self, at: int) -> tuple[tuple, int] | None:
        negated = False
        if self.text[at : at + 1] == "!":
            negated, at = True, self.space(at + 1)
        elif self.text[at : at + 3].lower() == "not":  # no word boundary is asked for
            negated, at = True, self.space(at + 3)
        found = self.predicate(at) or self.group(at)
        return found and (("not", found[0]) if negated else found[0], found[1])

    def group(self, at: int) -> tuple[tuple, int] | None:
        if self.text[at : at + 1] != "(":
            return None
        found = self.expression(self.space(at + 1))
        if not found:
            return None
        end = self.space(found[1])
        return (("group", found[0]), end + 1) if self.text[end : end + 1] == ")" else None

    def predicate(self, at: int) -> tuple[tuple, int] | None:
        key = IDENTIFIER.match(self.text, at)
        if not key:
            return None
        colon = self.space(key.end())
        if self.text[colon : colon + 1] != ":":
            return None
        start = self.space(colon + 1)
        end = self.quoted(start)
        if end is None:
            bare = BARE.match(self.text, start)
            if not bare:
                return None
            end = bare.end()
        return ("is", key[0], self.text[start:end]), end

    def quoted(self, at: int) -> int | None:
        """The end of a quoted value. After an escaped quote one more character is taken as it is."""
        quote = self.text[at : at + 1]
        if quote not in ("'", '"') or not quote:
            return None
        at += 1
        while at < len(self.text):
            step = 3 if self.text.startswith("\\" + quote, at) else 0 if self.text[at] == quote else 1
            if not step or at + step > len(self.text):
                break
            at += step
        return at + 1 if self.text[at : at + 1] == quote else None


def unescape(raw: str) -> str:
    """Within quotes a backslash stands for the character after it. What begins with a quote loses its last character."""
    if raw[:1] not in ("'", '"'):
        return raw
    if len(raw) == 1 or not raw[-1].isascii():
        raise QueryError("This is no query: two operators meet, or a value has no end.")
    return re.sub(r"\\(.?)", r"\1", raw[1:-1], flags=re.S)


def _build(items: list) -> Node:
    kinds = [isinstance(x, str) for x in items]
    if kinds[0]:
        raise QueryError("A predicate is missing before the first operator.")
    if kinds[-1]:
        raise QueryError("A predicate is missing after the last operator.")
    if any(not a and not b for a, b in zip(kinds, kinds[1:])):
        raise QueryError("Two predicates stand side by side; put & or | between them.")
    if any(a and b for a, b in zip(kinds, kinds[1:])):
        raise QueryError("This is no query: two operators meet, or a value has no end.")
    out: Node | None = None
    group = _term(items[0])
    for sign, item in zip(items[1::2], items[2::2]):
        if sign == "&":
            group = And(group, _term(item))
        else:
            out = group if out is None else Or(out, group)
            group = _term(item)
    return group if out is None else Or(out, group)


def _term(item: tuple) -> Node:
    if item[0] == "not":
        return Not(_term(item[1]))
    if item[0] == "group":
        return _build(item[1])
    return Predicate(ALIASES.get(item[1], item[1]), unescape(item[2]))


def parse(text: str) -> Node:
    if not text.strip():
        raise QueryError("There is no query: it is empty or blank.")
    reader = _Reader(text)
    try:
        found = reader.expression(reader.space(0))
        if not found or reader.space(found[1]) != len(text):
            raise QueryError(f"This is no query from character {reader.space(found[1]) if found else 0} on: {text[reader.space(found[1]) if found else 0 :][:40]!r}")
        return _build(found[0])
    except RecursionError:
        raise QueryError("The query is nested too deeply.") from None


def quoted_if_needed(value: str) -> str:
    if not value or any(c.isspace() or c in "&|()" for c in value):
        return '"' + value.replace('"', '\\"') + '"'
    return value


def canonical(node: Node) -> str:
    match node:
        case Predicate(key, value):
            return f"{key}:{quoted_if_needed(value)}"
        case And(left, right):
            sides = (f"({canonical(x)})" if isinstance(x, Or) else canonical(x) for x in (left, right))
            return " & ".join(sides)
        case Or(left, right):
            return f"{canonical(left)} | {canonical(right)}"
        case Not(child):
            inner = canonical(child)
            return f"!{inner}" if isinstance(child, Predicate) else f"!({inner})"


def flatten(node: Node, kind: type) -> list[Node]:
    """The operands of a chain of one operator, left to right."""
    return flatten(node.left, kind) + flatten(node.right, kind) if isinstance(node, kind) else [node]


def chain(kind: type, nodes: list[Node]) -> Node:
    out = nodes[0]
    for n in nodes[1:]:
        out = kind(out, n)
    return out


def stable(node: Node) -> dict:
    """A JSON form with chains as lists."""
    match node:
        case Predicate(key, value):
            return {"kind": "predicate", "key": key, "value": value}
        case Not(child):
            return {"kind": "not", "child": stable(child)}
        case And():
            return {"kind": "and", "children": [stable(x) for x in flatten(node, And)]}
        case Or():
            return {"kind": "or", "children": [stable(x) for x in flatten(node, Or)]}


def predicates(node: Node) -> list[Predicate]:
    match node:
        case Predicate():
            return [node]
        case Not(child):
            return predicates(child)
        case And(left, right) | Or(left, right):
            return predicates(left) + predicates(right)


def normalize(text: str) -> str:
    return canonical(parse(text))
