"""Two dialects of glob patterns, as anchored regular expressions of Java."""

from __future__ import annotations

import re

from quarry.plans.query import QueryError

SPECIAL = set("\\.[]{}()<>*+-=!?^$|&#~/ \t\n\r\"'")


def escaped(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def _class(pattern: str, at: int, negations: str) -> tuple[str, int]:
    """A bracketed class from the character after '['; a ']' that comes first is a member."""
    negated = pattern[at : at + 1] != "" and pattern[at] in negations
    start = at + negated
    end = pattern.find("]", start + 1)
    if end < 0:
        raise QueryError(f"Invalid glob pattern: unclosed character class in '{pattern}'.")
    members, k, body = pattern[start:end], 0, ""
    while k < len(members):
        if members[k + 1 : k + 2] == "-" and k + 2 < len(members):
            if members[k] > members[k + 2]:
                raise QueryError(f"Invalid glob pattern: invalid range in '{pattern}'.")
            body += f"{escaped(members[k])}-{escaped(members[k + 2])}"
            k += 3
        else:
            body += escaped(members[k])
            k += 1
    return f"[{'^' if negated else ''}{body}]", end + 1


def name_regex(pattern: str) -> str:
    """Of base names: ``* ? [..] [!..]``, in either case of ASCII letters; ``**`` only as a whole path component."""
    if not pattern:
        raise QueryError("A glob needs at least one character.")
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            stars = len(pattern) - at - len(pattern[at:].lstrip("*"))
            after = pattern[at + stars : at + stars + 1]
            if stars > 2 or stars == 2 and (after not in ("", "/") or at and pattern[at - 1] != "/"):
                raise QueryError(f"Invalid glob pattern: '**' must be a path component of its own in '{pattern}'.")
            if stars == 2 and after == "/":
                out, at = out + "(?:.*/)?", at + 3
            else:
                out, at = out + ".*", at + stars
        elif c == "?":
            out, at = out + ".", at + 1
        elif c == "[":
            got, at = _class(pattern, at + 1, "!")
            out += got
        else:
            out, at = out + escaped(c), at + 1
    return f"(?is)^(?:{out})$"


def path_regex(pattern: str) -> str:
    """Of whole paths, case-sensitive: ``*`` and ``?`` cross separators; ``**`` components, ``{a,b}``, ``[..]``, escapes."""
    out, at, depth = "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            stars = len(pattern) - at - len(pattern[at:].lstrip("*"))
            before, after = pattern[at - 1 : at] if at else "", pattern[at + stars : at + stars + 1]
            if stars == 2 and before in ("", "/") and after in ("", "/"):
                if not before:
                    out, at = out + ("(?:/?|.*/)" if after else ".*"), at + 2 + bool(after)
                elif after:
                    out, at = out[: -len(escaped("/"))] + "(?:/|/.*/)", at + 3
                else:
                    out, at = out + ".*", at + 2
            else:
                out, at = out + ".*", at + stars
        elif c == "?":
            out, at = out + ".", at + 1
        elif c == "[":
            got, at = _class(pattern, at + 1, "!^")
            out += got
        elif c == "{":
            out, at, depth = out + "(?:", at + 1, depth + 1
        elif c == "}":
            if not depth:
                raise QueryError(f"Invalid glob pattern: unopened alternation in '{pattern}'.")
            out, at, depth = out + ")", at + 1, depth - 1
        elif c == "," and depth:
            out, at = out + "|", at + 1
        elif c == "\\":
            if at + 1 == len(pattern):
                raise QueryError(f"Invalid glob pattern: dangling '\\' in '{pattern}'.")
            out, at = out + escaped(pattern[at + 1]), at + 2
        else:
            out, at = out + escaped(c), at + 1
    if depth:
        raise QueryError(f"Invalid glob pattern: unclosed alternation in '{pattern}'.")
    return f"(?s)^(?:{out})$"


def has_glob(value: str) -> bool:
    return any(c in value for c in "*?[{")


def plain_name(pattern: str) -> tuple[str, str] | None:
    """A name pattern of one literal with stars at its ends at most: what comparison does it, on lower-cased names."""
    core = pattern.strip("*")
    if not core or not core.isascii() or re.search(r"[*?\[\]/]", core) or "**" in pattern:
        return None
    kind = {(False, False): "equals", (True, False): "endswith", (False, True): "startswith", (True, True): "contains"}
    return kind[pattern[0] == "*", pattern[-1] == "*"], core.lower()
