"""Which files of a directory are left out: default rules, ignore files, and what takes files back in."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass
from pathlib import Path

#: Left out unless a root ignore file takes them back in.
DEFAULT_IGNORES = ("node_modules/**", "target/**", "dist/**", "build/**", ".git/**", ".svn/**", ".hg/**", "**/*.pyc", "**/__pycache__/**")
#: Directories that default rules leave out whole.
CLOSED = ("node_modules", "target", "dist", "build", ".git", ".svn", ".hg", "__pycache__")
#: Ignore files of every directory, the later ones weighing more.
IGNORE_FILES = (".gitignore", ".ignore", ".quarryignore")
OWN_FILE = IGNORE_FILES[-1]
#: A user's own rules, which weigh least.
GLOBAL_IGNORE = str(Path.home() / ".config" / "quarry" / "ignore")


def rule_regex(pattern: str) -> str:
    """A line of an ignore file, without '!' and trailing '/', as a regular expression for paths below its directory."""
    anchored = "/" in pattern
    body, out, at = pattern.lstrip("/"), "", 0
    while at < len(body):
        if body.startswith("**/", at) and (at == 0 or body[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif body[at:] == "**" and (at == 0 or body[at - 1] == "/"):
            out, at = out + ".+", at + 2
        elif body[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif body[at] == "?":
            out, at = out + "[^/]", at + 1
        elif body[at] == "[" and "]" in body[at + 2 :]:
            end = body.index("]", at + 2)
            inner = body[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif body[at] == "\\" and at + 1 < len(body):
            out, at = out + re.escape(body[at + 1]), at + 2
        else:
            out, at = out + re.escape(body[at]), at + 1
    return ("" if anchored else "(?:.*/)?") + out


@dataclass(frozen=True)
class Rule:
    source: str
    text: str
    regex: re.Pattern
    negated: bool
    only_dirs: bool


class Rules:
    """The last rule that matches a file, or a directory above it, decides. Rules of the directories above the one that was
    entered last are kept, no others."""

    def __init__(self, base: str, no_ignore: bool = False, extra: tuple[str, ...] = ()):
        self.base, self.no_ignore = base, no_ignore
        self.own = [r for line in extra if (r := self._rule(line, "global"))]
        self.rules: dict[str, list[Rule]] = {}
        self.back: list[re.Pattern] = []
        self.defaults = [(p, re.compile(rule_regex("/" + p if not p.startswith("**") else p))) for p in DEFAULT_IGNORES]

    @staticmethod
    def _rule(line: str, source: str) -> Rule | None:
        line = line.strip()
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        body = line[negated:].strip()
        only_dirs, body = body.endswith("/"), body.rstrip("/")
        return Rule(source, line, re.compile(rule_regex(body)), negated, only_dirs) if body else None

    def enter(self, where: str) -> None:
        """Reads the ignore files of a directory, before its entries are looked at."""
        if self.no_ignore:
            return
        self.rules = {w: r for w, r in self.rules.items() if not w or where == w or where.startswith(w + "/")}
        found = []
        for name in IGNORE_FILES:
            file = Path(self.base, where, name)
            if file.is_file():
                for line in file.read_text(errors="replace").splitlines():
                    if rule := self._rule(line, posixpath.join(where, name)):
                        found.append(rule)
                    if not where and name == OWN_FILE and line.strip().startswith("!"):
                        body = line.strip()[1:].strip()
                        self.back.append(re.compile(rule_regex("/" + body + "**" if body.endswith("/") else "/" + body)))
        if found:
            self.rules[where] = found

    def closed(self, rel: str) -> bool:
        """Whether nothing below a directory can be taken in, so that it need not be listed: a default rule has all of it,
        and no rule takes anything back."""
        return not self.back and any(r.fullmatch(rel + "/x") for _, r in self.defaults) and rel.split("/")[-1] in CLOSED

    def ignoring(self, rel: str) -> tuple[str, str] | None:
        """Where the rule stands that leaves a file out, and the rule; None if the file stays."""
        default = next((p for p, r in self.defaults if r.fullmatch(rel)), None)
        if default and not any(r.fullmatch(rel) for r in self.back):
            return "default", default
        last = None
        for where, rules in (("", self.own), *sorted(self.rules.items())):
            if where and not rel.startswith(where + "/"):
                continue
            below = posixpath.relpath(rel, where) if where else rel
            parts = below.split("/")
            names = ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]
            for rule in rules:
                if any(rule.regex.fullmatch(n) for n in (names[:-1] if rule.only_dirs else names)):
                    last = rule
        return None if last is None or last.negated else (last.source, last.text)


def global_rules(file: str = GLOBAL_IGNORE) -> tuple[str, ...]:
    """The lines of a user's own rules."""
    return tuple(Path(file).read_text(errors="replace").splitlines()) if Path(file).is_file() else ()
