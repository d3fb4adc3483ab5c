"""Tolerant tokenizers: comments, strings, identifiers and punctuation of a source text, whatever its state.

Comments and strings are consumed first, so that nothing in them is taken for code. Positions are characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    text: str


IDENT = r"[^\W\d]\w*"
NUMBER = r"\d[\w.]*"
DOUBLE = r'"(?:\\[\s\S]|[^"\\\n])*"'
SINGLE = r"'(?:\\[\s\S]|[^'\\\n])*'"
LONG_DOUBLE = r'"(?:\\[\s\S]|[^"\\])*"'
LONG_SINGLE = r"'(?:\\[\s\S]|[^'\\])*'"
SLASHES = r"//[^\n]*"
BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
HASHES = r"\#[^\n]*"


@dataclass(frozen=True)
class Lexer:
    """``rules``: (kind, expression) pairs in order of precedence; ``nested``: an opening and closing mark that nest."""

    rules: tuple[tuple[str, str], ...]
    nested: tuple[str, str] | None = None
    ident: str = IDENT
    templates: bool = False
    regexes: bool = False

    def __post_init__(self):
        parts = [f"(?P<{kind}_{k}>{x})" for k, (kind, x) in enumerate(self.rules)]
        parts += [f"(?P<ident_>{self.ident})", f"(?P<number_>{NUMBER})", r"(?P<space_>\s+)", r"(?P<punct_>=>|->|::|\?\.|&&|\|\||==|!=|<=|>=|[\s\S])"]
        object.__setattr__(self, "pattern", re.compile("|".join(parts)))

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        at, size = 0, len(text)
        while at < size:
            if self.nested and text.startswith(self.nested[0], at):
                end = self._nested_end(text, at)
                out.append(Token("comment", at, end, text[at:end]))
            elif self.templates and text[at] == "`":
                end = template_end(text, at)
                out.append(Token("template", at, end, text[at:end]))
            elif self.regexes and text[at] == "/" and (end := self._regex_end(text, at, out)):
                out.append(Token("regex", at, end, text[at:end]))
            else:
                m = self.pattern.match(text, at)
                end, kind = m.end(), m.lastgroup.rpartition("_")[0]
                if kind != "space":
                    out.append(Token(kind, at, end, m[0]))
            at = end
        return out

    def _nested_end(self, text: str, at: int) -> int:
        opening, closing = self.nested
        depth, marks = 0, re.compile(re.escape(opening) + "|" + re.escape(closing))
        for m in marks.finditer(text, at):
            depth += 1 if m[0] == opening else -1
            if not depth:
                return m.end()
        return len(text)

    @staticmethod
    def _regex_end(text: str, at: int, before: list[Token]) -> int | None:
        """A slash begins a regular expression where no operand stands before it."""
        if text.startswith(("//", "/*"), at):
            return None
        last = next((t for t in reversed(before) if t.kind != "comment"), None)
        if last and (last.kind in ("number", "str", "template", "regex") or last.kind == "ident" and last.text not in OPERAND_KEYWORDS or last.text in (")", "]", "}")):
            return None
        m = REGEX_LITERAL.match(text, at)
        return m and m.end()


OPERAND_KEYWORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await", "instanceof"}
REGEX_LITERAL = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def template_end(text: str, at: int) -> int:
    """The end of a template string, past nested templates in its ``${}`` parts."""
    at, size = at + 1, len(text)
    while at < size:
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < size and depth:
                if text[at] == "`":
                    at = template_end(text, at)
                    continue
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
        else:
            at += 1
    return min(at, size)


C_LIKE = (("comment", SLASHES), ("comment", BLOCK))

RUST = Lexer((("comment", SLASHES), ("str", r'b?r(?P<hash>\#*)"[\s\S]*?"(?P=hash)'), ("str", r'[bc]?"(?:\\[\s\S]|[^"\\])*"'), ("char", r"b?'(?:\\(?:[^u']|u\{[^}]*\})[^']{0,2}|[^\\'\n])'"), ("life", rf"'{IDENT}")), nested=("/*", "*/"), ident=r"(?:r\#)?[^\W\d]\w*")
PYTHON = Lexer((("comment", HASHES), ("str", r"(?i:[rbfut]{0,2})(?:'''[\s\S]*?(?:(?<!\\)'''|\Z)|\"\"\"[\s\S]*?(?:(?<!\\)\"\"\"|\Z))"), ("str", rf"(?i:[rbfut]{{0,2}})(?:{DOUBLE}|{SINGLE})")))
SCRIPT = Lexer((*C_LIKE, ("str", DOUBLE), ("str", SINGLE)), ident=r"[#$]?(?:[^\W\d]|\$)[\w$]*", templates=True, regexes=True)
GO = Lexer((*C_LIKE, ("str", DOUBLE), ("str", r"`[^`]*`"), ("char", SINGLE)))
JAVA = Lexer((*C_LIKE, ("str", r'"""[\s\S]*?"""'), ("str", DOUBLE), ("char", SINGLE)))
C = Lexer((*C_LIKE, ("include", r"\#[ \t]*include[ \t]*(?:<[^>\n]*>|\"[^\"\n]*\")"), ("define", r"\#[ \t]*define\b"), ("str", rf"(?:u8|[uUL])?{DOUBLE}"), ("char", SINGLE)))
CPP = Lexer((*C_LIKE, ("include", r"\#[ \t]*include[ \t]*(?:<[^>\n]*>|\"[^\"\n]*\")"), ("define", r"\#[ \t]*define\b"), ("raw", r'(?:u8|[uUL])?R"(?P<tag>[^()\\\s]{0,16})\([\s\S]*?\)(?P=tag)"'), ("str", rf"(?:u8|[uUL])?{DOUBLE}"), ("char", SINGLE)))
CSHARP = Lexer((*C_LIKE, ("str", r'\$*"""[\s\S]*?"""'), ("str", r'(?:@\$?|\$@)"(?:""|[^"])*"'), ("str", rf"\$?{DOUBLE}"), ("char", SINGLE)), ident=rf"@?{IDENT}")
PHP = Lexer((("comment", SLASHES), ("comment", BLOCK), ("comment", r"\#(?!\[)[^\n]*"), ("str", r"<<<[ \t]*(?P<q>['\"]?)(?P<tag>\w+)(?P=q)\n[\s\S]*?\n[ \t]*(?P=tag)\b"), ("str", LONG_DOUBLE), ("str", LONG_SINGLE), ("var", r"\$\w+"), ("name", r"\\?[^\W\d]\w*(?:\\\w+)+|\\[^\W\d]\w*")))
RUBY = Lexer((("comment", r"(?m:^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z))"), ("comment", HASHES), ("str", r"<<[~-]?(?P<q>['\"]?)(?P<tag>[A-Z_]+)(?P=q)[^\n]*\n[\s\S]*?\n[ \t]*(?P=tag)\b"), ("str", LONG_DOUBLE), ("str", LONG_SINGLE), ("sym", r":(?:[^\W\d]\w*[?!]?|\"[^\"]*\")"), ("ivar", r"@@?\w+|\$\w+")), ident=r"[^\W\d]\w*[?!]?(?!=)|[^\W\d]\w*")
BASH = Lexer((("comment", r"(?<![\w$\"'{])\#[^\n]*"), ("str", r'"(?:\\[\s\S]|[^"\\])*"'), ("raw", r"\$?'[^']*'"), ("var", r"\$(?:\w+|\{[^}]*\}|[@#?*!$-])")), ident=r"[\w./+-]+")
LUA = Lexer((("comment", r"--\[(?P<e>=*)\[[\s\S]*?(?:\](?P=e)\]|\Z)"), ("comment", r"--[^\n]*"), ("str", r"\[(?P<f>=*)\[[\s\S]*?\](?P=f)\]"), ("str", DOUBLE), ("str", SINGLE)))
SCALA = Lexer((("comment", SLASHES), ("str", r'[a-z]*"""[\s\S]*?"""'), ("str", rf"(?:[a-z]\w*)?{DOUBLE}"), ("char", r"'(?:\\.|[^'\\])'")), nested=("/*", "*/"))
SWIFT = Lexer((("comment", SLASHES), ("str", r'(?P<p>\#*)"""[\s\S]*?"""(?P=p)'), ("str", r'(?P<o>\#+)"[^\n]*?"(?P=o)'), ("str", DOUBLE)), nested=("/*", "*/"))
ELIXIR = Lexer((("comment", HASHES), ("str", r'"""[\s\S]*?"""'), ("str", LONG_DOUBLE), ("char", SINGLE), ("sym", r":[^\W\d]\w*[?!]?")), ident=r"[^\W\d]\w*[?!]?")
HASKELL = Lexer((("comment", r"--+(?![!#$%&*+./<=>?@\\^|~:])[^\n]*"), ("str", LONG_DOUBLE), ("char", r"'(?:\\[^'\n]+|[^'\\\n])'")), nested=("{-", "-}"), ident=r"[^\W\d][\w']*")
OCAML = Lexer((("str", LONG_DOUBLE), ("str", r"\{(?P<t>[a-z_]*)\|[\s\S]*?\|(?P=t)\}"), ("char", r"'(?:\\[^'\n]+|[^'\\\n])'")), nested=("(*", "*)"), ident=r"[^\W\d][\w']*")
ZIG = Lexer((("comment", SLASHES), ("str", r"\\\\[^\n]*(?:\n[ \t]*\\\\[^\n]*)*"), ("str", DOUBLE), ("char", SINGLE), ("builtin", rf"@{IDENT}")))
SQL = Lexer((("comment", r"--[^\n]*"), ("comment", BLOCK), ("str", r"'(?:''|[^'])*'"), ("dollar", r"\$(?P<t>\w*)\$[\s\S]*?\$(?P=t)\$"), ("name", r'"(?:""|[^"])*"|`[^`]*`|\[[^\]\n]*\]')))
CSS = Lexer((("comment", BLOCK), ("str", DOUBLE), ("str", SINGLE), ("at", r"@[\w-]+"), ("hash", r"\#[\w-]+")), ident=r"-?-?[^\W\d][\w-]*")
