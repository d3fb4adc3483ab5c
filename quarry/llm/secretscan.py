"""Secret scans: an Aho-Corasick prefilter, anchored regular expressions near its hits, embedded checks.

The kinds that the method adds are those whose format carries a check of its own: a CRC, a length, or an encoding that
only whole keys have. Formats without one are left to the base kinds.

Defined results: a null text is an empty one; an empty text has no span; equal rows have equal results; spans are code
points, end exclusive, and any length of text is scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pass_through, small, strings

#: The base kinds' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Order of the kinds: the base first, then those that the method adds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")

#: Public formats of keys that carry a check of their own.
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: A token begins where a run of its characters does, so a run is tried once however often it holds the lead.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}+)\.(eyJ[A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{16,})")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,32}PRIVATE KEY(?: BLOCK)?)-----((?:[^-]|-(?!----)){32,}+)-----END \1-----")
ARMOUR_HEADER = re.compile(r"[A-Za-z][A-Za-z-]*: .*")
BASE62 = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}
#: Bytes of a signature by the algorithm that the token's header names; of RS and PS the key decides.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
OPENSSH, DER_SEQUENCE = b"openssh-key-v1\0", 0x30


def crc_matches(body: str, tail: str) -> bool:
    """The last six characters are the CRC-32 of the others in base 62."""
    value = 0
    for c in tail:
        value = value * 62 + BASE62[c]
    return value == zlib.crc32(body.encode())


def url_bytes(part: str) -> bytes:
    return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True)


def token_matches(head: str, claims: str, signature: str) -> bool:
    """Header and claims are JSON objects, and the signature is as long as the algorithm makes it."""
    try:
        first, second, n = json.loads(url_bytes(head)), json.loads(url_bytes(claims)), len(url_bytes(signature))
    except (ValueError, RecursionError):
        return False
    if not isinstance(first, dict) or not isinstance(second, dict) or not isinstance(first.get("alg"), str):
        return False
    return n == SIGNATURES[first["alg"]] if first["alg"] in SIGNATURES else first["alg"][:2] in ("RS", "PS") and n >= 128


def crc24(data: bytes) -> int:
    value = 0xB704CE
    for byte in data:
        value ^= byte << 16
        for _ in range(8):
            value <<= 1
            if value & 0x1000000:
                value ^= 0x1864CFB
    return value


def der_fits(data: bytes) -> bool:
    """One DER sequence whose own length is that of the rest."""
    if len(data) < 2 or data[0] != DER_SEQUENCE:
        return False
    n, at = data[1], 2
    if n >= 0x80:
        at += n & 0x7F
        n = int.from_bytes(data[2:at], "big")
    return at < len(data) and n == len(data) - at


def key_fits(label: str, body: str) -> bool:
    """What stands between the marks says itself that it is whole: DER by its length, an OpenSSH key by its mark, an
    armoured block by its CRC-24, an encrypted key by whole cipher blocks."""
    lines = [x.strip() for x in body.splitlines()]
    heads = [x for x in lines if ARMOUR_HEADER.fullmatch(x)]
    packed = [x for x in lines if x and x not in heads]
    check = packed.pop() if label.endswith("BLOCK") and packed and packed[-1][:1] == "=" else None
    try:
        data = base64.b64decode("".join("".join(packed).split()), validate=True)
        if label.endswith("BLOCK"):
            return check is not None and bool(data) and crc24(data) == int.from_bytes(base64.b64decode(check[1:], validate=True), "big")
    except ValueError:
        return False
    if label.startswith("OPENSSH"):
        return data.startswith(OPENSSH)
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in heads):
        return len(data) >= 16 and len(data) % 8 == 0
    return not heads and der_fits(data)


#: Lead of a key -> (kind, pattern, check of the match).
NEAR = {
    **{f"gh{c}_": ("github", GITHUB, lambda m: crc_matches(m[1], m[2])) for c in "pousr"},
    "npm_": ("npm", NPM, lambda m: crc_matches(m[1], m[2])),
    "eyJ": ("jwt", JWT, lambda m: token_matches(*m.groups())),
    "-----BEGIN ": ("pem", PEM, lambda m: key_fits(*m.groups())),
}

_automaton = None


def automaton():
    """All spellings of the words in either case, so that texts need no lower-casing; one for each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word in WORDS:
            for chars in itertools.product(*({c, c.upper()} for c in word)):
                _automaton.add_word("".join(chars), ("assign", len(word)))
        _automaton.add_word("AKIA", ("access", 4))
        for lead in NEAR:
            _automaton.add_word(lead, (lead, len(lead)))
        _automaton.make_automaton()
    return _automaton


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind), by start and kind.

    Base matches are leftmost and don't overlap within a kind; a match that fails the length still takes its characters.
    """
    out = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton().iter(text):
        hits.setdefault(kind, []).append(end - n + 1)
    for kind, starts in hits.items():
        free = 0
        starts.sort()
        if kind == "assign":
            for s in starts:
                if s >= free and (m := ASSIGN.match(text, s)):
                    free = m.end()
                    if len(m[2]) >= LEAST_ASSIGN:
                        out.append((s, free, 0))
        elif kind == "access":
            for s in starts:
                if s >= free and (m := ACCESS.match(text, s)):
                    free = m.end()
                    if free - s >= LEAST_ACCESS:
                        out.append((s, free, 1))
        else:
            name, pattern, check = NEAR[kind]
            for s in starts:
                if s >= free and (m := pattern.match(text, s)) and check(m):
                    free = m.end()
                    out.append((s, free, KINDS.index(name)))
    return sorted(out, key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document, however often its id occurs: counts of the base kinds, a digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [find(t) for t in strings(b.column(1))]
            base = [[x for x in f if x[2] < 3] for f in found]
            counts = [pa.array([sum(x[2] == k for x in f) for f in base], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([joined(f) for f in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def masked(text: str, mask: str) -> str:
    """The text with every span, overlapping ones as one, replaced by the mask."""
    out, at, spans = [], 0, sorted((a, b) for a, b, _ in find(text))
    for k, (a, b) in enumerate(spans):
        if k and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "<SECRET>", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with secrets masked in the text and the length column, where there is one, following it."""

    def change(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.schema.names
        at = names.index(text_col)
        old = b.column(at).to_pylist()
        new = [t and masked(t, mask) for t in old]
        columns = list(b.columns)
        columns[at] = pa.array(new, b.schema.field(at).type)
        if length_col in names and pa.types.is_integer(b.schema.field(length_col).type):
            k = names.index(length_col)
            differs = pa.array([a != b for a, b in zip(old, new)])
            sizes = pa.array(np.array([len(t or "") for t in new], np.int64)).cast(b.schema.field(k).type)
            columns[k] = pa.compute.if_else(differs, sizes, columns[k])
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return pass_through(docs, change)
