"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from left to right into
longest matches: each phrase is the longest run of characters that occurs in the language's text. The language with the
fewest phrases, normalised by the size of its sample, wins.

The classifier is fitted on a bounded sample: of each language the ``DOCS`` training documents of the smallest id hash,
at most ``DOC_CHARS`` characters of each, ``SAMPLE_CHARS`` in all. The automata are built once in each Python worker
from that text, which is all that is broadcast. Parsing covers whole texts; a phrase also ends after every ``SPAN``
characters, so that the spans of all texts advance in step as arrays.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from; equal
texts have equal results; ties go to the language that is first in order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, strings

DOCS, DOC_CHARS, SAMPLE_CHARS, SPAN = 64, 2000, 16_000, 256
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")
#: All code points.
POINTS = 0x110000
#: A language of more characters than this has its steps in a sorted list, not in a table of states by characters.
WIDE = 256


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def normalise(text: str) -> str:
    """Lower-cased words of letters alone, with one space between."""
    return " ".join(NO_LETTERS.sub(" ", text.lower()).split())


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """The ids are chosen over narrow rows, each task keeping ``DOCS`` of a language at most; then those texts are read."""
    known = docs.where(F.col(lang_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = known.where(F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"))
    chosen = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= DOCS).select("id").distinct()
    texts = known.join(F.broadcast(chosen), known[id_col].eqNullSafe(chosen["id"]), "left_semi")
    cut = texts.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.substring(text_col, 1, 2 * DOC_CHARS).alias("text")).where("text is not null")
    cut = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= DOCS)
    out: dict[str, list[str]] = {}
    for r in sorted(cut.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(normalise(r["text"])[:DOC_CHARS])
    return {lang: "\n".join(x)[:SAMPLE_CHARS] for lang, x in sorted(out.items()) if any(x)}


def automaton_steps(codes: list[int]) -> list[dict[int, int]]:
    """By state of the automaton of all substrings: code -> state. State 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """The steps as a table: [state, code] -> state, or -1."""
    step = automaton_steps(codes)
    out = np.full((len(step), width), -1, np.int32)
    for s, by in enumerate(step):
        if by:
            out[s, list(by)] = list(by.values())
    return out


class Parser:
    """Phrases of many texts at once, against each language."""

    def __init__(self, samples: dict[str, str]):
        self.langs = list(samples)
        chars = sorted({c for text in samples.values() for c in text} - {"\n", " "})
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        self.gap = self.code[" "] = len(chars) + 1
        #: By code point: a sample's character, or a gap for what is no letter; other letters have code 0, which matches nothing.
        self.table = np.full(POINTS, self.gap, np.int32)
        self.table[[p for p in range(POINTS) if LETTER.match(chr(p))]] = 0
        for c, k in self.code.items():
            self.table[ord(c)] = k
        self.own, self.steps, self.norm = [], [], []
        for text in samples.values():
            mine = sorted({self.code[c] for c in text if c != "\n"} | {self.gap})
            own = np.zeros(self.gap + 1, np.int32)  # each language has an alphabet of its own
            own[mine] = np.arange(1, len(mine) + 1)
            self.own.append(own)
            coded = [int(own[self.code[c]]) if c != "\n" else 0 for c in text]
            self.steps.append(self.wide(coded, len(mine) + 1) if len(mine) >= WIDE else self.narrow(coded, len(mine) + 1))
            self.norm.append(math.log2(max(2, len(text))))

    @staticmethod
    def narrow(coded: list[int], width: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """(states, codes) -> the next states, and in the lowest bit whether a phrase ended before this character."""
        raw = suffix_automaton(coded, width)
        raw[:, 0] = -1  # unknown characters and sample borders end a phrase
        bits = max(1, (width - 1).bit_length())
        full = np.where(raw >= 0, raw << 1, np.maximum(raw[0], 0)[None, :] << 1 | 1)
        padded = np.zeros((len(raw), 1 << bits), np.int32)
        padded[:, :width] = full
        flat = padded.ravel()
        return lambda state, c: flat[(state << bits) | c]

    @staticmethod
    def wide(coded: list[int], width: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """The same by a search among the steps that there are."""
        step = automaton_steps(coded)
        found = sorted((s * width + c, to) for s, by in enumerate(step) for c, to in by.items() if c)
        keys, to = (np.array(x, np.int64) for x in zip(*found))
        start = np.ones(width, np.int32)
        for c, first in step[0].items():
            if c:
                start[c] = first << 1 | 1

        def follow(state: np.ndarray, c: np.ndarray) -> np.ndarray:
            key = state.astype(np.int64) * width + c
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, to[at] << 1, start[c]).astype(np.int32)

        return follow

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[text, language] phrases of whole lower-cased texts; a run of what are no letters is one gap."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.table[points]
        gap = codes == self.gap
        kept = ~(gap & np.r_[False, gap[:-1]])
        bounds = np.cumsum([0, *map(len, texts)])
        sizes = np.diff(np.r_[0, np.cumsum(kept)][bounds])
        codes = codes[kept]
        spans = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(texts)), spans)
        first = np.repeat(np.cumsum(sizes) - sizes, spans) + SPAN * (np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans))
        lengths = np.minimum(SPAN, np.repeat(np.cumsum(sizes), spans) - first)
        order = np.argsort(-lengths, kind="stable")
        owner, first, lengths = owner[order], first[order], lengths[order]
        for a in range(0, len(owner), 8192):
            o, f, n = owner[a : a + 8192], first[a : a + 8192], lengths[a : a + 8192]
            alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
            columns = [codes[f[:m] + k] for k, m in enumerate(alive)]
            for j, (own, step) in enumerate(zip(self.own, self.steps)):
                state = np.zeros(len(o), np.int32)
                count = np.ones(len(o), np.int32)
                for c in columns:
                    m = len(c)
                    got = step(state[:m], own[c])
                    count[:m] += got & 1
                    state[:m] = got >> 1
                np.add.at(out[:, j], o, count)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The score is 1 less the winner's part of the runner-up's normalised phrases; 1 if there is but one language."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = self.phrases([t.lower() for t in texts]) * np.array(self.norm)
        best = bits.argmin(axis=1)
        ranked = np.sort(bits, axis=1)
        sure = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-9) if len(self.langs) > 1 else np.ones(len(texts))
        known = [bool(LETTER.search(t)) for t in texts]
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)], [float(s) if ok else 0.0 for s, ok in zip(sure, known)]


_parsers: dict[int, Parser] = {}
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for every document: whether it was held out of training, its language and how sure that is."""
    samples = training_sample(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    key = hash(tuple(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(shared.value)
        for b in small(batches):
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                lang, score = _parsers[key].predict(strings(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
