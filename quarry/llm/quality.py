"""Quality rules: a short-circuit cascade in the order of rejection per cost, measured on a sample.

Defined results: a null or empty text has no words and fails the base rules; equal texts have equal results; a text of
any length is read whole. Words are runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pass_through, small, utf8

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


class Features:
    """What the rules ask of one text; each is computed when it is first asked for."""

    __slots__ = ("_lines", "_words", "data")

    def __init__(self, data: bytes):
        self.data, self._words, self._lines = data, None, None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.data.split()  # of bytes: at these six characters only
        return self._words

    @property
    def lines(self) -> list[bytes]:
        """The lines with a word."""
        if self._lines is None:
            self._lines = [x for x in self.data.split(b"\n") if x and not x.isspace()]
        return self._lines

    def word_chars(self) -> int:
        return len(self.data.decode("utf-8", "replace")) - sum(map(self.data.count, (SPACES[k : k + 1] for k in range(6))))

    def n_symbols(self) -> int:
        return sum(map(self.data.count, (SYMBOLS[k : k + 1] for k in range(8))))

    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def n_repeat_words(self) -> int:
        """Words in windows of three words that the text has twice or more, the first included."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = {x for x, n in Counter(windows).items() if n > 1}
        total = free = 0
        for k, x in enumerate(windows):
            if x in often:
                total += k + 3 - max(free, k)
                free = k + 3
        return total

    def n_letter_words(self) -> int:
        """Words with an ASCII letter or any character beyond ASCII."""
        return sum(1 for x in self.words if not x.isascii() or x.upper() != x.lower())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


#: The base rules' limits, then those of the further rules, which are this operator's parameters.
RULES = (
    Rule("few_words", lambda f: len(f.words) < 50, base=True),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words() > 50 * len(f.words), base=True),
    Rule("symbols", lambda f: 4 * f.n_symbols() > len(f.words)),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines() > len(f.lines)),
    Rule("word_length", lambda f: not 2 * len(f.words) <= f.word_chars() <= 15 * len(f.words)),
    Rule("letters", lambda f: 100 * f.n_letter_words() < 70 * len(f.words)),
)
SAMPLE = 2000


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[str]:
    """The rules' names by rejections per second on about ``sample`` random rows; the sample stays on the executors.

    The order decides the cost alone: a text is kept if no rule rejects it. An empty table gives the order as declared.
    """
    n = docs.count()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits = dict.fromkeys([r.name for r in rules], 0.0), dict.fromkeys([r.name for r in rules], 0)
        for b in small(batches):
            for data in utf8(b.column(0)):
                for r in rules:
                    f = Features(data)
                    f.words  # noqa: B018  split once for all rules, so no part of a rule's cost
                    began = time.perf_counter()
                    hits[r.name] += r.rejects(f)
                    cost[r.name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(cost)), pa.array(list(cost.values())), pa.array(list(hits.values()), pa.int64())], names=["rule", "cost", "hits"])

    part = docs.select(text_col).sample(min(1.0, sample / max(n, 1)), seed=7)
    rows = part.mapInArrow(measure, "rule string, cost double, hits long").groupBy("rule").agg(F.sum("hits").alias("h"), F.sum("cost").alias("c")).collect()
    rate = {r["rule"]: r["h"] / max(r["c"], 1e-9) for r in rows}
    return sorted((r.name for r in rules), key=lambda x: -rate.get(x, 0.0))


def passes(data: bytes, ordered: list[Rule]) -> bool:
    f = Features(data)
    return not any(r.rejects(f) for r in ordered)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for every document: the base figures, whether the base rules fail it, and the cascade's verdict."""
    by = {r.name: r for r in rules}
    names = order_rules(docs, text_col, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [by[x] for x in names if not by[x].base]
        for b in small(batches):
            rows = []
            for data in utf8(b.column(1)):
                f = Features(data)
                n, repeats = len(f.words), f.n_repeat_words()
                failed = n < 50 or 100 * repeats > 50 * n
                rows.append((n, f.word_chars(), f.n_symbols(), f.n_dup_lines(), repeats, failed, not failed and not any(r.rejects(f) for r in cascade)))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    by = {r.name: r for r in rules}
    names = order_rules(docs, text_col, rules)

    def change(b: pa.RecordBatch) -> pa.RecordBatch:
        cascade = [by[x] for x in names]
        return b.filter(pa.array([passes(data, cascade) for data in utf8(b.column(b.schema.get_field_index(text_col)))], pa.bool_()))

    return pass_through(docs, change)
