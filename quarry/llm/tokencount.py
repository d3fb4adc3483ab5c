"""Numbers of tokens of whole texts by a sentencepiece model, without keeping any ids.

Rows come in Arrow batches, which are dealt anew by bytes, and long texts are cut at safe boundaries. What is between two
boundaries is encoded once for a batch, many in a call, and kept for later batches; only lengths go back.

A cut is safe if no token of the model reaches over it. A token is a piece of the vocabulary, so none reaches over two
characters that no piece holds side by side:

- before a space after another character, as in this kind of model a space stands only at a piece's start or among spaces.
  The space goes with the text after it, where it becomes the mark that the library puts before a text anyway;
- in texts without such spaces, between two characters that are in no piece together, if the second is in none after the
  mark either: the mark is then a token of its own, which is taken off again.

Models of another shape (marks within pieces, symbols given by the user, normalising, another or no mark before a text)
are recognised by their vocabulary and by what they make of a probe, and get their texts whole.

Defined results: a null text counts as empty, and an empty text has no tokens; strings of special tokens are plain text,
as is the library's default. Rows with a null or repeated doc_id are counted like all others. Columns but doc_id and text
aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: The mark that stands for a space.
MARK = "▁"
#: A space that a text may be cut at: after another character, and not the text's last one.
SAFE = re.compile(f"(?<=[^ {MARK}]) (?=.)", re.S)
#: Bytes of text that are counted at once; characters of a text from which it is cut before, and of a piece without spaces.
BATCH_BYTES, LONG_TEXT, LONG_PIECE = 8 << 20, 4 << 20, 1 << 14
#: Bytes that go to the library in one call.
CALL_BYTES = 1 << 20
#: Pieces whose counts a worker keeps at most before it starts anew; longer pieces are not kept.
KEPT, KEPT_CHARS = 500_000, 64
#: A text that every other normaliser changes: runs of spaces, a ligature, a tab, a wide space, a composed letter, capitals.
PROBE = " a  Bﬁ\t　Å "

COUNTS = "doc_id long, n_bytes long, n_tokens long"


class Counter:
    """count(texts) -> the number of tokens of each."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=file)
        usable = [k for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k))]
        pieces = [m.id_to_piece(k) for k in usable]
        self.pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        normal = m.normalize(PROBE) == (" " + PROBE).replace(" ", MARK)
        self.safe = normal and not any(b == MARK != a for a, b in self.pairs)
        #: Every character has tokens of its own: unknown ones aren't drawn together.
        self.bytewise = any(m.is_byte(k) for k in range(m.get_piece_size()))
        self.kept: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        """Counts of texts as the library takes them, in calls of about equal bytes."""
        out, at, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= CALL_BYTES:
                out += map(len, self.model.encode(texts[at : k + 1], num_threads=1))
                at, size = k + 1, 0
        return out + [len(x) for x in self.model.encode(texts[at:], num_threads=1)]

    def _long_piece(self, piece: str) -> list[tuple[str, int]]:
        """(text, tokens to take off) of a long piece that is cut where no token reaches over."""
        out, at, less, k = [], 0, 0, LONG_PIECE
        while self.bytewise and k < len(piece):
            after = piece[k]
            if piece[k - 1 : k + 1].replace(" ", MARK) in self.pairs or MARK + after in self.pairs or after in (" ", MARK):
                k += 1
                continue
            out.append((piece[at:k], less))
            at, less, k = k, 1, k + LONG_PIECE
        return [*out, (piece[at:], less)]

    def _new(self, pieces: list[str]) -> list[int]:
        """Counts of pieces, each as if it stood at a text's start."""
        if all(len(p) <= LONG_PIECE for p in pieces):
            return self._library(pieces)
        parts = [self._long_piece(p) if len(p) > LONG_PIECE else [(p, 0)] for p in pieces]
        counts = iter(self._library([t for x in parts for t, _ in x]))
        return [sum(next(counts) - less for _, less in x) for x in parts]

    def _known(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.kept.get, pieces))
        missing = [p for p, n in zip(pieces, found) if n is None]
        if missing:
            made = dict(zip(missing, self._new(missing)))
            found = [made[p] if n is None else n for p, n in zip(pieces, found)]
            if len(self.kept) + len(made) > KEPT:
                self.kept.clear()
            self.kept.update((p, n) for p, n in made.items() if len(p) <= KEPT_CHARS)
        return np.array(found, np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.safe:
            return np.array(self._library(texts.to_pylist()), np.int64)
        plain = pc.invert(pc.or_(pc.match_substring_regex(texts, f"^ | $|  |{MARK}"), pc.equal(texts, "")))
        cut = pc.split_pattern(texts.filter(plain), " ")
        others = [SAFE.split(t) if t else [] for t in texts.filter(pc.invert(plain)).to_pylist()]
        flat = pa.array([p for x in others for p in x], cut.type.value_type)
        pieces = pa.concat_arrays([cut.flatten(), flat]).dictionary_encode()
        sizes = np.concatenate([pc.list_value_length(cut).to_numpy(zero_copy_only=False), [len(x) for x in others]]).astype(np.int64)
        each = self._known(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(sizes)
        first = plain.to_numpy(zero_copy_only=False)
        out = np.empty(len(texts), np.int64)
        out[np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])] = total[ends] - total[ends - sizes]
        return out


def cuts(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut at safe spaces; what follows the last one stays whole."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def count_array(counter: Counter, texts: pa.Array) -> np.ndarray:
    """Counts of whole texts; long ones part by part, so that no more than a part is in pieces at a time."""
    long = pc.greater(pc.binary_length(texts), LONG_TEXT).to_numpy(zero_copy_only=False) if counter.safe else np.zeros(len(texts), bool)
    out = np.zeros(len(texts), np.int64)
    out[~long] = counter.count(texts.filter(pa.array(~long)))
    for k in np.flatnonzero(long):
        out[k] = sum(int(counter.count(pa.array([part], texts.type))[0]) for part in cuts(texts[k].as_py(), LONG_TEXT))
    return out


_counters: dict[str, Counter] = {}


def counter(file: str) -> Counter:
    """One for each Python worker."""
    if file not in _counters:
        _counters[file] = Counter(file)
    return _counters[file]


def count_tokens(docs: DataFrame, file: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(file)
        for b in by_bytes(batches, "text", BATCH_BYTES):
            texts = b.column(1)
            n = count_array(c, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
