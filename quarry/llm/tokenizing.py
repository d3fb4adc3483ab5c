"""Whole-text encoding with the tokenizers library, with a bounded cache of encoded words.

A text is cut where the pre-tokenizer begins a new token whatever stands around, so the ids of the cuts, one after the
other, are those of the whole text:

- where white space is dropped, at all white space;
- where a space is kept with the word after it, before a single space, and around a single line feed, between two
  characters that are not white space. Texts with other white space are cut at such spaces alone.

A word of Latin letters, with punctuation after them or none, is one token of the pre-tokenizers in ``KNOWN`` for the
letters and one for the punctuation. Such a run of letters goes to the library's model itself, which spares the
library's bookkeeping of offsets, and is kept without the punctuation; every other word goes through the whole library.
Runs are kept in two generations: one that is asked for again moves to the younger, which becomes the older when full.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute

#: White space (Unicode White_Space) and the separators FS to US, which not all libraries count as such.
SEPARATORS = "\x1c\x1d\x1e\x1f"
ASCII_SPACE = "\t\x0b\x0c\r" + SEPARATORS
OTHER_SPACE = "\x85\xa0                　"
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Runs of letters that a worker keeps, in each of two generations, and other words; longer ones are not kept.
RUNS, ODD = 500_000, 200_000
LONGEST = 64
#: Whole texts that a worker keeps, for copies; longer texts are not kept.
COPIES, LONGEST_COPY = 3000, 8192
#: Latin letters that every version of Unicode calls so, that normalising leaves alone and that are one letter in lower case;
#: ASCII punctuation but the apostrophe, which may begin a token with the letters after it.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
PUNCTUATION = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
MARKS = re.escape(PUNCTUATION)
SIMPLE = re.compile(f"([{LETTERS}]+)([{MARKS}]{{0,8}})")
#: Ends of words that a worker keeps at most.
ENDS = 10_000
#: Texts, and about how many of their characters, whose words are looked up at once.
GROUP, GROUP_CHARS = 2048, 1 << 23
#: (normalizer, pre-tokenizer) of which the above holds -> whether letters are put in lower case.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_CLASSES = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_FOLDED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN = [
    (None, _BYTES | {"use_regex": True}, False),
    (_FOLDED, {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": _CLASSES, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]}, True),
]
#: A byte's character in a byte-level vocabulary; line feeds stay, to part words.
_OTHER = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
SHOWN = "".join("\n" if b == 10 else _OTHER.get(b, chr(b)) for b in range(256))
SPACE = SHOWN[32]
#: A token that stands alone between words, and what is written for it: many words are encoded in one call.
BREAK = {True: ("\n", "\n"), False: ("|", " | ")}


def common(text: str) -> bool:
    """White space is spaces and line feeds."""
    return not any(c in text for c in (ASCII_SPACE if text.isascii() else ASCII_SPACE + OTHER_SPACE))


def plain(text: str) -> bool:
    """White space is single spaces and line feeds, with other characters on both sides."""
    if text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    return common(text)


class Encoder:
    """encode(texts) -> for each text its ids as bytes of little-endian unsigned 16-bit (or 32-bit) integers.

    ``joined_space``: the pre-tokenizer keeps a space with the word after it; otherwise it drops white space. A key is
    a word; one that begins with a line feed stands for the word after a line feed instead of a space.
    """

    def __init__(self, file: str, joined_space: bool):
        os.environ |= {"TOKENIZERS_PARALLELISM": "false", "RAYON_NUM_THREADS": "1"}
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.joined = joined_space
        self.mark, self.between = BREAK[joined_space]
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.feed = np.array([self.mark_id], self.dtype).tobytes()
        self.ends: dict[str, bytes] = {}
        self.simple, self.lower = self._shape(file)
        self.tokens = self.tokenizer.model.tokenize
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.copies: dict[str, bytes] = {}

    def _shape(self, file: str) -> tuple[re.Pattern[str] | None, bool]:
        """The words whose letters the model may be given alone, and whether in lower case."""
        with open(file, encoding="utf-8") as f:
            shape = json.load(f)
        for normalizer, pre_tokenizer, lower in KNOWN:
            if (shape["normalizer"], shape["pre_tokenizer"]) == (normalizer, pre_tokenizer):
                if not any(re.fullmatch(f"[{LETTERS}]*[{MARKS}]*", t["content"]) for t in shape["added_tokens"]):
                    return SIMPLE, lower
        return None, False

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str], lead: str) -> dict[str, bytes]:
        size, mark = self.dtype.itemsize, self.mark
        odd = [w for w in words if mark in w or not w]
        simple = [w for w in words if mark not in w and w] if odd else words
        out = dict(zip(odd, self._library([lead + w for w in odd])))
        for k in range(0, len(simple), 512):
            part = simple[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([lead + (self.between + lead).join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.mark_id) * size
            if len(ends) != len(part) - 1:  # a word has a mark of its own after normalising
                out.update(zip(part, self._library([lead + w for w in part])))
                continue
            data = ids.tobytes()
            ends = [*ends.tolist(), len(data)]
            at = [0, *(z + size for z in ends)]
            out.update(zip(part, [data[a:z] for a, z in zip(at, ends)]))
        return out

    def _runs(self, runs: list[str], lead: str) -> dict[str, bytes]:
        """Runs of letters, by the model."""
        if not runs:
            return {}
        tokens, ids, ends = self.tokens, [], []
        first = SPACE if lead else ""
        for shown in codecs.charmap_decode("\n".join(runs).encode(), "strict", SHOWN)[0].split("\n"):
            ids += [t.id for t in tokens(first + shown)]
            ends.append(len(ids))
        data, size = np.array(ids, self.dtype).tobytes(), self.dtype.itemsize
        return {w: data[a * size : z * size] for w, a, z in zip(runs, [0, *ends], ends)}

    def _words(self, words: list[str], lead: str, runs: dict[str, bytes]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Odd words, and those of letters and marks. The latter are two tokens, so a run is encoded once for all marks;
        new runs are put into ``runs``."""
        simple = self.simple
        if simple is None:
            return self._encoded(words, lead), {}
        odd, need, parts, lower, ends = [], set(), [], self.lower, self.ends
        for w in words:
            m = simple.fullmatch(w)
            if m is None:
                odd.append(w)
                continue
            run, end = m.groups()
            if lower:
                run = run.lower()
            parts.append((w, run, end))
            if run not in runs:
                need.add(run)
        if len(ends) > ENDS:
            ends.clear()
        new = list({end for _, _, end in parts} - ends.keys())
        ends.update(zip(new, self._library(new)))
        made = self._runs(list(need), lead)
        plain = {}
        for w, run, end in parts:
            ids = made.get(run)
            plain[w] = (runs[run] if ids is None else ids) + ends[end]
        runs.update(made if not need or max(map(len, need)) <= LONGEST else {r: ids for r, ids in made.items() if len(r) <= LONGEST})
        return self._encoded(odd, lead), plain

    def _keys(self, keys: set[str]) -> dict[str, bytes]:
        """The keys' ids; odd words and words after a line feed are kept as they are."""
        if not self.joined:
            odd, plain = self._words(list(keys), "", self.runs)
        else:
            odd, plain = self._words([k for k in keys if k[:1] != "\n"], " ", self.runs)
            feed = self.feed
            for made in self._words([k[1:] for k in keys if k[:1] == "\n"], "", {}):
                odd |= {"\n" + w: feed + ids for w, ids in made.items()}
        if len(self.odd) + len(odd) > ODD:
            self.odd.clear()
        self.odd.update((k, ids) for k, ids in odd.items() if len(k) <= LONGEST)
        if len(self.runs) > RUNS:
            self.older, self.runs = self.runs, {}
        return odd | plain

    def encode(self, texts: list[str]) -> list[bytes]:
        """Without cyclic garbage collection meanwhile: there are no cycles, but very many strings to walk over."""
        out: list[bytes] = []
        collecting = gc.isenabled()
        gc.disable()
        try:
            start = chars = 0
            for k, t in enumerate(texts):
                if k - start == GROUP or chars > GROUP_CHARS:
                    out += self._copied(texts[start:k])
                    start, chars = k, 0
                chars += len(t)
            out += self._copied(texts[start:])
        finally:
            if collecting:
                gc.enable()
        return out

    def _copied(self, texts: list[str]) -> list[bytes]:
        """Looks up copies of texts seen before; the rest is encoded."""
        if len(self.copies) > COPIES:
            self.copies.clear()
        new = list({t for t in texts if t not in self.copies})
        made = dict(zip(new, self._some(new)))
        out = [made[t] if t in made else self.copies[t] for t in texts]
        self.copies.update((t, ids) for t, ids in made.items() if len(t) <= LONGEST_COPY)
        return out

    def _parts(self, text: str) -> str | list[str] | None:
        """Keys, or a text that is cut into them at every space; None if the library has to see the text whole."""
        if not self.joined:
            if common(text):
                return text.replace("\n", " ")
            return None if any(c in text for c in SEPARATORS) else text.split()
        if plain(text):
            return "\n" + text.replace("\n", " \n")
        first, *rest = LONE_SPACE.split(text)
        return None if any(w[:1] == "\n" for w in rest) else ["\n" + first, *rest]

    def _some(self, texts: list[str]) -> list[bytes]:
        """One lookup for each distinct word; ids are put in place by the words' numbers."""
        parts = [self._parts(t) if t else None for t in texts]
        cut = [k for k, p in enumerate(parts) if isinstance(p, str)]
        listed = [k for k, p in enumerate(parts) if isinstance(p, list)]
        out = [self._library([t])[0] if t and p is None else b"" for t, p in zip(texts, parts)]
        split = pa.compute.split_pattern(pa.array([parts[k] for k in cut], pa.large_string()), " ")
        lists = pa.array([w for k in listed for w in parts[k]], pa.large_string())
        words = pa.concat_arrays([split.flatten(), lists]).dictionary_encode()
        if not len(words):
            return out
        ends = np.cumsum([0, *pa.compute.list_value_length(split).to_pylist(), *(len(parts[k]) for k in listed)])
        taken = self._ids(words.dictionary.to_pylist()).take(words.indices)
        places, data = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist(), taken.buffers()[2].to_pybytes()
        skip = self.dtype.itemsize if self.joined else 0
        for k, a, z in zip(cut + listed, places, places[1:]):
            out[k] = data[a + skip : z]
        return out

    def _known(self, key: str) -> bytes | None:
        """What is kept of a key that is no run of the younger generation."""
        run = key.rstrip(PUNCTUATION)
        end = key[len(run) :]
        if self.lower and (key.isascii() or self.simple.fullmatch(key)):
            run = run.lower()
        ids = self.runs.get(run)
        if ids is None:
            ids = self.older.get(run)
            if ids is None:
                return self.odd.get(key)
            self.runs[run] = ids
        if not end:
            return ids
        tail = self.ends.get(end)
        return self.odd.get(key) if tail is None else ids + tail

    def _ids(self, keys: list[str]) -> pa.Array:
        row: list[bytes | None] = list(map(self.runs.get, keys))
        known = self._known
        row = [known(k) if ids is None else ids for k, ids in zip(keys, row)]
        new = [k for k, ids in zip(keys, row) if ids is None]
        if new:
            made = self._keys(set(new))
            row = [made[k] if ids is None else ids for k, ids in zip(keys, row)]
        return pa.array(row, pa.large_binary())


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(file: str, joined_space: bool) -> Encoder:
    """One for each Python worker."""
    key = (file, joined_space)
    if key not in _encoders:
        _encoders[key] = Encoder(file, joined_space)
    return _encoders[key]
