"""Token counts, periodic runs and the audit of filters against brute force, and over odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import common, filteraudit, periodicruns, queries, tokencount

Q = queries.queries()
MODEL = public_tokenizers.path(queries.PIECES_TOKENIZER)
SPACES = " \t\n\x0b\x0c\r"


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def split(text: str | None) -> list[str]:
    for c in SPACES:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


# --- op11


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda t: len(model.encode(t or ""))


def brute_counts(docs, library) -> list[tuple]:
    out = [(i, len((t or "").encode()), library(t)) for i, t in docs]
    return sorted(((*r, r[2] > queries.TOKEN_LIMIT) for r in out), key=repr)


def test_token_counts(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert rows(Q["op11_token_counts"](spark, small)) == brute_counts(docs, library)


def test_token_counts_of_odd_rows(spark, odd, nothing, library):
    odd = odd.withColumn("n_tokens", F.lit(-1)).withColumn("N_BYTES", F.lit("x"))
    docs = odd.select("doc_id", "text").collect()
    assert rows(tokencount.count_tokens(odd, MODEL, queries.TOKEN_LIMIT)) == brute_counts(docs, library)
    assert tokencount.count_tokens(nothing, MODEL, 1).collect() == []


def test_a_very_long_text(spark, library, monkeypatch):
    texts = ["many words, " * 300_000, "x" * 200_000, "字\n中" * 30_000, " " * 5000, ("a" * 70 + " ") * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_tokens"] for r in tokencount.count_tokens(df, MODEL, 1).orderBy("doc_id").collect()] == [library(t) for t in texts]


@pytest.fixture(scope="module")
def close():
    """A counter that cuts after few characters."""
    before = tokencount.LONG_PIECE, tokencount.LONG_TEXT
    tokencount.LONG_PIECE, tokencount.LONG_TEXT = 12, 40
    yield tokencount.Counter(MODEL)
    tokencount.LONG_PIECE, tokencount.LONG_TEXT = before


PARTS = st.sampled_from(["a", "ing", "the", " ", "  ", "▁", "\n", "\t", "\r", "<s>", "</s>", "<unk>", "<0x0A>", "é", "ﬁ", "中", "文", "😀", ".", "23", "\x00", "　", "х"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=60).map("".join), max_size=6))
def test_cuts_change_no_count(close, library, texts):
    assert close.safe and tokencount.count_array(close, pa.array(texts, pa.string())).tolist() == [library(t) for t in texts]


def test_a_model_that_cannot_be_cut_gets_whole_texts(close, library, monkeypatch):
    monkeypatch.setattr(close, "safe", False)
    texts = ["a  b", " a", "", "x y z " * 50]
    assert tokencount.count_array(close, pa.array(texts)).tolist() == [library(t) for t in texts]


def test_batches_by_bytes():
    texts = ["a" * 10, None, "b" * 50, "", "c" * 10, "d" * 10, "e" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for b in (batch, batch.slice(2)):
        parts = [x.column(0).to_pylist() for x in common.by_bytes([b], "t", 20)]
        assert [t for p in parts for t in p] == b.column(0).to_pylist()
        assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 20 for p in parts)
    assert len(list(common.by_bytes([batch], "t", 20))) == 4


# --- op12


def brute_runs(words: list, min_length: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """Every period, smallest first, and every stretch that it holds in."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(min_length, exponent * q) and end > at:
                found.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def tailed(doc_id: int | None, text: str | None) -> list[str]:
    words = split(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_digest(doc_id: int | None, text: str | None) -> tuple:
    words = tailed(doc_id, text)
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = rows(Q["op12_periodic_runs"](spark, small))
    assert got == sorted((brute_digest(*d) for d in docs), key=repr)
    assert len({r[1] for r in got}) > 1


def periodic(seed: int, letters: int, most: int = 150) -> list[int]:
    """Words of which some stretches repeat."""
    r = random.Random(seed)
    out: list[int] = []
    while len(out) < most:
        unit = [r.randrange(letters) for _ in range(r.randint(1, 12))]
        out += unit * r.choice((1, 1, 2, 3, 5)) + unit[: r.randint(0, len(unit))]
    return out


@pytest.mark.parametrize("shape", [(24, 3), (2, 2), (5, 2), (6, 3), (10, 4)])
def test_runs_equal_brute_force(shape):
    for seed in range(400):
        words = periodic(seed, seed % 5 + 1)
        assert periodicruns.runs(words, *shape) == brute_runs(words, *shape)


@pytest.mark.parametrize("shape", [(24, 3), (4, 2), (9, 3)])
def test_masking_loses_no_run(shape):
    for seed in range(200):
        many = [periodic(seed + k, k % 4 + 1, 20 * k) for k in range(6)]
        texts = [" ".join(map(str, w)).encode() for w in many]
        sizes, found, left = periodicruns.find_in(texts, *shape)
        assert found == [brute_runs(w, *shape) for w in many] and sizes.tolist() == list(map(len, many))


def test_masking_leaves_out_what_stands_twice_far_apart():
    once = [f"w{k}" for k in range(400)]
    codes = np.array([int(w[1:]) for w in once + once] + [1000, 1001] * 20)
    parts = periodicruns.segments(codes, np.array([len(codes)]), 24, 3)
    assert parts == [(800, 840)]
    assert periodicruns.overlap(24, 3) == 16 and periodicruns.overlap(2, 2) == 1


def test_colliding_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(periodicruns, "gram_hashes", lambda codes, k: np.zeros(max(0, len(codes) - k + 1), np.uint64))
    for seed in range(50):
        many = [periodic(seed, 2), periodic(seed + 1, 3)]
        assert periodicruns.find_in([" ".join(map(str, w)).encode() for w in many], 24, 3)[1] == [brute_runs(w) for w in many]


def test_periodic_runs_of_odd_rows(spark, odd, nothing):
    odd = odd.withColumn("runs", F.lit("taken")).withColumn("Collapsed", F.lit(1))
    out = periodicruns.find_runs(odd)
    assert out.columns == [*odd.columns, "n_words", "runs_", "collapsed_"]
    got = {(r["doc_id"], r["text"]): (r["n_words"], [tuple(x) for x in r["runs_"]], r["collapsed_"]) for r in out.collect()}
    for (doc_id, text), (n, found, left) in got.items():
        assert n == len(split(text)) and found == brute_runs(split(text))
        assert left == ("word" if doc_id == 6 else " ".join(split(text)))
    assert out.count() == odd.count() and periodicruns.find_runs(nothing).collect() == []


def test_a_long_periodic_text(spark):
    text = "a b c " * 40_000 + "x " + "y " * 30_000
    ((found, left),) = spark.createDataFrame([(1, text)], "doc_id long, text string").transform(periodicruns.find_runs).select("runs", "collapsed").collect()
    assert [tuple(r) for r in found] == [(0, 120_000, 3), (120_001, 30_000, 1)] and left == "a b c x y"


# --- op13


def brute_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """docs: (doc_id, text, source). Every order is walked through for every document."""
    flags = []
    for i, text, source in docs:
        t = text or ""
        w = split(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        told = [(q, x) for j, q, x in labels if i is not None and j == i]
        fails = dict(A=len(w) < 50, B=100 * len(set(w)) < 65 * len(w), C=100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), D=any(c in "#$%&*|" for c in t), E=copy)
        flags.append((source or "", fails, any(q == 1 for q, _ in told), any(x == 1 for _, x in told)))
    out = []
    for part in sorted({f[0] for f in flags}):
        mine, removed = [f for f in flags if f[0] == part], Counter()
        table = []
        for order in map("".join, permutations("ABCDE")):
            alive = list(range(len(mine)))
            for step, name in enumerate(order, 1):
                hit = [k for k in alive if mine[k][1][name]]
                redundant = sum(f[1][name] for f in mine) - len(hit)
                only = sum(f[1][name] and sum(f[1].values()) == 1 for f in mine)
                alive = [k for k in alive if k not in hit]
                removed[name] += len(hit)
                table.append((name, (part, order, step, len(alive), len(hit), redundant, only, sum(mine[k][2] for k in hit), sum(mine[k][3] for k in hit))))
        out += [(*r, removed[name]) for name, r in table]
    return sorted(out, key=repr)


def test_filter_audit_equals_sql_and_brute_force(spark, small):
    df = Q["op13_filter_audit"](spark, small)
    got = rows(df)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    columns = ", ".join(df.columns)
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({queries.AUDIT_SQL})").fetchall(), key=repr)
    docs, labels = (list(map(tuple, spark.read.parquet(f"{small}/{t}.parquet").select(*c).collect())) for t, c in (("documents", ("doc_id", "text", "source")), ("labels", ("doc_id", "quality", "toxic"))))
    assert got == brute_audit(docs, labels)


LONG = " ".join(f"w{k}" for k in range(60))
AUDITED = [
    (10, LONG, "a"), (11, LONG, "a"), (11, LONG, "b"), (10, LONG, "a"), (9, LONG, None), (12, LONG + " #", ""), (13, None, "a"), (14, "", "a"), (None, LONG, "a"), (None, None, None),
    (15, "SHOUT " * 80, "a"), (16, "Shout " * 80, "c"), (17, LONG.upper(), "c"), (18, "ÄÖÜ 日本 " + LONG, "c"), (19, LONG + "\x0b\x0c", "c"),
]
LABELS = [(10, 1, 0), (10, None, 1), (11, 0, None), (11, 1, 1), (13, None, None), (None, 1, 1), (16, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("frequent", [1, 3, 1000])
def test_filter_audit_of_odd_rows(spark, nothing, monkeypatch, frequent):
    """Whether copies are found by a broadcast or a shuffle."""
    monkeypatch.setattr(filteraudit, "FREQUENT", frequent)
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, source string").withColumn("flags", F.lit("x")).withColumn("PART", F.lit(1)).withColumn("good", F.lit(None).cast("int"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))
    assert rows(filteraudit.audit(docs, labels)) == brute_audit(AUDITED, LABELS)
    assert rows(filteraudit.audit(docs, labels.limit(0))) == brute_audit(AUDITED, [])
    assert filteraudit.audit(nothing, labels).collect() == []


def test_filter_audit_of_the_common_odd_rows(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    assert rows(filteraudit.audit(odd, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))) == brute_audit(docs, LABELS)
