"""The pipeline's stages against brute-force versions, each over its own input."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_pieces, brute_print, brute_quality, check_packing

from quarry.llm import mixing, packing, quality, secretscan, simhash
from quarry.llm.common import materialise


def similar_components(docs: list[tuple]) -> dict:
    """id -> smallest id, by all pairs: two bits of the fingerprint, or a similarity of 0.8 of five words."""
    shingles, prints = {}, {}
    for i, text in docs:
        w = text.lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        prints[i] = brute_print(text)
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in shingles.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for x in by.values() for a in x for b in x if a < b} | {(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    for a, b in pairs:
        n = len(shingles[a] & shingles[b])
        if (prints[a] ^ prints[b]).bit_count() <= 2 or n >= 0.8 * (len(shingles[a]) + len(shingles[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_sets_that_no_pair_asks_for_are_not_shuffled(spark):
    """Wide rows go by bits before the join: all that are wanted stay, nearly no others reach the shuffle."""
    h = F.xxhash64("id")
    sets = spark.range(20000).select(h.alias("shingle_set"), F.array(F.col("id").cast("int")).alias("shingles"))
    asked = spark.range(0, 20000, 50).select(h.alias("shingle_set"))
    got = simhash.marked(sets, asked, "shingle_set")
    assert got.columns == sets.columns
    kept, wanted = {r[0] for r in got.collect()}, {r[0] for r in asked.collect()}
    assert wanted <= kept and len(kept) < len(wanted) + 20
    assert simhash.marked(sets, asked.limit(0), "shingle_set").count() == 0
    few = spark.createDataFrame([(x,) for x in (0, -1, 32767, 32768, -(1 << 63), (1 << 63) - 1)], "shingle_set long")
    assert simhash.marked(few, few, "shingle_set").count() == 6
    one = spark.createDataFrame([(-1,)], "shingle_set long")
    assert {r[0] for r in simhash.marked(few, one, "shingle_set").collect()} == {-1, (1 << 63) - 1}


def test_near_copies_go_and_others_stay(spark):
    """Copies with two or three changed words of 150 to 400; texts that share less than the similarity."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, near = [], []
    for g in range(150):
        text = [word() for _ in range(rng.randint(150, 400))]
        docs.append((10 * g, " ".join(text)))
        copy = list(text)
        for k in rng.sample(range(len(copy)), 3):
            copy[k] = word()
        docs.append((10 * g + 1, " ".join(copy)))
        near.append(10 * g + 1)
        half = text[: len(text) // 2] + [word() for _ in range(len(text) // 2)]
        docs.append((10 * g + 2, " ".join(half)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(i in kept for i in near) <= 4
    assert all(i in kept for i, _ in docs if i % 10 != 1)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(300)]
    docs = [(0, " ".join(base))]
    for i in range(1, 400):
        copy = list(base)
        for k in rng.sample(range(len(copy)), 4):
            copy[k] = word()
        docs.append((i, " ".join(copy)))
    assert simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).count() <= 4


def words_of(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def kept_of(spark, docs: list[tuple]) -> set:
    return {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_appended_and_replaced_blocks(spark):
    """Contiguous edits just above and just below the similarity, against all pairs."""
    rng = random.Random(5)
    docs = []
    for g in range(200):
        text = words_of(rng, 300)
        more = rng.randint(55, 85)
        docs.append((4 * g, " ".join(text)))
        docs.append((4 * g + 1, " ".join(text + words_of(rng, more))))
        other, block = words_of(rng, 300), rng.randint(20, 36)
        at = rng.randint(0, 300 - block)
        docs.append((4 * g + 2, " ".join(other)))
        docs.append((4 * g + 3, " ".join(other[:at] + words_of(rng, block) + other[at + block :])))
    want = similar_components(docs)
    assert 100 < sum(i != r for i, r in want.items()) < 400
    assert kept_of(spark, docs) == set(want.values())


def test_variants_of_an_absent_text(spark):
    """No member is similar to all others: groups without their base, against all pairs."""
    rng = random.Random(6)
    docs = []
    for size, changes, members in ((400, 6, 150), (100, 2, 150)):
        base = words_of(rng, size)
        for _ in range(members):
            copy = list(base)
            for k in rng.sample(range(size), changes):
                copy[k] = words_of(rng, 1)[0]
            docs.append((len(docs), " ".join(copy)))
    want = similar_components(docs)
    assert kept_of(spark, docs) == set(want.values())


def test_one_fingerprint_of_different_texts(spark):
    """A text that is similar to one of two texts with the same fingerprint, not to the one of the smaller id."""
    rng = random.Random(7)
    often, tails = words_of(rng, 7) * 400, [words_of(rng, 60), words_of(rng, 60)]
    docs = [(k, " ".join(often + t)) for k, t in enumerate(tails)] + [(2, " ".join(often[:11] + tails[1]))]
    prints = [brute_print(t) for _, t in docs]
    assert prints[0] == prints[1] and (prints[0] ^ prints[2]).bit_count() > 2
    assert set(similar_components(docs).values()) == {0}
    assert kept_of(spark, docs) == {0}


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        after = stage(spark, docs, d)
        got = after.collect()
        if k < 4:
            assert after.columns == columns
        if name == "quality_rules":
            rules = [r for r in quality.RULES if not r.base]
            want = [r for r in before if not brute_quality(r["text"])[5] and not any(x.rejects(quality.Features(r["text"].encode())) for x in rules)]
            assert Counter(got) == Counter(want) and len(want) < len(before)
        elif name == "near_duplicates":
            found = similar_components([(r["doc_id"], r["text"]) for r in before])
            assert set(got) <= set(before) and len(got) < len(before)
            kept = Counter(found[r["doc_id"]] for r in got)
            assert set(kept) == set(found.values())  # none is lost whole
            assert len(got) <= 1.01 * len(kept)
        elif name == "secret_scan":
            want = [(r["doc_id"], secretscan.masked(r["text"], "<SECRET>")) for r in before]
            assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)
            assert any(r["text"] not in {x["text"] for x in before} for r in got)
            assert not any(secretscan.find(r["text"]) for r in got)
        elif name == "mix_sources":
            assert Counter(got) == Counter(before) and got != before
        else:
            check_packing(got, brute_pieces([(r["doc_id"], r["text"]) for r in before]))
        docs = spark.createDataFrame(got, after.schema)


def test_run_equals_its_stages(spark):
    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, got.select(*key).collect())) == Counter(map(tuple, docs.select(*key).collect()))


def test_stages_of_odd_rows(spark, odd, nothing):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


@pytest.mark.parametrize("written", [True, False])
def test_packing_follows_the_mix(spark, written):
    """Sequences stand in the order of the mixed rows; a window of that order is packed by itself."""
    rng = random.Random(8)
    made = [(i, " ".join(words_of(rng, rng.randint(1, 300))), "ab"[i % 7 == 0]) for i in range(600)]
    docs = mixing.mixed_order(spark.createDataFrame(made, "doc_id long, text string, source string").repartition(5), block_bytes=1000)
    docs = docs.repartitionByRange(4, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc())
    docs = materialise(docs, "test") if written else docs
    want = brute_pieces([x[:2] for x in made])
    sizes = Counter()
    for (doc, _, _, n, _), c in want.items():
        sizes[doc] += n * c
    starts, at = {}, 0
    for doc in range(599, -1, -1):
        starts[doc] = at
        at += sizes[doc]
    path = corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER)
    got = packing.pack_in_order(docs, path, window=1 << 14).collect()
    assert check_packing(got, want) <= at / 2048 + at / (1 << 14) + 2
    assert all(r["sequence_id"] >> 14 == starts[r["doc_id"]] + r["start"] >> 14 for r in got)
    first = {}
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], at), starts[r["doc_id"]] + r["start"])
    assert [first[k] for k in sorted(first)] == sorted(first.values())


def test_mixing_shuffles_texts_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mixed_order(docs)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in x and "Broadcast" not in x for x in plan.splitlines()) == 1


def test_mixed_rows_are_dealt_without_a_sample(spark, monkeypatch):
    """No further pass over the texts looks for ranges, none takes them through Python; partitions are even ranges of slots."""
    monkeypatch.setattr(mixing, "PART_BYTES", 20_000)
    monkeypatch.setattr(mixing, "LEAST_BYTES", 1000)
    rng = random.Random(9)
    made = [(i, " ".join(words_of(rng, rng.randint(1, 100))), "abc"[rng.randrange(3)]) for i in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    mixed = mixing.mixed_order(docs, block_bytes=1000)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "MapInArrow" not in plan
    got = mixed.select("doc_id", F.octet_length("text").alias("n"), F.spark_partition_id().alias("part")).collect()
    places = mixing.positions(docs, block_bytes=1000).collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in sorted(places, key=lambda r: (r["slot"], r["place"]))]
    assert [r["part"] for r in got] == sorted(r["part"] for r in got)
    sizes = Counter()
    for r in got:
        sizes[r["part"]] += r["n"] + 1
    assert len(sizes) == mixed.rdd.getNumPartitions() > 5 and max(sizes.values()) < 24_000


def test_shingles_are_counted_over_all_sets(spark):
    sets = spark.createDataFrame([([1, 2, -5],), ([2, 3],), ([],), ([2],), (None,)], "shingles array<int>").repartition(3)
    counts = simhash.shingle_counts(sets)
    assert [int(counts[k & (simhash.BINS - 1)]) for k in (1, 2, 3, -5, 9)] == [8, 16, 8, 8, 0]
    assert int((counts > 0).sum()) == 4
    assert not simhash.shingle_counts(sets.where("false")).any()
