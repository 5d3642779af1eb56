"""Near-duplicates by Jaccard similarity against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from gradeflow.llm import simhash_ring

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain_set(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def plain_components(rows):
    """Smallest id of each row's group by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return [(r[0], least[g]) for r, g in zip(rows, group)]


def corpus():
    rnd = random.Random(3)
    rows = []
    for family in range(12):
        base = [f"f{family}w{rnd.randrange(900)}" for _ in range(300)]
        for change in (0, 2, 3, 4, 5, 6, 7, 10, 14, 25):
            words = list(base)
            for at in rnd.sample(range(300), change):
                words[at] = f"x{rnd.randrange(10**6)}"
            rows.append((family * 100 + change, " ".join(words)))
    rows += [(5000, None), (5001, " "), (5002, "two words"), (5003, "Two  WORDS"), (None, "two words"), (None, "alone")]
    rnd.shuffle(rows)
    return rows


def test_groups_are_those_of_brute_force(spark):
    rows = corpus()
    got = simhash_ring.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_components(rows), key=str)


def test_crowded_buckets_are_searched_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_ring, "BLOCK", 3)
    rows = corpus()
    got = simhash_ring.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_components(rows), key=str)


def test_stage_drops_copies_that_one_fingerprint_misses(spark):
    rows = [r for r in corpus() if r[0] is not None]
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert left == {c for _, c in plain_components(rows)}


def test_rows_of_one_id_go_by_their_own_text(spark):
    copied, other, third = (" ".join(f"{c}{k}" for k in range(50)) for c in "abc")
    rows = [(1, copied), (2, copied), (2, other), (2, other), (3, third), (3, other), (4, third), (4, copied), (None, other)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, copied), (2, other), (3, third), (None, other)], key=str)


def test_filter_keeps_every_pair_within_the_limit():
    """Rings that differ in at most the limit pass, however the differences are dealt; unrelated ones don't."""
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 63, simhash_ring.SEGMENTS, dtype=np.uint64)
    others = []
    for size in (0, 1, 100, 319, 320):
        for spread in (16, 7, 5):
            segments = rng.permutation(16)[:spread]
            bits = rng.permutation(spread * 64)[:size]
            other = one.copy()
            for b in bits:
                other[segments[b // 64]] ^= np.uint64(1) << np.uint64(b % 64)
            others.append(other)
    assert simhash_ring.within_ring(one, np.array(others)).all()
    far = rng.integers(0, 1 << 63, (200, simhash_ring.SEGMENTS), dtype=np.uint64)
    assert not simhash_ring.within_ring(one, far).any()


def test_no_rows(spark):
    assert simhash_ring.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
