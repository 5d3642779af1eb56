"""SimHash groups and removal of repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeflow.llm import simhash, suffix_dedup

SF = "/root/testdata/sf0.001"


def groups(bits):
    parent = {b: b for b in bits}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(bits)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {b: root(b) for b in bits}


def plain_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_documents(spark):
    odd = [(90001, None), (90002, ""), (90003, "a"), (None, "a"), (90004, "A"), (90005, "x y"), (90005, "x y"), (90006, "w " * 5000)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("bits", F.lit("clash"))
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    of, least = groups({b for _, b in rows}), {}
    for i, b in rows:
        if i is not None:
            least[of[b]] = min(least.get(of[b], 1 << 60), i)
    got = sorted(map(tuple, simhash.simhash_digest(docs).collect()), key=str)
    assert got == sorted(((i, f"{b:016x}", least.get(of[b])) for i, b in rows), key=str)


@pytest.mark.parametrize("block", [4096, 16])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, signed = random.Random(3), lambda x: x - (1 << 64) if x >> 63 else x
    values = {0, (1 << 64) - 1}
    for _ in range(15):
        b = rng.getrandbits(64)
        for _ in range(50):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(signed(x),) for x in values], "bits long"))).collect()}
    of, members = groups(values), {}
    for x in values:
        members.setdefault(of[x], []).append(signed(x))
    assert all(found.get(x, x) == min(m) for m in members.values() for x in m)


def test_chain_finds_every_pair():
    """Every pattern of up to three differing bits passes some start's budgets."""
    import itertools

    import numpy as np

    patterns = [sum(1 << b for b in c) for n in (0, 1, 2, 3) for c in itertools.combinations(range(64), n)]
    a = np.zeros(len(patterns), np.uint64)
    b = np.array(patterns, np.uint64)
    ok = np.zeros(len(patterns), bool)
    for start in range(simhash.SEGMENTS):
        ok |= simhash.within_chain(a, b, np.full(len(a), start, np.uint64))
    assert ok.all()


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_digest(empty).count() == 0
    assert suffix_dedup.dedup_digest(empty).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"crowd_rows": 5, "batch_rows": 3}])
def test_repeated_strings(spark, sizes):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [text(n) for n in (180, 205, 230, 400, 199, 200)]
    rows = [(90000, None), (90001, ""), (90002, "a" * 500), (90003, "a" * 199), (90004, "ab" * 120), (90005, "a" * 200), (None, "q" * 150)]
    for i in range(150):
        t = "".join(rng.choice([text(rng.randint(1, 150)), rng.choice(shared), rng.choice(shared)[: rng.randint(100, 300)]]) for _ in range(rng.randint(1, 8)))
        rows.append((i, t))
        if i % 37 == 0:
            rows += [(i, t), (1000 + i, t)]
        if i % 11 == 0:
            k = rng.randrange(len(t))
            rows.append((2000 + i, t[:k] + "#" + t[k + 1 :]))
    # Thue-Morse words and their complements, on which sums of letters' powers collide
    for k, (x, y) in enumerate(("an", "th")):
        for size in (256, 1024, 2048):
            word = "".join((x, y)[bin(i).count("1") & 1] for i in range(size))
            rows += [(5000 + 10 * k + size, word), (5001 + 10 * k + size, word.translate(str.maketrans(x + y, y + x)))]
    # one passage of 260 bytes, with other surroundings each time
    passage = text(260)
    rows += [(9000 + i, text(rng.randint(0, 300)) + passage + text(rng.randint(0, 300))) for i in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string")
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = sorted(map(tuple, suffix_dedup.dedup_digest(df, **sizes).collect()), key=str)
    assert got == sorted(want, key=str)


def test_any_of_several_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng, rows = random.Random(8), []
    for r in docs.collect()[:60]:
        w = r["text"].split()
        for k in range(2):
            w[rng.randrange(len(w))] = f"edit{k}"
            rows.append((5000 + 2 * r["doc_id"] + k, " ".join(w)))
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    data = docs.collect()
    prints = simhash.fingerprints(pa.array([r["text"] for r in data]), 5, 3)
    assert [int(x) & (1 << 64) - 1 for x in prints[:20, 0]] == [plain_fingerprint(r["text"], 5) for r in data[:20]]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unsigned = prints.view("u8")
    for i in range(len(data)):
        near = (np.bitwise_count(unsigned[i + 1 :] ^ unsigned[i]) <= 3).any(axis=1)
        for j in np.flatnonzero(near):
            parent[root(i)] = root(i + 1 + int(j))
    least = {}
    for i, r in enumerate(data):
        least[root(i)] = min(least.get(root(i), 1 << 60), r["doc_id"])
    want = sorted((r["doc_id"], least[root(i)]) for i, r in enumerate(data))
    assert sorted(map(tuple, simhash.near_duplicates_by_any(docs, prints=3).collect())) == want
    assert any(a != b for a, b in want)
