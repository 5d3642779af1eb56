"""Token counts and BPE against the libraries, on real and random texts."""

import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from gradeflow.llm import bpe, token_count

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(1)
    letters = "ab 's're \n\t  é😀٣½1 .,!ſ\x1c\x85　ñ"
    parts = ["<|endoftext|>", "'re", "'ll", "'ve", "'s", " ", "  ", "\n", "abc"]
    out = ["".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(800)]
    return out + [None, "", "a" * 20000, "ab" * 9000 + " " * 700 + "x", " " * 5000, "'s" * 4000, "x" * 700 + " y", "<|endoftext", "|>"]


def test_counts():
    lib, model, all_ = Tokenizer.from_file(JSON), token_count.counter(JSON), texts()
    want = [len(e.ids) for e in lib.encode_batch([t or "" for t in all_], add_special_tokens=False)]
    sizes, got = token_count.count_slice(pa.array(all_), model)
    assert got.tolist() == want
    assert sizes.tolist() == [len((t or "").encode()) for t in all_]
    assert [int(token_count.count_slice(pa.array([t]), model)[1][0]) for t in all_[::7]] == want[::7]


def test_colliding_words():
    """Thue-Morse words and their complements, on which sums of letters' powers collide, and pieces longer than a state."""
    lib, model = Tokenizer.from_file(JSON), token_count.counter(JSON)
    words = []
    for x, y in ("an", "th", "er", "ab", "xy"):
        for size in (8, 16, 256, 1024, 2048):
            word = "".join((x, y)[bin(i).count("1") & 1] for i in range(size))
            words += [word, word.translate(str.maketrans(x + y, y + x))]
    rng = random.Random(9)
    words += ["".join(rng.choice("aeinst") for _ in range(3000)), "ab" * 3000, "-" * 3001, "=-" * 999 + "=", "\n" * 3000]
    want = [len(e.ids) for e in lib.encode_batch(words, add_special_tokens=False)]
    assert token_count.count_slice(pa.array(words), model)[1].tolist() == want
    assert [int(token_count.count_slice(pa.array([w]), model)[1][0]) for w in reversed(words)] == want[::-1]


def test_small_store(monkeypatch):
    """Counts stay right when the transducer is compiled afresh all the time."""
    monkeypatch.setattr(token_count, "KEPT", 50)
    lib, model, all_ = Tokenizer.from_file(JSON), token_count.Counter(JSON), texts()[:60]
    got = [int(token_count.count_slice(pa.array([t]), model)[1][0]) for t in all_]
    assert got == [len(e.ids) for e in lib.encode_batch(all_, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["letters", "one", "script", "words", "spaces"])
def test_long_pieces(kind):
    """Pre-tokens of over a hundred thousand bytes, with other texts around them, and chunks that have to be run again."""
    rng = random.Random(3)
    text = {
        "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=120_000)), "one": lambda: "a" * 150_001, "script": lambda: "".join(rng.choices("日本語中文字漢字仮名", k=50_000)),
        "words": lambda: "".join(rng.choices(["hello", "world", "the", "ation", "ing", "e"], k=40_000)), "spaces": lambda: " " * 120_000 + "x",
    }[kind]()
    lib, model = Tokenizer.from_file(JSON), token_count.counter(JSON)
    all_ = ["one two", text, None, text[:20_000] + " <|endoftext|>" + text[:30_000]]
    got = token_count.count_slice(pa.array(all_), model)[1].tolist()
    assert got == [len(e.ids) for e in lib.encode_batch([t or "" for t in all_], add_special_tokens=False)]


def test_states_stay_bounded(monkeypatch):
    """Many pre-tokens that make a state a byte: the transducer is compiled afresh between groups of them."""
    monkeypatch.setattr(token_count, "KEPT", 3000)
    rng = random.Random(4)
    model, lib = token_count.Counter(JSON), Tokenizer.from_file(JSON)
    texts_ = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(200, 900))) for _ in range(30)) for _ in range(4)]
    for t in texts_:
        assert int(token_count.count_slice(pa.array([t]), model)[1][0]) == len(lib.encode(t, add_special_tokens=False).ids)
        assert len(model.holds) <= 4 * 3000


def test_pairs_by_undoing_merges():
    """Whether tokens may stand side by side, against merging their bytes."""
    import numpy as np

    model, rng = token_count.counter(JSON), random.Random(5)
    tokens = [bytes([k]) for k in range(256)] + [a + b for a, b in sorted(model.rank, key=model.rank.get)]
    pairs = [(rng.randrange(len(tokens)), rng.randrange(len(tokens)) if rng.random() < 0.5 else rng.randrange(600)) for _ in range(5000)]
    got = model.long_tokens.undone(*np.array(pairs).T)
    assert got.tolist() == [model.merged(tokens[a] + tokens[b]) == [tokens[a], tokens[b]] for a, b in pairs]


def test_no_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (None, None, None)], "doc_id long, text string, found string").withColumn("n_tokens", pytest.importorskip("pyspark.sql.functions").lit(7))
    got = sorted(map(tuple, token_count.token_count_digest(docs, JSON).collect()), key=str)
    assert got == [(1, 7, 2, False), (1, 7, 2, False), (None, 0, 0, False)]
    assert token_count.token_count_digest(docs.where("false"), JSON).count() == 0
    assert bpe.encoding_digest(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encoding_digest(docs, RANKS, public_tokenizers.PATTERN).where("doc_id is null").first()["n_tokens"] == 0


def test_tokens_stand_alone():
    """Every token's own bytes encode to that token, which the transducer's transitions rest on."""
    model = token_count.counter(JSON)
    assert all(model.merged(t) == [t] for t in model.tokens)


@pytest.mark.parametrize("chunk,overlap", [(16384, 256), (50, 8), (13, 3)])
def test_encoding(chunk, overlap):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    all_ = texts()
    ids = bpe.encode_batch(pa.array(all_), RANKS, public_tokenizers.PATTERN, chunk, overlap)
    assert ids.to_pylist() == [lib.encode_ordinary(t or "") for t in all_]
    assert bpe.decode_batch(ids, RANKS, public_tokenizers.PATTERN).to_pylist() == [(t or "").encode() for t in all_]


def test_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("ids", pytest.importorskip("pyspark.sql.functions").lit("clash"))
    rows = {r["doc_id"]: r for r in bpe.encoding_digest(docs, RANKS, public_tokenizers.PATTERN).collect()}
    counts = {r["doc_id"]: r for r in token_count.token_count_digest(docs, JSON).collect()}
    assert len(rows) == len(counts) == docs.count()
    import hashlib

    for r in docs.collect():
        assert rows[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert counts[r["doc_id"]]["over_limit"] == (counts[r["doc_id"]]["n_tokens"] > 1024)
