"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Texts are brought to the form " w1 w2 ... wn " (ASCII letters in lower case, words of letters, digits and all characters
beyond ASCII), in which a window of words is a plain byte string with a space at either end. The search keeps Wu and
Manber's tables: a shift table over blocks of bytes says how far a window of the text can move because its last block
occurs in no pattern, or only further to the left; where the shift is zero, the suffix block's bucket gives the patterns
to try. Blocks are longer and the table is larger the more patterns there are. Inside a bucket, patterns stand in order of
their first bytes, so that only those which begin like the text are tried, and a direct comparison of the bytes confirms
each. A batch of texts is cut into lanes whose pointers move in step, so that each step is one lookup over all lanes.

Patterns are places in the benchmark's text, never copies of it. A pass holds at most ``PASS_BYTES`` of the benchmark; larger
benchmarks are split by a hash of their items into as many passes over each batch as needed, and a task holds the tables of
one pass at a time.

Defined cases: null and wordless texts have no words and are never hit; null or wordless items, and items with a null id,
have no windows; repeated items count once by id, with the windows of all their rows; an empty benchmark hits nothing, and an
empty table gives an empty one; texts of any length are searched whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import row_slices, text_buffer

WINDOW_WORDS = 10
#: Bytes of the benchmark that one pass searches for; what a broadcast holds is bounded by it.
PASS_BYTES = 16 << 20
#: Lower bounds of the classes of pattern length. Each class has tables of its own, as the shortest pattern limits the shifts.
CLASSES = (0, 8, 16, 32, 64)
TABLE_BITS = (16, 23)
#: Positions that are verified together.
VERIFY = 1 << 16
LANES = 1024
NAMED = 256  # patterns whose items are kept as a set
RESULT = "struct<n_words:bigint,hit_runs:array<struct<start:bigint,end:bigint>>,items:array<string>>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@dataclass
class Normal:
    """Texts laid end to end in normal form: bytes, and for each byte the number of words begun before it."""

    data: bytes
    starts: np.ndarray  # where each word begins in data
    first: np.ndarray  # n + 1 word offsets of the texts


def normalized(buffer: np.ndarray, offsets: np.ndarray) -> Normal:
    """Each text gets a space before its first word and after each word."""
    word = _WORD[buffer]
    begins = word.copy()
    inner = np.ones(len(buffer), bool)
    inner[offsets[:-1][offsets[:-1] < len(buffer)]] = False
    begins[1:] &= ~(word[:-1] & inner[1:])
    at = np.flatnonzero(begins)
    first = np.searchsorted(at, offsets)
    # each word's bytes, its end (a space), and one more space before a text's first word
    kept = np.flatnonzero(word)
    number = np.cumsum(begins)[kept] - 1  # of the word that each kept byte belongs to
    heads = np.diff(first) > 0
    extra = np.zeros(len(at) + 1, np.int64)
    extra[first[:-1][heads]] = 1
    shift = np.cumsum(extra[: len(at)])  # spaces before words, so far
    out = np.full(len(kept) + len(at) + int(heads.sum()), 32, np.uint8)
    place = np.arange(len(kept)) + number + shift[number] if len(kept) else kept
    out[place] = _LOWER[buffer[kept]]
    starts = place[np.flatnonzero(np.diff(number, prepend=-1))] if len(kept) else kept
    return Normal(out.tobytes(), starts, first)


_ODD = np.uint64(0x9E3779B97F4A7C15)


class Class:
    """Wu-Manber tables for patterns of similar length: bytes text[start : start + size]."""

    def __init__(self, text: bytes, start: np.ndarray, size: np.ndarray):
        self.text, self.start, self.size = text, start, size
        self.length = int(size.min())
        volume = len(start) * self.length
        self.block = 8 if self.length >= 32 and volume > 1 << 18 else 4 if self.length >= 16 else min(2, self.length)
        low, high = TABLE_BITS
        self.bits = min(high, max(low, volume.bit_length() + 1))
        codes_at = self.codes(text)
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int16 if self.length < 1 << 15 else np.int32)
        for end in range(self.block, self.length + 1):  # from left to right, so that the smallest shift is the last written
            self.shift[codes_at(start + end - self.block)] = self.length - end
        key = self.key(codes_at(start + self.length - self.block), text, start)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def codes(self, data: bytes):
        """A function from places in data to the hash of the block there."""
        kind = {8: "<u8", 4: "<u4", 2: "<u2", 1: "u1"}[self.block]
        blocks = np.ndarray(len(data) - self.block + 1, kind, data, strides=(1,))
        return lambda at: ((blocks[at].astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.intp)

    def key(self, code: np.ndarray, data: bytes, at: np.ndarray) -> np.ndarray:
        """Suffix block's bucket, and a hash of the first bytes to order it by."""
        width = 8 if self.length >= 8 else 2 if self.length >= 2 else 1
        heads = np.ndarray(len(data) - width + 1, {8: "<u8", 2: "<u2", 1: "u1"}[width], data, strides=(1,))[at].astype(np.uint64)
        return (code.astype(np.uint64) << np.uint64(64 - self.bits)) | ((heads * _ODD) >> np.uint64(self.bits))

    def search(self, data: bytes) -> Iterator[tuple[int, int]]:
        """Positions, and numbers of patterns that begin there."""
        n = len(data) - self.length + 1
        if n <= 0:
            return
        code_of = self.codes(data)
        tail = self.length - self.block
        step = -(-n // LANES)
        at = np.arange(0, n, step)
        stop = np.minimum(at + step, n)
        found, waiting = [], 0
        while len(at):
            code = code_of(at + tail)
            move = self.shift[code]
            zero = np.flatnonzero(move == 0)
            if len(zero):
                found.append((at[zero], code[zero]))
                waiting += len(zero)
                if waiting >= VERIFY:
                    yield from self.verified(data, found)
                    found, waiting = [], 0
            at = at + np.maximum(move, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if found:
            yield from self.verified(data, found)

    def verified(self, data: bytes, found: list) -> Iterator[tuple[int, int]]:
        places, codes = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        key = self.key(codes, data, places)
        low, high = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
        some = np.flatnonzero(high > low)
        for place, a, b in zip(places[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            for k in self.order[a:b].tolist():
                begin = int(self.start[k])
                if data.startswith(self.text[begin : begin + int(self.size[k])], place):
                    yield place, k


class Matcher:
    """All classes of one pass over a benchmark's items: (id, text)."""

    def __init__(self, items: list[tuple[str, str]], words: int):
        normal = normalized(*text_buffer(pa.array([t for _, t in items], pa.string())))
        ends = np.append(normal.starts, len(normal.data))
        count = np.diff(normal.first)
        windows = np.where(count > 0, np.maximum(1, count - words + 1), 0)
        item = np.repeat(np.arange(len(items)), windows)
        first = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows) + normal.first[item]
        last = np.minimum(first + words, normal.first[item + 1]) - 1
        begin = normal.starts[first] - 1
        # a word ends with the space in front of the next one; an item's last word, where the next item's own space begins
        inner = last + 1 < normal.first[item + 1]
        after = ends[np.minimum(last + 1, len(ends) - 1)]
        end = np.where(inner | (after == len(normal.data)), after, after - 1) if len(item) else after
        # windows of the same bytes are one pattern, with the items that hold it
        numbers: dict[bytes, int] = {}
        pattern = np.array([numbers.setdefault(normal.data[a:b], len(numbers)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
        order = np.argsort(pattern, kind="stable")
        self.ids = [i for i, _ in items]
        self.holders, self.edges = item[order], np.searchsorted(pattern[order], np.arange(len(numbers) + 1))
        self.named: dict[int, set[str]] = {}
        one = order[self.edges[:-1]]
        self.words = (last - first + 1)[one]
        begin, size = begin[one], (end - begin)[one]
        kind = np.searchsorted(np.array(CLASSES), size, side="right")
        self.classes = [(np.flatnonzero(kind == k), Class(normal.data, begin[kind == k], size[kind == k])) for k in np.unique(kind)]

    def matches(self, data: bytes) -> Iterator[tuple[int, int]]:
        """Places and patterns of all occurrences."""
        for numbers, c in self.classes:
            for place, k in c.search(data):
                yield place, int(numbers[k])

    def items(self, pattern: int) -> set[str]:
        found = self.named.get(pattern)
        if found is None:
            if len(self.named) >= NAMED:
                self.named.clear()
            found = self.named[pattern] = {self.ids[k] for k in self.holders[self.edges[pattern] : self.edges[pattern + 1]].tolist()}
        return found


def search_batch(column: pa.Array, passes: list[Broadcast]) -> pa.Array:
    """Words, runs of hit words and items found, for each text. With several passes, all slices of a batch go through one before
    the next, so that tables are built once a batch; with one, a slice is done with before the next is brought to its form."""
    parts = (column.slice(a, b - a) for a, b in row_slices(column))
    if len(passes) <= 1:
        out = [Found(part).after(passes) for part in parts]
    else:
        slices = [Found(part) for part in parts]
        for one in passes:
            matcher = tables(one)
            for part in slices:
                part.search(matcher)
        out = [part.result() for part in slices]
    return pa.concat_arrays(out) if out else pa.array([], pa_type())


def pa_type() -> pa.DataType:
    run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.struct([("n_words", pa.int64()), ("hit_runs", pa.list_(run)), ("items", pa.list_(pa.string()))])


_LOADED: list = [None, None]  # the pass whose tables this worker holds


def tables(one: Broadcast) -> Matcher:
    token, items, words = one.value
    if _LOADED[0] != token:
        _LOADED[:] = [token, Matcher(items, words)]
    return _LOADED[1]


class Found:
    """A slice of texts, and what passes have found in it."""

    def __init__(self, column: pa.Array):
        self.normal = normalized(*text_buffer(column))
        self.edges = np.zeros(len(self.normal.starts) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(len(column))]

    def search(self, matcher: Matcher) -> None:
        normal = self.normal
        told: set[tuple[int, int]] = set()  # texts and patterns whose items are noted already
        for place, pattern in matcher.matches(normal.data):
            word = int(np.searchsorted(normal.starts, place + 1))
            self.edges[word] += 1
            self.edges[word + int(matcher.words[pattern])] -= 1
            row = int(np.searchsorted(normal.first, word, side="right")) - 1
            if (row, pattern) not in told:
                told.add((row, pattern))
                self.items[row] |= matcher.items(pattern)

    def after(self, passes: list[Broadcast]) -> pa.Array:
        for one in passes:
            self.search(tables(one))
        return self.result()

    def result(self) -> pa.Array:
        return as_array(self.normal, self.edges, self.items)


def as_array(normal: Normal, edges: np.ndarray, items: list[set[str]]) -> pa.Array:
    total = len(normal.starts)
    hit = np.cumsum(edges[:-1]) > 0
    begin = hit.copy()
    begin[1:] &= ~hit[:-1]
    begin[normal.first[:-1][normal.first[:-1] < total]] |= hit[normal.first[:-1][normal.first[:-1] < total]]
    end = hit.copy()
    end[:-1] &= ~hit[1:]
    last = normal.first[1:][normal.first[1:] > 0] - 1
    end[last] |= hit[last]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(normal.first, begins, side="right") - 1
    own = normal.first[row]
    offsets = np.searchsorted(begins, normal.first)
    runs = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(begins - own), pa.array(ends - own)], ["start", "end"])
    )
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(normal.first)), runs, pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        ["n_words", "hit_runs", "items"],
    )


def pattern_passes(benchmark: DataFrame, item: str = "item_id", text: str = "text", words: int = WINDOW_WORDS, pass_bytes: int = PASS_BYTES) -> list[Broadcast]:
    """Broadcasts of the benchmark's items, each of about ``pass_bytes``; one alone unless the benchmark is larger than that."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // pass_bytes))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        items = sorted((r.item, r.text) for r in part.collect())
        if items:
            out.append(spark.sparkContext.broadcast((uuid.uuid4().hex, items, words)))
    return out


def contamination(text: Column, passes: list[Broadcast]) -> Column:
    """Column of (n_words, hit_runs, items): words of the text, runs of words inside occurrences, items with occurring windows."""

    @F.arrow_udf(RESULT)
    def search(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield search_batch(batch, passes)

    return search(text)


def n_hit(found: Column) -> Column:
    return F.aggregate(found.hit_runs, F.lit(0).cast("bigint"), lambda acc, r: acc + r.end - r.start)


def contamination_digest(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: words, hit words, items, and a hash of the items' ids."""
    found = documents.select(F.col(key), contamination(F.col(text), pattern_passes(benchmark)).alias("found"))
    return found.select(
        key,
        F.col("found.n_words").alias("n_words"),
        n_hit(F.col("found")).alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.hit_runs") > 0).alias("contaminated"),
    )
