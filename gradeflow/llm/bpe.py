"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Long texts are cut into chunks that overlap. Each chunk is split into pre-tokens on its own, so chunks need nothing from
one another; neighbours are then stitched at the first position inside the overlap where both begin a pre-token, from
which on they agree, as the pattern never looks back. If the overlap has no such position (one pre-token fills it), the
left chunk is read on in windows of twice the length until it ends. Each piece is then merged by rank. Decoding lays the
bytes of the ids end to end.

Defined cases: a null text counts as empty and has no ids; repeated rows are each encoded; an empty table gives an empty one;
texts of any length are encoded whole, a slice of rows at a time, and decoded in pieces of ``DECODE_IDS``; an id that is null
or not in the vocabulary makes decoding fail; columns of the input other than id and text play no part.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import row_slices

CHUNK, OVERLAP = 16_384, 256
#: Pieces that a worker keeps encoded. The store is emptied when full.
STORE = 400_000
#: Ids that are turned into bytes at once; index arrays take eight times those bytes.
DECODE_IDS = 1 << 18
SHORT, NONE = 48, 1 << 60


def pre_tokens(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """All matches of the pattern in a text, by chunks."""
    if len(text) <= chunk + overlap:
        return pattern.findall(text)
    out: list[str] = []
    known, at = starts(text, 0, chunk + overlap, pattern), 0
    for left in range(chunk, len(text), chunk):
        following = starts(text, left, left + chunk + overlap, pattern)
        size = chunk + overlap
        while (meet := first_common(known, following, left)) is None and known[-1] < len(text):
            size *= 2
            if known[0] + size >= following[-1] and len(known) > 1:  # the next chunk is overrun
                following = starts(text, left, known[0] + 2 * size, pattern)
            known = starts(text, known[0], known[0] + size, pattern)
        if meet is None:
            break
        out += cut(text, known, at, meet)
        known, at = following, meet
    out += cut(text, starts(text, at, len(text), pattern) if known[-1] < len(text) else known, at, len(text))
    return out


def starts(text: str, begin: int, end: int, pattern: regex.Pattern) -> list[int]:
    """Where pre-tokens begin in text[begin:end], without the last two unless the text ends there (more text could change them)."""
    end = min(end, len(text))
    found = [m.start() for m in pattern.finditer(text, begin, end)]
    return [*found, end] if end == len(text) else found[:-2] or [begin]


def first_common(left: list[int], right: list[int], least: int) -> int | None:
    both = set(left)
    return next((x for x in right if x >= least and x in both), None)


def cut(text: str, edges: list[int], begin: int, end: int) -> list[str]:
    inside = [x for x in edges if begin <= x < end] + [end]
    return [text[a:b] for a, b in zip(inside, inside[1:], strict=False)]


class Vocabulary(dict):
    """Piece -> ids, filled as pieces come up."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for piece, rank in self.ranks.items():
            self.sizes[rank] = len(piece)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= STORE:
            self.clear()
        self[piece] = ids = tuple(self.merged(piece.encode()))
        return ids

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and where each begins (with the total last)."""
        sizes = self.sizes[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        if len(ids) and int(sizes.min()) == 0:
            raise ValueError("an id is not in the vocabulary")
        return self.flat[np.repeat(self.begins[ids] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def merged_short(self, piece: bytes) -> list[int]:
        """The same for few bytes, where a list is quicker than a heap."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joint = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while joint and (low := min(joint)) < NONE:
            i = joint.index(low)
            parts[i] += parts.pop(i + 1)
            del joint[i]
            if i < len(joint):
                joint[i] = rank(parts[i] + parts[i + 1], NONE)
            if i:
                joint[i - 1] = rank(parts[i - 1] + parts[i], NONE)
        return [self.ranks[x] for x in parts]

    def merged(self, piece: bytes) -> list[int]:
        """Joins the neighbours whose joint bytes have the lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= SHORT:
            return self.merged_short(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = list(range(1, n + 1))  # of the part that begins at i; 0 where a part was taken in by its left neighbour
        heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if ends[i] != mid or mid >= n or ends[mid] != end:
                continue
            ends[i], ends[mid] = end, 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, ends[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, i, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode_batch(column: pa.Array, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> pa.Array:
    vocab, parts = vocabulary(path, pattern), []
    for a, b in row_slices(column):
        texts = column.slice(a, b - a).to_pylist()
        pieces = [pre_tokens(t, vocab.pattern, chunk, overlap) if t else [] for t in texts]
        rows = [np.fromiter(chain.from_iterable(map(vocab.__getitem__, x)), np.int32) for x in pieces]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decode_batch(column: pa.Array, path: str, pattern: str) -> pa.Array:
    vocab = vocabulary(path, pattern)
    ids = column.flatten()
    if ids.null_count:
        raise ValueError("an id is null")
    ids = ids.to_numpy()
    # a null row has no ids in flatten(), and its edges are those of an empty row; the mask restores it
    edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
    data, sizes = [], []
    for low in range(0, len(ids), DECODE_IDS):
        part, ends = vocab.joined(ids[low : low + DECODE_IDS])
        data.append(part)
        sizes.append(np.diff(ends))
    flat = np.concatenate(data) if data else np.zeros(0, np.uint8)
    ends = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends[edges].astype(np.int64)), pa.py_buffer(flat)])
    return pc.if_else(column.is_valid(), out, None)


def binary_batches(column: pa.Array, path: str, pattern: str) -> pa.Array:
    """The same for a batch that Spark sent, which has to be of its binary type: rows in slices of about a million ids."""
    edges = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    parts, start = [], 0
    while start < len(column):
        base = edges[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(edges, base + 4 * DECODE_IDS, side="right")))
        parts.append(decode_batch(column.slice(start, stop - start), path, pattern).cast(pa.binary()))
        start = stop
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def encoded(text: Column, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Column of ids (array of int) of whole texts."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield encode_batch(column, path, pattern, chunk, overlap)

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Column of bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield binary_batches(column, path, pattern)

    return decode(ids)


def encoding_digest(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: number of ids, and hashes of the ids and of the bytes they decode to."""
    rows = documents.select(F.col(key), encoded(F.col(text), path, pattern).alias("ids"))
    return rows.select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path, pattern), 256).alias("decoded_sha256"),
    )
