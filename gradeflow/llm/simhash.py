"""SimHash near-duplicates: fingerprints of word shingles, and groups of texts whose fingerprints differ in few bits.

Candidates come from the pigeonring principle. A fingerprint is a ring of 16 segments of 4 bits. If two fingerprints
differ in at most 3 bits, some segment of the ring begins a chain whose first l segments differ in at most l * 3 / 16
bits together, for every l up to 16: the first 5 segments agree, the first 10 differ in at most one bit, the first 15 in
at most two. So at one of the 16 starts the first 20 bits agree, and of the next 20 at most one bit differs, so that
either the next 8 agree or the 12 after those. These two keys a start (28 and 32 bits) find every pair, and the chain's
budgets prune candidates before the full Hamming check.

Equal fingerprints are one node. Keys with more than ``BLOCK`` nodes are cut into blocks by hash and each pair of blocks
is compared by itself, so no task holds an unbounded bucket; a bucket returns at most one link a node (a spanning forest
of its links), never all pairs. Links are followed across buckets by alternating star steps (each node links to its
smallest neighbour), with every round written to the shared folder.

Defined cases: null and wordless texts have fingerprint zero and link like any other; a row with a null id takes part and
gets the component's smallest id, which is null if no row of the component has an id; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import row_slices, stored

SEED = 42
SEGMENTS, WIDTH, LIMIT = 16, 4, 3
BLOCK = 4096
#: Rows that a task compares at once, in whole groups.
ROWS = 100_000
#: Shingles hashed at once.
HASHES = 1 << 18


def salted(hashes: np.ndarray, salt: int) -> np.ndarray:
    """The hashes themselves for salt 0, else other hashes of the same shingles."""
    if not salt:
        return hashes
    h = (hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def fingerprints(column: pa.Array, shingle: int, prints: int = 1) -> np.ndarray:
    """Signed 64-bit fingerprints of texts, ``prints`` of each, by hashes of their own."""
    out = np.zeros((len(column), prints), np.int64)
    for low, high in row_slices(column):
        texts = column.slice(low, high - low).to_pylist()
        hashes: list[int] = []
        edges: list[int] = []
        ones = np.zeros((prints, len(texts), 64), np.int64)
        totals = np.zeros(len(texts), np.int64)

        def flush() -> None:
            if not hashes:
                return
            rows, first = np.unique(np.array(edges), return_index=True)
            for k in range(prints):
                each = np.ascontiguousarray(salted(np.array(hashes, "<u8"), k)).view(np.uint8).reshape(-1, 8)
                ones[k, rows] += np.add.reduceat(np.unpackbits(each, axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
            totals[rows] += np.diff(np.append(first, len(hashes)))
            hashes.clear()
            edges.clear()

        for row, text in enumerate(texts):
            words = (text or "").encode().lower().split()
            if not words:
                continue
            n = max(1, len(words) - shingle + 1)
            for at in range(0, n, HASHES):
                part = words[at : min(n, at + HASHES) + shingle - 1]
                joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
                hashes += [xxhash.xxh64_intdigest(s, SEED) for s in joined]
                edges += [row] * (len(hashes) - len(edges))
                if len(hashes) >= HASHES:
                    flush()
        flush()
        for k in range(prints):
            set_ = (ones[k] * 2 > totals[:, None]).astype(np.uint8)
            out[low:high, k] = np.packbits(set_, axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Column of fingerprints (long) of whole texts."""

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(fingerprints(column, shingle)[:, 0])

    return hashed(text)


def fingerprint_array(text: Column, shingle: int, prints: int) -> Column:
    """Column of arrays of ``prints`` fingerprints of whole texts."""

    @F.arrow_udf("array<bigint>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = fingerprints(column, shingle, prints)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * prints), pa.array(found.ravel()))

    return hashed(text)


def rotated(bits: Column, by: int) -> Column:
    return bits if not by else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))


def ring_keys(bits: Column) -> Column:
    """The 32 keys of a fingerprint: start, variant and bits packed into a long."""
    keys = []
    for start in range(SEGMENTS):
        turned = rotated(bits, start * WIDTH)
        head = F.shiftrightunsigned(turned, 44)  # 20 bits
        near = F.shiftrightunsigned(turned, 36).bitwiseAND(F.lit(0xFF))
        far = F.shiftrightunsigned(turned, 24).bitwiseAND(F.lit(0xFFF))
        for variant, tail in enumerate((near, far)):
            keys.append(F.shiftleft(F.lit(start * 2 + variant).cast("bigint"), 40) + F.shiftleft(head, 12) + tail)
    return F.array(*keys)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def within_chain(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether pairs keep the chain's budgets from their key's start, and then the full distance."""
    diff = a ^ b
    by = (start * WIDTH).astype(np.uint64)
    turned = np.where(by == 0, diff, (diff << by) | (diff >> ((np.uint64(64) - by) & np.uint64(63))))
    ok = turned >> np.uint64(44) == 0  # 5 segments, none
    ok &= popcount(turned >> np.uint64(24)) <= 1  # 10 segments
    ok &= popcount(turned >> np.uint64(4)) <= 2  # 15 segments
    return ok & (popcount(diff) <= LIMIT)


def forest(groups: np.ndarray, bits: np.ndarray, start: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``groups``, thinned to a spanning forest. side: block number where a pair of blocks meets, else -1 twice."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    left, right = [], []
    at, gap = np.arange(len(groups)), 0
    while True:
        gap += 1
        at = at[at + gap < len(groups)]
        at = at[groups[at] == groups[at + gap]]
        if not len(at):
            break
        pair = at[(side[at] != side[at + gap]) | (side[at] < 0)]
        pair = pair[within_chain(bits[pair], bits[pair + gap], start[pair])]
        for g, a, b in zip(groups[pair].tolist(), bits[pair].tolist(), bits[pair + gap].tolist(), strict=True):
            x, y = root((g, a)), root((g, b))
            if x != y:
                parent[x] = y
                left.append(a)
                right.append(b)
    return np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64)


def grouped_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, side, bits) come in order of key and cell; whole groups are compared together."""
    held: list[np.ndarray] = []

    def take(rows: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))
        start = (rows[:, 0] >> 41).astype(np.uint64)
        a, b = forest(np.cumsum(new), rows[:, 3].view(np.uint64), start, rows[:, 2])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= ROWS:
            rows = np.concatenate(held)
            last = rows[-1]
            same = np.flatnonzero((rows[:, 0] != last[0]) | (rows[:, 1] != last[1]))
            whole = int(same[-1]) + 1 if len(same) else 0
            if whole:
                yield take(rows[:whole])
            held = [rows[whole:]]
    if held and sum(map(len, held)):
        yield take(np.concatenate(held))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``bits``) that differ in at most 3 bits; enough of them to connect all that links connect."""
    keyed = nodes.select("bits", F.explode(ring_keys(F.col("bits"))).alias("key"))
    crowded = stored(keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "crowded")
    many = crowded.count()
    if many:
        crowded = F.broadcast(crowded) if many <= 200_000 else crowded
        block = F.pmod(F.xxhash64("bits"), F.col("blocks"))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        cells = keyed.join(crowded, "key", "left").select("key", "bits", "blocks", block.alias("block"), other.alias("other"))
        cells = cells.select(
            "key",
            F.when(F.col("blocks").isNull(), F.lit(0).cast("bigint")).otherwise(F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("cell"),
            F.when(F.col("blocks").isNull() | (F.col("block") == F.col("other")), F.lit(-1).cast("bigint")).otherwise(F.col("block")).alias("side"),
            "bits",
        )
        # a block's pair with itself and with others are cells of their own, so sides are -1 all through a cell or never
    else:
        cells = keyed.select("key", F.lit(0).cast("bigint").alias("cell"), F.lit(-1).cast("bigint").alias("side"), "bits")
    placed = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return placed.mapInArrow(grouped_links, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of all nodes that pairs (a, b) connect; root: the smallest node. Alternating star steps."""
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = stored(small.where("a <> b").distinct(), "pairs")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = now


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, bits, component): fingerprint, and the smallest id that links reach."""
    rows = stored(documents.select(F.col(key), fingerprint(F.col(text), shingle).alias("bits")), "fingerprints")
    nodes = stored(rows.groupBy("bits").agg(F.min(key).alias("least")), "nodes")
    found = components(links(nodes))
    joined = nodes.join(found.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    lowest = joined.groupBy("root").agg(F.min("least").alias("component"))
    of = joined.join(lowest, "root").select("bits", "component")
    return rows.join(of, "bits").select(key, "bits", "component")


def near_duplicates_by_any(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, prints: int = 4) -> DataFrame:
    """(key, component): as ``near_duplicates``, with several fingerprints by hashes of their own, of which any one links.
    A single fingerprint of similar texts passes 3 bits by luck often enough; several find most of what one misses."""
    rows = documents.select(F.col(key), fingerprint_array(F.col(text), shingle, prints).alias("prints"))
    rows = stored(rows.withColumn("node", F.xxhash64("prints")), "fingerprints")
    nodes = stored(rows.groupBy("node").agg(F.min("prints").alias("prints"), F.min(key).alias("least")), "nodes")
    edges = []
    for k in range(prints):
        part = nodes.select("node", F.get("prints", F.lit(k)).alias("bits"))
        first = stored(part.groupBy("bits").agg(F.min("node").alias("first")), "first")
        edges.append(part.join(first, "bits").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
        pairs = stored(links(first.select("bits")), "links")
        side = lambda c, first=first: first.select(F.col("bits").alias(c), F.col("first").alias(f"{c}_node"))
        edges.append(pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    found = components(reduce(DataFrame.unionByName, edges))
    joined = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(joined.join(lowest, "root").select("node", "component"), "node").select(key, "component")


def simhash_digest(documents: DataFrame) -> DataFrame:
    """One row for each document: fingerprint in hex, and component."""
    return near_duplicates(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
