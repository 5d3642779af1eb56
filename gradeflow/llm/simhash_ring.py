"""SimHash near-duplicates by similarity: groups of texts whose sets of five-word shingles share at least four fifths.

A single fingerprint of 64 bits at 3 bits finds few pairs at that similarity, so a text gets a ring of 16 segments of 64 bits. Each
segment is the SimHash (majority of bits) of four shingles that are sampled by their own least hashes, so similar texts often sample
the same four, and then agree in the whole segment. Candidates are nodes that agree in a segment. They go through the pigeonring
filter: if two rings differ in at most ``LIMIT`` bits, some segment begins a chain whose first l segments differ in at
most l * LIMIT / 16 bits together, for every l. Texts of similarity 0.8 differ in about 130 bits of 1024 and unrelated ones in
440, so a limit of 320 prunes what is unrelated and loses nothing similar. What passes is held against the sets themselves, so
nothing less similar links. Two texts of similarity 0.8 agree in no segment in 0.02 % of cases, and in fewer the more similar they are.

Texts with the same set are one node. Groups of nodes that agree in several segments and have the same members are searched
once. A group is searched from node to node: those that link leave the search, so that a group of near copies costs a few
passes over it and returns one pair for each node that links connect to another, never all pairs. Groups of more than ``BLOCK`` nodes are cut into
blocks, of which each two are searched together.

Defined cases: null and wordless texts have the empty set and are one node; a text shorter than a shingle is one shingle;
repeated rows are one node and each keep a row; rows with a null id take part; an empty table gives an empty one; texts of any
length are read whole. Sets hold 32 bits of each shingle's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import row_slices, stored
from gradeflow.llm.simhash import components

THRESHOLD = 0.8
SEGMENTS, SAMPLE = 16, 4
#: Segments whose groups are searched first.
FIRST = 4
#: Bits of the whole ring that may differ.
LIMIT = 320
BLOCK = 2048
SEED = 42
#: Shingles hashed at once.
HASHES = 4096
_random = np.random.default_rng(SEED)
SALT = _random.integers(0, 1 << 63, SEGMENTS * SAMPLE, dtype=np.uint64)
ODD = _random.integers(0, 1 << 63, SEGMENTS * SAMPLE, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's word shingles."""
    words = np.array([xxhash.xxh64_intdigest(w, SEED) for w in (text or "").encode().lower().split()], np.uint64)
    if not len(words):
        return np.zeros(0, np.uint32)
    size = min(shingle, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mixed(total + words[k : k + n])
    return np.unique((total >> np.uint64(32)).astype(np.uint32))


def ring(set_: np.ndarray) -> np.ndarray:
    """The segments of a set; none for the empty set."""
    if not len(set_):
        return np.zeros(0, np.uint64)
    wide = mixed(set_.astype(np.uint64))
    least = np.full(SEGMENTS * SAMPLE, ~np.uint64(0))
    for at in range(0, len(wide), HASHES):
        x = (wide[at : at + HASHES, None] ^ SALT) * ODD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    # a bit of a segment is set if it is in over half, so in three or four, of the sampled shingles' hashes
    a, b, c, d = mixed(least).reshape(SEGMENTS, SAMPLE).T
    return (a & b & (c | d)) | (c & d & (a | b))


def within_ring(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether rings keep a chain's budgets from some segment on all around, and the whole limit."""
    differ = np.bitwise_count(others ^ one).astype(np.int64)
    sums = np.cumsum(np.concatenate([np.zeros((len(differ), 1), np.int64), differ, differ], axis=1), axis=1)
    over = sums - np.arange(2 * SEGMENTS + 1) * (LIMIT // SEGMENTS)  # a chain from s keeps its budgets if no later sum is over that at s
    ok = np.zeros(len(differ), bool)
    for start in range(SEGMENTS):
        ok |= (over[:, start + 1 : start + SEGMENTS + 1] <= over[:, start : start + 1]).all(axis=1)
    return ok & (sums[:, SEGMENTS] <= LIMIT)


def sketched(documents: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, hash, node, ring, shingles) of each row; hash: of the text; node: of its set."""
    kind = dict(documents.dtypes)[key]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in row_slices(whole.column(2)):
                batch = whole.slice(low, high - low)
                sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
                rings = [ring(s) for s in sets]
                nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
                ends = np.cumsum([0, *map(len, rings)], dtype=np.int32)
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rings, np.zeros(0, np.uint64)]).view(np.int64))),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "hash", "node", "ring", "shingles"])

    own = documents.select(F.col(key), F.xxhash64(text).alias("hash"), F.col(text))
    return own.mapInArrow(rows, f"`{key}` {kind}, hash bigint, node bigint, ring array<bigint>, shingles binary")


def forest(sets: list[np.ndarray], rings: np.ndarray) -> list[tuple[int, int]]:
    """What links connect inside a group of distinct sets, as pairs of the first of a tree and each other one. rings: a row of
    segments for each."""
    sizes = np.array([len(s) for s in sets])
    left = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue and left.any():
            own = queue.pop()
            rest = np.flatnonzero(left)
            rest = rest[within_ring(rings[own], rings[rest])]
            if not len(rest):
                continue
            flat = np.concatenate([sets[k] for k in rest])
            near = sets[own][np.minimum(np.searchsorted(sets[own], flat), sizes[own] - 1)] == flat
            ends = np.cumsum(sizes[rest])
            shared = np.diff(np.append(0, np.append(0, np.cumsum(near))[ends]))
            found = rest[shared >= THRESHOLD * (sizes[rest] + sizes[own] - shared) - 1e-9]
            left[found] = False
            queue += found.tolist()
            out += [(first, int(x)) for x in found]
    return out


def grouped_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, node, ring, shingles) come in order of key and cell; whole groups are searched."""
    held: list[tuple[int, list[int], bytes]] = []
    a, b = [], []
    now = None

    def take() -> None:
        if len(held) > 1:
            held.sort(key=lambda h: h[0])  # so that the smallest node of a tree is its first
            for x, y in forest([np.frombuffer(s, np.uint32) for *_, s in held], np.array([r for _, r, _ in held], np.int64).view(np.uint64)):
                a.append(held[x][0])
                b.append(held[y][0])
        held.clear()

    def pairs() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a.clear()
        b.clear()
        return out

    for batch in batches:
        for key, cell, node, segments, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, cell) != now:
                take()
                now = (key, cell)
            held.append((node, segments, shingles))
        yield pairs()
    take()
    yield pairs()


def crowded(keyed: DataFrame) -> DataFrame:
    """(key, blocks): of the keys of several nodes (node, key, root), those whose nodes aren't all of one root; of keys that
    have the same nodes one is enough."""
    members = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"m{k}") for k in (0, 1)]
    counts = keyed.groupBy("key").agg(F.count("*").alias("count"), *members, (F.min("root") < F.max("root")).alias("open")).where("open")
    return counts.groupBy("count", "m0", "m1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))


def searched(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) inside the groups that share a key. sets: (node, shingles, ring)."""
    shared = keyed.join(crowded(keyed), "key")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # every two blocks meet in a cell of their own
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda x: x != F.col("block"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(others))
    cells = shared.withColumn("block", block).select("key", "node", "blocks", "block", other.alias("other"))
    cells = cells.select("key", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("cell"), "node")
    placed = cells.join(sets, "node").select("key", "cell", "node", "ring", "shingles").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return stored(placed.mapInArrow(grouped_links, "a bigint, b bigint").distinct(), "links")


def links(sketches: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of at least the similarity; enough of them to connect all that links connect. The groups of the
    first segments are searched first; of the other segments' groups, those whose nodes are all joined to one node already add
    nothing."""
    keyed = stored(sketches.select("node", F.posexplode("ring")).select("node", "pos", F.xxhash64("pos", "col").alias("key")).distinct(), "keys")
    # sets are fetched once, for the nodes that share a segment with another; these are stored first, so that Spark sees their
    # size and sends them to the sketches where it allows a broadcast, instead of shuffling all sketches
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    needed = stored(keyed.join(shared, "key", "left_semi").select("node").distinct(), "needed")
    sets = sketches.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("shingles", "ring")).alias("s")).select("node", "s.*")
    sets = stored(sets, "sets")
    first = searched(keyed.where(F.col("pos") < FIRST).select("node", "key", F.col("node").alias("root")), sets)
    # the smallest node that one of a node's groups connects it with
    near = first.select(F.col("a").alias("node"), F.col("a").alias("root")).unionByName(first.select(F.col("b").alias("node"), F.col("a").alias("root")))
    near = near.groupBy("node").agg(F.min("root").alias("root"))
    rest = keyed.where(F.col("pos") >= FIRST).join(near, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    return first.unionByName(searched(rest, sets))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(key, hash, root, component) of each row: hash of its text, group, and the smallest id of the group."""
    sketches = stored(sketched(documents, key, text, shingle), "sketches")
    found = components(links(sketches))
    rows = sketches.select(key, "hash", "node").join(found, "node", "left").select(key, "hash", F.coalesce("root", "node").alias("root"))
    lowest = rows.groupBy("root").agg(F.min(key).alias("component"))
    return rows.join(lowest, "root").select(key, "hash", "root", "component")
