"""Centroid clustering with exact distances by bit planes: one 64-bit word holds one bit of all 64 components.

Components are whole numbers in two's complement. Plane p of a vector packs bit p of its components into one word; the last
plane's bits weigh negatively. The dot product of two vectors is then the sum, over pairs of planes, of the pair's weight times
the number of ones in the AND of the two words, so distances come from AND and popcount alone and are exact. Sums for the new
centroids come from the planes too: of each cluster and plane, how many vectors have each bit set.

Spark holds the vectors as planes, written once (11 words a vector where components are below 1,024, in place of 64). Each round is
one pass over them, in which a task counts its own bits of each cluster and gives one row a cluster and component; Spark adds
those up, and the driver gets the centroids alone: ``clusters`` x 64 numbers, which don't grow with the vectors.

Defined cases: vectors that aren't of 64 components, or hold a null, NaN or infinite one, take no part and have no row. Null ids
are clustered but start no centroid; rows that repeat an id are rows of their own, those of one id start centroids in the order of
their planes; fewer vectors than clusters start fewer centroids; without any vector with an id, cluster, distance, sums and
digest are null. An empty table gives an empty one. Components are held at 2**59 after scaling; distances and sums beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import stored
from gradeflow.llm._vectors import as_long, decimals, matrix, whole, whole_numbers

CLUSTERS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
SIZE = 64
#: Rows that are worked on at once; bounds a task's memory whatever the batch is.
ROWS = 8192


def width(ints: np.ndarray) -> int:
    """Planes that hold these numbers in two's complement."""
    return int(max(ints.max(initial=0), ~ints.min(initial=0))).bit_length() + 1


def packed(ints: np.ndarray) -> np.ndarray:
    """(rows, planes) words: bit j of word p is bit p of component j."""
    planes = [np.packbits(((ints >> p) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for p in range(width(ints))]
    return np.concatenate(planes, axis=1)


def bits(words: np.ndarray) -> np.ndarray:
    """(rows, 64) zeros and ones of one word a row."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")


def weights(planes: int) -> list[int]:
    return [1 << p for p in range(planes - 1)] + [-(1 << (planes - 1))]


def unpacked(planes: np.ndarray) -> np.ndarray:
    return sum(bits(planes[:, p]).astype(np.int64) * w for p, w in enumerate(weights(planes.shape[1])))


def total(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over pairs of planes (the last axis of either side) of weight times popcount of AND: the dot products."""
    a, b = left.shape[-1], right.shape[-1]
    kind = np.int64 if a + b + 8 < 63 else object
    pairs = ((weights(a)[p] * weights(b)[q], np.bitwise_count(left[..., p] & right[..., q])) for p in range(a) for q in range(b))
    return sum(w * n.astype(kind) for w, n in pairs)


def dots(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return total(vectors[:, None, :], centroids[None, :, :])


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, all as planes; of equal distances the smaller number."""
    products, own, other = dots(vectors, centroids), total(vectors, vectors), total(centroids, centroids)
    if object in (products.dtype, own.dtype, other.dtype):
        products, own, other = map(whole_numbers, (products, own, other))
    squares = own[:, None] - 2 * products + other[None, :]
    found = squares.argmin(1)
    return found, squares[np.arange(len(found)), found]


def in_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            words = packed(matrix(part.column("ints"), SIZE))
            lists = pa.ListArray.from_arrays((np.arange(len(words) + 1) * words.shape[1]).astype(np.int32), pa.array(words.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), lists], ["vec_id", "planes"])


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of a batch, by number of planes, in slices."""
    lists = batch.column("planes")
    sizes = np.diff(lists.offsets.to_numpy())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            yield some, matrix(lists.take(pa.array(some)), size).view(np.uint64)


SUMS = "cluster int, at int, total decimal(38,0), n bigint"


def cluster_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums of the components of each cluster that has rows, and their number."""
    k = len(centroids)
    words = packed(centroids)
    counts, n = np.zeros((k, SIZE), object), np.zeros(k, np.int64)
    for batch in batches:
        for _, planes in by_width(batch):
            member = np.equal.outer(np.arange(k), nearest(planes, words)[0])
            n += member.sum(1)
            ones = member.astype(np.float32)  # slices are short, so these counts are exact
            for p, w in enumerate(weights(planes.shape[1])):
                counts += w * (ones @ bits(planes[:, p]).astype(np.float32)).astype(np.int64).astype(object)
    used = np.flatnonzero(n)
    columns = [np.repeat(used, SIZE).astype(np.int32), np.tile(np.arange(SIZE, dtype=np.int32), len(used)), counts[used].ravel(), np.repeat(n[used], SIZE)]
    yield pa.RecordBatch.from_arrays([decimals(c) if c.dtype == object else pa.array(c) for c in columns], ["cluster", "at", "total", "n"])


def plane_table(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, planes) of the vectors that take part, written to the shared folder."""
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.when(F.size(vector) == SIZE, whole(F.col(vector), scale)).alias("ints"))
    return stored(rows.where("ints is not null").mapInArrow(in_planes, "vec_id bigint, planes array<bigint>"), "planes")


def fitted(planes: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The final centroids as rows of integers."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = planes.where("vec_id is not null").orderBy(order, "planes").limit(clusters).select("planes").collect()  # at most ``clusters`` rows
    centroids = np.array([unpacked(np.array([r["planes"]], np.int64).view(np.uint64))[0] for r in first], np.int64).reshape(len(first), SIZE)
    for _ in range(rounds if first else 0):
        held = centroids.copy()
        found = planes.mapInArrow(lambda batches, held=held: cluster_sums(batches, held), SUMS)
        for row in found.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # a row for each cluster and component
            centroids[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return centroids


def assigned(planes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance decimal(38,0)) of every vector."""
    if not len(centroids):
        return planes.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("decimal(38,0)").alias("distance"))
    words = packed(centroids)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, planes in by_width(batch):
                found, squares = nearest(planes, words)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(found.astype(np.int32)), decimals(squares)], ["vec_id", "cluster", "distance"])

    return planes.mapInArrow(look_up, "vec_id bigint, cluster int, distance decimal(38,0)")


def clustering_digest(embeddings: DataFrame) -> DataFrame:
    spark = embeddings.sparkSession
    planes = plane_table(embeddings)
    centroids = fitted(planes)
    rows = stored(assigned(planes, centroids), "clusters")
    sums = {r["cluster"]: r["own"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()}  # one row a cluster
    every = sum(sums.values()) if None not in sums.values() else None
    table = [(k, own, every, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest() if k is not None else None) for k, own in sums.items()]
    named = spark.createDataFrame(table, "cluster int, own decimal(38,0), every decimal(38,0), centroid_sha256 string")
    rows = rows.alias("r").join(F.broadcast(named).alias("s"), F.col("r.cluster").eqNullSafe(F.col("s.cluster")))
    columns = {"distance": "distance", "own": "cluster_inertia", "every": "inertia"}
    return rows.select("vec_id", "r.cluster", *[as_long(F.col(c)).alias(name) for c, name in columns.items()], "centroid_sha256")
