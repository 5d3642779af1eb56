"""Exact top-k search by inner product: tiles of queries and shards of candidates, and a tree of merged top lists.

Candidates are dealt once into shards of at most some ``SHARD_BYTES`` and queries go to every shard, so what is shuffled is each
candidate once and each query once for each shard. A task holds one shard's candidates and streams the queries past them: tiles of
``QUERIES_A_TILE`` queries and ``CANDIDATES_A_TILE`` candidates are one matrix product each, from which only the k best of each
query leave. Top lists of ``FAN`` shards at a time are merged until one list is left for each query, so no task reads all shards'
lists. A task's memory is bounded by a shard and a tile, and work grows with queries times candidates, as an exact search must.

Components are scaled to integers first: scores are exact, whatever the order of summation. Where a tile's sums could
pass 2**53, they are computed in 64-bit integers instead of doubles; beyond 2**63 they are not defined.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite component take no part, nor do rows with a
null id; rows that repeat an id are each a query and a candidate, also for one another, as a query meets every row but its
own; vectors of another dimension than the query's are no candidates; equal scores rank by the smaller id; a query without
candidates returns no row, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import stored

QUERIES_A_TILE, CANDIDATES_A_TILE, FAN = 512, 8192, 8
#: Bytes of candidates in a shard: the most, and the least that tables too small to use all cores are cut into.
SHARD_BYTES, LEAST_BYTES = 64 << 20, 2 << 20
SCALE = 256
LISTS = "query_row bigint, query_id bigint, s int, vec_id bigint, score bigint"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long; null where the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))))


def tile_top(left: np.ndarray, right: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) by place of the k best candidates of each query in one tile; of equal scores the first candidates.
    same: where query and candidate are one row."""
    bound = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
    scores = (left.astype(float) @ right.T.astype(float)).astype(np.int64) if bound < 2**53 else left @ right.T
    scores[same] = np.iinfo(np.int64).min
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        above, equal = scores > least, scores == least
        picked = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1)[:, None]))
    else:
        picked = np.ones(scores.shape, bool)
    query, candidate = np.nonzero(picked & ~same)
    return query, candidate, scores[query, candidate]


def shard_top(queries: np.ndarray, query_rows: np.ndarray, shard: np.ndarray, shard_rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best candidates in the shard of each of a tile's queries, from the lists of its tiles."""
    found = []
    for at in range(0, len(shard), CANDIDATES_A_TILE):
        some = slice(at, at + CANDIDATES_A_TILE)
        query, candidate, score = tile_top(queries, shard[some], query_rows[:, None] == shard_rows[some], k)
        found.append((query, candidate + at, score))
    query, candidate, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((candidate, -score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first], candidate[first], score[first]


def streamed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, dimension, role (candidates first) and id. Holds the candidates of one shard and dimension."""
    place, held = None, []
    for batch in batches:
        shards, sizes, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "size", "asks"))
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(sizes) != 0) | (np.diff(asks) != 0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
            if start == stop:
                continue
            if place != (shards[start], sizes[start]):
                place, held = (shards[start], sizes[start]), []
            part = batch.slice(start, stop - start)
            vectors = part.column("ints").flatten().to_numpy().reshape(stop - start, sizes[start])
            rows, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
            if not asks[start]:
                held.append((vectors, rows, ids))
                continue
            if not held:
                continue
            if len(held) > 1:
                held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
            shard, shard_rows, shard_ids = held[0]
            for at in range(0, stop - start, QUERIES_A_TILE):
                some = slice(at, at + QUERIES_A_TILE)
                query, candidate, score = shard_top(vectors[some], rows[some], shard, shard_rows, k)
                own = np.full(len(query), place[0], np.int32)
                columns = [rows[some][query], ids[some][query], own, shard_ids[candidate], score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "s", "vec_id", "score"])


def best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Merges the top lists of each key: (score, vec_id) ordered by score down, id up."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    top = lists.groupBy(*keys).agg(F.slice(order, 1, k).alias("top"))
    return top.select(*keys, F.posexplode("top").alias("at", "t")).select(*keys, "at", (-F.col("t.minus")).alias("score"), F.col("t.vec_id").alias("vec_id"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k candidates of the highest inner product."""
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), scaled(F.col(vector), scale).alias("ints"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and ints is not null").withColumn("size", F.size("ints"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers are fixed by being written
    held = 8 * (rows.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-held // SHARD_BYTES), min(cores, -(-held // LEAST_BYTES)))
    own = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    sides = rows.select(own.alias("s"), "size", F.lit(0).alias("asks"), "vec_id", "row", "ints").unionByName(
        rows.where("asks").select(every.alias("s"), "size", F.lit(1).alias("asks"), "vec_id", "row", "ints")
    )
    dealt = sides.repartitionById(shards, F.col("s")).sortWithinPartitions("s", "size", "asks", "vec_id")
    lists = dealt.mapInArrow(lambda batches: streamed(batches, k), LISTS)
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = best(lists.withColumn("s", F.floor(F.col("s") / FAN).cast("int")), ["query_row", "query_id", "s"], k)
    return best(lists, ["query_row", "query_id"], k).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "vec_id", "score")


def top_k_digest(embeddings: DataFrame) -> DataFrame:
    return exact_top_k(embeddings, F.col("vec_id") % 50 == 0)
