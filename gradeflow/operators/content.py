"""Document chunks: statistics, order, junk, similarity rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def token_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, estimated tokens (characters div 4), their mean, least and most, and large chunks."""
    t = F.floor(F.length("text") / 4)
    rows = chunks.select("document", t.alias("t"))
    return rows.groupBy("document").agg(F.count("*").alias("chunks"), F.sum("t").alias("tokens"), F.round(F.avg("t"), 2).alias("mean"), F.min("t").alias("least"), F.max("t").alias("most"), F.count_if(F.col("t") > 1000).alias("over_1k"), F.count_if(F.col("t") > 2000).alias("over_2k"))


def pages_of(chunks: DataFrame, per_page: int = 4) -> DataFrame:
    """Per (document, page): chunks and first of them."""
    page = F.floor((F.col("order_in_doc") - 1) / per_page)
    return chunks.groupBy("document", page.alias("page")).agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_id"))


def section_chunks(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entry_id, chunk_id): chunks on a section's pages. A section joins by the pages it spans, one row for each."""
    end = F.greatest(F.col("start_page"), F.coalesce(F.nullif("end_page", F.lit(0)), F.col("start_page")))
    wide = sections.select("document", "entry_id", F.explode(F.sequence("start_page", end)).alias("page"))
    return wide.join(chunks.select("document", "page", "chunk_id"), ["document", "page"]).select("entry_id", "chunk_id")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; 0 where one has no length."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = wide(a), wide(b)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


OWNERS, CHUNKS = 512, 4096


def semantic_rank(owners: DataFrame, chunks: DataFrame, least: float = 0.1, k: int = 10) -> DataFrame:
    """(owner_id, rank, chunk_id, cosine): the k nearest chunks of each owner from a least cosine on; owners without any keep a
    row of nulls. owners and chunks: (id, model, vector); an owner is no chunk of its own, and models don't meet. Groups of
    owners and of chunks make tiles, each a matrix product in one task, of which only the k best of each owner leave."""
    import numpy as np
    import pandas as pd

    n, asked = chunks.count(), owners.count()
    groups, shards = max(1, -(-asked // OWNERS)), max(1, -(-n // CHUNKS))
    part = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = owners.where("vector is not null").select("id", "model", "vector", part(groups).alias("g"), every(shards).alias("s"))
    right = chunks.where("vector is not null").select(F.col("id").alias("chunk_id"), F.col("model").alias("chunk_model"), F.col("vector").alias("chunk_vector"), part(shards).alias("s"), every(groups).alias("g"))
    unit = lambda m: m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) > 0, size, 1)

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 3))]
        b = b.sort_values("chunk_id")
        for (model, size), some in a.groupby([a["model"], a["vector"].map(len)]):
            own = b[(b["chunk_model"] == model) & (b["chunk_vector"].map(len) == size)]
            if not len(own):
                continue
            ids, asks = own["chunk_id"].to_numpy(), some["id"].to_numpy()
            scores = unit(np.array(some["vector"].tolist(), float)) @ unit(np.array(own["chunk_vector"].tolist(), float)).T
            scores[asks[:, None] == ids[None, :]] = -2
            top = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
            found = np.stack([np.repeat(asks, top.shape[1]), ids[top].ravel(), np.take_along_axis(scores, top, 1).ravel()], axis=1)
            out.append(found[found[:, 2] >= least])
        flat = np.concatenate(out)
        return pd.DataFrame({"owner_id": flat[:, 0].astype("int64"), "chunk_id": flat[:, 1].astype("int64"), "cosine": flat[:, 2]})

    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInPandas(tile, "owner_id bigint, chunk_id bigint, cosine double")
    place = F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc(F.round("cosine", 9)), "chunk_id"))
    best = found.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= k).select("owner_id", "rank", "chunk_id", F.round("cosine", 5).alias("cosine"))
    return owners.select(F.col("id").alias("owner_id")).join(best, "owner_id", "left")
