"""Cleaning of a training corpus in five stages, each of which works on all that the one before has kept.

1. toxicity: the classifier is fitted on labelled rows that are not held out, and documents it scores 0.5 or more go.
2. near_duplicates: of each group of documents that links connect, the one with the smallest id stays. Links join documents
   whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
3. decontamination: documents that hold a benchmark window of ten words go.
4. secrets: each secret in a text is replaced by a mark, and n_chars follows; no document goes.
5. encoding: ids of the byte-level BPE, with their number.

Rows with a null id stay through every stage unless what their text holds removes them; a group of near-duplicates that
no row has an id in keeps all its rows. Rows are told apart by id and text: an id that stands on unrelated texts keeps each
of them that no smaller id repeats, and rows that repeat both are one. Null and wordless texts are one group of near-duplicates.
Texts of any length are read whole; other columns pass through every stage but the last unchanged, whatever their names; an empty
table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm import bpe, decontaminate, secrets, simhash_ring, toxicity
from gradeflow.llm._shared import fresh, stored, table

SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("doc_id")))
    return docs.where(toxicity.toxicity(F.col("text"), model, spark) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(simhash_ring.near_duplicates(docs, shingle=SHINGLE).where("doc_id is not null").distinct(), "groups")
    # of each group one text of the smallest id stays; an id can stand on texts of several groups
    stays = found.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("stays"))
    own = fresh(docs.columns, "hash")
    others = found.join(stays, "root").where(F.struct("doc_id", "hash") != F.col("stays")).select("doc_id", F.col("hash").alias(own))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    kept = hashed.join(others, ["doc_id", own], "left_anti")
    # rows that repeat both id and text of the document that stays: one of them
    repeated = kept.where("doc_id is not null").groupBy("doc_id", own).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", own)
    once = kept.join(repeated, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own])
    return kept.join(repeated, ["doc_id", own], "left_anti").unionByName(once).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    passes = decontaminate.pattern_passes(table(spark, sf_dir, "benchmark"))
    return docs.where(F.size(decontaminate.contamination(F.col("text"), passes).getField("hit_runs")) == 0)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = fresh(docs.columns, "secret_spans")
    masked = secrets.redacted(secrets.with_secret_spans(docs, output=spans), spans=spans)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encoded(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Training, near-duplicates by sampled segments and byte-level BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
