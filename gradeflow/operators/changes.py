"""Upserts, insertions and differences of keyed tables; Parquet has no MERGE, so each gives the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, the new row's values (nulls too) stand."""
    values = [c for c in old.columns if c not in keys]
    right = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in values])
    joined = old.join(right, keys, "full_outer")
    return joined.select(*keys, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows, and the new ones whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind): rows that are new or differ in one of the columns."""
    right = before.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = after.join(right, key, "left")
    return rows.select(key, F.when(F.col("_old").isNull(), "new").when(differs, "changed").alias("kind")).where("kind is not null")
