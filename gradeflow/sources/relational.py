"""Reading a relational table in parallel, by ranges of its key of about equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(value: object) -> str:
    """A key's value in SQL: numbers as they are, anything else as a quoted string."""
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def key_bounds(keys: DataFrame, key: str, parts: int) -> list:
    """Up to parts - 1 distinct bounds between ranges of about equal numbers of rows, by quantiles over the counts of each value."""
    counted = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n"))
    kind = keys.schema[key].dataType.simpleString()
    if kind == "string":  # quantiles need numbers: values are numbered in order by ranges of their counts
        from gradeflow.operators.order import running_total

        placed = running_total(counted, [], [F.col(key)], F.col("n"), "before")
        total = counted.agg(F.sum("n")).first()[0] or 0
        cut = placed.withColumn("part", F.floor(F.col("before") * parts / F.lit(max(total, 1))))
        return [r["least"] for r in cut.groupBy("part").agg(F.min(key).alias("least")).orderBy("part").collect()][1:]
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = counted.agg(F.percentile(key, shares, F.col("n")).alias("bounds")).first()["bounds"] if parts > 1 else None
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    return sorted({int(-(-b // 1)) if whole else b for b in found or []})


def range_predicates(key: str, bounds: list, nulls: bool) -> list[str]:
    """SQL conditions of which each row meets exactly one; null keys have a part of their own."""
    edges = [literal(b) for b in bounds]
    if not edges:
        parts = [f"{key} IS NOT NULL"]
    else:
        parts = [f"{key} < {edges[0]}", *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(edges, edges[1:], strict=False)], f"{key} >= {edges[-1]}"]
    return [*parts, f"{key} IS NULL"] if nulls else parts


def read_table(spark: SparkSession, url: str, table: str, key: str, parts: int, second: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC in about ``parts`` partitions, none above about twice the mean however the key is distributed. The database counts
    the rows of each key value, and the bounds come from quantiles of those counts. A value with more than its share of rows,
    null among them, is cut further by ranges of ``second``, a numeric column such as the primary key, where one is given."""
    properties = properties or {}
    ask = lambda sql: spark.read.jdbc(url, f"({sql}) q", properties=properties).toDF(*[c.lower() for c in spark.read.jdbc(url, f"({sql}) q", properties=properties).columns])
    counts = ask(f"SELECT {key} AS k, COUNT(*) AS n FROM {table} GROUP BY {key}").withColumn("n", F.col("n").cast("bigint"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, -(-total // parts))
    heavy = counts.where(F.col("n") > share).collect()  # fewer than ``parts`` values
    rest = counts.where((F.col("n") <= share) & F.col("k").isNotNull())
    held = rest.agg(F.sum("n")).first()[0] or 0
    predicates = range_predicates(key, key_bounds(rest, "k", max(1, -(-held // share))), bool(counts.where(f"k is null and n <= {share}").count()))
    apart = [f"({key} IS NULL OR {key} <> {literal(r['k'])})" for r in heavy if r["k"] is not None]
    predicates = [" AND ".join([f"({p})", *apart]) for p in predicates]
    for r in heavy:
        own = f"{key} IS NULL" if r["k"] is None else f"{key} = {literal(r['k'])}"
        if second is None:
            predicates.append(own)
            continue
        seconds = ask(f"SELECT {second} AS s, COUNT(*) AS n FROM {table} WHERE {own} GROUP BY {second}").withColumn("n", F.col("n").cast("bigint"))
        bounds = key_bounds(seconds, "s", -(-r["n"] // share))
        predicates += [f"{own} AND ({p})" for p in range_predicates(second, bounds, bool(seconds.where("s is null").count()))]
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
