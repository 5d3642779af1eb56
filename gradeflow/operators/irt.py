"""Two-parameter item response calibration on sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions.scalar import item_level

#: Start of the parameters, Newton steps, responses an item needs.
A0, B0, STEPS, LEAST = 1.0, 0.0, 10, 20
#: Fixed values of the priors: ln a is normal (0, 0.5), b is normal (0, 1); they enter as log densities.
PRIOR_A_SD, PRIOR_B_SD = 0.5, 1.0


def response_counts(responses: DataFrame) -> DataFrame:
    """At most four rows for each item: (question_id, theta, score, n). A user's theta on an item comes from the newest of
    the responses to it: 2 if that was right, -2 if wrong. Users that aren't known share one."""
    newest = W.partitionBy("question_id", "user_id").orderBy(F.desc("created_at"), F.desc("id"))
    seeded = responses.withColumn("theta", (F.first("score").over(newest) - 0.5) * 4.0)
    return seeded.groupBy("question_id", "theta", F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n"))


def score_recalibration(responses: DataFrame, least: int = 5) -> DataFrame:
    """(question_id, n, mean, level) of items with enough responses, by mean score."""
    rows = responses.groupBy("question_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).where(F.col("n") >= least)
    mean = F.round("mean", 9)
    level = F.when(mean < 0.30, "master").when(mean < 0.60, "advanced").when(mean < 0.80, "intermediate").otherwise("beginner")
    return rows.select("question_id", "n", F.round("mean", 6).alias("mean"), level.alias("level"))




def recalibrate(responses: DataFrame) -> DataFrame:
    """(question_id, a, b, level) of items with enough responses: ten Newton steps on the counts, diagonal second derivatives.
    A step that isn't finite keeps the values before it."""
    counts = response_counts(responses)
    cells = counts.groupBy("question_id").agg(F.collect_list(F.struct("theta", "score", "n")).alias("cells"), F.sum("n").alias("total"))
    cells = cells.where(F.col("total") >= LEAST).withColumn("cells", F.sort_array("cells"))
    start = F.struct(F.lit(A0).alias("a"), F.lit(B0).alias("b"))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  # a value that several parts of use name

    def sums(a: Column, b: Column) -> Column:
        """The four sums over an item's cells, in one pass."""
        zero = F.struct(*[F.lit(0.0).alias(n) for n in ("da", "db", "ba", "bb")])

        def add(acc: Column, c: Column) -> Column:
            p = 1 / (1 + F.exp(-a * (c["theta"] - b)))

            def more(p: Column) -> Column:
                d, n = c["theta"] - b, c["n"]
                return F.struct(
                    (acc["da"] + n * (c["score"] - p) * d).alias("da"), (acc["db"] - n * (c["score"] - p) * a).alias("db"),
                    (acc["ba"] - n * p * (1 - p) * d * d).alias("ba"), (acc["bb"] - n * p * (1 - p) * a * a).alias("bb"),
                )

            return once(p, more)

        return F.aggregate("cells", zero, add)

    def newton(acc: Column, _: Column) -> Column:
        a, b = acc["a"], acc["b"]

        def step(s: Column) -> Column:
            new_a = F.when(s["ba"] != 0, a - (s["da"] - F.pow(F.log(a), 2) / (2 * PRIOR_A_SD**2)) / s["ba"]).otherwise(a)
            new_b = F.when(s["bb"] != 0, b - (s["db"] - F.pow(b, 2) / (2 * PRIOR_B_SD**2)) / s["bb"]).otherwise(b)
            return F.struct(F.when(new_a <= 0, F.lit(0.2)).otherwise(new_a).alias("a"), new_b.alias("b"))

        kept = lambda x: F.struct(F.when(finite(x["a"]), x["a"]).otherwise(a).alias("a"), F.when(finite(x["b"]), x["b"]).otherwise(b).alias("b"))
        return once(once(sums(a, b), step), kept)

    found = cells.select("question_id", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, newton).alias("s"))
    b = F.least(F.greatest(F.col("s.b"), F.lit(-3.0)), F.lit(3.0))
    return found.select("question_id", F.col("s.a").alias("a"), b.alias("b")).withColumn("level", item_level(F.col("b")))
