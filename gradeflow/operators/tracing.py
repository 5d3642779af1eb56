"""Knowledge tracing models on held-out attempts, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions.scalar import clamp
from gradeflow.operators.order import running_total

#: Of the interactive model (weights of knowledge, ability and observation) and of the standard model.
KEEP, ABLE, PRIOR_SHARE, OBSERVED = 0.7, 0.3, 0.55, 0.45
START, SLIP, GUESS, LEARN = 0.2, 0.1, 0.2, 0.15
TINY = 1e-12


def leave_last_out(attempts: DataFrame, least: int = 4) -> DataFrame:
    """Attempts of (student, skill) pairs with at least ``least``, numbered; the last of each is for testing."""
    pair = W.partitionBy("student", "skill")
    rows = attempts.where("student is not null and skill is not null").withColumn("n", F.count("*").over(pair))
    rows = rows.withColumn("attempt", F.row_number().over(pair.orderBy("ts", "event_id"))).where(F.col("n") >= least)
    return rows.select("student", "skill", "event_id", "ts", "correct", "attempt", "n", (F.col("attempt") == F.col("n")).alias("is_test"))


def standard_bkt(split: DataFrame) -> DataFrame:
    """(student, skill, y, p): the standard model's probability that the held-out attempt is right."""

    def step(acc: Column, x: Column) -> Column:
        right = acc * (1 - SLIP) / (acc * (1 - SLIP) + (1 - acc) * GUESS + TINY)
        wrong = acc * SLIP / (acc * SLIP + (1 - acc) * (1 - GUESS) + TINY)
        after = F.when(x["correct"] == 1, right).otherwise(wrong)
        return after + (1 - after) * LEARN

    seen = F.sort_array(F.collect_list(F.when(~F.col("is_test"), F.struct("attempt", "correct"))))
    rows = split.groupBy("student", "skill").agg(F.aggregate(seen, F.lit(START), step).alias("known"), F.max(F.when(F.col("is_test"), F.col("correct"))).alias("y"))
    return rows.select("student", "skill", "y", (F.col("known") * (1 - SLIP) + (1 - F.col("known")) * GUESS).alias("p"))


def interactive_bkt(split: DataFrame) -> DataFrame:
    """(student, skill, y, p): knowledge blended with the student's ability. Skills run in order of their id as sessions;
    the ability before each comes from a fold over the student's skills, knowledge within one from a closed form."""
    ratio = PRIOR_SHARE * KEEP
    train = split.where("not is_test")
    last = W.partitionBy("student", "skill")
    rows = train.withColumn("m", F.max("attempt").over(last))
    skills = rows.groupBy("student", "skill").agg(
        F.sum(F.pow(F.lit(ratio), F.col("m") - F.col("attempt")) * F.col("correct")).alias("recent"), F.max("m").alias("m"), F.avg("correct").alias("accuracy")
    )

    def step(acc: Column, x: Column) -> Column:
        before = acc["ability"]
        out = F.struct(x["skill"].alias("skill"), before.alias("before"))
        return F.struct(clamp(before * 0.8 + x["accuracy"] * 0.2, 0.05, 0.95).alias("ability"), F.concat(acc["seen"], F.array(out)).alias("seen"))

    start = F.struct(F.lit(0.5).alias("ability"), F.array().cast("array<struct<skill:string,before:double>>").alias("seen"))
    folded = skills.groupBy("student").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("skill", "accuracy"))), start, step).alias("f"))
    before = folded.select("student", F.col("f.ability").alias("final"), F.explode("f.seen").alias("s")).select("student", "final", "s.*")
    known = F.lit(PRIOR_SHARE * ABLE) * F.col("before") * (1 - F.pow(F.lit(ratio), F.col("m"))) / (1 - ratio) + F.lit(OBSERVED) * F.col("recent")
    tested = split.where("is_test").select("student", "skill", F.col("correct").alias("y"))
    return skills.join(before, ["student", "skill"]).join(tested, ["student", "skill"]).select("student", "skill", "y", (F.lit(KEEP) * known + F.lit(ABLE) * F.col("final")).alias("p"))


def kt_metrics(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of ``by``: mean absolute error, correlation, log loss and ROC AUC. The AUC ranks distinct scores;
    those nearer than 1e-12 are ties, so that rounding in the last place doesn't break them; ranks come from totals over ranges of scores."""
    p = clamp(F.col("p"), TINY, 1 - TINY)
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    basic = scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.corr("y", "p").alias("r"), F.avg(loss).alias("log_loss"))
    level = scored.groupBy(*by, F.round("p", 12).alias("p")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = running_total(level, [*by], [F.col("p")], F.col("neg"), "below")
    pairs = below.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2)).groupBy(*by).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    both = basic.join(pairs, [*by]) if by else basic.crossJoin(pairs)  # one row
    return both.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("mae", "r", "log_loss", "auc")])


def calibration_bins(scored: DataFrame) -> DataFrame:
    """Ten equal bins of p with the means of p and y; p of exactly 1 falls outside."""
    rows = scored.withColumn("bin", F.floor(F.round(F.col("p") * 10, 9)).cast("int")).where("bin between 0 and 9")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("mean_y"))
