"""Mastery, ability and their roll-ups, for every learner at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions.scalar import CODING_GAIN, LEARN, bkt_posterior, clamp, cluster_parameter, effective_correctness, normalize_difficulty, recency_weight, time_weight
from gradeflow.operators.fold import ordered_fold


def session_accuracy(responses: DataFrame) -> DataFrame:
    """Attempts, correct answers and accuracy of each session; 0 without attempts."""
    rows = responses.groupBy("user_id", "session_id").agg(F.count("correct").alias("attempts"), F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("right"), F.max("created_at").alias("ended_at"))
    return rows.withColumn("accuracy", F.when(F.col("attempts") > 0, F.col("right") / F.col("attempts")).otherwise(F.lit(0.0)))


def with_effective(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with what each is worth (by difficulty, time and game of its question), and whether it is about code."""
    about = questions.select("question_id", "difficulty", (F.col("game_type") == "coding").alias("is_coding"), F.col("game_type").alias("_game"))
    rows = responses.join(about, "question_id", "left")
    worth = effective_correctness(F.col("correct"), normalize_difficulty(F.col("difficulty")), time_weight(F.col("time_taken"), F.coalesce("_game", F.lit(""))), F.lit(1.0))
    return rows.withColumn("worth", worth).withColumn("is_coding", F.coalesce("is_coding", F.lit(False))).drop("_game", "difficulty")


def subtopic_accuracy(responses: DataFrame) -> DataFrame:
    """Attempts and mean effective correctness of each (session, subtopic), and whether any of it is about code."""
    rows = responses.where("correct is not null").groupBy("user_id", "session_id", "subtopic_id")
    return rows.agg(F.count("*").alias("attempts"), F.round(F.avg("worth"), 9).alias("accuracy"), F.max("created_at").alias("ended_at"), F.max("is_coding").alias("is_coding"))


def mastery_update(sessions: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(user_id, subtopic_id, mastery 0..100): sessions folded in order of their end. A session counts as one observation,
    right from an accuracy of one half; its change grows with the days since the one before and, if it is right and about
    code, by half, and a right one also learns. clusters: (user_id, learner_cluster); users without one are novices."""
    sessions = sessions.withColumn("ended_at", F.col("ended_at").cast("timestamp"))
    if clusters is None:
        sessions = sessions.withColumn("learner_cluster", F.lit(None).cast("int"))
    else:
        sessions = sessions.join(clusters.select("user_id", F.col("learner_cluster").cast("int").alias("learner_cluster")), "user_id", "left")
    start = F.struct(F.lit(0.0).alias("k"), F.lit(None).cast("timestamp").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        right = x["accuracy"] >= 0.5
        after = bkt_posterior(acc["k"], right.cast("int"), cluster_parameter(x["learner_cluster"], 0), cluster_parameter(x["learner_cluster"], 1))
        after = F.when(right, after + (1 - after) * LEARN).otherwise(after)
        gain = (after - acc["k"]) * recency_weight(acc["last"], x["ended_at"]) * F.when(right & x["is_coding"], F.lit(CODING_GAIN)).otherwise(F.lit(1.0))
        return F.struct(clamp(acc["k"] + gain, 0.0, 1.0).alias("k"), x["ended_at"].alias("last"))

    folded = ordered_fold(sessions, ["user_id", "subtopic_id"], ["ended_at", "session_id"], ["accuracy", "is_coding", "learner_cluster"], start, step, "state")
    return folded.select("user_id", "subtopic_id", (F.col("state.k") * 100).alias("mastery"), F.col("state.last").alias("last_practiced_at"))


def ability_update(sessions: DataFrame) -> DataFrame:
    """(user_id, ability): 0.8 of the old plus 0.2 of each session's accuracy, from 0.5, within 0.01 and 0.99."""
    step = lambda acc, x: clamp(acc * 0.8 + x["accuracy"] * 0.2, 0.01, 0.99)
    return ordered_fold(sessions, ["user_id"], ["ended_at", "session_id"], ["accuracy"], F.lit(0.5), step, "ability")


def theta_update(responses: DataFrame, items: DataFrame | None = None, rate: float = 0.1, least: int = 5) -> DataFrame:
    """(user_id, theta) of users with enough responses: gradient steps from the newest response to the oldest."""
    rows = responses.where("user_id is not null").select("user_id", "created_at", "id", "question_id", F.col("score").cast("double").alias("score"))
    if items is not None:
        rows = rows.join(items, "question_id", "left")
    else:
        rows = rows.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(0.0))
    rows = rows.withColumn("a", F.coalesce("a", F.lit(1.0))).withColumn("b", F.coalesce("b", F.lit(0.0)))

    def step(acc: Column, x: Column) -> Column:
        p = 1 / (1 + F.exp(-x["a"] * (acc - x["b"])))
        return clamp(acc + rate * x["a"] * (x["score"] - p), -3.0, 3.0)

    enough = rows.groupBy("user_id").count().where(F.col("count") >= least).select("user_id")
    rows = rows.join(enough, "user_id", "left_semi")
    return ordered_fold(rows, ["user_id"], ["created_at", "id"], ["score", "a", "b"], F.lit(0.0), step, "theta", reverse=True)


def proficiency(mastery: DataFrame, subtopics: DataFrame) -> DataFrame:
    """(user_id, topic_id, percent): mean of the mastery rows there are."""
    return mastery.join(subtopics.select("subtopic_id", "topic_id"), "subtopic_id").groupBy("user_id", "topic_id").agg(F.avg("mastery").alias("percent"))


def zone_completion(topic_rows: DataFrame, topics: DataFrame, zones: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, zone_id, zone_order, completion) for every user and zone: mean of the topic rows there are, else 0."""
    have = topic_rows.join(topics.select("topic_id", "zone_id"), "topic_id").groupBy("user_id", "zone_id").agg(F.avg("percent").alias("completion"))
    every = users.select("user_id").crossJoin(F.broadcast(zones.select("zone_id", "zone_order")))  # zones: a fixed, small dimension
    return every.join(have, ["user_id", "zone_id"], "left").withColumn("completion", F.coalesce("completion", F.lit(0.0)))


def completion_leaderboard(zone_rows: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, username, overall, zones as text) of learners: mean of the rounded zone completions, best first."""
    rows = zone_rows.join(users.where("role = 'learner'"), "user_id").withColumn("c", F.floor(F.round("completion", 6) * 100 + 0.5) / 100)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("zone_order", "c"))), lambda z: z["c"])
    board = rows.groupBy("user_id", "username").agg((F.floor(F.round(F.avg("c"), 6) * 100 + 0.5) / 100).alias("overall"), F.array_join(F.transform(parts, lambda x: F.format_string("%.2f", x)), ",").alias("zones"))
    return board.orderBy(F.desc("overall"), "username", "user_id")


def current_zone(zone_rows: DataFrame) -> DataFrame:
    """Each user's zone in progress: the first under 100, else the last; later ones are locked."""
    user = W.partitionBy("user_id")
    open_ = F.min(F.when(F.round("completion", 9) < 100, F.col("zone_order"))).over(user)
    now = F.coalesce(open_, F.max("zone_order").over(user))
    return zone_rows.select("user_id", "zone_id", F.round("completion", 6).alias("completion"), (F.col("zone_order") == now).alias("is_current"), (F.col("zone_order") > now).alias("locked"))
