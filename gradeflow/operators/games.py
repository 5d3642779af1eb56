"""Sessions, attempts, leaderboards and achievements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.operators.order import running_total


def game_leaderboard(sessions: DataFrame, responses: DataFrame) -> DataFrame:
    """Each user's best completed session of each game, with its rank: score down, time up. Games are few, so ranks are totals over
    ranges of the distinct results of a game, which a game's sessions are spread over."""
    scores = responses.groupBy("session_id").agg(F.sum("correct").alias("score"))
    rows = sessions.where("status = 'completed' and game_type is not null").join(scores, "session_id", "left")
    rows = rows.withColumn("score", F.coalesce("score", F.lit(0)).cast("bigint")).withColumn("elapsed", F.coalesce("elapsed", F.lit(0)).cast("bigint"))
    best = W.partitionBy("game_type", "user_id").orderBy(F.desc("score"), "elapsed", "session_id")
    first = rows.withColumn("k", F.row_number().over(best)).where("k = 1")
    same = ["game_type", "score", "elapsed"]
    better = running_total(first.groupBy(*same).agg(F.count("*").alias("n")), ["game_type"], [F.desc("score"), F.col("elapsed")], F.col("n"), "better")
    return first.join(better, same).select("game_type", "user_id", "session_id", "score", "elapsed", (F.col("better") + 1).alias("place"))


def attempt_lives(responses: DataFrame, lives: int = 3) -> DataFrame:
    """Attempt number and lives left of each answer to a question in a session, in order of time."""
    w = W.partitionBy("session_id", "question_id", "user_id").orderBy("created_at", "line", "subtopic_id")
    wrong = F.sum(1 - F.col("correct")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = responses.withColumn("wrong", wrong)
    left = F.greatest(F.lit(lives) - F.col("wrong"), F.lit(0))
    return rows.select("session_id", "question_id", "line", "subtopic_id", "created_at", (F.col("wrong") - (1 - F.col("correct")) + 1).cast("bigint").alias("attempt"), left.cast("bigint").alias("lives"), (left == 0).alias("game_over"))


def achievement_progress(sessions: DataFrame, responses: DataFrame) -> DataFrame:
    """Completed, perfect and fast perfect sessions of each user, with what they unlock."""
    perfect = responses.groupBy("session_id").agg(F.min("correct").alias("all_right"))
    rows = sessions.where("status = 'completed'").join(perfect, "session_id", "left")
    ok = F.coalesce(F.col("all_right") == 1, F.lit(False))
    fast = ok & (F.col("elapsed") <= 60) & F.coalesce(F.col("game_type") != "debugging", F.lit(True))
    out = rows.groupBy("user_id").agg(F.count("*").alias("completed"), F.count_if(ok).alias("perfect"), F.count_if(fast).alias("fast"))
    return out.select("user_id", F.least("completed", F.lit(20)).cast("bigint").alias("enthusiast"), F.least("perfect", F.lit(5)).cast("bigint").alias("perfection"), F.least("fast", F.lit(1)).cast("bigint").alias("speed"), (F.col("completed") >= 20).alias("has_enthusiast"), (F.col("perfect") >= 5).alias("has_perfection"), (F.col("fast") >= 1).alias("has_speed"))


def achievement_awards(sessions: DataFrame, responses: DataFrame, zones: DataFrame | None = None, awarded: DataFrame | None = None) -> DataFrame:
    """(user_id, code) newly earned; first steps and fast sessions count in crosswords and word searches only. zones: (user_id,
    zone_order, completion), of which a complete one earns that zone's award."""
    perfect = responses.groupBy("session_id").agg(F.min("correct").alias("all_right"))
    rows = sessions.where("status = 'completed'").join(perfect, "session_id", "left")
    ok = F.coalesce(F.col("all_right") == 1, F.lit(False))
    concept = F.coalesce(F.col("game_type").isin("crossword", "wordsearch"), F.lit(False))
    out = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("p"), F.count_if(ok & (F.col("elapsed") <= 60) & concept).alias("f"), F.count_if(concept).alias("c"))
    codes = F.array(F.when(F.col("c") >= 1, "first_steps"), F.when(F.col("n") >= 20, "game_enthusiast"), F.when(F.col("p") >= 5, "perfection_seeker"), F.when(F.col("f") >= 1, "speed_solver"))
    earned = out.select("user_id", F.explode(codes).alias("code")).where("code is not null")
    if zones is not None:
        earned = earned.unionByName(zones.where(F.round("completion", 9) >= 100).select("user_id", F.concat(F.lit("zone_"), F.col("zone_order").cast("string")).alias("code")))
    return earned if awarded is None else earned.join(awarded, ["user_id", "code"], "left_anti")


def learner_features(responses: DataFrame, least: int = 3) -> DataFrame:
    """Mean time, accuracy and number of answers of users with enough of them."""
    rows = responses.groupBy("user_id").agg(F.round(F.avg("time_taken"), 6).alias("avg_time"), F.round(F.avg("correct"), 6).alias("accuracy"), F.count("*").alias("answers"))
    return rows.where(F.col("answers") >= least)


def latest_responses(responses: DataFrame) -> DataFrame:
    """The newest answer of each user to each question."""
    w = W.partitionBy("user_id", "question_id").orderBy(F.desc("created_at"), F.desc("session_id"), F.desc("line"), F.desc("subtopic_id"), F.desc("correct"))
    return responses.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "question_id", "session_id", "line", "created_at", "correct")


def stream_activity_batch(attempts: DataFrame) -> DataFrame:
    """Answers and accuracy a day and skill."""
    day = F.to_date("ts").cast("string")
    return attempts.groupBy(day.alias("day"), "skill").agg(F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"))
