"""Grading of answers, first tests, and the history of proficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions.scalar import bkt_posterior, clamp, cluster_parameter, cluster_start, first_test_gain, sanitize_word

GRID_GAMES = ("crossword", "wordsearch")


def session_answers(sessions: DataFrame, responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Each answer with its session and question: the base of the other jobs."""
    about = questions.select("question_id", "difficulty", F.col("game_type").alias("question_game"))
    head = sessions.select("session_id", "status", "game_type", "start_time")
    return responses.join(head, "session_id").join(about, "question_id")


def grid_eligible(placements: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, item_id): the first question of a session for each word placed in its grid. Words count by their letters.
    placements: (session_id, word); items: (session_id, item_id, correct_answer)."""
    word = sanitize_word(F.coalesce("correct_answer", F.lit("")))
    first = items.select("session_id", "item_id", word.alias("w")).where("w <> ''").groupBy("session_id", "w").agg(F.min("item_id").alias("item_id"))
    placed = placements.select("session_id", sanitize_word(F.coalesce("word", F.lit(""))).alias("w")).distinct()
    return placed.join(first, ["session_id", "w"]).select("session_id", "item_id").distinct()


def grade_answers(items: DataFrame, submitted: DataFrame) -> DataFrame:
    """Items (session_id, item_id, game_type, correct_answer) with the answer submitted (session_id, item_id, user_answer,
    time_taken) and whether it is right. Grid games compare letters alone, other games trimmed text in either case; what wasn't
    answered is empty, wrong and took no time."""
    given = submitted.select("session_id", "item_id", "user_answer", "time_taken", F.lit(True).alias("_given"))
    rows = items.join(given, ["session_id", "item_id"], "left")
    text = F.coalesce("user_answer", F.lit(""))
    want = F.coalesce("correct_answer", F.lit(""))
    same = F.when(F.col("game_type").isin(*GRID_GAMES), sanitize_word(text) == sanitize_word(want)).otherwise(F.lower(F.trim(text)) == F.lower(F.trim(want)))
    return rows.select(
        "session_id", "item_id", F.coalesce("game_type", F.lit("")).alias("game_type"), text.alias("user_answer"),
        F.when(F.col("_given"), same).otherwise(F.lit(False)).alias("is_correct"), F.coalesce("time_taken", F.lit(0)).cast("int").alias("time_taken"),
    )


def response_events(graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two rows that each answer is logged as: the game's response, and a score of 1 or 0 for analytics."""
    game = graded.select("session_id", "item_id", "user_answer", "is_correct", "time_taken")
    return game, graded.select("session_id", "item_id", F.when(F.col("is_correct"), 1.0).otherwise(0.0).alias("score"), F.col("time_taken").alias("response_time"))


def first_test_stats(results: DataFrame) -> DataFrame:
    """Per (user, subtopic): answers, right ones, and the difficulty that counts: the last advanced or master one seen, else
    intermediate if any, else beginner. results: (user_id, subtopic_ids, correct, difficulty, place), in order of place."""
    rows = results.select("user_id", "correct", "difficulty", "place", F.explode("subtopic_ids").alias("subtopic_id"))
    hard = F.col("difficulty").isin("advanced", "master")
    out = rows.groupBy("user_id", "subtopic_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("correct") == 1).alias("right"),
        F.max_by(F.when(hard, F.col("difficulty")), F.when(hard, F.col("place"))).alias("hard"), F.coalesce(F.bool_or(F.col("difficulty") == "intermediate"), F.lit(False)).alias("middle"),
    )
    level = F.coalesce(F.col("hard"), F.when(F.col("middle"), "intermediate").otherwise("beginner"))
    return out.select("user_id", "subtopic_id", "total", "right", level.alias("difficulty"))


def first_mastery(stats: DataFrame, users: DataFrame, subtopics: DataFrame) -> DataFrame:
    """(user_id, subtopic_id, mastery 0..100 to six digits) for every user of ``users`` (user_id, learner_cluster) and subtopic: what the
    first test shows, moved by its difficulty, else the start of the user's cluster. What the test showed is as long as ``stats``; the
    rest is every user's whole catalogue but for that, which is unfolded in the tasks that write it and never shuffled."""
    users = users.select("user_id", F.col("learner_cluster").cast("int").alias("c"))
    subtopics = subtopics.select("subtopic_id")
    start = cluster_start(F.col("c"))
    right = (F.col("right") / F.col("total") >= 0.5).cast("int")
    after = bkt_posterior(start, right, cluster_parameter(F.col("c"), 0), cluster_parameter(F.col("c"), 1))
    moved = clamp(start + (after - start) * first_test_gain(F.col("difficulty")), 0.05, 0.95)
    shown = stats.where("total > 0").join(users, "user_id").join(subtopics, "subtopic_id").select("user_id", "subtopic_id", F.round(moved * 100, 6).alias("mastery"))
    tested = stats.where("total > 0").groupBy("user_id").agg(F.collect_set("subtopic_id").alias("tested"))
    ids = subtopics.agg(F.sort_array(F.collect_list(F.struct("subtopic_id")))["subtopic_id"].alias("ids"))  # one row
    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = users.join(tested, "user_id", "left").select("user_id", F.round(start * 100, 6).alias("mastery"), F.coalesce("tested", F.array().cast("array<bigint>")).alias("tested"))
    rows = rows.repartition(tasks, "user_id").crossJoin(F.broadcast(ids))  # users are few before they unfold, so their bytes say nothing of the work
    rest = rows.select("user_id", F.explode(F.array_except("ids", "tested")).alias("subtopic_id"), "mastery")
    return rest.unionByName(shown)


def proficiency_history(snapshots: DataFrame, least: float = 0.01) -> DataFrame:
    """Snapshots (user_id, topic_id, at, percent) that differ from the one before, or from 0 at first, by more than ``least``."""
    before = F.lag("percent", 1, 0.0).over(W.partitionBy("user_id", "topic_id").orderBy("at"))
    rows = snapshots.withColumn("before", F.coalesce(before, F.lit(0.0)))
    return rows.where(F.abs(F.col("percent") - F.col("before")) > least).select("user_id", "topic_id", "at", "percent")


def history_bootstrap(history: DataFrame, current: DataFrame) -> DataFrame:
    """The history, and for users without any one row of each of their current proficiencies."""
    fresh = current.join(history.select("user_id").distinct(), "user_id", "left_anti")
    return history.unionByName(fresh.select(*history.columns))
