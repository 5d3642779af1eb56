"""Nested session exports and attempt logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSIONS = (
    "id BIGINT, session_id STRING, user_id BIGINT, username STRING, game_type STRING, status STRING, start_time STRING, end_time STRING, total_score INT, time_limit INT, "
    "game_questions ARRAY<STRUCT<gamequestion_id BIGINT, generated_question STRUCT<generated_question_id BIGINT, question_text STRING, correct_answer STRING, estimated_difficulty STRING, game_type STRING>, "
    "responses ARRAY<STRUCT<response_id BIGINT, user_id BIGINT, username STRING, user_answer STRING, is_correct BOOLEAN, time_taken INT, answered_at STRING>>>>"
)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session exports: files that each hold one JSON array."""
    return spark.read.schema(SESSIONS).json(path, multiLine=True)


def flatten_sessions(sessions: DataFrame) -> DataFrame:
    """One row for each response. A question without responses keeps one row; a session without questions has none."""
    rows = sessions.withColumn("q", F.explode("game_questions")).withColumn("r", F.explode_outer("q.responses"))
    g = "q.generated_question"
    return rows.select(
        F.col("id").alias("session_pk"), "session_id", "user_id", "username", F.col("game_type").alias("session_game_type"), F.col("status").alias("session_status"), "start_time", "end_time", "total_score", "time_limit",
        "q.gamequestion_id", f"{g}.generated_question_id", f"{g}.question_text", f"{g}.correct_answer", f"{g}.estimated_difficulty", F.col(f"{g}.game_type").alias("question_game_type"),
        "r.response_id", F.col("r.user_id").alias("response_user_id"), F.col("r.username").alias("response_username"), "r.user_answer", "r.is_correct", "r.time_taken", "r.answered_at",
    )


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log of tutoring attempts as (student, skill, correct, ts). Rows without a skill stay; models leave them out."""
    raw = spark.read.csv(path, header=True)
    return raw.select(
        F.col("user_id").cast("bigint").alias("student"), F.col("skill_id").alias("skill"), F.col("correct").try_cast("int").alias("correct"), F.col("start_time").try_cast("timestamp").alias("ts")
    )
