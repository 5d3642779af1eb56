"""Keyed state over the answer log: abilities, mastery, awards and the two logged tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeflow.functions.scalar import CODING_GAIN, LEARN, SLIP_GUESS
from gradeflow.operators import catalogue, games

RATE, MOST = 0.1, 3.0


def _arrived(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's new rows, by time and id."""
    return pd.concat(frames).sort_values(["ts", "event_id"])


def theta(events: DataFrame) -> DataFrame:
    """(user_id, theta, n) after each micro-batch: gradient steps in order of arrival, by time inside a batch. This is the
    event-time order, where the batch job goes from the newest answer to the oldest. events: (event_id, user_id, score, a, b, ts)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, n = state.get if state.exists else (0.0, 0)
        rows = _arrived(frames)
        for score, a, b in zip(rows["score"], rows["a"], rows["b"], strict=True):
            t = min(max(t + RATE * a * (score - 1 / (1 + math.exp(-a * (t - b)))), -MOST), MOST)
            n += 1
        state.update((t, n))
        yield pd.DataFrame({"user_id": [key[0]], "theta": [t], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, theta double, n bigint", "theta double, n bigint", "update", GroupStateTimeout.NoTimeout)


def mastery(sessions: DataFrame, cluster: str = "novice") -> DataFrame:
    """(user_id, subtopic_id, mastery, last_practiced_at) after each micro-batch of closed sessions (event_id, user_id,
    subtopic_id, accuracy, is_coding, ts): one observation each, as in the batch fold."""
    slip, guess = SLIP_GUESS[cluster]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, last = state.get if state.exists else (0.0, None)
        rows = _arrived(frames)
        for accuracy, coding, ts in zip(rows["accuracy"], rows["is_coding"], rows["ts"], strict=True):
            right = accuracy >= 0.5
            p = k * (1 - slip) / (k * (1 - slip) + (1 - k) * guess) if right else k * slip / (k * slip + (1 - k) * (1 - guess))
            p = min(max(p, 0.05), 0.95)
            p = p + (1 - p) * LEARN if right else p
            now = int(ts.timestamp())
            weight = 1.0 if last is None else min(1 + 0.05 * ((now - last) // 86400), 2.0)
            k, last = min(max(k + (p - k) * weight * (CODING_GAIN if coding and right else 1.0), 0.0), 1.0), now
        state.update((k, last))
        yield pd.DataFrame({"user_id": [key[0]], "subtopic_id": [key[1]], "mastery": [100 * k], "last_practiced_at": [pd.Timestamp(last, unit="s")]})

    return sessions.groupBy("user_id", "subtopic_id").applyInPandasWithState(
        update, "user_id bigint, subtopic_id bigint, mastery double, last_practiced_at timestamp", "k double, last bigint", "update", GroupStateTimeout.NoTimeout
    )


def response_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: answers (event_id, user_id, question_id, correct, time_taken, ts) to two tables in a folder, responses of
    games and scores. A batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        game = rows.select("event_id", "user_id", "question_id", (F.col("correct") == 1).alias("is_correct"), "time_taken", F.col("ts").alias("answered_at"))
        score = rows.select("event_id", "user_id", "question_id", F.col("correct").cast("double").alias("score"), F.col("time_taken").alias("response_time"), F.col("ts").alias("created_at"))
        game.write.mode("overwrite").parquet(f"{folder}/game_responses/batch={number}")
        score.write.mode("overwrite").parquet(f"{folder}/responses/batch={number}")
        rows.unpersist()

    return write


def award_sink(spark: SparkSession, sessions_path: str, responses_path: str, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of closed sessions (user_id among others): awards of the users it touches, worked out afresh from the
    stored tables, of which those that no earlier batch gave are written. A batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        users = batch.select("user_id").distinct()
        sessions = spark.read.parquet(sessions_path).join(users, "user_id", "left_semi")
        earned = games.achievement_awards(sessions, spark.read.parquet(responses_path))
        try:
            given = spark.read.schema("user_id bigint, code string, batch bigint").parquet(folder).where(F.col("batch") < number)
            earned = earned.join(given.select("user_id", "code"), ["user_id", "code"], "left_anti")
        except Exception as error:  # nothing was given yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        earned.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def progress_sink(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of workers' reports (generation_id, worker_id, at, status, questions, seconds): keeps the reports, and writes
    the progress of the generations that a batch touches, worked out from all their reports so far: a cancelled worker stays
    so, whatever comes later. A batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/reports/batch={number}")
        kept = spark.read.parquet(f"{folder}/reports").where(F.col("batch") <= number)
        touched = kept.where(F.col("batch") == number).select("generation_id").distinct()
        progress = catalogue.generation_progress(kept.drop("batch").join(touched, "generation_id", "left_semi"))
        progress.write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")

    return write
