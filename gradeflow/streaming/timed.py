"""Keyed state with event-time timers: sessions that close, and abilities and mastery in the order of time.

Rows wait in state until the watermark has passed them and are then taken in the order of (ts, event_id), so a stream gives what
the batch job gives for the same rows, in whatever order they arrive inside the watermark; rows behind it are dropped. State is
kept by the RocksDB store (``use_timers``), which transformWithState needs, and survives a restart from the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeflow.functions.scalar import CODING_GAIN, LEARN, cluster_parameter

RATE, MOST = 0.1, 3.0
#: A session's time limit, and how long its end is remembered, so that answers after it open no new session.
LIMIT_MS, KEPT_MS = 300_000, 86_400_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def milliseconds(ts: pd.Series) -> list[int]:
    return [int(x) for x in pd.to_datetime(ts).astype("datetime64[ms]").astype("int64")]


class Waiting(StatefulProcessor):
    """Buffers rows (ms, event_id, *fields) and hands those that the watermark has passed to ``taken``, in order. Subclasses name the
    columns they need and keep what they have learned in ``memory``."""

    fields: tuple[str, ...] = ()
    kinds: tuple[type, ...] = ()  # pandas hands columns with nulls over as floats
    field_types = ""
    memory_types = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"ms bigint, event_id bigint, {self.field_types}")
        self.memory = handle.getValueState("memory", self.memory_types)

    def keep(self, rows: Iterator[pd.DataFrame]) -> None:
        for frame in rows:
            columns = [[None if pd.isna(x) else kind(x) for x in frame[c]] for c, kind in zip(self.fields, self.kinds, strict=True)]
            self.rows.appendList([*zip(milliseconds(frame["ts"]), frame["event_id"].tolist(), *columns, strict=True)])

    def wake_at(self, ms: int) -> None:
        """One timer a key: at this time."""
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer > ms:  # earlier ones fire first and look again
                self.handle.deleteTimer(timer)
        if ms not in timers:
            self.handle.registerTimer(ms)

    def passed(self, watermark: int) -> list[tuple]:
        """Takes the rows before the watermark out of the buffer; the earliest of the others is waited for."""
        held = sorted(self.rows.get())
        ready = [r for r in held if r[0] < watermark]
        left = held[len(ready) :]
        self.rows.clear()
        if left:
            self.rows.put(left)
            self.wake_at(left[0][0] + 1)
        return ready

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.keep(rows)
        first = min(r[0] for r in self.rows.get())
        self.wake_at(max(first + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ready = self.passed(max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        yield self.taken(key, ready) if ready else pd.DataFrame()

    def taken(self, key: tuple, ready: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Theta(Waiting):
    fields, kinds = ("score", "a", "b"), (float, float, float)
    field_types, memory_types = "score double, a double, b double", "theta double, n bigint"

    def taken(self, key: tuple, ready: list[tuple]) -> pd.DataFrame:
        t, n = self.memory.get() if self.memory.exists() else (0.0, 0)
        for _, _, score, a, b in ready:
            t = min(max(t + RATE * a * (score - 1 / (1 + math.exp(-a * (t - b)))), -MOST), MOST)
            n += 1
        self.memory.update((t, n))
        return pd.DataFrame({"user_id": [key[0]], "theta": [t], "n": [n]})


class Mastery(Waiting):
    fields, kinds = ("accuracy", "is_coding", "slip", "guess"), (float, bool, float, float)
    field_types, memory_types = "accuracy double, is_coding boolean, slip double, guess double", "known double, last bigint"

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        row = initialState.iloc[0]
        self.memory.update((float(row["mastery"]) / 100, milliseconds(initialState["last_practiced_at"])[0]))

    def taken(self, key: tuple, ready: list[tuple]) -> pd.DataFrame:
        k, last = self.memory.get() if self.memory.exists() else (0.0, None)
        for ms, _, accuracy, coding, slip, guess in ready:
            right = accuracy >= 0.5
            p = k * (1 - slip) / (k * (1 - slip) + (1 - k) * guess) if right else k * slip / (k * slip + (1 - k) * (1 - guess))
            p = min(max(p, 0.05), 0.95)
            p = p + (1 - p) * LEARN if right else p
            weight = 1.0 if last is None else min(1 + 0.05 * ((ms - last) // 86_400_000), 2.0)
            k, last = min(max(k + (p - k) * weight * (CODING_GAIN if coding and right else 1.0), 0.0), 1.0), ms
        self.memory.update((k, last))
        return pd.DataFrame({"user_id": [key[0]], "subtopic_id": [key[1]], "mastery": [100 * k], "last_practiced_at": [pd.Timestamp(last, unit="ms")]})


class Sessions(Waiting):
    """Closes a session at its first completion, or at the limit after its first row; memory holds when it was closed."""

    fields, kinds = ("correct", "completes"), (int, bool)
    field_types, memory_types = "correct int, completes boolean", "closed bigint"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.memory.exists():  # rows of a closed session are late to it
            self.keep(rows)
            held = list(self.rows.get())
            self.wake_at(max(session_end(held)[0] + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.memory.exists():
            self.memory.clear()
            yield pd.DataFrame()
            return
        held = list(self.rows.get())
        end, completed = session_end(held)
        inside = [r for r in held if r[0] <= end]
        self.rows.clear()
        self.memory.update((end,))
        self.wake_at(max(end + KEPT_MS, timerValues.getCurrentWatermarkInMs() + 1))
        answers = [r[2] for r in inside if r[2] is not None]
        start = min(r[0] for r in inside)
        yield pd.DataFrame({
            "session_id": [key[0]], "started": [pd.Timestamp(start, unit="ms")], "ended": [pd.Timestamp(end, unit="ms")], "status": ["completed" if completed else "expired"],
            "attempts": [len(answers)], "right": [int(sum(answers))],
        })


def session_end(rows: list[tuple]) -> tuple[int, bool]:
    """(when the session ends, whether by completion) of rows (ms, event_id, correct, completes)."""
    limit = min(r[0] for r in rows) + LIMIT_MS
    done = [r[0] for r in rows if r[3] and r[0] <= limit]
    return (min(done), True) if done else (limit, False)


def theta_by_time(answers: DataFrame, delay: str = "1 day") -> DataFrame:
    """(user_id, theta, n) whenever the watermark has passed more of a user's answers: gradient steps in the order of time.
    answers: a stream (event_id, user_id, score, a, b, ts)."""
    rows = answers.select("event_id", "user_id", *[F.col(c).cast("double").alias(c) for c in Theta.fields], "ts").withWatermark("ts", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(Theta(), "user_id bigint, theta double, n bigint", "Append", "EventTime")


def mastery_by_time(sessions: DataFrame, users: DataFrame, known: DataFrame | None = None, delay: str = "1 day") -> DataFrame:
    """(user_id, subtopic_id, mastery, last_practiced_at) whenever the watermark has passed more of a user's sessions on a subtopic, each with
    the slip and guess of the user's own cluster. sessions: a stream (event_id, user_id, subtopic_id, accuracy, is_coding, ts);
    users: (user_id, learner_cluster), joined as a table; known: (user_id, subtopic_id, mastery, last_practiced_at), what the state
    begins with."""
    slip, guess = (cluster_parameter(F.col("learner_cluster"), k) for k in (0, 1))
    rows = sessions.withWatermark("ts", delay).join(users.select("user_id", "learner_cluster"), "user_id", "left")
    rows = rows.select("event_id", "user_id", "subtopic_id", F.col("accuracy").cast("double").alias("accuracy"), F.coalesce("is_coding", F.lit(False)).alias("is_coding"), slip.alias("slip"), guess.alias("guess"), "ts")
    keys = ["user_id", "subtopic_id"]
    first = known.select(*keys, "mastery", "last_practiced_at").groupBy(*keys) if known is not None else None
    return rows.groupBy(*keys).transformWithStateInPandas(Mastery(), "user_id bigint, subtopic_id bigint, mastery double, last_practiced_at timestamp", "Append", "EventTime", first)


def closed_sessions(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(session_id, started, ended, status, attempts, right) of each session once the watermark has passed its end: its first completion, or
    300 s after its first row. events: a stream (event_id, session_id, correct, completes, ts), correct null where a row is no answer.
    Rows after the end count nowhere; the end is remembered for a day after it."""
    rows = events.select("event_id", F.col("session_id").cast("string").alias("session_id"), F.col("correct").cast("int").alias("correct"), F.coalesce("completes", F.lit(False)).alias("completes"), "ts").withWatermark("ts", delay)
    out = "session_id string, started timestamp, ended timestamp, status string, attempts bigint, right bigint"
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(), out, "Append", "EventTime")


def closed_sessions_batch(events: DataFrame) -> DataFrame:
    """The same of a table of all events."""
    limit = F.col("started") + F.expr(f"INTERVAL {LIMIT_MS // 1000} SECONDS")
    first = events.groupBy("session_id").agg(F.min("ts").alias("started"))
    rows = events.join(first, "session_id").withColumn("limit", limit).where("ts <= limit")
    done = F.min(F.when(F.coalesce("completes", F.lit(False)), F.col("ts")))
    ends = rows.groupBy("session_id").agg(done.alias("done"))
    rows = rows.join(ends, "session_id").withColumn("ended", F.coalesce("done", "limit")).where("ts <= ended")
    out = rows.groupBy("session_id", "started", "ended", F.when(F.col("done").isNull(), "expired").otherwise("completed").alias("status"))
    return out.agg(F.count("correct").alias("attempts"), F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("right"))
