"""Streams with timers against their batch forms: rows out of order, a row behind the watermark, a restart from the checkpoint."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import mastery
from gradeflow.streaming import timed

START = datetime(2024, 1, 1)
END = START + timedelta(days=30)


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, folder, files, schema, job, late=()):
    """Feeds files one a batch: the first half, then, from the checkpoint, the rest; ``late`` rows come in a last file."""
    timed.use_timers(spark)
    # a batch's rows are late to the watermark that the batch before it began with: one more batch stands between
    source, parts = f"{folder}/in", [*files, *([files[-1], late] if late else [])]
    half = len(files) // 2

    def feed(n):
        spark.createDataFrame(parts[n], schema).coalesce(1).write.mode("append").parquet(f"file://{source}")

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{source}")
        query = job(stream).writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    for n in range(half):
        feed(n)
    go()
    for n in range(half, len(parts)):
        feed(n)
    go()
    return spark.read.parquet(f"file://{folder}/out")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sessions_close(spark, tmp_path):
    """By completion, by the limit, by a completion that comes after the limit, and with rows that arrive before earlier ones."""
    schema = "event_id long, session_id string, correct int, completes boolean, ts timestamp"
    rows = [
        (1, "a", 1, False, at(0)), (2, "a", 0, False, at(60)), (3, "a", None, True, at(90)), (4, "a", 1, False, at(95)),
        (5, "b", 1, False, at(10)), (6, "b", 1, False, at(310)), (7, "b", 1, False, at(311)), (8, "b", None, True, at(320)),
        (9, "c", None, True, at(20)), (10, "d", 0, False, at(500)), (11, "d", 1, None, at(450)), (12, "d", None, True, at(640)), (13, "d", None, True, at(600)),
    ]
    rng = random.Random(3)
    rng.shuffle(rows)
    files = [rows[:5], rows[5:9], rows[9:], [(90, "z", 1, False, END)]]
    late = [(91, "a", 1, False, at(1)), (92, "e", 1, False, at(2))]
    got = run(spark, tmp_path, files, schema, timed.closed_sessions, late)
    want = timed.closed_sessions_batch(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert {r["session_id"]: (r["status"], r["attempts"], r["right"]) for r in got.collect()} == {"a": ("completed", 2, 1), "b": ("expired", 2, 2), "c": ("completed", 0, 0), "d": ("completed", 2, 1)}


def test_theta_in_order_of_time(spark, tmp_path):
    rng = random.Random(5)
    schema = "event_id long, user_id long, score double, a double, b double, ts timestamp"
    rows = [(k, k % 3, float(rng.random() < 0.6), rng.choice([0.8, 1.0, 1.3]), rng.uniform(-1, 1), at(rng.randint(0, 5000))) for k in range(40)]
    files = [rows[:15], rows[15:30], rows[30:], [(99, 7, 1.0, 1.0, 0.0, END)]]
    got = run(spark, tmp_path, files, schema, timed.theta_by_time, late=[(98, 1, 0.0, 1.0, 0.0, at(3))])
    last = {r["user_id"]: (r["theta"], r["n"]) for r in got.groupBy("user_id").agg(F.max_by("theta", "n").alias("theta"), F.max("n").alias("n")).collect()}
    want = {}
    for k, user, score, a, b, ts in sorted(rows, key=lambda r: (r[5], r[0])):
        t, n = want.get(user, (0.0, 0))
        want[user] = (min(max(t + 0.1 * a * (score - 1 / (1 + math.exp(-a * (t - b)))), -3.0), 3.0), n + 1)
    assert {k: v for k, v in last.items() if k != 7} == {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()}


def test_mastery_takes_each_cluster(spark, tmp_path):
    """As the batch fold over sessions, with users of three clusters and one of none; a known mastery is where the fold begins."""
    rng = random.Random(6)
    schema = "event_id long, user_id long, subtopic_id long, accuracy double, is_coding boolean, ts timestamp"
    rows = [(k, k % 4, k % 2, rng.random(), rng.random() < 0.5, at(rng.randint(0, 20) * 50_000 + k)) for k in range(40)]
    users = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, None)], "user_id long, learner_cluster int")
    known = spark.createDataFrame([(50, 5, 40.0, START)], "user_id long, subtopic_id long, mastery double, last_practiced_at timestamp")
    extra = (77, 50, 5, 0.9, False, at(86_400 * 3))
    files = [[*rows[:20], extra], rows[20:], [(99, 60, 0, 1.0, False, END + timedelta(days=30))]]
    got = run(spark, tmp_path, files, schema, lambda s: timed.mastery_by_time(s, users, known, delay="20 days"))
    last = got.groupBy("user_id", "subtopic_id").agg(F.max_by("mastery", "last_practiced_at").alias("mastery"))
    found = {(r["user_id"], r["subtopic_id"]): r["mastery"] for r in last.collect()}
    sessions = spark.createDataFrame(rows, schema).withColumnRenamed("ts", "ended_at").withColumnRenamed("event_id", "session_id")
    want = {(r["user_id"], r["subtopic_id"]): r["mastery"] for r in mastery.mastery_update(sessions, users).collect()}
    assert {k: v for k, v in found.items() if k[0] < 50} == {k: pytest.approx(v) for k, v in want.items()}
    p = 0.4 * 0.85 / (0.4 * 0.85 + 0.6 * 0.3)
    p += (1 - p) * 0.1
    assert found[(50, 5)] == pytest.approx(100 * (0.4 + (p - 0.4) * 1.15))
