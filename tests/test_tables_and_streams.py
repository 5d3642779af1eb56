"""Exports, keyed changes, selection and streams on small fixtures."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import changes, selection
from gradeflow.sources import exports
from gradeflow.streaming import answers


def test_flatten_sessions(spark, tmp_path):
    question = {"gamequestion_id": 7, "generated_question": {"generated_question_id": 70, "question_text": "q", "game_type": "coding"}}
    answered = question | {"responses": [{"response_id": 1, "user_id": 5, "is_correct": True}, {"response_id": 2, "user_id": 5, "is_correct": False}]}
    data = [{"id": 1, "session_id": "a", "game_questions": [answered, question | {"gamequestion_id": 8}]}, {"id": 2, "session_id": "b", "game_questions": []}]
    (tmp_path / "x.json").write_text(json.dumps(data))
    rows = exports.flatten_sessions(exports.read_sessions(spark, str(tmp_path)))
    assert len(rows.columns) == 23
    assert sorted((r["session_pk"], r["gamequestion_id"], r["response_id"] or 0) for r in rows.collect()) == [(1, 7, 1), (1, 7, 2), (1, 8, 0)]


def test_read_attempts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,skill_id,correct,start_time,other\n1,s,1,2024-01-01 00:00:00,x\n2,,0,,y\n")
    assert [tuple(r)[:3] for r in exports.read_attempts(spark, str(tmp_path)).orderBy("student").collect()] == [(1, "s", 1), (2, None, 0)]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], old.schema)
    assert sorted(map(tuple, changes.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, None, 5), (3, "c", 3)]
    assert sorted(map(tuple, changes.insert_missing(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert sorted(map(tuple, changes.changed(old, new, "k", ["x"]).collect())) == [(2, "changed"), (3, "new")]


def test_sampling_law(spark):
    """The first question drawn follows the softmax of the gains; no question comes twice."""
    gains = {1: 0.1, 2: 0.4, 3: 0.9}
    users = spark.range(6000).select(F.col("id").alias("user_id"))
    pool = spark.createDataFrame([(q, q, g) for q, g in gains.items()], "question_id long, subtopic_id long, gain double")
    drawn = selection.sample_by_gain(users.crossJoin(pool), 2, 3).collect()
    first = [r["question_id"] for r in drawn if r["place"] == 1]
    total = sum(math.exp(g / 0.6) for g in gains.values())
    for q, g in gains.items():
        assert first.count(q) / len(first) == pytest.approx(math.exp(g / 0.6) / total, abs=0.025)
    assert len(drawn) == 12000 == len({(r["user_id"], r["question_id"]) for r in drawn})


def test_nearest_item(spark):
    """Against all pairs: ties, values in other bins, and games of their own."""
    import random

    rng = random.Random(4)
    items = [(i, "ab"[i % 2], rng.choice([rng.uniform(-0.2, 0.2), rng.uniform(-3, 3), 0.5])) for i in range(120)] + [(900, "c", 2.9)]
    users = [(i, rng.choice([rng.uniform(-4, 4), rng.uniform(-0.1, 0.1), 0.5, None])) for i in range(200)]
    got = sorted(map(tuple, selection.nearest_item(spark.createDataFrame(users, "user_id long, theta double"), spark.createDataFrame(items, "question_id long, game_type string, b double")).collect()))
    want = [(u, g, min((abs(b - (t or 0.0)), q) for q, k, b in items if k == g)[1]) for u, t in users for g in "abc"]
    assert got == sorted(want)


def test_streams_agree_with_batches(spark, tmp_path):
    at = datetime(2024, 1, 1)
    data = [(i, i % 2, "s", i % 3 % 2, at + timedelta(seconds=200 * i * (1 + i // 10))) for i in range(20)]
    schema = "event_id long, student long, skill string, correct int, ts timestamp"
    events = spark.createDataFrame(data + data[:3], schema)
    late = spark.createDataFrame([(99, 9, "s", 1, at + timedelta(days=60))], schema)  # moves the watermark past all that came before
    for k, part in enumerate((events, late)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, job in (("activity", answers.activity), ("sessions", answers.session_summary)):
        query = job(answers.deduplicated(stream), delay=None).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(60)
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got and got == {tuple(r) for r in job(events.dropDuplicates(["event_id"])).collect()}


def test_sessions_count_gaps_in_whole_seconds(spark, tmp_path):
    """Gaps across 300 seconds of the clock end a session, as in the job's SQL; answers without a time stand alone."""
    import duckdb

    from gradeflow.plans import jobs

    at = datetime(2024, 1, 1)
    seconds = [0.9, 300.1, 600.05, 899.99, 1200.0, 1499.999999, 5000.5, 5300.5]
    data = [(i, 1, "view", 200.0, at + timedelta(seconds=s)) for i, s in enumerate(seconds)] + [(90, 2, "view", 1.0, None), (91, 2, "view", 200.0, None), (92, None, "view", 200.0, at)]
    spark.createDataFrame(data, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted((tuple(r) for r in con.sql(jobs.ORACLE_SQL["session_summary"]).fetchall()), key=key)
    got = sorted((tuple(r) for r in jobs.session_summary(spark, str(tmp_path)).collect()), key=key)
    assert got == want and (1, 2, 2) in got and len(got) == 9
