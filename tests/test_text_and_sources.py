"""Text rules, question sources and keyed streams on small fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import text as rules
from gradeflow.operators import catalogue, grading, merging, selection
from gradeflow.sources import questions
from gradeflow.streaming import learners


def values(spark, rule, *texts):
    return [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i").select(rule(F.col("t")).alias("x")).collect()]


def test_kinds_of_chunks(spark):
    texts = [">>> 1 + 1", "x = f(y) is one\n    a\n    b", "Now try this at home", "Exercise: write a loop", "See the following code", "A list is defined as a sequence", ""]
    assert values(spark, rules.classify_chunk, *texts) == ["Code", "Code", "Try_It", "Exercise", "Example", "Concept", "Concept"]


def test_cleaning(spark):
    raw = "[ 12 ] Loops\nChapter 3\nsee https://a.org/x and [docs](http://b.com) Page 3 of 9\n17\nCopyright 2020 by us"
    assert values(spark, rules.clean_raw, raw, None) == ["Loops see and [docs](", ""]
    chunk = "THE HEADING\nA list holds items [3] in order.\n#hidden\nNote that: \nA list holds items"
    assert values(spark, rules.clean_chunk, chunk) == ["A list holds items in order. Note that: A list holds items"]
    assert values(spark, rules.clean_chunk, "same line here\nsame line here\nmore of it") == ["same line here more of it"]


def test_levels_of_questions(spark):
    texts = ["", "What is a list?", "Explain why and how to write it, or not and more", "Evaluate the trade-off", "What will be printed: print(1)?"]
    assert values(spark, rules.question_level, *texts) == ["beginner", "beginner", "master", "master", "intermediate"]


def test_junk(spark):
    title = F.lit("Fluent Snakes")
    long = "word " * 60
    got = values(spark, lambda t: rules.junk_reason(t, title), "", "x" * 199, long, long + "ISBN 3", "Fluent Snakes! " * 20)
    assert got == ["empty", "short", None, "marker: isbn", "title"]


def test_index_and_other_books(spark):
    assert values(spark, rules.index_start, "lists 12\nloops, for 113\nmaps 14", "a . . . 3\nlists 12", "") == [True, False, False]
    assert values(spark, lambda t: rules.other_book(t, F.lit("Intermediate Python")), "as Fluent Python says", "Intermediate Python it is") == [True, False]


def test_question_dump_and_export(spark, tmp_path):
    data = [{"question_text": "Q ", "difficulty": " Master"}, {"game_data": {"normal": {"question_text": "C"}}, "difficulty": "beginner"}, {"question_text": "x", "difficulty": "odd"}, {"question_text": " ", "difficulty": "master"}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    assert sorted(map(tuple, questions.read_dump(spark, str(tmp_path / "d.json")).collect())) == [("C", "beginner"), ("Q", "master")]
    rows = [(1, "coding", "t", "a", "beginner", "s", "2024", {"correct_code": "x=1", "hidden_tests": '["a"]'}), (2, "non_coding", "t", "a", "master", None, "2024", {"explanation": "e", "generation_timestamp": "g"})]
    df = spark.createDataFrame(rows, "question_id int, game_type string, question_text string, correct_answer string, difficulty string, subtopic string, created_at string, fields map<string,string>")
    out = questions.exported(df, "now")
    got = {r["question_id"]: json.loads(r["document"]) for r in out.collect()}
    assert got[1]["game_data"]["normal"]["clean_solution"] == "x=1" and got[1]["game_data"]["normal"]["hidden_tests"] == ["a"] and got[1]["game_data"]["generation_timestamp"] == "now"
    assert got[2]["game_data"] == {"explanation": "e", "generation_timestamp": "g"} and got[2]["correct_answer"] == "a"
    questions.write_exports(out, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_model_answers(spark):
    texts = ['[{"q": 1}, {"q": 2}]', 'Here:\n```json\n{"questions": [{"q": 3}]}\n```', '{"q": "a\\d"}', 'well [{"q": 4}] so', "nothing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "response_id int, text string")
    got = sorted((r["response_id"], json.loads(r["question"])["q"]) for r in questions.parse_responses(df).collect())
    assert got == [(0, 1), (0, 2), (1, 3), (2, "a\\d"), (3, 4)]


def test_first_test(spark):
    rows = [(1, [7, 8], 1, "advanced", 0), (1, [7], 1, "beginner", 1), (1, [8], 0, "intermediate", 2), (1, [9], 0, "master", 3)]
    stats = grading.first_test_stats(spark.createDataFrame(rows, "user_id long, subtopic_ids array<long>, correct int, difficulty string, place int"))
    users = spark.createDataFrame([(1, 1)], "user_id long, learner_cluster int")
    got = {r["subtopic_id"]: r["mastery"] for r in grading.first_mastery(stats, users, spark.createDataFrame([(7,), (8,), (9,), (10,)], "subtopic_id long")).collect()}
    assert got[7] == pytest.approx(61.93181818181818) and got[9] == pytest.approx(5.0) and got[10] == pytest.approx(25.0)


def test_quotas(spark):
    assert selection.quotas(10) == {"low": 4, "mid": 3, "high": 1, "review": 2, "maintenance": 0}
    rows = [(1, 100 * s + q, s, part, level, 0.1 * q) for s, part in ((1, "low"), (2, "mid"), (3, "high"), (4, "review"), (5, "maintenance")) for q, level in enumerate(("beginner", "advanced") * 4)]
    df = spark.createDataFrame(rows, "user_id long, question_id long, subtopic_id long, part string, difficulty string, gain double")
    got = selection.question_set(df, 10, 3).collect()
    assert len(got) == 10 == len({r["question_id"] for r in got})
    assert {p: sum(r["own"] for r in got if r["part"] == p) for p in ("low", "mid", "high", "review")} == {"low": 4, "mid": 3, "high": 1, "review": 2}


def test_context(spark):
    long = "content " * 40
    chunks = spark.createDataFrame([(i, f"d{i % 2}", f"{i} {long}" if i != 3 else "short", "t") for i in range(6)], "chunk_id long, document string, text string, title string")
    ranked = spark.createDataFrame([(1, i, i, 0.9 - i / 10) for i in range(6)] + [(2, 0, 0, 0.1)], "owner_id long, rank long, chunk_id long, similarity double")
    pool = spark.createDataFrame([("d1", 0)], "document string, tier int")
    got = {r["owner_id"]: r for r in catalogue.retrieval_context(ranked, chunks, pool).collect()}
    assert got[1]["chunks"] == 1 and got[1]["context"].startswith("1 content") and got[2]["context"] == ""
    both = spark.createDataFrame([("c", 1, 2), ("c", 0, 1)], "combination string, place int, owner_id long")
    assert catalogue.combined_context(catalogue.retrieval_context(ranked, chunks, pool), both).first()["context"] == got[1]["context"]


def test_keyed_streams(spark, tmp_path):
    """Two micro-batches give what one fold in order of time gives."""
    import math

    at = datetime(2024, 1, 1)
    data = [(i, i % 3, float(i % 2), 1.0, 0.2, at + timedelta(days=i)) for i in range(30)]
    schema = "event_id long, user_id long, score double, a double, b double, ts timestamp"
    for k, part in enumerate((data[:14], data[14:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = learners.theta(stream).writeStream.format("memory").queryName("theta_now").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("theta_now").collect():
        last[r["user_id"]] = max(last.get(r["user_id"], (0, 0)), (r["n"], r["theta"]))
    for user in range(3):
        t = 0.0
        for _, _, score, a, b, _ in (x for x in data if x[1] == user):
            t = min(max(t + 0.1 * a * (score - 1 / (1 + math.exp(-a * (t - b)))), -3), 3)
        assert last[user] == (10, pytest.approx(t))
    sessions = stream.select("event_id", "user_id", F.lit(4).cast("bigint").alias("subtopic_id"), F.col("score").alias("accuracy"), F.lit(True).alias("is_coding"), "ts")
    query = learners.mastery(sessions).writeStream.format("memory").queryName("mastery_now").outputMode("update").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    from gradeflow.operators import mastery

    folded = spark.createDataFrame(data, schema).select("user_id", F.col("event_id").alias("session_id"), F.lit(4).alias("subtopic_id"), F.col("score").alias("accuracy"), F.lit(True).alias("is_coding"), F.col("ts").alias("ended_at"))
    want = {r["user_id"]: r["mastery"] for r in mastery.mastery_update(folded).collect()}
    got = {}
    for r in spark.table("mastery_now").orderBy("last_practiced_at").collect():
        got[r["user_id"]] = r["mastery"]
    assert got == {u: pytest.approx(m) for u, m in want.items()}


def test_sinks(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, i % 4, i, i % 2, 9, at) for i in range(20)], "event_id long, user_id long, question_id long, correct int, time_taken int, ts timestamp")
    write = learners.response_sink(str(tmp_path / "log"))
    for number in (0, 0, 1):  # the first batch twice
        write(rows, number)
    assert spark.read.parquet(str(tmp_path / "log/responses")).count() == spark.read.parquet(str(tmp_path / "log/game_responses")).count() == 40
    spark.createDataFrame([(i, 1, "completed", "crossword", 30) for i in range(21)], "session_id long, user_id long, status string, game_type string, elapsed long").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(i, 1) for i in range(21)], "session_id long, correct int").write.parquet(str(tmp_path / "r"))
    award = learners.award_sink(spark, str(tmp_path / "s"), str(tmp_path / "r"), str(tmp_path / "a"))
    for number in (0, 1, 1):
        award(spark.createDataFrame([(1,)], "user_id long"), number)
    assert sorted(r["code"] for r in spark.read.parquet(str(tmp_path / "a")).collect()) == ["first_steps", "game_enthusiast", "perfection_seeker", "speed_solver"]


def test_levels_of_first_tests(spark):
    fenced = "```python\nif a:\n  if b:\n    print(c)\n```"
    texts = [None, "", "What is a variable?", "Write a loop", f"What is printed? {fenced}", "Create a function: x = 1"]
    assert values(spark, rules.first_test_level, *texts) == ["beginner", "beginner", "beginner", "intermediate", "advanced", "intermediate"]


def test_merging(spark):
    texts = {
        "code": ["class A(B):", "def f(x):", "return x", "Other words stand here."],
        "brackets": ["import os\nvalues = [1, 2", "3, 4]\nThe end.", "And more."],
        "sentence": ["It goes on without", "an end.", "Next one."],
        "list": ["- first", "- second", "Done."],
        "topic": ["Loop Basics\nHere it is.", "The basics of it.", "Nothing."],
        "output": ["Run it now.", "$ python a.py", "OK"],
        "long": ["word " * 601 + "and", "so on."],
        "gaps": ["It goes on without", "", None, "an end."],
    }
    rows = [(d, k, k, "Concept", t) for d, own in texts.items() for k, t in enumerate(own)] + [(None, 9, 9, "Concept", "open"), (None, 10, 10, "Concept", "end.")]
    schema = "document string, chunk_id long, page int, chunk_type string, text string"
    found = {}
    for r in merging.merge_split_chunks(spark.createDataFrame(rows, schema)).orderBy("chunk_id").collect():
        found.setdefault(r["document"], []).append((r["chunk_id"], r["last_page"], r["parts"], r["chunk_type"], r["merge_type"]))
    # the line of the definition stays in the open chunk, so that whatever begins with a letter goes on with it
    assert found["code"] == [(0, 3, 4, "Code", "split_code_block")]
    assert found["brackets"] == [(0, 1, 2, "Code", "split_code_block"), (2, 2, 1, "Concept", None)]
    assert found["sentence"] == [(0, 1, 2, "Concept", "incomplete_sentence"), (2, 2, 1, "Concept", None)]
    assert found["list"] == [(0, 1, 2, "Concept", "list_continuation"), (2, 2, 1, "Concept", None)]
    assert found["topic"] == [(0, 1, 2, "Concept", "topic_continuation"), (2, 2, 1, "Concept", None)]
    assert found["output"] == [(0, 2, 3, "Code", "terminal_output")]
    assert [x[2] for x in found["long"]] == [1, 1] and [x[2] for x in found["gaps"]] == [1] * 4 and len(found[None]) == 2
    assert merging.merge_split_chunks(spark.createDataFrame([], schema)).count() == 0


def test_progress_of_a_stream(spark, tmp_path):
    write = learners.progress_sink(spark, str(tmp_path))
    schema = "generation_id long, worker_id string, at int, status string, questions long, seconds long"
    write(spark.createDataFrame([(1, "a", 1, "active", 2, 10), (1, "b", 1, "cancelled", 1, 5), (2, "a", 1, "active", 0, 1)], schema), 0)
    second = spark.createDataFrame([(1, "a", 2, "completed", 7, 20), (1, "b", 2, "active", 4, 20)], schema)
    for _ in range(2):  # a batch that comes again replaces itself
        write(second, 1)
    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/progress/batch=1").collect()]
    assert [(r["generation_id"], r["workers"], r["completed"], r["cancelled"], r["questions"], r["percent"]) for r in rows] == [(1, 2, 1, 1, 11, 50.0)]


def test_chunks_are_cleaned_once(spark):
    """The cleaner's rules stand a few times in the job's plan, not once for each use of what they give; short chunks leave before they join."""
    from gradeflow.functions import text as rules
    from gradeflow.operators import merging
    from gradeflow.plans import content_jobs

    plan = content_jobs.chunk_pipeline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("PacktPublishing") < 60
    assert spark.range(1).select(rules.clean_chunk(F.lit(None).cast("string")).alias("x")).first()["x"] == ""
    rows = [("a", 1, 0, "Concept", "It goes on in"), ("a", 2, 1, "Concept", "two three"), ("a", 3, 1, "Concept", "the next page."), (None, 4, 0, "Concept", "short"), (None, 5, 0, "Concept", "long enough")]
    got = merging.merge_split_chunks(spark.createDataFrame(rows, "document string, chunk_id long, page int, chunk_type string, text string"), 10).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["parts"], r["text"]) for r in got] == [(1, 2, "It goes on in the next page."), (5, 1, "long enough")]
