"""Search of the question bank."""

from gradeflow.operators import bank


def test_search_reads_whole_texts_and_filters(spark):
    late = "x" * 150 + " Needle"
    data = [(1, late, "coding", "pending", False), (2, "Q needle", "non_coding", "pending", True), (3, "other", "coding", "approved", False), (40, "other", "coding", "pending", False)]
    questions = spark.createDataFrame([(i, 7, t, "advanced", g, s, f) for i, t, g, s, f in data], "question_id long, subtopic_id long, question_text string, difficulty string, game_type string, status string, flagged boolean")
    subtopics = spark.createDataFrame([(7, 1, "loops")], "subtopic_id long, topic_id long, name string")
    topics = spark.createDataFrame([(1, 1, "control")], "topic_id long, zone_id long, name string")
    zones = spark.createDataFrame([(1, "first")], "zone_id long, name string")
    rows = bank.named(questions, subtopics, topics, zones)
    ids = lambda *a, **k: sorted(r["question_id"] for r in bank.search(rows, *a, **k).collect())
    assert ids("needle") == [1, 2]
    assert bank.search(rows, "needle", unflagged=True).first()["preview"] == late[:100]
    assert ids("LOOP") == [1, 2, 3, 40]
    assert ids("40", game_type="non_coding") == [40]
    assert ids("loop", status="pending", game_type="coding") == [1, 40]
    assert ids("needle", "master") == ids("loop", zone="none") == ids("loop", topic="none") == []
    assert ids("9" * 30) == []
