"""Rules and folds against worked values and plain restatements."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import scalar
from gradeflow.operators import bank, content, irt, mastery, tracing


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("m,correct,slip,guess,want", [(0.25, 1, 0.10, 0.25, 0.5454545454545455), (0.25, 0, 0.10, 0.25, 0.05), (1.0, 0, 0.05, 0.20, 0.95)])
def test_posterior(spark, m, correct, slip, guess, want):
    assert value(spark, scalar.bkt_posterior(F.lit(m), F.lit(correct), slip, guess)) == pytest.approx(want)


@pytest.mark.parametrize("t,want", [(30, 1.0), (60, 0.7), (10, 1.2), (None, 1.0)])
def test_time_weight(spark, t, want):
    assert value(spark, scalar.time_weight(F.lit(t).cast("double"), F.lit("crossword"))) == pytest.approx(want)


def test_time_weight_of_slow_games(spark):
    assert value(spark, scalar.time_weight(F.lit(50.0), F.lit("coding"))) == pytest.approx(0.914947228730031)


@pytest.mark.parametrize("k,d,want", [(0.5, 0.5, 0.27832583007993494), (0.15, 0.0, 0.14375625347530707), (0.85, 1.0, 0.14469475712474472), (0.0, 0.33, 0.0)])
def test_information_gain(spark, k, d, want):
    assert value(spark, scalar.information_gain(F.lit(k), F.lit(k), F.lit(d))) == pytest.approx(want, abs=1e-9)


def test_theta_in_the_order_given(spark):
    """Newest first; ids make the listed order."""
    listed = [(1, 1.0, 0.0), (1, 1.2, 0.5), (0, 0.8, -1.0), (1, 1.0, 0.0), (0, 1.0, 0.0)]
    day = datetime(2024, 1, 10)
    data = [(7, f"{9 - i}", i, s, day - timedelta(days=i)) for i, (s, _, _) in enumerate(listed)]
    rows = spark.createDataFrame(data, "user_id long, id string, question_id long, score long, created_at timestamp")
    items = spark.createDataFrame([(i, a, b) for i, (_, a, b) in enumerate(listed)], "question_id long, a double, b double")
    assert mastery.theta_update(rows, items).first()["theta"] == pytest.approx(0.06428133740247727)
    assert mastery.theta_update(rows.limit(4), items).count() == 0


def responses(spark, cells):
    data, user = [], 0
    for theta, right, n in cells:
        for _ in range(n):
            user += 1
            # the newest response gives the user's theta; an older one carries the other score
            data.append((1, user, 1 if theta > 0 else 0, user * 10 + 1, datetime(2024, 1, 2)))
            assert right == (1 if theta > 0 else 0)
    return spark.createDataFrame(data, "question_id long, user_id long, score int, id long, created_at timestamp")


def test_irt_all_right_diverges_to_the_clamp(spark):
    row = irt.recalibrate(responses(spark, [(2, 1, 20)])).first()
    assert (row["a"], row["b"], row["level"]) == (pytest.approx(0.2), -3.0, "beginner")


def test_irt_needs_twenty(spark):
    assert irt.recalibrate(responses(spark, [(2, 1, 19)])).count() == 0


def test_mastery_fold(spark):
    rng = random.Random(2)
    data = []
    for u in range(30):
        at = datetime(2024, 1, 1)
        for k in range(rng.randint(1, 9)):
            at += timedelta(days=rng.randint(0, 30), hours=rng.randint(0, 23))
            data.append((u, k, 1, rng.choice([0.0, 0.25, 0.5, 1.0]), at, rng.random() < 0.5))
    df = spark.createDataFrame(data, "user_id long, session_id long, subtopic_id long, accuracy double, ended_at timestamp, is_coding boolean")
    clusters = spark.createDataFrame([(u, u % 4 if u % 4 < 3 else None) for u in range(28)], "user_id long, learner_cluster long")
    got = {r["user_id"]: r["mastery"] for r in mastery.mastery_update(df, clusters).collect()}
    for u in range(30):
        k, last = 0.0, None
        slip, guess = {0: (0.05, 0.2), 1: (0.1, 0.25)}.get(u % 4 if u < 28 else None, (0.15, 0.3))
        for _, _, _, acc, at, coding in sorted((x for x in data if x[0] == u), key=lambda x: (x[4], x[1])):
            right = acc >= 0.5
            p = k * (1 - slip) / (k * (1 - slip) + (1 - k) * guess) if right else k * slip / (k * slip + (1 - k) * (1 - guess))
            p = min(max(p, 0.05), 0.95)
            p = p + (1 - p) * 0.1 if right else p
            w = 1.0 if last is None else min(1 + 0.05 * ((at - last).total_seconds() // 86400), 2.0)
            k, last = min(max(k + (p - k) * w * (1.5 if coding and right else 1), 0.0), 1.0), at
        assert got[u] == pytest.approx(k * 100)


def attempts(spark, marks):
    data = [(1, "s", c, datetime(2024, 1, 1) + timedelta(hours=i), i) for i, c in enumerate(marks)]
    return spark.createDataFrame(data, "student long, skill string, correct int, ts timestamp, event_id long")


def test_tracing_models(spark):
    split = tracing.leave_last_out(attempts(spark, [1, 0, 1, 1]))
    assert tracing.interactive_bkt(split).first()["p"] == pytest.approx(0.61023461875)
    assert tracing.standard_bkt(split).first()["p"] == pytest.approx(0.6864907651698907)
    assert tracing.leave_last_out(attempts(spark, [1, 0, 1])).count() == 0


def test_metrics_rank_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    assert tracing.kt_metrics(df).first()["auc"] == pytest.approx(0.625)
    assert tracing.calibration_bins(spark.createDataFrame([(1, 1.0), (0, 0.95)], "y int, p double")).collect()[0]["n"] == 1


@pytest.mark.parametrize("text,ids,game,level,want", [("What does the len() function return for a list?", [3], "non_coding", "beginner", "dd4087a28637"), ("Write a loop, then sum the values.", [5, 2], "coding", "advanced", "6f36ff5389f2")])
def test_question_hash(spark, text, ids, game, level, want):
    assert value(spark, bank.question_hash(F.lit(text), F.array(*map(F.lit, ids)), F.lit(game), F.lit(level))) == want


def test_similar_questions(spark):
    base = "name the loop that runs once for each item of a list in order"
    new = spark.createDataFrame([(1, 1, "beginner", "coding", base), (2, 1, "beginner", "coding", base + " now"), (3, 2, "beginner", "coding", base), (4, 1, "beginner", "coding", None)], "question_id long, subtopic_id long, difficulty string, game_type string, question_text string")
    old = spark.createDataFrame([(10, 1, "beginner", "coding", base.upper()), (11, 1, "beginner", "coding", "quite another text")], new.schema)
    assert sorted(map(tuple, bank.similar(new, old).collect())) == [(1, 10), (2, 10)]


def test_section_chunks(spark):
    sections = spark.createDataFrame([(1, 1, 2, 4), (1, 2, 5, 0), (1, 3, 9, None)], "document long, entry_id long, start_page long, end_page long")
    chunks = spark.createDataFrame([(1, p, 100 + p) for p in range(1, 8)], "document long, page long, chunk_id long")
    assert sorted(map(tuple, content.section_chunks(sections, chunks).collect())) == [(1, 102), (1, 103), (1, 104), (2, 105)]


def test_normalize_difficulty(spark):
    got = spark.createDataFrame([("Beginner",), ("master",), ("0.4",), ("3",), ("x",), (None,)], "d string").select(scalar.normalize_difficulty(F.col("d")).alias("x"))
    assert [r["x"] for r in got.collect()] == [0.0, 1.0, 0.5, 0.5, 0.5, 0.5]
    got = spark.createDataFrame([(0.4,), (3.0,), (-1.0,), (None,)], "x double").select(scalar.normalize_number(F.col("x")).alias("x"))
    assert [r["x"] for r in got.collect()] == [0.4, pytest.approx(2 / 3), 0.5, 0.5]


def test_effective(spark):
    one = F.lit(1.0)
    assert value(spark, scalar.effective_correctness(F.lit(1), F.lit(0.0), one, one)) == pytest.approx(0.7)
    t = scalar.time_weight(F.lit(40.0), F.lit("crossword"))
    assert value(spark, scalar.effective_correctness(F.lit(1), F.lit(0.33), t, one)) == pytest.approx(0.7004414654344712)
    assert not math.isnan(value(spark, scalar.recency_weight(F.lit(None).cast("timestamp"), F.current_timestamp())))
