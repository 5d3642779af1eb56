"""Free names, combinations and bins against plain restatements."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import catalogue, curation, selection

CATALOGUE = [(1, 10, "Loops"), (2, 10, "C"), (3, 11, "Go"), (4, 11, "go routines"), (5, 12, "Loops and more"), (6, 12, "Data  types"), (7, 12, " lists ")]


def test_names_as_restated(spark):
    """Names of one and two characters, empty ones, inner blanks, and no match."""
    names = ["C loops", "G", "Go", "GO ROUTINES now", " loops", "Lo", "Data types", "Data", "", "  ", "zzz", "\tLists\n", "c", "loops and", None]
    keys = {}
    for k, _, name in CATALOGUE:
        keys.setdefault(name.strip().lower(), k)

    def find(name):
        key = name.strip().lower()
        return keys.get(key) or next((v for k, v in sorted(keys.items(), key=lambda x: x[1]) if k.startswith(key) or key.startswith(k)), None)

    cat = spark.createDataFrame(CATALOGUE, "subtopic_id long, topic_id long, name string")
    got = {r["name"]: r["subtopic_id"] for r in catalogue.matched_names(spark.createDataFrame([(n,) for n in names], "name string"), cat).collect()}
    assert got == {n: find(n) for n in names if n is not None and find(n) is not None}
    assert got["C loops"] == 2 and got["Go"] == 3 and got["G"] == 3 and "zzz" not in got and got[""] == 1

    questions = spark.createDataFrame([(1, ["Lists", "C", "zzz", "Data", "c "]), (2, []), (3, None)], "question_id long, names array<string>")
    lists = {r["question_id"]: (r["subtopic_ids"], r["topic_ids"]) for r in catalogue.matched_lists(questions, cat).collect()}
    assert lists == {1: ([7, 2, 6], [12, 10]), 2: ([], []), 3: ([], [])}


@pytest.mark.parametrize("difficulty,most", [("beginner", None), ("intermediate", None), ("master", None), (None, 9)])
def test_combinations_as_restated(spark, difficulty, most):
    rng = random.Random(8)
    own = {1: [rng.randrange(4) for _ in range(23)], 2: [50], 3: [60, 60], 4: [70, 71, 72], 5: [rng.randrange(80, 82) for _ in range(9)]}
    rows, k = [], 0
    for zone, topics in own.items():
        for t in topics:
            rows.append((k, zone * 100 + t, zone))
            k += 1
    subtopics = spark.createDataFrame([(s, t) for s, t, _ in rows], "subtopic_id long, topic_id long")
    topics = spark.createDataFrame(sorted({(t, z) for _, t, z in rows}), "topic_id long, zone_id long")
    size = {"beginner": 1, "intermediate": 2}.get(difficulty, 3)
    want = []
    for zone in own:
        mine = [(s, t) for s, t, z in rows if z == zone]
        groups = {}
        for s, t in mine:
            groups.setdefault(t, []).append(s)
        out = [(s,) for s, _ in mine]
        if size >= 2:
            pairs = [p for g in groups.values() for p in itertools.combinations(g, 2)] + list(itertools.combinations([g[0] for g in groups.values()], 2))
            out += pairs[: len(mine) // 2]
        if size >= 3:
            out += list(itertools.combinations([s for s, _ in mine], 3))[: len(mine) // 3]
        assert len({tuple(sorted(c)) for c in out}) == len(out)
        want += [(zone, n + 1, list(c)) for n, c in enumerate(out[:most])]
    assert sorted(map(tuple, curation.smart_combinations(subtopics, topics, difficulty, most).collect())) == sorted(want)


def test_pairs_by_rank(spark):
    for g in (2, 3, 7, 40):
        rows = spark.range(g * (g - 1) // 2).select(F.lit(g).alias("g"), F.col("id").alias("r"))
        assert [(r["x"], r["y"]) for r in curation.unranked(rows, "g", "r").orderBy("r").collect()] == list(itertools.combinations(range(g), 2))


def test_nearest_item_where_values_bunch(spark):
    """Nine tenths of the values in one hundredth of the range: the same answers, few rows a bin."""
    rng = random.Random(9)
    near = lambda: rng.gauss(0.4, 0.002) if rng.random() < 0.9 else rng.uniform(-5, 5)
    items = [(i, "ab"[i % 2], near()) for i in range(400)]
    users = [(i, near()) for i in range(400)]
    frames = spark.createDataFrame(users, "user_id long, theta double"), spark.createDataFrame(items, "question_id long, game_type string, b double")
    for bins in (2, 16, 128):
        got = sorted(map(tuple, selection.nearest_item(*frames, bins=bins).collect()))
        assert got == sorted((u, g, min((abs(b - t), q) for q, k, b in items if k == g)[1]) for u, t in users for g in "ab")
