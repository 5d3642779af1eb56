"""Jobs with a row for each user and subtopic: their rows are made in the tasks that write them, and agree with plain loops."""

import pytest

from gradeflow.operators import curation
from gradeflow.plans import bank_jobs, jobs  # noqa: F401  (the other registers its jobs too)

SF = "/root/testdata/sf0.001"


def shuffled_after_unfolding(df):
    """Whether anything is dealt out after the users' lists are unfolded; True also without lists."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    unfolds = [k for k, line in enumerate(plan) if "Generate explode" in line]
    return not unfolds or any("Exchange" in line for line in plan[: unfolds[0]])


@pytest.mark.parametrize("name", ["mastery_band_rows", "band_union", "preassessment_init"])
def test_products_are_not_shuffled(spark, name):
    assert not shuffled_after_unfolding(jobs.QUERIES[name](spark, SF))


def test_band_rows(spark):
    """Every subtopic of the user's zone once, in the part of its mastery; users and subtopics without rows are weak, other zones' rows don't count."""
    known = [(1, 10, 49.9999999999), (1, 11, 50.0), (1, 12, 84.999), (1, 13, 85.0), (1, 14, 90.0), (1, 15, 100.0), (1, 20, 95.0), (2, 21, 99.9), (2, 10, 100.0), (3, 21, 10.0)]
    subtopics = [(0, s) for s in range(10, 17)] + [(1, 20), (1, 21)]
    zones = [(1, 0), (2, 1), (3, 1), (4, 1)]
    got = sorted(map(tuple, curation.band_rows(spark.createDataFrame(known, "user_id long, subtopic_id long, mastery double"), spark.createDataFrame(zones, "user_id long, zone_id int"), spark.createDataFrame(subtopics, "zone_id int, subtopic_id long")).collect()))
    have, want = {(u, s): round(m, 9) for u, s, m in known}, []
    for u, z in zones:
        for s in (s for k, s in subtopics if k == z):
            m = have.get((u, s), 0)
            band = "weak" if m < 90 else "review" if m < 100 else "maintenance"
            want.append((u, s, band, ("low" if m < 50 else "mid" if m < 85 else "high") if m < 90 else band))
    assert got == sorted(want)


def test_band_union(spark):
    """Subtopics of the zone but for those seen; what was seen twice or in another zone leaves the rest alone."""
    subtopics = [(0, s) for s in range(10, 17)] + [(1, 20), (1, 21)]
    zones = [(1, 0), (2, 1), (3, 1), (4, 1)]
    seen = [(1, 10), (1, 10), (1, 20), (2, 20), (2, 21), (3, 15), (None, 20)]
    got = curation.band_union(spark.createDataFrame(zones, "user_id long, zone_id int"), spark.createDataFrame(subtopics, "zone_id int, subtopic_id long"), spark.createDataFrame(seen, "user_id long, subtopic_id long"))
    assert sorted(map(tuple, got.collect())) == sorted((u, s) for u, z in zones for k, s in subtopics if k == z and (u, s) not in seen)


def test_set_candidates(spark):
    """A zone of few questions: all of them, with the parts and mastery that a join of users and questions gives. A zone of many: of the
    part low a pool a side, in which each question comes about equally often, none twice and none of the other parts."""
    import random
    from collections import Counter

    from gradeflow.operators import selection

    rng = random.Random(5)
    levels = ("beginner", "intermediate", "advanced", "master")
    subtopics = [(z, 100 * z + s) for z in (0, 1) for s in range(20)]
    questions = [(q, 100 * z + rng.randrange(19), rng.choice(levels)) for z, n in ((0, 250), (1, 2000)) for q in range(10_000 * z, 10_000 * z + n)]
    zones = [(u, u % 2) for u in range(120)]
    known = [(u, s, rng.choice([10.0, 49.0, 60.0, 86.0, 95.0, 100.0])) for u, _ in zones if u > 3 for s in rng.sample([s for _, s in subtopics], 6)]
    mastery = curation.in_parts(spark.createDataFrame(known, "user_id long, subtopic_id long, mastery double"))
    ability = spark.createDataFrame([(u, u / 200) for u in range(60)], "user_id long, ability double")
    tables = [spark.createDataFrame(r, t) for r, t in ((zones, "user_id long, zone_id int"), (subtopics, "zone_id int, subtopic_id long"), (questions, "question_id long, subtopic_id long, difficulty string"))]
    rows = selection.set_candidates(mastery, ability, *tables, 10, 7).collect()
    assert len({(r["user_id"], r["question_id"]) for r in rows}) == len(rows)
    have = {(u, s): m for u, s, m in known}
    part = lambda m: "low" if m < 50 else "mid" if m < 85 else "high" if m < 90 else "review" if m < 100 else "maintenance"
    full = {(u, q): (s, part(have.get((u, s), 0)), level, have.get((u, s)), u / 200 if u < 60 else None) for u, z in zones for q, s, level in questions if s // 100 == z}
    got = {(r["user_id"], r["question_id"]): (r["subtopic_id"], r["part"], r["difficulty"], r["known"] and round(r["known"] * 100, 6), r["ability"]) for r in rows}
    assert all(full[k] == v for k, v in got.items())
    assert {k for k in got if k[0] % 2 == 0} == {k for k in full if k[0] % 2 == 0}
    assert {k for k, v in got.items() if v[1] != "low"} == {k for k, v in full.items() if v[1] != "low"}
    pools = Counter((k[0], v[2] in levels[:2]) for k, v in got.items() if k[0] % 2 and v[1] == "low")
    assert set(pools.values()) == {100} and len(pools) == 120
    often = Counter(k[1] for k, v in got.items() if k[0] in (1, 3))  # these know nothing
    assert len(often) > 300  # two users' pools of 200 from 2000 share about 20
    seen = Counter(k[1] // 200 for k, v in got.items() if k[0] % 2 and v[1] == "low")
    assert max(seen.values()) < 1.35 * min(seen.values())
