"""Retrieval contexts on worked lists: the other list, pools, junk, and the short texts."""

import pytest

from gradeflow.operators import retrieval

LONG = "word " * 60


@pytest.fixture(scope="module")
def found(spark):
    names = spark.createDataFrame([(k, f"S{k}", f"T{k}") for k in range(1, 6)], "owner_id long, name string, topic string")
    ranked = [(1, "code", r, 100 + r, 0.9 - r / 100) for r in range(1, 20)] + [(1, "concept", 1, 200, 0.8)]
    ranked += [(2, "concept", r, 200 + r, 0.7) for r in range(1, 12)] + [(3, "code", 1, 300, 0.49)] + [(4, "concept", 1, 400, 0.9), (4, "concept", 2, 401, 0.8)]
    chunks = [(100 + r, "Code", f" {LONG}{r}\n", "Loops in depth", ("beginner", "Advanced", None)[r % 3]) for r in range(1, 20)]
    chunks += [(200 + r, None, f"{LONG}{r}", "A book", "master") for r in range(12)] + [(300, "Code", LONG, "A book", "beginner")]
    chunks += [(400, "Concept", "short", "A book", "beginner"), (401, "Concept", LONG + " All Rights Reserved", "A book", None)]
    wanted = [(k, d, g) for k in range(1, 6) for d in ("beginner", "master") for g in ("coding", "non_coding")]
    args = (
        spark.createDataFrame(wanted, "owner_id long, difficulty string, game_type string"), names, spark.createDataFrame(ranked, "owner_id long, list string, rank long, chunk_id long, similarity double"),
        spark.createDataFrame(chunks, "chunk_id long, chunk_type string, text string, title string, document_difficulty string"),
    )
    contexts = retrieval.retrieval_contexts(*args).cache()
    return {(r["owner_id"], r["difficulty"], r["game_type"]): r for r in contexts.collect()}, contexts, names


def test_lists_and_pools(found):
    rows = found[0]
    assert len(rows) == 20
    own = rows[1, "beginner", "coding"]  # of 15 entries, those without a difficulty are in no pool
    assert (own["kept"], own["supplementary"]) == (10, 5)
    assert own["context"].startswith("Topic: T1\nSubtopic: S1\nGame Type: coding\nTarget Difficulty: beginner\nContent Types Found: Code\nRetrieved Chunks: 10 (primary=5, supplementary=5)\n\nTARGET DIFFICULTY: Beginner\n\nGUIDANCE:\n- Primary references")
    first = own["content"].index("--- Code [difficulty: beginner] ---\n" + (LONG + "3").strip() + "\nDocument: Loops in depth")
    assert first < own["content"].index(retrieval.SUPPLEMENTARY_HEAD) < own["content"].index("[difficulty: advanced] ---\n" + (LONG + "1").strip())
    assert rows[1, "master", "coding"]["kept"] == 5 and "SUPPLEMENTARY" not in rows[1, "master", "coding"]["context"]
    assert rows[1, "beginner", "non_coding"]["kept"] == 1
    other = rows[2, "master", "coding"]  # nothing in the list of code: seven of the other
    assert (other["kept"], other["supplementary"]) == (7, 0) and "Content Types Found: Unknown" in other["context"] and "--- Content [difficulty: master]" in other["content"]
    assert rows[2, "beginner", "non_coding"]["supplementary"] == 11


def test_short_texts(found):
    rows = found[0]
    end = ".\nPlease generate coding questions based on the subtopic name and general Python knowledge."
    assert rows[3, "beginner", "coding"]["context"] == f"Topic: T3\nSubtopic: S3\nGame Type: coding\n\nNo relevant coding chunks found above similarity threshold{end}"
    assert rows[5, "master", "coding"]["context"] == f"Topic: T5\nSubtopic: S5\nGame Type: coding\n\n{retrieval.NO_RANKING}{end}"
    assert "All 1 retrieved chunks rejected as junk (id=400: too short (5 < 200))" in rows[4, "beginner", "coding"]["context"]
    # none of the pool of master: all entries count, and both are junk
    assert "All 2 retrieved chunks rejected as junk (id=400: too short (5 < 200); id=401: matched junk marker: 'all rights reserved')" in rows[4, "master", "coding"]["context"]
    assert {r["content"] for k, r in rows.items() if k[0] > 2} == {None}


def test_combinations(spark, found):
    rows, contexts, names = found
    pairs = spark.createDataFrame([("x", 1, 5), ("x", 0, 1), ("y", 0, 2)], "combination string, place int, owner_id long")
    got = {(r["combination"], r["difficulty"], r["game_type"]): r["context"] for r in retrieval.combined_contexts(pairs, contexts, names).collect()}
    assert len(got) == 8
    text = got["x", "beginner", "coding"]
    assert text.startswith("GAME TYPE: CODING\nDIFFICULTY LEVEL: BEGINNER\nSUBTOPIC COMBINATION: S1 + S5\n\nTARGET DIFFICULTY: Beginner") and "SIMPLIFIED" in text
    assert f"=== S1 ===\n{rows[1, 'beginner', 'coding']['content']}\n\n=== S5 ===\n{rows[5, 'beginner', 'coding']['context']}" in text
