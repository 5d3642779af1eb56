"""WARC round trips, held-out accuracy of the toxicity scores, and the pipeline's stages."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeflow.llm import simhash, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("split", [4 << 20, 3000])
def test_warc(spark, split):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = [(9000 + i, None if i % 3 else "http://a b\n/c", ["same", "é", None, "", "x" * 400000][i % 5]) for i in range(20)] + [(None, "u", "same"), (None, "u", "nobody"), (9015, "u", "same")]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("refers_to", F.lit("clash"))
    rows, largest = pages.collect(), {}
    for r in rows:
        if r["page_id"] is not None:
            largest[r["html"] or ""] = max(largest.get(r["html"] or "", -1), r["page_id"])
    want = []
    for r in rows:
        b, kept = (r["html"] or "").encode(), largest.get(r["html"] or "")
        first = kept is None or kept == r["page_id"]
        want.append((r["page_id"], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else kept))
    assert sorted(map(tuple, warc.warc_digest(pages, split).collect()), key=str) == sorted(want, key=str)


def test_warc_of_nothing(spark):
    assert warc.warc_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def toxic_corpus(spark):
    clean = "the meeting is about the budget of next year and the people who plan it".split()
    bad = ["idiot", "scumbag", "worthless"]
    rows, labels = [], []
    for i in range(400):
        words = [clean[(i * 7 + k * k) % len(clean)] + str((i + k) % 9) for k in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[3::10] = [bad[(i // 5 + k) % 3] for k in range(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (None, "idiot"), (1002, docs.where("doc_id = 0").first()["text"].upper() * 3000)], docs.schema)
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(docs.unionByName(odd).withColumn("score", F.lit("clash")), labels).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert 40 < len(held) < 120
    right = sum(got[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert right / len(held) > 0.95
    assert got[1000]["score"] == got[1001]["score"] < 0.5 <= got[1002]["score"] <= 1


def test_held_out_labels_are_never_read(spark):
    docs, labels = toxic_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_digest(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark)
    assert {r["score"] for r in toxicity.toxicity_digest(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_without_telling_features(spark):
    """Labels that no word goes with mark nothing, and a null id isn't held out."""
    docs = spark.createDataFrame([(i, f"the same few words {i % 3}") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(300)], "doc_id long, toxic int")
    rows = toxicity.toxicity_digest(docs, labels).collect()
    assert {r["predicted"] for r in rows} == {0} and all(0 < r["score"] < 0.5 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert toxicity.toxicity_digest(docs.where("false"), labels).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs.where("doc_id is not null"), SF).count() == 300


def test_run_end_to_end(spark, tmp_path):
    """All stages one after another, on the smallest tables, with ids repeated over different texts, and on no documents."""
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, words("a", 40)), (2, words("a", 40)), (2, words("b", 40)), (3, 'token = "abcdef123" ' + words("c", 9)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, 3, None]
    assert all(r["n_tokens"] == len(r["ids"]) for r in kept)
    docs.where("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(5, base), (3, base), (9, base + " tail"), (7, "quite different text " * 9), (None, "alone it stands"), (3, base), (11, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    left = sorted((r["doc_id"] for r in got.collect()), key=str)
    linked = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs, shingle=5).collect()}
    assert left == sorted({i for i in linked if i is None or linked[i] == i}, key=str)
    assert 3 in left and 5 not in left and 7 in left and None in left


def test_stages_keep_columns_and_clean_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, "clean text", "en", "s", 10), (2, bench, "en", "s", 9), (3, 'my token = "abcdef123"', "en", "s", 22), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, None]
    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, kept, SF).collect()}
    assert masked[3]["text"] == 'my [secret]"' and masked[3]["n_chars"] == 12 and masked[1]["text"] == "clean text"
    assert kept.columns == docs.columns
    ids = corpus_pipeline.encode(spark, kept, SF).collect()
    assert len(ids) == 3 and all(r["n_tokens"] == len(r["ids"]) for r in ids)


def test_stages_with_clashing_columns(spark):
    """Columns of every name that the stages use themselves pass through unchanged."""
    names = ["hash", "HASH2", "_t", "_own", "_base", "_assign", "_value", "_new", "_live", "_run", "_blocks", "_gaps", "secret_spans", "root", "node", "ring", "shingles", "component", "stays", "n", "found", "key"]
    texts = ["one two three four five six seven", 'my token = "abcdef123" and more', None, "one two three four five six seven"]
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated, corpus_pipeline.mask_secrets, corpus_pipeline.drop_toxic):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        for r in got.collect():
            assert list(r[2:]) == list(rows[r["doc_id"]][2:])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 1, 2]
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_secrets(spark, docs, SF).collect()}[1] == 'my [secret]" and more'


def test_near_duplicates_of_documents_against_all_pairs(spark):
    """On the given documents: what links of all pairs at 0.8 connect, and nothing else."""
    from gradeflow.llm import simhash_ring

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "").split()
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    group = {k: k for k in sets}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    ids, links = sorted(sets), 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                group[top(b)] = top(a)
                links += 1
    want = {}
    for k in ids:
        want.setdefault(top(k), []).append(k)
    want = {k: min(members) for members in want.values() for k in members}
    assert links > 5 and {r["doc_id"]: r["component"] for r in simhash_ring.near_duplicates(docs, shingle=5).collect()} == want


def test_first_step_goes_down_the_risk(monkeypatch):
    """One step of training against the risk by plain loops, and its slope by differences, where the negative part is above and below 0."""
    import math

    import numpy as np

    from gradeflow.llm import toxicity

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "SHRINK", 0.0)
    rng = random.Random(3)
    draw = lambda words, n: [np.array(sorted(rng.sample(words, 3))) for _ in range(n)]
    for prior, unlabelled in ((0.2, draw(range(8), 40)), (0.9, draw(range(6, 12), 40))):
        positive = draw(range(5), 30)
        w, bias = toxicity.fitted(positive, unlabelled, prior, 5)
        picks = np.random.default_rng(5)
        picks.permutation(len(unlabelled))
        chosen = [positive[i] for i in picks.integers(0, len(positive), max(16, toxicity.BATCH // 2))]
        loss = lambda z: math.log1p(math.exp(-z))

        def parts(at, b, chosen=chosen, unlabelled=unlabelled, prior=prior):
            score = lambda x: sum(at.get(int(f), 0.0) for f in x) + b
            mean = lambda rows, sign: sum(loss(sign * score(x)) for x in rows) / len(rows)
            return prior * mean(chosen, 1), mean(unlabelled, -1) - prior * mean(chosen, -1)

        start = math.log(prior / (1 - prior))
        up, negative = parts({}, start)
        risk = (lambda a, b: sum(parts(a, b))) if negative >= 0 else (lambda a, b: -parts(a, b)[1])
        for f in range(12):
            slope = (risk({f: 1e-4}, start) - risk({f: -1e-4}, start)) / 2e-4
            if abs(slope) > 1e-5:
                assert np.sign(w[f]) == -np.sign(slope) and abs(w[f]) == pytest.approx(toxicity.RATE, rel=0.2)
        slope = (risk({}, start + 1e-4) - risk({}, start - 1e-4)) / 2e-4
        if abs(slope) > 1e-5:
            assert np.sign(bias - start) == -np.sign(slope)


def test_cut_of_least_risk_by_plain_loops():
    import numpy as np

    from gradeflow.llm import toxicity

    rng = random.Random(4)
    for _ in range(20):
        p = [rng.choice([0, 1, 2, 3, rng.uniform(0, 4)]) for _ in range(rng.randint(1, 20))]
        u = [rng.choice([0, 1, 2, rng.uniform(-2, 3)]) for _ in range(rng.randint(2, 30))]
        levels = sorted({*p, *u})
        if len(levels) < 2:
            continue
        options = []
        for a, b in zip(levels, levels[1:], strict=False):
            cut = (a + b) / 2
            caught, marked = sum(x > cut for x in p) / len(p), sum(x > cut for x in u) / len(u)
            options.append((0.3 * (1 - caught) + max(0, marked - 0.3 * caught), b - a, cut))
        least = min(o[0] for o in options)
        widest = max(o[1] for o in options if o[0] <= least + 1e-9)
        assert toxicity.least_risk(np.array(p, float), np.array(u, float), 0.3) in [pytest.approx(o[2]) for o in options if o[0] <= least + 1e-9 and o[1] == pytest.approx(widest)]
