"""Scalar rules on worked values, accents, clusters against their definition, and breakdowns on edge cases."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import scalar
from gradeflow.operators import details, selection


def values(spark, rows, schema, expression):
    return [r["v"] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").select("k", expression.alias("v")).orderBy("k").collect()]


def test_titles_and_levels(spark):
    assert values(spark, [("my_first-book.v2.pdf",), ("plain",), (".pdf",)], "f string", scalar.document_title(F.col("f"))) == ["My First Book.v2", "Plain", ""]
    thetas = [(None,), (-0.51,), (-0.5,), (0.49,), (0.5,), (1.49,), (1.5,)]
    assert values(spark, thetas, "t double", scalar.theta_level(F.col("t"))) == ["beginner", "beginner", "intermediate", "intermediate", "advanced", "advanced", "master"]


def test_accents_are_folded(spark):
    """As the compatibility form without marks has it, wherever that is letters and digits."""
    names = ["Café déjà vu", "Über Größe", "naïve coöp", "Ａ１ ﬁne ﬂow", "日本 x", "Ångström — 2", "ñandú_ÇA", "plain", "", "i̇z", "№ 5", "ẞ"]
    want = []
    for n in names:
        folded = unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().strip().lower()
        slug = "".join(c for c in folded if c.isalnum() or c in "_- \t")
        want.append("-".join(p for p in slug.replace("-", " ").split()).strip("-_"))
    assert values(spark, [(n,) for n in names[:-2]], "n string", scalar.slugify(F.col("n"))) == want[:-2]
    assert values(spark, [(names[-1],)], "n string", scalar.slugify(F.col("n"))) == [""]


def test_clusters_by_their_definition(spark):
    """Centres are the means of their own users on the scaled features, users are at the nearest, numbers go by accuracy."""
    rng = random.Random(5)
    rows = [(k, rng.gauss((10, 30, 60)[k % 3], 2), min(1.0, max(0.0, rng.gauss((0.9, 0.6, 0.3)[k % 3], 0.03)))) for k in range(90)]
    features = spark.createDataFrame(rows, "user_id long, avg_time double, accuracy double")
    centres, scale = selection.train_clusters(features)
    mean = lambda xs: sum(xs) / len(xs)
    spread = [math.sqrt(mean([(r[i] - mean([x[i] for x in rows])) ** 2 for r in rows])) for i in (1, 2)]
    assert scale == pytest.approx(tuple(spread)) and [c[0] for c in centres] == [0, 1, 2] and centres[0][2] > centres[1][2] > centres[2][2]
    got = {r["user_id"]: r["cluster"] for r in selection.assign_cluster(features, centres, scale).collect()}
    for k, t, a in rows:
        assert got[k] == min((((t - ct) / scale[0]) ** 2 + ((a - ca) / scale[1]) ** 2, n) for n, ct, ca in centres)[1] == k % 3
    for n, ct, ca in centres:
        own = [r for r in rows if got[r[0]] == n]
        assert (ct, ca) == pytest.approx((mean([r[1] for r in own]), mean([r[2] for r in own])))
    with pytest.raises(ValueError):
        selection.train_clusters(features.limit(49))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 1.0, 0.999, 0.1, 0.1, None]], "v double")
    assert [(r["bin"], r["n"]) for r in details.histogram(df, "v", 10).orderBy("bin").collect()] == [(0, 1), (1, 2), *[(k, 0) for k in range(2, 9)], (9, 2)]
    one = details.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["n"]) for r in one] == [(1.5, 1.75, 0), (1.75, 2.0, 0), (2.0, 2.25, 2), (2.25, 2.5, 0)]
    assert details.histogram(df.limit(0), "v").count() == 0


def test_boundaries_of_text(spark):
    full = "some words of a page about nothing in particular " * 6
    pages = [
        (1, ["Contents", full, "Chapter 1 " + full, full, "index of all " + full]), (2, ["x", full + " loops", full, "short"]), (3, [full, full + ">>> print( def import "]), (4, ["a", "b"]),
        (5, ["chapter 1 about it, but too short"] + [full] * 25 + ["copyright"]),
    ]
    rows = [(d, k, t) for d, texts in pages for k, t in enumerate(texts)]
    got = {r["document"]: (r["first_page"], r["last_page"]) for r in details.text_boundaries(spark.createDataFrame(rows, "document int, page int, text string")).collect()}
    assert got == {1: (2, 3), 2: (1, 2), 3: (1, 1), 4: (0, 1), 5: (0, 25)}
