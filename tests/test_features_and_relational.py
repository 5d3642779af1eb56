"""Chunk features on worked texts, and a relational table read in ranges."""

import json

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import features
from gradeflow.sources import relational


def described(spark, title, text, page=3):
    df = spark.createDataFrame([(title, text, page)], "title string, text string, page int")
    row = df.select(features.chunk_features(F.col("title"), F.col("text"), F.col("page")).alias("f")).withColumn("json", features.prompt_record(F.lit("7"), F.col("f"))).first()
    return row["f"], json.loads(row["json"])


def test_titles(spark):
    titles = {
        "1.2 Challenge: Draw a tree ...": ("Challenge: Draw a tree", "1.2"), "3.4 Review Exercises: Loops . . .": ("Exercises: Loops", "3.4"), " 2.10 Lists  and tuples": ("Lists and tuples", "2.10"),
        "7 Classes": ("Classes", "7"), ".5. Odd.title": ("Oddtitle", ""), "Plain title...": ("Plain title", ""), "": ("", ""), None: ("", ""),
    }
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", features.title_and_section(F.col("t")).alias("x")).collect()
    assert {r["t"]: tuple(r["x"]) for r in rows} == titles


def test_features(spark):
    text = "A string is a string.\n\n\nUse the print() function, see https://a.org/x or www.b.org for more... before 12\n"
    f, record = described(spark, "4.1 Strings in Python", text)
    assert f["content"] == "A string is a string. Use the print() function, see  or  for more before" and f["improved"] and f["text_length"] == len(f["content"])
    assert (f["clean_title"], f["section_number"], f["content_type"], f["page_number"]) == ("Strings in Python", "4.1", "concept_explanation", 4)
    assert f["concepts"] == "string for print() function"  # "for" stands in "before" too
    assert f["keywords"] == ["string", "function", "print", "python", "strings"] and (f["code_examples"], f["exercises"]) == (0, 0)
    assert record["id"] == "chunk_7" and record["title"] == f["clean_title"] and record["content"].startswith("CONTENT:\nA string") and record["metadata"]["text_length"] == f["text_length"]


def test_examples_and_exercises(spark):
    assert described(spark, "x", "First >>> x = 1 then >>> y")[0]["code_examples"] == 2
    f = described(spark, "x", "value = 3 and so on")[0]
    assert (f["code_examples"], f["content_type"]) == (1, "instructional_text")
    f = described(spark, "x", "1.5 Loops and everything else about them 44")[0]
    assert (f["clean_title"], f["exercises"]) == ("1.5 Loops and everything else about them", 1)
    assert described(spark, "x", "1. Write a loop that prints python")[0]["exercises"] == 0  # marked as an exercise instead
    for empty in (None, "", "  ", "12"):
        f = described(spark, None, empty)[0]
        assert (f["clean_title"], f["concepts"], f["keywords"], f["code_examples"], f["text_length"]) == ("", "", [], 0, 0)
    long = described(spark, "t", "loop " * 60_000)[0]
    assert long["concepts"] == "loop" and long["text_length"] == 299_999


@pytest.mark.parametrize("kind", ["skewed", "text", "empty"])
def test_relational_table_in_ranges(spark, tmp_path, kind):
    """Rows read are rows written; no partition is above about twice the mean, with a hot key and null keys."""
    url = f"jdbc:derby:{tmp_path}/db_{kind};create=true"
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    k = F.col("id")
    key = F.when(k % 3 == 0, 7).when(k % 10 == 1, None).otherwise((k * k) % 5000)
    rows = spark.range(0 if kind == "empty" else 3000).select(k.alias("ID"), (key.cast("int") if kind != "text" else F.concat(F.lit("it's "), (k % 700).cast("string")).cast("varchar(40)")).alias("K"), (k * 2).alias("V"))
    rows.coalesce(1).write.jdbc(url, "T", mode="overwrite", properties=own | ({"createTableColumnTypes": "K VARCHAR(40)"} if kind == "text" else {}))
    got = relational.read_table(spark, url, "T", "K", 8, second="ID", properties=own)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    if kind != "empty":
        assert len(sizes) >= 8 and max(sizes) <= 2 * 3000 / 8
