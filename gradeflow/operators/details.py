"""Breakdowns beside the catalogue's summaries: by type, by page, by bin, and where a book's content lies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.scalar import DIFFICULTY
from gradeflow.operators import curation


def token_stats_by_type(chunks: DataFrame) -> DataFrame:
    """(document, chunk_type, chunks, tokens, characters, over_4k, compression) with totals of each document and of all, whose keys are null.
    compression: cleaned characters in raw ones. chunks: (document, chunk_type, text, cleaned)."""
    t = F.floor(F.length("text") / 4)
    out = chunks.rollup("document", "chunk_type").agg(
        F.count("*").alias("chunks"), F.sum(t).alias("tokens"), F.sum(F.length("text")).alias("characters"), F.count_if(t > 4000).alias("over_4k"), F.sum(F.length("cleaned")).alias("_left")
    )
    return out.withColumn("compression", F.round(F.coalesce(F.col("_left") / F.nullif("characters", F.lit(0)), F.lit(0.0)), 6)).drop("_left")


def page_chunks(chunks: DataFrame) -> DataFrame:
    """(document, page, chunks, kinds): a page's chunks as structs (order_in_doc, chunk_id, chunk_type, characters) in order, and how many there
    are of each kind, by name. chunks: (document, page, order_in_doc, chunk_id, chunk_type, text)."""
    one = F.struct("order_in_doc", "chunk_id", "chunk_type", F.length("text").alias("characters"))
    rows = chunks.groupBy("document", "page").agg(F.sort_array(F.collect_list(one)).alias("chunks"))  # a page's own chunks
    kinds = F.transform("chunks", lambda c: c["chunk_type"])
    count = lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n"))
    return rows.withColumn("kinds", F.transform(F.array_sort(F.array_distinct(kinds)), count))


def question_distribution(questions: DataFrame, subtopics: DataFrame) -> DataFrame:
    """(topic_id, subtopic_id, questions, one column a difficulty, coding, non_coding, latest) of questions that aren't flagged: of each subtopic,
    those without any too, and of each topic (subtopic_id null) and all."""
    own = questions.where("not flagged").groupBy("subtopic_id").agg(
        F.count("*").alias("questions"), *[F.count_if(F.col("difficulty") == k).alias(k) for k in DIFFICULTY], *[F.count_if(F.col("game_type") == k).alias(k) for k in ("coding", "non_coding")], F.max("question_id").alias("latest")
    )
    rows = subtopics.select("topic_id", "subtopic_id").join(own, "subtopic_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in own.columns[1:-1]]
    return rows.rollup("topic_id", "subtopic_id").agg(*sums, F.max("latest").alias("latest"))


def zone_achievements(zones: DataFrame) -> DataFrame:
    """(user_id, zone_id, current, target, unlocked) of (user_id, zone_id, completion): whole percents of a zone, of 100."""
    current = F.least(F.floor(F.round("completion", 9)), F.lit(100)).cast("bigint")
    return zones.select("user_id", "zone_id", current.alias("current"), F.lit(100).alias("target"), (current >= 100).alias("unlocked"))


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n): equal bins from the least to the greatest value, the last with both ends; empty ones have n 0. Where all values are
    equal, the bins span one around them."""
    v = F.col(column)
    ends = values.agg(F.min(v).alias("a"), F.max(v).alias("b")).where("a is not null")
    same = F.col("a") == F.col("b")
    ends = ends.select(F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    ends = F.broadcast(ends)  # one row
    number = F.least(F.floor(F.round((v - F.col("a")) / (F.col("b") - F.col("a")) * bins, 9)), F.lit(bins - 1)).cast("int")
    counts = values.where(v.isNotNull()).crossJoin(ends).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda k: F.round(F.col("a") + (F.col("b") - F.col("a")) * k / bins, 6)
    every = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"))
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def estimated_pages(kept: DataFrame, raw: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``page_number`` to the chunks kept: the k-th of n raw chunks of a document stands k pages' shares behind its first page, each of one
    page at least, and not behind its last. spans: (document, start_page, end_page); k counts from 0 by order_in_doc."""
    n = raw.groupBy("document").agg(F.count("*").alias("_n"), F.min("order_in_doc").alias("_first")).join(spans, "document")
    share = F.greatest(F.lit(1.0), (F.col("end_page") - F.col("start_page") + 1) / F.col("_n"))
    page = F.least(F.col("start_page") + F.floor((F.col("order_in_doc") - F.col("_first")) * share), F.col("end_page"))
    return kept.join(n, "document").withColumn("page_number", page.cast("bigint")).select(*kept.columns, "page_number")


def subtopics_without_vectors(subtopics: DataFrame, vectors: DataFrame, models: int = 2) -> DataFrame:
    """(subtopic_id, have): subtopics that have a vector of fewer models than there are. vectors: (subtopic_id, model)."""
    have = vectors.groupBy("subtopic_id").agg(F.count_distinct("model").alias("have"))
    return subtopics.select("subtopic_id").join(have, "subtopic_id", "left").select("subtopic_id", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < models)


def page_with_place(rows: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """A page of a table with its place on every row: total, page, page_size, has_more, previous and next page (null where there is none)."""
    page, info = curation.page(rows, order, number, size)
    whole = {k: F.lit(v) for k, v in info.items()}
    before, after = (info["page"] - 1 if info["page"] > 1 else None), (info["page"] + 1 if info["has_more"] else None)
    return page.withColumns(whole | {"previous_page": F.lit(before).cast("int"), "next_page": F.lit(after).cast("int")})


def material_counts(subtopics: DataFrame, materials: DataFrame) -> DataFrame:
    """(topic_id, subtopics, materials): what each topic with subtopics has."""
    n = materials.groupBy("topic_id").agg(F.count("*").alias("materials"))
    rows = subtopics.groupBy("topic_id").agg(F.count("*").alias("subtopics")).join(n, "topic_id", "left")
    return rows.select("topic_id", "subtopics", F.coalesce("materials", F.lit(0)).alias("materials"))


#: Words of a page that begins a book's content, and of pages that are none.
FIRST_WORDS = ("chapter 1", "chapter one", "chapter i", "lesson 1", "unit 1", "module 1")
SECOND_WORDS = ("introduction to python", "getting started", "python basics", "fundamentals", "variables", "data types", "functions", "loops", "programming")
SKIP_WORDS = (
    "table of contents", "contents", "preface", "foreword", "acknowledgments", "about the author", "about this book", "copyright", "isbn", "dedication",
    "index", "bibliography", "references", "glossary", "about packt", "appendix", "answer key", "solutions", "toc", "title page", "cover",
)
CODE_WORDS = (">>>", "print(", "def ", "import ", "from ", "python", "variable", "function", "string")
SEARCHED_PAGES, LAST_PAGES, ENOUGH_CODE = 50, 20, 4


def text_boundaries(pages: DataFrame) -> DataFrame:
    """(document, first_page, last_page) by the text of pages (document, page, text), numbered from 0. First: the first of 50 pages that names
    chapter 1, else the first with another opening word or four signs of code, else 0. Last: of the last 20 pages behind the first,
    the last with over 200 characters, else the last of all. Pages with a word that skips them are neither."""
    low = F.lower(F.coalesce("text", F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    n = F.length(F.regexp_replace(low, r"^\s+|\s+$", ""))
    code = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in CODE_WORDS])
    rows = pages.withColumn("_ok", ~any_of(SKIP_WORDS)).withColumn("_n", n)
    early = F.col("_ok") & (F.col("page") < SEARCHED_PAGES)
    one = F.min(F.when(early & (F.col("_n") >= 100) & any_of(FIRST_WORDS), F.col("page")))
    two = F.min(F.when(early & (F.col("_n") >= 200) & (any_of(SECOND_WORDS) | (code >= ENOUGH_CODE)), F.col("page")))
    last = F.max(F.when(F.col("_ok") & (F.col("_n") > 200), F.col("page")))
    found = rows.groupBy("document").agg(F.coalesce(one, two, F.lit(0)).alias("first_page"), last.alias("_last"), (F.max("page") + 1).alias("_total"))
    # the last good page is the first one met from the end, if it is met at all
    met = F.col("_last") > F.greatest(F.col("_total") - LAST_PAGES, F.col("first_page"))
    return found.select("document", F.col("first_page").cast("bigint").alias("first_page"), F.when(met, F.col("_last")).otherwise(F.col("_total") - 1).cast("bigint").alias("last_page"))
