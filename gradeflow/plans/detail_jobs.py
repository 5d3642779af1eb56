"""Registered breakdowns beside the catalogue's summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import scalar
from gradeflow.functions import text as rules
from gradeflow.operators import catalogue, details, mastery
from gradeflow.plans.adapters import domain
from gradeflow.plans.content_jobs import TYPED, cleaned_sql
from gradeflow.plans.jobs import ABILITY, ZONES, _zones, job
from gradeflow.streaming import answers


@job(f"""WITH {TYPED}, t AS (SELECT document, chunk_type, text, length(text) // 4 AS t, length({cleaned_sql()}) AS cleaned FROM typed)
    SELECT document, chunk_type, count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (WHERE t > 4000) AS over_4k,
        round(coalesce(sum(cleaned) * 1.0 / nullif(sum(length(text)), 0), 0.0), 6) AS compression FROM t GROUP BY ROLLUP (document, chunk_type)""")
def token_stats_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document's chunks by kind, with totals, and what cleaning leaves of them."""
    return details.token_stats_by_type(catalogue.typed(domain(spark, d, "pieces")).withColumn("cleaned", rules.clean_raw(F.col("text"))))


@job(f"""WITH {TYPED}, k AS (SELECT document, page, string_agg(concat(chunk_type, ':', n), ',' ORDER BY chunk_type) AS kinds FROM (SELECT document, page, chunk_type, count(*) AS n FROM typed GROUP BY ALL) x GROUP BY document, page)
    SELECT t.document AS document, t.page AS page, string_agg(concat(order_in_doc, ':', chunk_id, ':', chunk_type, ':', length(text)), ',' ORDER BY order_in_doc) AS chunks, any_value(kinds) AS kinds
    FROM typed t JOIN k ON k.document = t.document AND k.page = t.page GROUP BY t.document, t.page""")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each page's chunks in order, and their kinds."""
    rows = details.page_chunks(catalogue.typed(domain(spark, d, "pieces")))
    chunk = lambda c: F.concat_ws(":", c["order_in_doc"], c["chunk_id"], c["chunk_type"], c["characters"])
    kind = lambda k: F.concat_ws(":", k["kind"], k["n"])
    return rows.select("document", "page", F.array_join(F.transform("chunks", chunk), ",").alias("chunks"), F.array_join(F.transform("kinds", kind), ",").alias("kinds"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE difficulty = '{k}') AS {k}" for k in scalar.DIFFICULTY)
_GAMES = ", ".join(f"count(*) FILTER (WHERE game_type = '{k}') AS {k}" for k in ("coding", "non_coding"))
_SUMS = ", ".join(f"CAST(coalesce(sum({k}), 0) AS BIGINT) AS {k}" for k in ("questions", *scalar.DIFFICULTY, "coding", "non_coding"))


@job(f"""WITH q AS (SELECT subtopic_id, count(*) AS questions, {_COUNTS}, {_GAMES}, max(question_id) AS latest FROM questions WHERE NOT flagged GROUP BY subtopic_id)
    SELECT topic_id, s.subtopic_id AS subtopic_id, {_SUMS}, max(latest) AS latest FROM subtopics s LEFT JOIN q ON q.subtopic_id = s.subtopic_id GROUP BY ROLLUP (topic_id, s.subtopic_id)""")
def question_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each subtopic and topic by difficulty and game, and the latest."""
    return details.question_distribution(domain(spark, d, "questions"), domain(spark, d, "subtopics"))


@job(f"""WITH {ZONES} SELECT user_id, zone_id, CAST(least(floor(round(completion, 9)), 100) AS BIGINT) AS current, 100 AS target, floor(round(completion, 9)) >= 100 AS unlocked FROM zone_rows""")
def zone_achievements(spark: SparkSession, d: str) -> DataFrame:
    """How far each user is towards each zone's achievement."""
    return details.zone_achievements(_zones(spark, d))


@job(f"""WITH {ABILITY}, e AS (SELECT CASE WHEN min(ability) = max(ability) THEN min(ability) - 0.5 ELSE min(ability) END AS a, CASE WHEN min(ability) = max(ability) THEN max(ability) + 0.5 ELSE max(ability) END AS b FROM ability),
    c AS (SELECT CAST(least(floor(round((ability - a) / (b - a) * 30, 9)), 29) AS INTEGER) AS bin, count(*) AS n FROM ability, e GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS bin, round(a + (b - a) * k / 30, 6) AS low, round(a + (b - a) * (k + 1) / 30, 6) AS high, coalesce(n, 0) AS n FROM e, range(30) t(k) LEFT JOIN c ON c.bin = k""")
def ability_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Abilities in thirty equal bins."""
    return details.histogram(mastery.ability_update(mastery.session_accuracy(domain(spark, d, "responses"))), "ability")


@job("""WITH n AS (SELECT document, count(*) AS n, min(order_in_doc) AS first, min(page) AS start_page, max(page) AS end_page FROM pieces GROUP BY document)
    SELECT chunk_id, CAST(least(start_page + floor((order_in_doc - first) * greatest(1.0, (end_page - start_page + 1) / n::DOUBLE)), end_page) AS BIGINT) AS page_number FROM pieces p JOIN n ON n.document = p.document WHERE chunk_id % 5 > 0""")
def estimated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the chunks whose number isn't a multiple of five, from their place among all of their document."""
    raw = domain(spark, d, "pieces").select("document", "chunk_id", "order_in_doc", "page")
    spans = raw.groupBy("document").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    return details.estimated_pages(raw.where("chunk_id % 5 > 0"), raw, spans).select("chunk_id", "page_number")


@job("""WITH v AS (SELECT vec_id % 140 AS subtopic_id, count(DISTINCT label % 2) AS have FROM embeddings WHERE vec_id % 3 > 0 OR label % 2 = 0 GROUP BY ALL)
    SELECT s.subtopic_id AS subtopic_id, coalesce(have, 0) AS have FROM subtopics s LEFT JOIN v ON v.subtopic_id = s.subtopic_id WHERE coalesce(have, 0) < 2""")
def subtopics_without_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are of two models by their label's parity; of odd labels every third is taken for missing."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 3 > 0 or label % 2 = 0")
    return details.subtopics_without_vectors(domain(spark, d, "subtopics"), e.select((F.col("vec_id") % 140).alias("subtopic_id"), (F.col("label") % 2).alias("model")))


@job("""WITH n AS (SELECT count(*) AS total FROM questions), p AS (SELECT question_id, row_number() OVER (ORDER BY question_text, question_id) AS k FROM questions)
    SELECT question_id, CAST(total AS INTEGER) AS total, 3 AS page, 10 AS page_size, total > 30 AS has_more, 2 AS previous_page, CASE WHEN total > 30 THEN 4 END AS next_page FROM p, n WHERE k BETWEEN 21 AND 30""")
def page_with_place(spark: SparkSession, d: str) -> DataFrame:
    """The third page of questions by text, with its place."""
    page = details.page_with_place(domain(spark, d, "questions"), [F.col("question_text"), F.col("question_id")], 3)
    return page.select("question_id", "total", "page", "page_size", "has_more", "previous_page", "next_page")


@job("""WITH s AS (SELECT topic_id, count(*) AS subtopics FROM subtopics GROUP BY topic_id), m AS (SELECT topic_id, count(*) AS materials FROM materials GROUP BY topic_id)
    SELECT s.topic_id AS topic_id, subtopics, coalesce(materials, 0) AS materials FROM s LEFT JOIN m ON m.topic_id = s.topic_id""")
def material_counts(spark: SparkSession, d: str) -> DataFrame:
    return details.material_counts(domain(spark, d, "subtopics"), domain(spark, d, "materials"))


def _contains(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@job(rf"""WITH p AS (SELECT document, page, lower(text) AS low, length(regexp_replace(lower(text), '^\s+|\s+$', '', 'g')) AS n FROM book_pages),
    g AS (SELECT document, page, n, NOT {_contains(details.SKIP_WORDS)} AS ok, {_contains(details.FIRST_WORDS)} AS one, {_contains(details.SECOND_WORDS)} OR {" + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in details.CODE_WORDS)} >= 4 AS two FROM p),
    f AS (SELECT document, coalesce(min(page) FILTER (WHERE ok AND page < 50 AND n >= 100 AND one), min(page) FILTER (WHERE ok AND page < 50 AND n >= 200 AND two), 0) AS first, max(page) + 1 AS total FROM g GROUP BY document)
    SELECT f.document AS document, CAST(first AS BIGINT) AS first_page, CAST(coalesce((SELECT max(page) FROM g WHERE g.document = f.document AND ok AND n > 200 AND page > greatest(total - 20, first)), total - 1) AS BIGINT) AS last_page FROM f""")
def text_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Where the content of every document's book begins and ends, by its pages' text."""
    return details.text_boundaries(domain(spark, d, "book_pages"))


@job(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(strip_accents(substr(coalesce(text, ''), 1, 60)))), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug FROM documents""")
def document_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of the first characters of every document, in four languages."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", scalar.slugify(F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("slug"))


@job("""WITH w AS (SELECT skill, correct, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '6 hours' FOR k IN range(4)]) AS started FROM attempts)
    SELECT skill, CAST(epoch(started) AS BIGINT) AS started, count(*) AS n, CAST(sum(correct) AS BIGINT) AS "right" FROM w GROUP BY ALL""")
def sliding_activity(spark: SparkSession, d: str) -> DataFrame:
    """Answers of each skill in windows of a day that begin six hours apart: the batch form of the stream."""
    events = domain(spark, d, "attempts").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = answers.activity(events, slide="6 hours")
    return rows.select("skill", F.unix_timestamp("day").alias("started"), "n", "right")
