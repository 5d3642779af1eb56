"""The catalogue of documents, chunks, tables of contents and reading pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions import text as rules


def typed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_type", rules.classify_chunk(F.col("text")))


def embedding_coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document: chunks, those with a vector of the model that fits their type, and the share. vectors: (chunk_id, model)."""
    rows = chunks.withColumn("model", rules.chunk_model(F.col("chunk_type"))).join(vectors.select("chunk_id", "model", F.lit(1).alias("_has")).distinct(), ["chunk_id", "model"], "left")
    out = rows.groupBy("document").agg(F.count("*").alias("chunks"), F.count("_has").alias("embedded"))
    return out.withColumn("coverage", F.round(F.col("embedded") * 100.0 / F.col("chunks"), 6))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def complexity(chunks: DataFrame) -> DataFrame:
    """Chunks of code with their points and level."""
    points = rules.code_complexity(F.col("text"))
    level = F.when(F.col("points") <= 2, "easy").when(F.col("points") <= 5, "medium").otherwise("hard")
    return chunks.where("chunk_type in ('Code', 'Try_It')").withColumn("points", points).withColumn("level", level)


def document_list(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that aren't deleted, newest first, with their number of chunks."""
    n = chunks.groupBy("document").agg(F.count("*").alias("chunks"))
    rows = documents.where("not is_deleted").join(n, "document", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return rows.orderBy(F.desc("created_at"), "document")


def toc_end_pages(toc: DataFrame, total: DataFrame) -> DataFrame:
    """Entries end on the page before the next one begins, the last on the document's last page. total: (document, total_pages)."""
    after = F.lead("start_page").over(W.partitionBy("document").orderBy("start_page", "entry_id"))
    rows = toc.join(total, "document").withColumn("after", after)
    return rows.select("document", "entry_id", "start_page", (F.coalesce("after", "total_pages") - 1).alias("end_page"))


def toc_dedup(toc: DataFrame) -> DataFrame:
    """Entries with titles of more than 3 characters that aren't numbers alone, the first of each title by page."""
    name = F.lower(F.trim("title"))
    rows = toc.where((F.length(F.trim("title")) > 3) & ~F.trim("title").rlike(r"^[\d.]+$"))
    first = F.row_number().over(W.partitionBy("document", name).orderBy("start_page", "entry_id"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k")


def toc_levels(toc: DataFrame) -> DataFrame:
    """(document, place, entry_id, level): entries by page, none more than one level below the one before or below the third. The level
    at place p is the least of 3, its own and, for each entry before at place q, that one's plus p - q, so a running least of
    level - place gives it, with a 0 before the first. Nulls take the deepest level allowed."""
    by_page = W.partitionBy("document").orderBy("start_page", "entry_id", "level")
    rows = toc.select("document", "start_page", "entry_id", "level").withColumn("place", (F.row_number().over(by_page) - 1).cast("bigint"))
    least = F.min(F.least(F.col("level"), F.lit(3)) - F.col("place")).over(by_page.rowsBetween(W.unboundedPreceding, 0))
    level = F.least(least, F.lit(1)) + F.col("place")
    return rows.select("document", "place", F.col("entry_id").cast("bigint").alias("entry_id"), level.cast("bigint").alias("level"))


def content_boundaries(toc: DataFrame) -> DataFrame:
    """(document, first_page, last_page): the first entry that isn't front matter, or the first at all; the last one's end, else start."""
    name = F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"^\d+(\.\d+)*\.?\s*", "")))
    real = (name != "") & ~name.isin(*rules.FRONT_MATTER)
    last = F.max_by(F.coalesce(F.nullif("end_page", F.lit(0)), F.col("start_page")), F.struct("start_page", "entry_id"))
    out = toc.groupBy("document").agg(F.min(F.when(real, F.col("start_page"))).alias("real"), F.min("start_page").alias("first"), last.alias("last"))
    return out.select("document", F.coalesce("real", "first").alias("first_page"), F.col("last").alias("last_page"))


def until_index(chunks: DataFrame, title: Column | None = None) -> DataFrame:
    """Chunks of a document before its index, or another book, begins."""
    stop = rules.index_start(F.col("text")) | (rules.other_book(F.col("text"), title) if title is not None else F.lit(False))
    gone = F.max(stop.cast("int")).over(W.partitionBy("document").orderBy("order_in_doc").rowsBetween(W.unboundedPreceding, 0))
    return chunks.withColumn("_gone", gone).where("_gone = 0").drop("_gone")


def backfill_order(materials: DataFrame) -> DataFrame:
    """Pages without a place in their topic get those after its last, in order of id."""
    topic = W.partitionBy("topic_id")
    k = F.row_number().over(W.partitionBy("topic_id", F.col("order_in_topic").isNull()).orderBy("material_id"))
    rows = materials.withColumn("_most", F.coalesce(F.max("order_in_topic").over(topic), F.lit(0))).withColumn("_k", k)
    return rows.withColumn("order_in_topic", F.coalesce("order_in_topic", F.col("_most") + F.col("_k"))).drop("_most", "_k")


def reading_order() -> list[Column]:
    return [F.col("subtopic_order"), F.coalesce("order_in_topic", F.lit(10_000_000)), F.col("title"), F.col("material_id")]


def reading_neighbors(materials: DataFrame) -> DataFrame:
    """Previous and next page of a topic in reading order; pages without a place come last in their subtopic."""
    w = W.partitionBy("topic_id").orderBy(*reading_order())
    return materials.select("material_id", "topic_id", F.lag("material_id").over(w).alias("previous_id"), F.lead("material_id").over(w).alias("next_id"))


def reading_toc(materials: DataFrame, search: str = "") -> DataFrame:
    """Pages of each topic in reading order with their place, those whose title or content holds a string."""
    rows = materials.where(F.lower("title").contains(search.lower()) | F.lower("content").contains(search.lower()))
    return rows.select("topic_id", F.row_number().over(W.partitionBy("topic_id").orderBy(*reading_order())).cast("bigint").alias("place"), "material_id", "title")


def matched_names(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, subtopic_id): the subtopic of a free name: the same apart from case and outer blanks, else the first of the
    catalogue of which one begins with the other; an empty name begins every one. catalogue: (subtopic_id, topic_id, name).

    Both ways are equal joins. A catalogue name can only begin a name by one of the lengths that catalogue names have, so each name
    is cut to those; and a name begins a catalogue name if it is one of that name's beginnings, of which each has the first
    subtopic kept. Names that nothing matches have no row."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    left = names.select("name").where("name is not null").distinct().withColumn("n", plain(F.col("name")))
    right = catalogue.where("name is not null").groupBy(plain(F.col("name")).alias("c")).agg(F.min("subtopic_id").alias("subtopic_id"))
    same = left.join(right, left["n"] == F.col("c")).select("name", "subtopic_id")
    rest = left.join(same.select("name"), "name", "left_anti")
    lengths = right.agg(F.array_sort(F.collect_set(F.length("c"))).alias("lengths"))  # one row
    cut = rest.crossJoin(F.broadcast(lengths)).select("name", "n", F.explode(F.filter("lengths", lambda k: k <= F.length("n"))).alias("k"))
    begun = cut.select("name", F.col("n").substr(F.lit(1), F.col("k")).alias("c")).join(right, "c").select("name", "subtopic_id")
    parts = right.select("subtopic_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("c")), lambda k: F.col("c").substr(F.lit(1), k))).alias("n"))
    begins = rest.join(parts.groupBy("n").agg(F.min("subtopic_id").alias("subtopic_id")), "n").select("name", "subtopic_id")
    return same.unionByName(begun.unionByName(begins).groupBy("name").agg(F.min("subtopic_id").alias("subtopic_id")))


def matched_lists(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(question_id, subtopic_ids, topic_ids) of (question_id, names): the subtopics and topics that a question's names match, each once, in
    the order of the names; empty lists where there is none."""
    said = questions.select("question_id", F.posexplode("names").alias("at", "name"))
    found = said.join(matched_names(said, catalogue), "name").join(catalogue.select("subtopic_id", "topic_id"), "subtopic_id")
    rows = found.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("at", "subtopic_id", "topic_id"))).alias("rows"))  # a question's own names
    ids = lambda c: F.array_distinct(F.transform(F.coalesce("rows", F.array().cast("array<struct<at:int,subtopic_id:bigint,topic_id:bigint>>")), lambda r: r[c]))
    return questions.select("question_id").join(rows, "question_id", "left").select("question_id", ids("subtopic_id").alias("subtopic_ids"), ids("topic_id").alias("topic_ids"))


def delete_impact(subtopics: DataFrame, **dependents: DataFrame) -> DataFrame:
    """Per subtopic: rows of each dependent table, each counted before it joins."""
    out = subtopics.select("subtopic_id")
    for name, rows in dependents.items():
        out = out.join(rows.groupBy("subtopic_id").agg(F.count("*").alias(name)), "subtopic_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A dependent table after the rows it depends on went."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def fanned_out(notifications: DataFrame, users: DataFrame) -> DataFrame:
    """(notification_id, user_id): a broadcast notification goes to every learner, others to their recipient. Every pair is a
    row to be sent, so the output is as large as the cross join."""
    learners = users.where("role = 'learner'").select("user_id")
    every = notifications.where("is_broadcast").select("notification_id").crossJoin(learners)
    return every.unionByName(notifications.where("not is_broadcast").select("notification_id", F.col("recipient").alias("user_id")))


def generation_progress(workers: DataFrame) -> DataFrame:
    """Per generation: workers by their latest status (by time), what they made, the share done, and seconds left. A cancelled
    worker stays so. workers: (generation_id, worker_id, at, status, questions, seconds)."""
    last = F.struct("at", "seconds")
    latest = workers.groupBy("generation_id", "worker_id").agg(
        F.when(F.bool_or(F.col("status") == "cancelled"), "cancelled").otherwise(F.max_by("status", last)).alias("status"), F.max("questions").alias("questions"), F.max("seconds").alias("seconds")
    )
    n = lambda s: F.count_if(F.col("status") == s)
    out = latest.groupBy("generation_id").agg(F.count("*").alias("workers"), n("completed").alias("completed"), n("failed").alias("failed"), n("active").alias("active"), n("cancelled").alias("cancelled"), F.sum("questions").cast("bigint").alias("questions"), F.max("seconds").alias("seconds"))
    left = F.col("workers") - F.col("completed") - F.col("failed") - F.col("cancelled")
    eta = F.when(F.col("completed") > 0, left * F.col("seconds") / F.col("completed"))
    return out.withColumn("percent", F.round(F.col("completed") * 100.0 / F.col("workers"), 6)).withColumn("eta", F.round(eta, 6))


def classifier_report(scored: DataFrame) -> DataFrame:
    """Per label: precision, recall, F1 and support, with accuracy and macro F1 of all. scored: (actual, predicted)."""
    cells = scored.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col("actual").alias("label")).agg(hit.alias("hits"), F.sum("n").alias("support"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    rows = actual.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    rows = rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))
    total = rows.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return rows.crossJoin(F.broadcast(total)).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1")])  # one row


def tfidf(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, weight): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1) of words and pairs of words, each text brought to length 1."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    rows = texts.select(key, words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda k: F.concat(F.get("w", k), F.lit(" "), F.get("w", k + 1)))).otherwise(F.array().cast("array<string>"))
    terms = rows.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # one row
    size = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return weighed.join(size, key).select(key, "term", (F.col("w") / F.col("size")).alias("weight"))


def retrieval_context(ranked: DataFrame, chunks: DataFrame, pool: DataFrame, least: float = 0.5, most: int = 15) -> DataFrame:
    """(owner_id, chunks, context): the text that a generation gets for each owner. ranked: (owner_id, rank, chunk_id, similarity);
    chunks: (chunk_id, document, text, title); pool: (document, tier), tier 0 before 1. Of the ``most`` best chunks from ``least``
    on, those of the pool are taken, or all if none is in it; junk is left out; owners without any get an empty text."""
    best = ranked.where(F.col("similarity") >= least).withColumn("_k", F.row_number().over(W.partitionBy("owner_id").orderBy("rank"))).where(F.col("_k") <= most)
    rows = best.join(chunks, "chunk_id").join(pool, "document", "left")
    some = F.max(F.col("tier").isNotNull().cast("int")).over(W.partitionBy("owner_id"))
    rows = rows.withColumn("_some", some).where((F.col("_some") == 0) | F.col("tier").isNotNull())
    rows = rows.where(rules.junk_reason(F.col("text"), F.col("title")).isNull())
    parts = F.sort_array(F.collect_list(F.struct(F.coalesce("tier", F.lit(0)).alias("tier"), "rank", "text")))
    out = rows.groupBy("owner_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))
    owners = ranked.select("owner_id").distinct()
    return owners.join(out, "owner_id", "left").select("owner_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("context", F.lit("")).alias("context"))


def combined_context(contexts: DataFrame, combinations: DataFrame) -> DataFrame:
    """(combination, context): texts of a combination's owners, in order. combinations: (combination, place, owner_id)."""
    parts = F.sort_array(F.collect_list(F.struct("place", "context")))
    rows = combinations.join(contexts.select("owner_id", "context"), "owner_id").where("context <> ''")
    return rows.groupBy("combination").agg(F.array_join(F.transform(parts, lambda p: p["context"]), "\n\n").alias("context"))
