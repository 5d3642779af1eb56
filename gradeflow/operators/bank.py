"""The question bank: enrichment, search, validation, deduplication, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words that say little about a question.
COMMON = ("a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should")
BACKSLASH_MARKS = "[.,!?()\\[\\]{}\";:]+"


#: The columns of a listed question.
PREVIEW = ("question_id", "substring(question_text, 1, 100) AS preview", "difficulty", "game_type", "subtopic", "topic", "zone")


def named(questions: DataFrame, subtopics: DataFrame, topics: DataFrame, zones: DataFrame) -> DataFrame:
    """Whole questions with the names of their subtopic, topic and zone."""
    dims = subtopics.select("subtopic_id", "topic_id", F.col("name").alias("subtopic")).join(topics.select("topic_id", "zone_id", F.col("name").alias("topic")), "topic_id").join(zones.select("zone_id", F.col("name").alias("zone")), "zone_id")
    return questions.join(dims, "subtopic_id")


def enrich(questions: DataFrame, subtopics: DataFrame, topics: DataFrame, zones: DataFrame) -> DataFrame:
    """Questions with the names of their subtopic, topic and zone."""
    return named(questions, subtopics, topics, zones).selectExpr(*PREVIEW)


def search(
    rows: DataFrame, text: str = "", difficulty: str | None = None, game_type: str | None = None, unflagged: bool = False, **equal: str | int
) -> DataFrame:
    """Questions (as ``named`` gives them) whose text, subtopic or topic holds a string in either case, or whose id it is. The
    id is found whatever the game is. ``equal``: values of other columns, as status, subtopic, topic or zone."""
    like = lambda c: F.lower(c).contains(text.lower())
    hit = like("question_text") | like("subtopic") | like("topic")
    if game_type is not None:
        hit = hit & (F.col("game_type") == game_type)
    if text.isascii() and text.isdigit():
        hit = hit | (F.col("question_id").cast("string") == (text.lstrip("0") or "0"))
    if difficulty is not None:
        equal["difficulty"] = difficulty
    rows = rows.where(hit)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return (rows.where("not flagged") if unflagged else rows).selectExpr(*PREVIEW)


def statistics(questions: DataFrame) -> DataFrame:
    """Totals by status, by difficulty, by game, and of all."""
    sets = [["status"], ["difficulty"], ["game_type"], []]
    return questions.groupingSets(sets, "status", "difficulty", "game_type").agg(F.count("*").alias("n")).select("status", "difficulty", "game_type", "n")


def topic_summary(questions: DataFrame, subtopics: DataFrame) -> DataFrame:
    """Per topic: questions that aren't flagged, subtopics with and without any, and the share with."""
    n = questions.where("not flagged").groupBy("subtopic_id").agg(F.count("*").alias("n"))
    rows = subtopics.join(n, "subtopic_id", "left").groupBy("topic_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("questions"), F.count("n").alias("with_questions"), F.count("*").alias("subtopics"))
    return rows.withColumn("coverage", F.round(F.col("with_questions") * 100.0 / F.col("subtopics"), 6))


def dashboard(questions: DataFrame, subtopics: DataFrame, topics: DataFrame) -> DataFrame:
    """One row of counts over the catalogue."""
    left = subtopics.agg(F.count_distinct("topic_id").alias("topics_with_subtopics"), F.count("*").alias("subtopics"))
    right = questions.agg(F.count_distinct("subtopic_id").alias("subtopics_with_questions"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "processed").alias("processed"))
    return left.crossJoin(right).crossJoin(topics.agg(F.count("*").alias("topics")))


def essence(text: Column) -> Column:
    """The first five words of a text that say something, sorted."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, f"^{BACKSLASH_MARKS}|{BACKSLASH_MARKS}$", "")
    kept = F.filter(words, lambda w: ~bare(w).isin(*COMMON) & (F.length(w) > 2))
    return F.array_join(F.sort_array(F.slice(F.transform(kept, bare), 1, 5)), " ")


def question_hash(text: Column, subtopic_ids: Column, game: Column, difficulty: Column) -> Column:
    """Twelve hex digits over essence, subtopics written as a tuple, game and difficulty."""
    ids = F.transform(F.sort_array(subtopic_ids), lambda x: x.cast("string"))
    tuple_ = F.concat(F.lit("("), F.array_join(ids, ", "), F.when(F.size(ids) == 1, ",").otherwise(""), F.lit(")"))
    return F.substring(F.md5(F.concat_ws("|", essence(text), tuple_, game, difficulty)), 1, 12)


def hash_dedup(questions: DataFrame) -> DataFrame:
    """Each question with its hash, and the first question that has the same."""
    h = question_hash(F.col("question_text"), F.array("subtopic_id"), F.col("game_type"), F.col("difficulty"))
    rows = questions.select("question_id", h.alias("hash"))
    return rows.withColumn("first_id", F.min("question_id").over(W.partitionBy("hash"))).withColumn("duplicate", F.col("first_id") != F.col("question_id"))


def similar(new: DataFrame, stored: DataFrame, threshold: float = 0.8, length_ratio: float = 0.7) -> DataFrame:
    """(new_id, stored_id): stored questions of the same subtopic, difficulty and game that a new one repeats: equal texts, or
    lengths within the ratio and word sets of at least the Jaccard similarity. Word sets are joined on their rarest words
    (prefix filter), so that only pairs which can reach the threshold meet. stored is a new question's past: it holds no new one."""
    block = ["subtopic_id", "difficulty", "game_type"]
    base = lambda df: df.select(F.col("question_id").alias("id"), *block, F.lower(F.trim("question_text")).alias("t")).withColumn("words", F.array_distinct(F.filter(F.split("t", r"\s+"), lambda w: w != ""))).where("t <> ''")
    a, b = base(new), base(stored)
    rarity = b.select(*block, F.explode("words").alias("w")).groupBy(*block, "w").agg(F.count("*").alias("df"))

    def prefixes(df: DataFrame) -> DataFrame:
        tokens = df.select("id", *block, F.explode("words").alias("w"), F.size("words").alias("n")).join(rarity, [*block, "w"], "left")
        order = W.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "w")
        return tokens.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1).select("id", *block, "w")

    pairs = prefixes(a).withColumnRenamed("id", "new_id").join(prefixes(b).withColumnRenamed("id", "stored_id"), [*block, "w"]).select("new_id", "stored_id").distinct()
    full = pairs.join(a.select(F.col("id").alias("new_id"), F.col("t").alias("t1"), F.col("words").alias("w1")), "new_id").join(b.select(F.col("id").alias("stored_id"), F.col("t").alias("t2"), F.col("words").alias("w2")), "stored_id")
    ratio = F.least(F.length("t1"), F.length("t2")) / F.greatest(F.length("t1"), F.length("t2"))
    jaccard = F.size(F.array_intersect("w1", "w2")) / F.size(F.array_union("w1", "w2"))
    return full.where((F.col("t1") == F.col("t2")) | ((ratio >= length_ratio) & (jaccard >= threshold))).select("new_id", "stored_id")


def repeats(questions: DataFrame, threshold: float = 0.8, length_ratio: float = 0.7) -> DataFrame:
    """(question_id, existing_id): questions that repeat one with a smaller id, and the smallest of those. Equal texts of a block
    are one class with its smallest id, so that copies meet no other copy; classes meet by ``similar``."""
    block = ["subtopic_id", "difficulty", "game_type"]
    rows = questions.withColumn("t", F.lower(F.trim("question_text"))).where("t <> ''")
    classes = rows.groupBy(*block, "t").agg(F.min("question_id").alias("question_id"))
    named_ = classes.select("question_id", *block, F.col("t").alias("question_text"))
    near = similar(named_, named_, threshold, length_ratio).groupBy(F.col("new_id").alias("first_id")).agg(F.min("stored_id").alias("least_id"))
    first = classes.select(*block, "t", F.col("question_id").alias("first_id")).join(near, "first_id", "left")
    found = rows.join(first, [*block, "t"]).select("question_id", F.coalesce("least_id", "first_id").alias("existing_id"))
    return found.where("existing_id < question_id")


def subtopic_pairs(subtopics: DataFrame) -> DataFrame:
    """Pairs of subtopics of one topic, at most half as many as the topic has subtopics (one at least), in order."""
    w = W.partitionBy("topic_id")
    rows = subtopics.select("topic_id", "subtopic_id", "order_in_topic", F.count("*").over(w).alias("n"))
    left = rows.select("topic_id", F.col("subtopic_id").alias("first_id"), F.col("order_in_topic").alias("i"), "n")
    right = rows.select("topic_id", F.col("subtopic_id").alias("second_id"), F.col("order_in_topic").alias("j"))
    # only the pairs the cap can keep are made: those of the first member, and no more than the cap of them
    cap = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    pairs = left.join(right, "topic_id").where((F.col("i") == 1) & (F.col("j") > 1) & (F.col("j") - 1 <= cap))
    return pairs.select("topic_id", "first_id", "second_id")


def recent_and_top(questions: DataFrame, subtopics: DataFrame, rankings: DataFrame, n: int = 10) -> DataFrame:
    """(list, place, id, value): the newest questions, the subtopics with most questions, and the latest rankings (ranking_id,
    updated_at)."""

    def top(rows: DataFrame, name: str) -> DataFrame:
        best = rows.orderBy(F.desc("value"), "id").limit(n)
        place = F.row_number().over(W.partitionBy(F.lit(name)).orderBy(F.desc("value"), "id"))  # over n rows
        return best.select(F.lit(name).alias("list"), place.cast("bigint").alias("place"), F.col("id").cast("bigint").alias("id"), F.col("value").cast("bigint").alias("value"))

    newest = questions.select(F.col("question_id").alias("id"), F.col("question_id").alias("value"))
    busiest = questions.groupBy(F.col("subtopic_id").alias("id")).agg(F.count("*").alias("value")).join(subtopics.select(F.col("subtopic_id").alias("id")), "id", "left_semi")
    latest = rankings.select(F.col("ranking_id").alias("id"), F.col("updated_at").alias("value"))
    return top(newest, "newest").unionByName(top(busiest, "most questions")).unionByName(top(latest, "rankings"))


def bands(mastery: DataFrame, subtopics: DataFrame, users: DataFrame) -> DataFrame:
    """Number of weak, review and maintained subtopics of each user. Subtopics without a row are weak, and need no row to be counted."""
    have = mastery.groupBy("user_id").agg(F.count_if(F.col("mastery") < 90).alias("low"), F.count_if((F.col("mastery") >= 90) & (F.col("mastery") < 100)).alias("review"), F.count_if(F.col("mastery") >= 100).alias("maintained"), F.count("*").alias("known"))
    total = subtopics.agg(F.count("*").alias("total"))
    rows = users.select("user_id").join(have, "user_id", "left").na.fill(0).crossJoin(F.broadcast(total))
    return rows.select("user_id", (F.col("low") + F.col("total") - F.col("known")).alias("weak"), "review", "maintained")
