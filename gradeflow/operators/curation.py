"""Curation of the question bank: flags, checks, cleaning, status changes, batches, combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions.scalar import slugify

LEVELS = ("beginner", "intermediate", "advanced", "master")
#: Keys of a question's data that are of no use any more, at the top and inside rag_context.
OLD_KEYS = ("used", "context", "auto_generated", "pipeline_version", "is_cross_subtopic")
OLD_INNER_KEYS = ("used", "context")
STATUSES = ("pending", "approved", "rejected", "needs_review")
#: Fields that a question needs, besides text and difficulty.
CODING_FIELDS = ("buggy_question_text", "function_name", "sample_input", "sample_output", "hidden_tests", "clean_solution", "code_shown_to_student", "code_with_bug_fixed", "explanation", "buggy_explanation")
OTHER_FIELDS = ("answer", "explanation")


def flagged(questions: DataFrame, reason: str | None = None, game_type: str | None = None, level: str | None = None, min_count: int | None = None) -> DataFrame:
    """Flagged questions, the newest flag first. With a level: those with as many flags of it, or, without a number, with any
    of it or with none counted at all. flag_count_by_level: map of level to count."""
    rows = questions.where("flagged")
    if reason:
        rows = rows.where(F.lower("flag_reason").contains(reason.lower()))
    if game_type:
        rows = rows.where(F.col("game_type") == game_type)
    if level is not None:
        if level not in LEVELS:
            raise ValueError(f"level must be one of {LEVELS}")
        count = F.coalesce(F.try_element_at("flag_count_by_level", F.lit(level)), F.lit(0))
        rows = rows.where(count >= min_count) if min_count is not None else rows.where((count > 0) | (F.coalesce(F.size("flag_count_by_level"), F.lit(0)) <= 0))
    return rows.orderBy(F.desc("flag_created_at"), "question_id")


def malformed(questions: DataFrame, last: int = 1000) -> DataFrame:
    """(question_id, reason) of the newest ids that hold no usable question. The first reason counts."""
    newest = questions.agg(F.max("question_id").alias("newest"))
    rows = questions.crossJoin(F.broadcast(newest)).where(F.col("question_id") >= F.col("newest") - last)  # one row
    blank = lambda c, n: F.length(F.trim(F.coalesce(c, F.lit("")))) < n
    reason = (
        F.when(blank("question_text", 10), "text").when(blank("correct_answer", 1), "answer")
        .when(F.col("topic_id").isNull() | F.col("subtopic_id").isNull(), "subtopic").when(F.col("status") == "processing", "processing")
    )
    return rows.select("question_id", reason.alias("reason")).where("reason is not null")


def validated(questions: DataFrame) -> DataFrame:
    """(batch, place, is_valid, reason) of questions (batch, place, game_type, fields: map of name to text). Of a batch's coding
    questions each function's name stands once; a missing name counts as one, too."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    coding = F.col("game_type") == "coding"
    seen = F.row_number().over(W.partitionBy("batch", coding, field("function_name")).orderBy("place"))
    rows = questions.withColumn("_seen", seen)

    def lacking(names: tuple[str, ...]) -> Column:
        bad = lambda n: F.coalesce(F.regexp_like(F.regexp_replace(field(n), r"\s", ""), F.lit(r"^\[.+\]$")), F.lit(False)) if n == "hidden_tests" else F.length(F.trim(F.coalesce(field(n), F.lit("")))) > 0
        return F.filter(F.array(*[F.when(~bad(n), F.lit(n)) for n in ("question_text", "difficulty", *names)]), lambda x: x.isNotNull())

    short = F.get(F.when(coding, lacking(CODING_FIELDS)).otherwise(lacking(OTHER_FIELDS)), F.lit(0))
    reason = F.when(coding & (F.col("_seen") > 1), "function_name twice").otherwise(short)
    return rows.select("batch", "place", reason.isNull().alias("is_valid"), reason.alias("reason"))


def formatted(questions: DataFrame) -> DataFrame:
    """Questions (id, game_type, fields) with the fields of their kind alone, older names of a field standing in for it."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    known = lambda name, old=None: F.coalesce(F.nullif(field(name), F.lit("")), field(old) if old else F.lit(None), F.lit(""))
    coding = {n: known(n) for n in ("question_text", "buggy_question_text", "function_name", "sample_input", "sample_output", "hidden_tests", "difficulty", "explanation", "buggy_explanation")}
    coding |= {"clean_solution": known("clean_solution", "correct_code"), "code_shown_to_student": known("code_shown_to_student", "buggy_code"), "code_with_bug_fixed": known("code_with_bug_fixed", "buggy_correct_code")}
    other = {n: F.coalesce(field(n), F.lit("")) for n in ("question_text", "difficulty", "explanation")} | {"answer": F.coalesce(field("answer"), field("correct_answer"), F.lit(""))}
    as_map = lambda parts: F.create_map(*[x for k, v in sorted(parts.items()) for x in (F.lit(k), v)])
    return questions.select("id", "game_type", F.when(F.col("game_type") == "coding", as_map(coding)).otherwise(as_map(other)).alias("fields"))


def cleaned_data(questions: DataFrame, column: str = "game_data") -> DataFrame:
    """(question_id, game_data, removed): JSON data without old keys, and the keys that went. An inner rag_context that
    is left empty goes too. Values keep their JSON types."""
    rows = questions.withColumn("data", F.from_json(column, "map<string,variant>"))
    rows = rows.withColumn("inner", F.from_json(F.to_json(F.try_element_at("data", F.lit("rag_context"))), "map<string,variant>"))
    rows = rows.withColumn("kept", F.map_filter("inner", lambda k, _: ~k.isin(*OLD_INNER_KEYS)))
    outer = F.map_filter("data", lambda k, _: ~k.isin(*OLD_KEYS) & ~((k == "rag_context") & F.coalesce(F.size("kept") == 0, F.lit(False))))
    outer = F.transform_values(outer, lambda k, v: F.when((k == "rag_context") & F.col("inner").isNotNull(), F.parse_json(F.to_json("kept"))).otherwise(v))
    none = F.array().cast("array<string>")
    top = F.array_intersect(F.map_keys("data"), F.array(*map(F.lit, OLD_KEYS)))
    nested = F.transform(F.coalesce(F.array_intersect(F.map_keys("inner"), F.array(*map(F.lit, OLD_INNER_KEYS))), none), lambda k: F.concat(F.lit("rag_context."), k))
    return rows.select("question_id", F.to_json(outer).alias("game_data"), F.array_sort(F.concat(F.coalesce(top, none), nested)).alias("removed"))


def deprecated_fields(questions: DataFrame, column: str = "game_data") -> DataFrame:
    """(field, questions): how many questions hold each old key."""
    keys = F.array_intersect(F.json_object_keys(column), F.array(*map(F.lit, OLD_KEYS)))
    return questions.select(F.explode(keys).alias("field")).groupBy("field").agg(F.count("*").alias("questions"))


def playable(questions: DataFrame, game_type: str, subtopics: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Questions of a game in some subtopics that aren't flagged or excluded; outside of coding the answer needs a letter."""
    rows = questions.where((F.col("game_type") == game_type) & ~F.col("flagged")).join(subtopics.select("subtopic_id"), "subtopic_id", "left_semi")
    if game_type != "coding":
        rows = rows.where(F.col("correct_answer").rlike("[A-Za-z]+"))
    return rows if excluded is None else rows.join(excluded.select("question_id"), "question_id", "left_anti")


def set_status(questions: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Questions with a new status where their id is in ``ids``."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    rows = questions.join(ids.select("question_id").distinct().withColumn("_hit", F.lit(True)), "question_id", "left")
    return rows.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def deleted(questions: DataFrame, ids: DataFrame) -> DataFrame:
    return questions.join(ids.select("question_id"), "question_id", "left_anti")


def folded_flags(toggles: DataFrame) -> DataFrame:
    """(question_id, flagged, reason, counts as text) after all of a question's toggles (question_id, at, level, reason) in order.
    Every toggle turns the flag over and counts its level up or, not below 0, down."""
    zero = F.struct(F.lit(False).alias("on"), F.lit(None).cast("string").alias("reason"), *[F.lit(0).alias(n) for n in LEVELS])

    def step(acc: Column, x: Column) -> Column:
        now = ~acc["on"]
        counts = [F.when(x["level"] == n, F.when(now, acc[n] + 1).otherwise(F.greatest(acc[n] - 1, F.lit(0)))).otherwise(acc[n]).alias(n) for n in LEVELS]
        return F.struct(now.alias("on"), F.when(now, F.nullif(x["reason"], F.lit(""))).alias("reason"), *counts)

    rows = F.sort_array(F.collect_list(F.struct("at", "level", "reason")))
    out = toggles.groupBy("question_id").agg(F.aggregate(rows, zero, step).alias("f"))
    return out.select("question_id", F.col("f.on").alias("flagged"), F.col("f.reason").alias("reason"), F.concat_ws(",", *[F.col(f"f.{n}").cast("string") for n in LEVELS]).alias("counts"))


#: Where a regenerated field goes.
MODEL_FIELDS = {"question_text": "question_text", "answer": "correct_answer", "difficulty": "difficulty"}


def apply_accepted(questions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Stored questions with what was accepted of regenerated ones: proposals (question_id, fields: map, accepted: array). Fields
    without a value stay as they are; a clean solution also becomes the answer; what changed is listed and pending."""
    names = F.map_keys(F.map_filter("fields", lambda k, v: v.isNotNull() & F.array_contains("accepted", k)))
    rows = questions.join(proposals.select("question_id", "fields", F.array_sort(names).alias("applied")), "question_id", "left")
    new = lambda f: F.when(F.array_contains("applied", F.lit(f)), F.try_element_at("fields", F.lit(f)))
    return rows.select(
        "question_id", F.coalesce(new("question_text"), F.col("question_text")).alias("question_text"),
        F.coalesce(new("clean_solution"), new("answer"), F.col("correct_answer")).alias("correct_answer"), F.coalesce(new("difficulty"), F.col("difficulty")).alias("difficulty"),
        F.when(F.col("applied").isNotNull(), "pending").otherwise(F.col("status")).alias("status"), F.coalesce(F.array_join("applied", ","), F.lit("")).alias("applied"),
    )


def batch(questions: DataFrame, limit: int, seed: int | None = None) -> DataFrame:
    """The newest questions, or with a seed a random choice that the seed alone decides."""
    order = F.desc("question_id") if seed is None else F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("question_id").cast("string")))
    return questions.orderBy(order, "question_id").limit(limit)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 10, most: int = 100) -> tuple[DataFrame, dict]:
    """One page of a table in an order, and its place: total, page, page_size, has_more."""
    size = max(1, min(size, most))
    total = rows.count()
    start = (max(1, number) - 1) * size
    return rows.orderBy(*order).offset(start).limit(size), {"total": total, "page": number, "page_size": size, "has_more": start + size < total}


def zone_combinations(subtopics: DataFrame, topics: DataFrame) -> DataFrame:
    """(zone_id, size, members as text): single subtopics of a zone in order of id, then as many pairs as half of them and as
    many triples as a third, one at least. Only combinations that the caps can keep are made: in order, all of them begin
    with the zone's first subtopics, so the number of rows grows with the subtopics alone."""
    zone = W.partitionBy("zone_id")
    rows = subtopics.join(topics.select("topic_id", "zone_id"), "topic_id").select("zone_id", "subtopic_id", F.row_number().over(zone.orderBy("subtopic_id")).alias("i"), F.count("*").over(zone).alias("n"))
    single = rows.select("zone_id", F.lit(1).alias("size"), F.col("subtopic_id").cast("string").alias("members"))
    cap = lambda k: F.greatest(F.lit(1), F.floor(F.col("n") / k))
    first = lambda i: rows.where(F.col("i") == i).select("zone_id", F.col("subtopic_id").alias(f"s{i}"))
    # pair k in order is (1, k + 1) and triple k is (1, 2, k + 2), as the caps are below the number of those
    pairs = rows.join(first(1), "zone_id").where((F.col("i") > 1) & (F.col("i") - 1 <= cap(2)))
    pairs = pairs.select("zone_id", F.lit(2).alias("size"), F.concat_ws(",", F.col("s1").cast("string"), F.col("subtopic_id").cast("string")).alias("members"))
    triples = rows.join(first(1), "zone_id").join(first(2), "zone_id").where((F.col("i") > 2) & (F.col("i") - 2 <= cap(3)))
    triples = triples.select("zone_id", F.lit(3).alias("size"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("s1", "s2", "subtopic_id")]).alias("members"))
    return single.unionByName(pairs).unionByName(triples)


#: Members of a combination at most, by difficulty.
COMBINED = {"beginner": 1, "intermediate": 2, "advanced": 3, "master": 3}


def smart_combinations(subtopics: DataFrame, topics: DataFrame, difficulty: str | None = None, most: int | None = None) -> DataFrame:
    """(zone_id, place, members array): a zone's subtopics in order of id, then half as many pairs and a third as many triples, as far as
    the difficulty allows. Pairs of one topic come first, topic by topic in the order of their first subtopics, then pairs of the
    first subtopics of two topics; triples go over the whole zone. ``most``: combinations of a zone at most.

    The k-th pair of g things in order is worked out from k, so only the pairs that are kept are made, and rows grow with the
    subtopics alone."""
    allowed = COMBINED.get(difficulty, 3)
    zone, topic = W.partitionBy("zone_id"), W.partitionBy("zone_id", "topic_id")
    own = subtopics.select("subtopic_id", "topic_id").distinct().join(topics.select("topic_id", "zone_id"), "topic_id")
    rows = own.select("zone_id", "topic_id", "subtopic_id", (F.row_number().over(zone.orderBy("subtopic_id")) - 1).alias("i"), (F.row_number().over(topic.orderBy("subtopic_id")) - 1).alias("k"), F.count("*").over(zone).alias("n"))
    out = rows.select("zone_id", F.lit(1).alias("size"), F.col("i").cast("bigint").alias("at"), F.array("subtopic_id").alias("members"))
    if allowed >= 2:
        groups = rows.groupBy("zone_id", "topic_id").agg(F.min("i").alias("first"), F.min("subtopic_id").alias("subtopic_id"), F.count("*").alias("g"), F.first("n").alias("n"))
        groups = groups.withColumn("pairs", F.expr("g * (g - 1) div 2")).withColumn("place", F.row_number().over(zone.orderBy("first")) - 1)
        groups = groups.withColumn("before", F.coalesce(F.sum("pairs").over(zone.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        groups = groups.withColumn("all_pairs", F.sum("pairs").over(zone)).withColumn("m", F.count("*").over(zone)).withColumn("cap", F.expr("n div 2"))
        take = groups.select("zone_id", "topic_id", "g", "before", F.least("pairs", F.col("cap") - F.col("before")).alias("take")).where("take > 0")
        same = unranked(take.select("zone_id", "topic_id", "before", "g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("take") - 1)).alias("r")), "g", "r")
        member = lambda k: rows.select("zone_id", "topic_id", F.col("k").alias(k), F.col("subtopic_id").alias(f"m{k}"))
        same = same.join(member("x"), ["zone_id", "topic_id", "x"]).join(member("y"), ["zone_id", "topic_id", "y"]).select("zone_id", (F.col("before") + F.col("r")).alias("at"), F.array("mx", "my").alias("members"))
        left = groups.where("place = 0").select("zone_id", "m", "all_pairs", F.least(F.col("cap") - F.col("all_pairs"), F.expr("m * (m - 1) div 2")).alias("take")).where("take > 0")
        cross = unranked(left.select("zone_id", "m", "all_pairs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("take") - 1)).alias("r")), "m", "r")
        first = lambda k: groups.select("zone_id", F.col("place").alias(k), F.col("subtopic_id").alias(f"m{k}"))
        cross = cross.join(first("x"), ["zone_id", "x"]).join(first("y"), ["zone_id", "y"]).select("zone_id", (F.col("all_pairs") + F.col("r")).alias("at"), F.array("mx", "my").alias("members"))
        out = out.unionByName(same.unionByName(cross).withColumn("size", F.lit(2)))
    if allowed >= 3:  # a third of the subtopics is less than the triples that begin with the first two
        first = lambda i: rows.where(F.col("i") == i).select("zone_id", F.col("subtopic_id").alias(f"s{i}"))
        third = rows.where((F.col("i") >= 2) & (F.col("i") - 2 < F.expr("n div 3"))).join(first(0), "zone_id").join(first(1), "zone_id")
        out = out.unionByName(third.select("zone_id", F.lit(3).alias("size"), (F.col("i") - 2).cast("bigint").alias("at"), F.array("s0", "s1", "subtopic_id").alias("members")))
    out = out.withColumn("place", F.row_number().over(zone.orderBy("size", "at")).cast("bigint"))
    return out.where(F.col("place") <= most if most else F.lit(True)).select("zone_id", "place", "members")


def unranked(rows: DataFrame, size: str, rank: str) -> DataFrame:
    """Adds x < y, the pair of that rank (from 0) of ``size`` things in order."""
    g, r = F.col(size).cast("double"), F.col(rank).cast("double")
    guess = F.floor((2 * g - 1 - F.sqrt((2 * g - 1) * (2 * g - 1) - 8 * r)) / 2)
    begins = lambda x: F.expr(f"({x} * (2 * {size} - {x} - 1)) div 2")
    rows = rows.withColumn("_x", guess)
    rows = rows.withColumn("x", F.when(begins("_x") > F.col(rank), F.col("_x") - 1).when(begins("(_x + 1)") <= F.col(rank), F.col("_x") + 1).otherwise(F.col("_x")).cast("int"))  # the root may be rounded
    return rows.withColumn("y", (F.col(rank) - begins("x") + F.col("x") + 1).cast("int")).drop("_x")


def question_budget(combinations: Column, subtopics: Column, each: int) -> Column:
    """Questions for each combination: their share of ``each`` a subtopic, one at least; none without combinations."""
    return F.when(combinations > 0, F.greatest(F.lit(1), F.floor(subtopics * each / combinations))).otherwise(F.lit(0)).cast("bigint")


def backfilled(subtopics: DataFrame) -> DataFrame:
    """Subtopics with a slug where there is none, and intents from a template (fixed texts) where they are empty."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    filled = lambda c, before, after: F.when(empty(c), F.concat(F.lit(before), F.lower("name"), F.lit(after))).otherwise(F.col(c))
    return subtopics.select(
        "subtopic_id", F.coalesce("slug", slugify(F.col("name"))).alias("slug"),
        filled("concept_intent", "Learn about ", " concepts and fundamentals.").alias("concept_intent"), filled("code_intent", "Practice ", " with hands-on coding examples.").alias("code_intent"),
    )


def in_parts(mastery: DataFrame) -> DataFrame:
    """Mastery rows with their ``part``: low, mid or high where weak (under 90), review under 100, else maintenance."""
    m = F.round("mastery", 9)
    part = F.when(m < 50, "low").when(m < 85, "mid").when(m < 90, "high").when(m < 100, "review").otherwise("maintenance")
    return mastery.select("user_id", "subtopic_id", "mastery", part.alias("part"))


def in_zones(zones: DataFrame, subtopics: DataFrame, lists: DataFrame) -> DataFrame:
    """One row for each user: user_id, ``ids`` (all subtopics of their zone) and the columns of ``lists`` (user_id, zone_id, ...), null
    where that has no row. A user's catalogue is the zone's, so it is kept once a zone and meets the users where they lie: tables with
    a row for each user and subtopic are made by unfolding ``ids`` in the tasks that write them, and are never shuffled.
    zones: (user_id, zone_id), one of each user; subtopics: (zone_id, subtopic_id)."""
    ids = subtopics.groupBy("zone_id").agg(F.sort_array(F.collect_list(F.struct("subtopic_id")))["subtopic_id"].alias("ids"))  # a row a zone
    tasks = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = zones.join(lists, ["user_id", "zone_id"], "left").repartition(tasks, "user_id")  # rows are few before they unfold, so their bytes say nothing of the work
    return rows.join(F.broadcast(ids), "zone_id")


def band_rows(mastery: DataFrame, zones: DataFrame, subtopics: DataFrame) -> DataFrame:
    """(user_id, subtopic_id, band, part) for each subtopic of each user's zone: weak under 90 or without a row, in the parts low, mid
    and high; review under 100; else maintenance. zones: (user_id, zone_id); subtopics: (zone_id, subtopic_id)."""
    above = in_parts(mastery).where("part <> 'low'").join(F.broadcast(subtopics), "subtopic_id")
    lists = above.groupBy("user_id", "zone_id").agg(F.collect_list(F.struct("subtopic_id", "part")).alias("above"))
    lists = lists.select("user_id", "zone_id", F.col("above.subtopic_id").alias("above"), F.col("above.part").alias("parts"))
    rows = in_zones(zones, subtopics, lists).select("user_id", "above", "parts", F.explode("ids").alias("subtopic_id"))
    part = F.coalesce(F.get("parts", (F.array_position("above", F.col("subtopic_id")) - 1).cast("int")), F.lit("low"))
    rows = rows.select("user_id", "subtopic_id", part.alias("part"))
    return rows.select("user_id", "subtopic_id", F.when(F.col("part").isin("low", "mid", "high"), "weak").otherwise(F.col("part")).alias("band"), "part")


def band_union(zones: DataFrame, subtopics: DataFrame, seen: DataFrame) -> DataFrame:
    """(user_id, subtopic_id): each subtopic of each user's zone once, without those ``seen`` (user_id, subtopic_id). Weak, review and
    maintenance hold every subtopic of the zone between them, so the union of the bands needs no mastery."""
    lists = seen.join(F.broadcast(subtopics), "subtopic_id").groupBy("user_id", "zone_id").agg(F.collect_set("subtopic_id").alias("seen"))
    left = F.array_except("ids", F.coalesce("seen", F.array().cast("array<bigint>")))
    return in_zones(zones, subtopics, lists).select("user_id", F.explode(left).alias("subtopic_id"))
