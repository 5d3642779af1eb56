"""The texts that a generation gets for subtopics: chunks of ranked lists, sorted by how hard their documents are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions import text as rules

LIST_TOP, OTHER_TOP, LEAST_SIMILARITY, TOLD = 15, 7, 0.5, 5
#: Which documents' difficulties are used as they are, and which have to be simplified, for each target.
POOLS = {
    "beginner": (("beginner",), ("intermediate", "advanced", "master")),
    "intermediate": (("beginner", "intermediate"), ("advanced", "master")),
    "advanced": (("intermediate", "advanced"), ("master",)),
    "master": (("advanced", "master"), ()),
}
#: The wording of the texts.
PRIMARY_HEAD = "PRIMARY REFERENCES (target difficulty — use as-is):\n"
SUPPLEMENTARY_HEAD = "SUPPLEMENTARY REFERENCES (above target — SIMPLIFY before using):\n"
CONTENT_HEAD = "LEARNING CONTENT:"
NO_RANKING = "No semantic analysis available"
PLAIN_GUIDANCE = "TARGET DIFFICULTY: {Target}\n\nGUIDANCE:\n- All references match the target difficulty — use them directly\n- Keep questions consistent with the {target} level"
MIXED_GUIDANCE = (
    'TARGET DIFFICULTY: {Target}\n\nGUIDANCE:\n- Primary references are chunks tagged "{Target}"\n- Chunks from {higher} are supplementary and should be SIMPLIFIED in your output\n'
    "- Do NOT introduce concepts beyond {target} level\n- If a chunk uses advanced terminology, translate it to {target}-friendly language"
)


def guidance(difficulty: Column, mixed: Column) -> Column:
    """How to use the references of a target difficulty; mixed: whether some are above it."""
    out = F.lit(PLAIN_GUIDANCE.format(Target="Target", target=""))
    for target, (_, higher) in POOLS.items():
        names = {"Target": target.capitalize(), "target": target, "higher": ", ".join(f'"{h.capitalize()}"' for h in higher)}
        both = F.when(mixed, MIXED_GUIDANCE.format(**names)).otherwise(PLAIN_GUIDANCE.format(**names)) if higher else F.lit(PLAIN_GUIDANCE.format(**names))
        out = F.when(F.lower(difficulty) == target, both).otherwise(out)
    return out


def in_pool(difficulty: Column, document: Column, supplementary: bool) -> Column:
    """Whether a document's difficulty is in a target's pool: all of it, or its supplementary part. Other targets take every difficulty as primary."""
    found = F.lit(False) if supplementary else document.isin(*POOLS)
    for target, (first, second) in POOLS.items():
        allowed = second if supplementary else first + second
        found = F.when(difficulty == target, document.isin(*allowed) if allowed else F.lit(False)).otherwise(found)
    return F.coalesce(found, F.lit(False))


def junk_detail(text: Column, title: Column) -> Column:
    """Why a chunk is left out, in words; null if it isn't."""
    bare, name = F.trim(text), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    low = F.lower(bare)
    reason = rules.junk_reason(text, title)
    hits = F.floor((F.length(low) - F.length(F.replace(low, name, F.lit("")))) / F.length(name))
    return (
        F.when(reason == "empty", "empty text")
        .when(reason == "short", F.concat(F.lit("too short ("), F.length(bare), F.lit(" < 200)")))
        .when(reason == "title", F.concat(F.lit("title '"), name, F.lit("' repeated "), hits, F.lit("x at high density")))
        .when(reason.isNotNull(), F.concat(F.lit("matched junk marker: '"), F.substring(reason, 9, 100), F.lit("'")))
    )


def listed_chunks(wanted: DataFrame, ranked: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(wanted columns, at, chunk_id): of the list that a game type reads first the ``LIST_TOP`` best from a least similarity on, or if there is none,
    the ``OTHER_TOP`` best of the other list. ranked: (owner_id, list, rank, chunk_id, similarity), list: code or concept."""
    place = F.row_number().over(W.partitionBy("owner_id", "list").orderBy("rank", "chunk_id"))  # a list's own entries
    best = ranked.where(F.col("similarity") >= least).withColumn("at", place).where(F.col("at") <= LIST_TOP)
    sizes = best.groupBy("owner_id").agg(F.count_if(F.col("list") == "code").alias("n_code"), F.count_if(F.col("list") == "concept").alias("n_concept"))
    coding = F.col("game_type") == "coding"
    first = F.when(coding, "code").otherwise("concept")
    empty = F.when(coding, F.col("n_code")).otherwise(F.col("n_concept")) == 0
    other = F.when(coding, "concept").otherwise("code")
    rows = wanted.join(sizes, "owner_id").withColumn("list", F.when(empty, other).otherwise(first)).withColumn("_top", F.when(empty, OTHER_TOP).otherwise(LIST_TOP))
    return rows.join(best.select("owner_id", "list", "at", "chunk_id"), ["owner_id", "list"]).where("at <= _top").select(*wanted.columns, "at", "chunk_id")


def retrieval_contexts(wanted: DataFrame, names: DataFrame, ranked: DataFrame, chunks: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(owner_id, difficulty, game_type, kept, supplementary, content, context): the text for each row of wanted (owner_id, difficulty, game_type).

    names: (owner_id, name, topic). chunks: (chunk_id, chunk_type, text, title, document_difficulty). Chunks whose document is in the target's pool
    are taken, or all where none is; junk is left out. Where nothing is ranked, similar enough or kept, a short text says so.
    content: the references alone, null in such a text. Texts travel once, after the lists have been cut; an owner's text is of 15 chunks at most."""
    keys = ["owner_id", "difficulty", "game_type"]
    rows = listed_chunks(wanted, ranked, least).join(chunks, "chunk_id")
    level = F.lower(F.coalesce("document_difficulty", F.lit("")))
    rows = rows.withColumn("_allowed", in_pool(F.col("difficulty"), level, False)).withColumn("_above", in_pool(F.col("difficulty"), level, True))
    kind = F.coalesce("chunk_type", F.lit("Content"))
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    entry = F.concat(F.lit("--- "), kind, F.lit(" [difficulty: "), F.when(level == "", "unknown").otherwise(level), F.lit("] ---\n"), bare, F.lit("\nDocument: "), F.coalesce("title", F.lit("")))
    rows = rows.withColumn("_why", junk_detail(F.col("text"), F.col("title")))
    part = F.struct("at", "chunk_id", entry.alias("entry"), F.coalesce("chunk_type", F.lit("Unknown")).alias("kind"), F.col("_why").alias("why"), F.col("_above").alias("above"), F.col("_allowed").alias("allowed"))
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("all"))  # 15 at most
    found = found.withColumn("parts", F.when(F.exists("all", lambda p: p["allowed"]), F.filter("all", lambda p: p["allowed"])).otherwise(F.col("all")))
    good = F.filter("parts", lambda p: p["why"].isNull())
    entries = lambda above: F.transform(F.filter("good", lambda p: p["above"] == above), lambda p: p["entry"])
    found = found.withColumn("good", good).withColumn("first", entries(False)).withColumn("second", entries(True))
    section = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, "\n\n")))
    found = found.withColumn("content", F.concat_ws("\n\n", section(PRIMARY_HEAD, "first"), section(SUPPLEMENTARY_HEAD, "second")))
    every = wanted.join(names, "owner_id").join(ranked.select("owner_id").distinct().withColumn("_ranked", F.lit(True)), "owner_id", "left").join(found, keys, "left")
    head = F.concat(F.lit("Topic: "), F.col("topic"), F.lit("\nSubtopic: "), F.col("name"), F.lit("\nGame Type: "), F.col("game_type"))
    kept, above = F.coalesce(F.size("good"), F.lit(0)), F.coalesce(F.size("second"), F.lit(0))
    junk = F.filter("parts", lambda p: p["why"].isNotNull())
    details = F.array_join(F.transform(F.slice(junk, 1, TOLD), lambda p: F.concat(F.lit("id="), p["chunk_id"], F.lit(": "), p["why"])), "; ")
    reason = (
        F.when(F.col("_ranked").isNull(), NO_RANKING)
        .when(F.col("parts").isNull(), F.concat(F.lit("No relevant "), F.col("game_type"), F.lit(" chunks found above similarity threshold")))
        .otherwise(F.concat(F.lit("All "), F.size(junk), F.lit(" retrieved chunks rejected as junk ("), details, F.lit(")")))
    )
    stub = F.concat(head, F.lit("\n\n"), reason, F.lit(".\nPlease generate "), F.col("game_type"), F.lit(" questions based on the subtopic name and general Python knowledge."))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("good", lambda p: p["kind"]))), ", ")
    full = F.concat(
        head, F.lit("\nTarget Difficulty: "), F.col("difficulty"), F.lit("\nContent Types Found: "), kinds, F.lit("\nRetrieved Chunks: "), kept, F.lit(" (primary="), kept - above, F.lit(", supplementary="), above, F.lit(")\n\n"),
        guidance(F.col("difficulty"), above > 0), F.lit(f"\n\n{CONTENT_HEAD}\n"), F.col("content"),
    )
    some = kept > 0
    return every.select(*keys, kept.cast("bigint").alias("kept"), above.cast("bigint").alias("supplementary"), F.when(some, F.col("content")).alias("content"), F.when(some, full).otherwise(stub).alias("context"))


def combined_contexts(combinations: DataFrame, contexts: DataFrame, names: DataFrame) -> DataFrame:
    """(combination, difficulty, game_type, context): one text for each combination (combination, place, owner_id) of subtopics, from the texts of
    ``retrieval_contexts``; members without references bring the short text that says so."""
    member = F.concat(F.lit("=== "), F.col("name"), F.lit(" ===\n"), F.coalesce(F.trim("content"), F.col("context")))
    rows = combinations.join(names.select("owner_id", "name"), "owner_id").join(contexts, "owner_id")
    part = F.struct("place", F.col("name").alias("name"), member.alias("text"), (F.col("supplementary") > 0).alias("above"))
    found = rows.groupBy("combination", "difficulty", "game_type").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # two or three members
    text = F.concat(
        F.lit("GAME TYPE: "), F.upper("game_type"), F.lit("\nDIFFICULTY LEVEL: "), F.upper("difficulty"), F.lit("\nSUBTOPIC COMBINATION: "), F.array_join(F.transform("parts", lambda p: p["name"]), " + "), F.lit("\n\n"),
        guidance(F.col("difficulty"), F.exists("parts", lambda p: p["above"])), F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"),
    )
    return found.select("combination", "difficulty", "game_type", text.alias("context"))
