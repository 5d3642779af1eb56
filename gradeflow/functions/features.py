"""What a chunk holds, as one record for retrieval and for prompts: title, section, kind, concepts, keywords, examples and exercises.

Terms are found in one scan of the text each for concepts and keywords, by patterns that give every occurrence, and ranked by how
often the chunk has them, then by their order in the list (concepts) or the alphabet (keywords).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeflow.functions.code import once

#: Forms of a numbered title with what its text begins with, the first that fits.
SECTIONS = (
    (r"^(\d+\.\d+)\s*Challenge:\s*(.+?)(?:\s*[\.\s]*)?$", "Challenge: "), (r"^(\d+\.\d+)\s*(?:Review\s*)?Exercise(?:s)?:\s*(.+?)(?:\s*[\.\s]*)?$", "Exercises: "),
    (r"^(\d+\.\d+)\s*(.+?)(?:\s*[\.\s]*)?$", ""), (r"^(\d+)\s*(.+?)(?:\s*[\.\s]*)?$", ""),
)
#: What is taken out of a text, in order.
CLEANUP = (
    (r"\n{3,}", "\n\n"), (r"\.{3,}", ""), (r"\s+", " "), (r"(?m)^\s+|\s+$", ""), (r"https?://[^\s]+", ""), (r"www\.[^\s]+", ""), (r"\S+\.com[^\s]*", ""), (r"realpython\.com[^\s]*", ""),
    (r"(?m)\s+\d{1,3}\s*$", ""), (r"(?m)^\s*\d{1,3}\s*$", ""), (r"\s+\d{1,3}\s*\n", "\n"),
)
TITLE_CLEANUP = ((r"[\.\s]*\.[\.\s]*", ""), (r"[\.\s]+$", ""), (r"\s+", " "))
#: Programming terms, words of a keyword, signs of a kind of text.
CONCEPTS = (
    "input()", "print()", "string", "variable", "method", "function", "uppercase", "lowercase", "concatenation", "indexing", "slicing", "loop", "if statement", "else", "while", "for", "list", "dictionary",
    "tuple", "class", "object", "module", "package", "import",
)
KEYWORDS = ("python", "input", "string", "method", "function", "variable", "print", "user", "interactive", "programming", "code", "exercise")
KINDS = (("challenge", ("challenge",)), ("exercises", ("exercise",)), ("tutorial_with_code", (">>>", "python")), ("concept_explanation", ("method", "function")))
POINTS = ("Interactive programming concepts", "String manipulation techniques", "Practical coding exercises", "Development environment usage")
MOST_CONCEPTS, MOST_KEYWORDS, MOST_EXAMPLES, LEAST_EXERCISE = 6, 8, 5, 21


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def title_and_section(title: Column) -> Column:
    """struct(title, section) of a title from a table of contents; section is empty where it has no number."""

    def read(t: Column) -> Column:
        found = [F.when(t.rlike(p), F.struct(F.concat(F.lit(before), strip(F.regexp_extract(t, p, 2))).alias("title"), F.regexp_extract(t, p, 1).alias("section"))) for p, before in SECTIONS]
        plain = F.struct(F.regexp_replace(t, r"^\.?\d+(\.\d+)?\.?\s*", "").alias("title"), F.lit("").alias("section"))
        return F.coalesce(*found, plain)

    return once(once(strip(F.coalesce(title, F.lit(""))), read), lambda x: F.struct(strip(replaced(x["title"], TITLE_CLEANUP)).alias("title"), x["section"].alias("section")))


def clean_content(text: Column) -> Column:
    return strip(replaced(F.coalesce(text, F.lit("")), CLEANUP))


def framed(content: Column) -> Column:
    """A cleaned text, which is one paragraph, with code fenced and an exercise marked; empty if it is a number alone or a contents line."""
    p = F.regexp_replace(content, r"\s+\d{1,3}$", "")
    gone = (content == "") | content.rlike(r"^\d+(\.\d+)?\s*$") | content.rlike(r"^\d+(\.\d+)?\s+[A-Z].*\.{3,}")
    exercise = F.concat(F.lit("**Exercise "), F.substring(p, 1, 1), F.lit(":** "), F.substring(p, 3, 1 << 30))
    return F.when(gone, "").when(p.contains(">>>"), F.concat(F.lit("```python\n"), p, F.lit("\n```"))).when(p.rlike(r"^\d+\.\s"), exercise).otherwise(p)


def ranked(found: Column, order: Column | None = None) -> Column:
    """Distinct terms of an array, those that stand in it most often first, then by their place in ``order``, or else by the alphabet."""
    place = (lambda x: F.array_position(order, x)) if order is not None else (lambda x: F.lit(0).cast("bigint"))
    counts = F.transform(F.array_distinct(found), lambda x: F.struct((-F.size(F.filter(found, lambda y: y == x))).alias("n"), place(x).alias("at"), x.alias("term")))
    return F.transform(F.array_sort(counts), lambda x: x["term"])


def concepts(content: Column) -> Column:
    terms = "|".join(rf"\Q{t}\E" for t in CONCEPTS)
    return once(F.regexp_extract_all(F.lower(content), F.lit(f"(?=({terms}))"), F.lit(1)), lambda found: ranked(found, F.array(*map(F.lit, CONCEPTS))))


def keywords(title: Column, content: Column) -> Column:
    own = F.regexp_extract_all(F.lower(title), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    tech = F.regexp_extract_all(F.lower(content), F.lit(r"\b(?:" + "|".join(KEYWORDS) + r")\b"), F.lit(0))
    return once(F.concat(own, tech), lambda found: ranked(found))


def chunk_features(title: Column, text: Column, page: Column) -> Column:
    """struct(clean_title, section_number, content_type, concepts, keywords, code_examples, exercises, page_number, text_length, improved,
    content) of a chunk. A text that begins with a numbered heading is its own title. Null titles and texts count as empty."""

    def judge(x: Column) -> Column:
        content, body, low = x["content"], x["body"], F.lower(x["body"])
        heading = F.when(content.rlike(r"^\d+\.\d*\s*[A-Z]"), strip(F.regexp_replace(content, r"\s*\d+\s*$", "")))
        name = F.coalesce(heading, x["own"]["title"])
        kind = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [low.contains(s) for s in signs]), k) for k, signs in KINDS], F.lit("instructional_text"))
        hits = lambda p: F.filter(F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(1)), strip), lambda m: m != "")
        examples = [r"(?s)```python\n(.*?)\n```", r"(?sm)>>> (.+?)(?:\n|$)", r"(?sm)(?:^|\n)([a-zA-Z_][a-zA-Z0-9_]*\s*=.*?)(?:\n|$)"]
        n = reduce(lambda a, b: a + b, [F.size(hits(p)) for p in examples])
        exercises = F.filter(hits(r"(?s)(?:^|\n)\s*(\d+\.\s*.+?)(?=\n\s*\d+\.|$)"), lambda m: F.length(m) >= LEAST_EXERCISE)
        return F.struct(
            name.alias("clean_title"), x["own"]["section"].alias("section_number"), kind.alias("content_type"), F.array_join(F.slice(concepts(body), 1, MOST_CONCEPTS), " ").alias("concepts"),
            F.slice(keywords(name, body), 1, MOST_KEYWORDS).alias("keywords"), F.least(n, F.lit(MOST_EXAMPLES)).alias("code_examples"), F.size(exercises).alias("exercises"),
            (page + 1).alias("page_number"), F.length(content).alias("text_length"), (F.length(content) != F.length(F.coalesce(text, F.lit("")))).alias("improved"), content.alias("content"),
        )

    cleaned = once(clean_content(text), lambda c: F.struct(c.alias("content"), framed(c).alias("body"), title_and_section(title).alias("own")))
    return once(cleaned, judge)


def prompt_record(chunk_id: Column, features: Column) -> Column:
    """JSON of the record that a prompt gets, from ``chunk_features``."""
    points = "\n".join(f"- {p}" for p in POINTS)
    context = F.concat(F.lit("CONTENT:\n"), features["content"], F.lit(f"\n\nKEY LEARNING POINTS:\n{points}"))
    meta = F.struct(features["text_length"].alias("text_length"), F.lit(True).alias("optimized"), F.lit("toc_chunk_processor").alias("source"))
    return F.to_json(F.struct(
        F.concat(F.lit("chunk_"), chunk_id).alias("id"), features["clean_title"].alias("title"), context.alias("content"), features["page_number"].alias("page"), features["content_type"].alias("type"),
        features["concepts"].alias("concepts"), features["keywords"].alias("keywords"), features["code_examples"].alias("code_examples_count"), features["exercises"].alias("exercises_count"), meta.alias("metadata"),
    ))
