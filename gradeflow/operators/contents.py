"""Tables of contents read from the text of a book's first pages.

Pages are judged one by one in the JVM, and the lines of a book's contents by a fold that looks at most ten lines ahead. A
book's contents are at most ``FIRST_PAGES`` pages, which is what one row holds; books are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Signs of a page of contents, and titles that are no entries.
KEYWORDS = ("contents", "table of contents", "toc", "chapters", "sections")
META_TITLES = ("foreword", "preface", "introduction", "why this book", "about", "acknowledgments", "contents", "table of contents", "toc", "index", "chapters", "sections", "overview")
TOP_WORDS = ("chapter", "part", "section", "unit", "module")
SECOND_WORDS = ("exercise", "example", "practice", "problem")
#: Level of a title by how it is numbered, the first that fits.
NUMBERED = ((3, r"^\s*\d+\.\d+\.\d+\.\d+"), (2, r"^\s*\d+\.\d+\.\d+"), (1, r"^\s*\d+\.\d+"), (0, r"^\s*\d+\.?\s"), (0, r"^\s*[A-Z]\.\s"), (1, r"^\s*[a-z]\.\s"), (0, r"^\s*[IVX]+\.\s"))
FIRST_PAGES, AHEAD, LEAST_ENTRIES, LONGEST_TITLE = 15, 10, 3, 250

_ENTRY = "struct<title:string,page:bigint,level:int>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_meta(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(" + "|".join(META_TITLES) + r")\b")


def contents_pages(pages: DataFrame) -> DataFrame:
    """The rows of (document, page, text) that hold contents. pages are numbered from 0; the first ``FIRST_PAGES`` count, those of less than
    ten characters aside. Contents begin at a page with a keyword, or with two of: many numbers, dot leaders, numbered lines. They go
    on while pages have a keyword or, in smaller number, one of these. Books without such a page have no row."""
    text = F.coalesce("text", F.lit(""))
    n = lambda p: F.regexp_count(text, F.lit(p))
    numbers, dots, numbered = n(r"\b\d{1,3}\b"), n(r"\.{2,}"), n(r"(?m)^\s*\d+\.?\d*\s+[A-Za-z]")
    named = F.exists(F.array(*map(F.lit, KEYWORDS)), lambda k: F.lower(text).contains(k))
    strong = (numbers > 8).cast("int") + (dots > 3).cast("int") + (numbered > 2).cast("int") >= 2
    rows = pages.where(F.col("page").between(0, FIRST_PAGES - 1) & (F.length(strip(text)) >= 10))
    rows = rows.withColumn("_starts", named | strong).withColumn("_goes_on", named | (numbers > 5) | (dots > 2) | (numbered > 1))
    book = W.partitionBy("document")
    rows = rows.withColumn("_first", F.min(F.when(F.col("_starts"), F.col("page"))).over(book))
    rows = rows.withColumn("_stop", F.min(F.when((F.col("page") > F.col("_first")) & ~F.col("_goes_on"), F.col("page"))).over(book))
    kept = (F.col("page") >= F.col("_first")) & (F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))
    return rows.where(kept).select(*pages.columns)


def _cleaned(title: Column) -> Column:
    bare = strip(F.regexp_replace(title, r"^\.+|\.+$", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"\s*\.{2,}\s*", " "), r"\s+", " ")


def title_level(title: Column) -> Column:
    """0 to 3: by a title's numbering, else by its words."""
    low = F.lower(title)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    cases = [(title.rlike(p), level) for level, p in NUMBERED] + [(has(TOP_WORDS), 0), (has(SECOND_WORDS), 1)]
    return F.coalesce(*[F.when(hit, F.lit(level)) for hit, level in cases], F.lit(0))


def text_entries(text: Column, next_line_too: bool = False) -> Column:
    """array<struct(title, page, level)> of a contents text. An entry is a line with dot leaders and a page, or a line with the ones that
    follow it up to a page number of its own line, ten lines on at most. Numbers alone, metadata titles, titles of less than
    three characters and those of dots are no entries. As in the service that is rebuilt, the line that follows one with dot leaders is
    passed over; ``next_line_too`` reads it. Pages count from 0; a page number beyond a long ends no entry."""
    digits = lambda x: x.rlike(r"^[0-9]+$")

    def read(s: Column, k: Column, lines: Column) -> Column:
        line = F.get(lines, k - 1)
        ahead = F.slice(lines, k + 1, F.lit(AHEAD))
        leader = r"^(.+?)\s*\.{2,}\s*(\d{1,4})\s*$"
        dotted = line.rlike(leader)
        at = F.array_position(F.transform(ahead, lambda x: digits(x) & x.rlike("[1-9]") & x.try_cast("bigint").isNotNull()), True)
        more = F.filter(F.slice(ahead, 1, F.greatest(at - 1, F.lit(0)).cast("int")), lambda x: (x != "") & ~digits(x))
        title = _cleaned(F.when(dotted, strip(F.regexp_extract(line, leader, 1))).otherwise(F.array_join(F.concat(F.array(line), more), " ")))
        page = F.when(dotted, F.regexp_extract(line, leader, 2).try_cast("bigint")).otherwise(F.get(ahead, (at - 1).cast("int")).try_cast("bigint"))
        skipped = (F.length(line) < 2) | digits(line) | is_meta(line)
        found = ~skipped & (dotted | (at > 0))
        dots = F.length(title) - F.length(F.replace(title, F.lit("."), F.lit("")))
        good = found & (F.length(title) >= 3) & (dots <= F.length(title) * 0.5) & ~is_meta(title)
        entry = F.struct(F.substring(title, 1, LONGEST_TITLE).alias("title"), (page - 1).alias("page"), title_level(title).cast("int").alias("level")).cast(_ENTRY)
        step = F.when(found & dotted, F.lit(1 if next_line_too else 2)).when(found, at + 1).otherwise(1)
        return F.struct((k + step).cast("int").alias("next"), F.when(good, F.array_append(s["out"], entry)).otherwise(s["out"]).alias("out"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    start = F.struct(F.lit(1).alias("next"), F.array().cast(f"array<{_ENTRY}>").alias("out"))
    fold = lambda ls: F.aggregate(F.sequence(F.lit(1), F.size(ls)), start, lambda s, k: F.when(k == s["next"], read(s, k, ls)).otherwise(s))["out"]
    return F.get(F.transform(F.array(lines), fold), F.lit(0))


def toc_parse(pages: DataFrame, next_line_too: bool = False) -> DataFrame:
    """(document, place, title, start_page, level) of each book whose contents have ``LEAST_ENTRIES`` entries or more: by page, entries of a page
    as they stand; no level is more than one below the entry before. pages: (document, page, text)."""
    parts = F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    whole = contents_pages(pages).groupBy("document").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    found = whole.select("document", text_entries(F.col("text"), next_line_too).alias("entries")).where(F.size("entries") >= LEAST_ENTRIES)
    rows = found.select("document", F.posexplode("entries").alias("at", "e")).select("document", "at", "e.*")
    by_page = W.partitionBy("document").orderBy("page", "at")  # a book's entries, which one row has held
    rows = rows.withColumn("place", F.row_number().over(by_page))
    allowed = F.min(F.col("level") - F.col("place")).over(by_page.rowsBetween(W.unboundedPreceding, 0)) + F.col("place")
    return rows.select("document", (F.col("place") - 1).cast("bigint").alias("place"), "title", F.col("page").alias("start_page"), allowed.cast("bigint").alias("level"))
