"""Rules over texts of chunks and questions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the raw cleaner takes out, in order: pattern and what stands for it. U+200B is the zero-width space of some PDFs.
URLS = (
    (r"https?://[^\s]+", ""), (r"https?:/[^\s]*", ""), (r"www\.[^\s]+", ""), (r"[a-zA-Z0-9.-]+\.(com|org|net|edu|gov|io)[^\s]*", ""),
    ("https?:/\u200b/\u200b[^\\s]*", ""), ("[a-zA-Z0-9.-]+\\.\u200b[a-zA-Z0-9.-]+[^\\s]*", ""), ("/\u200b[a-zA-Z0-9._-]+/[^\\s]*", ""), (r"/[a-zA-Z0-9._-]+/[a-zA-Z0-9._/-]*", ""),
    ("[a-zA-Z0-9.-]+\\.\u200b[a-zA-Z]+", ""), (r"github\.com[^\s]*", ""), (r"PacktPublishing[^\s]*", ""), ("Expert-\u200bPython[^\\s]*", ""), ("/\u200btree/\u200b[^\\s]*", ""), ("/\u200bmaster/\u200b[^\\s]*", ""),
    ("https:/\u200b/\u200b\\s*for\\s+this\\s+chapter", "for this chapter"), ("https:/\u200b/\u200b\\s*", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
)
RAW = (
    (r"\[\s*\d+\s*\]", ""), (r"(?i)\[\s*\d+\s*\]\s*.{0,60}Chapter\s+\d+", ""), (r"(?m)^Chapter\s+\d+\s*$", ""), *URLS,
    (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\[\d+\]", ""), (r"(?i)Page \d+ of \d+", ""), (r"(?m)^\d+$", ""), (r"(?i)Copyright.*", ""), (r"(?i)All rights reserved.*", ""), (r"\s+", " "),
)


def replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def clean_raw(text: Column) -> Column:
    """A page's text without page marks, links, references and notices, on one line."""
    return F.trim(replaced(F.coalesce(text, F.lit("")), RAW))


#: What marks a line as part of an explanation.
EXPLAINS = (" is defined as ", " refers to ", " means ", "definition:", "in other words", "simply put", "key term", "important to note", "terminology", "principle", "concept", "theory")
ASSIGNMENT = r"[a-zA-Z_]\w*\s*=\s*[^=]"


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds(text: Column, *words: str) -> Column:
    return any_of(*[text.contains(w) for w in words])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_chunk(text: Column) -> Column:
    """A chunk's text by lines: without headings, references and links, and without a first line that stands twice."""

    def line(x: Column, plain: Column) -> Column:
        told = plain & holds(F.lower(x), *EXPLAINS) & (F.length(x) > 20)
        heading = ((x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) < 100)) | (x.startswith("#") & ~x.startswith("# ")) | (x.endswith(":") & (F.size(F.split(x, r"\s+")) <= 4) & ~plain)
        bare = replaced(x, (*URLS, (r"\[\d+\]", ""), (r"(?i)Page \d+ of \d+", ""), (r"^\d+$", "")))
        title = lambda b: b.rlike(r"^\d+\.?\s*[A-Z][a-z\s]+$") & (F.size(F.filter(F.split(b, r"\s+"), lambda w: w != "")) <= 5)
        rest = once(bare, lambda b: F.when(title(b), "").otherwise(F.trim(F.regexp_replace(b, r"\s+", " "))))
        return F.when(x == "", "").when(told, replaced(x, URLS)).when(heading, "").otherwise(rest)

    def joined(lines: Column) -> Column:
        first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
        keeps = first.contains(">>>") | first.rlike("^(def |class |import |from )") | holds(F.lower(first), " is defined as ", " refers to ", " means ", "definition:")
        kept = F.when((first == second) & ~keeps, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)
        return F.regexp_replace(F.array_join(kept, "\n"), r"\s+", " ")

    whole = F.coalesce(text, F.lit(""))
    plain = ~(holds(whole, ">>>", "def ", "class ", "import ") | whole.rlike(ASSIGNMENT))
    lines = once(plain, lambda p: F.filter(F.transform(F.split(F.trim(whole), "\n"), lambda x: once(F.trim(x), lambda y: line(y, p))), lambda x: F.trim(x) != ""))
    return once(lines, joined)


def times(text: Column, part: str) -> Column:
    """How often a string stands in a text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def classify_chunk(text: Column) -> Column:
    """Code, Try_It, Exercise, Example or Concept: the first whose signs the text shows."""
    low, bare = F.lower(text), F.trim(text)
    strong = any_of(
        text.contains(">>>"), bare.rlike(r"^(import |from |def |class |if __name__|\$ python|\$ pip)"), text.rlike(r"(?m)^\s*(def|class|import|from)\s+\w+"),
        text.rlike(r"print\s*\(.*\)"), text.rlike(r"return\s+\w+"), text.contains("...") & text.contains("def "),
    )
    weak = [text.rlike(r"[a-zA-Z_]\w*\s*=\s*[^=\s]"), (times(text, "{") > 1) & (times(text, "}") > 1), (times(text, "[") > 2) & (times(text, "]") > 2), text.rlike(r"\b\w+\(\w+.*\)"), times(text, "    ") > 1]
    code = strong | (reduce(lambda a, b: a + b, [w.cast("int") for w in weak]) >= 2)
    try_it = any_of(holds(low, "try it", "try this", "give it a try", "now try", "hands-on"), low.contains("your turn") & holds(low, "code", "write"), low.contains("interactive") & holds(low, "session", "example"))
    exercise = any_of(
        low.contains("exercise") & holds(low, "write", "code", "implement"), low.contains("practice") & holds(low, "coding", "programming"), low.contains("challenge") & holds(low, "code", "implement"),
        low.contains("assignment") & holds(low, "write", "create"), holds(low, "task:", "problem:"), low.contains("implement") & holds(low, "function", "class", "method"),
    )
    elements = holds(text, "def ", "class ", "import ", ">>>") | ((times(text, "(") > 2) & (times(text, ")") > 2))
    example = any_of(
        holds(low, "example", "demonstration") & elements, low.contains("here's how") & holds(low, "code", "write", "implement"), holds(low, "sample code", "code snippet", "following code", "code below", "code above"),
        low.contains("usage example") & holds(low, "function", "method", "class"),
    )
    return F.when(code, "Code").when(try_it, "Try_It").when(exercise, "Exercise").when(example, "Example").otherwise("Concept")


def encoder_text(text: Column, is_code: Column, most: int = 2048) -> Column:
    """The text that is encoded: words of a sentence, or a program's lines without blank ones, cut to what encoders read."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x)), lambda x: x != "")
    return F.substring(F.when(is_code, F.array_join(lines, "\n")).otherwise(F.trim(F.regexp_replace(text, r"\s+", " "))), 1, most)


def subtopic_texts(name: Column, concept_intent: Column, code_intent: Column) -> Column:
    """The texts of a subtopic: its name, and with each intent it has."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(name, F.lit(" "), c))
    return F.filter(F.array(name, some(concept_intent), some(code_intent)), lambda x: x.isNotNull())


def chunk_model(chunk_type: Column) -> Column:
    return F.when(chunk_type == "Concept", "sentence").otherwise("code_bert")


#: Signs of what a question asks for, with their weight and name; the first group of each pattern is words.
ASKS = (
    (1, "recall", r"\b(define|definition|what is|identify|name|meaning|which of the following|choose)\b"), (2, "explain", r"\b(explain|describe|summarize)\b"),
    (4, "apply", r"\b(how do you use|how to|apply|write|create|implement)\b"), (8, "evaluate", r"\b(evaluate|trade[-\s]?off|tradeoffs|trade-offs)\b"),
    (3, "analyze", r"\b(analyze|compare|contrast|justify|difference between)\b"), (3, "cause", r"\b(why|how does|what happens if|effect of|reason)\b"),
    (3, "debug", r"\b(debug|fix|error|incorrect|bug)\b"), (3, "trace", r"\b(output|what will be printed|trace)\b"), (1, "steps", r"\b(step|steps|first|then|after|before|next)\b"),
)
STATEMENT = (r"^(a|an|the|this|these|those)\b", r"^[a-z][a-z\s'/-]{3,60}\b(is|are|can|cannot|will|share|uses|allow|allows|means|refers)\b")
SNIPPET = r"```|[()\[\]{}=+\-*/%<>]|\bfor\b|\bwhile\b|\bif\b|\bdef\b|print\("


def asked(text: Column) -> list[tuple[int, str, Column]]:
    """The signs of a question that isn't about code: weight, name, and whether the text shows it."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    signs = [(w, name, low.rlike(p)) for w, name, p in ASKS]
    statement = ~low.contains("?") & (low.rlike(STATEMENT[0]) | low.rlike(STATEMENT[1]))
    clauses = F.regexp_count(low, F.lit(r"\b(and|or|but|however)\b")) >= 2
    return [*signs, (1, "statement", statement), (1, "clauses", clauses), (1, "example", low.rlike(SNIPPET))]


def question_reasons(text: Column) -> Column:
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for _, name, hit in asked(text)]), lambda x: x.isNotNull())


def question_level(text: Column) -> Column:
    """Level of a question that isn't about code; one that traces an example is intermediate at least."""
    signs = asked(text)
    score = reduce(lambda a, b: a + b, [F.when(hit, w).otherwise(0) for w, _, hit in signs])
    by = {name: hit for _, name, hit in signs}
    level = F.when(score >= 8, "master").when(score >= 6, "advanced").when((score >= 4) | (by["trace"] & by["example"]), "intermediate").otherwise("beginner")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "beginner").otherwise(level)


#: Strings of front matter, patterns of back matter, other books of a bundle, signs of a sample.
JUNK_MARKERS = ("all rights reserved", "isbn", "copyright ©", "first published", "library of congress", "printed in", "packt publishing", "o'reilly media", "birmingham - mumbai", "cover designed", "acquisition editor", "commissioning editor", "content development editor", "technical editor")
BACK_MATTER = r"(?im)Other Books You May Enjoy|Leave a review|ISBN:\s*\d|Para \w+, com todo|Table of Contents|Chapter Summary \d+|Further Reading \d+|^\s*[A-Z]\s*$"
BOOKS = ("Fluent Python", "Expert Python Programming", "Python Basics", "Intermediate Python")
SAMPLE_SIGNS = ("This is a sample from", "With the full version of the book you get", "purchase a full version", "If you enjoyed the sample chapters", "Python Basics: A Practical Introduction to Python 3")
FRONT_MATTER = ("contents", "table of contents", "toc", "foreword", "preface", "dedication", "copyright", "about the author", "about the authors", "about real python", "acknowledgements", "acknowledgments", "colophon", "title page")


def junk_reason(text: Column, title: Column, least: int = 200) -> Column:
    """Why a chunk is no content: empty, short, a marker, or its book's title again and again; null if it is."""
    low, name = F.lower(F.trim(text)), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    found = F.get(F.filter(F.array(*map(F.lit, JUNK_MARKERS)), lambda m: low.contains(m)), F.lit(0))
    hits = F.floor((F.length(low) - F.length(F.replace(low, name, F.lit("")))) / F.length(name))
    again = (F.length(name) >= 8) & (hits >= 3) & (hits * F.length(name) / F.length(low) > 0.05)
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.length(low) < least, "short").when(found.isNotNull(), F.concat(F.lit("marker: "), found)).when(again, "title")


def other_book(text: Column, title: Column) -> Column:
    """Whether a text names another book of the bundle, one whose title shares less than two words with its own."""
    own = F.split(F.lower(title), r"\s+")
    return any_of(*[F.lower(text).contains(b.lower()) & (F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in b.lower().split()]))) < 2) for b in BOOKS])


def back_matter(text: Column) -> Column:
    """Back matter, or the placeholder of a sample: two signs of it, or one of the first three in less than 800 characters, from 50 characters on."""
    signs = reduce(lambda a, b: a + b, [F.lower(text).contains(s.lower()).cast("int") for s in SAMPLE_SIGNS])
    short = holds(F.lower(text), *[s.lower() for s in SAMPLE_SIGNS[:3]])
    n = F.length(F.trim(text))
    return F.trim(text).rlike(BACK_MATTER) | ((n >= 50) & ((signs >= 2) | ((n < 800) & short)))


def index_start(text: Column) -> Column:
    """Whether most lines are a term and a page number, as a book's index begins."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    hits = F.size(F.filter(lines, lambda x: x.rlike(r"^[^0-9\s].{2,40}\s+\d{2,3}$")))
    return ~text.rlike(r"\.\s*\.\s*\.") & (F.size(lines) > 0) & (hits > F.size(lines) * 0.6)


def code_complexity(text: Column) -> Column:
    """Points of a piece of code: lines by five up to 3, and definitions, classes and imports it has."""
    lines = F.size(F.split(text, "\n"))
    has = lambda s, n: F.when(text.contains(s), n).otherwise(0)
    return F.least(F.floor(lines / 5), F.lit(3)) + has("def ", 2) + has("class ", 3) + F.when(text.contains("import ") | text.contains("from "), 1).otherwise(0)


#: Signs of a first test's question: points, pattern in its text, pattern in its code (both in lower case, "" for none).
FIRST_TEST = (
    (1, r"\b(define|definition|what is|identify|name)\b", ""), (1, r"\b(explain|describe|summarize)\b", ""), (2, r"\b(write|create|use|convert|compute|calculate|implement|handle)\b", ""),
    (3, r"\b(debug|fix|correct|error|why|explain why|analyze)\b", ""), (3, r"\b(output|what will be printed|what is printed|result of this code|trace)\b", ""),
    (2, r"\b(if|elif|else)\b", r"\b(if|elif|else)\b"), (2, r"\b(for|while|loop)\b", r"\b(for|while)\b"), (2, r"\bnested\b", r"(?s)\b(for|while)\b.*\b(for|while)\b|\bif\b.*\bif\b"),
    (1, r"\b(and|or)\b", r"\b(and|or)\b"), (2, r"\b(def|function)\b", r"\bdef\b"), (1, r"\b(list|dict|tuple|set)\b", r"[\[{]"), (2, r"\b(try|except|exception)\b", r"\b(try|except|exception)\b"),
)
FENCED = r"(?is)```(?:python)?\s*(.*?)```"
CODE_LINE = r"\b(for|while|if|def)\b|print\s*\(|=|range\s*\("
ADVANCED_FROM, INTERMEDIATE_FROM = 7, 4


def code_inside(text: Column) -> Column:
    """The fenced code of a text, or else its lines that look like code."""
    fenced = F.trim(F.array_join(F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), "\n"))
    lines = F.trim(F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(CODE_LINE)), "\n"))
    return F.when(fenced != "", fenced).otherwise(lines)


def first_test_level(text: Column) -> Column:
    """beginner, intermediate or advanced by the points of a first test's question; code counts one point."""
    text = F.trim(F.coalesce(text, F.lit("")))

    def level(x: Column) -> Column:
        code = F.lower(x["code"])
        points = [F.when(x["low"].rlike(a) | (code.rlike(b) if b else F.lit(False)), n).otherwise(0) for n, a, b in FIRST_TEST]
        score = reduce(lambda s, p: s + p, points, F.when(code != "", 1).otherwise(0))
        return F.when(score >= ADVANCED_FROM, "advanced").when(score >= INTERMEDIATE_FROM, "intermediate").otherwise("beginner")

    # computed once, however many signs look at it
    return F.get(F.transform(F.array(F.struct(F.lower(text).alias("low"), code_inside(text).alias("code"))), level), F.lit(0))
