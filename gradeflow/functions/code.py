"""Difficulty of a question about code: what it asks for, and the structure of its code, read by a fold over logical lines.

The fold keeps the indentation levels and the blocks that are open, each with the indentation of its first line and what it is, so
nesting, branches of one statement and calls of the function inside itself are seen as a parser would see them. Strings and comments
are taken out first, and lines that stand in open brackets are joined. Code that doesn't read as statements line by line
(prose, broken indentation, a block without a body) gives no structure, and patterns over the text stand in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeflow.functions.text import FENCED

#: Strings, by possessive loops, which Java's patterns run without recursion however long a string is.
STRING = "|".join([r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""', r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''", r'"(?:[^"\\\n]++|\\[\s\S])*+"', r"'(?:[^'\\\n]++|\\[\s\S])*+'"])
HEAD = r"^(async\s+def|async\s+for|async\s+with|def|class|for|while|if|elif|else|try|except|finally|with)\b"
KEYWORDS = r"\b(and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield)\b"
#: Statements can't begin behind something else, outside brackets.
INSIDE = r"[^:;\s]\s+(for|while|def|class|return|with|try|except|finally|elif|del|global|nonlocal|assert|raise|pass|break|continue)\b"
NO_CODE = r"[?$`]|![^=]|!$|\w\.\s+\w"
BRACKETED = r"[\[({][^\[\](){}]*[\])}]"

_BLOCK = "struct<indent:int,kind:string,name:string>"
_STATE = f"struct<levels:array<int>,open:array<{_BLOCK}>,awaits:int,bad:boolean,loops:int,ifs:int,nested_loop:boolean,nested_if:boolean,recursion:boolean,comprehension:boolean>"


def once(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def code_of(text: Column) -> Column:
    """The fenced code of a text, else all of it."""
    fenced = F.regexp_extract_all(text, F.lit(FENCED), F.lit(1))
    return F.when(F.size(fenced) > 0, F.trim(F.array_join(fenced, "\n"))).otherwise(text)


def without_strings(code: Column) -> Column:
    """Code without strings and comments; tabs are eight blanks, and lines that a backslash ends go on."""
    bare = F.regexp_replace(code, rf"(#[^\n]*)|{STRING}", "$1")
    return F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("\t"), F.lit(" " * 8)), r"#[^\n]*", ""), r"\\\n", " ")


def logical_lines(code: Column) -> Column:
    """struct(depth, line, out): the lines of code, those in open brackets joined; depth is not 0 where brackets don't match."""
    net = lambda x: F.length(F.regexp_replace(x, r"[^\[({]", "")) - F.length(F.regexp_replace(x, r"[^\])}]", ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("line"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        depth = (s["depth"] + net(x)).cast("int")
        line = F.when(s["depth"] > 0, F.concat(s["line"], F.lit(" "), F.trim(x))).otherwise(x)
        ends = depth <= 0
        return F.struct(depth.alias("depth"), F.when(ends, "").otherwise(line).alias("line"), F.when(ends, F.array_append(s["out"], line)).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.filter(F.split(code, "\n"), lambda x: F.trim(x) != ""), start, step)


def read_line(line: Column) -> Column:
    """struct(indent, body, head, name, bad) of a logical line, as far as it can be told from the line alone."""
    body = F.trim(line)
    return once(
        F.struct((F.length(F.rtrim(line)) - F.length(body)).cast("int").alias("indent"), body.alias("body")),
        lambda x: F.struct(
            x["indent"].alias("indent"), x["body"].alias("body"), F.regexp_replace(F.regexp_extract(x["body"], HEAD, 1), r"\s+", " ").alias("head"),
            F.regexp_extract(x["body"], r"^(?:async\s+)?def\s+(\w+)", 1).alias("name"), _unreadable(x["body"]).alias("bad"),
        ),
    )


def _unreadable(body: Column) -> Column:
    flat = reduce(lambda b, _: F.regexp_replace(b, BRACKETED, "0"), range(4), F.regexp_replace(body, r"^async\s+", ""))
    starts = body.rlike(HEAD)
    lone_if = flat.rlike(r"\S\s+if\b") & ~flat.rlike(r"\belse\b")
    return (
        F.regexp_replace(body, KEYWORDS, ",").rlike(r"\w\s+\w")
        | body.rlike(NO_CODE)
        | flat.rlike(INSIDE)
        | lone_if
        | (starts & ~body.contains(":"))
        | (~starts & body.endswith(":"))
        | (body.rlike(r"^(async\s+)?def\b") & ~body.rlike(r"^(async\s+)?def\s+\w+\s*\("))
    )


def _next(s: Column, x: Column) -> Column:
    """The state behind a line: which blocks are open, and what has been seen so far."""
    indent, head = x["indent"], x["head"]
    deeper = s["awaits"] >= 0  # the line before began a block
    fits = F.when(deeper, indent > s["awaits"]).otherwise(F.array_contains(s["levels"], indent))
    levels = F.when(deeper, F.array_append(s["levels"], indent)).otherwise(F.filter(s["levels"], lambda v: v <= indent))
    above = F.filter(s["open"], lambda b: b["indent"] < indent)
    left = F.filter(s["open"], lambda b: b["indent"] == indent)  # of the block that this line ends or goes on with
    goes_on = head.isin("elif", "else", "except", "finally")
    kind = F.when(head.isin("for", "while"), "loop").when(head == "if", "if").when(head.isin("def", "async def"), "def").otherwise("other")
    kind = F.when(goes_on, F.get(left, F.lit(0))["kind"]).otherwise(kind)
    block = F.struct(indent.alias("indent"), kind.alias("kind"), x["name"].alias("name"))
    blocks = F.when(head != "", F.array_append(above, block)).otherwise(above)
    inside = lambda k: F.exists(above, lambda b: b["kind"] == k)
    own = F.element_at(F.filter(F.concat(F.array(F.struct(F.lit(-1).alias("indent"), F.lit("").alias("kind"), F.lit("").alias("name")).cast(_BLOCK)), blocks), lambda b: (b["kind"] == "def") | (b["indent"] < 0)), -1)["name"]
    rest = F.regexp_replace(x["body"], r"^(async\s+)?def\s+\w+", "")
    calls = (own != "") & F.regexp_like(rest, F.concat(F.lit(r"(^|[^\w.])"), own, F.lit(r"\s*\(")))
    loop, branch = head.isin("for", "while"), head.isin("if", "elif")
    return F.struct(
        levels.alias("levels"),
        blocks.alias("open"),
        F.when((head != "") & x["body"].endswith(":"), indent).otherwise(-1).alias("awaits"),
        (s["bad"] | x["bad"] | ~fits | (goes_on & (F.size(left) == 0))).alias("bad"),
        (s["loops"] + loop.cast("int")).alias("loops"),
        (s["ifs"] + branch.cast("int")).alias("ifs"),
        (s["nested_loop"] | (loop & inside("loop"))).alias("nested_loop"),
        (s["nested_if"] | (branch & (inside("if") | (head == "elif")))).alias("nested_if"),
        (s["recursion"] | calls).alias("recursion"),
        (s["comprehension"] | x["body"].rlike(r"[\[({].*\bfor\b.*\bin\b")).alias("comprehension"),
    ).cast(_STATE)


def structure(code: Column) -> Column:
    """struct of what the code is made of; ``used`` says whether it reads as code that has a function, class, loop or branch."""
    no, zero = F.lit(False), F.lit(0)
    start = F.struct(F.array(zero), F.array().cast(f"array<{_BLOCK}>"), F.lit(-1), no, zero, zero, no, no, no, no).cast(_STATE)

    def read(c: Column) -> Column:
        def fold(lines: Column) -> Column:
            return F.struct(lines["depth"].alias("depth"), c.alias("bare"), F.aggregate(F.transform(lines["out"], read_line), start, _next).alias("s"))

        return once(logical_lines(c), fold)

    def told(x: Column) -> Column:
        s, bare = x["s"], x["bare"]
        begins = lambda p: bare.rlike(rf"(?m)^\s*{p}")
        parsed = ~s["bad"] & (x["depth"] == 0) & (s["awaits"] < 0)
        function, cls = begins(r"(async\s+)?def\b"), begins(r"class\b")
        seen = {"function": function, "class": cls, "try": begins(r"try\s*:"), "with": begins(r"with\b"), "async": begins(r"async\s+def\b"), "lambda": bare.rlike(r"\blambda\b"), "yield": bare.rlike(r"\byield\b")}
        used = parsed & (function | cls | (s["loops"] > 0) | (s["ifs"] > 0))
        names = ("loops", "ifs", "nested_loop", "nested_if", "recursion", "comprehension")
        return F.struct(used.alias("used"), *[c.alias(k) for k, c in seen.items()], *[s[k].alias(k) for k in names])

    return once(once(without_strings(code), read), told)


#: Points for what a question asks for and for how its code is built, and points by patterns where it can't be read.
INLINE = (2, r"(?i)\bfor\b|\bwhile\b|\bif\b|\bprint\s*\(|range\s*\(")
TRACE = r"(?i)\b(trace|predict the output|what is the output|what will be printed)\b"
TASKS = ((3, "trace", TRACE), (3, "debug", r"(?i)\b(debug|fix|correct|why|explain why)\b"), (2, "create", r"(?i)\b(implement|write|create|program)\b"))
BUILT = ((5, "recursion"), (5, "async"), (4, "yield"), (3, "class"), (3, "try"), (2, "with"), (2, "comprehension"), (2, "lambda"))
NEEDS_RECURSION = r"(?i)\b(using recursion|use recursion|recursive|recursion)\b"
HINTS = ((4, "async", r"(?i)\basync\b|\bawait\b"), (3, "yield", r"(?i)\byield\b"), (3, "class", r"(?i)\bclass\b"), (3, "try", r"(?i)\btry\b.*\bexcept\b"), (2, "comprehension", r"(?i)\[.*for.+in.+\]|\{.*for.+in.+\}"))
MASTER_FROM, ADVANCED_FROM, INTERMEDIATE_FROM = 13, 9, 5


def coding_difficulty(text: Column) -> Column:
    """struct(score, level, tag, reasons). tag: hard_master, hard_intermediate or hard_advanced by a sign that decides alone, else the
    level from intermediate up, else null. Null and empty texts: score 0, beginner, no tag."""

    def rate(x: Column) -> Column:
        t, code, s = x["t"], x["code"], x["s"]
        used, fenced = s["used"], t.contains("```")
        count = lambda p: F.regexp_count(code, F.lit(p))
        loops, ifs = count(r"(?i)\bfor\b|\bwhile\b"), count(r"(?i)\bif\b")
        signs = [(INLINE[0], "inline", ~fenced & t.rlike(INLINE[1])), *[(n, name, t.rlike(p)) for n, name, p in TASKS]]
        signs += [(n, name, used & s[name]) for n, name in BUILT]
        signs += [(3, "nested loop", used & s["nested_loop"]), (2, "loop", used & ~s["nested_loop"] & (s["loops"] > 0)), (2, "nested if", used & s["nested_if"]), (1, "if", used & ~s["nested_if"] & (s["ifs"] > 0))]
        signs += [(4, "recursion?", ~used & t.rlike(r"(?i)\brecurs(ion|ive)\b")), *[(n, name + "?", ~used & code.rlike(p)) for n, name, p in HINTS]]
        signs += [(4, "nested loop?", ~used & (loops >= 2)), (2, "loop?", ~used & (loops == 1)), (2, "nested if?", ~used & (ifs >= 2)), (1, "if?", ~used & (ifs == 1))]
        reasons = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"))) for n, name, hit in signs]))
        return F.struct(t.alias("t"), s.alias("s"), fenced.alias("fenced"), reasons.alias("reasons"))

    def judge(x: Column) -> Column:
        t, s = x["t"], x["s"]
        score = F.aggregate(x["reasons"], F.lit(0), lambda a, r: a + r["n"])
        level = F.when(score >= MASTER_FROM, "master").when(score >= ADVANCED_FROM, "advanced").when(score >= INTERMEDIATE_FROM, "intermediate").otherwise("beginner")
        tag = (
            F.when(s["used"] & (s["recursion"] | s["async"] | s["yield"]), "hard_master")
            .when(t.rlike(NEEDS_RECURSION), "hard_master")
            .when(t.rlike(TRACE) & x["fenced"], "hard_intermediate")
            .when(s["used"] & (s["nested_loop"] | s["try"] | s["class"]), "hard_advanced")
            .when(level != "beginner", level)
        )
        return F.struct(score.alias("score"), level.alias("level"), tag.alias("tag"), F.transform(x["reasons"], lambda r: r["name"]).alias("reasons"))

    t = F.trim(F.coalesce(text, F.lit("")))
    with_code = once(F.struct(t.alias("t"), code_of(t).alias("code")), lambda x: F.struct(x["t"].alias("t"), x["code"].alias("code"), structure(x["code"]).alias("s")))
    return once(once(with_code, rate), judge)
