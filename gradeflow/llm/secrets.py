"""Secret scan with DataFrame functions alone: pattern matches, and entropy windows over candidate strings.

Base kinds are found by pattern, leftmost and without overlaps. The entropy kinds look at candidate strings (runs of
``[A-Za-z0-9+/_=-]``) of ``WINDOW`` characters or more: a window slides over the candidate, a count of each character in it is
kept up to date from the one that leaves and the one that enters, and with it the window's Shannon entropy. Windows that
reach the threshold of the candidate's character class are joined into spans. An allow list suppresses candidates that are
identifiers or numbers as a whole, and windows that hold a placeholder's word. Entropy is kept in whole units of 2**-20 bit,
so that the comparison with a threshold doesn't depend on the order of floating point sums. Long candidates are taken in
blocks of ``STRETCH`` windows, and touching spans of neighbouring blocks are joined, so the work grows with the length alone.

Defined cases: a null text counts as empty and has no spans; repeated rows are each scanned; an empty table gives an empty one;
texts and candidates of any length are scanned whole; other columns pass through ``with_secret_spans`` untouched, and one
that is named like its output is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import fresh

#: The base kinds in their order. Letters of the assign pattern match in either case.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of 20 characters or more
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN_MIN = 6

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
UNIT = 1 << 20
#: Bits of entropy that a window must reach, by the candidate's character class.
THRESHOLDS = {"entropy_hex": 2.9, "entropy_base64": 3.7}
#: Candidates that are no secrets as a whole: identifiers with dashes, anything without a digit or a letter, words with numbers.
ALLOWED = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[^0-9]*$|^[^a-z]*$|^[a-z]+([_/=-]+([a-z]+|[0-9]{1,4}))*$"
#: Words that make a window a placeholder.
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|0000|12345678|abcdefgh|qwerty"
#: Different characters without which no window can reach its threshold: 2 to the power of it, rounded up.
LEAST_LETTERS = {kind: math.ceil(2**bits) for kind, bits in THRESHOLDS.items()}
#: Windows of a candidate that are taken together.
STRETCH = 256
#: Prefix sums are taken in blocks of this many, so that long arrays aren't copied once for each element.
BLOCK = 256


def weight(count: int) -> int:
    """count * log2(count) in units."""
    return round(count * math.log2(count) * UNIT) if count else 0


#: Windows pass when sum of weights <= WINDOW * (log2(WINDOW) - threshold).
LIMITS = {kind: round(WINDOW * (math.log2(WINDOW) - bits) * UNIT) for kind, bits in THRESHOLDS.items()}


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs."""

    def fold(array: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(
            array, empty, lambda acc, x: F.struct((acc.at + x).alias("at"), F.concat(acc.sums, F.array(acc.at + x)).alias("sums"))
        ).sums

    zero = F.lit(0).cast("bigint")
    starts = F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))
    blocks = F.transform(starts, lambda s: F.slice(values, s, F.lit(BLOCK)))
    totals = fold(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), zero)
    offsets = F.concat(F.array(zero), totals)
    parts = F.transform(F.arrays_zip(blocks.alias("b"), offsets.alias("o")), lambda z: F.when(z.b.isNotNull(), fold(z.b, z.o)))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.filter(parts, lambda p: p.isNotNull())))


def located(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: array of (start, end, match) of a pattern's matches in code points, end exclusive."""
    found, ends = f"{name}_found", f"{name}_ends"
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    lengths = F.transform(
        F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), F.col(found).alias("match")),
        lambda z: (F.length(z.gap) + F.length(z.match)).cast("bigint"),
    )
    df = df.withColumn(ends, F.when(F.size(found) > 0, running_sum(lengths)))
    spans = F.zip_with(
        ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return df.withColumn(name, F.coalesce(spans, none)).drop(found, ends)


NO_SPANS = "array<struct<start:bigint,end:bigint>>"


def entropy_runs(candidate: Column, limit: Column) -> Column:
    """Spans inside a candidate of the joined windows whose entropy reaches the limit."""
    parts = F.regexp_extract_all(candidate, F.lit(f".{{1,{STRETCH}}}"), F.lit(0))

    def blocks(p: Column) -> Column:
        """Each part with as much of the next one as the windows that begin in it reach into."""
        numbers = F.sequence(F.lit(0), F.size(p) - 1)
        texts = F.transform(numbers, lambda k: F.struct((k * STRETCH).cast("bigint").alias("at"), F.concat(F.get(p, k), F.substring(F.coalesce(F.get(p, k + 1), F.lit("")), 1, WINDOW - 1)).alias("text")))
        return F.filter(texts, lambda b: F.length(b["text"]) >= WINDOW)

    lettered = F.transform(
        bound(parts, blocks),
        lambda b: F.struct(b["at"].alias("at"), b["text"].alias("text"), F.substring(b["text"], 1, WINDOW).alias("first"), F.split(b["text"], "").alias("chars"), F.array_distinct(F.split(b["text"], "")).alias("letters")),
    )
    # each character's number in the block's own alphabet, so that counts are looked up by number
    coded = F.transform(
        lettered,
        lambda b: F.struct(
            b["at"].alias("at"),
            b["text"].alias("text"),
            F.transform(b["chars"], lambda c: F.array_position(b["letters"], c).cast("int") - 1).alias("codes"),
            F.transform(b["letters"], lambda c: WINDOW - F.length(F.replace(b["first"], c, F.lit("")))).alias("counts"),
        ),
    )
    spans = F.flatten(F.transform(coded, lambda b: F.transform(block_runs(b["text"], b["codes"], b["counts"], limit), lambda s: F.struct((b["at"] + s.start).alias("start"), (b["at"] + s.end).alias("end")))))
    closed = F.aggregate(spans, nothing_open(), lambda acc, s: joined(acc, s.start, s.end))
    return ended(closed)


def nothing_open() -> Column:
    """No spans yet: those that are closed, and the ends of the open one (-1: none)."""
    none = F.lit(-1).cast("bigint")
    return F.struct(F.array().cast(NO_SPANS).alias("runs"), none.alias("start"), none.alias("end"))


def joined(acc: Column, start: Column, end: Column) -> Column:
    """One more span, which begins no earlier than those before it; where they touch, the open one grows."""
    own = F.struct(acc["start"].alias("start"), acc["end"].alias("end"))
    new = F.struct(F.concat(acc["runs"], F.array(own)).alias("runs"), start.alias("start"), end.alias("end"))
    first = F.struct(acc["runs"].alias("runs"), start.alias("start"), end.alias("end"))
    grown = F.struct(acc["runs"].alias("runs"), acc["start"].alias("start"), end.alias("end"))
    return F.when(acc["start"] < 0, first).when(start <= acc["end"], grown).otherwise(new)


def ended(acc: Column) -> Column:
    own = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
    return F.when(acc["start"] < 0, acc["runs"]).otherwise(F.concat(acc["runs"], own))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Counts are kept in a string, one character a letter of the alphabet, as a change then copies some 60 bytes and no array.


def written(count: Column) -> Column:
    return F.char(count + ord("A"))


def count_of(counts: Column, letter: Column) -> Column:
    return F.ascii(F.substring(counts, letter + 1, F.lit(1))) - ord("A")


def block_runs(text: Column, codes: Column, each: Column, limit: Column) -> Column:
    """Spans of the joined windows of a block. codes: the number of each character; each: how often each number's character is
    in the first window."""
    weights = F.array(*[F.lit(weight(c)).cast("bigint") for c in range(WINDOW + 1)])
    of = lambda n: F.get(weights, n)
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda acc, c: acc + of(c))
    counts = F.array_join(F.transform(each, written), "")

    def noted(spans: Column, at: Column, sum_: Column) -> Column:
        good = (sum_ <= limit) & ~F.rlike(F.substring(text, at + 1, F.lit(WINDOW)), F.lit(PLACEHOLDER))
        return F.when(good, joined(spans, at.cast("bigint"), (at + WINDOW).cast("bigint"))).otherwise(spans)

    def moved(acc: Column, edge: Column) -> Column:
        """Sum and counts after a character left and another entered."""
        out, into = count_of(acc["counts"], edge["leaves"]), count_of(acc["counts"], edge["enters"])
        sum_ = acc["sum"] - of(out) + of(out - 1) + of(into + 1) - of(into)
        counts = F.overlay(F.overlay(acc["counts"], written(out - 1), edge["leaves"] + 1), written(into + 1), edge["enters"] + 1)
        return F.when(edge["leaves"] != edge["enters"], F.struct(sum_.alias("sum"), counts.alias("counts"))).otherwise(F.struct(acc["sum"].alias("sum"), acc["counts"].alias("counts")))

    def slide(acc: Column, at: Column) -> Column:
        """The window moves from at - 1 to at (counted from 0)."""
        edge = F.struct(F.get(codes, at - 1).alias("leaves"), F.get(codes, at + (WINDOW - 1)).alias("enters"))
        after = bound(edge, lambda e: moved(acc, e))
        return bound(after, lambda x: F.struct(x["sum"].alias("sum"), x["counts"].alias("counts"), noted(acc["spans"], at, x["sum"]).alias("spans")))

    start = F.struct(total.alias("sum"), counts.alias("counts"), noted(nothing_open(), F.lit(0), total).alias("spans"))
    steps = F.when(F.size(codes) > WINDOW, F.sequence(F.lit(1), F.size(codes) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return ended(F.aggregate(steps, start, slide)["spans"])


def with_secret_spans(df: DataFrame, text: str = "text", output: str = "secret_spans") -> DataFrame:
    """Adds an array of (start, rank, kind, end) of all secrets, in order of start and then of kind. The caller's columns are kept in
    one struct meanwhile, so that none of them, whatever its name, meets those of the work."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != output])
    df = df.select(own.alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    group = F.regexp_extract_all("_t", F.lit(f"(?i){ASSIGN}"), F.lit(2))
    df = located(df, "_t", f"(?i){ASSIGN}", "_assign")
    df = df.withColumn("_value", F.when(F.size("_assign") > 0, group).otherwise(F.array().cast("array<string>")))
    df = located(df, "_t", ACCESS, "_access")
    df = located(df, "_t", HEX, "_hex")
    df = located(df, "_t", CANDIDATE, "_run")

    def spans(array: Column, kind: str) -> Column:
        return F.transform(
            array,
            lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s.end.alias("end")),
        )

    assign = F.filter(
        F.zip_with("_assign", "_value", lambda s, v: F.struct(s.start.alias("start"), s.end.alias("end"), F.length(v).alias("n"))),
        lambda s: s.n >= ASSIGN_MIN,
    )
    df = df.withColumn("_base", F.concat(spans(assign, "assign"), spans(F.col("_access"), "access"), spans(F.col("_hex"), "hex")))
    live = F.filter("_run", lambda r: ~F.rlike(r.match, F.lit(ALLOWED)))
    letters = lambda r: F.size(F.array_distinct(F.split(r.match, "")))
    live = F.filter(live, lambda r: letters(r) >= F.when(F.rlike(r.match, F.lit("^[0-9a-fA-F]+$")), F.lit(LEAST_LETTERS["entropy_hex"])).otherwise(F.lit(LEAST_LETTERS["entropy_base64"])))
    live = F.transform(live, lambda r: F.struct(r.start.alias("start"), F.rlike(r.match, F.lit("^[0-9a-fA-F]+$")).alias("is_hex"), r.match.alias("match")))
    df = df.withColumn("_live", F.when(F.size("_run") > 0, live).otherwise(F.array().cast("array<struct<start:bigint,is_hex:boolean,match:string>>")))

    def added(r: Column) -> Column:
        is_hex = r.is_hex
        kind = F.when(is_hex, F.lit("entropy_hex")).otherwise(F.lit("entropy_base64"))
        limit = F.when(is_hex, F.lit(LIMITS["entropy_hex"])).otherwise(F.lit(LIMITS["entropy_base64"])).cast("bigint")
        rank = F.when(is_hex, F.lit(KINDS.index("entropy_hex"))).otherwise(F.lit(KINDS.index("entropy_base64")))
        return F.transform(
            entropy_runs(r.match, limit),
            lambda s: F.struct((r.start + s.start).alias("start"), rank.alias("rank"), kind.alias("kind"), (r.start + s.end).alias("end")),
        )

    new = F.filter(
        F.flatten(F.transform("_live", added)), lambda s: ~F.exists("_base", lambda b: (b.start <= s.start) & (b.end >= s.end))
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    df = df.withColumn("_new", F.when(F.size("_live") > 0, new).otherwise(none))
    return df.select("_own.*", F.array_sort(F.concat("_base", "_new")).alias(output))


def redacted(df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[secret]") -> DataFrame:
    """Replaces every secret in the text, overlapping ones together, by a mark. Texts without secrets stay as they are, null too.
    What lies between secrets is taken out of blocks of the text, as counting characters from its start would cost its length."""
    blocks, gaps = fresh(df.columns, "_blocks"), fresh(df.columns, "_gaps")
    df = df.withColumn(blocks, F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))

    def between(start: Column, end: Column) -> Column:
        low, high = F.floor(start / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
        piece = F.array_join(F.slice(blocks, low + 1, high - low + 1), "")
        return F.substring(piece, (start - low * STRETCH).cast("int") + 1, (end - start).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(
            s.start >= acc["at"], F.struct(F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("start"), s.start.alias("end")))).alias("gaps"), s.end.alias("at"))
        ).otherwise(F.struct(acc["gaps"].alias("gaps"), F.greatest(acc["at"], s.end).alias("at")))

    start = F.struct(F.array().cast(NO_SPANS).alias("gaps"), F.lit(0).cast("bigint").alias("at"))
    last = lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("start"), F.length(text).cast("bigint").alias("end"))))
    df = df.withColumn(gaps, F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, step, last)))
    done = F.array_join(F.transform(gaps, lambda g: between(g.start, g.end)), mark)
    return df.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).drop(blocks, gaps)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def secret_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: the counts by base kind, a hash of the base spans, and all spans as text."""
    df = with_secret_spans(df.select(F.col(key), F.col(text)), text).withColumn(
        "base", F.filter("secret_spans", lambda s: s.rank < 3)
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")
    return df.select(
        key,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
    )
