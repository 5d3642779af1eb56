"""License scan: TF-IDF cosine of license files and headers to templates, and inheritance along directories.

A file is cut into units: its whole text, each paragraph (between lines without a letter or digit, so that comment marks around a header
don't matter), each line, and each SPDX tag. Its own license is that of the template with the highest cosine to any unit. It
is a license file where the whole text reaches the threshold, or the first paragraph does so with the head of a long license
(then the head alone decides); otherwise the unit is a header. Term weights are log-scaled counts times inverse document frequency;
the frequencies of the templates' terms are counted over all files, and other terms weigh as if in no file. An SPDX tag with its
identifier is one term. Units without any of a template's heavy terms can't reach the threshold: a template's terms are taken in order
of weight, and those left over once what remains is shorter than the threshold need not be looked for. So a pattern over the heavy
terms picks the few units to score, without losing any. Templates are a sparse table that units join by term.

A directory's license is that of its best license file that may hand it down: one named like a license file (``GIVER``), or whose
text has ``GIVES_FROM`` words or more, as a license itself has; a sentence that names a license speaks for its own file alone. A
file without a license of its own inherits from the nearest directory above it that has one, found by joining each distinct directory with its ancestors' paths.

Defined cases: null texts and empty texts have no license of their own, and may inherit; a null path has no directory and
inherits nothing; an empty table gives an empty one; texts of any length are scanned whole; equal cosines take the license that
sorts first, and equal license files the path that sorts first; rows that share key and path are one file, which has the best
license of any of them, and each get a row; the scan keeps the key and path columns alone, and other columns may have any name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import stored
from gradeflow.llm.license_texts import HEADS, TAGS, TEMPLATES

THRESHOLD = 0.6
#: Names of files that hand down their license, and words from which any license file does.
GIVER, GIVES_FROM = r"(?i)(^|/)(un)?(licen[cs]es?|copying|notice)([-._][^/]*)?$", 40
SALTS = 16
#: Files, of which one task scores those that may hold a license; bounds its tables of counts where the setting for shuffles is low.
FILES_A_DEAL = 5_000
TAG = r"spdx-license-identifier:[ \t]*[a-z0-9.+-]*[a-z0-9+]"
TERM = f"{TAG}|[a-z0-9]+"  # of lower-cased text


def terms(text: Column) -> Column:
    """Terms of a text; the blanks inside a tag are no part of it."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(?<=spdx-license-identifier:)[ \t]+", F.lit("")), F.lit(TERM), F.lit(0))


def plain_terms(text: str) -> list[str]:
    return re.findall(TERM, re.sub(r"(?<=spdx-license-identifier:)[ \t]+", "", text.lower()))


def all_templates() -> list[tuple[str, str, bool]]:
    """(license, text, whether it is the head of a license file), in order of license."""
    texts = [(name, text, False) for name, own in TEMPLATES.items() for text in own]
    texts += [(name, text, True) for name, text in HEADS.items()]
    texts += [(name, f"SPDX-License-Identifier: {tag}", False) for name, tags in TAGS.items() for tag in tags]
    return sorted(texts, key=lambda t: (t[0], not t[2], t[1]))


def inverse_frequency(files: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, float]]:
    """Number of files with a text, and the weight of each term of the templates."""
    known = F.array(*map(F.lit, vocabulary))
    found = files.select(F.array_intersect(terms(F.col(text)), known).alias("t")).where(F.col(text).isNotNull())
    n = files.where(F.col(text).isNotNull()).count()
    counts = dict(found.select(F.explode("t").alias("t")).groupBy("t").count().collect())  # bounded by the templates' terms
    return n, {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}


def unit_vectors(texts: list[str], idf: dict[str, float]) -> list[dict[str, float]]:
    out = []
    for text in texts:
        counts: dict[str, int] = {}
        for t in plain_terms(text):
            counts[t] = counts.get(t, 0) + 1
        weights = {t: (1 + math.log(c)) * idf[t] for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.append({t: w / norm for t, w in weights.items()})
    return out


def heavy_terms(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a text must hold one to reach the threshold with some template."""
    out: set[str] = set()
    for vector in vectors:
        rest = 0.0
        for t, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            rest += w * w
            if math.sqrt(rest) >= threshold - 1e-9:
                out.add(t)
    return sorted(out)


def any_of(found: list[str]) -> str:
    """Pattern of whole terms in either case, dealt by first letter so that few of them are tried at a place."""
    firsts: dict[str, list[str]] = {}
    for t in found:
        firsts.setdefault(t[0], []).append(re.escape(t[1:]).replace(":", r":[ \t]*"))
    return "(?i)(?<![A-Za-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(firsts.items())) + ")(?![A-Za-z0-9])"


def cosines(units: DataFrame, keys: list[str], vectors: list[dict[str, float]], idf: dict[str, float], other: float) -> DataFrame:
    """(keys, template, cosine) of each unit with its best template, by number. units: keys and ``unit``, a text."""
    rows = [(t, idf[t], [(k, v[t]) for k, v in enumerate(vectors) if t in v]) for t in idf]
    sparse = units.sparkSession.createDataFrame(rows, "t string, idf double, parts array<struct<k:int,v:double>>")
    counted = units.select(*keys, F.explode(terms(F.col("unit"))).alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("c"))
    weighed = counted.join(F.broadcast(sparse), "t", "left")  # bounded by the templates' terms
    weighed = weighed.withColumn("w", (1 + F.log("c")) * F.coalesce("idf", F.lit(other)))
    # the unit's own squares go along as part -1
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.col("w").alias("v"))), F.coalesce("parts", F.array().cast("array<struct<k:int,v:double>>")))
    dots = weighed.select(*keys, "w", F.explode(parts).alias("p")).groupBy(*keys, "p.k").agg(F.sum(F.col("w") * F.col("p.v")).alias("dot"))
    each = F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "dot")))  # bounded by the number of templates
    summed = dots.groupBy(*keys).agg(F.sqrt(F.max(F.when(F.col("k") < 0, F.col("dot")))).alias("norm"), each.alias("each"))
    best = F.array_max(F.transform("each", lambda d: F.struct(F.round(d["dot"] / F.col("norm"), 9).alias("cosine"), (-d["k"]).alias("minus"))))
    return summed.select(*keys, best.alias("b")).where("b is not null").select(*keys, (-F.col("b.minus")).alias("template"), F.col("b.cosine").alias("cosine"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, down to the root "", each with its depth."""
    parts = F.split(folder, "/")
    depths = F.sequence(F.lit(0), F.when(folder == "", F.lit(0)).otherwise(F.size(parts)))
    return F.transform(depths, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))


#: What a unit is; in this order of standing.
LINE, PARAGRAPH, FIRST, WHOLE = range(4)
#: Between paragraphs: lines without a letter or digit.
GAP = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def units_of(text: Column, pattern: str) -> Column:
    """(is, unit) of each unit of a text that may reach the threshold; equal units of one kind once."""
    holds = lambda x: F.rlike(x, F.lit(pattern))
    named = lambda kind, units: F.transform(units, lambda x: F.struct(F.lit(kind).alias("is"), x.alias("unit")))
    paragraphs = F.split(F.regexp_replace(text, r"^[^A-Za-z0-9]+", ""), GAP)
    lines = F.filter(F.split(text, "\n"), holds)
    tags = F.regexp_extract_all(F.lower(text), F.lit(TAG), F.lit(0))
    later = F.filter(F.slice(paragraphs, F.lit(2), F.size(paragraphs)), holds)
    return F.array_distinct(
        F.concat(named(WHOLE, F.array(text)), named(FIRST, F.slice(paragraphs, 1, 1)), named(PARAGRAPH, later), named(LINE, lines), named(LINE, tags))
    )


def license_scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, license, cosine, origin, inherited_from) for each row. origin: file, header, inherited or none."""
    rows = files.select(F.col(key), F.col(path).alias("path"), F.col(text).alias("text"))
    templates = all_templates()
    vocabulary = sorted({t for _, x, _ in templates for t in plain_terms(x)})
    n, idf = inverse_frequency(rows, "text", vocabulary)
    vectors = unit_vectors([x for _, x, _ in templates], idf)
    pattern = any_of(heavy_terms(vectors, threshold))
    gives = F.coalesce(F.rlike("path", F.lit(GIVER)), F.lit(False)) | (F.size(F.split(F.trim("text"), r"\s+")) >= GIVES_FROM)
    picked = rows.where(F.rlike("text", F.lit(pattern))).select(F.col(key), "path", F.xxhash64("text").alias("hash"), gives.alias("gives"), "text")
    # a file's text is shuffled once; what groups by more than these three finds its rows together
    deals = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FILES_A_DEAL))
    dealt = picked.repartition(deals, key, "path", "hash").distinct()
    units = dealt.select(key, "path", "hash", "gives", F.posexplode(units_of(F.col("text"), pattern)).alias("at", "u")).select(key, "path", "hash", "gives", "at", "u.*")
    scored = cosines(units, [key, "path", "hash", "gives", "at", "is"], vectors, idf, math.log(1 + n) + 1).where(F.col("cosine") >= threshold)
    name = F.get(F.array(*[F.lit(t[0]) for t in templates]), F.col("template"))
    head = F.get(F.array(*[F.lit(t[2]) for t in templates]), F.col("template"))
    standing = F.when((F.col("is") == FIRST) & head, 2).when(F.col("is") == WHOLE, 1).otherwise(0)
    # of equal cosines the license that sorts first, which has the smaller number
    own = scored.groupBy(key, "path").agg(F.max(F.struct(standing.alias("standing"), "cosine", (-F.col("template")).alias("minus"), name.alias("license"), "gives")).alias("o"))
    own = own.select(key, "path", F.least(F.col("o.standing"), F.lit(1)).alias("whole"), "o.cosine", "o.license", "o.gives")
    own = stored(own, "licenses").distinct()
    given = own.where("whole = 1 and gives and path is not null").groupBy(directory(F.col("path")).alias("above")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("from"), "license")).alias("g")
    ).select("above", F.col("g.from").alias("inherited_from"), F.col("g.license").alias("given"), (-F.col("g.c")).alias("given_cosine"))
    folders = rows.where("path is not null").select(directory(F.col("path")).alias("folder")).distinct()
    nearest = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.*").join(given, "above")
    nearest = nearest.groupBy("folder").agg(F.max_by(F.struct("inherited_from", "given", "given_cosine"), "depth").alias("n")).select("folder", "n.*")
    named = files.select(F.col(key), F.col(path).alias("path")).withColumn("folder", directory(F.col("path")))
    own = own.select(F.col(key).alias("own_key"), F.col("path").alias("own_path"), "whole", "cosine", "license")
    joined = named.join(own, named[key].eqNullSafe(own["own_key"]) & named["path"].eqNullSafe(own["own_path"]), "left")
    # a folder can hold a third of all files: its files are dealt over SALTS keys, and what it inherits goes along with each
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = joined.withColumn("salt", F.pmod(F.xxhash64(key, "path"), F.lit(SALTS)).cast("int")).join(salted, ["folder", "salt"], "left")
    has = F.col("license").isNotNull()
    return joined.select(
        key,
        "path",
        F.coalesce("license", "given").alias("license"),
        F.round(F.coalesce("cosine", "given_cosine"), 6).alias("cosine"),
        F.when(F.col("whole") == 1, "file").when(has, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("inherited_from")).alias("inherited_from"),
    )


def corpus_licenses(documents: DataFrame) -> DataFrame:
    """The scan over documents, each taken for a file source/language/id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return license_scan(documents.select("doc_id", path.alias("path"), "text"))
