"""URL filter: a list of host and path rules first, and for the other URLs association rules over URL tokens.

Listed rules name a host, which stands for its subdomains too, and the beginning of a path; of those that fit, the longest decides. The
URLs that they decide are the labelled ones. Spark's FP-growth mines, from the tokens and labels of those, the combinations of tokens
that come with a label; rules below ``CONFIDENCE`` or ``SUPPORT`` go, and so do rules that a rule over fewer tokens makes
idle: one with the same label that is at least as sure. An inverted index holds each rule under its rarest token: the tokens
of a URL are joined with it, the rest of each rule found is compared, and the surest rule that holds gives the verdict (then the
one with more support, then allow). No rule: allow.

A URL's tokens fill fixed slots (scheme, three parts of the host, the first directory, the kind of its last part, the names of its query, the
fragment), so the combinations that FP-growth counts are bounded however long a URL is, and work grows with the rows alone.

The main path uses DataFrame functions and Spark's FP-growth only. URLs are read once for the labels and once for the verdicts,
and only those without a listed rule are shuffled, one small row each; the index is joined as Spark chooses by its size, and hot
tokens are no problem as it holds rules under their rarest.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; an empty path fits no listed
rule with a path, as every one has; repeated rows are rows of their own; without labelled URLs nothing is mined; an empty
table gives an empty one. Upper-case letters beyond A-Z stay as they are.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import stored

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Least share of the labelled URLs that hold a rule's tokens and label, never fewer URLs than ``FEWEST``; least share of the
#: URLs with the tokens that have the label.
SUPPORT, FEWEST, CONFIDENCE = 0.01, 5, 0.8
LABEL = "verdict="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What stands behind the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones that of the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*[F.when(fit, found) for fit, found in fits])


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The tokens of a URL, each in a slot of its own; empty slots give none."""
    labels = F.split(F.regexp_replace(host, r":\d*\z", ""), r"\.")
    last = F.element_at(F.split(path, "/"), -1)
    site = F.try_element_at(labels, F.lit(-3))
    words = F.split(site, "-")
    asked = F.regexp_extract(after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(asked, "&"), lambda x: F.split(x, "=")[0]))), "&")
    slots = {
        "scheme": F.substring_index(url, "://", 1),
        "top": F.try_element_at(labels, F.lit(-1)),
        "domain": F.try_element_at(labels, F.lit(-2)),
        "site": site,
        "first": F.when(F.size(words) > 1, words[0]),
        "last": F.when(F.size(words) > 1, F.element_at(words, -1)),
        "lead": F.when(F.size(labels) > 3, labels[0]),
        "dir": F.regexp_extract(path, r"\A/([^/]*)/", 1),
        "kind": F.when(last == "", "folder").when(last.rlike(r"\A[0-9]+\z"), "number").when(last.contains("."), F.concat(F.lit("."), F.substring_index(last, ".", -1))).otherwise("name"),
        "asks": names,
        "mark": F.regexp_extract(after_scheme(url), r"#(.*)", 1),
    }
    every = F.array(*[F.when(value != "", F.concat(F.lit(name + ":"), F.translate(value, UPPER, LOWER))) for name, value in slots.items()])
    return F.when(host != "", F.array_compact(every)).otherwise(F.array().cast("array<string>"))


RULE_COLUMNS = "tokens array<string>, verdict string, n bigint, confidence double"


def mined(labelled: DataFrame, support: float = SUPPORT, fewest: int = FEWEST, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, verdict, n, confidence): the rules kept. labelled: (tokens, verdict)."""
    spark = labelled.sparkSession
    rows = stored(labelled.select(F.array_append("tokens", F.concat(F.lit(LABEL), F.col("verdict"))).alias("items")), "labelled")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RULE_COLUMNS)
    least = max(fewest, math.ceil(support * n))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), numPartitions=spark.sparkContext.defaultParallelism).fit(rows).freqItemsets
    sets = stored(sets.where(F.col("freq") >= least).select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    is_label = lambda x: x.startswith(LABEL)
    with_label = sets.where(F.exists("items", is_label) & (F.size("items") > 1))
    whole = with_label.select(F.filter("items", lambda x: ~is_label(x)).alias("tokens"), F.substring(F.filter("items", is_label)[0], len(LABEL) + 1, 99).alias("verdict"), F.col("freq").alias("n"))
    rules = whole.join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens").withColumn("confidence", F.col("n") / F.col("freq"))
    rules = stored(rules.where(F.col("confidence") >= confidence).select("tokens", "verdict", "n", "confidence"), "rules")
    # each rule without one of its tokens: where that is a rule as sure, the longer one changes no verdict
    shorter = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("left")).select(F.array_remove("tokens", F.col("left")).alias("part"), "tokens", "verdict", "confidence")
    other = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure"))
    idle = shorter.join(other, ["part", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    return rules.join(idle, ["tokens", "verdict"], "left_anti")


def inverted(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """(token, rest, verdict, n, confidence): each rule under the token that the fewest labelled URLs hold, with its other tokens."""
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    numbered = rules.select("tokens", "verdict", "n", "confidence", F.explode("tokens").alias("token")).join(often, "token")
    rare = numbered.groupBy("tokens", "verdict", "n", "confidence").agg(F.min(F.struct("often", "token"))["token"].alias("token"))
    return rare.select("token", F.array_remove("tokens", F.col("token")).alias("rest"), "verdict", "n", "confidence")


def matched(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict): the verdict of the surest rule for each row of (keys, tokens); keys tell rows apart."""
    asked = rows.select(*keys, "tokens", F.explode_outer("tokens").alias("token"))
    found = asked.join(index, "token", "left")
    holds = F.size(F.array_except("rest", "tokens")) == 0
    best = F.max(F.when(holds, F.struct("confidence", "n", (F.col("verdict") == "allow").alias("allows"), "verdict")))
    return found.groupBy(*keys).agg(F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(key, host, path, rule, verdict) of every row."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("found", listed(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = rows.where("found is not null").select("tokens", F.col("found.verdict").alias("verdict"))
    index = stored(inverted(mined(labelled), labelled), "index")
    rest = rows.where("found is null").withColumn("row", F.monotonically_increasing_id())
    mine = matched(rest, index, ["row", "page_id", "host", "path"])
    done = rows.where("found is not null").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    return done.unionByName(mine.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), "verdict"))
