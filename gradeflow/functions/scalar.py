"""Scalar rules as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Difficulty labels on a scale from 0 to 1.
DIFFICULTY = {"beginner": 0.0, "intermediate": 0.33, "advanced": 0.67, "master": 1.0}
#: Slip, guess and mastery at the start, by learner cluster.
SLIP_GUESS = {"proficient": (0.05, 0.20), "mid": (0.10, 0.25), "novice": (0.15, 0.30)}
LEARN = 0.10
SLOW_GAMES = ("coding", "hangman", "debugging")
#: Learner clusters by number, mastery at the start, gain of right answers about code, gain by difficulty in the first test.
CLUSTERS = ("proficient", "mid", "novice")
CLUSTER_START = (0.40, 0.25, 0.10)
CODING_GAIN = 1.5
FIRST_TEST_GAIN = {"beginner": 1.0, "intermediate": 1.1, "advanced": 1.25, "master": 1.4}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normalize_difficulty(label: Column) -> Column:
    """A label brought to 0..1; 0.5 for any other text."""
    text = F.lower(F.trim(label))
    out = F.when(text.isNull(), F.lit(0.5))
    for name, value in DIFFICULTY.items():
        out = out.when(text == name, F.lit(value))
    return out.otherwise(F.lit(0.5))


def normalize_number(number: Column) -> Column:
    """A number brought to 0..1: 0 to 1 as it is, up to 4 by thirds; 0.5 for anything else."""
    number = number.cast("double")
    return F.when(number.between(0.0, 1.0), number).when((number > 1) & (number <= 4), (number - 1) / 3).otherwise(F.lit(0.5))


def cluster_parameter(cluster: Column, which: int) -> Column:
    """Slip (0) or guess (1) of a learner cluster; of novices where there is none."""
    out = F.when(cluster.isNull(), F.lit(SLIP_GUESS["novice"][which]))
    for number, name in enumerate(CLUSTERS):
        out = out.when(cluster == number, F.lit(SLIP_GUESS[name][which]))
    return out.otherwise(F.lit(SLIP_GUESS["novice"][which]))


def cluster_start(cluster: Column) -> Column:
    """Mastery at the start of a learner cluster; of novices where there is none."""
    out = F.when(cluster.isNull(), F.lit(CLUSTER_START[2]))
    for number, value in enumerate(CLUSTER_START):
        out = out.when(cluster == number, F.lit(value))
    return out.otherwise(F.lit(CLUSTER_START[2]))


def first_test_gain(difficulty: Column) -> Column:
    out = F.when(difficulty.isNull(), F.lit(1.0))
    for name, value in FIRST_TEST_GAIN.items():
        out = out.when(difficulty == name, F.lit(value))
    return out.otherwise(F.lit(1.0))


def first_subtopic_ids(subtopic_id: Column, subtopic_ids: Column, subtopics: Column, mapping_ids: Column) -> Column:
    """The subtopics of an answer, from the first of four places that names any. subtopics: array of structs with an id."""
    named = F.filter(F.transform(subtopics, lambda s: s["id"]), lambda x: x.isNotNull())
    some = lambda ids: F.when(F.size(ids) > 0, ids)
    one = F.when(F.coalesce(subtopic_id, F.lit(0)) != 0, F.array(subtopic_id))
    return F.coalesce(one, some(subtopic_ids), some(named), mapping_ids, F.array().cast("array<bigint>"))


def difficulty_weight(d: Column) -> Column:
    return clamp(F.lit(0.70) + F.lit(0.65) * d, 0.70, 1.35)


def lives_weight(remaining: Column, most: Column) -> Column:
    return F.when((most > 0) & remaining.isNotNull(), difficulty_weight(remaining / most)).otherwise(F.lit(1.0))


def time_weight(seconds: Column, game: Column, expected: Column | None = None) -> Column:
    """exp(-0.8 (t / reference - 1)) within 0.70 and 1.20; 1 without a time."""
    usual = F.when(game.isin(*SLOW_GAMES), F.lit(45.0)).otherwise(F.lit(30.0))
    reference = usual if expected is None else F.when(expected > 0, expected).otherwise(usual)
    return F.when(seconds > 0, clamp(F.exp(F.lit(-0.8) * (seconds / reference - 1)), 0.70, 1.20)).otherwise(F.lit(1.0))


def effective_correctness(correct: Column, difficulty: Column, time: Column, lives: Column) -> Column:
    """0 for a wrong answer, else the product of the weights within 0 and 1."""
    return F.when(correct == 1, clamp(difficulty_weight(difficulty) * time * lives, 0.0, 1.0)).otherwise(F.lit(0.0))


def recency_weight(last: Column, now: Column) -> Column:
    """1.05 a whole day since practice, at most 2; 1 if never practised."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(last)) / 86400)
    return F.when(last.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0) + F.lit(0.05) * days, F.lit(2.0)))


def bkt_posterior(mastery: Column, correct: Column, slip: Column | float, guess: Column | float) -> Column:
    """Mastery after one answer, within 0.05 and 0.95."""
    right = mastery * (1 - slip) / (mastery * (1 - slip) + (1 - mastery) * guess)
    wrong = mastery * slip / (mastery * slip + (1 - mastery) * (1 - guess))
    return clamp(F.when(correct == 1, right).otherwise(wrong), 0.05, 0.95)


def theta_level(theta: Column) -> Column:
    theta = F.coalesce(theta, F.lit(-1.0))
    return F.when(theta < -0.5, "beginner").when(theta < 0.5, "intermediate").when(theta < 1.5, "advanced").otherwise("master")


def item_level(b: Column) -> Column:
    return F.when(b >= 1, "master").when(b >= 0, "advanced").when(b >= -1, "intermediate").otherwise("beginner")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form has one ASCII letter or digit, what that is, and ligatures with more."""
    one, more = {}, {}
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]):
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalnum():
            one[c] = plain
        elif len(plain) in (2, 3) and plain.isalpha() and unicodedata.category(c) in ("Ll", "Lu", "Lt"):
            more[c] = plain
    return "".join(one), "".join(one.values()), more


def ascii_folded(text: Column) -> Column:
    """Letters and digits with accents, of full width and in ligatures as plain ones; other characters stay."""
    old, new, more = _folds()
    folded = F.translate(text, old, new)
    whole = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), more.items(), folded)
    return F.when(folded.rlike("[" + "".join(more) + "]"), whole).otherwise(folded)


def slugify(name: Column) -> Column:
    """A name in lower-case ASCII with hyphens: accents are folded before what isn't ASCII is dropped."""
    plain = F.regexp_replace(F.lower(F.trim(ascii_folded(name))), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[-\s]+", "-"), "^[-_]+|[-_]+$", "")


def sanitize_word(word: Column) -> Column:
    return F.upper(F.regexp_replace(word, "[^A-Za-z]", ""))


def document_title(file_name: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "[_-]", " "))


def entropy(p: Column, edge: float = 0.001) -> Column:
    p = clamp(p, edge, 1 - edge)
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def information_gain(known: Column, ability: Column, difficulty: Column) -> Column:
    """Expected entropy lost by asking: prior .7 known + .3 ability, slip and guess moved by the difficulty."""
    prior = F.lit(0.7) * known + F.lit(0.3) * ability
    slip, guess = F.lit(0.15) * (1 + F.lit(0.5) * difficulty), F.lit(0.25) * (1 - F.lit(0.3) * difficulty)
    right = prior * (1 - slip) + (1 - prior) * guess
    after_right = prior * (1 - slip) / right
    after_wrong = prior * slip / (1 - right)
    return F.greatest(entropy(prior) - right * entropy(after_right) - (1 - right) * entropy(after_wrong), F.lit(0.0))
