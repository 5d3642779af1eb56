"""Question dumps, exports, and questions out of a language model's answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("beginner", "intermediate", "advanced", "master")
DUMP = "question_text STRING, difficulty STRING, game_type STRING, game_data STRUCT<normal: STRUCT<question_text: STRING>>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(text, difficulty) of dumps that each hold one JSON array: known levels alone, no empty texts."""
    raw = spark.read.schema(DUMP).json(path, multiLine=True)
    text = F.trim(F.coalesce(F.nullif("question_text", F.lit("")), F.col("game_data.normal.question_text")))
    rows = raw.select(text.alias("text"), F.lower(F.trim("difficulty")).alias("difficulty"))
    return rows.where(F.col("difficulty").isin(*LEVELS) & (F.col("text") != ""))


def exported(questions: DataFrame, exported_at: str) -> DataFrame:
    """(question_id, game_type, document): each question as the JSON document it is exported as. questions: (question_id, game_type,
    question_text, correct_answer, difficulty, subtopic, created_at, fields: map); older names of a field stand in for it."""
    field = lambda n, *old: F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(x)), F.lit("")) for x in (n, *old)], F.lit("")).alias(n)
    stamp = F.coalesce(F.try_element_at("fields", F.lit("generation_timestamp")), F.lit(exported_at)).alias("generation_timestamp")
    tests = F.coalesce(F.from_json(F.try_element_at("fields", F.lit("hidden_tests")), "array<string>"), F.array().cast("array<string>")).alias("hidden_tests")
    normal = F.struct(F.col("question_text"), field("function_name"), field("sample_input"), field("sample_output"), tests, field("clean_solution", "correct_code"), field("explanation")).alias("normal")
    buggy = F.struct(field("buggy_question_text"), field("code_shown_to_student", "buggy_code"), field("code_with_bug_fixed", "buggy_correct_code"), field("buggy_explanation", "buggy_code_explanation")).alias("buggy")
    last = [F.col("created_at"), F.lit(exported_at).alias("exported_at")]
    coding = F.to_json(F.struct("game_type", "difficulty", "subtopic", F.struct(normal, buggy, stamp).alias("game_data"), *last))
    other = F.to_json(F.struct("question_text", "correct_answer", "game_type", "difficulty", "subtopic", F.struct(field("explanation"), stamp).alias("game_data"), *last))
    return questions.select("question_id", "game_type", F.when(F.col("game_type") == "coding", coding).otherwise(other).alias("document"))


def write_exports(documents: DataFrame, path: str) -> None:
    """One folder of lines of JSON for each kind of game."""
    documents.select("game_type", F.col("document").alias("value")).write.partitionBy("game_type").text(path)


def _balanced(text: str) -> str | None:
    """The first complete pair of square brackets in a text, with what is inside."""
    start = text.find("[")
    depth = 0
    for at, c in enumerate(text[start:], start) if start >= 0 else ():
        depth += (c == "[") - (c == "]")
        if not depth:
            return text[start : at + 1]
    return None


def parsed(text: str | None) -> list[str] | None:
    """The questions of one answer as JSON texts: of its fenced part if it has one; as it is, or with stray backslashes doubled,
    or else of the first array in it. None where nothing parses."""
    text = (text or "").strip()
    fence = re.search(r"```json(.*?)```", text, re.S)
    text = fence[1].strip() if fence else text
    fixed = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", text)
    for whole in (True, False):
        for one in (text, fixed):
            try:
                found = json.loads(one if whole else _balanced(one) or "")
            except json.JSONDecodeError:
                continue
            found = found.get("questions", found) if isinstance(found, dict) else found
            found = [found] if isinstance(found, dict) else found
            return [json.dumps(q, sort_keys=True) for q in found] if isinstance(found, list) else None
    return None


def parse_responses(answers: DataFrame, key: str = "response_id", text: str = "text") -> DataFrame:
    """(key, place, question): a row for each question of each answer, as JSON; none for answers that nothing parses of."""

    @F.arrow_udf("array<string>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([parsed(t) for t in column.to_pylist()], pa.list_(pa.string()))

    return answers.select(key, F.posexplode(parse(F.col(text))).alias("place", "question"))


def field_of(question: Column, name: str) -> Column:
    return F.get_json_object(question, f"$.{name}")
