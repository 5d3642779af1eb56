"""Registered jobs of grading, first tests, question bank and selection, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import scalar
from gradeflow.operators import curation, grading, mastery, selection
from gradeflow.plans.adapters import domain
from gradeflow.plans.jobs import ABILITY, MASTERY, ZONES, _mastery, eig_scores, job
from gradeflow.storage import stored


@job("""SELECT r.session_id AS session_id, r.user_id AS user_id, r.question_id AS question_id, line, subtopic_id, created_at, correct, time_taken, status, s.game_type AS game_type, start_time,
    q.difficulty AS difficulty, q.game_type AS question_game FROM responses r JOIN sessions s ON r.session_id = s.session_id JOIN (SELECT question_id, difficulty, game_type FROM questions) q ON r.question_id = q.question_id""")
def session_answers(spark: SparkSession, d: str) -> DataFrame:
    return grading.session_answers(*(domain(spark, d, v) for v in ("sessions", "responses", "questions")))


GRADED = """graded AS (SELECT i.session_id, item_id, coalesce(game_type, '') AS game_type, CASE WHEN skipped THEN '' ELSE given_answer END AS user_answer,
    CASE WHEN skipped THEN FALSE WHEN game_type IN ('crossword', 'wordsearch') THEN upper(regexp_replace(given_answer, '[^A-Za-z]', '', 'g')) = upper(regexp_replace(correct_answer, '[^A-Za-z]', '', 'g'))
        ELSE lower(trim(given_answer)) = lower(trim(correct_answer)) END AS is_correct, CASE WHEN skipped THEN 0 ELSE time_taken END AS time_taken
    FROM items i JOIN sessions s ON i.session_id = s.session_id)"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    items = domain(spark, d, "items")
    games = domain(spark, d, "sessions").select("session_id", "game_type")
    given = items.where("not skipped").select("session_id", "item_id", F.col("given_answer").alias("user_answer"), "time_taken")
    return grading.grade_answers(items.select("session_id", "item_id", "correct_answer").join(games, "session_id"), given)


@job(f"WITH {GRADED} SELECT * FROM graded")
def grade_answers(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d)


@job(f"WITH {GRADED} SELECT session_id, item_id, user_answer, is_correct, CASE WHEN is_correct THEN 1.0 ELSE 0.0 END::DOUBLE AS score, time_taken AS response_time FROM graded")
def log_response_events(spark: SparkSession, d: str) -> DataFrame:
    """The two logged rows of each answer, side by side."""
    game, score = grading.response_events(_graded(spark, d))
    return game.drop("time_taken").join(score, ["session_id", "item_id"])


@job("""WITH w AS (SELECT session_id, item_id, upper(regexp_replace(correct_answer, '[^A-Za-z]', '', 'g')) AS w, item_id % 2 = 0 AS placed FROM items),
    f AS (SELECT session_id, w, min(item_id) AS item_id FROM w WHERE w <> '' GROUP BY ALL)
    SELECT DISTINCT f.session_id AS session_id, f.item_id AS item_id FROM f JOIN w ON f.session_id = w.session_id AND f.w = w.w WHERE placed""")
def grid_eligible_questions(spark: SparkSession, d: str) -> DataFrame:
    """The words of items with even numbers stand for what the grids hold."""
    items = domain(spark, d, "items")
    return grading.grid_eligible(items.where("item_id % 2 = 0").select("session_id", F.lower("correct_answer").alias("word")), items)


@job("""SELECT question_id, CASE WHEN p_size % 4 = 0 THEN CAST(subtopic_id + 1 AS VARCHAR) WHEN p_size % 4 = 1 THEN subtopic_id || ',' || p_size
    WHEN p_size % 4 = 2 THEN CAST(p_size AS VARCHAR) ELSE CAST(question_id AS VARCHAR) END AS ids FROM bank""")
def extract_subtopic_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each quarter of the bank names its subtopics in another place."""
    b, kind = domain(spark, d, "bank"), F.col("p_size") % 4
    long = lambda *cs: F.array(*[F.col(c).cast("bigint") for c in cs])
    ids = scalar.first_subtopic_ids(
        F.when(kind == 0, F.col("subtopic_id") + 1), F.when(kind == 1, long("subtopic_id", "p_size")).otherwise(F.array().cast("array<bigint>")),
        F.when(kind == 2, F.array(F.struct(F.lit(None).cast("bigint").alias("id")), F.struct(F.col("p_size").cast("bigint").alias("id")))), F.when(kind == 3, long("question_id")),
    )
    return b.select("question_id", F.array_join(ids, ",").alias("ids"))


TESTS = """tests AS (SELECT student AS user_id, correct, ts, event_id, (event_id * 7) % 97 AS s1, (event_id * 7 + 1) % 97 AS s2,
    CASE event_id % 4 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced' ELSE 'master' END AS difficulty FROM attempts WHERE skill IN ('click', 'view')),
    each AS (SELECT user_id, correct, difficulty, event_id, unnest([s1, s2]) AS subtopic_id FROM tests),
    stats AS (SELECT user_id, subtopic_id, count(*) AS total, count(*) FILTER (WHERE correct = 1) AS "right",
        coalesce(arg_max(difficulty, event_id) FILTER (WHERE difficulty IN ('advanced', 'master')), CASE WHEN bool_or(difficulty = 'intermediate') THEN 'intermediate' ELSE 'beginner' END) AS difficulty
        FROM each GROUP BY ALL)"""


def _first_test(spark: SparkSession, d: str) -> DataFrame:
    a = domain(spark, d, "attempts").where("skill in ('click', 'view')")
    level = F.get(F.array(*[F.lit(x) for x in curation.LEVELS]), (F.col("event_id") % 4).cast("int"))
    ids = F.array((F.col("event_id") * 7) % 97, (F.col("event_id") * 7 + 1) % 97)
    return grading.first_test_stats(a.select(F.col("student").alias("user_id"), ids.alias("subtopic_ids"), "correct", level.alias("difficulty"), F.col("event_id").alias("place")))


@job(f"WITH {TESTS} SELECT * FROM stats")
def preassessment_subtopic_stats(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views stand for the answers of the first test."""
    return _first_test(spark, d)


@job(f"""WITH {TESTS}, k AS (SELECT u.user_id, s.subtopic_id, stats.total, stats."right" * 1.0 / stats.total >= 0.5 AS ok, stats.difficulty,
        CASE learner_cluster WHEN 0 THEN 0.40::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.10::DOUBLE END AS k, CASE learner_cluster WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.10::DOUBLE ELSE 0.15::DOUBLE END AS slip,
        CASE learner_cluster WHEN 0 THEN 0.20::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.30::DOUBLE END AS guess
        FROM users u JOIN (SELECT DISTINCT user_id FROM stats) t ON t.user_id = u.user_id CROSS JOIN subtopics s LEFT JOIN stats ON stats.user_id = u.user_id AND stats.subtopic_id = s.subtopic_id),
    p AS (SELECT *, least(greatest(CASE WHEN ok THEN k * (1 - slip) / (k * (1 - slip) + (1 - k) * guess) ELSE k * slip / (k * slip + (1 - k) * (1 - guess)) END, 0.05), 0.95) AS post FROM k)
    SELECT user_id, subtopic_id, round(100 * CASE WHEN total > 0 THEN least(greatest(k + (post - k) * CASE difficulty WHEN 'beginner' THEN 1.0 WHEN 'intermediate' THEN 1.1 WHEN 'advanced' THEN 1.25 ELSE 1.4 END, 0.05), 0.95)
        ELSE k END, 6) AS mastery FROM p""")
def preassessment_init(spark: SparkSession, d: str) -> DataFrame:
    """For the users that took the first test."""
    stats = stored(_first_test(spark, d), "first_test")
    users = domain(spark, d, "users").join(stats.select("user_id").distinct(), "user_id", "left_semi")
    return grading.first_mastery(stats, users, domain(spark, d, "subtopics"))


SNAPSHOTS = 'snaps AS (SELECT student AS user_id, skill AS topic_id, ts AS "at", 100 * avg(correct) OVER (PARTITION BY student, skill ORDER BY ts ROWS UNBOUNDED PRECEDING) AS percent FROM attempts)'


def _history(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    share = F.avg("correct").over(W.partitionBy("student", "skill").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    snaps = domain(spark, d, "attempts").select(F.col("student").alias("user_id"), F.col("skill").alias("topic_id"), F.col("ts").alias("at"), (100 * share).alias("percent"))
    return grading.proficiency_history(snaps)


HISTORY = f"""{SNAPSHOTS}, h AS (SELECT *, lag(percent, 1, 0.0) OVER (PARTITION BY user_id, topic_id ORDER BY "at") AS b FROM snaps),
    history AS (SELECT user_id, topic_id, "at", round(percent, 6) AS percent FROM h WHERE abs(percent - b) > 0.01)"""


@job(f"WITH {HISTORY} SELECT * FROM history")
def proficiency_history(spark: SparkSession, d: str) -> DataFrame:
    """Running accuracies stand for proficiency after each session."""
    return _history(spark, d).withColumn("percent", F.round("percent", 6))


@job(f"""WITH {HISTORY}, past AS (SELECT * FROM history WHERE user_id % 2 = 0), now AS (SELECT user_id, topic_id, max("at") AS "at", round(arg_max(percent, "at"), 6) AS percent FROM snaps GROUP BY user_id, topic_id)
    SELECT * FROM past UNION ALL SELECT * FROM now WHERE user_id NOT IN (SELECT user_id FROM past)""")
def history_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Only users with even ids have a history; the current values are those of the last session."""
    from pyspark.sql import Window as W

    share = F.avg("correct").over(W.partitionBy("student", "skill").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    snaps = domain(spark, d, "attempts").select(F.col("student").alias("user_id"), F.col("skill").alias("topic_id"), F.col("ts").alias("at"), (100 * share).alias("percent"))
    now = snaps.groupBy("user_id", "topic_id").agg(F.max("at").alias("at"), F.round(F.max_by("percent", "at"), 6).alias("percent"))
    past = _history(spark, d).where("user_id % 2 = 0").withColumn("percent", F.round("percent", 6))
    return grading.history_bootstrap(past, now)


def _bank(spark: SparkSession, d: str) -> DataFrame:
    counts = F.when(F.col("flag_count") > 0, F.create_map("difficulty", "flag_count")).otherwise(F.create_map().cast("map<string,int>"))
    return domain(spark, d, "bank").withColumn("flag_count_by_level", counts)


@job("""SELECT question_id, flag_reason, difficulty FROM bank WHERE flagged AND contains(lower(flag_reason), 'typo') AND game_type = 'non_coding'
    AND (flag_count = 0 OR difficulty = 'advanced')""")
def flagged_questions(spark: SparkSession, d: str) -> DataFrame:
    return curation.flagged(_bank(spark, d), "TYPO", "non_coding", "advanced").select("question_id", "flag_reason", "difficulty")


@job("""SELECT question_id, reason FROM (SELECT question_id, CASE WHEN length(trim(question_text)) < 10 THEN 'text' WHEN length(trim(correct_answer)) < 1 THEN 'answer' WHEN topic_id IS NULL THEN 'subtopic'
    WHEN status = 'processing' THEN 'processing' END AS reason FROM bank WHERE question_id >= (SELECT max(question_id) FROM bank) - 1000) x WHERE reason IS NOT NULL""")
def malformed_questions(spark: SparkSession, d: str) -> DataFrame:
    return curation.malformed(domain(spark, d, "bank"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Raw questions in batches, of which some lack a field, repeat a function or use older names."""
    kind = F.col("p_size")
    coding = [n for n in curation.CODING_FIELDS if n not in ("hidden_tests", "function_name", "clean_solution")]
    parts = [F.lit("question_text"), "question_text", F.lit("difficulty"), "difficulty", F.lit("answer"), "correct_answer"]
    for n in coding:
        parts += [F.lit(n), F.when((kind % 10 == 3) & F.lit(n == "sample_input"), F.lit(" ")).otherwise(F.concat(F.lit(n), kind.cast("string")))]
    parts += [F.lit("hidden_tests"), F.when(kind % 10 == 7, F.lit("[]")).otherwise(F.lit("[1, 2]")), F.lit("function_name"), F.concat(F.lit("f"), (F.col("question_id") % 40).cast("string"))]
    parts += [F.lit("clean_solution"), F.when(kind % 2 == 0, F.lit("x = 1")), F.lit("correct_code"), F.lit("x = 2")]
    return domain(spark, d, "bank").select((F.col("question_id") / 50).cast("bigint").alias("batch"), F.col("question_id").alias("place"), F.col("question_id").alias("id"), "game_type", F.create_map(*parts).alias("fields"))


@job("""WITH r AS (SELECT question_id // 50 AS batch, question_id AS place, game_type, p_size, correct_answer,
        row_number() OVER (PARTITION BY question_id // 50, game_type = 'coding', question_id % 40 ORDER BY question_id) AS k FROM bank),
    e AS (SELECT *, CASE WHEN game_type = 'coding' AND k > 1 THEN 'function_name twice' WHEN game_type = 'coding' AND p_size % 10 = 3 THEN 'sample_input' WHEN game_type = 'coding' AND p_size % 10 = 7 THEN 'hidden_tests'
        WHEN game_type = 'coding' AND p_size % 2 = 1 THEN 'clean_solution' WHEN game_type <> 'coding' AND trim(correct_answer) = '' THEN 'answer' END AS reason FROM r)
    SELECT batch, place, reason IS NULL AS is_valid, reason FROM e""")
def validate_questions(spark: SparkSession, d: str) -> DataFrame:
    return curation.validated(_fields(spark, d))


@job("""SELECT question_id AS id, game_type, CASE WHEN game_type = 'coding' THEN CASE WHEN p_size % 2 = 0 THEN 'x = 1' ELSE 'x = 2' END END AS solution,
    CASE WHEN game_type <> 'coding' THEN correct_answer END AS answer, CASE WHEN game_type = 'coding' THEN 12 ELSE 4 END AS n FROM bank""")
def format_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = curation.formatted(_fields(spark, d))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    return rows.select("id", "game_type", get("clean_solution").alias("solution"), get("answer").alias("answer"), F.size("fields").alias("n"))


@job("""SELECT question_id, concat('{"explanation":"', json_extract_string(game_data, '$.explanation'), '","n":', p_size, CASE WHEN p_size % 5 = 1 THEN ',"rag_context":{"x":[1,2]}' ELSE '' END, '}') AS game_data,
    concat_ws(',', CASE WHEN p_size % 6 = 0 THEN 'context' END, CASE WHEN p_size % 5 < 2 THEN 'rag_context.used' END, CASE WHEN p_size % 4 = 0 THEN 'used' END) AS removed FROM bank""")
def clean_game_data(spark: SparkSession, d: str) -> DataFrame:
    return curation.cleaned_data(domain(spark, d, "bank")).withColumn("removed", F.array_join("removed", ","))


@job("SELECT field, count(*) AS questions FROM (SELECT unnest(json_keys(game_data)) AS field FROM bank) x WHERE field IN ('used', 'context', 'auto_generated', 'pipeline_version', 'is_cross_subtopic') GROUP BY field")
def deprecated_field_audit(spark: SparkSession, d: str) -> DataFrame:
    return curation.deprecated_fields(domain(spark, d, "bank"))


@job("""SELECT question_id, difficulty FROM questions WHERE game_type = 'non_coding' AND NOT flagged AND regexp_matches(correct_answer, '[A-Za-z]')
    AND subtopic_id IN (SELECT subtopic_id FROM subtopics s JOIN topics t ON s.topic_id = t.topic_id WHERE zone_id = 1) AND question_id NOT IN (SELECT question_id FROM responses WHERE correct = 0 AND time_taken = 50)""")
def playable_questions(spark: SparkSession, d: str) -> DataFrame:
    """Of zone 1, without those that took somebody 50 seconds and still went wrong."""
    topics = domain(spark, d, "topics").where("zone_id = 1")
    subtopics = domain(spark, d, "subtopics").join(topics.select("topic_id"), "topic_id", "left_semi")
    return curation.playable(domain(spark, d, "questions"), "non_coding", subtopics, domain(spark, d, "responses").where("correct = 0 and time_taken = 50").select("question_id").distinct()).select("question_id", "difficulty")


@job("SELECT s_name AS candidate FROM supplier WHERE lower(replace(s_name, 'Supplier', 'Customer')) IN (SELECT lower(username) FROM users)")
def username_taken(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are suppliers' names with another word in front; case doesn't count."""
    names = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("candidate"), F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("name"))
    return names.join(domain(spark, d, "users").select(F.lower("username").alias("name")), "name", "left_semi").select("candidate")


@job("SELECT question_id, CASE WHEN question_id IN (SELECT question_id FROM responses WHERE correct = 0) THEN 'needs_review' ELSE status END AS status FROM questions WHERE NOT flagged")
def bulk_status_update(spark: SparkSession, d: str) -> DataFrame:
    """Questions that anybody got wrong need a review; flagged ones are deleted."""
    q = domain(spark, d, "questions")
    changed = curation.set_status(q, domain(spark, d, "responses").where("correct = 0"), "needs_review")
    return curation.deleted(changed, q.where("flagged")).select("question_id", "status")


@job("""WITH t AS (SELECT student AS question_id, list({'level': CASE event_id % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'advanced' ELSE 'master' END, 'reason': skill} ORDER BY ts) AS xs FROM attempts GROUP BY student),
    f AS (SELECT question_id, list_reduce(xs, lambda a, x: {'flag': NOT a.flag, 'reason': CASE WHEN NOT a.flag THEN x.reason END,
        'b': CASE WHEN x.level = 'beginner' THEN CASE WHEN NOT a.flag THEN a.b + 1 ELSE greatest(a.b - 1, 0) END ELSE a.b END,
        'd': CASE WHEN x.level = 'advanced' THEN CASE WHEN NOT a.flag THEN a.d + 1 ELSE greatest(a.d - 1, 0) END ELSE a.d END,
        'm': CASE WHEN x.level = 'master' THEN CASE WHEN NOT a.flag THEN a.m + 1 ELSE greatest(a.m - 1, 0) END ELSE a.m END}, {'flag': FALSE, 'reason': NULL::VARCHAR, 'b': 0, 'd': 0, 'm': 0}) AS s FROM t)
    SELECT question_id, s.flag AS flagged, s.reason AS reason, concat_ws(',', s.b, 0, s.d, s.m) AS counts FROM f""")
def flag_fold(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for toggles; the user for the question."""
    level = F.get(F.array(F.lit("beginner"), F.lit("advanced"), F.lit("master")), (F.col("event_id") % 3).cast("int"))
    return curation.folded_flags(domain(spark, d, "attempts").select(F.col("student").alias("question_id"), F.col("ts").alias("at"), level.alias("level"), F.col("skill").alias("reason")))


@job("""SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'New ' || question_text ELSE question_text END AS question_text, CASE WHEN question_id % 3 = 0 AND p_size % 2 = 0 THEN 'y = 1' ELSE correct_answer END AS correct_answer,
    difficulty, CASE WHEN question_id % 3 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN question_id % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'clean_solution,question_text' ELSE 'question_text' END ELSE '' END AS applied FROM bank""")
def apply_accepted_fields(spark: SparkSession, d: str) -> DataFrame:
    """A third of the bank was regenerated; the new difficulty isn't accepted, and half has no solution."""
    b = domain(spark, d, "bank")
    fields = F.create_map(F.lit("question_text"), F.concat(F.lit("New "), "question_text"), F.lit("difficulty"), F.lit("master"), F.lit("clean_solution"), F.when(F.col("p_size") % 2 == 0, F.lit("y = 1")))
    new = b.where("question_id % 3 = 0").select("question_id", fields.alias("fields"), F.array(F.lit("question_text"), F.lit("clean_solution")).alias("accepted"))
    return curation.apply_accepted(b, new)


@job("SELECT question_id FROM questions ORDER BY md5('7|' || question_id), question_id LIMIT 25")
def question_batch(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five at random, by a seed."""
    return curation.batch(domain(spark, d, "questions"), 25, 7).select("question_id")


@job("SELECT question_id, difficulty FROM questions ORDER BY question_id DESC LIMIT 20 OFFSET 40")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    """The third page of twenty of the newest questions."""
    return curation.page(domain(spark, d, "questions"), [F.desc("question_id")], 3, 20)[0].select("question_id", "difficulty")


@job("""WITH r AS (SELECT zone_id, subtopic_id, row_number() OVER (PARTITION BY zone_id ORDER BY subtopic_id) AS i, count(*) OVER (PARTITION BY zone_id) AS n FROM subtopics s JOIN topics t ON s.topic_id = t.topic_id),
    p AS (SELECT a.zone_id, a.subtopic_id || ',' || b.subtopic_id AS members, a.n, row_number() OVER (PARTITION BY a.zone_id ORDER BY a.i, b.i) AS k FROM r a JOIN r b ON a.zone_id = b.zone_id AND a.i < b.i),
    few AS (SELECT * FROM r WHERE i <= 2 OR i <= n // 3 + 3),
    t AS (SELECT a.zone_id, a.subtopic_id || ',' || b.subtopic_id || ',' || c.subtopic_id AS members, a.n, row_number() OVER (PARTITION BY a.zone_id ORDER BY a.i, b.i, c.i) AS k
        FROM few a JOIN few b ON a.zone_id = b.zone_id AND a.i < b.i AND a.i = 1 AND b.i = 2 JOIN few c ON a.zone_id = c.zone_id AND b.i < c.i)
    SELECT zone_id, 1 AS size, CAST(subtopic_id AS VARCHAR) AS members FROM r UNION ALL SELECT zone_id, 2, members FROM p WHERE k <= greatest(1, n // 2) UNION ALL SELECT zone_id, 3, members FROM t WHERE k <= greatest(1, n // 3)""")
def zone_combinations(spark: SparkSession, d: str) -> DataFrame:
    return curation.zone_combinations(domain(spark, d, "subtopics"), domain(spark, d, "topics"))


def _smart_sql(difficulty: str) -> str:
    size = curation.COMBINED[difficulty]
    return f"""SELECT zone_id, '{difficulty}' AS difficulty, row_number() OVER (PARTITION BY zone_id ORDER BY size, a, b) AS place, members FROM (
        SELECT zone_id, 1 AS size, i AS a, 0 AS b, CAST(subtopic_id AS VARCHAR) AS members FROM o
        UNION ALL SELECT zone_id, 2, k, 0, members FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY crosses, f1, f2, i1, i2) AS k FROM p) x WHERE k <= n // 2 AND {size} >= 2
        UNION ALL SELECT zone_id, 3, k, 0, members FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY i1, i2, i3) AS k FROM t) x WHERE k <= n // 3 AND {size} >= 3) y"""


@job(f"""WITH o AS (SELECT t.zone_id AS zone_id, s.topic_id AS topic_id, subtopic_id, row_number() OVER (PARTITION BY t.zone_id ORDER BY subtopic_id) AS i, min(subtopic_id) OVER (PARTITION BY t.zone_id, s.topic_id) AS first,
        count(*) OVER (PARTITION BY t.zone_id) AS n FROM subtopics s JOIN topics t ON s.topic_id = t.topic_id),
    p AS (SELECT a.zone_id AS zone_id, a.n AS n, a.topic_id <> b.topic_id AS crosses, a.first AS f1, b.first AS f2, a.i AS i1, b.i AS i2, concat(a.subtopic_id, ',', b.subtopic_id) AS members
        FROM o a JOIN o b ON a.zone_id = b.zone_id AND a.i < b.i WHERE a.topic_id = b.topic_id OR (a.subtopic_id = a.first AND b.subtopic_id = b.first)),
    t AS (SELECT a.zone_id AS zone_id, a.n AS n, a.i AS i1, b.i AS i2, c.i AS i3, concat(a.subtopic_id, ',', b.subtopic_id, ',', c.subtopic_id) AS members
        FROM o a JOIN o b ON a.zone_id = b.zone_id AND a.i < b.i JOIN o c ON a.zone_id = c.zone_id AND b.i < c.i WHERE a.i <= 2 AND b.i <= 2)
    {" UNION ALL ".join(_smart_sql(k) for k in curation.COMBINED)}""")
def smart_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Singles, pairs and triples of each zone for each difficulty, those of one topic first."""
    parts = [curation.smart_combinations(domain(spark, d, "subtopics"), domain(spark, d, "topics"), k).withColumn("difficulty", F.lit(k)) for k in curation.COMBINED]
    every = reduce(DataFrame.unionByName, parts)
    return every.select("zone_id", "difficulty", "place", F.array_join("members", ",").alias("members"))


@job("""SELECT topic_id, n AS subtopics, CASE WHEN n > 1 THEN greatest(1, n * 5 // (n - 1)) ELSE 0 END AS each FROM (SELECT topic_id, count(*) AS n FROM subtopics GROUP BY topic_id) x""")
def question_budget(spark: SparkSession, d: str) -> DataFrame:
    """Five questions a subtopic over one combination less than there are subtopics."""
    n = domain(spark, d, "subtopics").groupBy("topic_id").agg(F.count("*").alias("subtopics"))
    return n.withColumn("each", curation.question_budget(F.col("subtopics") - 1, F.col("subtopics"), 5))


@job(r"""SELECT subtopic_id, CASE WHEN subtopic_id % 2 = 0 THEN 'kept' ELSE regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g') END AS slug,
    CASE WHEN subtopic_id % 3 = 0 THEN 'known' ELSE 'Learn about ' || lower(name) || ' concepts and fundamentals.' END AS concept_intent, 'Practice ' || lower(name) || ' with hands-on coding examples.' AS code_intent FROM subtopics""")
def backfill_text_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = domain(spark, d, "subtopics").select("subtopic_id", "name", F.when(F.col("subtopic_id") % 2 == 0, "kept").alias("slug"), F.when(F.col("subtopic_id") % 3 == 0, "known").otherwise("").alias("concept_intent"), F.lit(None).cast("string").alias("code_intent"))
    return curation.backfilled(rows)


BANDS = f"""{ZONES}, open_zone AS (SELECT user_id, coalesce(min(CASE WHEN round(completion, 9) < 100 THEN zone_order END), max(zone_order)) AS zone_order FROM zone_rows GROUP BY user_id),
    zone_subs AS (SELECT o.user_id, s.subtopic_id FROM open_zone o JOIN zones z ON z.zone_order = o.zone_order JOIN topics t ON t.zone_id = z.zone_id JOIN subtopics s ON s.topic_id = t.topic_id),
    bands AS (SELECT z.user_id, z.subtopic_id, round(coalesce(m.mastery, 0), 9) AS m FROM zone_subs z LEFT JOIN mastery m ON m.user_id = z.user_id AND m.subtopic_id = z.subtopic_id)"""


def _open_zones(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mastery, each user's zone in progress, and the subtopics of the zones."""
    known = stored(_mastery(spark, d).select("user_id", "subtopic_id", "mastery"), "mastery")
    zone_rows = mastery.zone_completion(mastery.proficiency(known, domain(spark, d, "subtopics")), *(domain(spark, d, v) for v in ("topics", "zones", "users")))
    zones = mastery.current_zone(zone_rows).where("is_current").select("user_id", "zone_id").distinct()
    subtopics = domain(spark, d, "subtopics").join(domain(spark, d, "topics").select("topic_id", "zone_id"), "topic_id")
    return known, zones, subtopics.select("zone_id", "subtopic_id")


@job(f"""WITH {BANDS} SELECT user_id, subtopic_id, CASE WHEN m < 90 THEN 'weak' WHEN m < 100 THEN 'review' ELSE 'maintenance' END AS band,
    CASE WHEN m < 50 THEN 'low' WHEN m < 85 THEN 'mid' WHEN m < 90 THEN 'high' WHEN m < 100 THEN 'review' ELSE 'maintenance' END AS part FROM bands""")
def mastery_band_rows(spark: SparkSession, d: str) -> DataFrame:
    return curation.band_rows(*_open_zones(spark, d))


@job(f"""WITH {BANDS} SELECT DISTINCT user_id, subtopic_id FROM bands b WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.user_id = b.user_id AND r.subtopic_id = b.subtopic_id AND r.correct = 1)""")
def band_union(spark: SparkSession, d: str) -> DataFrame:
    """Subtopics of any band that the user has no right answer on."""
    _, zones, subtopics = _open_zones(spark, d)
    return curation.band_union(zones, subtopics, domain(spark, d, "responses").where("correct = 1").select("user_id", "subtopic_id"))


@job("""WITH n AS (SELECT question_id, CASE WHEN avg(correct) < 0.3 THEN 'master' WHEN avg(correct) < 0.6 THEN 'advanced' WHEN avg(correct) < 0.8 THEN 'intermediate' ELSE 'beginner' END AS level, count(*) AS k FROM responses GROUP BY question_id)
    SELECT count(*) AS checked, count(*) FILTER (WHERE k >= 5 AND level <> difficulty) AS updated, count(*) FILTER (WHERE k >= 5 AND level = difficulty) AS unchanged, count(*) FILTER (WHERE k IS NULL OR k < 5) AS skipped
    FROM questions q LEFT JOIN n ON n.question_id = q.question_id""")
def bulk_difficulty_summary(spark: SparkSession, d: str) -> DataFrame:
    from gradeflow.operators import irt
    from gradeflow.plans.jobs import analytics_log

    new = irt.score_recalibration(analytics_log(spark, d)).select("question_id", "level")
    rows = domain(spark, d, "questions").join(new, "question_id", "left")
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("level") != F.col("difficulty")).alias("updated"), F.count_if(F.col("level") == F.col("difficulty")).alias("unchanged"), F.count_if(F.col("level").isNull()).alias("skipped"))


POOLS = f"""{BANDS}, {ABILITY},
    scored AS (SELECT b.user_id, q.question_id, q.subtopic_id, q.difficulty, CASE WHEN m < 50 THEN 'low' WHEN m < 85 THEN 'mid' WHEN m < 90 THEN 'high' WHEN m < 100 THEN 'review' ELSE 'maintenance' END AS part,
        0.7 * m / 100 + 0.3 * coalesce(a.ability, 0.5) AS k, d.v FROM bands b JOIN questions q ON q.subtopic_id = b.subtopic_id LEFT JOIN ability a ON a.user_id = b.user_id
        JOIN (VALUES ('beginner', 0.0::DOUBLE), ('intermediate', 0.33), ('advanced', 0.67), ('master', 1.0)) d(difficulty, v) ON d.difficulty = q.difficulty
        WHERE q.game_type = 'non_coding' AND NOT flagged AND regexp_matches(correct_answer, '[A-Za-z]'))"""


@job()
def select_question_set(spark: SparkSession, d: str) -> DataFrame:
    """Ten questions for each user by the quotas of weak, review and maintained subtopics, filled up from the rest."""
    known, zones, subtopics = _open_zones(spark, d)
    ability = mastery.ability_update(mastery.session_accuracy(domain(spark, d, "responses")))
    pool = curation.playable(domain(spark, d, "questions"), "non_coding", domain(spark, d, "subtopics")).select("question_id", "subtopic_id", "difficulty")
    rows = selection.set_candidates(curation.in_parts(known), ability, zones, subtopics, pool, 10, 7)
    gain = scalar.information_gain(F.coalesce("known", F.lit(0.0)), F.coalesce("ability", F.lit(0.5)), scalar.normalize_difficulty(F.col("difficulty")))
    return selection.question_set(rows.withColumn("gain", gain), 10, 7)
