"""Registered jobs over the adapters' domain tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import scalar
from gradeflow.operators import bank, changes, content, games, irt, mastery, selection, tracing
from gradeflow.plans.adapters import domain, with_views
from gradeflow.storage import stored
from gradeflow.streaming import answers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def job(sql: str | None = None):
    """Registers a job under its name, with its SQL over the domain views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def analytics_log(spark: SparkSession, d: str) -> DataFrame:
    """The answer log with one id a row and a score."""
    key = F.struct("session_id", "line", "question_id", "subtopic_id", "created_at")
    return domain(spark, d, "responses").withColumn("id", key).withColumn("score", F.col("correct"))


@job("""SELECT user_id, session_id, count(correct) AS attempts, CAST(sum(correct) AS BIGINT) AS "right", round(avg(correct), 6) AS accuracy FROM responses GROUP BY ALL""")
def session_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mastery.session_accuracy(domain(spark, d, "responses")).drop("ended_at"), "accuracy")


#: What each answer is worth, and the accuracy of each (session, subtopic).
WORTH = """worth AS (SELECT r.*, coalesce(q.game_type = 'coding', FALSE) AS is_coding, CASE WHEN correct = 1 THEN least(greatest(
        least(greatest(0.70 + 0.65 * CASE q.difficulty WHEN 'beginner' THEN 0.0 WHEN 'intermediate' THEN 0.33 WHEN 'advanced' THEN 0.67 WHEN 'master' THEN 1.0 ELSE 0.5 END, 0.70), 1.35)
        * CASE WHEN time_taken > 0 THEN least(greatest(exp(-0.8 * (time_taken / CASE WHEN q.game_type IN ('coding', 'hangman', 'debugging') THEN 45.0::DOUBLE ELSE 30.0::DOUBLE END - 1)), 0.70), 1.20) ELSE 1.0 END, 0.0), 1.0)
        ELSE 0.0::DOUBLE END AS worth FROM responses r LEFT JOIN questions q ON r.question_id = q.question_id),
    parts AS (SELECT user_id, session_id, subtopic_id, count(*) AS attempts, round(avg(worth), 9) AS accuracy, max(created_at) AS ended_at, max(is_coding) AS is_coding
        FROM worth WHERE correct IS NOT NULL GROUP BY ALL)"""
_POSTERIOR = """least(greatest(CASE WHEN x.acc >= 0.5 THEN s.k * (1 - x.slip) / (s.k * (1 - x.slip) + (1 - s.k) * x.guess)
    ELSE s.k * x.slip / (s.k * x.slip + (1 - s.k) * (1 - x.guess)) END, 0.05), 0.95)"""
#: Mastery by a fold over each user's sessions on a subtopic.
MASTERY = f"""{WORTH},
    steps AS (SELECT p.user_id, subtopic_id, list({{'acc': accuracy, 'ended': ended_at, 'coding': is_coding,
        'slip': CASE learner_cluster WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.10::DOUBLE ELSE 0.15::DOUBLE END,
        'guess': CASE learner_cluster WHEN 0 THEN 0.20::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.30::DOUBLE END}} ORDER BY ended_at, session_id) AS xs
        FROM parts p LEFT JOIN users u ON p.user_id = u.user_id GROUP BY p.user_id, subtopic_id),
    mastery AS (SELECT user_id, subtopic_id, list_reduce(xs, lambda s, x: {{
        'k': least(greatest(s.k + (CASE WHEN x.acc >= 0.5 THEN {_POSTERIOR} + (1 - {_POSTERIOR}) * 0.10 ELSE {_POSTERIOR} END - s.k)
            * CASE WHEN s.last IS NULL THEN 1.0 ELSE least(1.0 + 0.05 * floor((epoch(x.ended) - epoch(s.last)) / 86400), 2.0) END
            * CASE WHEN x.acc >= 0.5 AND x.coding THEN 1.5 ELSE 1.0 END, 0.0), 1.0)::DOUBLE,
        'last': x.ended}}, {{'k': 0.0::DOUBLE, 'last': NULL::TIMESTAMP}}).k * 100 AS mastery FROM steps)"""
ABILITY = """s_acc AS (SELECT user_id, session_id, avg(correct) AS accuracy, max(created_at) AS ended_at FROM responses GROUP BY ALL),
    s_list AS (SELECT user_id, list(accuracy ORDER BY ended_at, session_id) AS xs FROM s_acc GROUP BY user_id),
    ability AS (SELECT user_id, list_reduce(xs, lambda acc, x: least(greatest(acc * 0.8 + x * 0.2, 0.01), 0.99), CAST(0.5 AS DOUBLE)) AS ability FROM s_list)"""
ZONES = f"""{MASTERY},
    topic_rows AS (SELECT m.user_id, s.topic_id, avg(mastery) AS percent FROM mastery m JOIN subtopics s ON m.subtopic_id = s.subtopic_id GROUP BY ALL),
    zone_have AS (SELECT r.user_id, t.zone_id, avg(percent) AS completion FROM topic_rows r JOIN topics t ON r.topic_id = t.topic_id GROUP BY ALL),
    zone_rows AS (SELECT u.user_id, z.zone_id, z.zone_order, coalesce(completion, 0.0) AS completion FROM users u CROSS JOIN zones z
        LEFT JOIN zone_have h ON h.user_id = u.user_id AND h.zone_id = z.zone_id)"""


@job(f"WITH {WORTH} SELECT user_id, session_id, subtopic_id, attempts, round(accuracy, 6) AS accuracy, is_coding FROM parts")
def subtopic_session_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_parts(spark, d).drop("ended_at"), "accuracy")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return mastery.subtopic_accuracy(mastery.with_effective(domain(spark, d, "responses"), domain(spark, d, "questions")))


def _mastery(spark: SparkSession, d: str) -> DataFrame:
    return mastery.mastery_update(_parts(spark, d), domain(spark, d, "users"))


@job(f"WITH {MASTERY} SELECT user_id, subtopic_id, round(mastery, 5) AS mastery FROM mastery")
def mastery_update(spark: SparkSession, d: str) -> DataFrame:
    return _mastery(spark, d).select("user_id", "subtopic_id", F.round("mastery", 5).alias("mastery"))


@job("""WITH s AS (SELECT user_id, session_id, avg(correct) AS accuracy, max(created_at) AS ended_at FROM responses GROUP BY ALL),
    o AS (SELECT user_id, list(accuracy ORDER BY ended_at, session_id) AS xs FROM s GROUP BY user_id)
    SELECT user_id, round(list_reduce(xs, lambda acc, x: least(greatest(acc * 0.8 + x * 0.2, 0.01), 0.99), CAST(0.5 AS DOUBLE)), 6) AS ability FROM o""")
def ability_update(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mastery.ability_update(mastery.session_accuracy(domain(spark, d, "responses"))), "ability")


@job("""WITH r AS (SELECT user_id, list(CAST(correct AS DOUBLE) ORDER BY created_at DESC, session_id DESC, line DESC, question_id DESC, subtopic_id DESC, created_at DESC) AS xs
        FROM responses WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 5)
    SELECT user_id, round(list_reduce(xs, lambda acc, x: least(greatest(acc + 0.1 * (x - 1 / (1 + exp(-acc))), -3.0), 3.0), CAST(0.0 AS DOUBLE)), 6) AS theta FROM r""")
def theta_update(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mastery.theta_update(analytics_log(spark, d)), "theta")


def _zones(spark: SparkSession, d: str) -> DataFrame:
    topic_rows = mastery.proficiency(_mastery(spark, d), domain(spark, d, "subtopics"))
    return mastery.zone_completion(topic_rows, domain(spark, d, "topics"), domain(spark, d, "zones"), domain(spark, d, "users"))


@job(f"WITH {ZONES} SELECT user_id, zone_id, zone_order, round(completion, 5) AS completion FROM zone_rows")
def proficiency_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _zones(spark, d).withColumn("completion", F.round("completion", 5))


@job(f"""WITH {ZONES}, c AS (SELECT z.user_id, username, zone_order, floor(round(completion, 6) * 100 + 0.5) / 100 AS c FROM zone_rows z JOIN users u ON z.user_id = u.user_id WHERE role = 'learner')
    SELECT user_id, username, floor(round(avg(c), 6) * 100 + 0.5) / 100 AS overall, string_agg(printf('%.2f', c), ',' ORDER BY zone_order) AS zones FROM c GROUP BY user_id, username""")
def completion_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return mastery.completion_leaderboard(_zones(spark, d), domain(spark, d, "users"))


@job(f"""WITH {ZONES}, n AS (SELECT *, coalesce(min(CASE WHEN round(completion, 9) < 100 THEN zone_order END) OVER (PARTITION BY user_id), max(zone_order) OVER (PARTITION BY user_id)) AS now FROM zone_rows)
    SELECT user_id, zone_id, round(completion, 6) AS completion, zone_order = now AS is_current, zone_order > now AS locked FROM n""")
def current_zone(spark: SparkSession, d: str) -> DataFrame:
    return mastery.current_zone(_zones(spark, d))


@job(f"""WITH {MASTERY}, h AS (SELECT user_id, count(*) AS known, count(*) FILTER (WHERE mastery < 90) AS low, count(*) FILTER (WHERE mastery >= 90 AND mastery < 100) AS review, count(*) FILTER (WHERE mastery >= 100) AS maintained FROM mastery GROUP BY user_id)
    SELECT u.user_id AS user_id, coalesce(low, 0) + (SELECT count(*) FROM subtopics) - coalesce(known, 0) AS weak, coalesce(review, 0) AS review, coalesce(maintained, 0) AS maintained FROM users u LEFT JOIN h ON h.user_id = u.user_id""")
def mastery_bands(spark: SparkSession, d: str) -> DataFrame:
    return bank.bands(_mastery(spark, d), domain(spark, d, "subtopics"), domain(spark, d, "users"))


@job()
def irt_recalibrate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(irt.recalibrate(analytics_log(spark, d)), "a", "b")


@job("""SELECT question_id, n, round(mean, 6) AS mean, CASE WHEN round(mean, 9) < 0.30 THEN 'master' WHEN round(mean, 9) < 0.60 THEN 'advanced'
    WHEN round(mean, 9) < 0.80 THEN 'intermediate' ELSE 'beginner' END AS level
    FROM (SELECT question_id, count(*) AS n, avg(correct) AS mean FROM responses GROUP BY question_id) x WHERE n >= 5""")
def score_recalibration(spark: SparkSession, d: str) -> DataFrame:
    return irt.score_recalibration(analytics_log(spark, d))


SPLIT = """SELECT student, skill, event_id, ts, correct, row_number() OVER (PARTITION BY student, skill ORDER BY ts, event_id) AS attempt,
    count(*) OVER (PARTITION BY student, skill) AS n FROM attempts"""


@job(f"SELECT student, skill, event_id, ts, correct, attempt, n, attempt = n AS is_test FROM ({SPLIT}) x WHERE n >= 4")
def leave_last_out(spark: SparkSession, d: str) -> DataFrame:
    return tracing.leave_last_out(domain(spark, d, "attempts")).withColumn("attempt", F.col("attempt").cast("bigint"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return tracing.leave_last_out(domain(spark, d, "attempts"))


KT = f"""split AS (SELECT *, attempt = n AS is_test FROM ({SPLIT}) x WHERE n >= 4 AND student IS NOT NULL AND skill IS NOT NULL),
    trained AS (SELECT student, skill, list(correct ORDER BY attempt) AS xs FROM split WHERE NOT is_test GROUP BY ALL),
    tested AS (SELECT student, skill, correct AS y FROM split WHERE is_test),
    folded AS (SELECT student, skill, list_reduce(xs, lambda k, c: (CASE WHEN c = 1 THEN k * 0.9 / (k * 0.9 + (1 - k) * 0.2 + 1e-12) ELSE k * 0.1 / (k * 0.1 + (1 - k) * 0.8 + 1e-12) END) * 0.85 + 0.15, CAST(0.2 AS DOUBLE)) AS k FROM trained),
    bkt AS (SELECT student, skill, y, k * 0.9 + (1 - k) * 0.2 AS p FROM folded JOIN tested USING (student, skill)),
    skills AS (SELECT student, skill, sum(pow(0.385, m - attempt) * correct) AS recent, max(m) AS m, avg(correct) AS accuracy
        FROM (SELECT *, max(attempt) OVER (PARTITION BY student, skill) AS m FROM split WHERE NOT is_test) x GROUP BY student, skill),
    befores AS (SELECT *, list(accuracy) OVER (PARTITION BY student ORDER BY skill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
        list(accuracy) OVER (PARTITION BY student ORDER BY skill ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM skills),
    able AS (SELECT *, coalesce(list_reduce(earlier, lambda a, x: least(greatest(a * 0.8 + x * 0.2, 0.05), 0.95), CAST(0.5 AS DOUBLE)), 0.5) AS before,
        list_reduce(every, lambda a, x: least(greatest(a * 0.8 + x * 0.2, 0.05), 0.95), CAST(0.5 AS DOUBLE)) AS final FROM befores),
    ibkt AS (SELECT student, skill, y, 0.7 * (0.165 * before * (1 - pow(0.385, m)) / 0.615 + 0.45 * recent) + 0.3 * final AS p FROM able JOIN tested USING (student, skill)),
    both_models AS (SELECT 'standard' AS model, * FROM bkt UNION ALL SELECT 'interactive' AS model, * FROM ibkt)"""
METRICS = f"""{KT}, clipped AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM both_models),
    plain AS (SELECT model, count(*) AS n, avg(abs(y - p)) AS mae, corr(y, p) AS r, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss FROM clipped GROUP BY model),
    level AS (SELECT model, round(p, 12) AS p, sum(y) AS pos, sum(1 - y) AS neg FROM both_models GROUP BY ALL),
    won AS (SELECT model, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS w FROM level),
    metrics AS (SELECT plain.model AS model, n, round(mae, 6) AS mae, round(r, 6) AS r, round(log_loss, 6) AS log_loss, round(auc, 6) AS auc
        FROM plain JOIN (SELECT model, sum(w) / nullif(sum(pos) * sum(neg), 0) AS auc FROM won GROUP BY model) a ON a.model = plain.model)"""


@job(f"WITH {KT} SELECT student, skill, y, round(p, 6) AS p FROM bkt")
def kt_bkt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracing.standard_bkt(_split(spark, d)), "p")


@job(f"WITH {KT} SELECT student, skill, y, round(p, 6) AS p FROM ibkt")
def kt_ibkt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracing.interactive_bkt(_split(spark, d)), "p")


@job(f"WITH {METRICS} SELECT * FROM metrics")
def kt_metrics(spark: SparkSession, d: str) -> DataFrame:
    one = lambda f, name: f(_split(spark, d)).select(F.lit(name).alias("model"), "y", "p")
    scored = one(tracing.standard_bkt, "standard").unionByName(one(tracing.interactive_bkt, "interactive"))
    return tracing.kt_metrics(stored(scored, "scored"), ("model",))  # folded once, read for each part of the metrics


@job(f"""WITH {KT}, b AS (SELECT CAST(floor(round(p * 10, 9)) AS INTEGER) AS bin, p, y FROM ibkt)
    SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return tracing.calibration_bins(tracing.interactive_bkt(_split(spark, d)))


@job("""WITH sc AS (SELECT session_id, sum(correct) AS score FROM responses GROUP BY session_id),
    r AS (SELECT game_type, user_id, session_id, CAST(coalesce(score, 0) AS BIGINT) AS score, CAST(elapsed AS BIGINT) AS elapsed,
        row_number() OVER (PARTITION BY game_type, user_id ORDER BY coalesce(score, 0) DESC, elapsed, session_id) AS k
        FROM sessions LEFT JOIN sc USING (session_id) WHERE status = 'completed' AND game_type IS NOT NULL)
    SELECT game_type, user_id, session_id, score, elapsed, rank() OVER (PARTITION BY game_type ORDER BY score DESC, elapsed) AS place FROM r WHERE k = 1""")
def game_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return games.game_leaderboard(domain(spark, d, "sessions"), domain(spark, d, "responses"))


@job("""WITH w AS (SELECT *, sum(1 - correct) OVER (PARTITION BY session_id, question_id, user_id ORDER BY created_at, line, subtopic_id
        ROWS UNBOUNDED PRECEDING) AS wrong FROM responses)
    SELECT session_id, question_id, line, subtopic_id, created_at, CAST(wrong - (1 - correct) + 1 AS BIGINT) AS attempt,
        CAST(greatest(3 - wrong, 0) AS BIGINT) AS lives, wrong >= 3 AS game_over FROM w""")
def attempt_lives(spark: SparkSession, d: str) -> DataFrame:
    return games.attempt_lives(domain(spark, d, "responses"))


ALL_RIGHT = "SELECT session_id, min(correct) AS all_right FROM responses GROUP BY session_id"


@job(f"""WITH p AS ({ALL_RIGHT}), c AS (SELECT user_id, count(*) AS n, sum(CASE WHEN all_right = 1 THEN 1 ELSE 0 END) AS p,
        sum(CASE WHEN all_right = 1 AND elapsed <= 60 AND (game_type IS NULL OR game_type <> 'debugging') THEN 1 ELSE 0 END) AS f
        FROM sessions LEFT JOIN p USING (session_id) WHERE status = 'completed' GROUP BY user_id)
    SELECT user_id, CAST(least(n, 20) AS BIGINT) AS enthusiast, CAST(least(p, 5) AS BIGINT) AS perfection, CAST(least(f, 1) AS BIGINT) AS speed,
        n >= 20 AS has_enthusiast, p >= 5 AS has_perfection, f >= 1 AS has_speed FROM c""")
def achievement_progress(spark: SparkSession, d: str) -> DataFrame:
    return games.achievement_progress(domain(spark, d, "sessions"), domain(spark, d, "responses"))


@job(f"""WITH {ZONES}, p AS ({ALL_RIGHT}), c AS (SELECT user_id, count(*) AS n, sum(CASE WHEN all_right = 1 THEN 1 ELSE 0 END) AS p, count(*) FILTER (WHERE game_type IN ('crossword', 'wordsearch')) AS c,
        sum(CASE WHEN all_right = 1 AND elapsed <= 60 AND game_type IN ('crossword', 'wordsearch') THEN 1 ELSE 0 END) AS f
        FROM sessions LEFT JOIN p USING (session_id) WHERE status = 'completed' GROUP BY user_id)
    SELECT user_id, 'first_steps' AS code FROM c WHERE c >= 1 UNION ALL SELECT user_id, 'game_enthusiast' AS code FROM c WHERE n >= 20 UNION ALL SELECT user_id, 'perfection_seeker' AS code FROM c WHERE p >= 5
    UNION ALL SELECT user_id, 'speed_solver' AS code FROM c WHERE f >= 1 UNION ALL SELECT user_id, 'zone_' || zone_order FROM zone_rows WHERE round(completion, 9) >= 100""")
def achievement_awards(spark: SparkSession, d: str) -> DataFrame:
    return games.achievement_awards(domain(spark, d, "sessions"), domain(spark, d, "responses"), _zones(spark, d))


@job("""SELECT user_id, round(avg(time_taken), 6) AS avg_time, round(avg(correct), 6) AS accuracy, count(*) AS answers
    FROM responses GROUP BY user_id HAVING count(*) >= 3""")
def learner_features(spark: SparkSession, d: str) -> DataFrame:
    return games.learner_features(domain(spark, d, "responses"))


@job("""SELECT user_id, question_id, session_id, line, created_at, correct FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id
    ORDER BY created_at DESC, session_id DESC, line DESC, subtopic_id DESC, correct DESC) AS k FROM responses) x WHERE k = 1""")
def latest_responses(spark: SparkSession, d: str) -> DataFrame:
    return games.latest_responses(domain(spark, d, "responses"))


@job("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, skill, count(*) AS n, round(avg(correct), 6) AS accuracy FROM attempts GROUP BY ALL")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    return games.stream_activity_batch(domain(spark, d, "attempts"))


ENRICHED = """SELECT question_id, substr(question_text, 1, 100) AS preview, difficulty, game_type, s.name AS subtopic, t.name AS topic, z.name AS zone
    FROM questions JOIN subtopics s USING (subtopic_id) JOIN topics t ON s.topic_id = t.topic_id JOIN zones z ON t.zone_id = z.zone_id"""


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return bank.enrich(*(domain(spark, d, v) for v in ("questions", "subtopics", "topics", "zones")))


@job(ENRICHED)
def enrich_questions(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d)


@job(f"SELECT * FROM ({ENRICHED}) e WHERE (contains(lower(preview), 're') OR contains(lower(subtopic), 're') OR contains(lower(topic), 're')) AND difficulty = 'advanced'")
def question_search(spark: SparkSession, d: str) -> DataFrame:
    """The SQL looks into the preview alone, which holds the whole of these tables' short texts."""
    return bank.search(bank.named(*(domain(spark, d, v) for v in ("questions", "subtopics", "topics", "zones"))), "re", "advanced")


@job("SELECT status, difficulty, game_type, count(*) AS n FROM questions GROUP BY GROUPING SETS ((status), (difficulty), (game_type), ())")
def question_statistics(spark: SparkSession, d: str) -> DataFrame:
    return bank.statistics(domain(spark, d, "questions"))


@job("""WITH n AS (SELECT subtopic_id, count(*) AS n FROM questions WHERE NOT flagged GROUP BY subtopic_id)
    SELECT topic_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS questions, count(n) AS with_questions, count(*) AS subtopics,
        round(count(n) * 100.0 / count(*), 6) AS coverage FROM subtopics LEFT JOIN n USING (subtopic_id) GROUP BY topic_id""")
def topic_question_summary(spark: SparkSession, d: str) -> DataFrame:
    return bank.topic_summary(domain(spark, d, "questions"), domain(spark, d, "subtopics"))


@job("""SELECT a.*, b.*, c.* FROM (SELECT count(DISTINCT topic_id) AS topics_with_subtopics, count(*) AS subtopics FROM subtopics) a,
    (SELECT count(DISTINCT subtopic_id) AS subtopics_with_questions, count(*) FILTER (WHERE status = 'pending') AS pending,
        count(*) FILTER (WHERE status = 'processed') AS processed FROM questions) b, (SELECT count(*) AS topics FROM topics) c""")
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    return bank.dashboard(domain(spark, d, "questions"), domain(spark, d, "subtopics"), domain(spark, d, "topics"))


HASHED = r"""words AS (SELECT *, list_filter(regexp_split_to_array(lower(question_text), '\s+'), lambda w: length(w) > 2) AS ws FROM questions),
    bare AS (SELECT *, list_filter(list_transform(ws, lambda w: regexp_replace(w, '^[.,!?()\[\]{}";:]+|[.,!?()\[\]{}";:]+$', '', 'g')),
        lambda w: NOT list_contains(['a','an','the','and','or','but','in','on','at','to','for','of','with','by','is','are','was','were','be','been','being','have','has','had','do','does','did','will','would','could','should'], w)) AS bs FROM words),
    hashed AS (SELECT question_id, left(md5(array_to_string(list_sort(bs[1:5]), ' ') || '|(' || subtopic_id || ',)|' || game_type || '|' || difficulty), 12) AS hash FROM bare)"""


@job(f"WITH {HASHED} SELECT question_id, hash, min(question_id) OVER (PARTITION BY hash) AS first_id, min(question_id) OVER (PARTITION BY hash) <> question_id AS duplicate FROM hashed")
def question_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return bank.hash_dedup(domain(spark, d, "questions"))


@job("""WITH q AS (SELECT question_id, subtopic_id, difficulty, game_type, lower(trim(question_text)) AS t,
        list_distinct(string_split(lower(trim(question_text)), ' ')) AS w FROM questions)
    SELECT a.question_id AS question_id, min(b.question_id) AS existing_id FROM q a JOIN q b ON a.subtopic_id = b.subtopic_id AND a.difficulty = b.difficulty AND a.game_type = b.game_type
    WHERE b.question_id < a.question_id AND (a.t = b.t OR (least(length(a.t), length(b.t)) * 1.0 / greatest(length(a.t), length(b.t)) >= 0.7
        AND len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) >= 0.8)) GROUP BY a.question_id""")
def similar_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each question is new to those with smaller ids."""
    return bank.repeats(domain(spark, d, "questions"))


@job("""WITH r AS (SELECT topic_id, subtopic_id, order_in_topic AS i, count(*) OVER (PARTITION BY topic_id) AS n FROM subtopics),
    p AS (SELECT a.topic_id, a.subtopic_id AS first_id, b.subtopic_id AS second_id, a.n, row_number() OVER (PARTITION BY a.topic_id ORDER BY a.i, b.i) AS k
        FROM r a JOIN r b ON a.topic_id = b.topic_id AND a.i < b.i)
    SELECT topic_id, first_id, second_id FROM p WHERE k <= greatest(1, n // 2)""")
def subtopic_combinations(spark: SparkSession, d: str) -> DataFrame:
    return bank.subtopic_pairs(domain(spark, d, "subtopics"))


@job("""WITH a AS (SELECT 'newest' AS list, question_id AS id, question_id AS value FROM questions), b AS (SELECT 'most questions' AS list, subtopic_id AS id, count(*) AS value FROM questions WHERE subtopic_id IN (SELECT subtopic_id FROM subtopics) GROUP BY subtopic_id),
    c AS (SELECT 'rankings' AS list, vec_id AS id, vec_id * 7919 % 100003 AS value FROM embeddings), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, id) AS place FROM u) SELECT list, place, CAST(id AS BIGINT) AS id, CAST(value AS BIGINT) AS value FROM k WHERE place <= 10""")
def recent_and_top(spark: SparkSession, d: str) -> DataFrame:
    rankings = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("ranking_id"), (F.col("vec_id") * 7919 % 100003).alias("updated_at"))
    return bank.recent_and_top(domain(spark, d, "questions"), domain(spark, d, "subtopics"), rankings)


@job("""WITH t AS (SELECT document, length(text) // 4 AS t FROM chunks) SELECT document, count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, round(avg(t), 2) AS mean,
    min(t) AS least, max(t) AS most, count(*) FILTER (WHERE t > 1000) AS over_1k, count(*) FILTER (WHERE t > 2000) AS over_2k FROM t GROUP BY document""")
def chunk_token_stats(spark: SparkSession, d: str) -> DataFrame:
    return content.token_stats(domain(spark, d, "chunks"))


@job("SELECT document, (order_in_doc - 1) // 4 AS page, count(*) AS chunks, min(chunk_id) AS first_id FROM chunks GROUP BY ALL")
def chunks_by_page(spark: SparkSession, d: str) -> DataFrame:
    return content.pages_of(domain(spark, d, "chunks"))


@job("""WITH v AS (SELECT vec_id AS id, label % 2 AS model, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
    c AS (SELECT a.id AS owner_id, b.id AS chunk_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (a.n * b.n) AS cosine
        FROM v a JOIN v b ON a.model = b.model WHERE a.id % 100 = 0 AND b.id <> a.id AND a.n > 0 AND b.n > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY round(cosine, 9) DESC, chunk_id) AS rank FROM c WHERE cosine >= 0.1)
    SELECT v.id AS owner_id, rank, chunk_id, round(cosine, 5) AS cosine FROM v LEFT JOIN r ON r.owner_id = v.id AND rank <= 10 WHERE v.id % 100 = 0""")
def semantic_rank(spark: SparkSession, d: str) -> DataFrame:
    """A search: the queries are the vectors whose id is divisible by 100, against all others; the label's parity is the model."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("model"), F.col("embedding").alias("vector"))
    return content.semantic_rank(e.where("id % 100 = 0"), e)


EIG = f"""{MASTERY}, {ABILITY},
    prior AS (SELECT m.user_id, m.subtopic_id, d.difficulty, 0.7 * mastery / 100 + 0.3 * ability AS k, 0.15 * (1 + 0.5 * d.v) AS slip, 0.25 * (1 - 0.3 * d.v) AS guess
        FROM mastery m JOIN ability a ON a.user_id = m.user_id, (VALUES ('beginner', 0.0::DOUBLE), ('intermediate', 0.33), ('advanced', 0.67), ('master', 1.0)) d(difficulty, v)),
    answered AS (SELECT *, k * (1 - slip) + (1 - k) * guess AS good FROM prior),
    after AS (SELECT *, least(greatest(k, 0.001), 0.999) AS p0, least(greatest(k * (1 - slip) / good, 0.001), 0.999) AS p1, least(greatest(k * slip / (1 - good), 0.001), 0.999) AS p2 FROM answered),
    gains AS (SELECT user_id, subtopic_id, difficulty, round(greatest(-(p0 * log2(p0) + (1 - p0) * log2(1 - p0)) + good * (p1 * log2(p1) + (1 - p1) * log2(1 - p1))
        + (1 - good) * (p2 * log2(p2) + (1 - p2) * log2(1 - p2)), 0.0), 6) AS eig FROM after)"""


@job(f"WITH {EIG} SELECT user_id, subtopic_id, difficulty, eig FROM gains")
def eig_scores(spark: SparkSession, d: str) -> DataFrame:
    """Gain of asking about each subtopic a user has practised, for each difficulty."""
    known = _mastery(spark, d).select("user_id", "subtopic_id", (F.col("mastery") / 100).alias("known"))
    ability = mastery.ability_update(mastery.session_accuracy(domain(spark, d, "responses")))
    levels = F.explode(F.array(*[F.lit(x) for x in scalar.DIFFICULTY]))
    rows = known.join(ability, "user_id").withColumn("difficulty", levels)
    gain = scalar.information_gain(F.col("known"), F.col("ability"), scalar.normalize_difficulty(F.col("difficulty")))
    return rows.select("user_id", "subtopic_id", "difficulty", F.round(gain, 6).alias("eig"))


@job(f"""WITH {ZONES} SELECT u.user_id AS user_id, t.topic_id AS topic_id, t.zone_id AS zone_id, round(coalesce(r.percent, 0.0), 6) AS proficiency FROM topics t JOIN (SELECT DISTINCT topic_id FROM subtopics) s ON t.topic_id = s.topic_id
    CROSS JOIN users u LEFT JOIN topic_rows r ON r.user_id = u.user_id AND r.topic_id = t.topic_id""")
def topic_progress(spark: SparkSession, d: str) -> DataFrame:
    """Every user's proficiency in every topic that has subtopics, 0 where there is none. Topics are a small fixed dimension."""
    topics = domain(spark, d, "topics").join(domain(spark, d, "subtopics").select("topic_id"), "topic_id", "left_semi").select("topic_id", "zone_id")
    have = mastery.proficiency(_mastery(spark, d), domain(spark, d, "subtopics"))
    every = domain(spark, d, "users").select("user_id").crossJoin(topics)
    return every.join(have, ["user_id", "topic_id"], "left").select("user_id", "topic_id", "zone_id", F.round(F.coalesce("percent", F.lit(0.0)), 6).alias("proficiency"))


@job("""SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.skill, o.skill) AS skill, CASE WHEN n.user_id IS NOT NULL THEN n.n ELSE o.n END AS n
    FROM (SELECT student AS user_id, skill, count(*) AS n FROM attempts WHERE event_id % 2 = 0 GROUP BY ALL) o
    FULL JOIN (SELECT student AS user_id, skill, count(*) AS n FROM attempts WHERE event_id % 2 = 1 GROUP BY ALL) n ON o.user_id = n.user_id AND o.skill = n.skill""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Counts over events with even ids are the stored table, those over odd ids the update."""
    a = domain(spark, d, "attempts").withColumnRenamed("student", "user_id")
    counted = lambda k: a.where(F.col("event_id") % 2 == k).groupBy("user_id", "skill").agg(F.count("*").alias("n"))
    return changes.upsert(counted(0), counted(1), ["user_id", "skill"])


@job("""WITH o AS (SELECT student, skill, min(event_id) AS first_id FROM attempts WHERE correct = 1 GROUP BY ALL), n AS (SELECT student, skill, min(event_id) AS first_id FROM attempts GROUP BY ALL)
    SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.student = n.student AND o.skill = n.skill)""")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    a = domain(spark, d, "attempts")
    first = lambda df: df.groupBy("student", "skill").agg(F.min("event_id").alias("first_id"))
    return changes.insert_missing(first(a.where("correct = 1")), first(a), ["student", "skill"])


@job("""WITH m AS (SELECT question_id, (0.5 - avg(correct)) * 6 AS b FROM responses GROUP BY question_id), i AS (SELECT m.question_id, game_type, b FROM m JOIN questions q ON q.question_id = m.question_id),
    u AS (SELECT u.user_id, coalesce(t, 0.0) AS theta FROM users u LEFT JOIN (SELECT user_id, (avg(correct) - 0.5) * 6 AS t FROM responses GROUP BY user_id) r ON r.user_id = u.user_id),
    g AS (SELECT DISTINCT theta FROM u), c AS (SELECT theta, game_type, question_id, row_number() OVER (PARTITION BY theta, game_type ORDER BY abs(b - theta), question_id) AS k FROM g, i)
    SELECT user_id, game_type, question_id FROM u JOIN c ON u.theta = c.theta WHERE k = 1""")
def nearest_theta_item(spark: SparkSession, d: str) -> DataFrame:
    """Accuracies stand for ability and difficulty."""
    r = domain(spark, d, "responses")
    items = r.groupBy("question_id").agg(((0.5 - F.avg("correct")) * 6).alias("b")).join(domain(spark, d, "questions").select("question_id", "game_type"), "question_id")
    users = domain(spark, d, "users").select("user_id").join(r.groupBy("user_id").agg(((F.avg("correct") - 0.5) * 6).alias("theta")), "user_id", "left")
    return selection.nearest_item(users, items)


@job(f"""WITH {EIG}, c AS (SELECT g.user_id, q.question_id, g.subtopic_id, eig / 0.6 - ln(-ln((CAST('0x' || left(md5('7|' || g.user_id || '|' || q.question_id), 12) AS BIGINT) + 0.5) / 281474976710656.0)) AS pull
        FROM gains g JOIN questions q ON q.subtopic_id = g.subtopic_id AND q.difficulty = g.difficulty WHERE NOT flagged),
    t AS (SELECT *, row_number() OVER (PARTITION BY user_id, subtopic_id ORDER BY pull DESC, question_id) AS turn FROM c),
    p AS (SELECT user_id, question_id, row_number() OVER (PARTITION BY user_id ORDER BY turn, pull DESC, question_id) AS place FROM t WHERE turn <= 5)
    SELECT user_id, question_id, place FROM p WHERE place <= 5""")
def select_questions(spark: SparkSession, d: str) -> DataFrame:
    """Five questions for each user among those of the subtopics practised, by gain."""
    gains = eig_scores(spark, d).withColumnRenamed("eig", "gain")
    pool = domain(spark, d, "questions").where("not flagged").select("question_id", "subtopic_id", "difficulty")
    return selection.sample_by_gain(gains.join(pool, ["subtopic_id", "difficulty"]), 5, 7)


@job()
def learner_clusters(spark: SparkSession, d: str) -> DataFrame:
    features = games.learner_features(domain(spark, d, "responses"))
    return selection.every_cluster(selection.assign_cluster(features, *selection.train_clusters(features)), domain(spark, d, "users"))


@job("""WITH g AS (SELECT student, ts, correct, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY student ORDER BY ts), ts) < 300 THEN 0 ELSE 1 END AS new FROM attempts),
    n AS (SELECT *, sum(new) OVER (PARTITION BY student ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT student, count(*) AS attempts, CAST(sum(correct) AS BIGINT) AS "right" FROM n GROUP BY student, s""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the stream of sessions. An answer without a time, which no window takes, is a session of its own."""
    events = domain(spark, d, "attempts").withColumn("ts", F.col("ts").cast("timestamp"))
    timeless = events.where("ts is null").select("student", F.lit(1).cast("bigint").alias("attempts"), F.col("correct").cast("bigint").alias("right"))
    return answers.session_summary(events).select("student", "attempts", "right").unionByName(timeless)


@job("""SELECT z.zone_id AS zone_id, z.name AS zone, count(DISTINCT t.topic_id) AS topics, count(DISTINCT s.subtopic_id) AS subtopics
    FROM zones z LEFT JOIN topics t ON t.zone_id = z.zone_id LEFT JOIN subtopics s ON s.topic_id = t.topic_id GROUP BY z.zone_id, z.name""")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    zones, topics, subtopics = (domain(spark, d, v) for v in ("zones", "topics", "subtopics"))
    n = subtopics.groupBy("topic_id").agg(F.count("*").alias("n"))
    inside = topics.join(n, "topic_id", "left").groupBy("zone_id").agg(F.count("*").alias("topics"), F.sum("n").alias("subtopics"))
    rows = zones.join(inside, "zone_id", "left")
    return rows.select("zone_id", F.col("name").alias("zone"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("topics", "subtopics")])


@job("""WITH s AS (SELECT user_id, session_id, avg(correct) AS accuracy, max(created_at) AS ended_at FROM responses GROUP BY ALL),
    o AS (SELECT user_id, list(accuracy ORDER BY ended_at, session_id) AS xs FROM s GROUP BY user_id),
    a AS (SELECT list_reduce(xs, lambda acc, x: least(greatest(acc * 0.8 + x * 0.2, 0.01), 0.99), CAST(0.5 AS DOUBLE)) AS v FROM o)
    SELECT count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS spread FROM a""")
def ability_distribution(spark: SparkSession, d: str) -> DataFrame:
    v = mastery.ability_update(mastery.session_accuracy(domain(spark, d, "responses")))
    x = F.col("ability")
    parts = {"least": F.min(x), "most": F.max(x), "mean": F.avg(x), "median": F.percentile(x, 0.5), "spread": F.stddev_pop(x)}
    return v.agg(F.count("*").alias("n"), *[F.round(c, 6).alias(k) for k, c in parts.items()])


@job(f"WITH {KT} SELECT model, round(regr_slope(y, p), 6) AS slope, round(regr_intercept(y, p), 6) AS intercept FROM both_models GROUP BY model")
def prediction_trend(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares line of outcomes on predictions, of either model."""
    one = lambda f, name: f(_split(spark, d)).agg(F.lit(name).alias("model"), F.round(F.regr_slope("y", "p"), 6).alias("slope"), F.round(F.regr_intercept("y", "p"), 6).alias("intercept"))
    return one(tracing.standard_bkt, "standard").unionByName(one(tracing.interactive_bkt, "interactive"))


@job(f"""WITH {METRICS}, m AS (SELECT a.metric, a.value AS standard, b.value AS interactive FROM
        (UNPIVOT (SELECT mae, r, log_loss, auc FROM metrics WHERE model = 'standard') ON mae, r, log_loss, auc INTO NAME metric VALUE value) a JOIN
        (UNPIVOT (SELECT mae, r, log_loss, auc FROM metrics WHERE model = 'interactive') ON mae, r, log_loss, auc INTO NAME metric VALUE value) b ON a.metric = b.metric),
    w AS (SELECT CASE WHEN i.mae < s.mae THEN 'interactive' ELSE 'standard' END AS winner, round((s.mae - i.mae) / s.mae * 100, 4) AS improvement
        FROM (SELECT mae FROM metrics WHERE model = 'interactive') i, (SELECT mae FROM metrics WHERE model = 'standard') s)
    SELECT metric, standard, interactive, round(interactive - standard, 6) AS difference,
        CASE WHEN (interactive < standard) = (metric IN ('mae', 'log_loss')) THEN 'interactive' ELSE 'standard' END AS better, winner, improvement FROM m, w""")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Each metric of both models, their difference, the better model of each, and by mean absolute error the winner and its gain in percent."""
    rows = kt_metrics(spark, d)
    long = rows.select("model", F.expr("stack(4, 'mae', mae, 'r', r, 'log_loss', log_loss, 'auc', auc) AS (metric, value)"))
    wide = long.groupBy("metric").pivot("model", ["standard", "interactive"]).agg(F.first("value"))
    lower = F.col("metric").isin("mae", "log_loss")
    better = F.when((F.col("interactive") < F.col("standard")) == lower, "interactive").otherwise("standard")
    mae = lambda name: F.max(F.when(F.col("model") == name, F.col("mae")))
    winner = rows.agg(F.when(mae("interactive") < mae("standard"), "interactive").otherwise("standard").alias("winner"), F.round((mae("standard") - mae("interactive")) / mae("standard") * 100, 4).alias("improvement"))
    wide = wide.select("metric", "standard", "interactive", F.round(F.col("interactive") - F.col("standard"), 6).alias("difference"), better.alias("better"))
    return wide.crossJoin(F.broadcast(winner))  # one row


@job("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@job("SELECT role, count(*) AS n, min(username) AS first_name FROM users GROUP BY role")
def users_by_role(spark: SparkSession, d: str) -> DataFrame:
    return domain(spark, d, "users").groupBy("role").agg(F.count("*").alias("n"), F.min("username").alias("first_name"))


@job(r"""SELECT question_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(question_text)), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug,
    upper(regexp_replace(correct_answer, '[^A-Za-z]', '', 'g')) AS word FROM questions""")
def slugs_and_words(spark: SparkSession, d: str) -> DataFrame:
    q = domain(spark, d, "questions")
    return q.select("question_id", scalar.slugify(F.col("question_text")).alias("slug"), scalar.sanitize_word(F.col("correct_answer")).alias("word"))


@job("""WITH t AS (SELECT topic_id, count(*) AS n FROM subtopics GROUP BY topic_id)
    SELECT topic_id, n AS singles, CASE WHEN n > 1 THEN least(n * (n - 1) // 2, greatest(1, n // 2)) ELSE 0 END AS pairs FROM t""")
def combination_counts(spark: SparkSession, d: str) -> DataFrame:
    n = domain(spark, d, "subtopics").groupBy("topic_id").agg(F.count("*").alias("singles"))
    s = F.col("singles")
    return n.withColumn("pairs", F.when(s > 1, F.least(F.floor(s * (s - 1) / 2), F.greatest(F.lit(1), F.floor(s / 2)))).otherwise(F.lit(0)).cast("bigint"))
