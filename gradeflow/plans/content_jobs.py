"""Registered jobs of chunks, tables of contents, reading pages and retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import text as rules
from gradeflow.operators import catalogue, changes, merging
from gradeflow.plans.adapters import domain
from gradeflow.plans.jobs import job


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def count(column: str, part: str) -> str:
    return f"((length({column}) - length(replace({column}, {quoted(part)}, ''))) // {len(part)})"


def typed_sql() -> str:
    """The kind of each piece, by the same signs in the other dialect."""
    t, low = "text", "lower(text)"
    strong = f"""({has(t, '>>>')} OR regexp_matches(trim(text), '^(import |from |def |class |if __name__|\\$ python|\\$ pip)') OR regexp_matches(text, '(?m)^\\s*(def|class|import|from)\\s+\\w+')
        OR regexp_matches(text, 'print\\s*\\(.*\\)') OR regexp_matches(text, 'return\\s+\\w+') OR ({has(t, '...')} AND {has(t, 'def ')}))"""
    weak = f"""(CAST(regexp_matches(text, '[a-zA-Z_]\\w*\\s*=\\s*[^=\\s]') AS INT) + CAST({count(t, '{')} > 1 AND {count(t, '}')} > 1 AS INT) + CAST({count(t, '[')} > 2 AND {count(t, ']')} > 2 AS INT)
        + CAST(regexp_matches(text, '\\b\\w+\\(\\w+.*\\)') AS INT) + CAST({count(t, '    ')} > 1 AS INT)) >= 2"""
    tries = f"{has(low, 'try it', 'try this', 'give it a try', 'now try', 'hands-on')} OR ({has(low, 'your turn')} AND {has(low, 'code', 'write')}) OR ({has(low, 'interactive')} AND {has(low, 'session', 'example')})"
    exercise = f"""({has(low, 'exercise')} AND {has(low, 'write', 'code', 'implement')}) OR ({has(low, 'practice')} AND {has(low, 'coding', 'programming')}) OR ({has(low, 'challenge')} AND {has(low, 'code', 'implement')})
        OR ({has(low, 'assignment')} AND {has(low, 'write', 'create')}) OR {has(low, 'task:', 'problem:')} OR ({has(low, 'implement')} AND {has(low, 'function', 'class', 'method')})"""
    elements = f"({has(t, 'def ', 'class ', 'import ', '>>>')} OR ({count(t, '(')} > 2 AND {count(t, ')')} > 2))"
    example = f"""({has(low, 'example', 'demonstration')} AND {elements}) OR ({has(low, "here's how")} AND {has(low, 'code', 'write', 'implement')})
        OR {has(low, 'sample code', 'code snippet', 'following code', 'code below', 'code above')} OR ({has(low, 'usage example')} AND {has(low, 'function', 'method', 'class')})"""
    return f"typed AS (SELECT *, CASE WHEN {strong} OR {weak} THEN 'Code' WHEN {tries} THEN 'Try_It' WHEN {exercise} THEN 'Exercise' WHEN {example} THEN 'Example' ELSE 'Concept' END AS chunk_type FROM pieces)"


TYPED = typed_sql()


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.typed(domain(spark, d, "pieces"))


@job(f"WITH {TYPED} SELECT chunk_id, chunk_type FROM typed")
def classify_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("chunk_id", "chunk_type")


def cleaned_sql() -> str:
    out = "text"
    for pattern, new in rules.RAW:
        if "​" not in pattern:  # no text of the tables holds it
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new.replace('$1', chr(92) + '1'))}, 'g')"
    return f"trim({out})"


@job(f"SELECT chunk_id, {cleaned_sql()} AS text FROM pieces")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return domain(spark, d, "pieces").select("chunk_id", rules.clean_raw(F.col("text")).alias("text"))


@job()
def chunk_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Pieces cleaned, classified, put together across pages and counted; those under ten characters, of back matter or after an index leave."""
    rows = domain(spark, d, "pieces").withColumn("chunk_type", rules.classify_chunk(F.col("text"))).withColumn("text", rules.clean_chunk(F.col("text")))
    rows = merging.merge_split_chunks(rows, 10).where(~rules.back_matter(F.col("text"))).withColumn("tokens", F.floor(F.length("text") / 4))
    rows = rows.withColumn("order_in_doc", F.col("chunk_id"))  # a document's pieces are numbered in order
    return catalogue.until_index(rows, F.col("document")).select("chunk_id", "document", "chunk_type", "page", "tokens")


@job(f"WITH {TYPED} SELECT chunk_id, page, order_in_doc, substr(text, 1, 200) AS preview FROM typed WHERE chunk_type = 'Code'")
def chunks_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("chunk_type = 'Code'").orderBy("document", "page", "order_in_doc").select("chunk_id", "page", "order_in_doc", F.substring("text", 1, 200).alias("preview"))


POINTS = "least((length(text) - length(replace(text, chr(10), '')) + 1) // 5, 3) + CASE WHEN contains(text, 'def ') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'class ') THEN 3 ELSE 0 END + CASE WHEN contains(text, 'import ') OR contains(text, 'from ') THEN 1 ELSE 0 END"


@job(f"WITH {TYPED}, p AS (SELECT document, {POINTS} AS points FROM typed WHERE chunk_type IN ('Code', 'Try_It')) SELECT document, count(*) AS chunks, count(*) FILTER (WHERE points <= 2) AS easy, count(*) FILTER (WHERE points > 2 AND points <= 5) AS medium, count(*) FILTER (WHERE points > 5) AS hard, CAST(sum(points) AS BIGINT) AS points FROM p GROUP BY document")
def coding_chunk_complexity(spark: SparkSession, d: str) -> DataFrame:
    n = lambda level: F.count_if(F.col("level") == level).alias(level)
    return catalogue.complexity(_typed(spark, d)).groupBy("document").agg(F.count("*").alias("chunks"), n("easy"), n("medium"), n("hard"), F.sum("points").cast("bigint").alias("points"))


VECTORS = "vectors AS (SELECT vec_id AS chunk_id, CASE WHEN label % 2 = 0 THEN 'sentence' ELSE 'code_bert' END AS model FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, "sentence").otherwise("code_bert").alias("model"))


@job(f"""WITH {TYPED}, {VECTORS} SELECT document, count(*) AS chunks, count(v.chunk_id) AS embedded, round(count(v.chunk_id) * 100.0 / count(*), 6) AS coverage FROM typed t
    LEFT JOIN (SELECT DISTINCT * FROM vectors) v ON v.chunk_id = t.chunk_id AND v.model = CASE WHEN chunk_type = 'Concept' THEN 'sentence' ELSE 'code_bert' END GROUP BY document""")
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.embedding_coverage(_typed(spark, d), _vectors(spark, d))


@job(f"WITH {VECTORS} SELECT chunk_id FROM pieces WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.missing_vectors(domain(spark, d, "pieces"), _vectors(spark, d)).select("chunk_id")


MARKERS = "[" + ", ".join(quoted(m) for m in rules.JUNK_MARKERS) + "]"


@job(f"""WITH l AS (SELECT chunk_id, text, lower(trim(text)) AS low, lower(document) AS title FROM pieces),
    m AS (SELECT *, list_filter({MARKERS}, lambda m: contains(low, m))[1] AS marker, (length(low) - length(replace(low, title, ''))) // greatest(length(title), 1) AS hits FROM l),
    r AS (SELECT chunk_id, CASE WHEN text = '' THEN 'empty' WHEN length(low) < 200 THEN 'short' WHEN marker IS NOT NULL THEN 'marker: ' || marker
        WHEN length(title) >= 8 AND hits >= 3 AND hits * length(title) * 1.0 / length(low) > 0.05 THEN 'title' END AS reason FROM m)
    SELECT chunk_id, reason FROM r WHERE reason IS NOT NULL""")
def junk_chunks(spark: SparkSession, d: str) -> DataFrame:
    return domain(spark, d, "pieces").select("chunk_id", rules.junk_reason(F.col("text"), F.col("document")).alias("reason")).where("reason is not null")


@job("""SELECT chunk_id, regexp_matches(text, '(?im)Other Books You May Enjoy|Leave a review|ISBN:\\s*\\d|Para \\w+, com todo|Table of Contents|Chapter Summary \\d+|Further Reading \\d+|^\\s*[A-Z]\\s*$') AS back_matter,
    contains(lower(text), 'fluent python') OR contains(lower(text), 'python basics') OR contains(lower(text), 'expert python programming') OR contains(lower(text), 'intermediate python') AS other_book FROM pieces""")
def back_matter_filter(spark: SparkSession, d: str) -> DataFrame:
    return domain(spark, d, "pieces").select("chunk_id", rules.back_matter(F.col("text")).alias("back_matter"), rules.other_book(F.col("text"), F.col("document")).alias("other_book"))


@job("""WITH n AS (SELECT document, max(page) + 2 AS total FROM pieces GROUP BY document), w AS (SELECT *, lead(start_page) OVER (PARTITION BY document ORDER BY start_page, entry_id) AS nxt FROM toc)
    SELECT w.document AS document, entry_id, start_page, coalesce(nxt, total) - 1 AS end_page FROM w JOIN n ON n.document = w.document""")
def toc_end_pages(spark: SparkSession, d: str) -> DataFrame:
    total = domain(spark, d, "pieces").groupBy("document").agg((F.max("page") + 2).alias("total_pages"))
    return catalogue.toc_end_pages(domain(spark, d, "toc"), total)


@job("""SELECT document, entry_id, title FROM (SELECT *, row_number() OVER (PARTITION BY document, lower(trim(title)) ORDER BY start_page, entry_id) AS k FROM toc WHERE length(trim(title)) > 3 AND NOT regexp_matches(trim(title), '^[0-9.]+$')) x WHERE k = 1""")
def toc_dedup(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.toc_dedup(domain(spark, d, "toc")).select("document", "entry_id", "title")


@job("""WITH l AS (SELECT document, list({'e': entry_id, 'v': CAST(level AS BIGINT)} ORDER BY start_page, entry_id) AS xs FROM toc GROUP BY document),
    f AS (SELECT document, list_reduce(xs, lambda a, x: {'v': least(x.v, a.v + 1, 3), 'out': list_append(a.out, {'e': x.e, 'v': least(x.v, a.v + 1, 3)})}, {'v': 0::BIGINT, 'out': []::STRUCT(e BIGINT, v BIGINT)[]}).out AS o FROM l)
    SELECT document, CAST(i - 1 AS BIGINT) AS place, o[i].e AS entry_id, o[i].v AS level FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM f) x""")
def toc_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.toc_levels(domain(spark, d, "toc").withColumn("level", F.col("level").cast("bigint")))


@job(f"""WITH c AS (SELECT *, lower(trim(regexp_replace(title, '^[0-9]+(\\.[0-9]+)*\\.?\\s*', ''))) AS n FROM toc)
    SELECT document, coalesce(min(CASE WHEN n <> '' AND n NOT IN ({", ".join(quoted(x) for x in rules.FRONT_MATTER)}) THEN start_page END), min(start_page)) AS first_page, max(start_page) AS last_page FROM c GROUP BY document""")
def content_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.content_boundaries(domain(spark, d, "toc").withColumn("end_page", F.lit(None).cast("bigint")))


@job("""WITH s AS (SELECT *, contains(text, 'Fluent Python') AS stop FROM pieces), g AS (SELECT *, max(CAST(stop AS INT)) OVER (PARTITION BY document ORDER BY order_in_doc ROWS UNBOUNDED PRECEDING) AS gone FROM s)
    SELECT chunk_id, document FROM g WHERE gone = 0""")
def stop_at_index(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.until_index(domain(spark, d, "pieces"), F.col("document")).select("chunk_id", "document")


@job("""SELECT material_id, coalesce(order_in_topic, coalesce(max(order_in_topic) OVER (PARTITION BY topic_id), 0) + row_number() OVER (PARTITION BY topic_id, order_in_topic IS NULL ORDER BY material_id)) AS order_in_topic FROM materials""")
def backfill_order(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.backfill_order(domain(spark, d, "materials")).select("material_id", F.col("order_in_topic").cast("bigint").alias("order_in_topic"))


READING = "subtopic_order, coalesce(order_in_topic, 10000000), title, material_id"


@job(f"SELECT material_id, topic_id, lag(material_id) OVER (PARTITION BY topic_id ORDER BY {READING}) AS previous_id, lead(material_id) OVER (PARTITION BY topic_id ORDER BY {READING}) AS next_id FROM materials")
def reading_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.reading_neighbors(domain(spark, d, "materials"))


@job(f"SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY {READING}) AS place, material_id, title FROM materials WHERE contains(lower(title), 'page 1') OR contains(lower(content), 'page 1')")
def reading_toc(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.reading_toc(domain(spark, d, "materials"), "Page 1")


@job("""WITH n AS (SELECT DISTINCT p_name AS name, lower(trim(p_name)) AS n FROM part UNION SELECT upper(name) || '  ', lower(name) FROM subtopics UNION SELECT name || ' and more', lower(name || ' and more') FROM subtopics),
    e AS (SELECT n.name, min(subtopic_id) AS subtopic_id FROM n JOIN subtopics s ON n.n = lower(s.name) GROUP BY n.name),
    r AS (SELECT n.name, min(subtopic_id) AS subtopic_id FROM n JOIN subtopics s ON starts_with(n.n, lower(s.name)) OR starts_with(lower(s.name), n.n) WHERE n.name NOT IN (SELECT name FROM e) GROUP BY n.name)
    SELECT * FROM e UNION ALL SELECT * FROM r""")
def match_subtopic_names(spark: SparkSession, d: str) -> DataFrame:
    s = domain(spark, d, "subtopics")
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")).unionByName(s.select(F.concat(F.upper("name"), F.lit("  ")).alias("name"))).unionByName(s.select(F.concat("name", F.lit(" and more")).alias("name")))
    return catalogue.matched_names(names, s)


@job("""WITH q AS (SELECT p_partkey AS question_id, [p_name, concat(' ', upper(s1.name)), 'Supplier', concat(s2.name, ' x'), p_name] AS names FROM part LEFT JOIN subtopics s1 ON s1.subtopic_id = p_partkey % 100 LEFT JOIN subtopics s2 ON s2.subtopic_id = p_size % 100),
    n AS (SELECT question_id, unnest(names) AS name, unnest(range(5)) AS at_k FROM q),
    d AS (SELECT DISTINCT name, lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) AS k FROM n WHERE name IS NOT NULL),
    c AS (SELECT subtopic_id, topic_id, lower(trim(name)) AS c FROM subtopics),
    e AS (SELECT name, min(subtopic_id) AS subtopic_id FROM d JOIN c ON k = c GROUP BY name),
    r AS (SELECT name, min(subtopic_id) AS subtopic_id FROM d JOIN c ON starts_with(k, c) OR starts_with(c, k) WHERE name NOT IN (SELECT name FROM e) GROUP BY name),
    m AS (SELECT question_id, at_k, x.subtopic_id AS subtopic_id, c.topic_id AS topic_id FROM n JOIN (SELECT * FROM e UNION ALL SELECT * FROM r) x ON n.name = x.name JOIN c ON c.subtopic_id = x.subtopic_id),
    s AS (SELECT question_id, string_agg(CAST(subtopic_id AS VARCHAR), ',' ORDER BY at_k) AS subtopic_ids FROM (SELECT question_id, subtopic_id, min(at_k) AS at_k FROM m GROUP BY ALL) y GROUP BY question_id),
    t AS (SELECT question_id, string_agg(CAST(topic_id AS VARCHAR), ',' ORDER BY at_k) AS topic_ids FROM (SELECT question_id, topic_id, min(at_k) AS at_k FROM m GROUP BY ALL) y GROUP BY question_id)
    SELECT q.question_id AS question_id, coalesce(subtopic_ids, '') AS subtopic_ids, coalesce(topic_ids, '') AS topic_ids FROM q LEFT JOIN s ON s.question_id = q.question_id LEFT JOIN t ON t.question_id = q.question_id""")
def match_subtopic_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ordered ids of the subtopics and topics that each question's names match; the names are made of part and supplier names."""
    s = domain(spark, d, "subtopics")
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("question_id"), "p_name", (F.col("p_partkey") % 100).alias("k1"), (F.col("p_size") % 100).cast("bigint").alias("k2"))
    named = lambda k, c: s.select(F.col("subtopic_id").alias(k), F.col("name").alias(c))
    q = p.join(named("k1", "n1"), "k1", "left").join(named("k2", "n2"), "k2", "left")
    q = q.select("question_id", F.array(F.col("p_name"), F.concat(F.lit(" "), F.upper("n1")), F.lit("Supplier"), F.concat("n2", F.lit(" x")), F.col("p_name")).alias("names"))
    found = catalogue.matched_lists(q, s)
    return found.select("question_id", F.array_join("subtopic_ids", ",").alias("subtopic_ids"), F.array_join("topic_ids", ",").alias("topic_ids"))


@job("""SELECT s.subtopic_id AS subtopic_id, coalesce(q.n, 0) AS questions, coalesce(r.n, 0) AS answers, coalesce(c.n, 0) AS chunks FROM subtopics s LEFT JOIN (SELECT subtopic_id, count(*) AS n FROM questions GROUP BY subtopic_id) q ON q.subtopic_id = s.subtopic_id
    LEFT JOIN (SELECT subtopic_id, count(*) AS n FROM responses GROUP BY subtopic_id) r ON r.subtopic_id = s.subtopic_id LEFT JOIN (SELECT subtopic_id, count(*) AS n FROM pieces GROUP BY subtopic_id) c ON c.subtopic_id = s.subtopic_id""")
def delete_impact(spark: SparkSession, d: str) -> DataFrame:
    part = lambda v: domain(spark, d, v).select("subtopic_id")
    return catalogue.delete_impact(domain(spark, d, "subtopics"), questions=part("questions"), answers=part("responses"), chunks=part("pieces"))


@job("SELECT entry_id FROM toc WHERE document IN (SELECT document FROM pieces GROUP BY document HAVING count(*) % 2 = 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Contents of documents with an odd number of chunks go with them."""
    gone = domain(spark, d, "pieces").groupBy("document").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return catalogue.without(domain(spark, d, "toc"), gone, "document").select("entry_id")


@job("""WITH n AS (SELECT s_suppkey AS notification_id, s_suppkey % 50 = 0 AS is_broadcast, s_suppkey AS recipient FROM supplier)
    SELECT notification_id, user_id FROM n, users WHERE is_broadcast AND role = 'learner' UNION ALL SELECT notification_id, recipient FROM n WHERE NOT is_broadcast""")
def notification_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for notifications; every fiftieth is for all learners."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("notification_id"), (F.col("s_suppkey") % 50 == 0).alias("is_broadcast"), F.col("s_suppkey").alias("recipient"))
    return catalogue.fanned_out(s, domain(spark, d, "users"))


@job("""WITH b AS (SELECT subtopic_id, name, name AS c FROM subtopics WHERE subtopic_id % 5 <> 0), a AS (SELECT subtopic_id, name, CASE WHEN subtopic_id % 3 = 0 THEN NULL ELSE name END AS c FROM subtopics)
    SELECT a.subtopic_id AS subtopic_id, CASE WHEN b.subtopic_id IS NULL THEN 'new' ELSE 'changed' END AS kind FROM a LEFT JOIN b ON a.subtopic_id = b.subtopic_id WHERE b.subtopic_id IS NULL OR a.c IS DISTINCT FROM b.c""")
def changed_subtopics(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the subtopics is new, and of a third the intent went."""
    s = domain(spark, d, "subtopics")
    before = s.where("subtopic_id % 5 <> 0").select("subtopic_id", "name", F.col("name").alias("concept_intent"))
    after = s.select("subtopic_id", "name", F.when(F.col("subtopic_id") % 3 != 0, F.col("name")).alias("concept_intent"))
    return changes.changed(before, after, "subtopic_id", ["name", "concept_intent"])


@job("""SELECT z.name AS zone, t.name AS topic, count(s.subtopic_id) AS subtopics, coalesce(string_agg(s.name, ',' ORDER BY s.subtopic_id), '') AS names FROM zones z JOIN topics t ON t.zone_id = z.zone_id
    LEFT JOIN subtopics s ON s.topic_id = t.topic_id GROUP BY z.name, t.topic_id, t.name""")
def generation_scope(spark: SparkSession, d: str) -> DataFrame:
    zones, topics, subtopics = (domain(spark, d, v) for v in ("zones", "topics", "subtopics"))
    inside = subtopics.groupBy("topic_id").agg(F.count("*").alias("subtopics"), F.sort_array(F.collect_list(F.struct("subtopic_id", "name"))).alias("s"))
    rows = topics.join(zones.select("zone_id", F.col("name").alias("zone")), "zone_id").join(inside, "topic_id", "left")
    return rows.select("zone", F.col("name").alias("topic"), F.coalesce("subtopics", F.lit(0)).alias("subtopics"), F.coalesce(F.array_join(F.transform("s", lambda x: x["name"]), ","), F.lit("")).alias("names"))


@job("""WITH w AS (SELECT user_id AS generation_id, event_type AS worker_id, ts, CASE WHEN event_id % 41 = 0 THEN 'cancelled' WHEN value > 200 THEN 'completed' WHEN value > 100 THEN 'active' ELSE 'failed' END AS status, event_id % 50 AS questions, event_id % 97 AS seconds FROM events),
    l AS (SELECT generation_id, worker_id, CASE WHEN bool_or(status = 'cancelled') THEN 'cancelled' ELSE arg_max(status, ts) END AS status, max(questions) AS questions, max(seconds) AS seconds FROM w GROUP BY ALL),
    g AS (SELECT generation_id, count(*) AS workers, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'active') AS active,
        count(*) FILTER (WHERE status = 'cancelled') AS cancelled, CAST(sum(questions) AS BIGINT) AS questions, max(seconds) AS seconds FROM l GROUP BY generation_id)
    SELECT *, round(completed * 100.0 / workers, 6) AS percent, CASE WHEN completed > 0 THEN round((workers - completed - failed - cancelled) * seconds * 1.0 / completed, 6) END AS eta FROM g""")
def generation_progress(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for reports of workers: the user for the generation, the type for the worker."""
    e = spark.read.parquet(f"{d}/events.parquet")
    status = F.when(F.col("event_id") % 41 == 0, "cancelled").when(F.col("value") > 200, "completed").when(F.col("value") > 100, "active").otherwise("failed")
    return catalogue.generation_progress(e.select(F.col("user_id").alias("generation_id"), F.col("event_type").alias("worker_id"), F.col("ts").alias("at"), status.alias("status"), (F.col("event_id") % 50).alias("questions"), (F.col("event_id") % 97).alias("seconds")))


@job("""WITH s AS (SELECT CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS predicted, quality AS actual FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    p AS (SELECT actual AS label, count(*) AS support, count(*) FILTER (WHERE actual = predicted) AS hits FROM s GROUP BY actual), q AS (SELECT predicted AS label, count(*) AS said FROM s GROUP BY predicted),
    r AS (SELECT p.label AS label, support, hits, CASE WHEN coalesce(said, 0) > 0 THEN hits * 1.0 / said ELSE 0.0 END AS "precision", hits * 1.0 / support AS recall FROM p LEFT JOIN q ON q.label = p.label),
    f AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1 FROM r)
    SELECT label, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round((SELECT sum(hits) * 1.0 / sum(support) FROM f), 6) AS accuracy, round((SELECT avg(f1) FROM f), 6) AS macro_f1 FROM f""")
def classifier_report(spark: SparkSession, d: str) -> DataFrame:
    """Length as a classifier of quality."""
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    scored = labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("actual"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("predicted"))
    return catalogue.classifier_report(scored)


@job("""WITH w AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 1) AS w FROM benchmark),
    t AS (SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE [] END)) AS term FROM w),
    c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM c),
    x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) * 1.0 / (1 + df)) + 1) AS v FROM f)
    SELECT id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS weight FROM x""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.tfidf(spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")).withColumn("weight", F.round("weight", 6))


LEVEL_SIGNS = " + ".join(f"CASE WHEN regexp_matches(low, {quoted(p)}) THEN {w} ELSE 0 END" for w, _, p in rules.ASKS)


@job(f"""WITH t AS (SELECT item_id, lower(trim(coalesce(text, ''))) AS low FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, lower(trim(coalesce(text, ''))) FROM conversations),
    s AS (SELECT item_id, low, {LEVEL_SIGNS} + CASE WHEN NOT contains(low, '?') AND (regexp_matches(low, {quoted(rules.STATEMENT[0])}) OR regexp_matches(low, {quoted(rules.STATEMENT[1])})) THEN 1 ELSE 0 END
        + CASE WHEN len(regexp_extract_all(low, '\\b(and|or|but|however)\\b')) >= 2 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, {quoted(rules.SNIPPET)}) THEN 1 ELSE 0 END AS score FROM t)
    SELECT item_id, CASE WHEN low = '' THEN 'beginner' WHEN score >= 8 THEN 'master' WHEN score >= 6 THEN 'advanced'
        WHEN score >= 4 OR (regexp_matches(low, {quoted(rules.ASKS[7][2])}) AND regexp_matches(low, {quoted(rules.SNIPPET)})) THEN 'intermediate' ELSE 'beginner' END AS level FROM s""")
def non_coding_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Of benchmark items and of turns of conversations."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    return b.unionByName(c).select("item_id", rules.question_level(F.col("text")).alias("level"))


CONTEXT = """ranked AS (SELECT subtopic_id AS owner_id, row_number() OVER (PARTITION BY subtopic_id ORDER BY chunk_id * 7919 % 1009, chunk_id) AS rank, chunk_id, 1 - (chunk_id * 7919 % 1009) / 1009.0 AS similarity FROM pieces),
    k AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY rank) AS k FROM ranked WHERE similarity >= 0.5),
    best AS (SELECT k.owner_id, k.rank, p.text, p.document, length(p.document) % 3 AS tier FROM k JOIN pieces p ON p.chunk_id = k.chunk_id WHERE k <= 15),
    pooled AS (SELECT *, max(CASE WHEN tier < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY owner_id) AS in_pool FROM best),"""


@job(f"""WITH {CONTEXT} l AS (SELECT *, lower(trim(text)) AS low, lower(document) AS title FROM pooled WHERE in_pool = 0 OR tier < 2),
    good AS (SELECT * FROM l WHERE length(low) >= 200 AND len(list_filter({MARKERS}, lambda m: contains(low, m))) = 0 AND NOT (length(title) >= 8 AND (length(low) - length(replace(low, title, ''))) // greatest(length(title), 1) >= 3
        AND ((length(low) - length(replace(low, title, ''))) // greatest(length(title), 1)) * length(title) * 1.0 / length(low) > 0.05)),
    c AS (SELECT owner_id, count(*) AS chunks, string_agg(text, chr(10) || chr(10) ORDER BY CASE WHEN tier < 2 THEN tier ELSE 0 END, rank) AS context FROM good GROUP BY owner_id)
    SELECT o.owner_id AS owner_id, coalesce(chunks, 0) AS chunks, md5(coalesce(context, '')) AS context FROM (SELECT DISTINCT owner_id FROM ranked) o LEFT JOIN c ON c.owner_id = o.owner_id""")
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by a number of the chunk; a document's place in the pool by the length of its name."""
    from pyspark.sql import Window as W

    pieces = domain(spark, d, "pieces")
    score = F.col("chunk_id") * 7919 % 1009
    ranked = pieces.select(F.col("subtopic_id").alias("owner_id"), F.row_number().over(W.partitionBy("subtopic_id").orderBy(score, "chunk_id")).alias("rank"), "chunk_id", (1 - score / 1009.0).alias("similarity"))
    pool = pieces.select("document", (F.length("document") % 3).alias("tier")).distinct().where("tier < 2")
    chunks = pieces.select("chunk_id", "document", "text", F.col("document").alias("title"))
    return catalogue.retrieval_context(ranked, chunks, pool).withColumn("context", F.md5("context"))


@job("""SELECT document, count(*) AS chunks, max(chunk_id) AS newest FROM pieces WHERE document NOT LIKE 'w%' GROUP BY document""")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose name begins with w are deleted; the newest chunk stands for the time."""
    pieces = domain(spark, d, "pieces")
    docs = pieces.groupBy("document").agg(F.max("chunk_id").alias("created_at")).withColumn("is_deleted", F.col("document").startswith("w"))
    return catalogue.document_list(docs, pieces).select("document", "chunks", F.col("created_at").alias("newest"))


@job(f"""WITH {TYPED} SELECT subtopic_id, chunk_type, count(*) AS chunks, max(1 - (chunk_id * 7919 % 1009) / 1009.0) AS best FROM typed GROUP BY GROUPING SETS ((subtopic_id, chunk_type), (subtopic_id), ())""")
def semantic_overview(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by subtopic and kind with the best similarity, and totals."""
    rows = _typed(spark, d).withColumn("similarity", 1 - (F.col("chunk_id") * 7919 % 1009) / 1009.0)
    sets = [["subtopic_id", "chunk_type"], ["subtopic_id"], []]
    return rows.groupingSets(sets, "subtopic_id", "chunk_type").agg(F.count("*").alias("chunks"), F.max("similarity").alias("best"))


@job(f"""WITH {TYPED}, r AS (SELECT subtopic_id, chunk_type, chunk_id, round(1 - (chunk_id * 7919 % 1009) / 1009.0, 6) AS similarity FROM typed),
    k AS (SELECT *, row_number() OVER (PARTITION BY subtopic_id, chunk_type ORDER BY similarity DESC, chunk_id) AS k FROM r WHERE similarity >= 0.5) SELECT subtopic_id, chunk_type, chunk_id, similarity FROM k WHERE k <= 5""")
def similar_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of each kind for each subtopic, from a similarity of 0.5 on."""
    from pyspark.sql import Window as W

    rows = _typed(spark, d).select("subtopic_id", "chunk_type", "chunk_id", F.round(1 - (F.col("chunk_id") * 7919 % 1009) / 1009.0, 6).alias("similarity")).where("similarity >= 0.5")
    k = F.row_number().over(W.partitionBy("subtopic_id", "chunk_type").orderBy(F.desc("similarity"), "chunk_id"))
    return rows.withColumn("k", k).where("k <= 5").drop("k")


@job("""WITH s AS (SELECT document, entry_id, start_page, start_page + entry_id % 3 AS end_page FROM toc) SELECT s.entry_id AS entry_id, p.chunk_id AS chunk_id FROM s JOIN pieces p ON p.document = s.document AND p.page BETWEEN s.start_page AND s.end_page""")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    from gradeflow.operators import content

    toc = domain(spark, d, "toc").withColumn("end_page", F.col("start_page") + F.col("entry_id") % 3)
    return content.section_chunks(toc, domain(spark, d, "pieces"))


@job("SELECT chunk_id, substr(CASE WHEN label % 2 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), lambda x: x <> ''), chr(10)) END, 1, 2048) AS text FROM pieces JOIN embeddings ON vec_id = chunk_id")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), (F.col("label") % 2 == 1).alias("is_code"))
    return domain(spark, d, "pieces").join(kinds, "chunk_id").select("chunk_id", rules.encoder_text(F.col("text"), F.col("is_code")).alias("text"))


FIRST_TEST_POINTS = " + ".join(
    f"CASE WHEN regexp_matches(low, {quoted(a)}){f' OR regexp_matches(lower(code), {quoted(b)})' if b else ''} THEN {n} ELSE 0 END" for n, a, b in rules.FIRST_TEST
)


@job(f"""WITH q AS (SELECT item_id, trim(coalesce(text, '')) AS text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, trim(coalesce(text, '')) FROM conversations UNION ALL SELECT 2000000 + chunk_id, trim(text) FROM pieces),
    f AS (SELECT item_id, text, trim(array_to_string(regexp_extract_all(text, {quoted(rules.FENCED)}, 1), chr(10))) AS fenced, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {quoted(rules.CODE_LINE)})), chr(10))) AS lines FROM q),
    c AS (SELECT item_id, lower(text) AS low, CASE WHEN fenced <> '' THEN fenced ELSE lines END AS code FROM f), s AS (SELECT item_id, CASE WHEN code <> '' THEN 1 ELSE 0 END + {FIRST_TEST_POINTS} AS score FROM c)
    SELECT item_id, CASE WHEN score >= {rules.ADVANCED_FROM} THEN 'advanced' WHEN score >= {rules.INTERMEDIATE_FROM} THEN 'intermediate' ELSE 'beginner' END AS level FROM s""")
def preassessment_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Of benchmark items, turns of conversations and chunks."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    p = domain(spark, d, "pieces").select((F.lit(2000000) + F.col("chunk_id")).alias("item_id"), "text")
    return b.unionByName(c).unionByName(p).select("item_id", rules.first_test_level(F.col("text")).alias("level"))


@job()
def merge_split_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks put together across pages; whether one goes on depends on all that is put together before, which no SQL folds here."""
    return merging.merge_split_chunks(domain(spark, d, "pieces").withColumn("chunk_type", rules.classify_chunk(F.col("text"))))
