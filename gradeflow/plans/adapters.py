"""Domain tables built from the driver's tables, as DataFrames and, word for word alike, as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view is written once in SQL that Spark and DuckDB both read.
VIEWS = {
    "zones": "SELECT r_regionkey AS zone_id, r_name AS name, r_regionkey AS zone_order FROM region",
    "topics": "SELECT n_nationkey AS topic_id, n_regionkey AS zone_id, n_name AS name FROM nation",
    "subtopics": """SELECT s_suppkey AS subtopic_id, s_nationkey AS topic_id, s_name AS name,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS order_in_topic FROM supplier""",
    "users": """SELECT c_custkey AS user_id, c_name AS username,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'learner' END AS role,
        CASE WHEN c_nationkey % 4 < 3 THEN c_nationkey % 4 END AS learner_cluster FROM customer""",
    "questions": """SELECT p_partkey AS question_id, p_partkey % (SELECT count(*) FROM supplier) AS subtopic_id,
        p_name AS question_text, p_brand AS correct_answer,
        CASE WHEN p_size <= 12 THEN 'beginner' WHEN p_size <= 25 THEN 'intermediate'
             WHEN p_size <= 38 THEN 'advanced' ELSE 'master' END AS difficulty,
        CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'coding' ELSE 'non_coding' END AS game_type,
        CASE WHEN p_size % 3 = 0 THEN 'pending' WHEN p_size % 3 = 1 THEN 'processed' ELSE 'approved' END AS status,
        p_size % 17 = 0 AS flagged FROM part""",
    "sessions": """SELECT o_orderkey AS session_id, o_custkey AS user_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'expired' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'crossword' WHEN '2' THEN 'hangman'
             WHEN '3' THEN 'wordsearch' WHEN '4' THEN 'debugging' END AS game_type,
        o_orderdate AS start_time, o_orderkey % 240 AS elapsed FROM orders""",
    "responses": """SELECT l_orderkey AS session_id, o_custkey AS user_id, l_partkey AS question_id, l_suppkey AS subtopic_id,
        l_linenumber AS line, l_shipdate AS created_at, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS correct,
        CAST(l_quantity AS INT) AS time_taken FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "attempts": "SELECT user_id AS student, event_type AS skill, CASE WHEN value > 100 THEN 1 ELSE 0 END AS correct, ts, event_id FROM events",
    "items": """SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS item_id,
        l_partkey AS question_id, p_brand AS correct_answer, CASE WHEN l_returnflag <> 'R' THEN concat(' ', upper(p_brand), ' ') ELSE 'x' END AS given_answer,
        CAST(l_quantity AS INT) AS time_taken, l_linenumber % 7 = 0 AS skipped FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bank": """SELECT p_partkey AS question_id, CASE WHEN p_size % 23 = 0 THEN NULL ELSE p_partkey % 25 END AS topic_id, p_partkey % 100 AS subtopic_id,
        CASE WHEN p_size % 19 = 0 THEN 'short' ELSE p_name END AS question_text, CASE WHEN p_size % 13 = 0 THEN ' ' ELSE p_brand END AS correct_answer, p_size,
        CASE WHEN p_size <= 12 THEN 'beginner' WHEN p_size <= 25 THEN 'intermediate' WHEN p_size <= 38 THEN 'advanced' ELSE 'master' END AS difficulty,
        CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'coding' ELSE 'non_coding' END AS game_type, CASE WHEN p_size % 11 = 0 THEN 'processing' ELSE 'pending' END AS status,
        p_size % 3 = 0 AS flagged, CASE WHEN p_size % 2 = 0 THEN 'Wrong answer' ELSE 'Typo in the text' END AS flag_reason, p_partkey AS flag_created_at, p_size % 5 AS flag_count,
        concat('{"explanation":"', p_brand, '","n":', CAST(p_size AS STRING), CASE WHEN p_size % 4 = 0 THEN ',"used":true' ELSE '' END, CASE WHEN p_size % 6 = 0 THEN ',"context":"c"' ELSE '' END,
            CASE WHEN p_size % 5 = 0 THEN ',"rag_context":{"used":1}' WHEN p_size % 5 = 1 THEN ',"rag_context":{"used":1,"x":[1,2]}' ELSE '' END, '}') AS game_data FROM part""",
    # places in a document are numbered over ids alone, and texts are joined by id, so that no task gathers a source's texts
    "chunks": """SELECT doc_id AS chunk_id, source AS document, text, n_chars, k AS order_in_doc
        FROM documents d JOIN (SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) n ON d.doc_id = n.id""",
    "pieces": """SELECT doc_id AS chunk_id, source AS document, doc_id % 9 + 1 AS subtopic_id, CAST(floor((k - 1) / 4) AS BIGINT) AS page,
        k AS order_in_doc, concat(coalesce(text, ''), CASE doc_id % 11 WHEN 0 THEN concat(chr(10), '>>> print(x)') WHEN 1 THEN ' Your turn: write it.'
            WHEN 2 THEN ' Exercise: implement it.' WHEN 3 THEN ' The following code shows it.' WHEN 4 THEN ' All rights reserved' WHEN 5 THEN concat(chr(10), 'x = 1', chr(10), '    y(z)', chr(10), '    w')
            WHEN 6 THEN ' Leave a review, see https://a.org/b and [12] Page 3 of 9' WHEN 7 THEN ' Fluent Python' WHEN 8 THEN concat(chr(10), 'def f(a):', chr(10), 'import os', chr(10), 'class C:') ELSE '' END) AS text
        FROM documents d JOIN (SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) n ON d.doc_id = n.id""",
    "toc": """SELECT source AS document, doc_id AS entry_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 3) AS BIGINT) AS start_page,
        CASE doc_id % 7 WHEN 0 THEN 'Preface' WHEN 1 THEN '1.2 Loops' WHEN 2 THEN ' LOOPS' WHEN 3 THEN '12.' WHEN 4 THEN 'Loops' ELSE concat('Topic ', doc_id) END AS title, doc_id % 4 + 1 AS level FROM documents""",
    "book_pages": """SELECT doc_id AS document, 0 AS page, coalesce(text, '') AS text FROM documents UNION ALL
        SELECT doc_id, 1, CASE doc_id % 4 WHEN 0 THEN concat('Contents', chr(10), '1. ', substr(text, 1, 20), ' ..... ', doc_id % 90 + 1, chr(10), chr(10), '1.1 ', substr(text, 21, 20), ' ... ', doc_id % 90 + 3, chr(10), chr(10),
            'Exercise ', substr(text, 41, 9), '....99', chr(10), 'Chapter ', substr(text, 51, 9), ' .. 100')
        WHEN 1 THEN concat('Table of contents', chr(10), substr(text, 1, 20), chr(10), substr(text, 30, 15), chr(10), doc_id % 50 + 2, chr(10), 'Preface', chr(10), '7', chr(10), 'II. ', substr(text, 60, 12), chr(10), chr(10), '88', chr(10), '1.1.1.1 ', substr(text, 80, 12), chr(10), '120')
        WHEN 2 THEN concat('1 ', substr(text, 1, 20), ' .... 2', chr(10), chr(10), '2 ', substr(text, 21, 20), ' .... 4', chr(10), chr(10), '3 ', substr(text, 41, 20), ' .... 9', chr(10), chr(10), '4 ', substr(text, 61, 20), ' .... ', doc_id % 30, chr(10), '1 2 3 4')
        ELSE 'A page without a list' END FROM documents WHERE text IS NOT NULL UNION ALL
        SELECT doc_id, 2, CASE WHEN doc_id % 8 < 4 THEN concat('5 More', chr(10), '....', chr(10), '200', chr(10), 'Practice ... 203', chr(10), chr(10), 'Unit of ', substr(text, 100, 300), chr(10), '210', chr(10), '1 2 3 4 5 6') ELSE 'The first chapter begins here' END FROM documents WHERE text IS NOT NULL""",
    "materials": """SELECT page_id AS material_id, page_id % 25 AS topic_id, page_id % 4 AS subtopic_order, CASE WHEN page_id % 5 > 0 THEN page_id % 5 END AS order_in_topic,
        concat('Page ', page_id % 13) AS title, coalesce(html, '') AS content FROM pages""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def with_views(sql: str) -> str:
    """A query with the domain tables it names in front of it as CTEs."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}" if used else body
    return f"WITH {heads} {body}" if used else body


def domain(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One domain table as a DataFrame over the Parquet files."""
    import re

    sql = VIEWS[view].replace("{", "{{").replace("}", "}}")  # braces of the text, beside those that name tables
    args = {}
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
            args[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(sql, **args)
