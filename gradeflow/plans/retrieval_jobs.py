"""Registered jobs of retrieval contexts over real rankings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import text as rules
from gradeflow.operators import content, retrieval
from gradeflow.plans.adapters import domain
from gradeflow.plans.content_jobs import TYPED, quoted
from gradeflow.plans.jobs import job
from gradeflow.storage import stored

GAMES = ("coding", "non_coding")
#: Least similarity here: the given vectors lie far apart, and few pairs reach the service's 0.5.
LEAST = 0.25
#: A document's difficulty by the last character of its name.
_LEVEL = "CASE ascii(right(document, 1)) % 5 WHEN 0 THEN 'Beginner' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced' WHEN 3 THEN 'master' END"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Both lists of the owners, which are the vectors whose id is divisible by 100: the nearest chunks of code and of concepts."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    chunks = e.join(domain(spark, d, "pieces").select(F.col("chunk_id").alias("id")), "id")
    one = lambda name, odd: content.semantic_rank(e.where("id % 100 = 0").select("id", F.lit(0).alias("model"), "vector"), chunks.where(F.col("label") % 2 == odd).select("id", F.lit(0).alias("model"), "vector"), k=20).where("chunk_id is not null").withColumn("list", F.lit(name))
    return one("code", 1).unionByName(one("concept", 0)).withColumnRenamed("cosine", "similarity")


def _owners(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 100 = 0")
    return e.select(F.col("vec_id").alias("owner_id"), F.concat(F.lit("Subtopic "), "vec_id").alias("name"), F.concat(F.lit("Topic "), "label").alias("topic"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    owners = _owners(spark, d)
    every = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    wanted = owners.select("owner_id", every("difficulty", retrieval.POOLS)).select("owner_id", "difficulty", every("game_type", GAMES))
    chunks = domain(spark, d, "pieces").select("chunk_id", rules.classify_chunk(F.col("text")).alias("chunk_type"), "text", F.col("document").alias("title"), F.expr(_LEVEL).alias("document_difficulty"))
    return retrieval.retrieval_contexts(wanted, owners, stored(_ranked(spark, d), "ranked"), chunks, LEAST)


def _guidance(mixed: str) -> str:
    cases = []
    for target, (_, higher) in retrieval.POOLS.items():
        names = {"Target": target.capitalize(), "target": target, "higher": ", ".join(f'"{h.capitalize()}"' for h in higher)}
        if higher:
            cases.append(f"WHEN difficulty = '{target}' AND {mixed} THEN {quoted(retrieval.MIXED_GUIDANCE.format(**names))}")
        cases.append(f"WHEN difficulty = '{target}' THEN {quoted(retrieval.PLAIN_GUIDANCE.format(**names))}")
    return f"CASE {' '.join(cases)} END"


_ALL = " OR ".join(f"(difficulty = '{t}' AND level IN ({', '.join(map(quoted, a + b))}))" for t, (a, b) in retrieval.POOLS.items())
_ABOVE = " OR ".join(f"(difficulty = '{t}' AND level IN ({', '.join(map(quoted, b))}))" for t, (a, b) in retrieval.POOLS.items() if b)
_MARKED = "list_filter([" + ", ".join(map(quoted, rules.JUNK_MARKERS)) + "], lambda m: contains(low, m))[1]"
_HITS = "((length(low) - length(replace(low, title, ''))) // greatest(length(title), 1))"
CONTEXTS = f"""{TYPED},
    unit AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS size FROM embeddings),
    cos AS (SELECT o.vec_id AS owner_id, CASE WHEN c.label % 2 = 1 THEN 'code' ELSE 'concept' END AS list, c.vec_id AS chunk_id,
        list_sum(list_transform(list_zip(o.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (o.size * c.size) AS s
        FROM unit o JOIN unit c ON c.vec_id <> o.vec_id JOIN pieces p ON p.chunk_id = c.vec_id WHERE o.vec_id % 100 = 0),
    ranked AS (SELECT *, round(s, 5) AS similarity, row_number() OVER (PARTITION BY owner_id, list ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM cos WHERE s >= 0.1 QUALIFY rank <= 20),
    best AS (SELECT *, row_number() OVER (PARTITION BY owner_id, list ORDER BY rank) AS at_k FROM ranked WHERE similarity >= {LEAST} QUALIFY at_k <= {retrieval.LIST_TOP}),
    owners AS (SELECT vec_id AS owner_id, concat('Subtopic ', vec_id) AS name, concat('Topic ', label) AS topic FROM embeddings WHERE vec_id % 100 = 0),
    wanted AS (SELECT owners.*, difficulty, game_type FROM owners, (VALUES {', '.join(f"('{k}')" for k in retrieval.POOLS)}) x(difficulty), (VALUES {', '.join(f"('{k}')" for k in GAMES)}) y(game_type)),
    picked AS (SELECT w.*, b.at_k, b.chunk_id FROM wanted w JOIN best b ON b.owner_id = w.owner_id WHERE CASE WHEN EXISTS (SELECT 1 FROM best f WHERE f.owner_id = w.owner_id AND f.list = CASE WHEN game_type = 'coding' THEN 'code' ELSE 'concept' END)
        THEN b.list = CASE WHEN game_type = 'coding' THEN 'code' ELSE 'concept' END ELSE b.list = CASE WHEN game_type = 'coding' THEN 'concept' ELSE 'code' END AND b.at_k <= {retrieval.OTHER_TOP} END),
    told AS (SELECT k.*, t.chunk_type, t.text, t.document, lower(trim(t.text)) AS low, lower(trim(t.document)) AS title, lower(coalesce({_LEVEL}, '')) AS level FROM picked k JOIN typed t ON t.chunk_id = k.chunk_id),
    pooled AS (SELECT *, {_ALL} AS allowed, {_ABOVE} AS above FROM told QUALIFY allowed OR NOT bool_or({_ALL}) OVER (PARTITION BY owner_id, difficulty, game_type)),
    why AS (SELECT *, CASE WHEN text = '' THEN 'empty text' WHEN length(low) < 200 THEN concat('too short (', length(low), ' < 200)') WHEN {_MARKED} IS NOT NULL THEN concat('matched junk marker: ''', {_MARKED}, '''')
        WHEN length(title) >= 8 AND {_HITS} >= 3 AND {_HITS} * length(title) * 1.0 / length(low) > 0.05 THEN concat('title ''', title, ''' repeated ', {_HITS}, 'x at high density') END AS why,
        concat('--- ', chunk_type, ' [difficulty: ', CASE WHEN level = '' THEN 'unknown' ELSE level END, '] ---', chr(10), regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), 'Document: ', document) AS entry FROM pooled),
    parts AS (SELECT owner_id, difficulty, game_type, count(*) FILTER (WHERE why IS NULL) AS kept, count(*) FILTER (WHERE why IS NULL AND above) AS supplementary, count(*) FILTER (WHERE why IS NOT NULL) AS junk,
        string_agg(DISTINCT chunk_type, ', ' ORDER BY chunk_type) FILTER (WHERE why IS NULL) AS kinds,
        string_agg(entry, chr(10) || chr(10) ORDER BY at_k) FILTER (WHERE why IS NULL AND NOT above) AS first, string_agg(entry, chr(10) || chr(10) ORDER BY at_k) FILTER (WHERE why IS NULL AND above) AS second,
        array_to_string(list_slice(list(concat('id=', chunk_id, ': ', why) ORDER BY at_k) FILTER (WHERE why IS NOT NULL), 1, {retrieval.TOLD}), '; ') AS details FROM why GROUP BY ALL),
    texts AS (SELECT w.*, coalesce(kept, 0) AS kept, coalesce(supplementary, 0) AS supplementary, kinds, junk, details, concat('Topic: ', topic, chr(10), 'Subtopic: ', name, chr(10), 'Game Type: ', w.game_type) AS head,
        CASE WHEN kept > 0 THEN concat_ws(chr(10) || chr(10), {quoted(retrieval.PRIMARY_HEAD)} || first, {quoted(retrieval.SUPPLEMENTARY_HEAD)} || second) END AS content, p.owner_id IS NOT NULL AS listed
        FROM wanted w LEFT JOIN parts p ON p.owner_id = w.owner_id AND p.difficulty = w.difficulty AND p.game_type = w.game_type),
    contexts AS (SELECT *, CASE WHEN kept > 0 THEN concat(head, chr(10), 'Target Difficulty: ', difficulty, chr(10), 'Content Types Found: ', kinds, chr(10), 'Retrieved Chunks: ', kept, ' (primary=', kept - supplementary, ', supplementary=', supplementary, ')',
        chr(10), chr(10), {_guidance("supplementary > 0")}, chr(10), chr(10), '{retrieval.CONTENT_HEAD}', chr(10), content)
        ELSE concat(head, chr(10), chr(10), CASE WHEN owner_id NOT IN (SELECT owner_id FROM ranked) THEN '{retrieval.NO_RANKING}' WHEN NOT listed THEN concat('No relevant ', game_type, ' chunks found above similarity threshold')
            ELSE concat('All ', junk, ' retrieved chunks rejected as junk (', details, ')') END, '.', chr(10), 'Please generate ', game_type, ' questions based on the subtopic name and general Python knowledge.') END AS context FROM texts)"""


@job(f"WITH {CONTEXTS} SELECT owner_id, difficulty, game_type, kept, supplementary, md5(context) AS context FROM contexts")
def retrieval_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The whole text for each owner, difficulty and game type, from the rankings of ``semantic_rank``."""
    return _contexts(spark, d).select("owner_id", "difficulty", "game_type", "kept", "supplementary", F.md5("context").alias("context"))


@job(f"""WITH {CONTEXTS}, m AS (SELECT a.owner_id AS combination, k, a.owner_id + 100 * k AS owner_id FROM owners a, range(2) t(k)),
    c AS (SELECT combination, difficulty, game_type, string_agg(name, ' + ' ORDER BY k) AS names, bool_or(supplementary > 0) AS above, string_agg(concat('=== ', name, ' ===', chr(10), coalesce(trim(content), context)), chr(10) || chr(10) ORDER BY k) AS parts
        FROM m JOIN contexts x ON x.owner_id = m.owner_id GROUP BY combination, difficulty, game_type)
    SELECT combination, difficulty, game_type, md5(concat('GAME TYPE: ', upper(game_type), chr(10), 'DIFFICULTY LEVEL: ', upper(difficulty), chr(10), 'SUBTOPIC COMBINATION: ', names, chr(10), chr(10), {_guidance("above")}, chr(10), chr(10), parts)) AS context FROM c""")
def combined_rag_context(spark: SparkSession, d: str) -> DataFrame:
    """One text for each owner with the next one."""
    owners = _owners(spark, d)
    pairs = owners.select(F.col("owner_id").alias("combination"), F.posexplode(F.array("owner_id", F.col("owner_id") + 100)).alias("place", "owner_id"))
    return retrieval.combined_contexts(pairs, stored(_contexts(spark, d), "contexts"), owners).withColumn("context", F.md5("context"))
