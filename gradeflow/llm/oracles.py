"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from gradeflow.llm import bitplanes, quantizer, secrets, url_rules

TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(CAST(x AS DOUBLE)) OR isinf(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, k, k + 9), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT size FROM bw),
dk AS (SELECT doc_id, w, size, unnest(range(1, greatest(1, len(w) - size + 2))) AS k FROM d, sizes),
hits AS (SELECT doc_id, k, dk.size AS size, item FROM dk JOIN bw ON dk.size = bw.size AND array_to_string(list_slice(dk.w, k, k + dk.size - 1), ' ') = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) x GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""



def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def located(name: str, pattern: str, more: str = "") -> str:
    """CTE with doc_id, start, match of a pattern: the lengths of what precedes a match add up to its place."""
    return f"""{name} AS (
  SELECT doc_id, m[i] AS match{", g[i] AS part" if more else ""},
    CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}) AS m, string_split_regex(t, {quoted(pattern)}) AS p{more} FROM d) x) y)"""


ASSIGN = f"(?i){secrets.ASSIGN}"
WEIGHTS = "[" + ", ".join(str(secrets.weight(k)) for k in range(secrets.WINDOW + 1)) + "]"
#: Entropy by counting each window afresh, where the query keeps counts up to date.
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{located("a", ASSIGN, f", regexp_extract_all(t, {quoted(ASSIGN)}, 2) AS g")},
{located("k", secrets.ACCESS)},
{located("h", secrets.HEX)},
{located("c", secrets.CANDIDATE)},
base AS (
  SELECT doc_id, start, start + length(match) AS stop, 0 AS kind FROM a WHERE length(part) >= {secrets.ASSIGN_MIN}
  UNION ALL SELECT doc_id, start, start + length(match), 1 FROM k
  UNION ALL SELECT doc_id, start, start + length(match), 2 FROM h),
live AS (SELECT *, CASE WHEN regexp_full_match(match, '[0-9a-fA-F]+') THEN 3 ELSE 4 END AS kind FROM c WHERE NOT regexp_matches(match, {quoted(secrets.ALLOWED)})),
windows AS (SELECT doc_id, start AS origin, kind, start + j AS start, substr(match, j + 1, {secrets.WINDOW}) AS w
  FROM (SELECT *, unnest(range(0, length(match) - {secrets.WINDOW} + 1)) AS j FROM live) x),
good AS (SELECT * FROM windows WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda x: {WEIGHTS}[length(w) - length(replace(w, x, '')) + 1]))
  <= CASE kind WHEN 3 THEN {secrets.LIMITS["entropy_hex"]} ELSE {secrets.LIMITS["entropy_base64"]} END AND NOT regexp_matches(w, {quoted(secrets.PLACEHOLDER)})),
marked AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id, origin ORDER BY start) <= {secrets.WINDOW} THEN 0 ELSE 1 END AS new FROM good),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, origin ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT doc_id, min(start) AS start, max(start) + {secrets.WINDOW} AS stop, min(kind) AS kind FROM numbered GROUP BY doc_id, origin, run),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start <= r.start AND b.stop >= r.stop)),
texts AS (SELECT doc_id, start, kind, [{", ".join(map(quoted, secrets.KINDS))}][kind + 1] || ':' || start || ':' || stop AS x FROM spans),
s AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '') AS base, string_agg(x, ',' ORDER BY start, kind) AS spans FROM texts GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""


def fits(verdict: str, host: str, path: str) -> str:
    return f"SELECT {quoted(host + path)} AS rule, {quoted(verdict)} AS v, {quoted(host)} AS h, {quoted(path)} AS p"


def slot(name: str, value: str) -> str:
    return f"CASE WHEN {value} <> '' THEN '{name}:' || translate({value}, '{url_rules.UPPER}', '{url_rules.LOWER}') END"


_LAST = "list_last(string_split(path, '/'))"
_KIND = f"CASE WHEN {_LAST} = '' THEN 'folder' WHEN regexp_full_match({_LAST}, '[0-9]+') THEN 'number' WHEN contains({_LAST}, '.') THEN '.' || list_last(string_split({_LAST}, '.')) ELSE 'name' END"
_ASKS = "array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]))), '&')"
_SLOTS = {
    "scheme": "string_split(url, '://')[1]",
    "top": "labels[-1]",
    "domain": "labels[-2]",
    "site": "labels[-3]",
    "first": "CASE WHEN contains(labels[-3], '-') THEN string_split(labels[-3], '-')[1] END",
    "last": "CASE WHEN contains(labels[-3], '-') THEN string_split(labels[-3], '-')[-1] END",
    "lead": "CASE WHEN len(labels) > 3 THEN labels[1] END",
    "dir": "regexp_extract(path, '^/([^/]*)/', 1)",
    "kind": _KIND,
    "asks": _ASKS,
    "mark": "regexp_extract(rest, '#(.*)', 1)",
}
#: Rules by counting every combination of tokens of every labelled URL, where the query grows frequent ones alone.
URLS = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l AS ({" UNION ALL ".join(fits(*r) for r in url_rules.RULES)}),
f AS (SELECT r, max({{'size': length(rule), 'host': length(h), 'rule': rule, 'v': v}}) AS best FROM h JOIN l ON (host = l.h OR ends_with(host, '.' || l.h)) AND starts_with(path, l.p) GROUP BY r),
t AS (SELECT h.*, best.rule AS rule, best.v AS v, CASE WHEN host = '' THEN [] ELSE list_sort(list_filter([{", ".join(slot(k, x) for k, x in _SLOTS.items())}], lambda x: x IS NOT NULL)) END AS tokens
  FROM (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM h) h LEFT JOIN f ON h.r = f.r),
sub AS (SELECT v, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT v, tokens, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS m FROM t WHERE v IS NOT NULL) x),
g AS (SELECT s, v, count(*) AS n FROM sub GROUP BY s, v),
least AS (SELECT greatest({url_rules.FEWEST}, ceil({url_rules.SUPPORT}::DOUBLE * count(*))) AS least FROM t WHERE v IS NOT NULL),
rules AS (SELECT s, v, n, n::DOUBLE / freq AS c FROM (SELECT *, sum(n) OVER (PARTITION BY s) AS freq FROM g) x, least WHERE n >= least AND n::DOUBLE / freq >= {url_rules.CONFIDENCE}),
said AS (SELECT r, max({{'c': c, 'n': n, 'allows': rules.v = 'allow', 'v': rules.v}}).v AS v FROM t JOIN rules ON list_has_all(tokens, s) WHERE t.v IS NULL GROUP BY r)
SELECT page_id, host, path, rule, coalesce(t.v, said.v, 'allow') AS verdict FROM t LEFT JOIN said ON t.r = said.r
"""


def integers(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(CAST(x AS DOUBLE)) OR isinf(CAST(x AS DOUBLE)))) = 0"
#: Both lists of a pair of rows a and b.
SQUARED = "CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
#: floor(s / n) of whole numbers.
MEAN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def assignment(name: str, rows: str, book: str) -> str:
    """CTE with row r, part, the nearest entry b and squared distance d, by comparing all of them."""
    return f"{name} AS MATERIALIZED (SELECT r, a.part AS part, min({{'d': {SQUARED}, 'k': b.k}}) AS x FROM {rows} a JOIN {book} b ON a.part = b.part GROUP BY ALL)"


def moved(name: str, rows: str, book: str, assigned: str) -> str:
    """CTE with the entries of the next round: component by component the floor of the mean, or as they were."""
    return f"""{name} AS MATERIALIZED (SELECT b.part AS part, b.k AS k, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN (
    SELECT part, k, list({MEAN} ORDER BY pos) AS e FROM (
      SELECT part, k, pos, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM (
        SELECT a.part AS part, x.k AS k, unnest(a.e) AS v, unnest(range(1, len(a.e) + 1)) AS pos FROM {rows} a JOIN {assigned} y ON y.r = a.r AND y.part = a.part) z
      GROUP BY part, k, pos) w GROUP BY part, k) m ON m.part = b.part AND m.k = b.k)"""


def rounds(rows: str, book: str, n: int) -> str:
    """CTEs of n rounds: b0 is the book given, b{n} and a{n} are the final entries and assignment."""
    steps = [f"b0 AS MATERIALIZED ({book})", assignment("a0", rows, "b0")]
    for k in range(1, n + 1):
        steps += [moved(f"b{k}", rows, f"b{k - 1}", f"a{k - 1}"), assignment(f"a{k}", rows, f"b{k}")]
    return ",\n".join(steps)


def codes() -> str:
    parts, n = quantizer.PARTS, quantizer.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, e) AS r, * FROM (SELECT vec_id, label, {integers(quantizer.SCALE)} AS e FROM embeddings WHERE embedding IS NOT NULL AND {FINITE}) x),
p AS MATERIALIZED (SELECT r, part, list_slice(e, part * (len(e) // {parts}) + 1, (part + 1) * (len(e) // {parts})) AS e FROM v, range({parts}) AS t(part)),
{rounds("p", f"SELECT part, r - 1 AS k, e FROM p WHERE r <= {quantizer.ENTRIES}", n)},
c AS (SELECT r, string_agg(printf('%02x', x.k), '' ORDER BY part) AS code, CAST(sum(x.d) AS BIGINT) AS error FROM a{n} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM b{n})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c ON v.r = c.r, s
"""


def clusters() -> str:
    n = bitplanes.ROUNDS
    return f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{bitplanes.SEED}:' || vec_id), e) AS r, 0 AS part, * FROM (
  SELECT vec_id, {integers(bitplanes.SCALE)} AS e FROM embeddings WHERE len(embedding) = {bitplanes.SIZE} AND {FINITE}) x),
{rounds("p", f"SELECT part, r - 1 AS k, e FROM p WHERE r <= {bitplanes.CLUSTERS}", n)}
SELECT vec_id, CAST(x.k AS INTEGER) AS cluster, x.d AS distance, CAST(sum(x.d) OVER (PARTITION BY x.k) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(b.e, ',')) AS centroid_sha256 FROM a{n} a JOIN p ON a.r = p.r JOIN b{n} b ON a.x.k = b.k
"""


ORACLE_SQL = {
    "op1_exact_top_k": TOP_K,
    "op2_decontaminate": CONTAMINATION,
    "op10_secret_scan": SECRETS,
    "op11_url_filter": URLS,
    "op12_vector_codes": codes(),
    "op13_bitplane_clusters": clusters(),
}
