"""SQL counterparts of the entity queries, for DuckDB over the same tables."""

from __future__ import annotations

from rollcall.functions.names import COMPANY_END, HONOUR_END, ID_PREFIXES, MIDDLE_INITIALS, NICKNAMES, TITLE_START
from rollcall.plans import entity_queries as q

_VALUES = q._sql_values


def _LIST(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"



def _company(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '{COMPANY_END}', '', 'g'))"


def _person(x: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({x}), '[.'']', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    bare = f"trim(regexp_replace(regexp_replace({plain}, '{TITLE_START}', '', 'g'), '{HONOUR_END}', '', 'g'))"
    bare = f"regexp_replace({bare}, '{MIDDLE_INITIALS}', '\\1 ', 'g')"
    nicknames = ", ".join(f"'{k}': '{v}'" for k, v in NICKNAMES.items())
    return f"coalesce(MAP {{{nicknames}}}[split_part({bare}, ' ', 1)], split_part({bare}, ' ', 1)) || substr({bare}, length(split_part({bare}, ' ', 1)) + 1)"


def _components(edges: str, nodes: str) -> str:
    """Least id that each node reaches, by a recursive query."""
    return f"""
both_ways AS (SELECT src AS a, dst AS b FROM ({edges}) UNION SELECT dst, src FROM ({edges})),
reach AS (SELECT id AS v, id AS r FROM {nodes} UNION SELECT b, r FROM reach JOIN both_ways ON a = v WHERE b > r),
comp AS (SELECT v AS id, min(r) AS component FROM reach GROUP BY v)"""


_PEOPLE = """
people AS (
  SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN event_id // 200 END AS qid, 'user ' || user_id AS name_normalized,
         json_extract_string(props, '$.k')::BIGINT AS org, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS from_date,
         strftime(ts + to_microseconds((value * 60 * 1000000)::BIGINT), '%Y-%m-%d') AS to_date,
         CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS prio, event_id % 4 = 0 AS unknown, event_id % 2 = 0 AS has_role
  FROM events)"""
_OVERLAP = """SELECT a.id AS src, b.id AS dst FROM people a JOIN people b ON a.name_normalized = b.name_normalized AND a.id < b.id
  AND a.from_date <= b.to_date AND b.from_date <= a.to_date AND a.from_date IS NOT NULL AND b.from_date IS NOT NULL"""
_PERSON_EDGES = f"""SELECT a.id AS src, b.id AS dst FROM people a JOIN people b ON a.qid = b.qid AND a.id < b.id
  UNION SELECT a.id, b.id FROM people a JOIN people b ON a.name_normalized = b.name_normalized AND a.org = b.org AND a.id < b.id UNION {_OVERLAP}"""
_PERSON_ORDER = """prio, unknown, NOT has_role, org IS NULL, coalesce(from_date, to_date, '') = '',
  translate(coalesce(from_date, to_date, ''), '0123456789', '9876543210'), id"""
_ORGS = f"""
orgs AS (
  SELECT p_partkey AS id, p_partkey % 4 AS prio, p_name AS name, {_company('p_name')} AS norm, p_brand || '-' || p_size AS region,
         CASE WHEN p_partkey % 40 = 0 THEN 'T' || (p_partkey // 120) END AS ticker,
         CASE p_partkey % 4 WHEN 1 THEN p_partkey WHEN 3 THEN p_partkey - 2 END AS cik FROM part)"""
_ORG_EDGES = """SELECT min(id) OVER (PARTITION BY norm, region) AS src, id AS dst FROM orgs WHERE norm <> ''
  UNION SELECT min(id) OVER (PARTITION BY ticker), id FROM orgs WHERE ticker IS NOT NULL
  UNION SELECT min(id) OVER (PARTITION BY cik), id FROM orgs WHERE cik IS NOT NULL"""
_ORG_CANON = f"""WITH RECURSIVE {_ORGS}, {_components(_ORG_EDGES, 'orgs')},
canon AS (SELECT o.id, o.name, first_value(o.id) OVER (PARTITION BY component ORDER BY prio, o.id) AS canon_id, count(*) OVER (PARTITION BY component) AS n
          FROM orgs o JOIN comp USING (id)),
sized AS (SELECT id, name, canon_id, CASE WHEN id = canon_id THEN n ELSE 1 END AS canon_size FROM canon)"""


def _article(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[aeiouAEIOU]') THEN 'an ' ELSE 'a ' END || {x}"


_FIRST_TOKENS = """
tokens AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
dim(token, role_id) AS (VALUES ('widget', 1), ('ring', 2), ('red', 3), ('small', 4)),
found AS (SELECT p_partkey, role_id, min(pos) AS pos FROM tokens JOIN dim USING (token) GROUP BY 1, 2)"""

_LEVENSHTEIN = "CASE WHEN lower({a}) = lower({b}) THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 1.0 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))::DOUBLE END"


def _ratio(a: str, b: str) -> str:
    return _LEVENSHTEIN.format(a=a, b=b)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_ROLE = "CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END"
_ORG = "CASE WHEN p_partkey % 3 > 0 THEN p_brand END"
_BINDING = "CASE WHEN regexp_matches(split_part(binding, 'T', 1), '^[0-9]{4}$') THEN split_part(binding, 'T', 1) || '-01-01' ELSE substr(split_part(binding, 'T', 1), 1, 10) END"

ORACLE = {
    "view_denormalize": """
SELECT c_custkey, c_name, n_name AS nation, r_name AS region, s_name AS supplier FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "stats_by_source": """
SELECT 'documents' AS kind, source AS name, count(*) AS n FROM documents GROUP BY source
UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY event_type""",
    "stats_by_type": """
SELECT coalesce(r_name, 'other') AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 4 GROUP BY 1""",
    "stats_summary": """
SELECT count(*) AS total, count(c) AS canonicalized, count(DISTINCT c) AS groups FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS c FROM orders)""",
    "distinct_ids": "SELECT DISTINCT o_custkey FROM orders",
    "upsert_replace": """
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderkey % 3 = 0) DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1""",
    "insert_ignore": """
WITH p AS (SELECT lower(trim(p_name)) AS name_normalized, p_brand, p_partkey FROM part)
SELECT name_normalized, p_brand, min(p_partkey) AS p_partkey FROM p WHERE p_partkey >= 100
  AND NOT EXISTS (SELECT 1 FROM p o WHERE o.p_partkey < 100 AND o.name_normalized = p.name_normalized AND o.p_brand = p.p_brand) GROUP BY 1, 2""",
    "get_or_create": """
SELECT row_number() OVER (ORDER BY p_name >= 'm', p_name) AS id, p_name AS name_normalized FROM (SELECT DISTINCT lower(trim(p_name)) AS p_name FROM part)""",
    "missing_fk_discovery": "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)",
    "fk_resolve_coalesce": """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN -1 END, c_nationkey) AS nation_id, coalesce(c_nationkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 END) AS newer
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0""",
    "fk_first_resolvable": f"""
WITH {_FIRST_TOKENS}
SELECT p_partkey, arg_min(role_id, pos) AS role_id, string_agg(role_id, ',' ORDER BY pos) AS role_ids FROM found GROUP BY p_partkey""",
    "reverse_mapping_kth": """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P'),
m AS (SELECT o_custkey, o_orderkey AS m_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
SELECT r.o_custkey, r.o_orderkey, m.m_orderkey FROM r LEFT JOIN m USING (o_custkey, k)""",
    "reverse_mapping_new": """
SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE o_orderstatus = 'O'
  AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus <> 'O' AND x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority)""",
    "person_canonicalize": f"""
WITH RECURSIVE {_PEOPLE}, {_components(_PERSON_EDGES, 'people')}
SELECT p.id, first_value(p.id) OVER (PARTITION BY component ORDER BY {_PERSON_ORDER.replace(' id', ' p.id')}) AS canon_id, count(*) OVER (PARTITION BY component) AS canon_size
FROM people p JOIN comp USING (id)""",
    "canon_representative": f"""
WITH {_PEOPLE}
SELECT id, first_value(id) OVER (PARTITION BY org ORDER BY {_PERSON_ORDER}) AS canon_id, count(*) OVER (PARTITION BY org) AS canon_size FROM people""",
    "org_canonicalize": f"{_ORG_CANON} SELECT id, canon_id, canon_size FROM sized",
    "canon_size": """
SELECT o.o_orderkey AS id, o.o_custkey AS canon_id, CASE WHEN o.o_orderkey = o.o_custkey THEN n ELSE 1 END AS canon_size
FROM orders o JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) c USING (o_custkey)""",
    "match_counts": "SELECT coalesce(sum(n - 1), 0)::BIGINT AS matches FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_brand)",
    "interval_islands": f"""
WITH RECURSIVE {_PEOPLE}, {_components(_OVERLAP, 'people')}
SELECT id, component FROM comp JOIN people USING (id) WHERE from_date IS NOT NULL""",
    "alias_explode": """
WITH p AS (SELECT p_partkey, lower(p_name) AS own, list_concat(string_split(upper(p_name), ' '), [p_type], [p_brand]) AS names FROM part),
x AS (SELECT p_partkey, own, lower(trim(unnest(names))) AS n FROM p)
SELECT DISTINCT p_partkey AS canon_id, n AS name_normalized FROM x WHERE n <> '' AND n <> own""",
    "transition_counts": """
SELECT old, new, count(*) AS n FROM (SELECT quality AS old, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE toxic END AS new FROM labels)
WHERE old IS DISTINCT FROM new GROUP BY 1, 2""",
    "name_lookup": f"""{_ORG_CANON},
hits AS (SELECT DISTINCT qid, s.canon_id FROM (VALUES (1, 'red widget'), (2, 'small ring'), (3, 'no such name')) v(qid, query) JOIN sized s ON s.name = query)
SELECT qid::BIGINT AS qid, canon_id, canon_name, canon_size, 1.0::DOUBLE AS score FROM (
  SELECT qid, c.id AS canon_id, c.name AS canon_name, c.canon_size, row_number() OVER (PARTITION BY qid ORDER BY c.canon_size DESC, c.id) AS nth
  FROM hits JOIN sized c ON c.id = hits.canon_id) WHERE nth = 1""",
    "role_search": """
SELECT 'ring' AS query, id, name, score FROM (SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) LIKE 'ring%' THEN 0.9 ELSE 0.7 END::DOUBLE AS score
  FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY length(p_name), p_partkey LIMIT 10)
UNION ALL SELECT 'red widget', min(p_partkey), 'red widget', 1.0 FROM part WHERE lower(p_name) = 'red widget'""",
    "location_search": """
SELECT * FROM (SELECT 'typed' AS query, n_nationkey AS id, n_name AS name, CASE WHEN lower(n_name) = 'nation_1' THEN 1.0 WHEN lower(n_name) LIKE 'nation\\_1%' ESCAPE '\\' THEN 0.9 ELSE 0.7 END::DOUBLE AS score
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND contains(lower(n_name), 'nation_1') ORDER BY length(n_name), n_nationkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'any', n_nationkey, n_name, CASE WHEN lower(n_name) = 'nation_1' THEN 1.0 ELSE 0.9 END FROM nation WHERE contains(lower(n_name), 'nation_1')
  ORDER BY length(n_name), n_nationkey LIMIT 5)""",
    "levenshtein_rerank": f"""
SELECT p_partkey, ratio, row_number() OVER (ORDER BY ratio DESC, p_retailprice / 2000 DESC, p_partkey)::INT AS rank
FROM (SELECT *, round({_ratio('p_name', "'red wedge'")}, 6) AS ratio FROM part) QUALIFY rank <= 20""",
    "disambiguate_blend": f"""
WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, p_name, p_size, round({_DOT.format(a='embedding', b='qe')} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='qe', b='qe')})), 6) AS sim
      FROM embeddings JOIN part ON vec_id = p_partkey, q)
SELECT vec_id, round(0.40 * sim + 0.45 * {_ratio('p_name', "'red ring'")} + 0.15 * least(ln(1 + p_size) / ln(51), 1), 5) AS person_score,
       round(0.7 * CASE WHEN sim > 0.95 AND length(p_name) <= 11 THEN 0 ELSE sim END + 0.3 * least(ln(p_size + 1) / ln(20), 1), 5) AS org_score FROM s""",
    "normalize_company": f"SELECT name, {_company('name')} AS normalized FROM (SELECT * FROM (VALUES {_VALUES(q.COMPANIES)}) v(name) UNION ALL SELECT DISTINCT p_name FROM part)",
    "normalize_name": f"SELECT name, {_person('name')} AS normalized FROM (SELECT * FROM (VALUES {_VALUES(q.PERSONS)}) v(name) UNION ALL SELECT c_name FROM customer)",
    "region_normalize": f"""
WITH g AS (SELECT c_custkey, {_LIST([x for (x,) in q.REGIONS])}[c_custkey % {len(q.REGIONS)} + 1] AS region FROM customer)
SELECT c_custkey, region, coalesce(MAP {{'us': 'US', 'uk': 'GB', 'gbr': 'GB', 'usa': 'US', 'ca': 'CA', 'ny': 'US', 'california': 'US', 'france': 'FR', 'germany': 'DE', 'u.s.a.': 'US'}}[lower(trim(region))], '') AS code FROM g""",
    "regions_match": f"""
WITH g AS (SELECT o_orderkey, {_LIST(q.CODES)}[o_orderkey % {len(q.CODES)} + 1] AS a, {_LIST(q.CODES)}[o_custkey % {len(q.CODES)} + 1] AS b FROM orders)
SELECT o_orderkey, a, b, (coalesce(a, '') = '' OR coalesce(b, '') = '' OR a = b)::INT AS same FROM g""",
    "org_names_match": f"""
SELECT p_name, (x = 'ring' OR (least(length(x), 4) >= 4 AND CASE WHEN length(x) <= 4 THEN contains('ring', x) ELSE contains(x, 'ring') END))::INT AS same
FROM (SELECT DISTINCT p_name, {_company('p_name')} AS x FROM part)""",
    "date_parse": f"""
WITH d AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '-0' || strftime(o_orderdate, '%m%d-%m-%d') || 'T00:00:00Z'
           WHEN 2 THEN '+' || strftime(o_orderdate, '%Y') || '-00-00T00:00:00Z' ELSE '+' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' END AS entity,
         CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' END AS binding,
         CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS compact
  FROM orders)
SELECT o_orderkey, split_part(regexp_replace(entity, '^\\+', ''), 'T', 1) AS entity_date, {_BINDING} AS binding_date,
       CASE WHEN regexp_matches(compact, '^[0-9]{{8}}$') THEN substr(compact, 1, 4) || '-' || substr(compact, 5, 2) || '-' || substr(compact, 7, 2)
            WHEN regexp_matches(compact, '^[0-9]{{6}}$') THEN substr(compact, 1, 4) || '-' || substr(compact, 5, 2) END AS compact_date,
       coalesce(nullif(compact, ''), '9999-12-31') AS until, translate(coalesce({_BINDING}, ''), '0123456789', '9876543210') AS inverted,
       CASE WHEN coalesce(compact, '') = '' THEN '1900' ELSE compact END AS filled
FROM d""",
    "json_fields": """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""",
    "classify_first_match": """
WITH f AS (SELECT user_id, arg_min(CASE event_type WHEN 'click' THEN 'executive' ELSE 'politician' END, event_id) AS kind FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
SELECT user_id, coalesce(kind, 'unknown') AS kind FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN f USING (user_id)""",
    "embed_text_template": f"""
WITH p AS (SELECT p_partkey, p_name AS name, p_partkey % 5 AS kind, {_ROLE} AS role, {_ORG} AS org FROM part),
t AS (SELECT *, CASE kind WHEN 0 THEN 'of' ELSE 'at' END AS prep, CASE kind WHEN 0 THEN 'executive' WHEN 1 THEN 'government official' WHEN 2 THEN 'artist' WHEN 3 THEN 'athlete' END AS label FROM p),
k AS (SELECT *, CASE WHEN role IS NOT NULL AND org IS NOT NULL THEN name || ', ' || {_article('role')} || ' ' || prep || ' ' || org
                     WHEN role IS NOT NULL THEN name || ', ' || {_article('role')} WHEN org IS NOT NULL THEN name || ' ' || prep || ' ' || org END AS known,
               name || ', ' || {_article('label')} AS labelled FROM t)
SELECT p_partkey, CASE WHEN kind IN (0, 1) THEN coalesce(known, labelled, name) WHEN kind IN (2, 3) THEN labelled ELSE coalesce(known, name) END AS text FROM k""",
    "identifiers": f"""
SELECT o_orderkey, o_orderkey AS qid, CASE WHEN length(o_orderkey::VARCHAR) >= 10 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 10, '0') END AS cik,
       ltrim(o_orderkey::VARCHAR, '0') AS bare, 'Q' || o_orderkey AS tail, '{ID_PREFIXES["sec_edgar"]}:' || o_orderkey AS resolved, sha256(o_orderkey::VARCHAR || chr(31)) AS cache_key FROM orders""",
    "search_terms": """
WITH w AS (SELECT p_name, string_split(p_name, ' ') AS ws FROM (SELECT DISTINCT p_name FROM part)),
t AS (SELECT p_name, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY length(w) DESC, i) AS nth FROM t WHERE n = 1 OR length(w) >= 3)
SELECT p_name, string_agg(w, '|' ORDER BY nth) AS terms FROM r WHERE nth <= 3 GROUP BY p_name""",
    "title_case": """
SELECT name, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled FROM (SELECT DISTINCT p_name AS name FROM part)
UNION ALL SELECT * FROM (VALUES ('o''neil  de la-cruz', 'O''Neil De La-Cruz'), ('JOHN   SMITH', 'John Smith'), ('', '')) v""",
    "lite_copy": "SELECT event_id, '{}' AS record FROM events",
    "migrate_types": "SELECT p_partkey, CASE p_size % 16 WHEN 14 THEN 7 WHEN 11 THEN 1 ELSE p_size % 16 END::BIGINT AS person_type_id FROM part",
}
