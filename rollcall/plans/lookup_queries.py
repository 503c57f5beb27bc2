"""Lookups and jobs over the driver tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.functions import names
from rollcall.operators import canonicalize, jobs, nearest, search, vector_search
from rollcall.plans import entity_queries, entity_sql, vector_queries
from rollcall.plans.tables import table


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("wanted"))
    return jobs.by_id(parts, wanted, "wanted")


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("source_identifier"), (F.col("o_orderkey") % 3).alias("source_id"), F.when(F.col("o_orderkey") % 2 == 0, 5).alias("alias_source_id"))
    primary = search.by_source(orgs, F.lit(1), F.lit("7")).select(F.lit("primary").alias("kind"), "id")
    return primary.union(jobs.person_by_source(orgs, F.lit(1), F.lit("7")).select(F.lit("person").alias("kind"), "id"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.page_after(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 100, 50, "c_custkey")


def update_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders")
    facts = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, day).alias("from_date"), F.when(F.col("o_orderkey") % 2 > 0, "").otherwise(day).alias("to_date"))
    changes = orders.where("o_orderstatus = 'O'").select("o_custkey", day.alias("from_date"), day.alias("to_date"))
    return jobs.update_dates(facts, changes, ["o_custkey"])


def canonical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its representative's name, by a self-join."""
    orgs = canonicalize.canonicalize_organizations(entity_queries._organizations(spark, sf_dir)).select("id", "name", "canon_id", "canon_size")
    heads = orgs.select(F.col("id").alias("canon_id"), F.col("name").alias("canon_name"))
    return orgs.join(heads, "canon_id").select("id", "canon_id", "canon_name")


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize.group_summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("canon_id")))


def merge_name_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name matches before vector matches, a group once."""
    found = vector_queries.vec_topk_canon(spark, sf_dir).select("qid", F.col("label").cast("long").alias("canon_id"), "score")
    named = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % vector_queries.QUERY_STEP == 0).select(F.col("vec_id").alias("qid"), F.col("label").cast("long").alias("canon_id"), F.lit(1.0).alias("score"))
    return search.merged(named, found, 4).select("qid", "canon_id", "score", "tier", "rank")


def resolve_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates above a threshold with resolved ids and confidence."""
    matches = vector_queries.vec_topk_int8(spark, sf_dir).withColumnRenamed("id", "canon_id")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("gleif").alias("source"), F.col("p_partkey").cast("string").alias("source_identifier"))
    return search.resolve_organizations(matches, parts, 0.3, 5)


def resolve_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to locations, by name or by country code."""
    nations = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    kind = F.when(F.col("n_nationkey") % 5 == 0, 19).otherwise(2).cast("long")  # every fifth is no country, so that its code finds nothing
    places = nations.select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.lower("n_name").alias("name_normalized"), code.alias("source_identifier"), kind.alias("location_type_id"))
    codes = nations.select(F.lower(F.concat(F.lit("code "), code)).alias("key"), code.alias("code"))
    own = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    spelt = F.when(F.col("c_custkey") % 3 == 0, own).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" Code N"), F.col("c_nationkey").cast("string"))).otherwise("nowhere")
    return search.resolve_regions(table(spark, sf_dir, "customer").select("c_custkey", spelt.alias("region")), "region", places, codes)


def person_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = canonicalize.canonicalize_people(entity_queries._people(spark, sf_dir))
    asked = spark.createDataFrame([(1, "Dr. User 3"), (2, "user 4 Jr."), (3, "nobody")], "qid long, query string")
    found = search.person_name_lookup(people, asked)
    return found.groupBy("qid").agg(F.countDistinct("canon_id").alias("groups"), F.min("canon_id").alias("first_group"))


def vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float cosine and exact top-k without quantisation."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = index.where(F.col("id") % vector_queries.QUERY_STEP == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    found = vector_search.sliced(queries, lambda part: vector_search.top_k(nearest.candidates(index, part, 5, places=5), 5))
    return found.select("qid", "id", "score", "rank")


KINDS = (
    "Private Limited Company", " charitable incorporated organisation ", "Scottish Charitable Incorporated Organisation", "PRI/LTD BY GUAR/NSC (Private, limited by guarantee)", "PRI/LBG/NSC (short)",
    "Royal Charter Company", "Other company type", "Community Interest Company", "Registered Society", "Limited Partnership", "Overseas Entity", "",
)
ROLES = ("Company Secretary", "Managing Director", "Architect", "Doctor", "Baker", "Chartered Accountant", "LEGAL COUNSEL", "Chief Engineer", "Consultant", "Vice President", "")


def classify_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered prefix and substring rules over every part, and the role text of an insider."""
    pick = lambda values, step: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("p_partkey") / step) % len(values)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(KINDS, 1), F.col("p_type")).alias("company"), F.concat_ws(" ", pick(ROLES, 1), "p_brand").alias("officer"), pick(ROLES, 1).alias("title"))
    flag = lambda n: F.col("p_partkey") % n == 0
    return rows.select(
        "p_partkey", names.uk_company_type(F.col("company")).alias("company_type"), names.officer_type(F.col("officer")).alias("officer_type"), names.insider_role(flag(2), flag(3), F.col("title"), flag(5)).alias("insider_role"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        point_lookup, source_lookup, keyset_page, update_dates, canonical_join, group_summary, merge_name_vector, resolve_with_candidates, resolve_regions, person_name_lookup, vec_cosine, classify_types,
    )
}

def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_BASE = vector_queries.ORACLE["vec_topk_canon"]
ORACLE = {
    "point_lookup": "SELECT p_partkey AS id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    "source_lookup": """
SELECT 'primary' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey = 7 AND o_orderkey % 2 <> 0
UNION ALL SELECT 'person', min(o_orderkey) FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey = 7 HAVING count(*) > 0""",
    "keyset_page": "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 50",
    "update_dates": """
WITH c AS (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS d FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE d END AS from_date,
       CASE WHEN o_orderkey % 2 > 0 THEN d ELSE strftime(o_orderdate, '%Y-%m-%d') END AS to_date FROM orders LEFT JOIN c USING (o_custkey)""",
    "canonical_join": f"{entity_sql._ORG_CANON} SELECT s.id, s.canon_id, h.name AS canon_name FROM sized s JOIN sized h ON h.id = s.canon_id",
    "group_summary": "SELECT count(*) AS groups, count_if(n > 1)::BIGINT AS multi_record_groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    "merge_name_vector": f"""
WITH found AS ({_BASE}), named AS (SELECT vec_id AS qid, label AS canon_id, 1.0::DOUBLE AS score, 0 AS tier FROM embeddings WHERE vec_id % 100 = 0),
both_kinds AS (SELECT * FROM named UNION ALL SELECT qid, label, score, 1 FROM found),
once AS (SELECT *, row_number() OVER (PARTITION BY qid, canon_id ORDER BY tier, score DESC) AS nth FROM both_kinds)
SELECT qid, canon_id::BIGINT AS canon_id, score, tier, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, canon_id)::INT AS rank FROM once WHERE nth = 1 QUALIFY rank <= 4""",
    "resolve_with_candidates": f"""
SELECT qid, rank, p_name AS canonical_name, 'LEI:' || p_partkey AS canonical_id, least(greatest(score, 0), 1) AS confidence
FROM ({vector_queries.ORACLE["vec_topk_int8"]}) JOIN part ON p_partkey = id WHERE score >= 0.3 AND rank <= 5""",
    "resolve_regions": """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN ' Code N' || c_nationkey ELSE 'nowhere' END AS region,
       CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_nationkey % 5 <> 0 THEN c_nationkey + 1 END::BIGINT AS location_id FROM customer""",
    "person_name_lookup": f"""
WITH RECURSIVE {entity_sql._PEOPLE}, {entity_sql._components(entity_sql._PERSON_EDGES, 'people')},
canon AS (SELECT p.id, name_normalized, first_value(p.id) OVER (PARTITION BY component ORDER BY {entity_sql._PERSON_ORDER.replace(' id', ' p.id')}) AS canon_id,
                 count(*) OVER (PARTITION BY component) AS n FROM people p JOIN comp USING (id)),
hits AS (SELECT qid, canon_id, row_number() OVER (PARTITION BY qid ORDER BY n DESC, id) AS nth FROM canon JOIN (VALUES (1, 'user 3'), (2, 'user 4')) v(qid, name_normalized) USING (name_normalized))
SELECT qid::BIGINT AS qid, count(DISTINCT canon_id) AS groups, min(canon_id) AS first_group FROM hits WHERE nth <= 500 GROUP BY qid""",
    "vec_cosine": """
WITH p AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
    / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM p QUALIFY rank <= 5""",
    "classify_types": f"""
WITH p AS (SELECT p_partkey, lower(trim({_list(KINDS)}[p_partkey % {len(KINDS)} + 1] || p_type)) AS k, {_list(ROLES)}[p_partkey % {len(ROLES)} + 1] AS title,
                  lower({_list(ROLES)}[p_partkey % {len(ROLES)} + 1] || ' ' || p_brand) AS o FROM part)
SELECT p_partkey,
       CASE WHEN regexp_matches(k, '^(charitable incorporated organisation|scottish charitable incorporated organisation|community interest company|pri/ltd by guar|pri/lbg/nsc|registered society)') THEN 'nonprofit'
            WHEN starts_with(k, 'other company type') THEN 'unknown' ELSE 'business' END AS company_type,
       CASE WHEN regexp_matches(o, 'director|ceo|cfo|cto|coo|chief|managing|president|chairman') THEN 'executive' WHEN regexp_matches(o, 'secretary|solicitor|lawyer|legal') THEN 'legal'
            WHEN regexp_matches(o, 'accountant|engineer|architect|doctor|consultant') THEN 'professional' ELSE 'executive' END AS officer_type,
       coalesce(nullif(concat_ws(', ', CASE WHEN p_partkey % 2 = 0 THEN 'Director' END, CASE WHEN p_partkey % 3 = 0 THEN coalesce(nullif(title, ''), 'Officer') END), ''),
                CASE WHEN p_partkey % 5 = 0 THEN 'Investor' ELSE 'Insider' END) AS insider_role FROM p""",
}
