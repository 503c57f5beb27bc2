"""Record writes, name lookups and counts over the driver tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall import schema
from rollcall.operators import canonicalize, search, stats, upsert
from rollcall.plans import entity_queries, entity_sql
from rollcall.plans.tables import table


def type_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of type names, some of them unknown."""
    part = table(spark, sf_dir, "part")
    name = lambda values, n: F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), (F.col("p_partkey") % n).cast("int"))
    places = {i: v[0] for i, v in schema.LOCATION_TYPES.items()}
    return part.select(
        "p_partkey", schema.source_id(name(schema.SOURCE_TYPES | {10: "wikipedia"}, 12)).alias("source_id"), schema.organization_type_id(name(schema.ORGANIZATION_TYPES, 30)).alias("organization_type"),
        schema.person_type_id(name(schema.PEOPLE_TYPES, 20)).alias("person_type"), schema.location_type_id(name(places, 40)).alias("location_type"),
    )


def location_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places, some with identifiers in either case; every seventh is in the table."""
    key = F.col("c_custkey")
    text = (key % 40).cast("string")
    places = table(spark, sf_dir, "customer").select(
        key.alias("seq"), F.concat(F.col("c_mktsegment"), F.lit("-"), (key % 50).cast("string")).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("S"), text)).when(key % 3 == 1, F.concat(F.lit("s"), text)).otherwise(F.when(key % 2 == 0, "")).alias("source_identifier"),
    )
    return upsert.insert_locations(places.where("seq % 700 = 0"), places.where("seq % 700 <> 0"), "seq")


def people_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as people's records: the last of a customer and role counts, and roles are made as they come."""
    tables = schema.empty_database(spark)
    roles = tables["roles"].unionByName(spark.createDataFrame([(7, "1-Urgent", "1-urgent", 1)], "id long, name string, name_normalized string, source_id long"), allowMissingColumns=True)
    key = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").cast("string").alias("source_identifier"), (key % 2 + 1).alias("source_id"), F.when(key % 10 != 0, F.concat(F.lit(" "), "o_orderpriority")).alias("known_for_role"),
        F.lit(None).cast("long").alias("known_for_role_id"), F.lit(None).cast("long").alias("known_for_org_id"), F.lit(None).cast("string").alias("from_date"),
    )
    people, _ = upsert.upsert_people(tables["people"], roles, records, "id")
    return people.select("id", "source_identifier", "source_id", "known_for_role_id")


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize.person_merges(entity_queries._people(spark, sf_dir))


def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the name of another one in upper case."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    asked = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.upper("name").alias("query"))
    return search.same_name(part, asked).select("qid", "p_partkey", "name")


def name_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample_rows(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"])


QUERIES = {f.__name__: f for f in (type_ids, location_inserts, people_upsert, merge_counts, same_names, name_sample)}

_AGAIN = entity_sql._components(entity_sql._PERSON_EDGES.rsplit(" UNION ", 1)[0], "people").replace("both_ways", "both_keyed").replace("reach", "reach_keyed").replace("comp AS", "comp_keyed AS")
ORACLE = {
    "type_ids": """
SELECT p_partkey, CASE WHEN p_partkey % 12 BETWEEN 1 AND 9 THEN p_partkey % 12 ELSE 4 END AS source_id, CASE WHEN p_partkey % 30 BETWEEN 1 AND 17 THEN p_partkey % 30 ELSE 17 END AS organization_type,
       CASE WHEN p_partkey % 20 IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15) THEN p_partkey % 20 ELSE 15 END AS person_type,
       CASE WHEN p_partkey % 40 BETWEEN 1 AND 36 THEN p_partkey % 40 ELSE 36 END AS location_type FROM part""",
    "location_inserts": """
WITH r AS (SELECT c_custkey AS seq, c_mktsegment || '-' || (c_custkey % 50) AS name,
                  CASE c_custkey % 3 WHEN 0 THEN 'S' || (c_custkey % 40) WHEN 1 THEN 's' || (c_custkey % 40) ELSE CASE WHEN c_custkey % 2 = 0 THEN '' END END AS source_identifier FROM customer),
k AS (SELECT *, nullif(lower(source_identifier), '') AS ident, lower(trim(name)) AS norm FROM r),
old AS (SELECT norm AS known FROM k WHERE seq % 700 = 0 UNION SELECT ident FROM k WHERE seq % 700 = 0 AND ident IS NOT NULL),
w AS (SELECT * FROM k WHERE seq % 700 <> 0 AND ident IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ident ORDER BY seq) = 1),
identified AS (SELECT * FROM w WHERE ident NOT IN (SELECT known FROM old)),
n AS (SELECT * FROM k WHERE seq % 700 <> 0 AND ident IS NULL QUALIFY row_number() OVER (PARTITION BY norm ORDER BY seq) = 1)
SELECT seq, name, source_identifier FROM identified
UNION ALL SELECT seq, name, source_identifier FROM n WHERE norm NOT IN (SELECT known FROM old) AND NOT EXISTS (SELECT 1 FROM identified i WHERE i.norm = n.norm AND i.seq < n.seq)""",
    "people_upsert": """
WITH r AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS source_identifier, o_orderkey % 2 + 1 AS source_id, CASE WHEN o_orderkey % 10 <> 0 THEN lower(o_orderpriority) END AS role FROM orders),
fresh AS (SELECT DISTINCT role, source_id FROM r WHERE role IS NOT NULL AND NOT (role = '1-urgent' AND source_id = 1)),
ids AS (SELECT role, source_id, 7 + row_number() OVER (ORDER BY role, source_id) AS role_id FROM fresh UNION ALL SELECT '1-urgent', 1, 7)
SELECT max(id) AS id, source_identifier, source_id, role_id AS known_for_role_id FROM r LEFT JOIN ids USING (role, source_id) GROUP BY 2, 3, 4""",
    "merge_counts": f"""
WITH RECURSIVE {entity_sql._PEOPLE}, {entity_sql._components(entity_sql._PERSON_EDGES, 'people')}, {_AGAIN}
SELECT 'qid' AS kind, coalesce(sum(n - 1), 0)::BIGINT AS merges FROM (SELECT count(*) AS n FROM people WHERE qid IS NOT NULL GROUP BY qid)
UNION ALL SELECT 'org', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM people WHERE org IS NOT NULL GROUP BY name_normalized, org)
UNION ALL SELECT 'date', (SELECT count(DISTINCT component) FROM comp_keyed) - (SELECT count(DISTINCT component) FROM comp)""",
    "same_names": "SELECT q.p_partkey AS qid, p.p_partkey, p.p_name AS name FROM part p JOIN part q ON q.p_partkey % 100 = 0 AND lower(p.p_name) = lower(q.p_name)",
    "name_sample": "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 20",
}
