"""Views, searches, index files and table jobs over the driver tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall import schema
from rollcall.functions import names
from rollcall.operators import canonicalize, jobs, search, vector_search, views
from rollcall.plans import entity_sql, vector_queries
from rollcall.plans.tables import table
from rollcall.stage import stage_root

STEP = vector_queries.QUERY_STEP


def _filled(spark: SparkSession, rows: DataFrame, fields: str) -> DataFrame:
    """``rows`` in a table's form, its other columns null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], fields).schema])


def _database(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nations as places, parts as organisations, brands as roles, customers as people."""
    nation, part, customer = (table(spark, sf_dir, t) for t in ("nation", "part", "customer"))
    text = lambda c: F.col(c).cast("string").alias("source_identifier")
    tables = schema.empty_database(spark)
    tables["locations"] = _filled(spark, nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 6).alias("source_id"), (F.col("n_regionkey") + 1).alias("location_type_id"), text("n_nationkey")), schema.LOCATIONS)
    tables["organizations"] = _filled(spark, part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 4 + 1).alias("source_id"), text("p_partkey"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 25).alias("region_id"),
        (F.col("p_partkey") % 30).alias("entity_type_id"), F.when(F.col("p_partkey") % 10 == 0, 2).alias("alias_source_id"), F.col("p_partkey").alias("canon_id"),
    ), schema.ORGANIZATIONS)
    tables["roles"] = _filled(spark, part.select((F.col("p_partkey") * 2).alias("id"), F.col("p_type").alias("name"), (F.col("p_partkey") % 9).alias("source_id"), text("p_partkey")), schema.ROLES)
    tables["people"] = _filled(spark, customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 4 + 1).alias("source_id"), text("c_custkey"), F.col("c_nationkey").alias("country_id"), (F.col("c_custkey") % 20).alias("person_type_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("known_for_role_id"), F.col("c_custkey").alias("known_for_org_id"),
    ), schema.PEOPLE)
    return tables


def organizations_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.organizations(_database(spark, sf_dir)).select("id", "name", "source", "region", "region_type", "entity_type", "alias_source")


def people_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.people(_database(spark, sf_dir)).select("id", "name", "source", "country", "person_type", "known_for_role", "known_for_org")


def roles_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.roles(_database(spark, sf_dir)).select("id", "name", "source", "source_identifier")


def locations_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.locations(_database(spark, sf_dir)).select("id", "name", "source", "location_type", "simplified_type")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_queries._index(spark, sf_dir).withColumnRenamed("label", "canon_id").withColumn("source", F.when(F.col("id") % 2 == 0, "gleif").otherwise("wikidata"))


def organization_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are no queries, searched by vector; weak matches give way to a name that only one alias has."""
    index = _index(spark, sf_dir)
    queries = index.where(F.col("id") % STEP == 0).select(F.col("id").alias("qid"), F.concat(F.lit("org "), (F.col("id") + 3 - F.col("id") % 3).cast("string")).alias("query"), F.col("v").alias("q"))
    orgs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("org "), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") - F.col("p_partkey") % 2 + 1).alias("canon_id"), F.lit(2).cast("long").alias("canon_size"),
        F.when(F.col("p_partkey") % 3 == 0, 5).cast("long").alias("alias_source_id"),
    )
    return search.organization_search(index.where(F.col("id") % STEP != 0), orgs, queries, 5, source="wikipedia").select("qid", F.col("canon_id").cast("long").alias("canon_id"), "score", "tier", "rank")


def person_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A near composite match settles a query, else people of the same name, else weaker matches."""
    index = _index(spark, sf_dir)
    half = F.col("id") % (2 * STEP) == 0
    named = F.concat(F.lit("Dr. Customer#"), F.lpad((F.col("id") + 1).cast("string"), 9, "0"))
    queries = index.where(F.col("id") % STEP == 0).select(F.col("id").alias("qid"), F.when(F.col("id") % (3 * STEP) == 0, named).otherwise("nobody at all").alias("query"), F.lit("").alias("description"), F.col("v").alias("q"), F.col("v").alias("iq"))
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), names.normalize_person(F.col("c_name")).alias("name_normalized"), F.col("c_custkey").alias("canon_id"), F.lit(3).cast("long").alias("canon_size"),
        F.lit(None).cast("long").alias("known_for_role_id"), F.lit(1).cast("long").alias("known_for_org_id"),
    )
    found = search.person_search(index.where(half | (F.col("id") % STEP != 0)), None, people, queries, 3)
    return found.select("qid", F.col("canon_id").cast("long").alias("canon_id"), "score", "rank", "lookup_method")


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written by shards; the hot shard's folder read and searched."""
    import uuid

    index = vector_queries._index(spark, sf_dir).withColumn("shard", F.when(F.col("id") < 300, 0).otherwise(1 + F.floor((F.col("id") - 300) / 400)).cast("int"))
    path = f"{stage_root(spark)}/rollcall-index-{uuid.uuid4().hex}"
    vector_search.write_index(index, path)
    written = spark.read.parquet(path)
    return vector_search.search(written.drop("label"), vector_queries._queries(written).select("qid", "q"), 3, F.col("shard") == 0).select("qid", "id", "score", "rank")


def person_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of people with a name, the member that tells most for each canonical group."""
    people = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("clerk "), (F.col("o_orderkey") % 40).cast("string")).alias("name_normalized"), F.floor(F.col("o_orderkey") / 400).alias("canon_id"), (F.col("o_orderkey") % 7).cast("long").alias("canon_size"),
        F.when(F.col("o_orderkey") % 3 == 0, 1).cast("long").alias("known_for_role_id"), F.when(F.col("o_orderkey") % 5 == 0, 1).cast("long").alias("known_for_org_id"),
    )
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("Mrs. Clerk "), F.col("n_nationkey").cast("string")).alias("query"))
    return search.person_name_lookup(people, asked).select("qid", "canon_id", "matched_id")


def normalized_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = jobs.normalize_people(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Prof. "), "c_name", F.lit(" PhD")).alias("name"))).withColumn("kind", F.lit("person"))
    orgs = jobs.normalize_organizations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" Co., Ltd.")).alias("name"))).withColumn("kind", F.lit("organization"))
    return people.unionByName(orgs).select("kind", "id", "name_normalized")


def populated_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases made anew from the records: old made ones go, others stay, sizes are counted again."""
    orgs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name_normalized"), F.col("p_partkey").cast("string").alias("source_identifier"),
        F.lit(4).cast("long").alias("source_id"), F.when(F.col("p_partkey") % 10 == 0, 5).when(F.col("p_partkey") % 10 == 1, 3).cast("long").alias("alias_source_id"), F.lit(None).cast("string").alias("alias_source_identifier"),
        F.col("p_partkey").alias("canon_id"), F.lit(9).cast("long").alias("canon_size"), F.to_json(F.struct(F.array(F.upper("p_brand"), F.lower("p_brand")).alias("wikidata_aliases"), F.col("p_type").alias("ticker"))).alias("record"),
    )
    return jobs.populate_aliases(orgs).select("source_identifier", "name_normalized", "alias_source_id", "canon_id", "canon_size")


QUERIES = {
    f.__name__: f
    for f in (organizations_view, people_view, roles_view, locations_view, organization_search, person_search, index_files, person_matches, normalized_tables, populated_aliases)
}


def _values(table_: dict[int, str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{name}')" for i, name in table_.items()) + ")"


_SIMPLE = {i: schema.SIMPLIFIED_LOCATION_TYPES[simple] for i, (_, _, simple) in schema.LOCATION_TYPES.items()}
_PAIRS = vector_queries._BASE
_PLAIN = "trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))"
ORACLE = {
    "organizations_view": f"""
SELECT p_partkey AS id, p_name AS name, s.name AS source, n_name AS region, t.name AS region_type, e.name AS entity_type, a.name AS alias_source
FROM part JOIN {_values(schema.SOURCE_TYPES)} s(id, name) ON s.id = p_partkey % 4 + 1 JOIN {_values(schema.ORGANIZATION_TYPES)} e(id, name) ON e.id = p_partkey % 30
LEFT JOIN {_values(schema.SOURCE_TYPES)} a(id, name) ON p_partkey % 10 = 0 AND a.id = 2 LEFT JOIN nation ON p_partkey % 3 > 0 AND n_nationkey = p_partkey % 25
LEFT JOIN {_values(_SIMPLE)} t(id, name) ON t.id = n_regionkey + 1""",
    "people_view": f"""
SELECT c_custkey AS id, c_name AS name, s.name AS source, n_name AS country, t.name AS person_type, r.p_type AS known_for_role, o.p_name AS known_for_org
FROM customer JOIN {_values(schema.SOURCE_TYPES)} s(id, name) ON s.id = c_custkey % 4 + 1 JOIN {_values(schema.PEOPLE_TYPES)} t(id, name) ON t.id = c_custkey % 20
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN part r ON c_custkey % 2 = 0 AND r.p_partkey * 2 = c_custkey LEFT JOIN part o ON o.p_partkey = c_custkey""",
    "roles_view": f"SELECT p_partkey * 2 AS id, p_type AS name, s.name AS source, p_partkey::VARCHAR AS source_identifier FROM part JOIN {_values(schema.SOURCE_TYPES)} s(id, name) ON s.id = p_partkey % 9",
    "locations_view": f"""
SELECT n_nationkey AS id, n_name AS name, s.name AS source, t.name AS location_type, x.name AS simplified_type FROM nation JOIN {_values(schema.SOURCE_TYPES)} s(id, name) ON s.id = n_nationkey % 6
JOIN {_values({i: name for i, (name, _, _) in schema.LOCATION_TYPES.items()})} t(id, name) ON t.id = n_regionkey + 1 JOIN {_values(_SIMPLE)} x(id, name) ON x.id = n_regionkey + 1""",
    "organization_search": _PAIRS % "q.id % 100 = 0 AND n.id % 100 <> 0 AND n.id % 2 = 1" + """,
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS nth FROM pairs) WHERE nth = 1),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM firsts) WHERE r <= 5),
named AS (SELECT n.qid, t.p_partkey - t.p_partkey % 2 + 1 AS canon_id FROM near n JOIN part t ON t.p_partkey = n.qid + 3 - n.qid % 3 JOIN part h ON h.p_partkey = t.p_partkey - t.p_partkey % 2 + 1 WHERE r = 1 AND score < 0.95),
both_kinds AS (SELECT qid, canon_id, 1.0::DOUBLE AS score, 0 AS tier FROM named UNION ALL SELECT qid, label, score, 1 FROM near),
once AS (SELECT *, row_number() OVER (PARTITION BY qid, canon_id ORDER BY tier, score DESC) AS nth FROM both_kinds)
SELECT qid, canon_id::BIGINT AS canon_id, score, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, canon_id)::INT AS rank FROM once WHERE nth = 1) WHERE rank <= 5""",
    "person_search": _PAIRS % "q.id % 100 = 0 AND (n.id % 200 = 0 OR n.id % 100 <> 0)" + """,
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS nth FROM pairs) WHERE nth = 1),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM firsts) WHERE rank <= 3),
settled AS (SELECT qid FROM near WHERE rank = 1 AND score > 0.95),
named AS (SELECT DISTINCT qid, c_custkey FROM near JOIN customer ON c_custkey = qid + 1 WHERE qid % 300 = 0 AND qid NOT IN (SELECT qid FROM settled))
SELECT qid, label::BIGINT AS canon_id, score, rank, 'composite' AS lookup_method FROM near WHERE qid NOT IN (SELECT qid FROM named)
UNION ALL SELECT qid, c_custkey, 1.0, 1, 'name' FROM named""",
    "index_files": _PAIRS % "q.id % 100 = 0" + vector_queries._top("id < 300", "qid, id, score, rank", 3),
    "person_matches": """
WITH p AS (SELECT o_orderkey AS id, o_orderkey % 40 AS k, o_orderkey // 400 AS canon_id, o_orderkey % 7 AS n, (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT AS told FROM orders),
h AS (SELECT n_nationkey AS qid, p.*, row_number() OVER (PARTITION BY n_nationkey ORDER BY n DESC, id) AS nth FROM nation JOIN p ON k = n_nationkey)
SELECT qid, canon_id, id AS matched_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, canon_id ORDER BY told DESC, nth) AS best FROM h WHERE nth <= 500) WHERE best = 1""",
    "normalized_tables": f"""
SELECT 'person' AS kind, c_custkey AS id, {entity_sql._person("'Prof. ' || c_name || ' PhD'")} AS name_normalized FROM customer
UNION ALL SELECT 'organization', p_partkey, {entity_sql._company("p_name || ' Co., Ltd.'")} FROM part""",
    "populated_aliases": f"""
WITH kept AS (SELECT p_partkey, 'part ' || p_partkey AS n, CASE WHEN p_partkey % 10 = 1 THEN 3 END AS via FROM part WHERE p_partkey % 10 <> 0),
made AS (SELECT p_partkey, {_PLAIN} AS n, 5 AS via FROM part WHERE p_partkey % 10 > 1
         UNION ALL SELECT p_partkey, {_PLAIN.replace('p_brand', 'p_type')}, 7 FROM part WHERE p_partkey % 10 > 1 AND {_PLAIN.replace('p_brand', 'p_type')} <> {_PLAIN}),
rows_ AS (SELECT *, true AS own FROM kept UNION ALL SELECT *, false FROM made)
SELECT p_partkey::VARCHAR AS source_identifier, n AS name_normalized, via::BIGINT AS alias_source_id, p_partkey AS canon_id,
       CASE WHEN own THEN count(*) OVER (PARTITION BY p_partkey) ELSE 1 END AS canon_size FROM rows_""",
}
