"""Misspelt names, texts within names, graph patterns and kept embeddings over the driver tables, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.functions import regions, vectors
from rollcall.operators import fuzzy, links, patterns, requests
from rollcall.operators.embedding_cache import EmbeddingCache
from rollcall.plans.source_queries import _claims, _item, _q
from rollcall.plans.tables import table
from rollcall.sources import wikidata
from rollcall.stage import stage_root, staged

TYPING = ("swapped", "dropped letter", "doubled letter", "other letter")


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_nationkey, key``: a nation's name with its region's before it."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.concat_ws(" ", F.lower("r_name"), F.lower("n_name")).alias("key"))


def misspelt_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's nation in four misspellings, back to the nation."""
    nations = _nation_names(spark, sf_dir)
    known = regions.region_table(spark, nations.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("alpha2"), F.lit(None).cast("string").alias("alpha3"), F.col("key").alias("name")))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("key").alias("name"))
    asked = fuzzy.perturbed(customers, "c_custkey", "name", TYPING)
    return regions.with_near_region_code(asked, "query", "code", known).select("id", "kind", "query", "code")


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, name_normalized`` of distinct names of parts."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    return named.groupBy("name").agg(F.min("p_partkey").alias("id")).select("id", "name", F.lower("name").alias("name_normalized"))


def contains_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of customers' names as requests, all in one pass; some blank, some found nowhere, some equal to a name."""
    customers = table(spark, sf_dir, "customer")
    rows = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("name_normalized"))
    text = F.when(F.col("c_custkey") % 7 == 0, " ").when(F.col("c_custkey") % 7 == 1, "Nobody").when(F.col("c_custkey") % 7 == 2, F.col("c_name")).when(F.col("c_custkey") % 7 == 3, F.substring("c_name", -2, 2))
    asked = customers.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("qid"), F.coalesce(text, F.upper(F.substring("c_name", -4, 4))).alias("query"))
    found = requests.roles(rows, asked, 5)
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


def accuracy_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a search finds the name that was changed, by kind of change."""
    known = _part_names(spark, sf_dir)
    asked = fuzzy.perturbed(known).withColumn("qid", F.concat_ws("|", "kind", F.col("id").cast("string")))
    asked = staged(asked, "asked")
    found = fuzzy.names_search(known, asked.select("qid", "query"), 10)
    counts = fuzzy.accuracy_by_kind(asked.select("qid", "kind", "id"), found, 10)
    return counts.select("kind", "queries", F.round("acc_at_1", 6).alias("acc_at_1"), F.round("acc_at_k", 6).alias("acc_at_k"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, customers as companies, suppliers as people, and four classes of occupations, as items of a dump."""
    site = lambda has: F.when(has, F.create_map(F.lit("enwiki"), F.lit("{}"))).alias("sitelinks")
    text = lambda prop, value: F.when(value.isNotNull(), F.array(F.struct(F.struct(F.struct(value.alias("value")).alias("datavalue")).alias("mainsnak")))).alias(prop)
    describe = lambda value: F.struct(F.struct(value.alias("value")).alias("en")).alias("descriptions")

    def items(*ids: Column) -> Column:
        return F.array(*ids)

    nations = table(spark, sf_dir, "nation").select(_item(_q("n_nationkey", 10_000), F.col("n_name"), _claims(P31=items(F.lit("Q6256")))).alias("value"))
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "Q891723").when(k % 4 == 1, "Q4830453").when(k % 4 == 2, "Q163740")
    base = _claims(P31=items(kind), P17=items(F.when(k % 3 > 0, _q("c_nationkey", 10_000))), P112=items(F.when(k % 5 == 0, _q(k % 50, 2_000_000))))
    more = F.struct(*[base[p].alias(p) for p in ("P31", "P17", "P112")], text("P1278", F.when(k % 6 == 0, F.concat(F.lit("LEI"), k.cast("string")))), text("P249", F.when(k % 2 == 0, F.concat(F.lit("T"), k.cast("string"))))).alias("claims")
    companies = c.select(_item(_q("c_custkey", 1_000_000), F.col("c_name"), more).alias("value"))
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    jobs = F.when(n % 4 == 0, "Q901").when(n % 4 == 1, "Q902").when(n % 4 == 2, "Q903").otherwise("Q904")
    post = F.when(n % 3 == 0, "Q484876").when(n % 3 == 1, "Q911")
    people = s.select(_item(_q("s_suppkey", 2_000_000), F.col("s_name"), _claims(P31=items(F.lit("Q5")), P106=items(jobs), P39=items(post), P27=items(F.when(n % 2 == 0, _q("s_nationkey", 10_000)))), site(n % 7 > 0), describe(F.col("s_name"))).alias("value"))
    classes = spark.createDataFrame([("Q902", "Q901", None), ("Q903", "Q902", None), ("Q901", "Q903", None), ("Q911", None, "Q484876")], "id string, above string, of string")
    known = classes.select(_item(F.col("id"), F.col("id"), _claims(P279=items(F.col("above")), P31=items(F.col("of")))).alias("value"))
    return staged(wikidata.parse_dump(nations.union(companies).union(people).union(known)), "entities")


def graph_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisation patterns and a position's, an occupation's and the founders', each in its rows; the last one page by page."""
    entities = _entities(spark, sf_dir)
    facts = patterns.triples(entities)
    out = None
    asked = patterns.ORGANIZATION_PATTERNS | {"position": patterns.position_pattern("Q484876"), "occupation": patterns.occupation_pattern("Q901", below=True), "founder": patterns.founder_pattern()}
    for name in ("lei", "public_company", "business", "nonprofit", "position", "occupation", "founder"):
        rows = patterns.matches(facts, entities, asked[name])
        ticker = F.col("ticker") if "ticker" in rows.columns else F.lit(None).cast("string")
        rows = rows.select(F.lit(name).alias("pattern"), "id", "label", "country_label", ticker.alias("ticker"))
        if name == "founder":
            first = staged(patterns.page(rows, None, 7), "page")
            last = first.agg(F.max("id")).first()[0]
            rows = first.union(patterns.page(rows, last, 1_000_000))
        out = rows if out is None else out.union(rows)
    return out


def kept_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of parts embedded in two batches, and once more from what is kept alone."""
    place = f"{stage_root(spark)}/rollcall-embeddings-{uuid.uuid4().hex}"
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    cache = EmbeddingCache(spark, place, vectors.HashedEmbedder(32), "hashed-32")
    cache.add(names.where("p_partkey % 3 = 0"), "name")
    first = staged(cache.embedded(names, ["name"]), "embedded")
    again = EmbeddingCache(spark, place, Refusing(), "hashed-32").embedded(first.withColumnRenamed("name_vector", "first"), ["name"])
    return again.select("p_partkey", "name", F.size("name_vector").alias("dims"), (F.col("name_vector") == F.col("first")).alias("same"))


class Refusing:
    """A model that must not be asked."""

    dims = 32

    def embed_batch(self, texts: list[str]):
        if texts:
            raise RuntimeError("a text was embedded again")


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies of two registers; every tenth is an alias."""
    k = F.col("c_custkey")
    source = F.when(k % 2 == 0, links.SOURCE_IDS["sec_edgar"]).otherwise(links.SOURCE_IDS["companies_house"]).cast("long")
    number = F.when(k % 2 == 0, F.lpad(k.cast("string"), 10, "0")).otherwise(k.cast("string"))
    return table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(k.alias("id"), F.col("c_name").alias("name"), source.alias("source_id"), number.alias("source_identifier"), F.when(k % 10 == 0, 5).cast("long").alias("alias_source_id"))


def _officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of insiders or officers, some linked before."""
    k = F.col("o_orderkey")
    source = F.when(k % 3 == 0, links.SOURCE_IDS["sec_edgar"]).otherwise(links.SOURCE_IDS["companies_house"]).cast("long")
    text = F.col("o_custkey").cast("string")
    record = F.when(k % 3 == 0, F.to_json(F.struct(text.alias("issuer_cik")))).when(k % 7 > 0, F.to_json(F.struct(text.alias("company_number"), F.concat(F.lit("Company "), text).alias("company_name"))))
    return table(spark, sf_dir, "orders").select(k.alias("id"), source.alias("source_id"), record.alias("record"), F.when(k % 5 == 0, 7).cast("long").alias("known_for_org_id"))


def issuer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insiders with their issuers."""
    return links.link_issuers(_officers(spark, sf_dir), _companies(spark, sf_dir)).select("id", "known_for_org_id")


def officer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officers with their companies by number, stubs made for those that the table lacks."""
    orgs, people = links.link_officers(_officers(spark, sf_dir), _companies(spark, sf_dir))
    named = orgs.select(F.col("id").alias("known_for_org_id"), F.col("name").alias("company"), "source_identifier")
    return people.join(named, "known_for_org_id", "left").select("id", "company", "source_identifier")


QUERIES = {f.__name__: f for f in (misspelt_regions, contains_lookup, accuracy_by_kind, graph_patterns, kept_embeddings, issuer_links, officer_links)}


def _changed(kind: str) -> str:
    """SQL of one kind of change of ``name`` for ``id``."""
    less = " - 1" if kind == "swapped" else ""
    at = f"((('0x' || substr(md5('{kind}:' || id), 1, 8))::BIGINT % greatest(length(name){less}, 1)) + 1)"
    return {
        "swapped": f"substr(name, 1, {at} - 1) || substr(name, {at} + 1, 1) || substr(name, {at}, 1) || substr(name, {at} + 2)",
        "dropped letter": f"substr(name, 1, {at} - 1) || substr(name, {at} + 1)",
        "doubled letter": f"substr(name, 1, {at}) || substr(name, {at})",
        "other letter": f"substr(name, 1, {at} - 1) || CASE substr(name, {at}, 1) WHEN 'x' THEN 'z' ELSE 'x' END || substr(name, {at} + 1)",
        "other case": "CASE WHEN upper(name) = name THEN lower(name) ELSE upper(name) END",
        "last word alone": "CASE WHEN contains(name, ' ') THEN regexp_extract(name, '[^ ]+$') END",
        "without last word": "CASE WHEN contains(name, ' ') THEN regexp_replace(name, ' [^ ]+$', '') END",
    }[kind]


def _perturbed(kinds: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT id, name, '{k}' AS kind, {_changed(k)} AS query FROM named" for k in kinds)
    return f"asked AS (SELECT * FROM ({rows}) WHERE length(name) > 1 AND query IS NOT NULL AND query <> '' AND query <> name)"


_ALLOWED = "CASE WHEN length({0}) <= 3 THEN 0 WHEN length({0}) <= 7 THEN 1 WHEN length({0}) <= 60 THEN 2 ELSE 0 END"
_SCORE = "CASE WHEN lower(trim(query)) = lower(name) THEN 1.0 WHEN starts_with(lower(name), lower(trim(query))) THEN 0.9 ELSE 0.7 END"

ORACLE = {
    "misspelt_regions": f"""
WITH nations AS (SELECT n_nationkey, lower(r_name) || ' ' || lower(n_name) AS key, 'N' || lpad(n_nationkey::VARCHAR, 3, '0') AS code FROM nation JOIN region ON n_regionkey = r_regionkey),
named AS (SELECT c_custkey AS id, key AS name FROM customer JOIN nations ON c_nationkey = n_nationkey),
{_perturbed(TYPING)},
near AS (SELECT q.query, arg_min(code, (damerau_levenshtein(q.query, key), code)) AS code FROM (SELECT DISTINCT query FROM asked) q JOIN nations ON damerau_levenshtein(q.query, key) <= {_ALLOWED.format('q.query')} GROUP BY 1)
SELECT id, kind, query, coalesce(code, '') AS code FROM asked LEFT JOIN near USING (query)""",
    "contains_lookup": f"""
WITH asked AS (SELECT c_custkey AS qid, CASE c_custkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'Nobody' WHEN 2 THEN c_name WHEN 3 THEN right(c_name, 2) ELSE upper(right(c_name, 4)) END AS query FROM customer WHERE c_custkey % 10 = 0),
found AS (SELECT qid, query, c_custkey AS id, c_name AS name, lower(c_name) = lower(trim(query)) AS same FROM asked JOIN customer ON trim(query) <> '' AND lower(c_name) LIKE '%' || lower(trim(query)) || '%'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY same DESC, length(name), id)::INT AS rank, max(same) OVER (PARTITION BY qid) AS any_same FROM found)
SELECT qid, id, rank, round(({_SCORE})::DOUBLE, 6) AS score FROM ranked WHERE rank <= 5 AND (NOT any_same OR rank = 1)""",
    "accuracy_by_kind": f"""
WITH named AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part GROUP BY 2),
{_perturbed(fuzzy.KINDS[:-1])},
inside AS (SELECT a.kind, a.id AS qid, n.id, lower(n.name) = lower(trim(query)) AS same, length(n.name) AS len FROM asked a JOIN named n ON contains(lower(n.name), lower(trim(query)))),
held AS (SELECT kind, qid, id, row_number() OVER (PARTITION BY kind, qid ORDER BY same DESC, len, id) AS rank, max(same) OVER (PARTITION BY kind, qid) AS any_same FROM inside),
kept AS (SELECT kind, qid, id, rank FROM held WHERE rank <= 10 AND (NOT any_same OR rank = 1)),
left_over AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.kind = a.kind AND k.qid = a.id)),
known AS (SELECT lower(name) AS key, min(id) AS id FROM named GROUP BY 1),
near AS (SELECT t.text, arg_min(k.id, (damerau_levenshtein(t.text, key), k.id)) AS id FROM (SELECT DISTINCT lower(trim(query)) AS text FROM left_over) t JOIN known k ON abs(length(t.text) - length(key)) <= 2 AND levenshtein(t.text, key) <= 2 AND damerau_levenshtein(t.text, key) <= {_ALLOWED.format('t.text')} GROUP BY 1),
found AS (SELECT kind, qid, id, rank FROM kept UNION ALL SELECT kind, l.id, near.id, 1 FROM left_over l JOIN near ON text = lower(trim(query))),
best AS (SELECT a.kind, a.id, min(CASE WHEN f.id = a.id THEN rank END) AS place FROM asked a LEFT JOIN found f ON f.kind = a.kind AND f.qid = a.id GROUP BY 1, 2)
SELECT kind, count(*) AS queries, round(avg((coalesce(place, 99) = 1)::INT), 6) AS acc_at_1, round(avg((coalesce(place, 99) <= 10)::INT), 6) AS acc_at_k FROM best GROUP BY 1""",
    "graph_patterns": """
WITH company AS (SELECT c_custkey AS k, 'Q' || (c_custkey + 1000000) AS id, c_name AS label, CASE WHEN c_custkey % 3 > 0 THEN 'NATION_' || c_nationkey END AS country_label, CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey END AS ticker FROM customer),
person AS (SELECT s_suppkey AS k, 'Q' || (s_suppkey + 2000000) AS id, s_name AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'NATION_' || s_nationkey END AS country_label, NULL AS ticker FROM supplier WHERE s_suppkey % 7 > 0)
SELECT 'lei' AS pattern, id, label, country_label, ticker FROM company WHERE k % 6 = 0
UNION ALL SELECT CASE k % 4 WHEN 0 THEN 'public_company' WHEN 1 THEN 'business' ELSE 'nonprofit' END, id, label, country_label, ticker FROM company WHERE k % 4 < 3
UNION ALL SELECT 'position', id, label, country_label, ticker FROM person WHERE k % 3 < 2
UNION ALL SELECT 'occupation', id, label, country_label, ticker FROM person WHERE k % 4 < 3
UNION ALL SELECT 'founder', id, label, country_label, ticker FROM person WHERE k IN (SELECT c_custkey % 50 FROM customer WHERE c_custkey % 5 = 0)""",
    "issuer_links": """
SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 3 > 0 AND o_custkey % 2 = 0 AND o_custkey % 10 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END,
                                  CASE WHEN o_orderkey % 5 = 0 THEN 7 END)::BIGINT AS known_for_org_id FROM orders""",
    "officer_links": """
WITH orgs AS (SELECT c_custkey AS id, c_name AS company, CASE WHEN c_custkey % 2 = 0 THEN lpad(c_custkey::VARCHAR, 10, '0') ELSE c_custkey::VARCHAR END AS source_identifier FROM customer WHERE c_custkey % 3 > 0),
p AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % 5 = 0 AS linked, o_orderkey % 3 <> 0 AND o_orderkey % 7 > 0 AND o_orderkey % 5 <> 0 AS own FROM orders)
SELECT p.id, CASE WHEN linked THEN o7.company WHEN own THEN coalesce(o.company, 'Company ' || o_custkey) END AS company,
       CASE WHEN linked THEN o7.source_identifier WHEN own THEN o_custkey::VARCHAR END AS source_identifier
FROM p LEFT JOIN orgs o ON o.source_identifier = o_custkey::VARCHAR AND o.id % 2 = 1 LEFT JOIN orgs o7 ON o7.id = 7""",
    "kept_embeddings": "SELECT p_partkey, p_name || ' ' || p_brand AS name, 32 AS dims, true AS same FROM part",
}
