"""Entity operators over the driver tables, with their SQL counterparts.

Parts, customers and orders stand in for registry records: names are normalised, keys
resolved, records upserted, linked and looked up just as organisations and people are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rollcall.functions import dates, names, regions
from rollcall.operators import canonicalize, fk, stats, upsert
from rollcall.operators import search as lookups
from rollcall.plans.tables import table


def _literals(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _sql_values(values: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in values)


# -- views, counts ---------------------------------------------------------------------


def view_denormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nations = stats.denormalized(nation.select("id", F.col("name").alias("nation"), "n_regionkey"), [(region, "n_regionkey", "region")])
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    # 25 nations by construction.
    out = customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("id")).drop("id")
    return stats.denormalized(out, [], [(supplier, "c_custkey", "supplier")]).select("c_custkey", "c_name", "nation", "region", "supplier")


def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stats.counted(table(spark, sf_dir, "documents"), "source").select(F.lit("documents").alias("kind"), F.col("source").alias("name"), "n")
    events = stats.counted(table(spark, sf_dir, "events"), "event_type").select(F.lit("events").alias("kind"), F.col("event_type").alias("name"), "n")
    return docs.unionByName(events)


def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a two-level dimension, unknown values as the default."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region").where("r_regionkey < 4")
    simple = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("other")).alias("kind"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(simple), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("canon_id"))
    return stats.summary(orders)


def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey").distinct()


# -- writes and references ---------------------------------------------------------------


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    old, new = orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 3 = 0")
    keys = ["o_custkey", "o_orderpriority"]
    start = upsert.upsert(old.limit(0), old, keys, "o_orderkey")
    return upsert.upsert(start, new, keys, "o_orderkey")


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("name_normalized"), "p_brand", "p_partkey")
    return upsert.insert_ignore(parts.where("p_partkey < 100"), parts.where("p_partkey >= 100"), ["name_normalized", "p_brand"], "p_partkey")


def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "id long, name string, name_normalized string, source_id long")
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    made = upsert.get_or_create(empty, parts.where("p_name < 'm'"), "p_name", 4)
    return upsert.get_or_create(made, parts, "p_name", 4).select("id", "name_normalized")


def missing_fk_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.missing_keys(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0"), "o_custkey")


def fk_resolve_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1)).alias("nation_id"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_custkey", "c_nationkey")
    lookup = fk.unique_lookup(customer.where("c_custkey % 7 <> 0"), "c_custkey", "c_nationkey")
    kept = fk.resolve(orders, "o_custkey", lookup, "c_custkey", "c_nationkey", "nation_id")
    return fk.resolve(kept.withColumn("newer", F.col("nation_id")), "o_custkey", lookup, "c_custkey", "c_nationkey", "newer", keep_old=False).select("o_orderkey", "nation_id", "newer")


_TOKENS = [("widget", 1), ("ring", 2), ("red", 3), ("small", 4)]


def fk_first_resolvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    dim = _literals(spark, _TOKENS, "token string, role_id int")
    first = fk.first_resolvable(parts, "p_partkey", "tokens", dim, "token", "role_id", "role_id")
    every = fk.resolve_array(parts, "p_partkey", "tokens", dim, "token", "role_id", "role_ids")
    return first.join(every, "p_partkey").select("p_partkey", "role_id", F.array_join(F.col("role_ids").cast("array<string>"), ",").alias("role_ids"))


def reverse_mapping_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    mappings = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("m_custkey"), F.col("o_orderkey").alias("m_orderkey"))
    return fk.kth_to_kth(rows, "o_custkey", "o_orderkey", mappings, "m_custkey", "m_orderkey", ["m_orderkey"])


def reverse_mapping_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows, mappings = orders.where("o_orderstatus <> 'O'"), orders.where("o_orderstatus = 'O'")
    return fk.new_mappings(rows.select("o_custkey", "o_orderpriority"), mappings.select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


# -- linking -------------------------------------------------------------------------------


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as person records: the user as name, the property as organisation, a period from the time."""
    events = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    until = F.date_format(F.col("ts") + F.expr("make_dt_interval(0, 0, 0, value * 60)"), "yyyy-MM-dd")
    return events.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 50 == 0, F.floor(F.col("event_id") / 200)).alias("qid"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name_normalized"),
        F.get_json_object("props", "$.k").cast("long").alias("known_for_org_id"), F.when(F.col("event_id") % 3 == 0, day).alias("from_date"), until.alias("to_date"),
        F.expr("CASE event_type WHEN 'click' THEN 'wikidata' WHEN 'view' THEN 'sec_edgar' ELSE 'companies_house' END").alias("source"),
        F.when(F.col("event_id") % 4 == 0, "unknown").otherwise("executive").alias("person_type"), F.when(F.col("event_id") % 2 == 0, F.lit(1).cast("long")).alias("known_for_role_id"),
    )


def person_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize.canonicalize_people(_people(spark, sf_dir)).select("id", "canon_id", "canon_size")


def canon_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).withColumn("component", F.col("known_for_org_id"))
    return canonicalize.represented(rows, canonicalize.person_order(), size_on_all=True).select("id", "canon_id", "canon_size")


def _organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as organisation records; brand and size are the region, some share a ticker or a company number."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'gleif' WHEN 1 THEN 'sec_edgar' WHEN 2 THEN 'companies_house' ELSE 'wikidata' END").alias("source"),
        F.col("p_partkey").cast("string").alias("source_identifier"), F.col("p_name").alias("name"), names.normalize_company(F.col("p_name")).alias("name_normalized"),
        F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("region"),
        F.to_json(F.struct(F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit("t"), F.floor(F.col("p_partkey") / 120).cast("string"))).alias("ticker"), F.when(F.col("p_partkey") % 4 == 3, (F.col("p_partkey") - 2).cast("string")).alias("cik"))).alias("record"),
    )


def org_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize.canonicalize_organizations(_organizations(spark, sf_dir)).select("id", "canon_id", "canon_size")


def canon_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("canon_id"), F.lit(1).cast("long").alias("canon_size"))
    return canonicalize.refreshed_sizes(rows)


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize.match_counts(table(spark, sf_dir, "part"), F.struct("p_name", "p_brand"))


def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    dated = people.where("from_date IS NOT NULL")
    return canonicalize.grouped(dated, canonicalize.overlap_edges(dated)).select("id", "component")


def alias_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("name_normalized"), F.col("p_partkey").cast("string").alias("source_identifier"),
        F.lit(4).cast("long").alias("source_id"), F.lit(None).cast("long").alias("alias_source_id"), F.col("p_partkey").alias("canon_id"),
        F.to_json(F.struct(F.split(F.upper("p_name"), " ").alias("wikidata_aliases"), F.array(F.col("p_type")).alias("other_names"), F.col("p_brand").alias("ticker"))).alias("record"),
    )
    made = canonicalize.alias_rows(orgs, names.normalize_plain)
    return made.select("canon_id", "name_normalized")


def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("old"), F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("toxic")).alias("new"))
    return canonicalize.transitions(rows, "old", "new")


# -- lookups -------------------------------------------------------------------------------


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = canonicalize.canonicalize_organizations(_organizations(spark, sf_dir)).withColumn("alias_source_id", F.lit(None).cast("long"))
    queries = _literals(spark, [(1, "red widget"), (2, "small ring"), (3, "no such name")], "qid long, query string")
    found = lookups.name_lookup(orgs, queries)
    return found.select("qid", "canon_id", "canon_name", "canon_size", "score")


def role_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("name_normalized"))
    partial = lookups.role_search(roles, "Ring", 10).select(F.lit("ring").alias("query"), "id", "name", "score")
    return partial.union(lookups.role_search(roles, "red widget", 10).select(F.lit("red widget").alias("query"), "id", "name", "score"))


def location_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("location_type_id"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("simplified"))
    kept = lookups.location_search(nation, region, "nation_1", 5, "ASIA").select(F.lit("typed").alias("query"), "id", "name", "score")
    return kept.union(lookups.location_search(nation, region, "nation_1", 5).select(F.lit("any").alias("query"), "id", "name", "score"))


def levenshtein_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.round(names.levenshtein_ratio(F.col("p_name"), F.lit("red wedge")), 6).alias("ratio"), (F.col("p_retailprice") / 2000).alias("score"))
    order = [F.col("ratio").desc(), F.col("score").desc(), F.col("p_partkey")]
    ranked = rows.orderBy(*order).limit(20)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("p_partkey", "ratio", "rank")


def disambiguate_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.functions import vectors

    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name", F.col("p_size").alias("canon_size"))
    rows = e.join(parts, "vec_id").crossJoin(F.broadcast(q))  # one query
    sim = F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6)
    person = vectors.person_blend(sim, names.levenshtein_ratio(F.col("p_name"), F.lit("red ring")), F.col("canon_size"))
    org = vectors.org_blend(sim, F.col("p_name"), F.lit("red ring"), F.col("canon_size"))
    return rows.select("vec_id", F.round(person, 5).alias("person_score"), F.round(org, 5).alias("org_score"))


# -- scalar functions ----------------------------------------------------------------------

COMPANIES = [("Apple Inc.",), ("McDonald's Corp",), ("",), ("Ltd",), ("Acme Ltd",), ("Acme Limited",), ("Amazon.com, Inc.",), ("apple inc",), ("SEC",), ("Foo Co., Ltd.",), (None,)]
PERSONS = [("Dr. John Smith",), ("John Smith Jr.",), ("Prof. Jane Doe PhD",), ("Jane Doe",), ("",), ("Dr.",), ("Dr. Robert S. Mueller III",), ("Bob Jones",), ("J. K. Rowling",), (None,)]
REGIONS = [("US",), ("UK",), ("",), ("GBR",), ("USA",), ("CA",), ("NY",), ("California",), ("France",), ("nowhere",), (" germany ",), ("u.s.a.",)]
CODES = ("US", "", "GB", None, "FR", "DE")


def normalize_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _literals(spark, COMPANIES, "name string").union(table(spark, sf_dir, "part").select("p_name").distinct())
    return given.select("name", names.normalize_company(F.col("name")).alias("normalized"))


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _literals(spark, PERSONS, "name string").union(table(spark, sf_dir, "customer").select("c_name"))
    return given.select("name", names.normalize_person(F.col("name")).alias("normalized"))


def region_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with one of the spellings."""
    spelt = F.get(F.array(*[F.lit(x) for (x,) in REGIONS]), (F.col("c_custkey") % len(REGIONS)).cast("int"))
    return regions.with_region_code(table(spark, sf_dir, "customer").select("c_custkey", spelt.alias("region")), "region", "code")


def regions_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's customer and clerk in regions that the keys choose."""
    pick = lambda c: F.get(F.array(*[F.lit(x) for x in CODES]), (F.col(c) % len(CODES)).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pick("o_orderkey").alias("a"), pick("o_custkey").alias("b"))
    return rows.select("o_orderkey", "a", "b", regions.regions_match(F.col("a"), F.col("b")).cast("int").alias("same"))


def org_names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    return parts.select("p_name", names.org_names_match(F.col("p_name"), F.lit("Ring Inc.")).cast("int").alias("same"))


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in the sources' forms, some of them partial, before our era or missing."""
    day, k = lambda form: F.date_format("o_orderdate", form), F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(k == 0, None).when(k == 1, F.concat(F.lit("-0"), day("MMdd-MM-dd"), F.lit("T00:00:00Z"))).when(k == 2, F.concat(F.lit("+"), day("yyyy"), F.lit("-00-00T00:00:00Z"))).otherwise(F.concat(F.lit("+"), day("yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("entity"),
        F.when(k == 0, None).when(k == 1, day("yyyy")).when(k == 2, day("yyyy-MM-dd")).otherwise(F.concat(day("yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("binding"),
        F.when(k == 0, None).when(k == 1, day("yyyyMM")).when(k == 2, day("yyyy")).when(k == 3, "").otherwise(day("yyyyMMdd")).alias("compact"),
    )
    return rows.select(
        "o_orderkey",
        dates.entity_date(F.col("entity")).alias("entity_date"), dates.binding_date(F.col("binding")).alias("binding_date"), dates.compact_date(F.col("compact")).alias("compact_date"),
        dates.end_or_open(F.col("compact")).alias("until"), dates.inverted(dates.binding_date(F.col("binding"))).alias("inverted"), dates.filled(F.col("compact"), F.lit("1900")).alias("filled"),
    )


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


_CLASSES = [("click", "executive"), ("error", "politician"), ("view", "artist")]


def classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's type is that of their first event whose kind is mapped, else unknown."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    mapped = events.join(F.broadcast(_literals(spark, _CLASSES[:2], "event_type string, kind string")), "event_type")
    first = mapped.groupBy("user_id").agg(F.min_by("kind", "event_id").alias("kind"))
    return events.select("user_id").distinct().join(first, "user_id", "left").select("user_id", F.coalesce("kind", F.lit("unknown")).alias("kind"))


def embed_text_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'executive' WHEN 1 THEN 'government' WHEN 2 THEN 'artist' WHEN 3 THEN 'athlete' END")
    role, org = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", names.describe_person(F.col("p_name"), kind, F.lower(role), org).alias("text"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", names.entity_number(F.concat(F.lit("Q"), n)).alias("qid"), names.zero_filled(n).alias("cik"), names.without_zeros(names.zero_filled(n)).alias("bare"),
        names.uri_tail(F.concat(F.lit("http://x/entity/Q"), n)).alias("tail"), names.resolved_id(F.lit("sec_edgar"), n).alias("resolved"), names.cache_key(n, F.lit(None).cast("string")).alias("cache_key"),
    )


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    return parts.select("p_name", F.array_join(names.search_terms(F.col("p_name")), "|").alias("terms"))


def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _literals(spark, [("o'neil  de la-cruz",), ("JOHN   SMITH",), ("",)], "name string").union(table(spark, sf_dir, "part").select("p_name").distinct())
    return given.select("name", names.title_case(F.col("name")).alias("titled"))


def lite_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("record"))
    return upsert.without_records(events)


def migrate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 16).cast("long").alias("person_type_id"))
    return upsert.migrated(rows, 4)


QUERIES = {
    f.__name__: f
    for f in (
        view_denormalize, stats_by_source, stats_by_type, stats_summary, distinct_ids, upsert_replace, insert_ignore, get_or_create, missing_fk_discovery,
        fk_resolve_coalesce, fk_first_resolvable, reverse_mapping_kth, reverse_mapping_new, person_canonicalize, canon_representative, org_canonicalize,
        canon_size, match_counts, interval_islands, alias_explode, transition_counts, name_lookup, role_search, location_search, levenshtein_rerank,
        disambiguate_blend, normalize_company, normalize_name, region_normalize, regions_match, org_names_match, date_parse, json_fields,
        classify_first_match, embed_text_template, identifiers, search_terms, title_case, lite_copy, migrate_types,
    )
}
