"""Source readers over the driver tables: records written in each source's form, parsed again, with their SQL counterparts.

The tables' rows are turned into lines, objects or documents as the registries publish them,
so the parsers see whole tables and their results follow from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.functions import names
from rollcall.operators import fk, jobs, upsert
from rollcall.plans.tables import table
from rollcall.sources import aliases, gleif, sec, uk, wikidata


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns)).alias("value")


def _mod(column: str, n: int, of: int = 0) -> Column:
    return F.col(column) % n == of


def _day(column: str, form: str = "yyyy-MM-dd") -> Column:
    return F.date_format(column, form)


# -- registries ------------------------------------------------------------------------


def gleif_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registry objects in two of its forms; some lack an identifier or are inactive."""
    key = F.col("c_custkey")
    entity = F.struct(
        F.struct(F.concat(F.lit(" "), F.col("c_name")).alias("name")).alias("legalName"), F.when(_mod("c_custkey", 5), "INACTIVE").otherwise("ACTIVE").alias("status"),
        F.when(_mod("c_custkey", 3), "FUND").when(_mod("c_custkey", 3, 1), "GENERAL").alias("category"), F.struct(F.col("c_nationkey").cast("string").alias("country")).alias("legalAddress"),
        F.array(F.struct(F.lower("c_name").alias("name"))).alias("otherNames"),
    )
    registration = F.struct(F.struct(F.lit("2012-01-02T00:00:00Z").alias("initialRegistrationDate")).alias("registration"), entity.alias("entity"))
    attributes = F.struct(*[registration[c].alias(c) for c in ("registration", "entity")]).alias("attributes")
    lei = F.when(~_mod("c_custkey", 7), F.concat(F.lit("L"), key.cast("string")))
    return table(spark, sf_dir, "customer").select(F.when(_mod("c_custkey", 2), _json(lei.alias("id"), attributes)).otherwise(_json(lei.alias("LEI"), attributes)).alias("value"))


def gleif_columns(found: DataFrame) -> DataFrame:
    return found.select("source_id", "name", "region", "entity_type", "from_date", F.get_json_object("record", "$.other_names[0]").alias("other_name"))


def gleif_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gleif_objects(spark, sf_dir).union(spark.createDataFrame([("not json",)], "value string"))
    return gleif_columns(gleif.parse_json(rows, active_only=True))


def submission_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as submissions, and their tickers from the ticker file."""
    c = table(spark, sf_dir, "customer")
    ticker = c.where(_mod("c_custkey", 4)).select(_json(F.struct(F.col("c_custkey").cast("string").alias("cik_str"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title")).alias("0")))
    rows = c.select(_json(
        F.col("c_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"), F.when(_mod("c_custkey", 3), "operating").otherwise("other").alias("entityType"),
        F.when(_mod("c_custkey", 5), "6722").when(_mod("c_custkey", 5, 1), "3571").otherwise("").alias("sic"),
        F.struct(F.struct(F.when(~_mod("c_custkey", 6), F.col("c_mktsegment")).alias("stateOrCountry")).alias("business")).alias("addresses"),
        F.struct(F.struct(F.array(F.lit("2024-01-01"), F.concat(F.lit("19"), (F.col("c_custkey") % 90 + 10).cast("string"), F.lit("-05-06"))).alias("filingDate")).alias("recent")).alias("filings"),
    ))
    return rows, sec.tickers(ticker)


def submission_columns(found: DataFrame) -> DataFrame:
    return found.select("source_id", "name", "region", "entity_type", "from_date", F.get_json_object("record", "$.ticker").alias("ticker"))


def sec_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission_columns(sec.parse_submissions(*submission_objects(spark, sf_dir)))


def sec_ticker_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(_json(F.struct(F.col("s_suppkey").cast("string").alias("cik_str"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title")).alias("0")))
    return sec.ticker_companies(rows).select("source_id", "name", "region", "entity_type")


def sec_form_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a quarterly index; only form 4 is kept."""
    form = F.when(_mod("o_orderkey", 3), "4").when(_mod("o_orderkey", 3, 1), "4/A").otherwise("8-K")
    path = F.concat(F.lit("edgar/data/1/0001-24-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".txt"))
    line = F.concat_ws("   ", F.concat(form, F.lit("         ")), F.concat(F.lit("CLERK  OF "), F.upper("o_orderpriority")), F.concat(F.lit("100"), F.lpad(F.col("o_custkey").cast("string"), 5, "0")), _day("o_orderdate"), path)
    return sec.parse_form_index(table(spark, sf_dir, "orders").select(line.alias("value"))).withColumn("accession", names.accession_number(F.concat(F.lit("/"), F.substring_index("file_path", "/", -1))))


def sec_insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as insiders' forms: the customer reports on the clerk's company."""
    flag = lambda n: F.when(_mod("o_orderkey", n), "1").otherwise("0")
    tag = lambda name, *inside: F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name}>"))
    text = lambda c: F.col(c).cast("string")
    title = F.when(_mod("o_orderkey", 9), "CFO").otherwise("")
    relation = tag("reportingOwnerRelationship", tag("isDirector", flag(2)), tag("isOfficer", flag(3)), tag("officerTitle", title), tag("isTenPercentOwner", flag(5)))
    owner = tag("reportingOwner", tag("reportingOwnerId", tag("rptOwnerCik", F.lpad(text("o_custkey"), 10, "0")), tag("rptOwnerName", F.concat(F.lit("OWNER "), text("o_orderstatus")))), relation)
    issuer = tag("issuer", tag("issuerCik", F.lpad(text("o_orderkey"), 10, "0")), tag("issuerName", F.concat(F.lit("Issuer "), text("o_orderpriority"))))
    form = F.concat(F.lit("head "), tag("ownershipDocument", issuer, tag("periodOfReport", _day("o_orderdate")), owner), F.lit(" tail"))
    found = sec.parse_insider_forms(table(spark, sf_dir, "orders").select(form.alias("value")))
    return found.select("source_id", "name", "known_for_role", "known_for_org_name", "from_date")


def uk_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of the bulk file, active ones only."""
    status = F.when(_mod("p_partkey", 3), "Active").when(_mod("p_partkey", 3, 1), "Open").otherwise("Dissolved")
    kind = F.when(_mod("p_partkey", 4), "Registered Society").when(_mod("p_partkey", 4, 1), "Private Limited Company").otherwise("Other company type")
    rows = table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("CompanyNumber"), F.when(~_mod("p_partkey", 11), F.col("p_name")).alias(" CompanyName"), status.alias("CompanyStatus"), kind.alias("CompanyCategory"),
        F.lit("01/02/2000").alias("IncorporationDate"), F.col("p_brand").alias("SICCode.SicText_1"),
    )
    found = uk.parse_companies(rows, active_only=True)
    return found.select("source_id", "name", "region", "entity_type", F.get_json_object("record", "$.sic_code").alias("sic_code"))


def officer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies' lines, their orders as the officers' lines after them; a file for each nation."""
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    heads = customers.select(F.col("c_nationkey").cast("string").alias("file"), F.struct("c_custkey", F.lit(0).cast("long").alias("n")).alias("at"), F.concat(F.rpad(F.concat(number, F.lit("1")), 40, " "), "c_name", F.lit("<")).alias("value"))
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    job = F.when(_mod("o_orderkey", 3), "SOLICITOR").when(_mod("o_orderkey", 3, 1), "ENGINEER").otherwise("")
    start = F.concat(number, F.lit("2   "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.when(_mod("o_orderkey", 7), "Y").otherwise(" "))
    line = F.concat(F.rpad(start, 32, " "), _day("o_orderdate", "yyyyMMdd"), F.when(_mod("o_orderkey", 4), "20200101").otherwise("        "), F.lit("AB1 2CD 197001          0000MR<JOHN<DOE"), "o_orderstatus", F.lit("<<<<<<<<<"), job, F.lit("<BRITISH<UK<"))
    officers = rows.select(F.col("c_nationkey").cast("string").alias("file"), F.struct("c_custkey", F.col("o_orderkey").cast("long").alias("n")).alias("at"), line.alias("value"))
    return heads.union(officers)


def officer_columns(found: DataFrame) -> DataFrame:
    return found.select("source_id", "name", "person_type", "known_for_org_name", "from_date", "to_date", "birth_date")


def uk_officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return officer_columns(uk.parse_officers(officer_lines(spark, sf_dir)))


# -- the knowledge base's dump ---------------------------------------------------------


def _claims(**properties: Column) -> Column:
    """A claims object; each property has an array of ids, or of null for none."""
    claim = lambda qid: F.struct(F.struct(F.struct(F.struct(qid.alias("id")).alias("value")).alias("datavalue")).alias("mainsnak"))
    return F.struct(*[F.transform(F.filter(ids, lambda x: x.isNotNull()), claim).alias(p) for p, ids in properties.items()]).alias("claims")


def _q(column: Column | str, add: int = 0) -> Column:
    return F.concat(F.lit("Q"), ((F.col(column) if isinstance(column, str) else column) + add).cast("long").cast("string"))


def _item(qid: Column, label: Column, claims: Column, *more: Column) -> Column:
    return F.concat(_json(F.lit("item").alias("type"), qid.alias("id"), F.struct(F.struct(label.alias("value")).alias("en")).alias("labels"), claims, *more), F.lit(","))


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as organisations, customers as people, nations as places, and a class below one that is stated.

    Ids: parts from 10 million on, customers from 20, nations from 30, regions from 31.
    """
    part, customer, nation = (table(spark, sf_dir, t) for t in ("part", "customer", "nation"))
    kind = F.when(_mod("p_partkey", 3), "Q783794").when(_mod("p_partkey", 3, 1), "Q90000001").otherwise("Q99999999")
    chief = F.when(_mod("p_partkey", 2), _q("p_partkey", 20_000_000))
    names_ = F.struct(F.array(F.struct(F.upper("p_name").alias("value")), F.struct(F.concat("p_name", F.lit(" works")).alias("value"))).alias("en")).alias("aliases")
    orgs = part.select(_item(_q("p_partkey", 10_000_000), F.col("p_name"), _claims(P31=F.array(kind), P17=F.array(_q(F.col("p_partkey") % 25, 30_000_000)), P1037=F.array(chief)), names_).alias("value"))
    office = F.when(_mod("c_custkey", 2), "Q484876")
    trade = F.when(_mod("c_custkey", 3), "Q36180")
    works = F.when(_mod("c_custkey", 5), _q("c_custkey", 10_000_000))
    people = customer.select(_item(_q("c_custkey", 20_000_000), F.col("c_name"), _claims(P31=F.array(F.lit("Q5")), P39=F.array(office), P106=F.array(trade), P108=F.array(works), P27=F.array(_q("c_nationkey", 30_000_000)))).alias("value"))
    places = nation.select(_item(_q("n_nationkey", 30_000_000), F.col("n_name"), _claims(P31=F.array(F.lit("Q515")), P131=F.array(_q("n_regionkey", 31_000_000)), P17=F.array(_q("n_regionkey", 31_000_000), _q("n_nationkey", 30_000_000)))).alias("value"))
    fixed = [
        ('{"type":"item","id":"Q90000001","labels":{"en":{"value":"kind of university"}},"claims":{"P279":[{"mainsnak":{"datavalue":{"value":{"id":"Q90000002"}}}}]}},',),
        ('{"type":"item","id":"Q90000002","labels":{},"claims":{"P279":[{"mainsnak":{"datavalue":{"value":{"id":"Q3918"}}}}]}},',), ("[",), ("{broken,",), ("]",), ('{"type":"property","id":"P1"},',),
    ]
    return wikidata.parse_dump(orgs.union(people).union(places).union(spark.createDataFrame(fixed, "value string")))


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _dump(spark, sf_dir)
    classes = wikidata.closure(wikidata.subclass_edges(items), wikidata.class_table(spark))
    return items, classes, wikidata.routed(items, classes)


def dump_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)[2].select("id", "route", "class_type")


def dump_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wikidata.organizations(_routed(spark, sf_dir)[2])
    field = lambda path, name: F.get_json_object("record", path).alias(name)
    return found.select("qid", "name", "entity_type", "country_qid", field("$.wikidata_aliases[0]", "alias"), field("$.executives[0].person_qid", "person_qid"), field("$.executives[0].role", "role"))


def dump_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by positions, by the organisations that name them, by occupations, or by an employer."""
    items, classes, rows = _routed(spark, sf_dir)
    orgs = wikidata.organizations(rows).withColumn("id", F.col("source_id"))
    reverse = fk.executives(orgs).withColumnRenamed("org_id", "org_qid")
    found = wikidata.person_rows(rows, classes, wikidata.jurisdictions(items.where("id = 'none'")), reverse)
    return found.select("id", "step", "role_qid", "org_qid", "role", "person_type", "country_qid")


def dump_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wikidata.locations(_routed(spark, sf_dir)[2])
    return found.select("qid", "name", "location_type", F.array_join("parent_qids", ",").alias("parent_qids"))


def dump_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pass's references, the stand-in for an employer, and the labels of the countries."""
    items = _dump(spark, sf_dir)
    keys = wikidata.foreign_keys(items).join(jobs.fallback_organization(items), F.col("qid") == F.col("id"))
    country = F.coalesce("country_qid", "citizenship_qid")
    rows = keys.select("qid", country.alias("country_qid"), F.array_join("occupation_qids", ",").alias("occupations"), F.array_join("parent_qids", ",").alias("parents"), "employer_qid", "org_qid")
    return wikidata.labels_for(rows, "country_qid", items).withColumnRenamed("label", "country")


def query_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as result rows of the query service, some without a label of their own, all of them twice."""
    value = lambda c, name: F.struct(c.alias("value")).alias(name)
    uri = F.concat(F.lit("http://www.wikidata.org/entity/"), _q("s_suppkey"))
    label = F.when(_mod("s_suppkey", 4), _q("s_suppkey")).otherwise(F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").select(_json(value(uri, "company"), value(label, "companyLabel"), value(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")), "ticker"), value(F.when(_mod("s_suppkey", 2), "1999").otherwise("2020-01-15T00:00:00Z"), "inception")))
    return wikidata.parse_bindings(rows.union(rows)).select("source_id", "name", "ticker", "from_date", "source")


# -- aliases and batch jobs ------------------------------------------------------------


def _orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as organisations, every tenth an alias of another source."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("qid"), F.col("p_name").alias("name"), F.lower("p_name").alias("name_normalized"), F.col("p_brand").alias("brand"),
        F.col("p_partkey").cast("string").alias("source_identifier"), (F.col("p_partkey") % 4).cast("long").alias("source_id"), F.when(_mod("p_partkey", 10), 5).cast("long").alias("alias_source_id"),
    )


def outside_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor texts by title and transliterated names by entity id, joined to organisations."""
    parts, orgs = table(spark, sf_dir, "part"), _orgs(spark, sf_dir)
    anchors = parts.select(F.concat(F.lit("maker "), "p_brand").alias("anchor_text"), F.regexp_replace(F.initcap("p_name"), " ", "_").alias("title"))
    named = parts.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("Maison "), "p_name").alias("name"))
    first = aliases.anchor_aliases(anchors, orgs).select(F.lit("anchor").alias("kind"), "org_id", "name_normalized")
    return first.unionByName(aliases.paraname_aliases(named, orgs).select(F.lit("paraname").alias("kind"), "org_id", "name_normalized"))


def role_org_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("source_id"), F.col("c_custkey").cast("string").alias("source_identifier"), F.when(_mod("c_custkey", 3), F.lit(7)).cast("long").alias("known_for_role_id"), F.lit(None).cast("long").alias("known_for_org_id"))
    changes = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("source_id"), F.col("o_custkey").cast("string").alias("source_identifier"), F.col("o_orderkey").cast("long").alias("role_id"), (F.col("o_orderkey") * 2).cast("long").alias("org_id"))
    return jobs.update_role_org(people, changes).select("c_custkey", "known_for_role_id", "known_for_org_id")


def reclassified_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers typed by the positions and occupations in their records."""
    record = _json(F.array_compact(F.array(F.when(_mod("c_custkey", 2), "Q484876"), F.when(_mod("c_custkey", 7), "Q99"))).alias("positions"), F.array_compact(F.array(F.when(_mod("c_custkey", 3), "Q937857"))).alias("occupations"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), record.alias("record"), F.lit("legal").alias("person_type"))
    return jobs.reclassify_people(people, wikidata.class_table(spark)).select("id", "new_type")


def located_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each organisation's country, by the dump's claims."""
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _q("p_partkey", 10_000_000).alias("source_identifier"), F.when(_mod("p_partkey", 3), F.lit(1)).cast("long").alias("region_id"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), _q("n_nationkey", 30_000_000).alias("source_identifier"))
    return jobs.backfill_locations(facts, _dump(spark, sf_dir), places).select("id", "region_id")


def stub_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that officers' records name but the table lacks; and officers' companies by normalised name."""
    orgs = _orgs(spark, sf_dir)
    people = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("company_number"), F.concat(F.lit("Co "), F.col("o_orderkey").cast("string")).alias("company_name"))
    made = fk.stub_organizations(orgs, people, F.col("company_number"), F.col("company_name"), 2)
    return made.select("id", "source_identifier", "name", "source_id")


def titles_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").select(F.lower("p_name").alias("title")).distinct()
    return fk.first_with_name(titles, "title", _orgs(spark, sf_dir)).select("title", "org_id")


def record_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample, which is the feature."""
    return wikidata.sample_of(table(spark, sf_dir, "customer"), "c_custkey", "seed 7", 40).select("c_custkey")


def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key set in JSON records, other keys kept."""
    rows = table(spark, sf_dir, "events").select("event_id", upsert.merged_json(F.col("props"), "seen", F.col("event_type")).alias("record"))
    return rows.select("event_id", F.get_json_object("record", "$.k").alias("k"), F.get_json_object("record", "$.seen").alias("seen"))


QUERIES = {
    f.__name__: f
    for f in (
        gleif_records, sec_submissions, sec_ticker_companies, sec_form_index, sec_insiders, uk_companies, uk_officers, dump_routes, dump_organizations, dump_people, dump_locations, dump_references,
        query_bindings, outside_aliases, role_org_update, reclassified_people, located_facts, stub_companies, titles_by_name, record_sample, record_keys,
    )
}

_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'business' WHEN 1 THEN 'educational' END"
ORACLE = {
    "gleif_records": """
SELECT 'L' || c_custkey AS source_id, c_name AS name, c_nationkey::VARCHAR AS region, CASE c_custkey % 3 WHEN 0 THEN 'fund' WHEN 1 THEN 'business' ELSE 'unknown' END AS entity_type,
       '2012-01-02' AS from_date, lower(c_name) AS other_name FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0""",
    "sec_submissions": """
SELECT lpad(c_custkey::VARCHAR, 10, '0') AS source_id, c_name AS name, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE 'US' END AS region, CASE WHEN c_custkey % 5 = 0 THEN 'fund' ELSE 'business' END AS entity_type,
       '19' || (c_custkey % 90 + 10) || '-05-06' AS from_date, CASE WHEN c_custkey % 4 = 0 THEN 'T' || c_custkey ELSE '' END AS ticker
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0 OR c_custkey % 5 IN (0, 1)""",
    "sec_ticker_companies": "SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS source_id, s_name AS name, 'US' AS region, 'unknown' AS entity_type FROM supplier",
    "sec_form_index": """
SELECT '4' AS form_type, 'CLERK OF ' || upper(o_orderpriority) AS company_name, '00100' || lpad(o_custkey::VARCHAR, 5, '0') AS cik, strftime(o_orderdate, '%Y-%m-%d') AS date_filed,
       'edgar/data/1/0001-24-' || lpad(o_orderkey::VARCHAR, 6, '0') || '.txt' AS file_path, '0001-24-' || lpad(o_orderkey::VARCHAR, 6, '0') AS accession FROM orders WHERE o_orderkey % 3 = 0""",
    "sec_insiders": """
SELECT o_custkey || '_' || o_orderkey AS source_id, 'Owner ' || o_orderstatus AS name, 'Issuer ' || o_orderpriority AS known_for_org_name, strftime(o_orderdate, '%Y-%m-%d') AS from_date,
       coalesce(nullif(concat_ws(', ', CASE WHEN o_orderkey % 2 = 0 THEN 'Director' END, CASE WHEN o_orderkey % 9 = 0 THEN 'CFO' WHEN o_orderkey % 3 = 0 THEN 'Officer' END), ''), 'Investor') AS known_for_role
FROM orders WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AND o_orderkey <> 0 AND o_custkey <> 0""",
    "uk_companies": """
SELECT lpad(p_partkey::VARCHAR, 8, '0') AS source_id, p_name AS name, 'United Kingdom' AS region, CASE p_partkey % 4 WHEN 0 THEN 'nonprofit' WHEN 1 THEN 'business' ELSE 'unknown' END AS entity_type, p_brand AS sic_code
FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 3 < 2""",
    "uk_officers": """
SELECT lpad(o_orderkey::VARCHAR, 12, '0') || '_' || lpad(c_custkey::VARCHAR, 8, '0') AS source_id, 'John Doe' || lower(o_orderstatus) AS name,
       CASE o_orderkey % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'professional' ELSE 'executive' END AS person_type, c_name AS known_for_org_name, strftime(o_orderdate, '%Y-%m-%d') AS from_date,
       CASE WHEN o_orderkey % 4 = 0 THEN '2020-01-01' END AS to_date, '1970-01' AS birth_date FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0""",
    "dump_routes": f"""
SELECT 'Q' || (p_partkey + 10000000) AS id, 'organization' AS route, {_KIND} AS class_type FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT 'Q' || (c_custkey + 20000000), 'person', 'person' FROM customer UNION ALL SELECT 'Q' || (n_nationkey + 30000000), 'location', 'city' FROM nation""",
    "dump_organizations": f"""
SELECT p_partkey + 10000000 AS qid, p_name AS name, {_KIND} AS entity_type, 'Q' || (p_partkey % 25 + 30000000) AS country_qid, p_name || ' works' AS alias,
       CASE WHEN p_partkey % 2 = 0 THEN 'Q' || (p_partkey + 20000000) END AS person_qid, CASE WHEN p_partkey % 2 = 0 THEN 'director/manager' END AS role FROM part WHERE p_partkey % 3 < 2""",
    "dump_people": """
WITH c AS (SELECT *, 'Q' || (c_custkey + 20000000) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Q' || (c_custkey + 10000000) END AS works,
                  CASE WHEN c_custkey % 2 = 0 THEN 'executive' WHEN c_custkey % 3 = 0 THEN 'artist' ELSE 'unknown' END AS person_type, 'Q' || (c_nationkey + 30000000) AS country_qid FROM customer),
r AS (SELECT p_partkey FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 2 = 0),
f AS (SELECT id, 1 AS step, 'Q484876' AS role_qid, NULL AS org_qid, NULL AS role, person_type, country_qid FROM c WHERE c_custkey % 2 = 0
      UNION ALL SELECT id, 2, NULL, 'Q' || (p_partkey + 10000000), 'director/manager', person_type, country_qid FROM c JOIN r ON p_partkey = c_custkey
      UNION ALL SELECT id, 3, 'Q36180', NULL, NULL, person_type, country_qid FROM c WHERE c_custkey % 3 = 0)
SELECT * FROM f UNION ALL SELECT id, 4, NULL, works, NULL, person_type, country_qid FROM c WHERE id NOT IN (SELECT id FROM f)""",
    "dump_locations": """
SELECT n_nationkey + 30000000 AS qid, n_name AS name, 'city' AS location_type, 'Q' || (n_regionkey + 31000000) || ',Q' || (n_nationkey + 30000000) AS parent_qids FROM nation""",
    "dump_references": """
WITH x AS (
  SELECT 'Q' || (p_partkey + 10000000) AS qid, 'Q' || (p_partkey % 25 + 30000000) AS country_qid, '' AS occupations, '' AS parents, NULL AS employer_qid FROM part
  UNION ALL SELECT 'Q' || (c_custkey + 20000000), 'Q' || (c_nationkey + 30000000), CASE WHEN c_custkey % 3 = 0 THEN 'Q36180' ELSE '' END, '', CASE WHEN c_custkey % 5 = 0 THEN 'Q' || (c_custkey + 10000000) END FROM customer
  UNION ALL SELECT 'Q' || (n_nationkey + 30000000), 'Q' || (n_regionkey + 31000000), '', 'Q' || (n_regionkey + 31000000), NULL FROM nation
  UNION ALL SELECT unnest(['Q90000001', 'Q90000002']), NULL, '', '', NULL)
SELECT x.*, employer_qid AS org_qid, coalesce(n_name, country_qid) AS country FROM x LEFT JOIN nation ON country_qid = 'Q' || (n_nationkey + 30000000)""",
    "query_bindings": """
SELECT 'Q' || s_suppkey AS source_id, s_name AS name, 'T' || s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN '1999-01-01' ELSE '2020-01-15' END AS from_date, 'wikidata' AS source FROM supplier WHERE s_suppkey % 4 <> 0""",
    "outside_aliases": """
WITH primary_orgs AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part WHERE p_partkey % 10 <> 0), firsts AS (SELECT n, min(id) AS org_id FROM primary_orgs GROUP BY n)
SELECT DISTINCT 'anchor' AS kind, org_id, 'maker ' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS name_normalized FROM part JOIN firsts ON n = lower(p_name)
UNION ALL SELECT 'paraname', p_partkey, 'maison ' || lower(p_name) FROM part WHERE p_partkey % 10 <> 0""",
    "role_org_update": """
WITH c AS (SELECT o_custkey, min(o_orderkey)::BIGINT AS m FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE m END::BIGINT AS known_for_role_id, (2 * m)::BIGINT AS known_for_org_id FROM customer LEFT JOIN c ON o_custkey = c_custkey""",
    "reclassified_people": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'executive' WHEN c_custkey % 3 = 0 THEN 'athlete' WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE 'legal' END AS new_type FROM customer""",
    "located_facts": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 25 END::BIGINT AS region_id FROM part",
    "stub_companies": """
WITH missing AS (SELECT DISTINCT o_orderkey::VARCHAR AS n FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 2))
SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY n) AS id, n AS source_identifier, 'Co ' || n AS name, 2::BIGINT AS source_id FROM missing""",
    "titles_by_name": "SELECT lower(p_name) AS title, min(p_partkey) AS org_id FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1",
    "record_sample": "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || 'seed 7') LIMIT 40",
    "record_keys": "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS seen FROM events",
}
