"""Knowledge-base dumps: one entity a line, routed to roles, people, organisations and locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rollcall.functions import dates, names
from rollcall.sources.classes import class_rows
from rollcall.stage import drop_stage, staged

CLAIMS = "map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>,qualifiers:map<string,array<struct<datavalue:struct<value:string>>>>>>>"
ENTITY = (
    "type string, id string, labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, "
    f"sitelinks map<string,string>, claims {CLAIMS}"
)
# Properties that name executives, and the order in which others stand in for an employer.
EXECUTIVE_PROPERTIES = {"P169": "chief executive officer", "P488": "chairperson", "P112": "founded by", "P1037": "director/manager", "P3320": "board member"}
FALLBACK_PROPERTIES = ("P108", "P1830", "P54", "P102", "P241", "P264", "P1416", "P463", "P69")


def class_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The classes that route and type items; ``path`` is a file of further ones, such as occupations."""
    return class_rows(spark, path)


def parse_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """Items of dump lines; brackets, trailing commas and lines that don't parse are skipped."""
    text = F.regexp_replace(F.trim(column), ",$", "")
    rows = lines.select(text.alias("text")).where(F.startswith(text, F.lit("{")))
    return rows.select(F.from_json("text", ENTITY, {"mode": "PERMISSIVE"}).alias("x")).select("x.*").where("type = 'item' AND id IS NOT NULL")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump file, plain or compressed; bzip2 files are split between tasks."""
    return parse_dump(spark.read.text(path))


def claim_values(prop: str, claims: str | Column = "claims") -> Column:
    """Ids that a property's claims have, in order."""
    listed = F.try_element_at(F.col(claims) if isinstance(claims, str) else claims, F.lit(prop))
    ids = F.transform(F.coalesce(listed, F.array().cast("array<struct<mainsnak:struct<datavalue:struct<value:string>>,qualifiers:map<string,array<struct<datavalue:struct<value:string>>>>>>")), lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id"))
    return F.filter(ids, lambda x: x.isNotNull())


def first_claim(prop: str) -> Column:
    return F.get(claim_values(prop), F.lit(0))


def claim_time(prop: str) -> Column:
    value = F.get(F.try_element_at("claims", F.lit(prop)), F.lit(0))["mainsnak"]["datavalue"]["value"]
    return dates.entity_date(F.get_json_object(value, "$.time"))


def claim_text(prop: str) -> Column:
    return F.get(F.try_element_at("claims", F.lit(prop)), F.lit(0))["mainsnak"]["datavalue"]["value"]


def qualifier(claim: Column, prop: str, path: str = "$.id") -> Column:
    return F.get_json_object(F.get(F.try_element_at(claim["qualifiers"], F.lit(prop)), F.lit(0))["datavalue"]["value"], path)


def label() -> Column:
    """The English label, else any."""
    others = F.filter(F.map_values("labels"), lambda x: x["value"] != "")
    return F.coalesce(F.nullif(F.try_element_at("labels", F.lit("en"))["value"], F.lit("")), F.get(others, F.lit(0))["value"])


def closure(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with those below them: a subclass takes the type of its nearest classified ancestor.

    ``edges`` has ``child, parent``.  Each round goes down one level, until a level has no new
    class; types that a class has already are kept.
    """
    edges = staged(edges.select("child", "parent"), "subclasses")
    known = level = classes
    while True:
        seen = known.select(F.col("qid").alias("__qid"), F.col("kind").alias("__kind"))
        below = edges.join(level.withColumnRenamed("qid", "parent"), "parent").select(F.col("child").alias("qid"), "kind", "type")
        fresh = below.join(seen, (F.col("qid") == F.col("__qid")) & F.col("kind").eqNullSafe(F.col("__kind")), "left_anti").groupBy("qid", "kind").agg(F.min("type").alias("type"))
        level = staged(fresh, "classes")
        if not level.take(1):
            drop_stage(edges, level)
            return known
        known = known.unionByName(level)


def subclass_edges(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("child"), F.explode(claim_values("P279")).alias("parent"))


def routed(entities: DataFrame, classes: DataFrame, require_article: bool = False) -> DataFrame:
    """Items with ``route`` (role, person, organization, location) and ``class_type``, first match in that order.

    The type is that of the first claimed class that is known.
    """
    kinds = entities.select(F.col("id").alias("__id"), F.posexplode(claim_values("P31")).alias("at", "qid"))
    order = F.expr("CASE kind WHEN 'role' THEN 0 WHEN 'organization' THEN 2 WHEN 'location' THEN 3 END")
    known = kinds.join(classes.where("kind IN ('role', 'organization', 'location')"), "qid").select("__id", order.alias("order"), "at", "kind", "type")
    human = kinds.where("qid = 'Q5'").select("__id", F.lit(1).alias("order"), "at", F.lit("person").alias("kind"), F.lit("person").alias("type"))
    first = known.unionByName(human).groupBy("__id").agg(F.min(F.struct("order", "at", "kind", "type")).alias("m"))
    rows = entities.join(first, F.col("id") == F.col("__id")).select(*entities.columns, F.col("m.kind").alias("route"), F.col("m.type").alias("class_type"))
    return rows.where(F.map_contains_key("sitelinks", F.lit("enwiki"))) if require_article else rows


def organizations(rows: DataFrame) -> DataFrame:
    """Organisation records of routed items, with aliases and executives in the record."""
    own = rows.where("route = 'organization'").withColumn("label", label()).where("label IS NOT NULL")
    aliases = F.filter(F.transform(F.try_element_at("aliases", F.lit("en")), lambda a: a["value"]), lambda a: F.lower(a) != F.lower("label"))
    record = F.to_json(F.struct(
        F.col("id").alias("wikidata_id"), "label", F.try_element_at("descriptions", F.lit("en"))["value"].alias("description"), claim_text("P1278").alias("lei"), claim_text("P249").alias("ticker"),
        first_claim("P17").alias("country_qid"), aliases.alias("wikidata_aliases"), _executives().alias("executives"),
    ))
    return own.select(
        F.col("label").alias("name"), F.lit("wikidata").alias("source"), F.col("id").alias("source_id"), names.entity_number(F.col("id")).alias("qid"), F.col("class_type").alias("entity_type"),
        claim_time("P571").alias("from_date"), claim_time("P576").alias("to_date"), first_claim("P17").alias("country_qid"), record.alias("record"),
    )


def _executives() -> Column:
    none = F.array().cast("array<struct<person_qid:string,role:string,start_date:string,end_date:string>>")

    def of(prop: str, role: str) -> Column:
        found = F.transform(
            F.try_element_at("claims", F.lit(prop)),
            lambda c: F.struct(
                F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id").alias("person_qid"), F.lit(role).alias("role"), dates.entity_date(qualifier(c, "P580", "$.time")).alias("start_date"),
                dates.entity_date(qualifier(c, "P582", "$.time")).alias("end_date"),
            ),
        )
        return F.coalesce(F.filter(found, lambda x: x["person_qid"].isNotNull()), none)

    return F.concat(*[of(p, r) for p, r in EXECUTIVE_PROPERTIES.items()])


def person_rows(rows: DataFrame, classes: DataFrame, jurisdictions: DataFrame, reverse: DataFrame, most: int | None = None) -> DataFrame:
    """A record for every distinct role and organisation of each person.

    In order: positions held (a second term of an office is a record of its own), organisations
    that name the person, occupations not held as positions; without any of these the first
    property that can stand in for an employer.  ``jurisdictions`` has ``qid, org_qid`` of positions, ``reverse``
    has ``person_qid, org_qid, role, start_date, end_date``.  All of a person's records are given, or the first ``most``.
    """
    people = rows.where("route = 'person'").withColumn("label", label()).where("label IS NOT NULL")
    held = people.select("id", F.posexplode(F.try_element_at("claims", F.lit("P39"))).alias("at", "c"))
    positions = held.select(
        "id", "at", F.get_json_object(F.col("c.mainsnak.datavalue.value"), "$.id").alias("role_qid"), F.coalesce(*[qualifier(F.col("c"), p) for p in ("P108", "P642", "P1001")]).alias("org_qid"),
        F.coalesce(qualifier(F.col("c"), "P768"), qualifier(F.col("c"), "P4100")).alias("context_qid"), dates.entity_date(qualifier(F.col("c"), "P580", "$.time")).alias("from_date"),
        dates.entity_date(qualifier(F.col("c"), "P582", "$.time")).alias("to_date"),
    ).where("role_qid IS NOT NULL")
    named = positions.join(jurisdictions.select(F.col("qid").alias("role_qid"), F.col("org_qid").alias("own")), "role_qid", "left")
    first = named.select("id", F.lit(1).alias("step"), "at", "role_qid", F.coalesce("org_qid", "own", "context_qid").alias("org_qid"), F.lit(None).cast("string").alias("role"), "from_date", "to_date")
    order = F.row_number().over(Window.partitionBy("person_qid").orderBy("org_qid", "role"))
    second = reverse.withColumn("at", order).select(
        F.col("person_qid").alias("id"), F.lit(2).alias("step"), "at", F.lit(None).cast("string").alias("role_qid"), "org_qid", "role", F.col("start_date").alias("from_date"), F.col("end_date").alias("to_date")
    ).join(people.select("id"), "id", "left_semi").join(first.where("org_qid IS NOT NULL").select("id", "org_qid").distinct(), ["id", "org_qid"], "left_anti")
    none = F.lit(None).cast("string")
    third = people.select("id", F.lit(3).alias("step"), F.posexplode(claim_values("P106")).alias("at", "role_qid")).join(first.select("id", "role_qid").distinct(), ["id", "role_qid"], "left_anti")
    third = third.select("id", "step", "at", "role_qid", none.alias("org_qid"), none.alias("role"), none.alias("from_date"), none.alias("to_date"))
    found = first.unionByName(second).unionByName(third)
    last = people.join(found.select("id").distinct(), "id", "left_anti").select(
        "id", F.lit(4).alias("step"), F.lit(0).alias("at"), none.alias("role_qid"), F.coalesce(*[first_claim(p) for p in FALLBACK_PROPERTIES]).alias("org_qid"), none.alias("role"), none.alias("from_date"), none.alias("to_date")
    )
    every = found.unionByName(last)
    once = Window.partitionBy("id", "role_qid", "org_qid", "from_date").orderBy("step", "at")
    ranked = every.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    capped = ranked.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("step", "at")))
    if most is not None:  # a person's first facts; all of them otherwise
        capped = capped.where(F.col("n") <= most)
    kinds = _person_types(people, positions, classes)
    facts = people.select("id", F.col("label").alias("name"), first_claim("P27").alias("country_qid"), claim_time("P569").alias("birth_date"), claim_time("P570").alias("death_date"))
    return capped.drop("nth").join(facts, "id").join(kinds, "id", "left").withColumn("person_type", F.coalesce("person_type", F.lit("unknown")))


def _person_types(people: DataFrame, positions: DataFrame, classes: DataFrame) -> DataFrame:
    """The first position that is known, else the first occupation that is known."""
    of_position = positions.select("id", F.lit(0).alias("step"), "at", F.col("role_qid").alias("qid")).join(classes.where("kind = 'position'").select("qid", "type"), "qid")
    of_occupation = people.select("id", F.lit(1).alias("step"), F.posexplode(claim_values("P106")).alias("at", "qid")).join(classes.where("kind = 'occupation'").select("qid", "type"), "qid")
    both = of_position.unionByName(of_occupation)
    return both.groupBy("id").agg(F.min_by("type", F.struct("step", "at")).alias("person_type"))


def locations(rows: DataFrame) -> DataFrame:
    """Location records with parents and countries, each once and in order."""
    own = rows.where("route = 'location'").withColumn("label", label()).where("label IS NOT NULL")
    point = F.from_json(claim_text("P625"), "struct<latitude:double,longitude:double>")
    parents, countries = claim_values("P131"), claim_values("P17")
    record = F.to_json(F.struct(
        F.col("id").alias("wikidata_id"), "label", F.try_element_at("descriptions", F.lit("en"))["value"].alias("description"), parents.alias("parent_qids"), countries.alias("country_qids"),
        F.when(point.isNotNull(), F.struct(point["latitude"].alias("lat"), point["longitude"].alias("lon"))).alias("coordinates"),
    ))
    return own.select(
        F.col("label").alias("name"), F.lit("wikidata").alias("source"), F.col("id").alias("source_id"), names.entity_number(F.col("id")).alias("qid"), F.col("class_type").alias("location_type"),
        F.array_distinct(F.concat(parents, countries)).alias("parent_qids"), claim_time("P571").alias("from_date"), claim_time("P576").alias("to_date"), record.alias("record"),
    )


def roles(rows: DataFrame) -> DataFrame:
    own = rows.where("route = 'role'").withColumn("label", label()).where("label IS NOT NULL")
    record = F.to_json(F.struct(F.col("id").alias("wikidata_id"), "label", F.try_element_at("descriptions", F.lit("en"))["value"].alias("description")))
    return own.select(F.col("label").alias("name"), F.lit("wikidata").alias("source"), F.col("id").alias("source_id"), names.entity_number(F.col("id")).alias("qid"), record.alias("record"))


def jurisdictions(entities: DataFrame) -> DataFrame:
    """Organisation that a position belongs to by itself: its jurisdiction, country, or place."""
    own = F.coalesce(first_claim("P1001"), first_claim("P17"), first_claim("P131"))
    return entities.select(F.col("id").alias("qid"), own.alias("org_qid")).where("org_qid IS NOT NULL")


def foreign_keys(entities: DataFrame) -> DataFrame:
    """The second pass: only the references of each item."""
    return entities.select(
        F.col("id").alias("qid"), first_claim("P17").alias("country_qid"), first_claim("P27").alias("citizenship_qid"), claim_values("P106").alias("occupation_qids"), claim_values("P131").alias("parent_qids"), first_claim("P108").alias("employer_qid"),
    )


def parse_bindings(objects: DataFrame, kind: str = "company", column: str = "value") -> DataFrame:
    """Query-service result bindings; rows whose label is missing or just the id are skipped, ids come once."""
    value = lambda key: F.get_json_object(column, f"$.{key}.value")
    rows = objects.select(
        names.uri_tail(value(kind)).alias("source_id"), value(f"{kind}Label").alias("name"), value("lei").alias("lei"), value("ticker").alias("ticker"), value("countryLabel").alias("country"),
        dates.binding_date(value("inception")).alias("from_date"), dates.binding_date(value("dissolution")).alias("to_date"),
    )
    kept = rows.where("source_id IS NOT NULL AND name IS NOT NULL AND name <> '' AND name <> source_id")
    return kept.dropDuplicates(["source_id"]).withColumn("source", F.lit("wikidata"))


def sample_of(rows: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """A random sample that a seed determines."""
    return rows.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))).limit(n)


def labels_for(qids: DataFrame, column: str, entities: DataFrame) -> DataFrame:
    """Each id with its English label, else any, else the id itself."""
    named = entities.select(F.col("id").alias("__id"), label().alias("__label"))
    return qids.join(named, F.col(column) == F.col("__id"), "left").withColumn("label", F.coalesce("__label", column)).drop("__id", "__label")
