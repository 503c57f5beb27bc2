"""Batch jobs over whole tables: each takes tables and gives their next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.functions import dates, names, regions, vectors
from rollcall.operators import canonicalize, upsert, vector_search
from rollcall.sources.wikidata import FALLBACK_PROPERTIES, claim_values


def update_dates(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Fill ``from_date`` and ``to_date`` where they are missing, from one change for each key (the least dates)."""
    own = changes.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("from_date").alias("__from"), F.min("to_date").alias("__to"))
    same = [table[k].eqNullSafe(own[f"__{k}"]) for k in keys]
    joined = table.join(own, same, "left")
    return joined.withColumns({"from_date": dates.filled(F.col("from_date"), F.col("__from")), "to_date": dates.filled(F.col("to_date"), F.col("__to"))}).select(*table.columns)


def update_role_org(people: DataFrame, changes: DataFrame) -> DataFrame:
    """Set role and organisation by source and identifier; values that a person has stay."""
    own = changes.groupBy(F.col("source_id").alias("__s"), F.col("source_identifier").alias("__i")).agg(F.min("role_id").alias("__role"), F.min("org_id").alias("__org"))
    joined = people.join(own, (F.col("source_id") == F.col("__s")) & (F.col("source_identifier") == F.col("__i")), "left")
    return joined.withColumns({"known_for_role_id": F.coalesce("known_for_role_id", "__role"), "known_for_org_id": F.coalesce("known_for_org_id", "__org")}).select(*people.columns)


def by_id(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of a candidate set, in one join."""
    return table.join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")


def person_by_source(people: DataFrame, source: Column, identifier: Column) -> DataFrame:
    """The person of a source's identifier; of several rows the one with the smallest id."""
    rows = people.where((F.col("source_id") == source) & (F.col("source_identifier") == identifier))
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy("source_id", "source_identifier").orderBy("id"))).where("__nth = 1").drop("__nth")


def page_after(table: DataFrame, last_id: int, size: int = 10_000, id_col: str = "id") -> DataFrame:
    """The next rows in order of id."""
    return table.where(F.col(id_col) > last_id).orderBy(id_col).limit(size)


def seed_countries(locations: DataFrame) -> DataFrame:
    """Countries that the table lacks, by two-letter code, as new location rows."""
    spark = locations.sparkSession
    known = locations.where("location_type_id BETWEEN 2 AND 4").select(F.upper("source_identifier").alias("alpha2"))
    fresh = regions.iso_countries(spark).join(known, "alpha2", "left_anti")
    return fresh.select("name", names.normalize_plain(F.col("name")).alias("name_normalized"), F.col("alpha2").alias("source_identifier"), F.lit(2).cast("long").alias("location_type_id"))


def normalize_people(people: DataFrame) -> DataFrame:
    return people.withColumn("name_normalized", names.normalize_person(F.col("name")))


def normalize_organizations(orgs: DataFrame) -> DataFrame:
    return orgs.withColumn("name_normalized", names.normalize_company(F.col("name")))


def populate_aliases(orgs: DataFrame) -> DataFrame:
    """Primaries with their own aliases made anew; aliases from outside stay, and sizes are counted again."""
    kept = orgs.where("alias_source_id IS NULL OR alias_source_id NOT IN (5, 6, 7)")
    made = canonicalize.alias_rows(orgs, names.normalize_company)
    fresh = upsert.insert_ignore(kept, made, ["source_identifier", "source_id", "name_normalized"], "name")
    highest = kept.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    numbered = upsert.numbered(fresh, ["source_identifier", "name_normalized"], highest)
    return canonicalize.refreshed_sizes(kept.unionByName(numbered, allowMissingColumns=True))


def build_people_index(people: DataFrame, embedder: vectors.Embedder, dims: int = vectors.SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The composite index of people with an organisation and the identity index of all; every text is embedded once."""
    texts = vectors.embedded_distinct(people, ["name", "role_name", "org_name"], embedder)
    named = texts.withColumn("canon_id", F.coalesce("canon_id", "id")).withColumnRenamed("id", "person_id")
    composite = vectors.composite_vector(F.col("name_vector"), F.col("role_name_vector"), F.col("org_name_vector"), dims)
    identity = vectors.identity_vector(F.col("name_vector"), dims)
    return (
        vector_search.build_index(named.where("org_name IS NOT NULL"), "person_id", composite, ["canon_id"]),
        vector_search.build_index(named, "person_id", identity, ["canon_id"]),
    )


def build_organization_index(orgs: DataFrame, embedder: vectors.Embedder) -> DataFrame:
    rows = vectors.embedded(orgs.where("alias_source_id IS NULL").withColumnRenamed("id", "org_id"), "name", "__vector", embedder)
    return vector_search.build_index(rows, "org_id", vectors.normalized(F.col("__vector")), ["canon_id", "source"])


def reclassify_people(people: DataFrame, classes: DataFrame) -> DataFrame:
    """Types from the positions and occupations in the records; people without either keep theirs."""
    kind = "struct<positions:array<string>,occupations:array<string>>"
    parsed = people.select("id", F.from_json("record", kind).alias("r"))
    listed = parsed.select("id", F.posexplode(F.concat(
        F.transform(F.coalesce("r.positions", F.array().cast("array<string>")), lambda q: F.struct(q.alias("qid"), F.lit("position").alias("kind"))),
        F.transform(F.coalesce("r.occupations", F.array().cast("array<string>")), lambda q: F.struct(q.alias("qid"), F.lit("occupation").alias("kind"))),
    )).alias("at", "x")).select("id", "at", "x.qid", "x.kind")
    found = listed.join(classes, ["qid", "kind"]).groupBy("id").agg(F.min_by("type", "at").alias("__type"))
    mentioned = listed.select("id").distinct().withColumn("__has", F.lit(True))
    joined = people.join(mentioned, "id", "left").join(found, "id", "left")
    return joined.withColumn("new_type", F.when(F.col("__has"), F.coalesce("__type", F.lit("unknown"))).otherwise(F.col("person_type"))).drop("__has", "__type")


def backfill_locations(facts: DataFrame, entities: DataFrame, locations: DataFrame, out: str = "region_id") -> DataFrame:
    """The location of each fact's country, by the entity's claims; locations that are known stay."""
    country = entities.select(F.col("id").alias("__entity"), F.get(claim_values("P17"), F.lit(0)).alias("__country"))
    place = locations.groupBy(F.col("source_identifier").alias("__country")).agg(F.min("id").alias("__place"))
    joined = facts.join(country.join(place, "__country"), F.col("source_identifier") == F.col("__entity"), "left")
    return joined.withColumn(out, F.coalesce(out, "__place")).select(*facts.columns)


def fallback_organization(entities: DataFrame) -> DataFrame:
    """``id, org_qid``: the first property that can stand in for an employer."""
    return entities.select("id", F.coalesce(*[F.get(claim_values(p), F.lit(0)) for p in FALLBACK_PROPERTIES]).alias("org_qid"))
