"""Legal-entity identifier files: XML, JSON array, or one JSON object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.sources.ranges import array_objects
from rollcall.sources.records import company, text

# Categories of the registry.
CATEGORIES = {"GENERAL": "business", "SOLE_PROPRIETOR": "business", "FUND": "fund", "BRANCH": "branch", "INTERNATIONAL_ORGANIZATION": "international_org"}

_XML = (
    "LEI string, Entity struct<LegalName:string,EntityCategory:string,EntityStatus:string,LegalJurisdiction:string,"
    "LegalAddress:struct<City:string,Country:string>,OtherEntityNames:struct<OtherEntityName:array<string>>>, Registration struct<InitialRegistrationDate:string>"
)
_ADDRESS = "struct<country:string,city:string,Country:string,City:string>"


def _finish(rows: DataFrame, active_only: bool) -> DataFrame:
    category = F.upper(F.coalesce("category", F.lit("")))
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    since = F.substring_index("registered", "T", 1)
    record = F.to_json(F.struct(
        "lei", F.col("legal_name"), "status", "jurisdiction", F.coalesce("country", F.lit("")).alias("country"), F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("category", F.lit("")).alias("entity_category"), F.coalesce("other_names", F.array().cast("array<string>")).alias("other_names"), since.alias("initial_registration_date"),
    ))
    kept = rows.where(text("lei").isNotNull() & text("legal_name").isNotNull())
    if active_only:
        kept = kept.where(F.coalesce(F.upper("status"), F.lit("ACTIVE")) == "ACTIVE")
    return company(kept, "gleif", record, name=F.trim("legal_name"), source_id=F.col("lei"), region=F.coalesce("country", F.lit("")), entity_type=F.coalesce(F.element_at(kinds, category), F.lit("unknown")), from_date=since)


def read_xml(spark: SparkSession, path: str, active_only: bool = False) -> DataFrame:
    """Records of a file with or without a namespace prefix; the identifier must have 20 characters."""
    tags = ["LEIRecord", "lei:LEIRecord"]
    frames = [spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(_XML).load(path) for tag in tags]
    rows = frames[0].unionByName(frames[1]).where(F.length("LEI") == 20)
    return _finish(rows.select(
        F.col("LEI").alias("lei"), F.col("Entity.LegalName").alias("legal_name"), F.col("Entity.EntityStatus").alias("status"), F.col("Entity.EntityCategory").alias("category"),
        F.col("Entity.LegalJurisdiction").alias("jurisdiction"), F.col("Entity.LegalAddress.Country").alias("country"), F.col("Entity.LegalAddress.City").alias("city"),
        F.col("Entity.OtherEntityNames.OtherEntityName").alias("other_names"), F.col("Registration.InitialRegistrationDate").alias("registered"),
    ), active_only)


def _first(json: Column, *paths: str) -> Column:
    """The first path that has a value."""
    return F.coalesce(*[text(F.get_json_object(json, p)) for p in paths])


def parse_json(objects: DataFrame, column: str = "value", active_only: bool = False) -> DataFrame:
    """Records of JSON object texts in any of the registry's forms; objects that don't parse are skipped."""
    j = F.col(column)
    entity = "$.attributes.entity"
    others = F.coalesce(F.get_json_object(j, f"{entity}.otherNames"), F.get_json_object(j, f"{entity}.OtherEntityNames"))
    name_of = lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$['$']"), x)
    legal = F.get_json_object(j, f"{entity}.legalName")
    return _finish(objects.where(F.expr(f"try_parse_json({column}) IS NOT NULL")).select(
        _first(j, "$.id", "$.attributes.lei", "$.LEI").alias("lei"),
        F.coalesce(_first(j, f"{entity}.legalName.name", f"{entity}.legalName['$']"), F.when(~F.startswith(legal, F.lit("{")), text(legal)), _first(j, f"{entity}.LegalName", "$.legal_name")).alias("legal_name"),
        _first(j, f"{entity}.status", "$.attributes.registration.status").alias("status"), _first(j, f"{entity}.category", f"{entity}.EntityCategory").alias("category"), _first(j, f"{entity}.jurisdiction", f"{entity}.LegalJurisdiction").alias("jurisdiction"),
        _first(j, f"{entity}.legalAddress.country", f"{entity}.legalAddress.Country").alias("country"), _first(j, f"{entity}.legalAddress.city", f"{entity}.legalAddress.City").alias("city"),
        F.transform(F.from_json(others, "array<string>"), name_of).alias("other_names"),
        _first(j, "$.attributes.registration.initialRegistrationDate", "$.attributes.registration.InitialRegistrationDate").alias("registered"),
    ), active_only)


def read(spark: SparkSession, path: str, active_only: bool = False) -> DataFrame:
    """A file of any form: XML by name or first character, an array by ``[``, else a JSON object a line."""
    lines = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    first = lines[0][0].strip()[:1] if lines else ""
    if path.lower().endswith(".xml") or first == "<":
        return read_xml(spark, path, active_only)
    if first == "[":
        return parse_json(array_objects(spark, path), active_only=active_only)
    return parse_json(spark.read.text(path), active_only=active_only)
