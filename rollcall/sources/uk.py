"""The British company register: bulk CSV, search results, and officers' fixed-width files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.functions import dates, names
from rollcall.operators.ordered import running
from rollcall.sources.ranges import zip_lines
from rollcall.sources.records import company, person, text

ACTIVE = "^(active|open|live)"


def parse_companies(rows: DataFrame, active_only: bool = False) -> DataFrame:
    """Company rows under the bulk file's headers or those of the search results."""
    trimmed = rows.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿").strip().replace(".", "_")) for c in rows.columns])
    have = set(trimmed.columns)

    def value(*options: str) -> Column:
        found = [text(o) for o in options if o in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    read = trimmed.select(
        value("CompanyNumber", "company_number").alias("number"), value("CompanyName", "company_name", "title").alias("title"), F.lower(value("CompanyStatus", "company_status")).alias("status"),
        F.coalesce(value("CompanyCategory", "company_type"), F.lit("")).alias("kind"), value("IncorporationDate", "date_of_creation").alias("since"), value("DissolutionDate", "date_of_cessation").alias("until"),
        F.coalesce(value("CountryOfOrigin", "country"), F.lit("United Kingdom")).alias("country"), F.coalesce(value("SICCode_SicText_1"), F.lit("")).alias("sic_code"),
    ).where("number IS NOT NULL AND title IS NOT NULL")
    if active_only:
        read = read.where(F.rlike("status", F.lit(ACTIVE)))
    record = F.to_json(F.struct(
        F.col("number").alias("company_number"), "title", F.col("status").alias("company_status"), F.col("kind").alias("company_type"), F.col("since").alias("date_of_creation"),
        F.col("until").alias("date_of_cessation"), "country", "sic_code",
    ))
    return company(read.dropDuplicates(["number"]), "companies_house", record, name=F.col("title"), source_id=F.col("number"), region=F.col("country"), entity_type=names.uk_company_type(F.col("kind")), from_date=F.col("since"), to_date=F.col("until"))


def read_companies(spark: SparkSession, path: str, active_only: bool = False) -> DataFrame:
    return parse_companies(spark.read.csv(path, header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True), active_only)


def parse_officers(lines: DataFrame, file: str = "file", at: str = "at", column: str = "value", current_only: bool = False) -> DataFrame:
    """Individual officers of ``(file, at, value)`` lines, ``at`` giving the lines' order.

    A company line sets the name for the officers' lines after it that have its number; a long file is
    worked off in ranges, with the name carried from each to the next.
    """
    line = F.col(column)
    cut = lambda start, n: F.trim(F.substring(line, start + 1, n))
    rows = lines.where(~F.startswith(line, F.lit("DDDD"))).select(
        F.col(file).alias("file"), F.col(at).alias("at"), line.alias("line"), cut(0, 8).alias("number"), F.substring(line, 9, 1).alias("kind"),
        F.when(F.substring(line, 9, 1) == "1", F.struct(cut(0, 8).alias("number"), F.trim(F.substring_index(F.substr(line, F.lit(41)), "<", 1)).alias("name"))).alias("head"),
    )
    known = running(rows, ["file"], ["at"], {"of": ("last", "head")}, inclusive=True).withColumn("head", F.col("of")).where("kind = '2' AND length(line) > 76")
    line = F.col("line")
    fields = F.split(F.substr(line, F.lit(77)), "<")
    field = lambda i: F.coalesce(F.trim(F.get(fields, F.lit(i))), F.lit(""))
    people = known.where(F.substring(line, 25, 1) != "Y").select(
        "number", F.when(F.col("head.number") == F.col("number"), F.col("head.name")).otherwise("").alias("company_name"), cut(12, 12).alias("person_id"), dates.compact_date(cut(32, 8)).alias("appointment_date"),
        dates.compact_date(cut(40, 8)).alias("resignation_date"), cut(48, 8).alias("postcode"), F.coalesce(dates.compact_date(cut(64, 8)), dates.compact_date(cut(56, 6))).alias("birth_date"),
        field(2).alias("surname"), names.title_case(F.concat_ws(" ", F.nullif(field(1), F.lit("")), F.nullif(field(2), F.lit("")))).alias("name"), field(11).alias("occupation"), field(12).alias("nationality"),
    ).where("surname <> ''")
    if current_only:
        people = people.where("resignation_date IS NULL")
    role = F.coalesce(F.nullif(F.col("occupation"), F.lit("")), F.lit("Director"))
    record = F.to_json(F.struct(
        "person_id", F.col("number").alias("company_number"), "company_name", "appointment_date", "resignation_date", "postcode", "occupation", "nationality", F.col("resignation_date").isNull().alias("is_current"),
    ))
    return person(
        people, "companies_house", record, name=F.col("name"), source_id=F.concat_ws("_", "person_id", "number"), country=F.lit("GB"), person_type=names.officer_type(role), known_for_role=role,
        known_for_org_name=F.col("company_name"), from_date=F.col("appointment_date"), to_date=F.col("resignation_date"), birth_date=F.col("birth_date"),
    )


def read_officers(spark: SparkSession, path: str, current_only: bool = False) -> DataFrame:
    """Officers of the ``.dat`` members of archives; each member is a file of its own."""
    return parse_officers(zip_lines(spark, path, "*.dat"), current_only=current_only)
