"""The four tables with the names of what their keys refer to.

Each takes the tables of ``schema.empty_database`` by name.  Rows whose source or type is
unknown are left out, as by an inner join; places, roles and organisations may be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.operators.stats import denormalized

Tables = dict[str, DataFrame]
_COMMON = ["id", "qid", "name", "name_normalized", "source", "source_identifier"]


def organizations(tables: Tables) -> DataFrame:
    kinds = tables["location_types"].select(F.col("id").alias("location_type_id"), F.col("simplified").alias("name"))
    places = tables["locations"].join(F.broadcast(kinds.withColumnRenamed("name", "region_type")), "location_type_id", "left").select("id", "name", "region_type")
    rows = denormalized(tables["organizations"], [(tables["source_types"], "source_id", "source"), (tables["organization_types"], "entity_type_id", "entity_type")], [(tables["source_types"], "alias_source_id", "alias_source")])
    placed = rows.join(places.select(F.col("id").alias("region_id"), F.col("name").alias("region"), "region_type"), "region_id", "left")
    return placed.select(*_COMMON, "region", "region_type", "entity_type", "from_date", "to_date", "canon_id", "canon_size", "alias_source", "alias_source_identifier")


def people(tables: Tables) -> DataFrame:
    rows = denormalized(
        tables["people"], [(tables["source_types"], "source_id", "source"), (tables["people_types"], "person_type_id", "person_type")],
        [(tables["locations"], "country_id", "country"), (tables["roles"], "known_for_role_id", "known_for_role"), (tables["organizations"], "known_for_org_id", "known_for_org")],
    )
    return rows.select(*_COMMON, "country", "person_type", "known_for_role", "known_for_org", "known_for_org_id", "from_date", "to_date", "birth_date", "death_date", "canon_id", "canon_size")


def roles(tables: Tables) -> DataFrame:
    return denormalized(tables["roles"], [(tables["source_types"], "source_id", "source")]).select(*_COMMON, "canon_id", "canon_size")


def locations(tables: Tables) -> DataFrame:
    kinds = tables["location_types"].select("id", "name")
    rows = denormalized(tables["locations"], [(tables["source_types"], "source_id", "source"), (kinds, "location_type_id", "location_type"), (tables["location_types"].select("id", F.col("simplified").alias("name")), "location_type_id", "simplified_type")])
    return rows.select(*_COMMON, "parent_ids", "location_type", "simplified_type", "from_date", "to_date", "canon_id", "canon_size")
