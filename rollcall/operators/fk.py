"""Resolution of references: ids by external keys, arrays, reverse mappings, stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.operators.upsert import missing_keys, numbered


def unique_lookup(df: DataFrame, key: str, value: str, last: bool = True) -> DataFrame:
    """One value for each key: that of the row with the highest id, or the lowest."""
    pick = F.max_by(value, "id") if last else F.min_by(value, "id")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias(value))


def resolve(facts: DataFrame, fact_key: str, lookup: DataFrame, key: str, value: str, out: str, keep_old: bool = True) -> DataFrame:
    """Fill ``out`` from a unique lookup.  The old value wins if ``keep_old``, otherwise the new one where there is one."""
    names = lookup.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    joined = facts.join(names, F.col(fact_key) == F.col("__key"), "left")
    old = F.col(out) if out in facts.columns else F.lit(None)
    return joined.withColumn(out, F.coalesce(old, "__value") if keep_old else F.coalesce("__value", old)).drop("__key", "__value")


def first_resolvable(facts: DataFrame, id_col: str, keys: str, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``id_col, out``: the value of the first key of the array that the lookup has."""
    parts = facts.select(id_col, F.posexplode(keys).alias("__at", "__key"))
    found = parts.join(lookup.select(F.col(key).alias("__key"), F.col(value).alias("__value")), "__key")
    return found.groupBy(id_col).agg(F.min_by("__value", "__at").alias(out))


def resolve_array(facts: DataFrame, id_col: str, keys: str, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``id_col, out``: the values of all keys of the array in order, unknown keys left out, repeated values once."""
    parts = facts.select(id_col, F.posexplode(F.array_distinct(keys)).alias("__at", "__key"))
    found = parts.join(lookup.select(F.col(key).alias("__key"), F.col(value).alias("__value")), "__key")
    ordered = F.array_sort(F.collect_list(F.struct("__at", "__value")))
    return found.groupBy(id_col).agg(F.array_distinct(F.transform(ordered, lambda x: x["__value"])).alias(out))


def kth_to_kth(rows: DataFrame, row_key: str, row_order: str, mappings: DataFrame, mapping_key: str, mapping_order: str, values: list[str]) -> DataFrame:
    """The k-th mapping of a key fills the k-th row of that key; rows beyond the mappings get nulls."""
    nth = lambda key, order: F.row_number().over(Window.partitionBy(key).orderBy(order))
    left = rows.withColumn("__k", nth(row_key, row_order))
    right = mappings.select(F.col(mapping_key).alias("__key"), nth(mapping_key, mapping_order).alias("__n"), *values)
    return left.join(right, (F.col(row_key) == F.col("__key")) & (F.col("__k") == F.col("__n")), "left").drop("__key", "__k", "__n")


def new_mappings(rows: DataFrame, mappings: DataFrame, keys: list[str]) -> DataFrame:
    """Mappings whose keys no row has, each once."""
    return mappings.dropDuplicates(keys).join(rows.select(*keys).distinct(), keys, "left_anti")


def executives(orgs: DataFrame) -> DataFrame:
    """The reverse mapping from organisations' records: ``person_qid, org_id, role, start_date, end_date``."""
    kind = "struct<executives:array<struct<person_qid:string,role:string,start_date:string,end_date:string>>>"
    listed = orgs.select(F.col("id").alias("org_id"), F.explode(F.from_json("record", kind)["executives"]).alias("x"))
    return listed.select("org_id", "x.*")


def stub_organizations(orgs: DataFrame, people: DataFrame, company: Column, name: Column, source_id: int) -> DataFrame:
    """Organisations that people's records name but the table lacks, as new rows with ids after the highest."""
    named = people.select(company.alias("source_identifier"), name.alias("name")).where("source_identifier IS NOT NULL AND source_identifier <> ''")
    known = orgs.where(F.col("source_id") == source_id)
    missing = missing_keys(named, "source_identifier", known, "source_identifier")
    fresh = named.join(missing, "source_identifier").groupBy("source_identifier").agg(F.min("name").alias("name"))
    highest = orgs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return numbered(fresh.withColumn("source_id", F.lit(source_id).cast("long")), ["source_identifier"], highest)


def first_with_name(titles: DataFrame, title: str, orgs: DataFrame) -> DataFrame:
    """Each normalised title with the first primary organisation of that normalised name."""
    primary = orgs.where("alias_source_id IS NULL AND name_normalized <> ''").groupBy("name_normalized").agg(F.min("id").alias("org_id"))
    return titles.join(primary, F.col(title) == F.col("name_normalized")).drop("name_normalized")
