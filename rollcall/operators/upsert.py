"""Keyed writes on immutable tables: each gives the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.operators.ordered import laid_out
from rollcall.schema import KEYS

_ABSENT = "\u0000"


def _key(columns: list[str]) -> list[Column]:
    """Key columns with nulls made comparable."""
    return [F.coalesce(F.col(c).cast("string"), F.lit(_ABSENT)) for c in columns]


def _with_key(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("__key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_key(columns))]))


def numbered(df: DataFrame, order: list[str], start: int | Column = 0, out: str = "id") -> DataFrame:
    """Consecutive ids from ``start + 1`` in the order of ``order``, without one task seeing all rows.

    Rows are dealt into ranges and numbered within each; the ranges' counts give the offsets.
    """
    laid = laid_out(df, order)
    counts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    nth = F.col("__at").bitwiseAND((1 << 33) - 1) + 1  # the place within its range
    base = start if isinstance(start, Column) else F.lit(start)
    joined = laid.join(F.broadcast(offsets), "__part")
    return joined.withColumn(out, (base + F.col("__before") + nth).cast("long")).drop("__part", "__at", "__before")


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Replace rows by key; of incoming rows with equal keys the one with the highest ``sequence`` wins.

    Null key parts compare as equal.  A replaced row keeps its place in nothing but the key:
    all other columns are the new row's.
    """
    old = _with_key(table, keys).withColumn("__new", F.lit(0)).withColumn("__seq", F.lit(None).cast(incoming.schema[sequence].dataType))
    new = _with_key(incoming, keys).withColumn("__new", F.lit(1)).withColumn("__seq", F.col(sequence))
    both = old.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy("__key").orderBy(F.col("__new").desc(), F.col("__seq").desc_nulls_last())
    return both.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").select(*table.columns)


def insert_ignore(table: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The incoming rows that are inserted: first by ``sequence`` for each key, and only keys that the table lacks."""
    first = Window.partitionBy("__key").orderBy(F.col(sequence).asc_nulls_last())
    fresh = _with_key(incoming, keys).withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")
    return fresh.join(_with_key(table, keys).select("__key").distinct(), "__key", "left_anti").drop("__key")


def get_or_create(table: DataFrame, names: DataFrame, name: str, source_id: int) -> DataFrame:
    """The table with a row for every name of ``names`` under its normal form; existing ids stay.

    Names that are null or blank are refused.
    """
    if names.where(F.trim(F.coalesce(F.col(name), F.lit(""))) == "").take(1):
        raise ValueError("a name is empty")
    wanted = names.select(F.col(name).alias("name"), F.lower(F.trim(F.col(name))).alias("name_normalized"), F.lit(source_id).cast("long").alias("source_id"))
    fresh = insert_ignore(table, wanted, ["name_normalized", "source_id"], "name")
    highest = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return table.unionByName(numbered(fresh, ["name_normalized"], highest), allowMissingColumns=True)


def insert_locations(table: DataFrame, incoming: DataFrame, sequence: str) -> DataFrame:
    """The incoming locations that are inserted, in the order of ``sequence``.

    A row with an identifier is known if a row has that identifier in any case, a row without
    one if a row has its normalised name; the table's names and identifiers are looked up
    alike.  An empty identifier counts as none.  Of rows without a name or identifier none goes in.
    """
    name, identifier = F.lower(F.trim("name")), F.lower(F.nullif(F.col("source_identifier"), F.lit("")))
    known = table.select(F.explode(F.array(name, identifier)).alias("__key")).where("__key IS NOT NULL").distinct()
    first = Window.partitionBy("__key").orderBy(F.col(sequence).asc_nulls_last())

    def fresh(rows: DataFrame, key: Column) -> DataFrame:
        keyed = rows.withColumn("__key", key).where("__key IS NOT NULL")
        return keyed.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank").join(known, "__key", "left_anti")

    identified = fresh(incoming.where(identifier.isNotNull()), identifier).drop("__key")
    named = fresh(incoming.where(identifier.isNull()), name)
    earlier = identified.groupBy(name.alias("__key")).agg(F.min(sequence).alias("__first"))
    unknown = named.join(earlier, "__key", "left").where(F.col("__first").isNull() | (F.col("__first") > F.col(sequence)))
    return identified.unionByName(unknown.drop("__key", "__first"))


def upsert_people(people: DataFrame, roles: DataFrame, incoming: DataFrame, sequence: str) -> tuple[DataFrame, DataFrame]:
    """The next versions of people and roles; ``incoming`` has people's columns and ``known_for_role``, a role's text.

    Roles that a source lacks are made, the first by ``sequence`` giving the name, and people refer to them.  A null or blank
    text names no role and leaves ``known_for_role_id`` as it is.
    """
    role = F.nullif(F.lower(F.trim("known_for_role")), F.lit(""))
    wanted = incoming.where(role.isNotNull()).select(F.col("known_for_role").alias("name"), role.alias("name_normalized"), "source_id", F.col(sequence).alias("__seq"))
    fresh = insert_ignore(roles, wanted, KEYS["roles"], "__seq").drop("__seq")
    highest = roles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    both = roles.unionByName(numbered(fresh, KEYS["roles"], highest), allowMissingColumns=True)
    lookup = both.groupBy(F.col("name_normalized").alias("__name"), F.col("source_id").alias("__source")).agg(F.min("id").alias("__role"))
    told = incoming.withColumn("__own", role).join(lookup, (F.col("__own") == F.col("__name")) & F.col("source_id").eqNullSafe(F.col("__source")), "left")
    resolved = told.withColumn("known_for_role_id", F.coalesce("__role", "known_for_role_id")).drop("__own", "__name", "__source", "__role", "known_for_role")
    return upsert(people, resolved, KEYS["people"], sequence), both


def missing_keys(needed: DataFrame, column: str, existing: DataFrame, existing_column: str) -> DataFrame:
    """Distinct values that are referred to but do not exist."""
    return needed.select(column).where(F.col(column).isNotNull()).distinct().join(
        existing.select(F.col(existing_column).alias(column)), column, "left_anti"
    )


def compacted(df: DataFrame, path: str, files: int) -> None:
    """Rewrite a table in ``files`` files."""
    df.repartition(files).write.mode("overwrite").parquet(path)


def without_records(table: DataFrame) -> DataFrame:
    """The lite copy of a table: raw records emptied, all else kept."""
    return table.withColumn("record", F.lit("{}"))


def merged_json(record: Column, key: str, value: Column) -> Column:
    """A JSON object text with ``key`` set to ``value``, other keys kept."""
    pairs = F.coalesce(F.from_json(record, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(pairs, lambda k, v: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), value.cast("string"))))


def migrated(table: DataFrame, version: int) -> DataFrame:
    """A people or organisations table of an earlier version in the present form.

    Version 4 kept vectors in the table, 5 retired two person types, 6 brought alias columns.
    """
    out = table
    if version < 4:
        out = out.drop("embedding", "embedding_scalar")
    if version < 5 and "person_type_id" in out.columns:
        out = out.withColumn("person_type_id", F.when(F.col("person_type_id") == 14, 7).when(F.col("person_type_id") == 11, 1).otherwise(F.col("person_type_id")))
    if version < 6 and "entity_type_id" in out.columns and "alias_source_id" not in out.columns:
        out = out.withColumns({"alias_source_id": F.lit(None).cast("long"), "alias_source_identifier": F.lit(None).cast("string")})
    return out
