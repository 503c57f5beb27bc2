"""External aliases: anchor texts and transliterated names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.functions.names import entity_number, normalize_company


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """``anchor_text, title`` of a Parquet or CSV file, by name or else by position."""
    rows = spark.read.parquet(path) if path.lower().rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    if {"anchor_text", "title"} <= set(rows.columns):
        return rows.select("anchor_text", "title")
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("anchor_text"), F.col(f"`{rows.columns[1]}`").alias("title"))


def read_paranames(spark: SparkSession, path: str) -> DataFrame:
    """``qid, name`` of organisations' English names."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return rows.where("type = 'ORG' AND language = 'en'").select(entity_number(F.col("wikidata_id")).alias("qid"), "name")


def anchor_aliases(anchors: DataFrame, orgs: DataFrame) -> DataFrame:
    """``org_id, name, name_normalized``: anchors whose title names a primary organisation, by its first record."""
    primary = orgs.where("alias_source_id IS NULL AND name_normalized <> ''").groupBy("name_normalized").agg(F.min("id").alias("org_id"))
    titled = anchors.select("anchor_text", normalize_company(F.regexp_replace("title", "_", " ")).alias("name_normalized"))
    found = titled.join(primary, "name_normalized").select("org_id", F.col("anchor_text").alias("name"), F.col("name_normalized").alias("own"))
    return found.withColumn("name_normalized", normalize_company(F.col("name"))).where("name_normalized <> '' AND name_normalized <> own").drop("own").dropDuplicates(["org_id", "name_normalized"])


def paraname_aliases(names: DataFrame, orgs: DataFrame) -> DataFrame:
    """``org_id, name, name_normalized`` by entity id; of several organisations with an id the last counts."""
    primary = orgs.where("alias_source_id IS NULL AND qid IS NOT NULL").groupBy("qid").agg(F.max("id").alias("org_id"), F.max_by("name_normalized", "id").alias("own"))
    found = names.join(primary, "qid").withColumn("name_normalized", normalize_company(F.col("name")))
    return found.where("name_normalized <> '' AND name_normalized <> own").select("org_id", "name", "name_normalized").dropDuplicates(["org_id", "name_normalized"])
