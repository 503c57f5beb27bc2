"""Denormalised views, table statistics, and accuracy of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def denormalized(facts: DataFrame, dims: list[tuple[DataFrame, str, str]], optional: list[tuple[DataFrame, str, str]] = ()) -> DataFrame:
    """Facts with the names of their dimensions: ``(dimension, fact column, output column)`` each.

    Dimensions of enumerations are a few dozen rows by construction and are broadcast;
    optional ones are tables of their own and are joined as the optimiser sees fit.
    """
    out = facts
    for dim, key, name in dims:
        out = out.join(F.broadcast(dim.select(F.col("id").alias("__id"), F.col("name").alias(name))), F.col(key) == F.col("__id")).drop("__id")
    for table, key, name in optional:
        out = out.join(table.select(F.col("id").alias("__id"), F.col("name").alias(name)), F.col(key) == F.col("__id"), "left").drop("__id")
    return out


def counted(facts: DataFrame, by: str, names: DataFrame | None = None) -> DataFrame:
    """Rows of each value, with the dimension's names if given."""
    counts = facts.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts if names is None else denormalized(counts, [(names, by, "name")])


def summary(facts: DataFrame) -> DataFrame:
    """Total, rows with a canonical id, and number of groups."""
    return facts.agg(F.count(F.lit(1)).alias("total"), F.count("canon_id").alias("canonicalized"), F.countDistinct("canon_id").alias("groups"))


def sample_rows(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first rows in an order, for a report."""
    return rows.orderBy(*order).limit(n)


def accuracy(results: DataFrame, hit: Column, k: int, by: list[str]) -> DataFrame:
    """Share of queries with a hit at rank 1 and within k, by group; ``results`` has ``qid, rank``."""
    per_query = results.groupBy(*by, "qid").agg(
        F.max(F.when(hit & (F.col("rank") == 1), 1).otherwise(0)).alias("top"), F.max(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias("within")
    )
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.avg("top").alias("acc_at_1"), F.avg("within").alias("acc_at_k"))
