"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(labels: DataFrame, label_col: str, rows: int, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` ids with their label, those with the smallest hashes of the id.

    Labels other than 0 and 1 and null ids are left out; an id with several labels counts as 1 if any is.
    """
    found = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    found = found.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        found = found.where(where)
    return found.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def one_text_each(rows: DataFrame, label_col: str) -> DataFrame:
    """``doc_id, text`` and the label, one row for each id: of rows that repeat an id, the least text; so as many rows as the sample has at most."""
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first(label_col).alias(label_col))
