"""Embeddings of texts kept between batches, by the content of the text: a second run embeds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.functions import vectors
from rollcall.session import ship_package

SCHEMA = "digest string, vector array<float>"


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


class EmbeddingCache:
    """A table of digests and vectors under ``path``, one for each model's name.

    Each call of ``embedded`` appends the texts that the table lacks as one folder; a call that is retried may append
    texts again, which does no harm, as one vector is taken for each digest.  Writers at once do not disturb each other.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: vectors.Embedder, model: str):
        self.spark, self.embedder = spark, embedder
        self.path = f"{path.rstrip('/')}/model={model}"

    def table(self) -> DataFrame:
        """``digest, vector``, a digest once."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path).groupBy("digest").agg(F.first("vector").alias("vector"))

    def add(self, texts: DataFrame, column: str) -> None:
        """Embed those distinct texts that the table lacks, and append them."""
        ship_package(self.spark)
        wanted = texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().withColumn("digest", text_digest(F.col("text")))
        lacking = wanted.join(self.table().select("digest"), "digest", "left_anti")
        new = vectors.embedded(lacking, "text", "vector", self.embedder).select("digest", "vector")
        new.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def embedded(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with ``<column>_vector`` for each of the text columns; a null text has a null vector."""
        self.add(df.select(F.explode(F.array(*columns)).alias("text")), "text")
        known = self.table()
        for column in columns:
            own = known.select(F.col("digest").alias(f"__{column}"), F.col("vector").alias(f"{column}_vector"))
            df = df.join(own, text_digest(F.col(column)) == F.col(f"__{column}"), "left").drop(f"__{column}")
        return df
