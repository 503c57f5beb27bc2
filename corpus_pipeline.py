"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import mixing, ngram_join, packing, secrets, toxicity
from rollcall.llm.queries import vocabulary
from rollcall.session import prepare
from rollcall.stage import released, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    prepare(spark)  # the first stage; later ones run in the same session
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.ToxicityModel(docs, labels).clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8 stays."""
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; no document goes."""
    return secrets.redacted_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources come near their target sizes."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in training sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express the trained stages; the tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with released() as keep:  # what the stage wrote for itself goes
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
