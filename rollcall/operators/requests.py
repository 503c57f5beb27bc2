"""The search service's requests as calls that take frames of requests and give frames of answers.

Each request is a row with ``qid``; texts are embedded in batches with the given model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.functions import names, vectors
from rollcall.operators import fuzzy, search


def _with_vector(requests: DataFrame, text: str, embedder: vectors.Embedder, out: str = "q") -> DataFrame:
    rows = vectors.embedded(requests, text, "__vector", embedder)
    return rows.withColumn(out, vectors.quantized(vectors.normalized(F.col("__vector")))).drop("__vector")


def organizations(index: DataFrame, orgs: DataFrame, requests: DataFrame, embedder: vectors.Embedder, k: int = 20, source: str | None = None) -> DataFrame:
    """``qid, canon_id, score, tier, rank`` for each ``(qid, query)``."""
    return search.organization_search(index, orgs, _with_vector(requests.select("qid", "query"), "query", embedder), k, source, embedder)


def people(composite: DataFrame, identity: DataFrame, persons: DataFrame, requests: DataFrame, embedder: vectors.Embedder, k: int = 20, dims: int = vectors.SEGMENT) -> DataFrame:
    """``qid, canon_id, score, rank, lookup_method`` for each ``(qid, query, person_type, role, org)``."""
    told = requests.withColumn("description", names.describe_person(F.col("query"), F.col("person_type"), F.col("role"), F.col("org")))
    texts = vectors.embedded_distinct(told, ["query", "role", "org"], embedder)
    composed = vectors.composite_vector(F.col("query_vector"), F.col("role_vector"), F.col("org_vector"), dims)
    ready = texts.select("qid", "query", "description", vectors.quantized(composed).alias("q"), vectors.quantized(vectors.identity_vector(F.col("query_vector"), dims)).alias("iq"))
    return search.person_search(composite, identity, persons, ready, k, embedder)


def roles(table: DataFrame, requests: DataFrame, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """``qid, query`` and the roles for each ``(qid, query)``: an equal one alone, or else the shortest that contain it.

    All requests go through the table's gram postings at once; ``index`` are these, if they are at hand.
    """
    return fuzzy.contains_search(table, requests.select("qid", "query"), k, index=index)


def locations(table: DataFrame, types: DataFrame, requests: DataFrame, k: int = 10, simplified_type: str | None = None) -> DataFrame:
    """The shortest locations that contain each query, of one simplified type if given; an unknown type gives nothing."""
    if simplified_type is not None:
        wanted = types.where(F.col("simplified") == simplified_type).select(F.col("id").alias("location_type_id"))
        table = table.join(wanted, "location_type_id", "left_semi")
    return fuzzy.contains_search(table, requests.select("qid", "query"), k, exact_alone=False)


def resolve(index: DataFrame, orgs: DataFrame, requests: DataFrame, embedder: vectors.Embedder, least: float = search.RESOLVER_SCORE, k: int = search.RESOLVER_CANDIDATES) -> DataFrame:
    """Resolved ids with confidence for each ``(qid, query)``."""
    return search.resolve_organizations(organizations(index, orgs, requests, embedder, k), orgs, least, k)
