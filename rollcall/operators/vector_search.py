"""Quantised cosine search: exact top-k, filters, canonical groups, popularity shards.

Query vectors come in a frame and the index is scanned once for all of them, block by block;
a set whose vectors are too many bytes is worked off in slices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.functions import vectors
from rollcall.operators.nearest import candidates

#: Queries that one scan takes to the workers; a vector of 768 bytes makes that 12 MB.
MOST_QUERIES = 16_384
HOT_SIZE, COLD_SIZE = 3_000_000, 10_000_000


def with_norms(index: DataFrame, vector: str = "v") -> DataFrame:
    """The index with squared lengths, computed once for each vector."""
    return index.withColumn("vv", vectors.int_dot(F.col(vector), F.col(vector)).cast("double"))


def build_index(df: DataFrame, id_col: str, vector: Column, keep: list[str] | None = None) -> DataFrame:
    """``id``, the quantised vector, its squared length, and the columns in ``keep``."""
    return with_norms(df.select(F.col(id_col).alias("id"), vectors.quantized(vector).alias("v"), *(keep or [])))


def slices(queries: DataFrame, most: int = MOST_QUERIES) -> list[DataFrame]:
    """The queries in frames small enough for one scan."""
    n = queries.count()
    if n <= most:
        return [queries]
    parts = -(-n // most) * 2
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)]


def top_k(pairs: DataFrame, k: int, group: str = "qid", order: list[Column] | None = None) -> DataFrame:
    """The best k of each query, by score and then id; the limit is applied before the shuffle as well."""
    ranking = Window.partitionBy(group).orderBy(*(order or [F.col("score").desc(), F.col("id")]))
    return pairs.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def sliced(queries: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``find`` of each slice of the queries, put together."""
    return reduce(DataFrame.unionByName, [find(part) for part in slices(queries)])


def search(index: DataFrame, queries: DataFrame, k: int, where: Column | None = None, differ: bool = False, same: tuple[str, str] | None = None) -> DataFrame:
    """Exact top-k of each query; ``where`` restricts the index before ranking, ``differ`` and ``same`` the pairs."""
    rows = index if where is None else index.where(where)
    return sliced(queries, lambda part: top_k(candidates(rows, part, k, differ=differ, same=same), k))


def search_groups(index: DataFrame, queries: DataFrame, canon: str, k: int) -> DataFrame:
    """Exact top-k canonical groups of each query, each by its best row."""
    return sliced(queries, lambda part: best_of_group(candidates(index, part, k, group=canon), canon, k))


def best_of_group(pairs: DataFrame, canon: str, k: int) -> DataFrame:
    """Top-k over the best row of each canonical group."""
    first = Window.partitionBy("qid", canon).orderBy(F.col("score").desc(), "id")
    return top_k(pairs.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth"), k)


def popularity_shards(df: DataFrame, order: list[Column], hot: int = HOT_SIZE, cold: int = COLD_SIZE) -> DataFrame:
    """``shard`` by popularity rank: 0 for the first ``hot`` rows, then one for every ``cold`` rows.

    The rank comes from ranges of the order, so no task sees all rows.
    """
    from rollcall.operators.upsert import numbered

    named = df.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    ranked = numbered(named, [f"__o{i}" for i in range(len(order))], out="rank").drop(*[f"__o{i}" for i in range(len(order))])
    return ranked.withColumn("shard", F.when(F.col("rank") <= hot, 0).otherwise(1 + F.floor((F.col("rank") - hot - 1) / cold)).cast("int"))


def hot_then_cold(index: DataFrame, queries: DataFrame, k: int, threshold: float = 0.95) -> DataFrame:
    """Queries whose best hot score reaches the threshold get hot rows only, the others all rows."""
    hot = search(index, queries, k, F.col("shard") == 0)
    settled = hot.where((F.col("rank") == 1) & (F.col("score") >= threshold)).select("qid")
    cold = search(index, queries.join(settled, "qid", "left_anti"), k)
    return hot.join(settled, "qid", "left_semi").unionByName(cold)


def write_index(index: DataFrame, path: str) -> None:
    """One folder for each shard, so that a search of the hot shard reads no other."""
    index.write.mode("overwrite").partitionBy("shard").parquet(path)


def manifest(index: DataFrame) -> DataFrame:
    return index.groupBy("shard").agg(F.count(F.lit(1)).alias("count"), (F.first("shard") == 0).alias("hot")).orderBy("shard")
