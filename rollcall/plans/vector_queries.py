"""Vector operators over the embeddings table, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.functions import vectors
from rollcall.operators import neighbour_graph, stats, vector_search
from rollcall.plans.tables import table

DIMS = 16


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.build_index(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), ["label"])


#: Rows whose id is a multiple of this serve as queries, at every table size.
QUERY_STEP = 100


def _queries(index: DataFrame) -> DataFrame:
    return index.where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("qlabel"))


def vec_topk_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return vector_search.search(index, _queries(index), 10).select("qid", "id", "score", "rank")


def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    found = vector_search.search(index, _queries(index), 10, differ=True, same=("label", "qlabel"))
    return found.select("qid", "id", "label", "score", "rank")


def vec_topk_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    found = vector_search.search_groups(index, _queries(index), "label", 5)
    return found.select("qid", "id", "label", "score", "rank")


def vec_hot_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir).withColumn("shard", F.when(F.col("id") < 100, 0).otherwise(1))
    return vector_search.hot_then_cold(index, _queries(index).select("qid", "q"), 5).select("qid", "id", "score", "rank")


def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    segment = F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END")
    ranked = vector_search.popularity_shards(customers, [segment, -F.col("c_acctbal"), F.col("c_custkey")], hot=100, cold=250)
    return ranked.select("c_custkey", F.col("rank").alias("rn"), "shard")


def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.manifest(shard_assignment(spark, sf_dir))


def matryoshka_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.identity_vector(F.col("embedding"), DIMS).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(DIMS - 1)), 5).alias("last"), F.round(vectors.norm(F.col("v")), 5).alias("norm"))


def composite_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    name, role, org = (e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(f"v{k}")) for k in range(3))
    rows = name.join(role, "vec_id", "left").join(org, "vec_id", "left")
    composed = rows.select("vec_id", vectors.composite_vector(F.col("v0"), F.col("v1"), F.col("v2"), DIMS).alias("v"))
    return composed.select("vec_id", *[F.round(F.get("v", F.lit(i)), 5).alias(f"x{i}") for i in (0, DIMS, 2 * DIMS)])


def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantized(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0), lambda s, x: s + x.cast("int"))
    return rows.select("vec_id", total.cast("long").alias("total"), F.array_min("v").cast("long").alias("least"), F.array_max("v").cast("long").alias("most"))


def accuracy_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    results = vector_search.search(index, _queries(index), 10, differ=True)
    found = stats.accuracy(results, F.col("label") == F.col("qlabel"), 10, ["qlabel"])
    return found.select("qlabel", "queries", F.round("acc_at_1", 6).alias("acc_at_1"), F.round("acc_at_k", 6).alias("acc_at_k"))


def _graph_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the queries, and what the neighbour graph finds for them."""
    index = _index(spark, sf_dir)
    queries = _queries(index).select("qid", "q")
    rows, copies = neighbour_graph.distinct(neighbour_graph.packed(index), 10)
    found = neighbour_graph.graph_search(rows, neighbour_graph.build_graph(rows), queries, 10)
    return index, queries, neighbour_graph.with_copies(found, copies, 10)


def vec_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: what a beam over the neighbour graph finds."""
    return _graph_results(spark, sf_dir)[2]


def vec_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the graph finds nine tenths of the exact best ten of all queries."""
    index, queries, found = _graph_results(spark, sf_dir)
    counts = neighbour_graph.recall(found, vector_search.search(index, queries, 10)).agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), F.sum("found").alias("found"))
    return counts.select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))


_QUANTIZED = "list_transform(embedding, lambda x: least(greatest(round_even(x::DOUBLE * 127, 0), -127), 127)::INT)"
_BASE = f"""
WITH idx AS (SELECT vec_id AS id, label, {_QUANTIZED} AS v FROM embeddings),
norms AS (SELECT *, list_sum(list_transform(v, lambda x: x * x))::DOUBLE AS vv FROM idx),
pairs AS (
  SELECT q.id AS qid, q.label AS qlabel, n.id, n.label,
         round(CASE WHEN n.vv * q.vv > 0 THEN list_sum(list_transform(list_zip(n.v, q.v), lambda z: z[1] * z[2])) / sqrt(n.vv * q.vv) ELSE 0 END, 6) AS score
  FROM norms n, norms q WHERE %s)
"""


def _top(where: str, keep: str, k: int, pairs: str = "pairs", order: str = "score DESC, id") -> str:
    return f"SELECT {keep} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order})::INT AS rank FROM {pairs} WHERE {where}) WHERE rank <= {k}"


ORACLE = {
    "vec_topk_int8": _BASE % "q.id % 100 = 0" + _top("true", "qid, id, score, rank", 10),
    "vec_topk_filtered": _BASE % "q.id % 100 = 0" + _top("label = qlabel AND id <> qid", "qid, id, label, score, rank", 10),
    "vec_topk_canon": _BASE % "q.id % 100 = 0"
    + ", firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS nth FROM pairs) WHERE nth = 1) "
    + _top("true", "qid, id, label, score, rank", 5, "firsts"),
    "vec_hot_cold": _BASE % "q.id % 100 = 0"
    + ", hot AS (" + _top("id < 100", "*", 5) + "), settled AS (SELECT qid FROM hot WHERE rank = 1 AND score >= 0.95), cold AS ("
    + _top("qid NOT IN (SELECT qid FROM settled)", "*", 5)
    + ") SELECT qid, id, score, rank FROM hot WHERE qid IN (SELECT qid FROM settled) UNION ALL SELECT qid, id, score, rank FROM cold",
    "vec_graph_recall": "SELECT count(*) AS queries, (count(*) * least(10, (SELECT count(*) FROM embeddings)))::BIGINT AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "shard_assignment": """
SELECT c_custkey, rn, (CASE WHEN rn <= 100 THEN 0 ELSE 1 + (rn - 100 - 1) // 250 END)::INT AS shard FROM (
  SELECT c_custkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END,
                                       c_acctbal DESC, c_custkey) AS rn FROM customer)""",
    "shard_manifest": """
SELECT shard, count(*) AS count, shard = 0 AS hot FROM (
  SELECT rn, (CASE WHEN rn <= 100 THEN 0 ELSE 1 + (rn - 100 - 1) // 250 END)::INT AS shard FROM (SELECT row_number() OVER () AS rn FROM customer)) GROUP BY shard""",
    "matryoshka_identity": f"""
WITH s AS (SELECT vec_id, list_transform(embedding[1:{DIMS}], lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM s)
SELECT vec_id, round(v[1] / l, 5) AS first, round(v[{DIMS}] / l, 5) AS last,
       round(sqrt(list_sum(list_transform(v, lambda x: (x / l) * (x / l)))), 5) AS norm FROM n""",
    "composite_vector": f"""
WITH s AS (SELECT vec_id, list_transform(embedding[1:{DIMS}], lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM s),
j AS (SELECT a.vec_id, 8 * a.x AS a, coalesce(b.x, 0) AS b, 4 * coalesce(c.x, 0) AS c,
             sqrt(64 + CASE WHEN b.x IS NULL THEN 0 ELSE 1 END + CASE WHEN c.x IS NULL THEN 0 ELSE 16 END) AS l
      FROM u a LEFT JOIN u b ON b.vec_id = a.vec_id + 1 LEFT JOIN u c ON c.vec_id = a.vec_id + 2)
SELECT vec_id, round(a / l, 5) AS x0, round(b / l, 5) AS x{DIMS}, round(c / l, 5) AS x{2 * DIMS} FROM j""",
    "quantize": f"""
SELECT vec_id, list_sum(v)::BIGINT AS total, list_min(v)::BIGINT AS least, list_max(v)::BIGINT AS most FROM (SELECT vec_id, {_QUANTIZED} AS v FROM embeddings)""",
    "accuracy_at_k": _BASE % "q.id % 100 = 0"
    + ", top AS (" + _top("id <> qid", "*", 10) + """), hits AS (
  SELECT qlabel, qid, max(CASE WHEN label = qlabel AND rank = 1 THEN 1 ELSE 0 END) AS top1, max(CASE WHEN label = qlabel THEN 1 ELSE 0 END) AS topk FROM top GROUP BY 1, 2)
SELECT qlabel, count(*) AS queries, round(avg(top1), 6) AS acc_at_1, round(avg(topk), 6) AS acc_at_k FROM hits GROUP BY qlabel""",
}

QUERIES = {
    f.__name__: f
    for f in (
        vec_topk_int8, vec_topk_filtered, vec_topk_canon, vec_hot_cold, shard_assignment, shard_manifest, matryoshka_identity, composite_vector, quantize,
        accuracy_at_k, vec_graph_search, vec_graph_recall,
    )
}
