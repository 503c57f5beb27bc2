"""The neighbour graph against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import neighbour_graph as graph_index, vector_search


def _vectors(spark, n, dims, seed=3):
    """Groups of copies, near copies and random vectors, 8 bits a component; some rows without a vector."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dims))
    rows[: n // 5] = rows[0] + 0.1 * rng.normal(size=(n // 5, dims))
    rows[n // 5 : n // 4] = rows[n // 5]
    ints = np.clip(np.rint(rows / np.linalg.norm(rows, axis=1, keepdims=True) * 127), -127, 127).astype(int)
    data = [(i, v.tolist()) for i, v in enumerate(ints)] + [(n, None), (n + 1, [0] * dims), (n + 2, [None] * dims), (None, ints[0].tolist())]
    return spark.createDataFrame(data, "id long, v array<tinyint>").repartition(4)


@pytest.mark.parametrize(("n", "dims", "block"), [(3000, 16, 128), (1500, 48, 64)])
def test_recall(spark, n, dims, block):
    index = vector_search.with_norms(_vectors(spark, n, dims))
    queries = index.where((F.col("id") % 25 == 0) & (F.col("id") < n)).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    exact = vector_search.search(index, queries, 10)
    rows = graph_index.packed(index)
    graph = graph_index.build_graph(rows, block=block)
    found = graph_index.graph_search(rows, graph, queries, 10, starts=64).cache()
    score = graph_index.recall(found, exact).agg(F.sum("found").alias("found"), F.sum("wanted").alias("wanted")).first()
    assert score.wanted == 10 * (n // 25) and score.found >= 0.9 * score.wanted
    # Scores are exact, ranks follow them and ids, nothing comes twice.
    right = {(r.qid, r.id): r.score for r in vector_search.search(index, queries, 200).collect()}
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r.qid, []).append((r.rank, r.score, r.id))
        assert right.get((r.qid, r.id), r.score) == pytest.approx(r.score)
    for rows_ in by_query.values():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 11)) and [(s, i) for _, s, i in rows_] == sorted(((s, i) for _, s, i in rows_), key=lambda x: (-x[0], x[1]))
        assert len({i for *_, i in rows_}) == 10


def test_hubs_meet_a_bounded_number(spark):
    """A star: the centre is everybody's neighbour."""
    rng = np.random.default_rng(1)
    lists = [(0, list(range(1, 9)), [0.5] * 8)] + [(i, [0], [float(rng.random())]) for i in range(1, 2000)]
    graph = spark.createDataFrame(lists, graph_index.LISTS)
    met = graph_index._meetings(graph, 32).groupBy("centre").count().collect()
    assert max(r["count"] for r in met) <= 32 + 8


def test_small_and_empty_tables(spark):
    none = graph_index.packed(spark.createDataFrame([], "id long, v array<tinyint>"))
    queries = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [0, 0]), (None, [1, 1]), (4, [1, 2, 3])], "qid long, q array<tinyint>")
    assert graph_index.graph_search(none, graph_index.build_graph(none), queries).collect() == []
    few = graph_index.packed(spark.createDataFrame([(7, [1, 2]), (8, [2, 1]), (8, [2, 1])], "id long, v array<tinyint>"))
    found = graph_index.graph_search(few, graph_index.build_graph(few), queries).collect()
    assert [(r.qid, r.id, r.score, r.rank) for r in sorted(found)] == [(1, 7, 1.0, 1), (1, 8, 0.8, 2)]
    one = graph_index.packed(spark.createDataFrame([(7, [1, 2])], "id long, v array<tinyint>"))
    assert [r.id for r in graph_index.graph_search(one, graph_index.build_graph(one), queries).collect()] == [7]


def _recall(spark, index, found, queries):
    score = graph_index.recall(found, vector_search.search(index, queries, 10)).agg(F.sum("found").alias("found"), F.sum("wanted").alias("wanted")).first()
    return score.found / score.wanted


def _random(spark, n, dims, copies=1):
    ints = np.clip(np.rint(np.random.default_rng(5).normal(size=(n, dims)) * 40), -127, 127).astype(int)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ints)], "i long, v array<tinyint>")
    return vector_search.with_norms(rows.crossJoin(spark.range(copies)).select((F.col("i") + n * F.col("id")).alias("id"), "v").repartition(4))


def test_search_widens_until_its_recall_is_reached(spark):
    """A poor graph of random vectors, and a beam too narrow for it: in a larger table every beam is."""
    index = _random(spark, 3000, 32)
    queries = index.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    rows = graph_index.packed(index)
    graph = graph_index.build_graph(rows, degree=8, orders=2, descents=1, block=64)
    found = graph_index.graph_search(rows, graph, queries, 10, beam=16, follow=8, starts=16).cache()
    assert _recall(spark, index, found, queries) >= 0.9
    assert found.groupBy("qid").agg(F.count_distinct("id").alias("n"), F.max("rank").alias("last")).where("n = 10 AND last = 10").count() == 150


def test_copies_leave_the_graph_whole(spark):
    """With more copies than a list is long, lists of all rows would lead to copies only."""
    index = _random(spark, 400, 16, copies=40)
    queries = index.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    rows, copies = graph_index.distinct(graph_index.packed(index), 10)
    assert (rows.count(), copies.count()) == (400, 4000)
    found = graph_index.graph_search(rows, graph_index.build_graph(rows, block=64), queries, 10, starts=16)
    best = graph_index.with_copies(found, copies, 10).cache()
    assert {tuple(r) for r in best.collect()} == {tuple(r) for r in vector_search.search(index, queries, 10).select("qid", "id", "score", "rank").collect()}
