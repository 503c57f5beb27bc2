"""Approximate nearest neighbours by a graph of neighbours, built by descent and searched in batches.

First lists come from several random orders of the index: bits of random hyperplanes sort the
rows, the sequence is cut into blocks of equal size, and rows of a block are compared with each
other in one matrix product.  Then rounds of descent improve them: a row's neighbours, and the
rows that have it as a neighbour, are compared with each other, since neighbours of a row are
likely to be neighbours.  A hub is a neighbour of many rows; only its best ``hub`` of them take part, so
no group grows with the table.

A search keeps a beam of the best rows found for each query and follows their lists, all queries
in the same joins, until the beams hold no row that has not been followed.  How wide a beam must be
depends on the table, so the best rows of a bounded sample of the queries are also found exactly: while
the search misses too many of these, it goes on with twice the beam and twice the rows to start from.

Equal vectors would fill each other's lists and cut a graph into islands, so it is built over distinct ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.operators import vector_search
from rollcall.operators.vector_search import top_k
from rollcall.session import ship_package
from rollcall.stage import drop_stage, released, staged, task_count

#: Length of a list, random orders, rows of a block, rounds of descent, rows that a hub meets, rows that each meeting proposes.
DEGREE, ORDERS, BLOCK, DESCENTS, HUB, SPREAD = 24, 6, 1024, 2, 32, 8
#: Hyperplanes of an order.
PLANES = 24
#: Rows of the first beam, rows followed in a round, rounds of a beam, and rows where a search starts.
BEAM, FOLLOW, ROUNDS, STARTS = 256, 64, 8, 2048
#: Queries whose best rows are found exactly, and the share of these that a search must find: 0.9 and what a sample of this size may be off.
SAMPLE, TARGET = 256, 0.93
LISTS = "id long, near array<long>, scores array<float>"


def _rows(raw: pa.Array) -> np.ndarray:
    """Vectors of one Arrow column of bytes as rows; shorter ones end in zeros."""
    data = [np.frombuffer(x.as_buffer(), np.int8) for x in raw]
    width = max(map(len, data), default=0)
    return np.stack([x if len(x) == width else np.pad(x, (0, width - len(x))) for x in data]).astype(np.float32) if data else np.zeros((0, 0), np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = batch.columns
        packed = [None if v is None or None in v or not any(v) else np.array(v, np.int8).tobytes() for v in vectors.to_pylist()]
        keep = pa.array([p is not None and i is not None for p, i in zip(packed, ids.to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([ids.filter(keep), pa.array(packed, pa.binary()).filter(keep)], ["id", "raw"])


def packed(index: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """``id, raw``: the 8-bit vectors as bytes, of rows that have an id and a vector with some length; an id counts once."""
    ship_package(index.sparkSession)
    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<tinyint>").alias("v"))
    return rows.mapInArrow(_bytes, "id long, raw binary").groupBy("id").agg(F.min("raw").alias("raw"))


def distinct(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of ``packed`` rows the first id of each vector, ``id, raw``, and the first ``k`` ids of each, ``first, id``."""
    same = Window.partitionBy("raw")
    kept = rows.withColumn("nth", F.row_number().over(same.orderBy("id"))).where(F.col("nth") <= k)
    kept = staged(kept.withColumn("first", F.min("id").over(same)), "graph-rows")
    return kept.where("nth = 1").select("id", "raw"), kept.select("first", "id")


def with_copies(found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query, where ``found`` has first ids; ``copies`` as ``distinct`` gives them, at least ``k`` of each."""
    pairs = found.select("qid", F.col("id").alias("first"), "score").join(copies, "first")
    return top_k(pairs.select("qid", "id", "score"), k)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.frombuffer(x.as_buffer(), np.int8) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.int8()))], ["id", "v"])


def _codes(orders: int, seed: int) -> Callable:
    """A row for each order: the signs of the vector's products with its hyperplanes as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1))
            for order in range(orders):
                planes = np.random.default_rng((seed, order)).normal(size=(rows.shape[1], PLANES)).astype(np.float32)
                code = ((rows @ planes) > 0) @ (1 << np.arange(PLANES)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array([order] * len(rows), pa.int32()), pa.array(code.astype(np.int64)), *batch.columns], ["order", "code", "id", "raw"])

    return run


def _best_lists(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a square of similarities, the ids and similarities of its best ``k`` others, best first."""
    np.fill_diagonal(scores, -np.inf)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-scores, axis=1)[:, :k]
    own = np.take_along_axis(scores, at, axis=1)
    order = np.argsort(-own, axis=1)
    return ids[np.take_along_axis(at, order, axis=1)], np.take_along_axis(own, order, axis=1)


def _list_batch(ids: np.ndarray, near: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * near.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(near.ravel())), pa.ListArray.from_arrays(ends, pa.array(scores.ravel().astype(np.float32)))], ["id", "near", "scores"]
    )


def _grouped(most: int, k: int) -> Callable:
    """Lists from runs of equal ``group``, of at most ``most`` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, raw = None, [], []

        def lists() -> pa.RecordBatch:
            unit = _unit(_rows(pa.array(raw, pa.binary())))
            return _list_batch(*(lambda i: (i, *_best_lists(i, unit @ unit.T, k)))(np.array(ids, np.int64)))

        for batch in batches:
            for group, i, vector in zip(*[c.to_pylist() for c in batch.columns]):
                if group != of or len(ids) == most:
                    if len(ids) > 1:
                        yield lists()
                    of, ids, raw = group, [], []
                ids.append(i)
                raw.append(vector)
        if len(ids) > 1:
            yield lists()

    return run


def _merged(lists: DataFrame, degree: int) -> DataFrame:
    """One list for each id: the best ``degree`` of all its lists, each neighbour once."""
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("scores", "near"), lambda x: F.struct(x["scores"].alias("s"), F.negative(x["near"]).alias("n")))))
    best = lists.groupBy("id").agg(F.slice(F.reverse(F.array_sort(F.array_distinct(pairs))), 1, degree).alias("best"))
    return best.select("id", F.transform("best", lambda x: F.negative(x["n"])).alias("near"), F.transform("best", lambda x: x["s"]).alias("scores"))


def _meetings(graph: DataFrame, hub: int) -> DataFrame:
    """``centre, member``: the rows that meet at a centre, its neighbours and those it is a neighbour of, a bounded number of each."""
    edges = graph.select("id", F.explode(F.arrays_zip("near", "scores")).alias("x")).select("id", F.col("x.near").alias("near"), F.col("x.scores").alias("score"))
    # A row that is a neighbour of many keeps its best; Spark cuts its edges before they are shuffled.
    best = Window.partitionBy("near").orderBy(F.col("score").desc(), "id")
    kept = staged(edges.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= hub).select("id", "near"), "graph-edges")
    return kept.select(F.col("id").alias("centre"), F.col("near").alias("id")).union(kept.select(F.col("near").alias("centre"), "id"))


def build_graph(rows: DataFrame, degree: int = DEGREE, orders: int = ORDERS, descents: int = DESCENTS, block: int = BLOCK, hub: int = HUB, seed: int = 17) -> DataFrame:
    """``id, near, scores``: for each row of ``packed`` its neighbours found, best first, as a stage table.

    A table of one row has no lists.  Equal vectors stand by id, of equal similarity the smaller first.
    """
    ship_package(rows.sparkSession)
    coded = rows.mapInArrow(_codes(orders, seed), "order int, code long, id long, raw binary")
    laid = coded.repartitionByRange(task_count(rows), "order", "code", "id").sortWithinPartitions("order", "code", "id")
    graph = staged(_merged(laid.select(F.col("order").alias("group"), "id", "raw").mapInArrow(_grouped(block, degree), LISTS), degree), "graph")
    for _ in range(descents):
        met = _meetings(graph, hub).join(rows, "id").select("centre", "id", "raw")
        met = met.repartition(task_count(rows), "centre").sortWithinPartitions("centre", "id")
        found = met.mapInArrow(_grouped(degree + hub, SPREAD), LISTS)
        better = staged(_merged(graph.union(found), degree), "graph")
        drop_stage(graph)
        graph = better
    return graph


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of pairs of 8-bit vectors, sums in integers."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.stack([np.frombuffer(x.as_buffer(), np.int8) for x in c]).astype(np.float64) for c in batch.columns[2:4])
            score = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], ["qid", "id", "score"])


def _pair_scores(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, score`` of pairs; vectors of different lengths are no pair."""
    both = pairs.join(rows, "id").join(queries, "qid").where("octet_length(raw) = octet_length(asked)")
    return both.select("qid", "id", "asked", "raw").mapInArrow(_scored, "qid long, id long, score double")


def _entries(starts: bytes, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(starts).read_all().combine_chunks()
        ids = table.column("id").to_numpy()
        raw = table.column("raw").combine_chunks()
        unit, sizes = _unit(_rows(raw)), np.array([len(x.as_buffer()) for x in raw])
        for batch in batches:
            if batch.num_rows and len(ids):
                asked = _rows(batch.column(1))
                width = max(asked.shape[1], unit.shape[1])
                score = np.pad(asked, ((0, 0), (0, width - asked.shape[1]))) @ np.pad(unit, ((0, 0), (0, width - unit.shape[1]))).T
                score[np.array([len(x.as_buffer()) for x in batch.column(1)])[:, None] != sizes[None, :]] = -np.inf
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                fits = np.isfinite(np.take_along_axis(score, at, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), fits.sum(axis=1))), pa.array(ids[at[fits]])], ["qid", "id"])

    return run


def _exact(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``qid, id, score``: the best ``k`` of ``rows`` for each query, compared with all of them."""
    index = rows.select("id", "raw").mapInArrow(_unpacked, "id long, v array<tinyint>")
    queries = asked.mapInArrow(_unpacked, "id long, v array<tinyint>").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return vector_search.search(index, queries, k).where("score IS NOT NULL").select("qid", "id", "score", "rank")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [p.select(*parts[0].columns) for p in parts])


def graph_search(
    rows: DataFrame,
    graph: DataFrame,
    queries: DataFrame,
    k: int = 10,
    beam: int = BEAM,
    follow: int = FOLLOW,
    rounds: int = ROUNDS,
    starts: int = STARTS,
    sample: int = SAMPLE,
    target: float = TARGET,
) -> DataFrame:
    """``qid, id, score, rank``: the best ``k`` rows found for each query, scores to six places.

    ``queries`` has ``qid, q``; one without an id or whose vector is null, zero or holds a null finds nothing.  The search starts from
    the best of ``starts`` rows, those with the smallest hashes of their ids, which go to the workers (a
    few hundred bytes each).  In a round the lists of up to ``follow`` rows of each query's ``beam`` are followed.
    When ``rounds`` are over or nothing is left to follow, the results of ``sample`` queries are compared with their exact ones.
    While less than ``target`` of these are found, beam, follow and starts double; the exact rows themselves are not used.
    It ends at the latest when it has started from all rows.  Ties stand by id.  An empty index or set of queries gives no rows.
    """
    ship_package(rows.sparkSession)
    with released() as keep:
        asked = staged(packed(queries, "qid", "q").select(F.col("id").alias("qid"), F.col("raw").alias("asked")), "graph-queries")
        sampled = staged(asked.orderBy(F.xxhash64("qid"), "qid").limit(sample), "graph-sample")
        exact = staged(_exact(rows, sampled, k), "graph-exact")
        hashed = rows.select("id", "raw", F.xxhash64("id").alias("hash"))
        first = hashed.orderBy("hash", "id").limit(starts).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, first.schema) as out:
            out.write_table(first)
        # Hashes up to this one have been started from; rows lie evenly among them.
        least, last = -(1 << 63), (1 << 63) - 1
        upto = first.column("hash")[-1].as_py() if len(first) == starts else last
        pairs = asked.mapInArrow(_entries(sink.getvalue().to_pybytes(), max(follow, k)), "qid long, id long")
        found = staged(_pair_scores(pairs, rows, asked), "graph-found")
        parts, followed = [found], []  # what each round has found and followed; a row's state is in the last beam
        state = found.withColumn("done", F.lit(False))
        while True:
            for _ in range(rounds):
                best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
                ranked = state.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= beam)
                turn = Window.partitionBy("qid").orderBy("done", "nth")
                ranked = staged(ranked.withColumn("now", ~F.col("done") & (F.row_number().over(turn) <= follow)).select("qid", "id", "score", "done", "now"), "graph-beam")
                state = ranked.select("qid", "id", "score", (F.col("done") | F.col("now")).alias("done"))
                frontier = ranked.where("now").select("qid", "id")
                if not frontier.take(1):
                    break
                followed.append(frontier)
                onward = frontier.join(graph.select("id", "near"), "id").select("qid", F.explode("near").alias("id")).distinct()
                parts.append(staged(_pair_scores(onward.join(_union(parts).select("qid", "id"), ["qid", "id"], "left_anti"), rows, asked), "graph-found"))
                state = state.union(parts[-1].withColumn("done", F.lit(False)))
            best = top_k(state.join(sampled.select("qid"), "qid", "left_semi").withColumn("score", F.round("score", 6)), k)
            share = recall(best, exact, k).agg(F.sum("found").alias("found"), F.sum("wanted").alias("wanted")).first()
            if upto == last or not share.wanted or share.found >= target * share.wanted:
                break
            beam, follow = 2 * beam, 2 * follow
            more, upto = upto, min(upto + (upto - least) + 1, last)
            entries = _exact(hashed.where(F.col("hash").between(more + 1, upto)), asked, max(follow, k)).drop("rank")
            parts.append(staged(entries.join(_union(parts).select("qid", "id"), ["qid", "id"], "left_anti"), "graph-found"))
            # Rows that fell out of the smaller beam may be in this one.
            seen = _union(followed).withColumn("done", F.lit(True)) if followed else state.select("qid", "id", "done")
            state = _union(parts).join(seen, ["qid", "id"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
        result = staged(top_k(state.withColumn("score", F.round("score", 6)), k).select("qid", "id", "score", "rank"), "graph-result")
        keep.append(result)
    return result


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """``qid, wanted, found``: of each query's exact best ``k``, how many were found; a row of the k-th score counts for it, whichever it is."""
    last = exact.where(F.col("rank") <= k).groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("wanted"))
    good = found.join(last, "qid").where(F.col("score") >= F.col("least")).groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    return last.join(good, "qid", "left").select("qid", "wanted", F.least(F.coalesce("found", F.lit(0)), "wanted").alias("found"))
