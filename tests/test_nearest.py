"""Block-wise nearest neighbours against plain scans of all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import nearest, vector_search


def _score(a, b):
    if a is None or b is None or None in a or None in b:
        return 0.0
    aa, bb = sum(x * x for x in a), sum(x * x for x in b)
    if aa * bb == 0:
        return 0.0
    if len(a) != len(b):
        return None
    return float(f"{sum(x * y for x, y in zip(a, b)) / math.sqrt(aa * bb):.6f}") + 0.0


def _rows(rng, n):
    """Few distinct vectors, so that ties abound, with nulls, zeros, holes and another length."""
    kinds = [[rng.randrange(-3, 4) for _ in range(4)] for _ in range(40)] + [None, [0, 0, 0, 0], [1, None, 2, 3], [1, 2, 3], []]
    return [(i, rng.choice(kinds), rng.choice([None, *range(6)]), rng.randrange(n // 3)) for i in range(n)]


def _want(rows, k, group=None, differ=False, same=False):
    out = []
    for qid, q, qlabel, _ in rows:
        if qid % 10:
            continue
        pairs = [(i, _score(v, q), canon) for i, v, label, canon in rows if not (differ and i == qid) and not (same and (label is None or label != qlabel))]
        pairs.sort(key=lambda p: (math.inf if p[1] is None else -p[1], p[0]))
        if group:
            seen = set()
            pairs = [p for p in pairs if not (p[2] in seen or seen.add(p[2]))]
        out += [(qid, i, score, rank) for rank, (i, score, _) in enumerate(pairs[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"differ": True}, {"same": True, "differ": True}, {"group": "canon_id"}])
def test_blocks_equal_all_pairs(spark, options):
    rng = random.Random(11)
    rows = _rows(rng, 300)
    frame = spark.createDataFrame(rows, "id long, v array<tinyint>, label int, canon_id long").repartition(3)
    queries = frame.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("qlabel"))
    if "group" in options:
        found = vector_search.search_groups(frame, queries, "canon_id", 5)
    else:
        found = vector_search.search(frame, queries, 5, differ=options.get("differ", False), same=("label", "qlabel") if options.get("same") else None)
    assert sorted((r.qid, r.id, r.score, r["rank"]) for r in found.collect()) == _want(rows, 5, **options)


@pytest.mark.parametrize("block", [300, 7])
@pytest.mark.parametrize("group", [None, "canon_id"])
def test_scan_in_small_blocks(block, group):
    """The running bound of earlier blocks leaves out nothing."""
    import pyarrow as pa

    rows = _rows(random.Random(5), 300)
    columns = [list(c) for c in zip(*rows)]
    table = pa.table({"id": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.list_(pa.int8())), "label": pa.array(columns[2], pa.int32()), "canon_id": pa.array(columns[3], pa.int64())})
    asked = [r for r in rows if r[0] % 10 == 0]
    queries = pa.table({"qid": pa.array([r[0] for r in asked], pa.int64()), "q": pa.array([r[1] for r in asked], pa.list_(pa.int8()))})
    scan = nearest._Scan(queries, nearest.Rule(5, group))
    parts = [scan.block(table.slice(i, block)).to_pylist() for i in range(0, 300, block)]
    out = []
    for qid in queries.column("qid").to_pylist():
        pairs = [(p["id"], None if p["raw"] is None else float(f"{p['raw']:.6f}") + 0.0, p["canon_id"]) for part in parts for p in part if p["qid"] == qid]
        pairs.sort(key=lambda p: (math.inf if p[1] is None else -p[1], p[0]))
        seen = set()
        pairs = [p for p in pairs if not group or not (p[2] in seen or seen.add(p[2]))]
        out += [(qid, i, score, rank) for rank, (i, score, _) in enumerate(pairs[:5], 1)]
    assert sorted(out) == _want(rows, 5, group)


def test_no_rows_and_no_queries(spark):
    frame = spark.createDataFrame([(1, [1, 2])], "id long, v array<tinyint>")
    asked = frame.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    assert vector_search.search(frame.where("id > 1"), asked, 3).count() == 0
    assert vector_search.search(frame, asked.where("qid > 1"), 3).count() == 0
    assert [tuple(r) for r in vector_search.search(frame, asked, 3).select("qid", "id", "score", "rank").collect()] == [(1, 1, 1.0, 1)]


def test_fractions(spark):
    """Equal vectors of fractions stand in the order of ids; NaN is above all numbers, as in Spark."""
    rng = random.Random(2)
    kinds = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(12)]
    rows = [(i, rng.choice(kinds)) for i in range(200)] + [(500, [math.nan] * 9)]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = frame.where("id % 20 = 0 AND id < 500").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    found = vector_search.top_k(nearest.candidates(frame, asked, 4, places=5), 4)
    got = sorted((r.qid, r["rank"], r.id) for r in found.collect())
    want = []
    for qid, q in rows[:200:20]:
        pairs = sorted((-round(sum(x * y for x, y in zip(q, v)) / math.sqrt(sum(x * x for x in q) * sum(x * x for x in v)), 5), i) for i, v in rows[:200])
        want += [(qid, 1, 500)] + [(qid, rank, i) for rank, (_, i) in enumerate(pairs[:3], 2)]
    assert got == want
