"""Registered queries over whole tables, against their SQL."""

from __future__ import annotations

import random
from functools import partial

import duckdb
import pytest

from rollcall.operators import vector_search
from rollcall.plans import registry

SEARCHES = ["vec_topk_int8", "vec_topk_filtered", "vec_topk_canon", "vec_hot_cold", "accuracy_at_k", "vec_cosine", "merge_name_vector", "resolve_with_candidates"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    out = tmp_path_factory.mktemp("tables")
    tables = {
        "embeddings": ([(i, [rng.gauss(0, 0.3) for _ in range(16)], rng.randrange(6)) for i in range(730)], "vec_id long, embedding array<float>, label int"),
        "part": ([(i, f"{rng.choice(['red', 'small'])} {rng.choice(['Widget', 'ring'])}", f"Brand#{i % 5}", f"type {i % 7}") for i in range(1, 800)], "p_partkey long, p_name string, p_brand string, p_type string"),
        "lineitem": ([(k // 4, rng.randrange(1, 900)) for k in range(800)], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{out}/{name}.parquet")
    return str(out)


def _sql(folder, query):
    with duckdb.connect() as con:
        for name in ("embeddings", "part", "lineitem"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        found = con.execute(query)
        names = [d[0] for d in found.description]
        return sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in found.fetchall())


def _spark(spark, folder, name):
    found = registry.queries()[name](spark, folder)
    return sorted(tuple(row[c] for c in sorted(found.columns)) for row in found.collect())


@pytest.mark.parametrize("most", [vector_search.MOST_QUERIES, 3])
@pytest.mark.parametrize("name", SEARCHES)
def test_searches_take_all_queries(spark, folder, monkeypatch, name, most):
    monkeypatch.setattr(vector_search, "slices", partial(vector_search.slices, most=most))
    got = _spark(spark, folder, name)
    want = _sql(folder, registry.oracle_sql()[name])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b)


def test_alias_explode_takes_all_parts(spark, folder):
    got = _spark(spark, folder, "alias_explode")
    assert got == _sql(folder, registry.oracle_sql()["alias_explode"])
    assert {row[0] for row in got} == set(range(1, 800))


def test_point_lookup_takes_all_references(spark, folder):
    got = _spark(spark, folder, "point_lookup")
    assert got == _sql(folder, registry.oracle_sql()["point_lookup"])
    assert len(got) > 400
