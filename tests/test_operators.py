"""Relational operators against plain Python models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions import vectors
from rollcall.operators import canonicalize, fk, search, upsert, vector_search
from rollcall.operators.components import connected_components


def _closure(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(7)
    edges = {"random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "path": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(40)], "empty": []}[kind]
    frame = spark.createDataFrame([*edges, (None, 1), (3, 3)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(frame).collect()}
    want = {x: c for x, c in _closure([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_upsert_last_wins_and_nulls_are_equal(spark):
    table = spark.createDataFrame([("a", None, 1, "old"), ("b", "x", 2, "old")], "k string, r string, seq int, v string")
    new = spark.createDataFrame([("a", None, 5, "new"), ("a", None, 4, "lost"), ("c", None, 1, "new")], table.schema)
    got = {(r.k, r.r): r.v for r in upsert.upsert(table, new, ["k", "r"], "seq").collect()}
    assert got == {("a", None): "new", ("b", "x"): "old", ("c", None): "new"}
    fresh = upsert.insert_ignore(table, new, ["k", "r"], "seq").collect()
    assert [(r.k, r.v) for r in fresh] == [("c", "new")]


def test_get_or_create(spark):
    empty = spark.createDataFrame([], "id long, name string, name_normalized string, source_id long")
    one = upsert.get_or_create(empty, spark.createDataFrame([("CEO",), ("Chair",)], "n string"), "n", 4)
    two = upsert.get_or_create(one, spark.createDataFrame([(" ceo ",), ("Auditor",)], "n string"), "n", 4)
    assert {r.name_normalized: r.id for r in two.collect()} == {"ceo": 1, "chair": 2, "auditor": 3}
    with pytest.raises(ValueError):
        upsert.get_or_create(one, spark.createDataFrame([(" ",)], "n string"), "n", 4)


def test_fk_helpers(spark):
    rows = spark.createDataFrame([(1, ["x", "b", "a", "b"]), (2, ["x"])], "id long, keys array<string>")
    dim = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v long")
    assert [tuple(r) for r in fk.first_resolvable(rows, "id", "keys", dim, "k", "v", "o").collect()] == [(1, 20)]
    assert [(r.id, r.o) for r in fk.resolve_array(rows, "id", "keys", dim, "k", "v", "o").collect()] == [(1, [20, 10])]


def test_merged_json_and_migration(spark):
    row = spark.createDataFrame([('{"a":"1","b":"2"}',)], "r string")
    assert row.select(upsert.merged_json(F.col("r"), "b", F.lit("3")).alias("x")).first().x == '{"a":"1","b":"3"}'
    people = spark.createDataFrame([(14,), (11,), (3,)], "person_type_id long")
    assert sorted(r[0] for r in upsert.migrated(people, 4).collect()) == [1, 3, 7]


def test_overlap_closure_equals_pairwise(spark):
    rng = random.Random(3)
    people = []
    for i in range(80):
        start = rng.choice([None, "", f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}"])
        end = rng.choice([None, f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}"])
        people.append((i, rng.choice(["ann", "bob", ""]), start, end))
    frame = spark.createDataFrame(people, "id long, name_normalized string, from_date string, to_date string")
    edges = []
    for a in people:
        for b in people:
            if a[0] < b[0] and a[1] == b[1] != "" and a[2] and b[2] and a[2] <= (b[3] or "9999-12-31") and b[2] <= (a[3] or "9999-12-31"):
                edges.append((a[0], b[0]))
    got = {r.id: r.component for r in connected_components(canonicalize.overlap_edges(frame)).collect()}
    valid = {p[0] for p in people if p[2] and p[2] <= (p[3] or "9999-12-31")}
    want = _closure([e for e in edges if set(e) <= valid])
    assert got == want


def test_canonicalize_organizations(spark):
    rows = [
        (1, "wikidata", "Q1", "acme", "US", '{"lei":"L1"}', None), (2, "gleif", "L1", "acme corp x", "DE", "{}", None), (3, "sec_edgar", "0000000007", "seven", "US", "{}", None),
        (4, "wikidata", "Q7", "other", "US", '{"cik":"7"}', None), (5, "companies_house", "9", "", "", "{}", None), (6, "companies_house", "8", "", "", "{}", None), (7, "wikidata", "Q1", "alias", "US", "{}", 5),
    ]
    frame = spark.createDataFrame(rows, "id long, source string, source_identifier string, name_normalized string, region string, record string, alias_source_id long")
    got = {r.id: (r.canon_id, r.canon_size) for r in canonicalize.canonicalize_organizations(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (3, 2), 4: (3, 1), 5: (5, 1), 6: (6, 1)}


def test_people_search_tiers(spark):
    embedder = vectors.HashedEmbedder(32)
    people = spark.createDataFrame(
        [(1, "Ann Lee", "ann lee", "executive", "CEO", "Acme", 1, 1, 1, 3), (2, "Ann Lee", "ann lee", "artist", None, None, None, None, 2, 1), (3, "Bob Ray", "robert ray", "athlete", None, None, None, None, 3, 1)],
        "id long, name string, name_normalized string, person_type string, role_name string, org_name string, known_for_role_id long, known_for_org_id long, canon_id long, canon_size long",
    )
    composite = vectors.embedded(people.where("known_for_org_id IS NOT NULL"), "name", "e", embedder)
    index = vector_search.build_index(composite.withColumnRenamed("id", "vid"), "vid", F.col("e"), ["canon_id"])
    asked = spark.createDataFrame([(1, "Ann Lee", "Ann Lee, a CEO of Acme"), (2, "Bob Ray", "Bob Ray, an athlete")], "qid long, query string, description string")
    asked = vectors.embedded(asked, "query", "e", embedder).select("*", vectors.quantized(F.col("e")).alias("q"), vectors.quantized(F.col("e")).alias("iq")).drop("e")
    got = {(r.qid, r.rank): (r.canon_id, r.lookup_method) for r in search.person_search(index, None, people, asked, 5, embedder).collect()}
    assert got[(1, 1)] == (1, "composite") and got[(2, 1)] == (3, "name")


def test_name_lookup_prefers_blend(spark):
    orgs = spark.createDataFrame(
        [(1, "Securities and Exchange Commission", 1, 9, None), (2, "SEC Corp", 2, 1, None), (3, "SEC", 1, 1, 5), (4, "SEC", 2, 1, 5)], "id long, name string, canon_id long, canon_size long, alias_source_id long"
    )
    asked = spark.createDataFrame([(1, "SEC")], "qid long, query string")
    assert search.name_lookup(orgs, asked).first().canon_id == 1
    assert search.name_lookup(orgs, asked, vectors.HashedEmbedder(64)).count() == 1
    assert search.name_lookup(orgs, asked, aliases_only=True, single_only=True).count() == 0


def test_locations_are_inserted_as_one_by_one(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Paris ", "paris", "Rome", "Bonn", None]), rng.choice([None, None, "", "Q1", "q1", "Q2", "Q3"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "seq int, name string, source_identifier string")
    for start in (0, 3, 30):
        seen, want = set(), []
        for seq, name, identifier in rows:
            key = identifier.lower() if identifier else name.strip().lower() if name else None
            if seq >= start and (key is None or key in seen):
                continue
            seen |= {x for x in (name and name.strip().lower(), identifier and identifier.lower()) if x}
            if seq >= start:
                want.append(seq)
        got = upsert.insert_locations(frame.where(f"seq < {start}"), frame.where(f"seq >= {start}"), "seq")
        assert sorted(r.seq for r in got.collect()) == want


def test_people_get_roles_that_a_source_lacks(spark):
    from rollcall import schema

    tables = schema.empty_database(spark)
    fields = "id long, source_identifier string, source_id long, known_for_role string, known_for_role_id long, known_for_org_id long, from_date string"
    records = [(1, "a", 4, "Chair ", None, None, None), (2, "a", 4, "chair", None, None, None), (3, "b", 2, "chair", None, None, None), (4, "c", 4, " ", 9, None, None), (5, None, None, "Clerk", None, None, None)]
    people, roles = upsert.upsert_people(tables["people"], tables["roles"], spark.createDataFrame(records, fields), "id")
    known = {(r.name_normalized, r.source_id): r.id for r in roles.collect()}
    assert set(known) == {("chair", 4), ("chair", 2), ("clerk", None)} and len(set(known.values())) == 3
    assert sorted((r.id, r.known_for_role_id) for r in people.collect()) == [(2, known["chair", 4]), (3, known["chair", 2]), (4, 9), (5, known["clerk", None])]
    again, same = upsert.upsert_people(people, roles, spark.createDataFrame(records[:0], fields), "id")
    assert again.count() == 4 and same.count() == 3


def test_person_merges(spark):
    people = spark.createDataFrame(
        [(1, 5, "a", 1, "2020", "2021"), (2, 5, "a", 1, "2020", None), (3, None, "a", None, "2021", None), (4, None, "b", None, "2020", None), (5, None, "b", None, "2019", "2019")],
        "id long, qid long, name_normalized string, known_for_org_id long, from_date string, to_date string",
    )
    count = lambda rows: {r.kind: r.merges for r in canonicalize.person_merges(rows).collect()}
    assert count(people) == {"qid": 1, "org": 1, "date": 1}
    assert count(people.limit(0)) == {"qid": 0, "org": 0, "date": 0}
