"""Links of officers, the jobs after an import, and the person search through all its tiers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rollcall import schema
from rollcall.functions import vectors
from rollcall.operators import jobs, links, requests


def _table(spark, fields, rows):
    names = [f.split()[0] for f in fields.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fields)


def _database(spark):
    orgs = _table(spark, schema.ORGANIZATIONS, [
        {"id": 1, "name": "Acme Inc.", "source_id": 2, "source_identifier": "0000000042", "record": json.dumps({"other_names": ["The Acme"]})},
        {"id": 2, "name": "Blue Ltd", "source_id": 3, "source_identifier": "007", "record": "{}"},
        {"id": 3, "name": "Blue Limited", "source_id": 1, "source_identifier": "LEI7", "record": "{}"},
        {"id": 9, "name": "bluey", "source_id": 3, "source_identifier": "007", "alias_source_id": 8, "record": "{}"},
    ])
    people = _table(spark, schema.PEOPLE, [
        {"id": 1, "name": "Dr. Ann Lee", "source_id": 2, "source_identifier": "a", "record": json.dumps({"issuer_cik": "42"}), "known_for_org_id": 3, "person_type_id": 1},
        {"id": 2, "name": "Bob Ray", "source_id": 3, "source_identifier": "b", "record": json.dumps({"company_number": "007", "company_name": "x"}), "person_type_id": 1},
        {"id": 3, "name": "Cy Fox", "source_id": 3, "source_identifier": "c", "record": json.dumps({"company_number": "99", "company_name": "New Co"}), "person_type_id": 1},
        {"id": 4, "name": "Di Orr", "source_id": 3, "source_identifier": "d", "record": json.dumps({"company_number": "99", "company_name": "New Company"})},
        {"id": 5, "name": "Ed Poe", "source_id": 3, "source_identifier": "e", "record": "not json"},
        {"id": 6, "name": "Flo Ash", "source_id": 3, "source_identifier": "f", "record": json.dumps({"company_number": "98"}), "known_for_org_id": 2},
        {"id": 7, "name": "Gus May", "source_id": 2, "source_identifier": "g", "record": json.dumps({"issuer_cik": "43"})},
        {"id": 8, "name": "Hal Orr", "source_id": 4, "source_identifier": "h", "record": None},
    ])
    return orgs, people


def test_links(spark):
    orgs, people = _database(spark)
    assert {r.id: r.known_for_org_id for r in links.link_issuers(people, orgs).collect()} == {1: 1, 2: None, 3: None, 4: None, 5: None, 6: 2, 7: None, 8: None}
    more, linked = links.link_officers(people, orgs)
    stubs = [r for r in more.collect() if r.id > 9]
    assert [(r.id, r.name, r.source_id, r.source_identifier, r.name_normalized) for r in stubs] == [(10, "New Co", 3, "99", stubs[0].name_normalized)] and stubs[0].name_normalized
    assert {r.id: r.known_for_org_id for r in linked.collect()} == {1: 3, 2: 2, 3: 10, 4: 10, 5: None, 6: 2, 7: None, 8: None}
    again, same = links.link_officers(linked, more)
    assert again.count() == more.count() and sorted(map(str, same.collect())) == sorted(map(str, linked.collect()))


def test_jobs_after_an_import_and_all_tiers(spark):
    orgs, people = _database(spark)
    told = people.withColumns({"role_name": F.when(F.col("id") < 4, "director"), "org_name": F.when(F.col("id") == 1, "Acme").when(F.col("id") == 2, "Blue")})
    embedder = vectors.HashedEmbedder(48)
    done = links.post_import(orgs, told, embedder, 16)
    made = {(r.name_normalized, r.alias_source_id) for r in done["organizations"].collect()}
    assert ("the acme", 6) in made or any(via == 6 for _, via in made)
    groups = {r.id: r.canon_id for r in done["organizations"].collect() if r.alias_source_id is None}
    assert groups[2] == groups[3] == 3 and groups[1] == 1
    assert done["identity_index"].count() == 8 and done["composite_index"].count() == 2 and done["organization_index"].count() == 4
    asked = spark.createDataFrame([
        (1, "Dr. Ann Lee", "executive", "director", "Acme"),  # the composite match settles it
        (2, "Cy Fox", "executive", None, None),  # by name
        (3, "Flo Asch", "executive", None, None),  # nobody of that name: the nearest names
    ], "qid long, query string, person_type string, role string, org string")
    found = requests.people(done["composite_index"], done["identity_index"], done["people"], asked, embedder, 3, 16).collect()
    first = {r.qid: (r.canon_id, r.lookup_method) for r in found if r["rank"] == 1}
    assert first == {1: (1, "composite"), 2: (3, "name"), 3: (6, "identity")}


def test_countries_are_seeded_once(spark):
    places = _table(spark, schema.LOCATIONS, [{"id": 1, "name": "France", "source_identifier": "fr", "location_type_id": 2}, {"id": 2, "name": "XX", "source_identifier": "DE", "location_type_id": 19}])
    seeded = {r.source_identifier for r in jobs.seed_countries(places).collect()}
    assert "FR" not in seeded and {"DE", "GB", "US"} <= seeded and len(seeded) > 200
