"""Small hand-made files through the readers."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from rollcall.sources import aliases, gleif, sec, uk, wikidata
from rollcall.streaming import ingest

LEI = "5299000J2N45DDNE4Y28"


def test_gleif_forms(spark, tmp_path):
    for prefix in ("", "lei:"):
        p = prefix
        xml = (
            f"<root xmlns:lei='x'><{p}LEIRecord><{p}LEI>{LEI}</{p}LEI><{p}Entity><{p}LegalName> Acme AG </{p}LegalName><{p}LegalAddress><{p}City>Bonn</{p}City><{p}Country>DE</{p}Country></{p}LegalAddress>"
            f"<{p}EntityCategory>FUND</{p}EntityCategory></{p}Entity><{p}Registration><{p}InitialRegistrationDate>2012-01-02T00:00:00Z</{p}InitialRegistrationDate></{p}Registration></{p}LEIRecord>"
            f"<{p}LEIRecord><{p}LEI>short</{p}LEI><{p}Entity><{p}LegalName>Bad</{p}LegalName></{p}Entity></{p}LEIRecord></root>"
        )
        path = tmp_path / f"g{len(p)}.xml"
        path.write_text(xml)
        rows = gleif.read(spark, str(path)).collect()
        assert [(r.name, r.source_id, r.region, r.entity_type, r.from_date) for r in rows] == [("Acme AG", LEI, "DE", "fund", "2012-01-02")]
    objects = [
        {"id": "L1", "attributes": {"entity": {"legalName": {"name": "One"}, "otherNames": [{"name": "Uno"}, "Ein"], "legalAddress": {"country": "US"}, "category": "GENERAL"}}},
        {"LEI": "L2", "attributes": {"entity": {"legalName": {"$": "Two"}}}},
        {"id": "L3", "attributes": {"entity": {}}},
    ]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(o) for o in objects) + "\nnot json\n")
    for name in ("a.json", "b.jsonl"):
        rows = {r.source_id: r for r in gleif.read(spark, str(tmp_path / name)).collect()}
        assert set(rows) == {"L1", "L2"} and rows["L1"].entity_type == "business" and json.loads(rows["L1"].record)["other_names"] == ["Uno", "Ein"]


def test_sec(spark, tmp_path):
    one = {"cik": "320193", "name": "Apple Inc.", "entityType": "operating", "sic": "3571", "addresses": {"business": {"stateOrCountry": "CA"}}, "filings": {"recent": {"filingDate": ["2024-01-01", "1994-05-06"]}}}
    person = {"cik": "1", "name": "A Person", "entityType": "other", "sic": ""}
    with zipfile.ZipFile(tmp_path / "submissions.zip", "w") as z:
        z.writestr("CIK0000320193.json", json.dumps(one))
        z.writestr("CIK0000000001.json", json.dumps(person))
        z.writestr("other.txt", "x")
    lookup = sec.tickers(spark.createDataFrame([(json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple"}}),)], "value string"))
    rows = sec.read_submissions(spark, str(tmp_path / "submissions.zip"), lookup).collect()
    assert [(r.source_id, r.region, r.entity_type, r.from_date, json.loads(r.record)["ticker"]) for r in rows] == [("0000320193", "CA", "business", "1994-05-06", "AAPL")]
    lines = spark.createDataFrame([("4           APPLE INC   320193      2024-02-01  edgar/data/320193/0001-24-000001.txt",), ("4/A  X 1 2 3",), ("8-K x",)], "value string")
    assert [tuple(r) for r in sec.parse_form_index(lines).collect()] == [("4", "APPLE INC", "0000320193", "2024-02-01", "edgar/data/320193/0001-24-000001.txt")]
    form = (
        "head <ownershipDocument><issuer><issuerCik>0000320193</issuerCik><issuerName>Apple</issuerName></issuer><periodOfReport>2024-01-02</periodOfReport>"
        "<reportingOwner><reportingOwnerId><rptOwnerCik>0007</rptOwnerCik><rptOwnerName>COOK TIM</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>1</isOfficer><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner>"
        "<reportingOwner><reportingOwnerId><rptOwnerCik>8</rptOwnerCik><rptOwnerName>NOBODY</rptOwnerName></reportingOwnerId></reportingOwner></ownershipDocument> tail"
    )
    rows = sec.parse_insider_forms(spark.createDataFrame([(form,)], "value string")).collect()
    assert [(r.name, r.source_id, r.known_for_role, r.from_date) for r in rows] == [("Cook Tim", "7_320193", "Director, CEO", "2024-01-02")]


def test_uk(spark, tmp_path):
    (tmp_path / "uk.csv").write_text("﻿CompanyName, CompanyNumber,CompanyStatus,CompanyCategory,IncorporationDate,SICCode.SicText_1\nACME LTD,001,Active,Private Limited Company,01/02/2000,1 - x\n,002,Active,PLC,,\nOLD PLC,003,Dissolved,PLC,,\n", encoding="utf-8")
    rows = uk.read_companies(spark, str(tmp_path / "uk.csv"), active_only=True).collect()
    assert [(r.name, r.source_id, r.region, r.entity_type) for r in rows] == [("ACME LTD", "001", "United Kingdom", "business")]
    head = "DDDDSNAP".ljust(80)
    company = ("00000001" + "1").ljust(40) + "ACME<"
    officer = lambda number, corporate, name: f"{number}2   P00000000001{corporate}".ljust(32) + "20200115" + " " * 8 + "AB1 2CD " + "197001  " + " " * 8 + "0000" + f"MR<JANE MARY<{name}<<<<<<<<<SOLICITOR<BRITISH<UK<"
    lines = [head, company, officer("00000001", " ", "DOE"), officer("00000001", "Y", "CORP"), officer("00000002", " ", "ROE")]
    with zipfile.ZipFile(tmp_path / "officers.zip", "w") as z:
        z.writestr("a.dat", "\n".join(lines))
    rows = {r.name: r for r in uk.read_officers(spark, str(tmp_path / "officers.zip")).collect()}
    assert set(rows) == {"Jane Mary Doe", "Jane Mary Roe"}
    doe = rows["Jane Mary Doe"]
    assert (doe.known_for_org_name, doe.from_date, doe.birth_date, doe.person_type, rows["Jane Mary Roe"].known_for_org_name) == ("ACME", "2020-01-15", "1970-01", "legal", "")


def _claim(qid, **qualifiers):
    return {"mainsnak": {"datavalue": {"value": {"id": qid}}}, "qualifiers": {k: [{"datavalue": {"value": v}}] for k, v in qualifiers.items()}}


def _item(qid, name, claims, **more):
    return {"type": "item", "id": qid, "labels": {"en": {"value": name}}, "claims": claims, "sitelinks": {"enwiki": {"title": name}}, **more}


def test_dump(spark, tmp_path):
    entities = [
        _item("Q1", "Acme", {"P31": [_claim("Q4830453")], "P169": [_claim("Q2", P580={"time": "+2010-01-01T00:00:00Z"})]}, aliases={"en": [{"value": "ACME"}, {"value": "Acme Works"}]}),
        _item("Q2", "Ann", {"P31": [_claim("Q5")], "P39": [_claim("Q484876", P108={"id": "Q9"}), _claim("Q50")], "P106": [_claim("Q60")]}),
        _item("Q3", "Bob", {"P31": [_claim("Q5")], "P108": [_claim("Q1")]}),
        _item("Q4", "Bonn", {"P31": [_claim("Q515")], "P131": [_claim("Q70")], "P17": [_claim("Q183"), _claim("Q70")], "P625": [{"mainsnak": {"datavalue": {"value": {"latitude": 1.5, "longitude": 2.5}}}}]}),
        _item("Q60", "painter of x", {"P279": [_claim("Q1028181")]}),
        {"type": "property", "id": "P1"},
    ]
    (tmp_path / "dump.json").write_text("[\n" + ",\n".join(json.dumps(e) for e in entities) + ",\n{broken,\n]\n")
    items = wikidata.read_dump(spark, str(tmp_path / "dump.json"))
    assert items.count() == 5
    classes = wikidata.closure(wikidata.subclass_edges(items), wikidata.class_table(spark))
    assert classes.where("qid = 'Q60'").first().type == "artist"
    rows = wikidata.routed(items, classes, require_article=True)
    assert {r.id: r.route for r in rows.collect()} == {"Q1": "organization", "Q2": "person", "Q3": "person", "Q4": "location"}
    org = wikidata.organizations(rows).first()
    record = json.loads(org.record)
    assert (org.entity_type, record["wikidata_aliases"], record["executives"]) == ("business", ["Acme Works"], [{"person_qid": "Q2", "role": "chief executive officer", "start_date": "2010-01-01"}])
    reverse = spark.createDataFrame([("Q2", "Q1", "chief executive officer", "2010-01-01", None)], "person_qid string, org_qid string, role string, start_date string, end_date string")
    own = spark.createDataFrame([("Q50", "Q51")], "qid string, org_qid string")
    people = [(r.id, r.role_qid, r.org_qid, r.person_type) for r in wikidata.person_rows(rows, classes, own, reverse).orderBy("id", "step", "at").collect()]
    assert people == [("Q2", "Q484876", "Q9", "executive"), ("Q2", "Q50", "Q51", "executive"), ("Q2", None, "Q1", "executive"), ("Q2", "Q60", None, "executive"), ("Q3", None, "Q1", "unknown")]
    place = wikidata.locations(rows).first()
    assert place.parent_qids == ["Q70", "Q183"] and json.loads(place.record)["coordinates"] == {"lat": 1.5, "lon": 2.5}


def test_closure_reaches_every_level(spark):
    """A chain deeper than any fixed number of rounds, with a cycle at its end."""
    chain = [(f"C{k + 1}", f"C{k}") for k in range(20)] + [("C18", "C20")]
    edges = spark.createDataFrame(chain, "child string, parent string")
    found = wikidata.closure(edges, spark.createDataFrame([("C0", "occupation", "artist")], "qid string, kind string, type string"))
    assert sorted((r.qid, r.kind, r.type) for r in found.collect()) == sorted((f"C{k}", "occupation", "artist") for k in range(21))


def test_aliases(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("type\twikidata_id\tname\tlanguage\nORG\tQ1\tBig Blue\ten\nPER\tQ1\tX\ten\nORG\tQ1\tBleu\tfr\n")
    orgs = spark.createDataFrame([(1, 1, "ibm", None), (2, 1, "ibm alias", 5)], "id long, qid long, name_normalized string, alias_source_id long")
    found = aliases.paraname_aliases(aliases.read_paranames(spark, str(tmp_path / "p.tsv")), orgs).collect()
    assert [(r.org_id, r.name_normalized) for r in found] == [(1, "big blue")]
    anchors = spark.createDataFrame([("the company", "IBM"), ("ibm", "IBM"), ("x", "nobody")], "anchor_text string, title string")
    assert [(r.org_id, r.name_normalized) for r in aliases.anchor_aliases(anchors, orgs).collect()] == [(1, "the")]


def test_ingest_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    parse = lambda lines: lines.select(F.get_json_object("value", "$.id").alias("id"))
    run = lambda: ingest.ingest(ingest.read_lines(spark, str(folder), "*.jsonl"), parse, ["id"], str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    (folder / "a.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    run()
    (folder / "b.jsonl").write_text('{"id": "2"}\n{"id": "3"}\n')
    run()
    run()
    assert sorted(r.id for r in ingest.ingested(spark, str(tmp_path / "table")).collect()) == ["1", "2", "3"]
