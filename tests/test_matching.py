"""Misspelt names, texts within names, request calls, graph patterns and kept embeddings."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions import regions, vectors
from rollcall.operators import fuzzy, patterns, requests
from rollcall.operators.embedding_cache import EmbeddingCache
from rollcall.sources import wikidata


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    swapped = row[-1] == 2 and len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))
    return 1 if swapped else row[-1]


def _allowed(text):
    n = len(text)
    return 0 if n <= 3 else 1 if n <= 7 else 2 if n <= 60 else 0


def test_nearest_names_equal_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    known = sorted({word(rng.randrange(0, 13)) for _ in range(150)} | {"x" * 61, "y" * 60})
    texts = [word(rng.randrange(0, 13)) for _ in range(150)] + ["x" * 60, "x" * 61, "x" * 62, "y" * 59, "y" * 58 + "zz", None, None, known[3], known[3]]
    for name in known[::3]:
        for _ in range(2):
            at = rng.randrange(len(name) + 1)
            texts.append(rng.choice([name[: at - 2] + name[at - 2 : at][::-1] + name[at:] if at > 1 else name, name[:at] + name[at + 1 :], name[:at] + "q" + name[at:], name[:at] + "q" + name[at + 1 :]]))
    frame = spark.createDataFrame([(k, i % 3) for i, k in enumerate(known)], "key string, code int")
    got = {r.text: (r.key, r.distance) for r in fuzzy.nearest_names(spark.createDataFrame([(t,) for t in texts], "text string"), frame, order=["code"]).collect()}
    want = {}
    for t in set(texts) - {None}:
        near = sorted((_distance(t, k), i % 3, k) for i, k in enumerate(known) if _distance(t, k) <= _allowed(t))
        if near:
            want[t] = (near[0][2], near[0][0])
    assert got == want and sum(d > 0 for _, d in want.values()) > 40


def test_regions_that_are_misspelt(spark):
    subdivisions = spark.createDataFrame([("CA-ON", "Ontario"), ("DE-BY", "Bayern"), (None, "Nowhere"), ("US-GA", None)], "code string, name string")
    table = regions.region_table(spark, subdivisions=subdivisions)
    texts = {"Untied Kingdom": "GB", "united kindom": "GB", "Frnace": "FR", " germny ": "DE", "Ontaro": "CA", "Bayernn": "DE", "Califronia": "US", "fr": "FR", "fq": "", "qqqqqqqq": "", "": "", "UK": "GB"}
    given = spark.createDataFrame([(t,) for t in texts] + [(None,)], "region string")
    got = {r.region: r.code for r in regions.with_near_region_code(given, "region", "code", table).collect()}
    assert got == texts | {None: ""}
    exact = {r.region: r.code for r in regions.with_region_code(given, "region", "code", table).collect()}
    assert exact["UK"] == "GB" and exact["Frnace"] == ""


def _names(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", " ".join("".join(rng.choice("aAbBé%_'") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4)))])) for i in range(n)]


def test_equal_requests_are_searched_once(spark, monkeypatch):
    """Requests with equal texts gave a pair each with every row, those that equal a name too; rows as before."""
    table = spark.createDataFrame([(i, f"Name {i % 40}", f"name {i % 40}") for i in range(200)] + [(900, None, "name 1"), (901, "Other", "name 77")], "id long, name string, name_normalized string")
    asked = [(i, ["AME 1", " ame 1", "name 7", "Name 7 ", " ", "name 77", "zz"][i % 7]) for i in range(70)]
    queries, seen, search = spark.createDataFrame(asked, "qid long, query string"), [], fuzzy._holders
    monkeypatch.setattr(fuzzy, "_holders", lambda table, texts, *rest: seen.append(sorted(r[0] for r in texts.collect())) or search(table, texts, *rest))
    for alone in (True, False):
        found = {(r.qid, r.id, r.rank, r.score) for r in fuzzy.contains_search(table, queries, 3, alone).collect()}
        want, names = set(), [(i, f"name {i % 40}") for i in range(200)]
        for qid, text in asked:
            if text := text.strip().lower():
                best = sorted((not (alone and n == text), len(n), i, n) for i, n in names if text in n)
                best = best[:1] if best and not best[0][0] else best[:3]
                want |= {(qid, i, nth, 1.0 if n == text else 0.9 if n.startswith(text) else 0.7) for nth, (_, _, i, n) in enumerate(best, 1)}
        assert found == want
    assert seen == [["ame 1", "name 77", "zz"], ["ame 1", "name 7", "name 77", "zz"]]


def test_contains_equals_like(spark):
    rows = _names(1, 400)
    table = spark.createDataFrame([(i, n, (n or "").lower()) for i, n in rows], "id long, name string, name_normalized string")
    queries = [(q, t) for q, t in enumerate(["a", "ab", "ABa", "%", "_'", "é", "b a", "aaaaaaaaaaaa", " ", "", None, "bab  ", "zz", rows[7][1], "abab"])]
    asked = spark.createDataFrame(queries, "qid long, query string")
    found = {(r.qid, r.id) for r in fuzzy.containing(table, asked).collect()}
    assert found == {(q, i) for q, t in queries for i, n in rows if t and t.strip() and n and t.strip().lower() in n.lower()}
    got = {}
    for r in requests.roles(table, asked, 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    for q, t in queries:
        text = (t or "").strip().lower()
        hits = sorted(((n.lower() != text, len(n), i, n) for i, n in rows if text and n and text in n.lower()))[:4]
        if hits and not hits[0][0]:
            hits = hits[:1]
        assert sorted(got.get(q, [])) == [(k, i, 1.0 if not other else 0.9 if n.lower().startswith(text) else 0.7) for k, (other, _, i, n) in enumerate(hits, 1)]


def test_request_calls(spark):
    """All five calls, for several requests at once."""
    embedder = vectors.HashedEmbedder(24)
    names = ["Acme Energy", "Acme Bank", "Blue Ring Holdings", "Northern Light"]
    orgs = spark.createDataFrame([(i, n, "gleif", f"L{i}", i, 1, None, n.lower()) for i, n in enumerate(names, 1)], "id long, name string, source string, source_identifier string, canon_id long, canon_size long, alias_source_id long, name_normalized string")
    whole = vectors.embedded(orgs, "name", "e", embedder).withColumn("v", vectors.quantized(vectors.normalized(F.col("e"))))
    index = whole.select("id", "v", "canon_id", "source")
    asked = spark.createDataFrame([(1, "Acme Energy"), (2, "Blue Ring Holding"), (3, "Northern Lights")], "qid long, query string")
    found = requests.organizations(index, orgs, asked, embedder, 2)
    assert {(r.qid, r.canon_id) for r in found.collect() if r["rank"] == 1} == {(1, 1), (2, 3), (3, 4)}
    resolved = requests.resolve(index, orgs, asked, embedder, 0.5)
    assert {r.qid for r in resolved.collect()} == {1, 2, 3}
    types = spark.createDataFrame([(1, "city"), (2, "country")], "id long, simplified string")
    places = spark.createDataFrame([(1, "New York", "new york", 1), (2, "York", "york", 1), (3, "Yorkland", "yorkland", 2)], "id long, name string, name_normalized string, location_type_id long")
    where = spark.createDataFrame([(1, "york"), (2, "land"), (3, "x")], "qid long, query string")
    assert [(r.qid, r.id, r["rank"]) for r in sorted(requests.locations(places, types, where).collect(), key=lambda r: (r.qid, r["rank"]))] == [(1, 2, 1), (1, 1, 2), (1, 3, 3), (2, 3, 1)]
    assert [(r.qid, r.id) for r in requests.locations(places, types, where, simplified_type="country").orderBy("qid").collect()] == [(1, 3), (2, 3)]
    assert requests.locations(places, types, where, simplified_type="planet").collect() == []


def test_perturbed_names_and_accuracy(spark):
    rows = [(1, "William Henry Gates"), (2, "Ann Lee"), (3, "x"), (4, None), (5, "Solo"), (6, "aa")]
    asked = fuzzy.perturbed(spark.createDataFrame(rows, "id long, name string")).collect()
    by = {(r.id, r.kind): r.query for r in asked}
    assert by[1, "nickname"] == "bill Henry Gates" and by[1, "last word alone"] == "Gates" and by[1, "without last word"] == "William Henry"
    assert (5, "last word alone") not in by and (6, "swapped") not in by and not {3, 4} & {i for i, _ in by}
    for (i, kind), query in by.items():
        name = dict(rows)[i]
        assert query != name
        if kind in ("swapped", "dropped letter", "doubled letter", "other letter"):
            assert _distance(name, query) == 1
        if kind == "swapped":
            assert sorted(query) == sorted(name) and sum(a != b for a, b in zip(query, name)) == 2
    assert asked == fuzzy.perturbed(spark.createDataFrame(rows, "id long, name string")).collect()
    questions = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), ("c", "k", 3), ("d", "l", 4)], "qid string, kind string, id long")
    found = spark.createDataFrame([("a", 1, 1), ("a", 9, 2), ("b", 8, 1), ("b", 2, 2), ("c", 3, 11)], "qid string, id long, rank int")
    got = {r.kind: (r.queries, r.acc_at_1, r.acc_at_k) for r in fuzzy.accuracy_by_kind(questions, found).collect()}
    assert got == {"k": (3, pytest.approx(1 / 3), pytest.approx(2 / 3)), "l": (1, 0.0, 0.0)}


def _entity(qid, label, site=True, **claims):
    snak = lambda v: {"mainsnak": {"datavalue": {"value": {"id": v} if v.startswith("Q") else {"time": v} if v.startswith("+") else v}}}
    return json.dumps({
        "type": "item", "id": qid, "labels": {"en": {"value": label}} if label else {}, "descriptions": {"en": {"value": f"about {label}"}} if label else {}, "sitelinks": {"enwiki": {"title": "x"}} if site else {},
        "claims": {p: [snak(v) for v in (vs if isinstance(vs, list) else [vs])] for p, vs in claims.items()},
    })


def test_patterns(spark):
    lines = [
        _entity("Q1", "Acme", P31=["Q891723", "Q4830453"], P1278="LEI1", P249=["B", "A"], P17="Q30", P571="+1990-01-02T00:00:00Z", P112=["Q51", "Q52", "Q51"]),
        _entity("Q2", None, P31="Q891723", P414="Q77", P17="Q99"), _entity("Q30", "United States"), _entity("Q77", "Exchange"),
        _entity("Q51", "Ann", P31="Q5", P39="Q100", P106="Q200", P27="Q30"), _entity("Q52", "Bob", site=False, P31="Q5", P39="Q100", P106="Q202"),
        _entity("Q53", "Cy", P31="Q5", P39=["Q101", "Q9"], P106="Q202"), _entity("Q54", "Di", P31="Q5", P39="Q102"), _entity("Q101", "an instance", P31="Q100"),
        _entity("Q201", "b", P279="Q200"), _entity("Q202", "c", P279=["Q201", "Q203"]), _entity("Q200", "a", P279="Q202"),
    ]
    entities = wikidata.parse_dump(spark.createDataFrame([(line,) for line in lines], "value string"))
    facts = patterns.triples(entities)
    found = lambda p: {r.id: r for r in patterns.matches(facts, entities, p).collect()}
    public = found(patterns.ORGANIZATION_PATTERNS["public_company"])
    assert public.keys() == {"Q1", "Q2"}
    assert (public["Q1"].ticker, public["Q1"].country_label, public["Q1"].inception, public["Q1"].lei) == ("A", "United States", "1990-01-02", "LEI1")
    assert (public["Q2"].label, public["Q2"].country, public["Q2"].country_label, public["Q2"].lei) == ("Q2", "Q99", "Q99", None)
    assert found(patterns.ORGANIZATION_PATTERNS["lei"]).keys() == {"Q1"}
    listed = found(patterns.ORGANIZATION_PATTERNS["ticker"])
    assert listed.keys() == {"Q2"} and listed["Q2"].exchange_label == "Exchange"
    assert found(patterns.position_pattern("Q100")).keys() == {"Q51", "Q53"}  # Bob has no article, Di another position
    assert found(patterns.occupation_pattern("Q200")).keys() == {"Q51"}
    assert found(patterns.occupation_pattern("Q201", below=True)).keys() == {"Q51", "Q53"}  # the subclasses form a circle
    founders = found(patterns.founder_pattern())
    assert founders.keys() == {"Q51"} and founders["Q51"].description == "about Ann" and founders["Q51"].country_label == "United States"
    rows = patterns.matches(facts, entities, patterns.Pattern((patterns.Claim("P31"),)))
    pages, after = [], None
    while got := [r.id for r in patterns.page(rows, after, 2).collect()]:
        pages += got
        after = got[-1]
    assert pages == sorted(r.id for r in rows.collect()) and len(pages) == 7


def test_embeddings_are_kept(spark, tmp_path):
    class Refusing:
        dims = 16

        def embed_batch(self, texts):
            if texts:
                raise RuntimeError("asked again")

    df = spark.createDataFrame([(1, "a b", "x"), (2, "a b", None), (3, None, "a b"), (4, "", "y" * 5000)], "id long, one string, two string")
    embedder = vectors.HashedEmbedder(16)
    cache = EmbeddingCache(spark, str(tmp_path), embedder, "m")
    first = {r.id: (r.one_vector, r.two_vector) for r in cache.embedded(df, ["one", "two"]).collect()}
    want = lambda t: None if t is None else pytest.approx(embedder.embed_batch([t])[0].tolist())
    assert first == {r.id: (want(r.one), want(r.two)) for r in df.collect()}
    again = EmbeddingCache(spark, str(tmp_path), Refusing(), "m")
    assert {r.id: (r.one_vector, r.two_vector) for r in again.embedded(df, ["one", "two"]).collect()} == first
    cache.add(spark.createDataFrame([("new",), ("a b",)], "t string"), "t")
    assert cache.table().count() == 5
    with pytest.raises(Exception, match="asked again"):
        EmbeddingCache(spark, str(tmp_path), Refusing(), "other model").embedded(df, ["one"]).collect()
