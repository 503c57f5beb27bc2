"""Golden facts of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollcall.functions import dates, names, regions, vectors


def _map(spark, values, expression, schema="x string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + schema)
    return [r.y for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]


def test_company_names(spark):
    given = ["Apple Inc.", "", "Ltd", "Acme Ltd", "Acme Limited", "apple inc", "Amazon.com, Inc.", "SEC", None]
    assert _map(spark, given, names.normalize_company(F.col("x"))) == ["apple", "", "", "acme", "acme", "apple", "amazon com", "", None]


def test_person_names(spark):
    given = ["Dr. John Smith", "John Smith Jr.", "Prof. Jane Doe PhD", "Jane Doe", "", "Dr.", "Dr. Robert S. Mueller III", "Bob Jones"]
    expected = ["john smith", "john smith", "jane doe", "jane doe", "", "", "robert mueller", "robert jones"]
    assert _map(spark, given, names.normalize_person(F.col("x"))) == expected


def test_regions(spark):
    rows = spark.createDataFrame([(x,) for x in ("US", "UK", "", "GBR", "USA", "CA", "NY", "nowhere", None)], "r string")
    found = {r.r: r.code for r in regions.with_region_code(rows, "r", "code").collect()}
    assert found == {"US": "US", "UK": "GB", "": "", "GBR": "GB", "USA": "US", "CA": "CA", "NY": "US", "nowhere": "", None: ""}


def test_regions_match(spark):
    pairs = [("US", "US"), ("", "US"), ("GB", ""), ("US", "GB")]
    assert _map(spark, pairs, regions.regions_match(F.col("a"), F.col("b")), "a string, b string") == [True, True, True, False]


def test_search_terms(spark):
    terms = _map(spark, ["Apple Inc", "A Big Company", "AI", "one three five seven nine"], names.search_terms(F.col("x")))
    assert terms == [["Apple", "Inc"], ["Company", "Big"], ["AI"], ["three", "seven", "five"]]


@pytest.mark.parametrize(
    ("kind", "role", "org", "text"),
    [
        ("executive", "CEO", "Apple Inc", "N, a CEO of Apple Inc"), ("executive", "CEO", None, "N, a CEO"), ("executive", None, "Apple Inc", "N of Apple Inc"), ("executive", None, None, "N"),
        ("government", "Chair", "Federal Reserve", "N, a Chair at Federal Reserve"), ("journalist", "anchor", "CNN", "N, an anchor at CNN"), ("artist", "singer", "X", "N, an artist"),
        ("unknown", None, None, "N"), ("unknown", "engineer", "Google", "N, an engineer at Google"), (None, None, "Google", "N at Google"),
    ],
)
def test_person_text(spark, kind, role, org, text):
    row = spark.createDataFrame([("N", kind, role, org)], "n string, k string, r string, o string")
    made = names.describe_person(F.col("n"), F.col("k"), F.col("r"), F.col("o"), labels_without_role=False)
    assert row.select(made.alias("t")).first().t == text


def test_levenshtein_and_matching(spark):
    pairs = [("Abc", "abc"), ("", "x"), ("kitten", "sitting")]
    assert _map(spark, pairs, F.round(names.levenshtein_ratio(F.col("a"), F.col("b")), 6), "a string, b string") == [1.0, 0.0, round(1 - 3 / 7, 6)]
    pairs = [("Acme Inc", "ACME"), ("Ring", "Ringworld Corp"), ("AB", "ABC")]
    assert _map(spark, pairs, names.org_names_match(F.col("a"), F.col("b")), "a string, b string") == [True, True, False]


def test_title_case_and_ids(spark):
    assert _map(spark, ["o'neil  de la-cruz", ""], names.title_case(F.col("x"))) == ["O'Neil De La-Cruz", ""]
    assert _map(spark, ["Q312", "P31", ""], names.entity_number(F.col("x"))) == [312, None, None]
    assert _map(spark, ["320193", "12345678901"], names.zero_filled(F.col("x"))) == ["0000320193", "12345678901"]
    assert _map(spark, ["edgar/data/1/0001-20-000003.txt"], names.accession_number(F.col("x"))) == ["0001-20-000003"]


def test_dates(spark):
    assert _map(spark, ["+2020-01-15T00:00:00Z", "-0044-03-15T00:00:00Z"], dates.entity_date(F.col("x"))) == ["2020-01-15", "-0044-03-15"]
    assert _map(spark, ["1999", "2020-01-15T00:00:00Z"], dates.binding_date(F.col("x"))) == ["1999-01-01", "2020-01-15"]
    assert _map(spark, ["20200115", "202001", "2020", ""], dates.compact_date(F.col("x"))) == ["2020-01-15", "2020-01", None, None]
    assert _map(spark, ["2020-01", "", None], dates.inverted(F.col("x"))) == ["7979-98", "", ""]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, -1.0, 0.0], [0.0, 0.0, 2.0])], "a array<float>, b array<float>")
    got = rows.select(
        vectors.quantized(F.col("a")).alias("q"), vectors.cosine(F.col("a"), F.col("a")).alias("same"), vectors.cosine(F.col("a"), F.col("b")).alias("other"),
        vectors.composite_vector(F.col("a"), F.lit(None).cast("array<float>"), F.col("b"), 3).alias("c"), vectors.normalized(F.array(F.lit(0.0))).alias("zero"),
    ).first()
    assert list(got.q) == [127, -127, 0]
    assert got.same == pytest.approx(1.0) and got.other == 0.0 and got.zero == [0.0]
    assert sum(x * x for x in got.c) == pytest.approx(1.0) and got.c[3:6] == [0.0, 0.0, 0.0] and got.c[8] == pytest.approx(4 / 80**0.5)
