"""Accuracy of the trained operators on labelled rows of the driver's tables that the fit has not seen."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollcall.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


def figures(rows):
    """Share of right answers, precision and recall of ``(label, predicted)`` pairs."""
    both = sum(y and p for y, p in rows)
    return sum(y == p for y, p in rows) / len(rows), both / max(1, sum(p for _, p in rows)), both / max(1, sum(y for y, _ in rows))


def test_quality_held_out(tables):
    docs, labels = tables
    apart = F.col("doc_id") % 5 == 0
    scored = quality.QualityModel(docs, labels.where(~apart)).score(docs)
    rows = [(bool(r.quality), r.probability >= quality.KEEP_PROBABILITY) for r in scored.join(labels.where(apart), "doc_id").collect()]
    accuracy, precision, recall = figures(rows)
    print(f"quality: {len(rows)} rows, accuracy {accuracy:.3f}, precision {precision:.3f}, recall {recall:.3f}, base rate {sum(y for y, _ in rows) / len(rows):.3f}")
    assert accuracy > 0.95 and precision > 0.95 and recall > 0.97


def test_toxicity_held_out(tables):
    docs, labels = tables
    scored = toxicity.ToxicityModel(docs, labels).score(docs).where("held_out")
    rows = [(bool(r.toxic), bool(r.predicted)) for r in scored.join(labels, "doc_id").collect()]
    accuracy, precision, recall = figures(rows)
    print(f"toxicity: {len(rows)} rows, accuracy {accuracy:.3f}, precision {precision:.3f}, recall {recall:.3f}, base rate {sum(y for y, _ in rows) / len(rows):.3f}")
    assert precision > 0.9 and recall > 0.88
