"""Common forms of parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COMPANY = ["name", "source", "source_id", "region", "entity_type", "from_date", "to_date", "record"]
PERSON = [
    "name", "source", "source_id", "country", "person_type", "known_for_role", "known_for_org_name", "from_date", "to_date", "birth_date", "record",
]


def text(column: str | Column) -> Column:
    """Trimmed text; blank counts as missing."""
    return F.nullif(F.trim(F.col(column) if isinstance(column, str) else column), F.lit(""))


def company(rows: DataFrame, source: str, record: Column, **values: Column) -> DataFrame:
    given = {"source": F.lit(source), "record": record, **values}
    return rows.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in COMPANY])


def person(rows: DataFrame, source: str, record: Column, **values: Column) -> DataFrame:
    given = {"source": F.lit(source), "record": record, **values}
    return rows.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in PERSON])
