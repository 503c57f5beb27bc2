"""All queries over the driver tables by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans import entity_queries, entity_sql, lookup_queries, matching_queries, range_queries, record_queries, search_queries, source_queries, vector_queries
from rollcall.stage import stage_root
from rollcall.streaming import ingest

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a file stream into a table, each once."""
    place = f"{stage_root(spark)}/rollcall-ingest-{uuid.uuid4().hex}"
    rows = ingest.read_table(spark, sf_dir, "events.parquet", EVENTS)
    ingest.ingest(rows, lambda batch: batch.select("event_id", "user_id", "event_type", "value"), ["event_id"], f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return ingest.ingested(spark, f"{place}/table")


def queries() -> dict:
    return vector_queries.QUERIES | entity_queries.QUERIES | lookup_queries.QUERIES | source_queries.QUERIES | search_queries.QUERIES | record_queries.QUERIES | range_queries.QUERIES | matching_queries.QUERIES | {"stream_ingest": stream_ingest}


def oracle_sql() -> dict[str, str]:
    return vector_queries.ORACLE | entity_sql.ORACLE | lookup_queries.ORACLE | source_queries.ORACLE | search_queries.ORACLE | record_queries.ORACLE | range_queries.ORACLE | matching_queries.ORACLE | {"stream_ingest": "SELECT event_id, user_id, event_type, value FROM events"}
