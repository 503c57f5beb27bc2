"""Archives, arrays and a dump written from the driver tables and read back in parts, with their SQL counterparts."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.plans import source_queries
from rollcall.plans.tables import table
from rollcall.session import ship_package
from rollcall.sources import gleif, ranges, sec, uk
from rollcall.stage import stage_root, task_count
from rollcall.streaming import ingest

#: Small parts, so that small tables' files have several; what is larger is cut into some hundreds of parts of at most the readers' own size.
PART_BYTES, PARTS = 64 << 10, 512


def _folder(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/rollcall-{name}-{uuid.uuid4().hex}"


def _out(folder: str, name: str) -> tuple:
    system, place = ranges.located(folder)
    system.create_dir(place, recursive=True)
    return system, f"{place}/{name}"


def _save(folder: str, suffix: str, write: Callable) -> Callable:
    """A task's rows into one file, which is there when it is whole; a retry writes it anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = _out(folder, f"part-{task.partitionId():05d}{suffix}")
        mine = f"{path}.{task.taskAttemptId()}.tmp"
        with system.open_output_stream(mine) as out:
            write(out, (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])))
        system.move(mine, path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return run


def _array(out, rows: Iterator[tuple]) -> None:
    between = b"[\n"
    for (value,) in rows:
        out.write(between + value.encode())
        between = b",\n"
    out.write(b"\n]" if between == b",\n" else b"[]")


def _archive(out, rows: Iterator[tuple], packed: bool = True) -> None:
    """Rows of one member's name in a row are its lines."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as archive:
        for name, lines in groupby(rows, lambda row: row[0]):
            with archive.open(name, "w") as member:
                while held := [value for _, value in islice(lines, 4096)]:
                    member.write("\n".join([*held, ""]).encode())


def _written(rows: DataFrame, name: str, suffix: str, write: Callable) -> str:
    spark = rows.sparkSession
    ship_package(spark)
    folder = _folder(spark, name)
    rows.mapInArrow(_save(folder, suffix, write), "path string").write.format("noop").mode("overwrite").save()
    return f"{folder}/*{suffix}"


def _part_bytes(spark: SparkSession, path: str) -> int:
    size = ranges.listed(spark, path).agg(F.sum("size")).first()[0] or 0
    return min(max(PART_BYTES, size // PARTS), ranges.RANGE_BYTES)


def gleif_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as objects of JSON arrays, cut at object borders when read."""
    path = _written(source_queries.gleif_objects(spark, sf_dir).repartition(4), "arrays", ".json", _array)
    found = gleif.parse_json(ranges.array_objects(spark, path, PART_BYTES), active_only=True)
    return source_queries.gleif_columns(found)


def submission_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of submission archives, read in runs of members."""
    rows, lookup = source_queries.submission_objects(spark, sf_dir)
    name = F.concat(F.lit("CIK"), F.lpad(F.get_json_object("value", "$.cik"), 10, "0"), F.lit(".json"))
    path = _written(rows.select(name.alias("name"), "value").repartition(4), "submissions", ".zip", _archive)
    found = sec.parse_submissions(ranges.zip_members(spark, path, "CIK*.json", PART_BYTES), lookup)
    return source_queries.submission_columns(found)


def officer_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored members with the officers' lines of a nation's companies, cut at lines when read; each archive has a range of nations and companies."""
    lines = source_queries.officer_lines(spark, sf_dir)
    # A company's lines lie in one range, so in one member; a nation may lie in several archives.
    placed = lines.withColumn("company", F.col("at.c_custkey")).repartitionByRange(max(5, task_count(lines)), "file", "company")
    laid = placed.sortWithinPartitions("file", "at")
    path = _written(laid.select(F.concat("file", F.lit(".dat")).alias("name"), "value"), "officers", ".zip", lambda out, rows: _archive(out, rows, packed=False))
    found = uk.parse_officers(ranges.zip_lines(spark, path, "*.dat", _part_bytes(spark, path)))
    return source_queries.officer_columns(found)


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    record: list[Column] = [F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")]
    return table(spark, sf_dir, "orders").select(F.to_json(F.struct(*record)).alias("value"))


def _parsed(lines: DataFrame) -> DataFrame:
    field = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return lines.select(field("id", "long"), field("customer", "long"), field("status", "string"))


def dump_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a dump, each there twice, read as a stream that stops within a file and goes on from there."""
    folder = _folder(spark, "dump")
    rows = _order_lines(spark, sf_dir)
    rows.union(rows).write.text(f"{folder}/dump")
    size = sum(n for *_, n in ranges.dump_files(f"{folder}/dump"))
    for batch_bytes in (size // 3, size // 3, 0):  # each run is a new query that knows nothing but the checkpoint
        lines = ranges.stream_dump(spark, f"{folder}/dump", f"{folder}/checkpoint", batch_bytes, max(size // 16, 1 << 16))
        ingest.ingest(lines, _parsed, ["id"], f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return ingest.ingested(spark, f"{folder}/table")


QUERIES = {f.__name__: f for f in (gleif_arrays, submission_archives, officer_archives, dump_resumed)}
ORACLE = {
    "gleif_arrays": source_queries.ORACLE["gleif_records"],
    "submission_archives": source_queries.ORACLE["sec_submissions"],
    "officer_archives": source_queries.ORACLE["uk_officers"],
    "dump_resumed": "SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status FROM orders",
}
