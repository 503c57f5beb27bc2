"""Streaming ingest: lines that arrive are parsed and appended once, resuming where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Where the keys that were seen are held: on the executors' disks, with changes in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], keys: list[str], table: str, checkpoint: str, at_once: bool = True) -> StreamingQuery:
    """Parse a stream of lines and append the first row of each key to the Parquet ``table``.

    The keys seen are state of the query, partitioned by key in a state store, so a batch costs what it reads, however
    large the table is.  Each batch is a folder of the table that a retry writes anew, so it adds nothing twice; the
    checkpoint holds the state and how far the input was read.  ``parse`` must work on streams.  With ``at_once`` the
    query ends when all that is there was read, else it goes on until it is stopped.
    """
    spark = lines.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = parse(lines).dropDuplicates(keys).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if at_once else stream).start()


def read_lines(spark: SparkSession, folder: str, pattern: str = "*", files_at_once: int = 16) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", pattern).text(folder)


def read_table(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder that fit a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows, without the batches' numbers."""
    return spark.read.parquet(table).drop("batch")
