"""Count sketches of hashed tokens, summed over a whole table in bounded memory.

A sketch has a fixed number of counters whatever the table's size, so it may be
collected and broadcast.  Its counts steer orders and weights; no result is dropped on
the strength of a colliding counter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counters in a shuffled row.
CHUNK = 1 << 12
SCHEMA = "chunk int, counts binary"


def chunk_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A flat array of counters as rows; chunks without a count are left out, and counts take four bytes where that is enough."""
    table = counts.reshape(-1, CHUNK)
    used = np.flatnonzero(table.any(axis=1))
    if len(used):
        kind = "<u4" if table.max() < 1 << 32 else "<u8"
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([table[i].astype(kind).tobytes() for i in used], pa.binary())], ["chunk", "counts"]
        )


def _chunk(raw) -> np.ndarray:
    return np.frombuffer(raw, "<u8" if len(raw) == 8 * CHUNK else "<u4")


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = _chunk(counts.as_buffer())
            if chunk in total:
                total[chunk] += values
            else:
                total[chunk] = values.astype(np.uint64)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"]
        )


def collect_counts(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int) -> np.ndarray:
    """Sum the chunks that ``count`` yields for each partition of ``df`` into ``size`` counters."""
    out = np.zeros(size, np.uint64)
    summed = df.mapInArrow(count, SCHEMA).repartition("chunk").mapInArrow(_sum, SCHEMA)
    for row in summed.collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] += _chunk(row.counts)
    return out
