"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Lengths are at most the capacity, so the whole packing is decided on a histogram of at
most that many counts: pieces above a third of the capacity are matched, at most two to a
sequence, each largest with the largest that fits; shorter ones, longest first, go to the
smallest gap that takes them.  Equal sequences are planned together, so the plan has a
bounded number of groups whatever the table's size.  Every piece then finds its place
from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.llm import kernel, tokens
from rollcall.stage import staged

CAPACITY = 2048
END_ID = 0
RANK_BITS = 44

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan_groups(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal sequences: the ``(length, how many)`` in each, and the number of sequences.

    ``counts[n]`` is the number of pieces of length n.
    """
    left = [int(c) for c in counts]
    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    sizes: list[int] = []  # the gaps that occur, in order

    def put(pattern: list[tuple[int, int]], gap: int, n: int) -> None:
        if n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((pattern, n))

    third = capacity // 3
    for large in range(capacity, third, -1):
        while left[large]:
            partner = min(large, capacity - large)
            while partner > third and not (left[partner] >= 2 if partner == large else left[partner]):
                partner -= 1
            if partner <= third:
                put([(large, 1)], capacity - large, left[large])
                left[large] = 0
            elif partner == large:
                n = left[large] // 2
                put([(large, 2)], capacity - 2 * large, n)
                left[large] -= 2 * n
            else:
                n = min(left[large], left[partner])
                put([(large, 1), (partner, 1)], capacity - large - partner, n)
                left[large] -= n
                left[partner] -= n
    for small in range(third, 0, -1):
        todo = left[small]
        while todo:
            at = bisect_left(sizes, small)
            if at == len(sizes):
                each = capacity // small
                put([(small, each)], capacity - each * small, todo // each)
                if todo % each:
                    put([(small, todo % each)], capacity - todo % each * small, 1)
                break
            gap = sizes[at]
            pattern, n = gaps[gap].pop()
            each = gap // small
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            full = min(n, todo // each)
            put([*pattern, (small, each)], gap - each * small, full)
            rest = todo - full * each
            if full < n:
                if rest:  # fewer than one sequence takes
                    put([*pattern, (small, rest)], gap - rest * small, 1)
                    full += 1
                    rest = 0
                put(pattern, gap, n - full)
            todo = rest
    return [group for gap in sizes for group in gaps[gap]]


def slots_of(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Of each length in each group: its first rank (with the length above it), the group's size and first sequence, and the offset."""
    ranks: dict[int, int] = {}
    rows = []
    sequence = 0
    for pattern, n in groups:
        offset = 0
        for length, each in pattern:
            first = ranks.get(length, 0)
            ranks[length] = first + each * n
            rows.append(((length << RANK_BITS) | first, n, sequence, offset))
            offset += length * each
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": table[:, 0], "n": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _cut(path: str, end_id: int, capacity: int, special_text: bool) -> Callable:
    """Pieces of each text with the rank of each among its partition's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        encoder = tokens.encoder(path, False, special_text)
        for batch in batches:
            for block in kernel.blocks(batch.column(1), tokens.BLOCK_BYTES):
                ids, places = tokens.with_end(*encoder.encode(block), end_id)
                raw = ids.astype("<u4")
                docs, piece, start, length, crc, nth = [], [], [], [], [], []
                for i, (lo, hi) in enumerate(zip(places[:-1].tolist(), places[1:].tolist())):
                    for k, at in enumerate(range(lo, hi, capacity)):
                        size = min(capacity, hi - at)
                        docs.append(block.row0 + i)
                        piece.append(k)
                        start.append(at - lo)
                        length.append(size)
                        crc.append(zlib.crc32(raw[at : at + size]))
                        nth.append(seen[size])
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)], pa.array([part] * len(docs), pa.int32()), pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return run


def _place(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(slots["key"], (length << RANK_BITS) | rank, "right") - 1
            within = rank - (slots["key"][at] & ((1 << RANK_BITS) - 1))
            n = slots["n"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slots["sequence"][at] + within % n), pa.array(slots["offset"][at] + within // n * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, special_text: bool = False) -> DataFrame:
    """Places of all documents' tokens in sequences of at most ``capacity``, one row per piece.

    ``tokenizer`` is the path of a vocabulary file for the tokenizers library, of the kind
    that drops white space.  Strings of its special tokens in a text become these tokens, as in
    the library, or ordinary text with ``special_text``.  A null text is empty and has just the end id.  Only documents
    longer than ``capacity`` are cut.  Rows with equal or null ids are packed each by
    itself.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(texts.mapInArrow(_cut(tokenizer, end_id, capacity, special_text), PIECE_SCHEMA), "pieces")
    counts = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        histogram[row.length] = row.n
    slots = spark.sparkContext.broadcast(slots_of(plan_groups(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(slots), PACKED_SCHEMA)
