"""Importance resampling towards a target distribution, by an external sort-count of hashed n-gram streams.

Every text becomes a run of 16-bit bucket numbers.  Blocks of texts are written to a stage
table as packed streams with the documents' offsets, two bytes for each feature.  One pass
over the streams sorts them in bounded chunks and run-length encodes each chunk; Spark adds
up the runs.  A later pass gathers each document's gains from its stream.  The draw is a
range sort on scores with Gumbel noise, so no task ranks all documents.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.llm import kernel
from rollcall.llm.columns import own_prefix
from rollcall.stage import drop_stage, staged, task_count

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Bucket numbers that are sorted at once.
CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
#: In lower-cased UTF-8, all bytes but ASCII digits and letters part words.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
STREAM_SCHEMA = "doc_ids array<long>, n_words array<long>, starts array<long>, stream binary"
WEIGHT_SCHEMA = "doc_id long, n_words long, n_features long, weight long"


@functools.cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def crc_extend(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The checksums ``crc`` carried on over the byte spans ``data[start:end]``; all words take a byte at a time together."""
    table, size = _crc_table(), end - start
    order = np.argsort(-size, kind="stable")
    order = order[int(np.searchsorted(-size[order], -LONG)) :]
    at, state = start[order], ~crc[order]
    active = np.searchsorted(-size[order], -np.arange(LONG), "left")  # words of more than j bytes
    for j, n in enumerate(active.tolist()):
        if not n:
            break
        state[:n] = table[(state[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = crc.copy()
    out[order] = ~state
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(crc[i]))
    return out


def bucket_streams(block: kernel.Block, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of all texts of a block in a row, each text's first place, and each text's number of words.

    A text's features are all runs of 1 to ``n`` of its words, joined by a space.
    """
    low = kernel.lowered(block)
    found = kernel.words(low, SEPARATOR)
    owner, counts = found.owner(), found.counts
    crc = np.zeros(len(found.start), np.uint32)
    data = np.append(low.data, np.uint8(0x20))
    space = np.full(len(crc), len(low.data))
    parts, owners = [], []
    for size in range(1, n + 1):
        heads = len(found.start) - size + 1
        if heads <= 0:
            break
        if size > 1:
            crc = crc_extend(crc[:heads], data, space[:heads], space[:heads] + 1)
        crc = crc_extend(crc[:heads], data, found.start[size - 1 :], found.end[size - 1 :])
        within = owner[:heads] == owner[size - 1 :]
        parts.append((crc[within] % np.uint32(buckets)).astype("<u2"))
        owners.append(owner[:heads][within])
    stream = np.concatenate(parts) if parts else np.zeros(0, "<u2")
    if n > 1 and parts:
        stream = stream[np.argsort(np.concatenate(owners), kind="stable")]
    sizes = sum(np.maximum(counts - size + 1, 0) for size in range(1, n + 1))
    return stream, np.concatenate([[0], np.cumsum(sizes)[:-1]]), counts


def _streams(n: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                stream, starts, counts = bucket_streams(block, n, buckets)
                ids = batch.column(0).slice(block.row0, len(block))
                one = pa.array([0, len(block)], pa.int32())
                columns = [pa.ListArray.from_arrays(one, x) for x in (ids, pa.array(counts, pa.int64()), pa.array(starts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([stream.tobytes()], pa.binary())], ["doc_ids", "n_words", "starts", "stream"])

    return run


def run_lengths(chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of ``chunk`` and how often each occurs."""
    ordered = np.sort(chunk, kind="stable")  # a radix sort for 16 bits
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[heads], np.diff(np.append(heads, len(ordered)))


def _runs(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(buckets, np.int64), [], 0

        def merge() -> None:
            values, lengths = run_lengths(np.concatenate(held))
            total[values] += lengths
            held.clear()

        for batch in batches:
            for raw in batch.column(0):
                stream = np.frombuffer(raw.as_buffer(), "<u2")
                for at in range(0, len(stream), CHUNK):
                    held.append(stream[at : at + CHUNK])
                    size += len(held[-1])
                    if size >= CHUNK:
                        merge()
                        size = 0
        if held:
            merge()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return run


def count_buckets(streams: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; a task gives a row for each bucket at most, and the driver as many in all."""
    summed = streams.select("stream").mapInArrow(_runs(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the floor of a thousand times its log ratio of smoothed shares in the target and in the source."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weights(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for ids, words, starts, raw in zip(*batch.columns):
                stream, first = np.frombuffer(raw.as_buffer(), "<u2"), starts.values.to_numpy()
                sizes = np.diff(np.append(first, len(stream)))
                full, sums = np.flatnonzero(sizes), np.zeros(len(first), np.int64)
                if len(full):
                    sums[full] = np.add.reduceat(gain[stream], first[full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes, pa.int64()), pa.array(sums // np.maximum(sizes, 1), pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def write_streams(texts: DataFrame, id_col: str, text_col: str, n: int, buckets: int) -> DataFrame:
    """Packed streams of all texts as a stage table, a row for each block of texts."""
    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(_streams(n, buckets), STREAM_SCHEMA), "bucket-streams")


def importance_scores(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` numbers the drawn ones.

    A document's weight is the floored mean of its features' gains, 0 without features; its
    score adds Gumbel noise from a hash of ``seed`` and the id, so reruns draw the same.  Of
    the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn, the highest scores
    first, equal scores by the smaller id and repeated rows one after another.  A null
    text has no features; a row without an id has no score and is never drawn; an empty table
    or target gives gains all the same.  Other columns are not read.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers take 16 bits")
    streams = write_streams(docs, id_col, text_col, n, buckets)
    wanted = write_streams(target, target_id, target_text, n, buckets)
    gain = gains(count_buckets(streams, buckets), count_buckets(wanted, buckets))
    drop_stage(wanted)
    weights = streams.mapInArrow(_weights(docs.sparkSession.sparkContext.broadcast(gain)), WEIGHT_SCHEMA)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(weights.withColumn("score", F.col("weight") + noise), "importance")
    drop_stage(streams)
    takes_part = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    rest = scored.where(~takes_part).withColumn("rank", F.lit(None).cast("long"))
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    # Ranges of scores, numbered within; the place counts up from 0 in each partition's low 33 bits.
    laid = scored.where(takes_part).repartitionByRange(task_count(scored), *order).sortWithinPartitions(*order)
    laid = staged(laid.withColumn("place", F.monotonically_increasing_id()), "importance-ranges")
    part = F.shiftright("place", 33)
    counts = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    ranked = laid.join(F.broadcast(offsets), part == F.col("part"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = ranked.withColumn("rank", F.when(rank <= F.floor(F.lit(percent) * F.col("all") / 100), rank))
    return drawn.select(*rest.columns).union(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``importance_scores`` draws; of rows that repeat an id all, if one is drawn."""
    own = own_prefix(docs.columns)
    drawn = importance_scores(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(drawn, F.col(f"`{id_col}`").cast("long") == F.col(own), "left_semi")


#: The same scores in DuckDB SQL; checksums are computed for distinct words, byte by byte.
SCORES_SQL = """
WITH lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM benchmark),
single AS (SELECT doc_id, unnest(ws) AS w FROM lists),
tables AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_of
  FROM range(256) t(i)),
bytes AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS bs
  FROM (SELECT w FROM single UNION SELECT w FROM wanted)),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, tables),
s AS (SELECT bucket, count(*) AS n FROM single JOIN buckets USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (w) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (all_s + 10000) / ((coalesce(s.n, 0) + 1) * (all_t + 10000))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), sums),
weights AS (
  SELECT doc_id, count(w) AS n_features, coalesce(floor(sum(g)::DOUBLE / count(w))::BIGINT, 0) AS weight
  FROM (SELECT doc_id FROM lists) LEFT JOIN single USING (doc_id) LEFT JOIN buckets USING (w) LEFT JOIN gain USING (bucket) GROUP BY 1),
scores AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM weights),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scores LEFT JOIN ranked USING (doc_id)
"""
