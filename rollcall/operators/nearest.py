"""Exact nearest neighbours of a set of queries: blocks of index rows against all query vectors at once.

A block's similarities come from one matrix product, and of each query only rows that may be
among its best leave the block, so pairs of all rows with all queries are never rows of Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from rollcall.session import ship_package

#: Vectors of queries that a scan takes to the workers, in bytes; more are worked off in several scans.
QUERY_BYTES = 64 << 20
#: Rows and bytes held as a block (8-bit vectors take eight times as much there), and similarities that are computed at once.
BLOCK_ROWS, BLOCK_BYTES, TILE = 1 << 16, 4 << 20, 1 << 20
#: Scores are rounded later, so rows this much below the k-th best still count; rounding takes six places or fewer off.
PLACES_MARGIN = 2.0
MISSING = -2.0  # below every cosine: vectors of different lengths have no similarity


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Squared lengths, the vectors of each dimension count, and the counts; vectors that are null or hold a null have length 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    whole_row = np.ones(len(counts), bool)
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        whole_row = holes[starts + counts] == holes[starts]
    squares, parts = np.zeros(len(counts)), []
    dims = np.unique(counts[counts > 0])
    for d in dims:
        at = np.flatnonzero(counts == d)
        rows = values[starts[at][:, None] + np.arange(d)]
        squares[at] = np.where(whole_row[at], _dots(rows, rows), 0.0)
        parts.append((int(d), at, rows))
    return squares, parts, counts


def _dots(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Products row by row, added in the order of the dimensions."""
    total = np.zeros(len(one))
    for d in range(one.shape[1]):
        total += one[:, d] * other[:, d]
    return total


@dataclass(frozen=True)
class Rule:
    """What may match: rows of another id, of the query's value in a column, and the best row of each group."""

    k: int
    group: str | None = None
    differ: bool = False
    same: tuple[str, str] | None = None
    whole: bool = True
    places: int = 6

    @property
    def margin(self) -> float:
        return PLACES_MARGIN * 10.0**-self.places


def _similarity(dots: np.ndarray, qq: np.ndarray, vv: np.ndarray, whole: bool) -> np.ndarray:
    lengths = qq[:, None] * vv[None, :] if whole else np.sqrt(qq)[:, None] * np.sqrt(vv)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((lengths > 0) | np.isnan(lengths), dots / (np.sqrt(lengths) if whole else lengths), 0.0)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), known


class _Scan:
    """The queries, with the least score that each still asks for."""

    def __init__(self, queries: pa.Table, rule: Rule):
        self.rule, self.table = rule, queries.drop_columns(["q"])
        self.qq, self.parts, self.dims = _matrix(queries.column("q"))
        self.least = np.full(len(queries), -np.inf)
        self.qid, self.known = _numbers(queries.column("qid").combine_chunks())
        if rule.same:
            self.values = queries.column(rule.same[1]).combine_chunks()

    def block(self, rows: pa.Table) -> pa.Table:
        """Candidates among ``rows``: whatever may be among the best ``k`` of a query after rounding, ties included."""
        rule, n = self.rule, len(rows)
        vv, parts, dims = _matrix(rows.column("v"))
        ids, known = _numbers(rows.column("id").combine_chunks())
        groups = None
        if rule.group:
            groups = np.asarray(rows.column(rule.group).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False), np.int64)
        if rule.same:
            codes = pc.fill_null(pc.index_in(rows.column(rule.same[0]).combine_chunks().cast(self.values.type), self.values.unique().drop_null()), -1).to_numpy(zero_copy_only=False)
            asked = pc.fill_null(pc.index_in(self.values, self.values.unique().drop_null()), -2).to_numpy(zero_copy_only=False)
        step, found = max(1, TILE // n), []
        for start in range(0, len(self.qid), step):
            tile = slice(start, min(start + step, len(self.qid)))
            dots = np.full((tile.stop - start, n), np.nan)
            for d, at, vectors in self.parts:
                mine = at[(at >= start) & (at < tile.stop)]
                for e, where, others in parts:
                    if d == e and len(mine):
                        dots[np.ix_(mine - start, where)] = vectors[np.searchsorted(at, mine)] @ others.T
            score = _similarity(dots, self.qq[tile], vv, rule.whole)
            apart = (self.dims[tile, None] != dims[None, :]) & (self.qq[tile, None] * vv[None, :] > 0)
            key = np.where(apart, MISSING, np.where(np.isnan(score), np.inf, score))  # a NaN is above all numbers
            barred = np.zeros(key.shape, bool)
            if rule.differ:
                barred |= (self.qid[tile, None] == ids[None, :]) | ~known[None, :] | ~self.known[tile, None]
            if rule.same:
                barred |= asked[tile, None] != codes[None, :]
            key[barred] = -np.inf
            found += [(q, *self._best(q, key[q - start], ids, known, groups)) for q in range(start, tile.stop)]
        who = np.concatenate([np.full(len(at), q) for q, at, _ in found]) if found else np.zeros(0, np.int64)
        at = np.concatenate([at for _, at, _ in found]) if found else np.zeros(0, np.int64)
        raw = np.concatenate([key for *_, key in found]) if found else np.zeros(0)
        if not rule.whole:
            raw = self._in_order(who, at, raw, vv, parts)
        out = rows.drop_columns(["v"]).take(pa.array(at, pa.int64()))
        for name in self.table.column_names:
            out = out.append_column(name, self.table.column(name).take(pa.array(who, pa.int64())))
        raw = np.where(np.isposinf(raw), np.nan, raw)
        return out.append_column("raw", pa.array(raw, pa.float64(), mask=raw == MISSING))

    def _in_order(self, who: np.ndarray, at: np.ndarray, raw: np.ndarray, vv: np.ndarray, parts: list) -> np.ndarray:
        """Similarities of the chosen pairs from sums in the order of the dimensions: a matrix product of fractions may add in another."""
        out = raw.copy()
        for d, mine, vectors in self.parts:
            for e, where, others in parts:
                if d == e:
                    pair = np.flatnonzero(np.isin(who, mine) & np.isin(at, where))
                    dots = _dots(vectors[np.searchsorted(mine, who[pair])], others[np.searchsorted(where, at[pair])])
                    lengths = np.sqrt(self.qq[who[pair]]) * np.sqrt(vv[at[pair]])
                    with np.errstate(invalid="ignore", divide="ignore"):
                        exact = np.where((lengths > 0) | np.isnan(lengths), dots / lengths, 0.0)
                    out[pair] = np.where(np.isnan(exact), np.inf, exact)
        return out

    def _best(self, q: int, key: np.ndarray, ids: np.ndarray, known: np.ndarray, groups: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        k, margin = self.rule.k, self.rule.margin
        at = np.flatnonzero(key >= self.least[q] - margin if np.isfinite(self.least[q]) else key > -np.inf)
        if len(at) > k and groups is None:
            self.least[q] = max(self.least[q], np.partition(key[at], len(at) - k)[len(at) - k])
            at = at[key[at] >= self.least[q] - margin]
        # Equal scores stand in the order of ids, null first as Spark has it.
        at = at[np.lexsort((ids[at], known[at], -key[at]))]
        if groups is not None and len(at):
            _, first = np.unique(groups[at], return_index=True)  # the best row of each group
            tops = -np.sort(-key[at[first]])
            if len(tops) >= k:
                self.least[q] = max(self.least[q], tops[k - 1])
            best = np.full(groups.max() + 1, -np.inf)
            best[groups[at[first]]] = key[at[first]]
            at = at[key[at] >= np.maximum(best[groups[at]], self.least[q]) - margin]
            order = np.lexsort((np.arange(len(at)), groups[at], -key[at]))
            again = np.concatenate([[False], (key[at[order]][1:] == key[at[order]][:-1]) & (groups[at[order]][1:] == groups[at[order]][:-1])])
            at = at[np.sort(order[~again])]  # of equal scores in a group only the first can be its best
        new = np.concatenate([[True], key[at][1:] != key[at][:-1]])[: len(at)]
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[nth < k]  # more than k rows of one score cannot all be among the best
        return at, key[at]


def _scanner(queries: bytes, rule: Rule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(pa.ipc.open_stream(queries).read_all(), rule)
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows and (rows >= BLOCK_ROWS or size >= BLOCK_BYTES):
                yield from scan.block(pa.Table.from_batches(held)).combine_chunks().to_batches()
                held, rows, size = [], 0, 0
        if rows:
            yield from scan.block(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return run


def candidates(index: DataFrame, queries: DataFrame, k: int, group: str | None = None, differ: bool = False, same: tuple[str, str] | None = None, places: int = 6) -> DataFrame:
    """Pairs of a query and an index row, with ``score``, among which are the best ``k`` of each query.

    ``index`` has ``id, v`` and ``queries`` has ``qid, q``; other columns are carried, names must differ.
    ``differ`` leaves out rows of the query's own id and ``same`` takes rows whose first column equals the
    query's second.  With ``group`` the best ``k`` are groups of that column, each by its best row.  A vector that is null, zero
    or holds a null has similarity 0 with all, vectors of different lengths have none (null).  Queries come to
    the driver and must fit ``QUERY_BYTES`` twice, ids and other columns included; ``slices`` of the search module parts them.
    """
    spark = index.sparkSession
    ship_package(spark)
    rows = index.drop("vv")
    whole = isinstance(rows.schema["v"].dataType.elementType, T.IntegralType)
    table = queries.toArrow()
    if table.nbytes > 2 * QUERY_BYTES:
        raise ValueError(f"more than {2 * QUERY_BYTES} bytes of queries at once")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    fields = [f for f in rows.schema if f.name != "v"] + [f for f in queries.schema if f.name != "q"]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("raw", T.DoubleType())])
    found = rows.mapInArrow(_scanner(sink.getvalue().to_pybytes(), Rule(k, group, differ, same, whole, places)), schema)
    return found.withColumn("score", F.round("raw", places)).drop("raw")
