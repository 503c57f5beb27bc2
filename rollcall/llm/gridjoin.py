"""Near-duplicate vectors by the epsilon grid order join.

A cosine of t or more between unit vectors is a distance of at most ``sqrt(2 - 2 t)``, the
side of the grid's cells.  Cells are numbered along the leading principal dimensions of all
vectors, and vectors are sorted by them, so that a stretch of the sequence is a narrow box
in those dimensions.  The sequence is cut into blocks, the blocks into intervals of
intervals; Spark joins the sequence with itself interval by interval, from one pair down
to pairs of blocks, and drops every pair of boxes that is provably distant.  In a task two
blocks are cut once more, into leaves, and only leaves whose boxes are near are multiplied.

Equal vectors are one class with a size.  A pair of blocks gives a row for each vector with
a link, which has its links' number and one vector of its part of the graph, so the links
of a dense group are never rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.operators.components import connected_components
from rollcall.stage import drop_stage, staged, task_count

#: Vectors of a block, blocks of an interval, and vectors of a leaf.
BLOCK, FAN, LEAF = 2048, 16, 64
#: Bits of the sort key that cells share.
KEY_BITS = 60
#: Products of unit vectors this near the threshold are settled by a sum in the order of the dimensions.
SLACK = 1e-9


@dataclass(frozen=True)
class Grid:
    """Cells of side ``side`` along ``axes`` (dims x leading dimensions); vectors of other lengths take their first components."""

    threshold: float
    axes: np.ndarray

    @property
    def square(self) -> float:
        return 2 - 2 * self.threshold + 1e-9

    @property
    def side(self) -> float:
        return max(math.sqrt(self.square), 1e-4)

    @property
    def bits(self) -> int:
        return (2 * math.ceil(1 / self.side) + 1).bit_length()

    @property
    def leading(self) -> int:
        return KEY_BITS // self.bits

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Coordinates of unit vectors in the leading dimensions, zeros where there are fewer."""
        out = np.zeros((len(unit), self.leading))
        found = unit @ self.axes[:, : self.leading] if unit.shape[1] == len(self.axes) else unit[:, : self.leading]
        out[:, : found.shape[1]] = found
        return out

    def keys(self, places: np.ndarray) -> np.ndarray:
        """Cells in a row as one number, the first dimension in the highest bits."""
        most = math.ceil(1 / self.side)
        cells = np.clip(np.floor(places / self.side).astype(np.int64), -most, most) + most
        return reduce(lambda key, cell: (key << self.bits) | cell, cells.T, np.zeros(len(places), np.int64))


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and no square leaves the range of a double."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    scaled = _scaled(raw)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines row by row, all sums in the order of the dimensions."""
    a, b = _scaled(a), _scaled(b)
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        aa += a[:, d] * a[:, d]
        bb += b[:, d] * b[:, d]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _prepare(kind: str) -> Callable:
    """Digest and bytes of each vector that may have links; both are null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten()
            values = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)) + 0.0  # -0 and 0 are one
            digests, raw = [], []
            for at, n, whole in zip(np.cumsum(size) - size, size, pc.and_(ids.is_valid(), labels.is_valid()).to_pylist()):
                own = values[at : at + n]
                data = own.astype(kind).tobytes() if whole and n and np.isfinite(own).all() and own.any() else None
                raw.append(data)
                digests.append(data and hashlib.blake2b(data, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "digest", "vector"])

    return run


def _moments(kind: str, dims: int) -> Callable:
    """Sums of products of unit vectors with a 1 put behind: a row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(0)]
            if rows:
                unit = np.column_stack([unit_vectors(np.stack(rows).astype(np.float64)), np.ones(len(rows))])
                total += unit.T @ unit
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["i", "sums"])

    return run


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[i] = total.get(i, 0) + np.frombuffer(raw.as_buffer())
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["i", "sums"])


def principal_axes(classes: DataFrame, kind: str) -> np.ndarray:
    """Eigenvectors of the covariance of all unit vectors of the most frequent length, the largest spread first.

    The driver gets one matrix of that length squared.
    """
    lengths = classes.groupBy(F.octet_length("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    if not lengths:
        return np.eye(1)
    dims = lengths[0].n // np.dtype(kind).itemsize
    own = classes.where(F.octet_length("vector") == lengths[0].n).select("vector")
    sums = own.mapInArrow(_moments(kind, dims), "i int, sums binary").repartition("i").mapInArrow(_sum_rows, "i int, sums binary")
    total = np.zeros((dims + 1, dims + 1))
    for row in sums.collect():
        total[row.i] += np.frombuffer(row.sums)
    mean = total[-1, :-1] / total[-1, -1]
    return np.linalg.eigh(total[:-1, :-1] / total[-1, -1] - np.outer(mean, mean))[1][:, ::-1]


def _keyed(kind: str, grid: Grid) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.names.index("vector"))
            keys, sizes = np.zeros(len(raw), np.int64), pc.binary_length(raw).to_numpy()
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                rows = np.stack([np.frombuffer(raw[int(i)].as_buffer(), kind) for i in at]).astype(np.float64)
                keys[at] = grid.keys(grid.places(unit_vectors(rows)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(keys)], [*batch.schema.names, "width", "cells"])

    return run


BLOCK_SCHEMA = "part int, nth long, label string, width int, low array<double>, high array<double>, reps binary, sizes binary, digests binary, vectors binary"


def _blocks(kind: str, grid: Grid, most: int) -> Callable:
    """Blocks of the sorted sequence, each of one label and length, with their boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, of = TaskContext.get().partitionId(), 0, [], None

        def block() -> pa.RecordBatch:
            reps, sizes, digests, vectors = zip(*held)
            rows = np.frombuffer(b"".join(vectors), kind).reshape(len(held), -1).astype(np.float64)
            places = grid.places(unit_vectors(rows))
            values = [part, nth, *of, places.min(axis=0).tolist(), places.max(axis=0).tolist(), np.array(reps, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), b"".join(digests), b"".join(vectors)]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["part", "nth", "label", "width", "low", "high", "reps", "sizes", "digests", "vectors"])

        for batch in batches:
            for label, width, rep, size, digest, vector in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (of != (label, width) or len(held) == most):
                    yield block()
                    nth, held = nth + 1, []
                of = (label, width)
                held.append((rep, size, digest, vector))
        if held:
            yield block()

    return run


class _Side:
    """A block in a task: its vectors, in leaves with boxes."""

    def __init__(self, kind: str, grid: Grid, reps: bytes, sizes: bytes, digests: bytes, vectors: bytes):
        self.reps, self.sizes = np.frombuffer(reps, "<i8"), np.frombuffer(sizes, "<i8").astype(np.float64)
        self.digests = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        self.raw = np.frombuffer(vectors, kind).reshape(len(self.reps), -1).astype(np.float64)
        self.unit = unit_vectors(self.raw)
        places = grid.places(self.unit)
        self.heads = np.arange(0, len(self.reps), LEAF)
        self.low, self.high = np.minimum.reduceat(places, self.heads), np.maximum.reduceat(places, self.heads)


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while (parent[up] != up).any():
        parent[at] = up = parent[up]
    return up


def _join_sides(a: _Side, b: _Side, same: bool, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of ``a`` and of ``b``, weighted by sizes, and a least connected place for each, ``b``'s after ``a``'s."""
    shift = 0 if same else len(a.reps)
    parent = np.arange(shift + len(b.reps))
    links_a, links_b = np.zeros(len(a.reps)), np.zeros(len(b.reps))
    for leaf, head in enumerate(a.heads):
        gaps = np.maximum(np.maximum(b.low - a.high[leaf], a.low[leaf] - b.high), 0)
        near = np.flatnonzero((gaps * gaps).sum(axis=1) <= grid.square)
        if not len(near):
            continue
        rows = slice(head, min(head + LEAF, len(a.reps)))
        columns = (b.heads[near][:, None] + np.arange(LEAF)).ravel()
        columns = columns[columns < len(b.reps)]
        products = a.unit[rows] @ b.unit[columns].T
        hit = products >= grid.threshold
        x, y = np.nonzero(np.abs(products - grid.threshold) <= SLACK)
        if len(x):
            hit[x, y] = _cosine(a.raw[head + x], b.raw[columns[y]]) >= grid.threshold
        if same:
            hit[np.arange(head, rows.stop)[:, None] == columns] = False
        if not hit.any():
            continue
        links_a[rows] += hit @ b.sizes[columns]
        links_b[columns] += a.sizes[rows] @ hit
        x, y = np.nonzero(hit)
        x, y = x + head, columns[y] + shift
        while len(x):  # the greater root of a link goes below the lesser one, until none differ
            one, other = _roots(parent, x), _roots(parent, y)
            apart = one != other
            x, y, one, other = x[apart], y[apart], one[apart], other[apart]
            np.minimum.at(parent, np.maximum(one, other), np.minimum(one, other))
    return links_a, links_b, _roots(parent, np.arange(len(parent)))


LINK_SCHEMA = "rep long, digest binary, links long, root long"


def _join_blocks(kind: str, grid: Grid) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *sides in zip(*[c.to_pylist() for c in batch.columns]):
                a = _Side(kind, grid, *sides[:4])
                b = a if i == j else _Side(kind, grid, *sides[4:])
                links_a, links_b, roots = _join_sides(a, b, i == j, grid)
                links = links_a if i == j else np.concatenate([links_a, links_b])
                reps = a.reps if i == j else np.concatenate([a.reps, b.reps])
                digests = a.digests if i == j else a.digests + b.digests
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reps[at]), pa.array([digests[k] for k in at.tolist()], pa.binary()), pa.array(links[at].astype(np.int64)), pa.array(reps[roots[at]])],
                        ["rep", "digest", "links", "root"],
                    )

    return run


def _near(k: int, most: float) -> Column:
    """Whether the boxes of two intervals, columns ``low`` and ``high`` of ``a`` and ``b``, are near enough and may share a label."""
    gap = lambda d: F.greatest(F.col("a.low")[d] - F.col("b.high")[d], F.col("b.low")[d] - F.col("a.high")[d], F.lit(0.0))
    square = reduce(lambda x, y: x + y, (gap(d) * gap(d) for d in range(k)))
    return (square <= most) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))


def near_pairs(boxes: DataFrame, n: int, grid: Grid) -> DataFrame:
    """``i, j`` (i <= j) of blocks that may hold a link, by rounds from the whole sequence down.

    ``boxes`` has ``seq, label, width, low, high`` of ``n`` blocks.  In each round a pair of intervals
    becomes the pairs of their parts, at most ``FAN`` squared, and those too far apart go.
    """
    levels = max(1, math.ceil(math.log(max(n, 2), FAN) - 1e-12))
    k = grid.leading
    label = F.struct("label", "width")
    lows = F.array(*[F.min(F.col("low")[d]) for d in range(k)])
    highs = F.array(*[F.max(F.col("high")[d]) for d in range(k)])
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    for level in reversed(range(levels)):
        at = F.floor(F.col("seq") / FAN**level)
        parts = boxes.groupBy(at.alias("part")).agg(lows.alias("low"), highs.alias("high"), F.min(label).alias("first"), F.max(label).alias("last"))
        parts = staged(parts.withColumn("up", F.floor(F.col("part") / FAN)), "grid-intervals")
        met = pairs.join(parts.alias("a"), F.col("i") == F.col("a.up")).join(parts.alias("b"), F.col("j") == F.col("b.up"))
        pairs = staged(met.where((F.col("a.part") <= F.col("b.part")) & _near(k, grid.square)).select(F.col("a.part").alias("i"), F.col("b.part").alias("j")), "grid-pairs")
    return pairs


def _sequence(blocks: DataFrame) -> DataFrame:
    """The blocks with ``seq``, their number in the sequence from 0."""
    counts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range of the sequence
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(offsets), "part").withColumn("seq", F.col("before") + F.col("nth"))


def near_duplicates(rows: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: links to other rows of the same label at a cosine of ``threshold`` or more.

    A vector that is null, empty, zero, or has a null or non-finite component, a row without a
    label (if ``label_col`` is given) and a row without an id link with nothing; vectors of different
    lengths do not link.  Rows of equal vectors and labels link with each other; rows that repeat an
    id count one by one, and are one vertex of a component.  ``kept`` is whether the row's id is
    its component's, also where both are null.  Other columns are not read; an empty table gives no rows.
    """
    kind = "<f4" if rows.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    taken = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"))
    known = staged(taken.mapInArrow(_prepare(kind), "vec_id long, label string, digest binary, vector binary"), "grid-vectors")
    classes = known.where("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    classes = staged(classes, "grid-classes")
    grid = Grid(threshold, principal_axes(classes, kind))
    keyed = staged(classes.mapInArrow(_keyed(kind, grid), "label string, digest binary, rep long, size long, vector binary, width int, cells long"), "grid-cells")
    order = ["label", "width", "cells", "rep", "digest"]  # ids part a full cell between ranges
    laid = keyed.repartitionByRange(task_count(keyed), *order).sortWithinPartitions(*order)
    blocks = staged(laid.select("label", "width", "rep", "size", "digest", "vector").mapInArrow(_blocks(kind, grid, block), BLOCK_SCHEMA), "grid-blocks")
    drop_stage(keyed)
    placed = _sequence(blocks)
    boxes = staged(placed.select("seq", "label", "width", "low", "high"), "grid-boxes")
    pairs = near_pairs(boxes, boxes.count(), grid)
    side = lambda s, key: placed.select(F.col("seq").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in ("reps", "sizes", "digests", "vectors")])
    none = F.lit(None).cast("binary")  # a block that meets itself travels once
    met = pairs.where("i < j").join(side("a", "i"), "i").join(side("b", "j"), "j")
    met = met.unionByName(pairs.where("i = j").join(side("a", "i"), "i").select("*", *[none.alias(f"{c}_b") for c in ("reps", "sizes", "digests", "vectors")]))
    columns = [f"{c}_{s}" for s in "ab" for c in ("reps", "sizes", "digests", "vectors")]
    found = staged(met.select("i", "j", *columns).mapInArrow(_join_blocks(kind, grid), LINK_SCHEMA), "grid-links")
    drop_stage(blocks, boxes, pairs)
    links = found.groupBy("rep", "digest").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("rep", "root"), "rep", "root")
    of_class = classes.select("label", "digest", "rep", "size").join(links, ["rep", "digest"], "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = staged(of_class.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "grid-result")
    drop_stage(found, labels, classes)
    out = known.select("vec_id", "label", "digest").join(of_class, ["label", "digest"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The same in DuckDB SQL, from all pairs of a label.
LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v WHERE links.b > reach.r),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON v = vec_id LEFT JOIN counts ON a = vec_id
"""
