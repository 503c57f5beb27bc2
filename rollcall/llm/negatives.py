"""Hard-negative mining with product quantisation and stored residual norms.

Vectors are of integers.  The index stores each vector as one byte for every pair of
dimensions, the nearest centre of that pair's codebook, and the length of what the centres
leave over.  A query's products with all centres make a lookup table; the sum of a vector's
entries is its score up to the query's length times the residual's, by Cauchy and Schwarz.
So every score is known between two bounds, and only vectors that may be among a list's
best by these bounds are scored exactly, in integers.  Lists are complete: the bounds only
leave out vectors that cannot be in them.

The index is a stage table of blocks.  Queries go to the workers in slices of bounded size,
one after another; a task keeps the best of each list over its blocks, and Spark ranks what
the tasks found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.stage import drop_stage, staged, task_count

#: Rows that codebooks are fitted on, centres of a codebook, dimensions of a part, rounds of fitting.
TRAIN_ROWS, CENTRES, PART, ROUNDS = 4096, 256, 2, 8
#: Vectors of a block of the index, queries scored at once, bytes of queries that a scan takes to the workers.
BLOCK, TILE, SLICE_BYTES = 4096, 128, 64 << 20
#: Components beyond this are taken as it, so that products stay within 64 bits.
MOST = 1 << 26
#: Rounding of sums in single precision, as a share of the product of lengths.
ROUNDING = 1e-5


def integers(flat: np.ndarray) -> np.ndarray:
    """``floor(256 x)``, at most ``MOST`` either way."""
    return np.clip(np.floor(256 * flat), -MOST, MOST).astype(np.int32)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with an id, a label and finite components, as integers."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        end = np.cumsum(size)
        keep = (bad[end] == bad[end - size]) & pc.and_(pc.and_(ids.is_valid(), labels.is_valid()), vectors.is_valid()).to_numpy(zero_copy_only=False)
        raw = integers(np.where(np.isfinite(flat), flat, 0))
        data = [raw[e - n : e].tobytes() for e, n in zip(end[keep], size[keep])]
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([ids.filter(mask), labels.filter(mask), pa.array(size[keep], pa.int32()), pa.array(data, pa.binary())], ["id", "label", "dims", "vector"])


def usable_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``id, label, dims, vector`` (32-bit integers in a binary column) of the rows that take part."""
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    return taken.mapInArrow(_usable, "id long, label long, dims int, vector binary")


def _stacked(raw: list[bytes], dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if all(len(x) == 4 * dims for x in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), dims)
    return np.stack([np.pad(np.frombuffer(x, np.int32), (0, dims - len(x) // 4)) for x in raw])


def codebooks(sample: np.ndarray) -> np.ndarray:
    """Centres of each part (parts x ``CENTRES`` x ``PART``) by Lloyd's rounds over the sample; the last part may be filled with zeros."""
    padded = np.pad(sample, ((0, 0), (0, -sample.shape[1] % PART))).astype(np.float32)
    books = []
    for points in np.split(padded, padded.shape[1] // PART, axis=1):
        distinct = np.unique(points, axis=0)
        centres = distinct[np.linspace(0, len(distinct) - 1, CENTRES).astype(int)].copy()
        for _ in range(ROUNDS):
            of = _nearest(points, centres)
            n = np.bincount(of, minlength=CENTRES)
            for d in range(PART):
                centres[:, d] = np.where(n > 0, np.bincount(of, points[:, d], CENTRES) / np.maximum(n, 1), centres[:, d])
        books.append(centres)
    return np.stack(books)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * (points @ centres.T)).argmin(axis=1)


def encoded(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (parts x rows) and the lengths of the residuals, rounded up."""
    padded = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % PART))).astype(np.float64)
    codes, square = np.zeros((len(books), len(vectors)), np.uint8), np.zeros(len(vectors))
    for m, book in enumerate(books):
        points = padded[:, m * PART : (m + 1) * PART]
        codes[m] = _nearest(points.astype(np.float32), book)
        rest = points - book[codes[m]]
        square += (rest * rest).sum(axis=1)
    return codes, np.nextafter((np.sqrt(square) * (1 + ROUNDING)).astype(np.float32), np.float32(np.inf))


INDEX_SCHEMA = "ids binary, labels binary, vectors binary, codes binary, rest binary, longest double"


def _index_blocks(dims: int, shared, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, held = shared.value, []

        def block() -> pa.RecordBatch:
            ids, labels, raw = zip(*held)
            vectors = _stacked(list(raw), dims)
            codes, rest = encoded(vectors, books)
            longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()))
            values = [np.array(ids, "<i8"), np.array(labels, "<i8"), vectors, codes, rest]
            names = ["ids", "labels", "vectors", "codes", "rest", "longest"]
            return pa.RecordBatch.from_arrays([*[pa.array([v.tobytes()], pa.binary()) for v in values], pa.array([longest])], names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                if len(held) == most:
                    yield block()
                    held = []
        if held:
            yield block()

    return run


class Block:
    """A block of the index in a task."""

    def __init__(self, dims: int, ids, labels, vectors, codes, rest, longest):
        view = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
        self.ids, self.labels = view(ids, "<i8"), view(labels, "<i8")
        self.vectors = view(vectors, np.int32).reshape(len(self.ids), dims)
        self.codes, self.rest = view(codes, np.uint8).reshape(-1, len(self.ids)), view(rest, np.float32)
        self.longest = longest.as_py()
        self.first = np.zeros(len(self.ids), bool)  # an id that repeats counts once in bounds
        self.first[np.unique(self.ids, return_index=True)[1]] = True

    def bounds(self, queries: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table scores of all rows with each query (queries x rows), and how far the true ones may be off."""
        padded = np.pad(queries, ((0, 0), (0, -queries.shape[1] % PART))).astype(np.float32)
        total = np.zeros((len(self.ids), len(queries)), np.float32)
        for m, book in enumerate(books):
            table = book @ padded[:, m * PART : (m + 1) * PART].T  # centres x queries
            total += table[self.codes[m]]
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        return total.T.astype(np.float64), lengths[:, None] * (self.rest[None, :].astype(np.float64) + ROUNDING * self.longest + 1e-6)

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.int64) @ query.astype(np.int64)


class Lists:
    """The best ``k`` so far of each list: ids in the order of score and then id, each id once."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        once = np.sort(np.unique(ids, return_index=True)[1])[: self.k]
        self.ids[i], self.scores[i] = ids[once], scores[once]
        if len(once) == self.k:
            self.least[i] = scores[once[-1]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List numbers, ids and scores."""
        return np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids]), np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0, np.int64)])


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, minus infinity where there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*batch.columns):
            yield Block(dims, *row)


def _positives(dims: int, k: int, books_shared, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, vectors), books = shared.value, books_shared.value
        lists = Lists(len(ids), k)
        for block in _blocks(batches, dims):
            for lo in range(0, len(ids), TILE):
                about, off = block.bounds(vectors[lo : lo + TILE], books)
                for i in range(lo, min(lo + TILE, len(ids))):
                    own = np.flatnonzero((block.labels == labels[i]) & (block.ids != ids[i]))
                    low, high = about[i - lo, own] - off[i - lo, own], about[i - lo, own] + off[i - lo, own]
                    at = own[high >= max(lists.least[i], _kth(low[block.first[own]], k))]
                    if len(at):
                        lists.add(i, block.ids[at], block.exact(vectors[i], at))
        who, found, scores = lists.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(found), pa.array(scores)], ["anchor_id", "id", "score"])

    return run


def _negatives(dims: int, k: int, books_shared, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, vectors, of, positives, low_ends, high_ends), books = shared.value, books_shared.value
        lists, first = Lists(len(of), k), np.searchsorted(of, np.arange(len(ids) + 1))
        for block in _blocks(batches, dims):
            for lo in range(0, len(ids), TILE):
                about, off = block.bounds(vectors[lo : lo + TILE], books)
                for i in range(lo, min(lo + TILE, len(ids))):
                    other = np.flatnonzero(block.labels != labels[i])
                    low, high = about[i - lo, other] - off[i - lo, other], about[i - lo, other] + off[i - lo, other]
                    need = {}
                    for w in range(first[i], first[i + 1]):
                        inside = (high <= high_ends[w]) & block.first[other]  # their scores are in the window if they reach its lower end
                        least = max(low_ends[w], lists.least[w], _kth(low[inside], k))
                        if len(at := np.flatnonzero((high >= least) & (low <= high_ends[w]))):
                            need[w] = at
                    if not need:
                        continue
                    scored = np.unique(np.concatenate(list(need.values())))  # by several windows of an anchor, once
                    exact = block.exact(vectors[i], other[scored])
                    for w, at in need.items():
                        scores = exact[np.searchsorted(scored, at)]
                        fits = (scores >= low_ends[w]) & (scores <= high_ends[w])
                        lists.add(w, block.ids[other[at[fits]]], scores[fits])
        who, found, scores = lists.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[of[who]]), pa.array(positives[who]), pa.array(found), pa.array(scores)], ["anchor_id", "positive_id", "id", "score"])

    return run


def _best(found: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The best ``k`` of each group with ``rank``; an id that repeats counts once, at its best score."""
    once = found.groupBy(*groups, "id").agg(F.max("score").alias("score"))
    ranking = Window.partitionBy(*groups).orderBy(F.col("score").desc(), "id")
    return once.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


class HardNegatives:
    """Index of ``rows`` and the mining of negatives for anchors.

    Rows without an id or a label, and vectors that are null or hold a null or non-finite
    component, take no part.  Components become ``floor(256 x)``, within 2**26 either way;
    of vectors of different lengths the shorter one counts as ending in zeros.  A row's score
    is its inner product with the anchor; ties stand by id.  Rows that repeat an id count as
    one in every list, at their best score there; of anchors that repeat an id the least label and
    vector count.  Other columns are not read; an empty table gives no rows.

    Codebooks are fitted on at most ``TRAIN_ROWS`` rows, those with the smallest hashes of their ids;
    every row is indexed, and the sample does not change any result.
    """

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK, slice_bytes: int = SLICE_BYTES):
        self.slice_bytes = slice_bytes
        self.spark = rows.sparkSession
        self.rows = staged(usable_rows(rows, id_col, label_col, vector_col), "negatives-rows")
        self.dims = max(self.rows.agg(F.max("dims")).first()[0] or 0, 1)
        sample = self.rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select("vector").collect()
        books = codebooks(_stacked([r.vector for r in sample], self.dims)) if sample else np.zeros((0, CENTRES, PART), np.float32)
        self.books = self.spark.sparkContext.broadcast(books)
        # Blocks of mixed rows: a scan's tasks get as many of any label.
        dealt = self.rows.select("id", "label", "vector").repartition(task_count(self.rows))
        self.index = staged(dealt.mapInArrow(_index_blocks(self.dims, self.books, block), INDEX_SCHEMA), "negatives-index")

    def _slices(self, anchors: DataFrame, bytes_each: int) -> Iterator[list]:
        """The anchors in groups of at most ``slice_bytes``, each sorted by id; the driver holds one at a time."""
        held: list = []
        for row in anchors.toLocalIterator():
            held.append(row)
            if (len(held) + 1) * bytes_each > self.slice_bytes:
                yield sorted(held, key=lambda r: r.id)
                held = []
        if held:
            yield sorted(held, key=lambda r: r.id)

    def mine(self, anchors, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
        """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

        ``anchors`` is a condition on ``id``.  An anchor's positives are its best ``positives`` other rows of its label.
        For each the best ``negatives`` rows of other labels are given whose hundredfold score is
        between ``low`` and ``high`` times the positive's; where a positive's score is negative, none is.
        """
        chosen = staged(self.rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own")).select("id", "own.*"), "negatives-anchors")
        out = None
        for rows in self._slices(chosen, 4 * self.dims + 64 * positives):
            ids, labels = np.array([r.id for r in rows], np.int64), np.array([r.label for r in rows], np.int64)
            vectors = _stacked([r.vector for r in rows], self.dims)
            context = self.spark.sparkContext
            shared = context.broadcast((ids, labels, vectors))
            best = _best(self.index.mapInArrow(_positives(self.dims, positives, self.books, shared), "anchor_id long, id long, score long"), ["anchor_id"], positives)
            # A few rows for each anchor of the slice, whose vectors take more.
            windows = sorted((int(np.searchsorted(ids, r.anchor_id)), r.rank, r.id, r.score) for r in best.collect())
            of, pos, scores = (np.array([w[k] for w in windows], np.int64) for k in (0, 2, 3))
            ends = np.array([(_ceil_div(low * s, 100), high * s // 100) for s in scores.tolist()], np.int64).reshape(-1, 2)
            asked = context.broadcast((ids, labels, vectors, of, pos, ends[:, 0], ends[:, 1]))
            found = self.index.mapInArrow(_negatives(self.dims, negatives, self.books, asked), "anchor_id long, positive_id long, id long, score long")
            ranked = _best(found, ["anchor_id", "positive_id"], negatives)
            known = self.spark.createDataFrame(
                pa.table({"anchor_id": ids[of], "positive_id": pos, "positive_score": scores})
            )
            part = staged(ranked.join(known, ["anchor_id", "positive_id"]).select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
            shared.unpersist()
            asked.unpersist()
            out = part if out is None else out.union(part)
        drop_stage(chosen)
        if out is None:
            return self.spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return out


def contract_rows(embeddings: DataFrame) -> DataFrame:
    """Rows of the embeddings table with the label that the query asks for: the next one where the id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", moved.alias("label"), "embedding")


#: The same in DuckDB SQL, from all pairs of an anchor and a row.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (
  SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM pos JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""
