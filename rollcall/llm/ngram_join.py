"""N-gram Jaccard self-join with multiple-global-order filtering.

Two sets with a Jaccard similarity of t or more share a token among the first
``n - ceil(t n) + 1`` tokens of either, under any order of all tokens.  So a pair is a
candidate only if it shares such prefix tokens under each of several orders.  The first
order puts rare tokens first, by a count sketch of the whole corpus, and its prefixes are
joined in Spark with size and position bounds.  The other orders are independent hash
orders.  Their prefixes are also samples of the sets: below the least of the two last keys
both prefixes are complete, so the tokens shared there and those that either set has above
bound the intersection, and a pair whose bound is too small is no link.  The filters of all
orders are intersected in Spark on the pairs; only texts of pairs that pass them all are
fetched and verified on their whole sets.

Equal sets are one class from the start.  In a group of near copies a shared prefix token
is held by every member, so pairs are not listed at once.  First each token's members meet
only their hub, the member that has the token earliest in its prefix, which is the text the
others were edited from.  Verified links merge classes; then only pairs of classes that
are still apart are listed, and for each token only those outside the hub's class meet
the others.  Every pair that might link two different components is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.llm import kernel, sketch
from rollcall.llm.columns import own_prefix
from rollcall.operators.components import connected_components
from rollcall.stage import bucketed, drop_stage, input_bytes, staged

#: Seeds of the rare-first order's ties and of the independent hash orders.
RARE_SEED = np.uint64(0x243F6A8885A308D3)
SEEDS = np.array([0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
#: Counters of the sketch: one for each KB of input, within these bounds; they are broadcast as a byte each.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 18, 1 << 22


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1 if n else 0


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, eighths of a binary logarithm; they only order tokens."""
    return np.minimum(8 * np.log2(counts.astype(np.float64) + 1), 255).astype(np.uint8)


def rare_prefix(tokens: np.ndarray, levels: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` of ``tokens`` in the rare-first order: by sketched count, then by a hash."""
    mixed = kernel.mix(tokens ^ RARE_SEED)
    keys = (levels[(mixed & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mixed >> np.uint64(8))
    first = np.argpartition(keys, length - 1)[:length] if length < len(keys) else np.arange(len(keys))
    return tokens[first[np.lexsort((mixed[first], keys[first]))]]


def hash_prefix(tokens: np.ndarray, order: int, length: int) -> np.ndarray:
    """Keys of the first ``length`` of ``tokens`` under a hash order, ascending: the upper halves of hashes, as signed numbers."""
    mixed = kernel.mix(tokens ^ SEEDS[order])
    first = np.sort(np.partition(mixed, length - 1)[:length]) if length < len(mixed) else np.sort(mixed)
    return ((first >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)


def _counter(n: int, lower: bool, counters: int, key: kernel.Key) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint32)
        for batch in batches:
            for block in kernel.blocks(batch.column(0), 8 * kernel.BLOCK_BYTES):
                for tokens in kernel.shingle_sets(block, n, lower, key):
                    np.add.at(counts, (kernel.mix(tokens ^ RARE_SEED) & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
        yield from sketch.chunk_rows(counts)

    return count


def _fingerprints(n: int, lower: bool, num: int, den: int, key: kernel.Key, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                sizes, digests, parts, ends = [], [], [], [0]
                for tokens in kernel.shingle_sets(block, n, lower, key):
                    sizes.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    length = prefix_length(len(tokens), num, den)
                    if length:
                        parts.append(rare_prefix(tokens, levels, length))
                    ends.append(ends[-1] + length)
                values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.row0, len(block)), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                    ],
                    ["doc_id", "n_shingles", "digest", "prefix"],
                )

    return run


def _order_prefixes(n: int, lower: bool, num: int, den: int, key: kernel.Key) -> Callable:
    """``doc_id``, set size and the prefix under each hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                sizes, parts, ends = [], [[np.zeros(0, np.int32)] for _ in SEEDS], [0]
                for tokens in kernel.shingle_sets(block, n, lower, key):
                    sizes.append(len(tokens))
                    length = prefix_length(len(tokens), num, den)
                    for order, own in enumerate(parts):
                        if length:
                            own.append(hash_prefix(tokens, order, length))
                    ends.append(ends[-1] + length)
                columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own))) for own in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, len(block)), pa.array(sizes, pa.int32()), *columns], ["doc_id", "n", "order1", "order2"])

    return run


def _verifier(n: int, lower: bool, num: int, den: int, key: kernel.Key) -> Callable:
    def one(text: pa.Scalar) -> np.ndarray:
        return next(kernel.shingle_sets(next(kernel.blocks(pa.array([text.as_py()], pa.string()))), n, lower, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_text, hub_set = None, None, None
        for batch in batches:
            kept = []
            for a, text_a, text_b in zip(batch.column(0), batch.column(2), batch.column(3)):
                if hub is None or a != hub or text_a != hub_text:  # rows come sorted by a
                    hub, hub_text, hub_set = a, text_a, one(text_a)
                other = one(text_b)
                both = np.intersect1d(hub_set, other, assume_unique=True).size
                kept.append(den * both >= num * (len(hub_set) + len(other) - both))
            keep = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _need(a: Column, b: Column, num: int, den: int) -> Column:
    """Least intersection of sets of these sizes that is similar enough."""
    return F.ceil((num * (a + b)) / F.lit(float(num + den)) - 1e-9)


def _passes(order: str, num: int, den: int) -> Column:
    """Whether sets whose prefixes under a hash order are columns ``{order}_a`` and ``{order}_b`` can be similar.

    Below the least of the prefixes' last keys all tokens of both sets are known.  Keys are
    half hashes, so tokens of one set with equal keys are counted as shared as well.
    """
    a, b = F.col(f"{order}_a"), F.col(f"{order}_b")
    last = F.least(F.element_at(a, -1), F.element_at(b, -1))
    low_a, low_b = F.filter(a, lambda x: x < last), F.filter(b, lambda x: x < last)
    shared = F.size(F.array_intersect(low_a, low_b)) + F.size(low_a) - F.size(F.array_distinct(low_a))
    above = F.least(F.col("n_a") - F.size(low_a), F.col("n_b") - F.size(low_b))
    return F.arrays_overlap(a, b) & (shared + above >= _need(F.col("n_a"), F.col("n_b"), num, den))


def _may_link(n1: str, pos1: str, n2: str, pos2: str, num: int, den: int) -> Column:
    """Whether sets that share a token at these prefix positions can be similar, by their sizes and what is left after the token."""
    a, b, p, q = F.col(n1), F.col(n2), F.col(pos1), F.col(pos2)
    return (den * a >= num * b) & (den * b >= num * a) & (F.least(a - p, b - q) >= _need(a, b, num, den))


class NgramJoin:
    """Self-join of one table on its word n-gram sets at a Jaccard similarity of ``num / den`` or more.

    Null and wordless texts have an empty set and link with nothing; a text of fewer than
    ``n`` words has its whole sequence as its one shingle.  Rows without an id are never
    linked.  Rows with equal ids are one document.  Only the id and text columns are read,
    other columns may have any names.  Repeated rows give repeated rows, an empty table none.
    The texts are shuffled once, into a table bucketed by id, unless ``docs`` is one.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100, lower: bool = True, is_bucketed: bool = False):
        self.spark = docs.sparkSession
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.n, self.num, self.den, self.lower = n, num, den, lower
        self.key = kernel.fresh_key(n)  # so that no text can be written to collide with another
        counters = 1 << int(np.clip(input_bytes(docs) >> 10, LEAST_COUNTERS, MOST_COUNTERS) - 1).bit_length()
        counts = sketch.collect_counts(texts.select("text"), _counter(n, lower, counters, self.key), counters)
        self.levels = self.spark.sparkContext.broadcast(quantised(counts))
        self.own = None if is_bucketed else bucketed(texts, "doc_id")
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) if is_bucketed else self.own

    def _classes(self) -> None:
        """``members`` (doc_id, n_shingles, digest) of all rows; ``classes`` (rep, n, digest, prefix) of distinct sets."""
        schema = "doc_id long, n_shingles int, digest binary, prefix array<long>"
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.members = staged(rows.mapInArrow(_fingerprints(self.n, self.lower, self.num, self.den, self.key, self.levels), schema), "ngram-members")
        linked = self.members.where("n_shingles > 0 AND doc_id IS NOT NULL")
        self.classes = staged(
            linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")),
            "ngram-classes",
        )

    def _index(self) -> None:
        """``index``: prefix tokens of the first order that two or more classes hold, with each token's hub."""
        tokens = self.classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token")
        tokens = staged(tokens, "ngram-tokens")
        rows = staged(self.classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token")).join(tokens, "token"), "ngram-rows")
        drop_stage(tokens)
        hubs = staged(rows.groupBy("token").agg(F.min(F.struct("pos", "n", "rep")).alias("hub")), "ngram-hubs")
        self.index = staged(
            rows.join(hubs, "token").select("token", "rep", "n", "pos", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")),
            "ngram-index",
        )
        drop_stage(rows, hubs)

    def _of_pairs(self, pairs: DataFrame) -> DataFrame:
        """The rows of the documents that occur in ``(a, b)`` pairs; the documents are not shuffled."""
        ids = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ngram-ids")
        return self.docs.join(ids, "doc_id", "left_semi")

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """``(a, b, pass1, pass2)``: whether each pair passes the filters of the hash orders."""
        rows = self._of_pairs(pairs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        prefixes = staged(rows.mapInArrow(_order_prefixes(self.n, self.lower, self.num, self.den, self.key), "doc_id long, n int, order1 array<int>, order2 array<int>"), "ngram-orders")
        for end in ("b", "a"):
            pairs = pairs.join(prefixes.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "order1", "order2")]), end)
        return pairs.select("a", "b", *[_passes(f"order{k}", self.num, self.den).alias(f"pass{k}") for k in (1, 2)])

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the ``(a, b)`` pairs that pass the other orders' filters and the exact test."""
        pairs = staged(pairs, "ngram-pairs")
        passed = staged(self.filtered(pairs).where("pass1 AND pass2").select("a", "b"), "ngram-passed")
        texts = staged(self._of_pairs(passed), "ngram-texts")
        b = texts.select(F.col("doc_id").cast("long").alias("b"), F.col("text").alias("text_b"))
        a = texts.select(F.col("doc_id").cast("long").alias("a"), F.col("text").alias("text_a"))
        rows = passed.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        links = staged(rows.mapInArrow(_verifier(self.n, self.lower, self.num, self.den, self.key), "a long, b long").distinct(), "ngram-links")
        drop_stage(pairs, passed, texts)
        return links

    def _apart(self, labels: DataFrame | None) -> DataFrame:
        """Candidate pairs whose ends have different labels, and which no hub round has verified."""
        index = self.index
        if labels is None:
            index = index.withColumn("label", F.col("rep"))
        else:
            index = index.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        tokens = index.groupBy("token").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("label"))).alias("home")
        ).where("low <> high").select("token", "home")
        rows = staged(index.join(tokens, "token").select("token", "rep", "n", "pos", "hub", "label", "home"), "ngram-apart")
        out = rows.where("label <> home AND rep <> hub").select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("label").alias("label_a"))
        other = rows.where("rep <> hub").select("token", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("label").alias("label_b"), "home")
        met = out.join(other, "token").where(
            (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("home")) | (F.col("a") < F.col("b")))
            & _may_link("n_a", "pos_a", "n_b", "pos_b", self.num, self.den)
        )
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _hub_links(self) -> DataFrame:
        pairs = self.index.where((F.col("rep") != F.col("hub")) & _may_link("n", "pos", "hub_n", "hub_pos", self.num, self.den))
        return self._verified(pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())

    def links(self) -> DataFrame:
        """All links ``(a, b)``, a < b, between representatives of different sets."""
        self._classes()
        self._index()
        hub = self._hub_links()
        rest = self._verified(self._apart(None))
        drop_stage(self.own)
        return hub.union(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def components(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` of every row; a component's id is its smallest doc_id."""
        self._classes()
        self._index()
        hub_links = self._hub_links()
        labels = connected_components(hub_links, "a", "b")
        drop_stage(hub_links)
        rest = rest_links = self._verified(self._apart(labels))
        if rest.take(1):
            merged = labels
            for end in ("a", "b"):
                rest = rest.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"label_{end}")), end, "left").withColumn(
                    f"label_{end}", F.coalesce(f"label_{end}", end)
                )
            above = connected_components(rest, "label_a", "label_b").select(F.col("id").alias("label"), F.col("component").alias("top"))
            ends = rest.select(F.col("label_a").alias("id")).union(rest.select("label_b"))
            known = labels.union(ends.distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
            merged = known.join(above, F.col("component") == F.col("label"), "left").select("id", F.coalesce("top", "component").alias("component"))
        else:
            merged = labels
        of_class = self.classes.select("digest", "rep").join(merged.select(F.col("id").alias("rep"), "component"), "rep", "left")
        of_class = staged(of_class.select("digest", F.coalesce("component", "rep").alias("component")), "ngram-components")
        drop_stage(self.index, self.classes, labels, rest_links, self.own)
        members = self.members.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        return members.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the document with the smallest id stays.

    Rows without words or without an id stay.  Of rows that repeat an id one stays, the first in
    the order of their texts.  The texts are shuffled once, into a table bucketed by id; the
    candidates' texts and the rows that stay are both taken from it without another shuffle.
    """
    own = own_prefix(docs.columns)
    copy, again_id, nth = f"{own}copy", f"{own}repeated", f"{own}nth"
    docs = bucketed(docs, id_col)
    found = staged(NgramJoin(docs, id_col, text_col, n, num, den, is_bucketed=True).components().where("n_shingles > 0 AND doc_id IS NOT NULL"), "ngram-found")
    copies = found.where("component_id < doc_id").select(F.col("doc_id").alias(copy)).distinct()
    kept = docs.join(copies, F.col(f"`{id_col}`") == F.col(copy), "left_anti")
    repeated = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again_id))
    if not repeated.take(1):
        return kept
    repeated = staged(repeated, "ngram-repeated")
    same = F.col(f"`{id_col}`") == F.col(again_id)
    order = F.row_number().over(Window.partitionBy(id_col).orderBy(F.length(F.trim(F.coalesce(text_col, F.lit("")))) == 0, text_col))
    once = kept.join(repeated, same, "left_semi").withColumn(nth, order).where(F.col(nth) == 1).drop(nth)
    return kept.join(repeated, same, "left_anti").unionByName(once)


#: The same components in DuckDB SQL, from all pairs that share a shingle.
COMPONENTS_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
lists AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w),
sizes AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM lists),
tokens AS (SELECT doc_id, unnest(shingles) AS s FROM lists),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM tokens x JOIN tokens y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sizes UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v WHERE links.b > reach.r)
SELECT sizes.doc_id, n AS n_shingles, min(r) AS component_id FROM sizes JOIN reach ON v = sizes.doc_id GROUP BY 1, 2
"""
