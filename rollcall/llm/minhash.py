"""MinHash fingerprints, edited texts, and near-duplicate components by signature bands.

Signatures take the minimum of 128 permutations ``a x + b mod 2**32`` (a odd) of the word
shingles' hashes, in vectorised numpy.  A fingerprint is 16 bits of each minimum in hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm import kernel
from rollcall.operators.components import connected_components
from rollcall.stage import drop_stage, staged, task_count

PERMUTATIONS = 128
SHINGLE_WORDS = 5
#: Bands of four rows: at a similarity of 0.8 a pair misses all 32 with a probability of 5e-8.
BANDS = 32
#: Pairs that share a band are held against the low bits of all their minima before their texts are: at a similarity of 0.8 24 of
#: 128 differ on average, and more than this with a probability of 1e-5; at 0.5 it is 60.
SKETCH_BITS, MOST_DIFFERENT = 4, 45
#: Members of a bucket that its hub has not joined are held against a bit of each of so many further minima, of which 102 differ on average at 0.8,
#: and more than this with a probability of 1e-5; at 0.7 it is 154.
FINE_MINIMA, FINE_DIFFERENT = 1024, 145
_rng = np.random.Generator(np.random.PCG64(7919))
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_FINE_A = _rng.integers(0, 1 << 31, FINE_MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_B = _rng.integers(0, 1 << 32, FINE_MINIMA, dtype=np.uint32)
EMPTY = np.uint32(0xFFFFFFFF)


def signatures(sets: list[np.ndarray], a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """A row of minima, one for each permutation, for each set of 64-bit shingle hashes; an empty set has the largest value throughout."""
    out = np.full((len(sets), len(a)), EMPTY, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(len(a)):
            out[full, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
    return out


def _digits(rows: np.ndarray) -> np.ndarray:
    """16 mixed bits of each minimum."""
    return ((rows * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2")


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal minima, an estimate of the Jaccard similarity of the shingle sets."""
    return float((_digits(one) == _digits(other)).mean())


def fingerprint(row: np.ndarray) -> str:
    return _digits(row).tobytes().hex()


def _sets(texts: list[bytes], key: kernel.Key | None = None) -> list[np.ndarray]:
    return [s for block in kernel.blocks(pa.array(texts, pa.large_binary())) for s in kernel.shingle_sets(block, SHINGLE_WORDS, False, key)]


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


QUERY_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
)
#: Kinds of rows in a range, in their order: an id's component, its documents, and the first text of the next range.
COMPONENT, DOCUMENT, CLOSING = 0, 1, 2


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"]

    def flush(rows: list[tuple[int | None, str, int | None]], following: list[str]) -> pa.RecordBatch:
        """Fingerprints of ``rows``; ``following`` has the text after each."""
        edited = [edited_text(text, after) for (_, text, _), after in zip(rows, following)]
        plain = [text for _, text, _ in rows] + [following[-1]]
        raw = [t.encode() for t in plain + edited]
        signed = signatures(_sets(raw))
        own, changed = signed[: len(plain)], signed[len(plain) :]
        columns = [
            pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw[len(plain) :]]), pa.array([fingerprint(x) for x in own[:-1]]),
            pa.array([fingerprint(x) for x in changed]), pa.array([likeness(x, y) for x, y in zip(own[:-1], changed)], pa.float64()),
            pa.array([likeness(x, y) for x, y in zip(own[:-1], own[1:])], pa.float64()), pa.array([c for _, _, c in rows], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    held: list[tuple[int | None, str, int | None]] = []
    size, span, of_id = 0, None, (None, None)
    for batch in batches:
        for at, kind, doc_id, text, component in zip(*batch.columns):
            at, kind, doc_id = at.as_py(), kind.as_py(), doc_id.as_py()
            if span is not None and at != span:
                raise ValueError("a range of documents has no closing row")
            span = at
            if kind == COMPONENT:
                of_id = (doc_id, component.as_py())
                continue
            text = text.as_py()
            if held and (kind == CLOSING or size >= kernel.BLOCK_BYTES):
                yield flush(held, [t for _, t, _ in held[1:]] + [text])
                held, size = [], 0
            if kind == CLOSING:
                span = None
            else:
                held.append((doc_id, text, (of_id[1] if of_id[0] == doc_id else None) if doc_id is not None else None))
                size += len(text)


def _span(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds``, which ascend, below ``key``: first among every k-th of them, then in the stretch found."""
    if not bounds:
        return F.lit(0)
    k = max(1, round(len(bounds) ** 0.5))
    below = lambda found: F.size(F.filter(found, lambda bound: bound < key))
    whole = F.lit(np.array(bounds, np.int64))  # one literal, as is the next; generated code refers to them
    coarse = below(F.lit(np.array([bounds[min(i + k, len(bounds)) - 1] for i in range(0, len(bounds), k)], np.int64)))
    return (F.least(coarse * k, F.lit(len(bounds))) + below(F.slice(whole, coarse * k + 1, F.lit(k)))).cast("int")


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, components: DataFrame | None = None
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, one row per input row.

    The edited text takes characters from the next document in ascending order of id; the
    last one is followed by the first.  A null text is empty.  Null ids come first, and rows
    with equal ids stand in the order of their texts.  A document alone follows itself.  Only
    the id and text columns are read; an empty table gives no rows.

    Ranges of ids are laid out one to a partition, each closed by a copy of the next
    range's first row, so texts are shuffled once and no partition waits for another.
    ``components`` (``doc_id, component_id``, an id once) travel in the same shuffle and give
    the last column; it is null without them and for rows without an id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = ranges or task_count(docs)
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))  # range i has the keys above bounds[i - 1] up to bounds[i]
    placed = rows.withColumn("span", _span(F.col("key"), bounds))
    # One row for each range: its smallest key, at most as many as there are partitions.
    heads = {r.span: r.key for r in placed.groupBy("span").agg(F.min("key").alias("key")).collect()}
    if not heads:
        return spark.createDataFrame([], QUERY_SCHEMA)
    order = sorted(heads)
    # The range that a head closes: 12 bytes for each partition.
    closes = spark.createDataFrame([(heads[s], order[i - 1]) for i, s in enumerate(order)], "key long, closes int")
    head_rows = placed.join(F.broadcast(closes), "key").groupBy("key", "closes").agg(F.min("text").alias("text"))
    none = F.lit(None).cast("long")
    closing = head_rows.select(
        F.col("closes").alias("span"),
        F.lit((1 << 63) - 1).alias("key"), F.lit(CLOSING).alias("kind"), none.alias("doc_id"), "text", none.alias("component_id"),
    )
    laid = placed.select("span", "key", F.lit(DOCUMENT).alias("kind"), "doc_id", "text", none.alias("component_id")).union(closing)
    if components is not None:
        known = components.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), "component_id")
        laid = laid.union(known.select(_span(F.col("key"), bounds).alias("span"), "key", F.lit(COMPONENT).alias("kind"), F.col("key").alias("doc_id"), F.lit("").alias("text"), "component_id"))
    laid = laid.repartitionById(len(bounds) + 1, F.col("span"))
    last = F.col("kind") == CLOSING  # after the documents of the largest id too
    sorted_rows = laid.sortWithinPartitions("span", last, "key", "kind", "text")
    return sorted_rows.select("span", "kind", "doc_id", "text", "component_id").mapInArrow(_fingerprint_rows, QUERY_SCHEMA)


def fingerprint_and_link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprint_documents`` with the component of verified near-duplicates that each document belongs to.

    Of rows that repeat an id with several texts, the smallest component counts.
    """
    linked = near_duplicates(docs, id_col, text_col)
    components = staged(linked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "minhash-components")
    return fingerprint_documents(docs, id_col, text_col, components=components)


def _planes(rows: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The lowest ``bits`` mixed bits of the minima, plane by plane, in 64-bit words."""
    planes = [np.packbits((_digits(rows) >> k) & 1, axis=1) for k in range(bits)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view("<i8")


def _alike(one: Column, other: Column, minima: int = PERMUTATIONS, bits: int = SKETCH_BITS, most: int = MOST_DIFFERENT) -> Column:
    """Whether at most ``most`` minima differ in the planes of two rows."""
    words = minima // 64
    differ = lambda w: reduce(lambda x, y: x.bitwiseOR(y), (one[k * words + w].bitwiseXOR(other[k * words + w]) for k in range(bits)))
    return reduce(lambda x, y: x + y, (F.bit_count(differ(w)) for w in range(words))) <= most


def _fine_rows(key: kernel.Key) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                sets = list(kernel.shingle_sets(block, SHINGLE_WORDS, False, key))
                planes = pa.array(list(_planes(signatures(sets, _FINE_A, _FINE_B), 1)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, len(block)), pa.array([len(s) for s in sets], pa.int32()), planes], ["rep", "n", "fine"])

    return run


def _signature_rows(key: kernel.Key) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                sets = list(kernel.shingle_sets(block, SHINGLE_WORDS, False, key))
                rows = signatures(sets)
                bands = np.stack([kernel.mix(np.bitwise_xor.reduce(kernel.mix(part.astype(np.uint64) + np.arange(part.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1) + np.uint64(i)) for i, part in enumerate(np.split(rows, BANDS, axis=1))], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.row0, len(block)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array(list(_planes(rows)), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "bits"],
                )

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id``: components of verified pairs that share a signature band, one row per input row.

    Equal sets are one class.  In each band's bucket members first meet its hub, the member
    whose buckets are fullest: of a group of edited copies that is the text they were edited
    from, whose bands they all share.  Links verified by the Jaccard similarity of the whole five-word shingle sets merge classes, and
    members of a bucket that are still apart then meet as well, each pair in one of the buckets it shares, held against longer
    sketches.  So every pair that shares a band, might join two components and has sketches that fit the similarity is verified.  Texts without words are alone, as are
    rows without an id.  Other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = kernel.fresh_key(SHINGLE_WORDS)  # of this run's links; fingerprints stay the same from run to run
    signed = staged(texts.mapInArrow(_signature_rows(key), "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "minhash-signed")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", "bits", F.col("n_shingles").cast("int").alias("n"))).alias("own")).select("digest", "rep", "own.*")
    classes = staged(classes, "minhash-classes")
    members = staged(signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")), "minhash-members")
    drop_stage(signed)
    buckets = classes.select("rep", F.explode("bands").alias("band"), "bits", "n")
    held = staged(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "minhash-held")
    rows = sharing = staged(buckets.join(held, "band"), "minhash-sharing")
    weights = staged(rows.groupBy("rep").agg(F.sum("held").alias("weight")), "minhash-weights")
    rows = rows.join(weights, "rep").select("band", "rep", "bits", "n", "weight")
    hubs = rows.groupBy("band").agg(F.max(F.struct("weight", F.negative("rep").alias("last"), "rep", "bits", "n")).alias("hub"))
    hubs = staged(hubs.select("band", F.col("hub.rep").alias("hub"), F.col("hub.bits").alias("hub_bits"), F.col("hub.n").alias("hub_n")), "minhash-hubs")
    shared = staged(rows.select("band", "rep", "bits", "n").join(hubs, "band"), "minhash-buckets")
    reps = staged(classes.select("digest", "rep"), "minhash-reps")
    drop_stage(classes, held, hubs, weights, sharing)

    def fits(n: str, m: str) -> Column:
        """Whether sets of these sizes can be similar enough."""
        return (den * F.col(n) >= num * F.col(m)) & (den * F.col(m) >= num * F.col(n))

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = staged(ids.distinct(), "minhash-ids")
        kept = staged(texts.join(ids, "doc_id", "left_semi"), "minhash-texts")
        drop_stage(ids)
        return kept

    def verified(pairs: DataFrame, kept: DataFrame | None = None) -> DataFrame:
        pairs = staged(pairs, "minhash-pairs")
        kept = kept or texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
        rows = pairs.join(kept.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(
            kept.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"
        )
        links = staged(rows.select("a", "b", "text_a", "text_b").mapInArrow(_verify(num, den, key), "a long, b long").distinct(), "minhash-links")
        drop_stage(pairs, kept)
        return links

    hub_links = verified(shared.where((F.col("rep") != F.col("hub")) & fits("n", "hub_n") & _alike(F.col("bits"), F.col("hub_bits"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    labels = connected_components(hub_links, "a", "b")
    unjoined = rows = staged(_unjoined(shared, labels), "minhash-unjoined")
    drop_stage(shared, labels)
    kept = texts_of(rows.select(F.col("rep").alias("doc_id")))
    fine = kept.mapInArrow(_fine_rows(key), "rep long, n int, fine array<long>").distinct()  # an id may have several texts
    rows = rows.where("NOT is_hub")
    profiles = staged(rows.groupBy("rep", "n").agg(F.collect_set("band").alias("bands")).join(fine, ["rep", "n"]), "minhash-profiles")
    rest = verified(_apart(rows.join(profiles, ["rep", "n"]), fits), kept)
    labels = connected_components(hub_links.union(rest), "a", "b").select(F.col("id").alias("rep"), "component")
    of_class = staged(reps.join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "minhash-labels")
    drop_stage(unjoined, profiles, hub_links, rest, reps)
    return members.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _unjoined(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels and their hub's, of buckets in which some member is outside the hub's component."""
    label = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_label"))
    rows = shared.join(label("rep"), "rep", "left").join(label("hub"), "hub", "left").select(
        "band", "rep", "n", F.coalesce("rep_label", "rep").alias("label"), F.coalesce("hub_label", "hub").alias("home"), (F.col("rep") == F.col("hub")).alias("is_hub")
    )
    return rows.join(rows.where("label <> home").select("band").distinct(), "band", "left_semi")


def _apart(rows: DataFrame, fits: Callable) -> DataFrame:
    """Pairs of bucket members with different labels, hubs aside; one of each pair is outside its hub's component.

    A pair is listed in the smallest of the buckets that it shares.
    """
    outside = rows.where("label <> home").select("band", F.col("rep").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("bands").alias("bands_a"), F.col("fine").alias("fine_a"))
    other = rows.select("band", F.col("rep").alias("b"), F.col("label").alias("label_b"), "home", F.col("n").alias("n_b"), F.col("bands").alias("bands_b"), F.col("fine").alias("fine_b"))
    meet = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("home")) | (F.col("a") < F.col("b")))
    alike = _alike(F.col("fine_a"), F.col("fine_b"), FINE_MINIMA, 1, FINE_DIFFERENT)
    first = F.array_min(F.array_intersect("bands_a", "bands_b")) == outside.band
    met = outside.join(other, (outside.band == other.band) & meet & fits("n_a", "n_b") & alike & first)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(num: int, den: int, key: kernel.Key) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(2), batch.column(3)):
                if hub is None or text_a != hub:  # rows come sorted by a
                    hub, hub_set = text_a, _sets([text_a.as_py().encode()], key)[0]
                other = _sets([text_b.as_py().encode()], key)[0]
                both = np.intersect1d(hub_set, other, assume_unique=True).size
                keep.append(den * both >= num * (len(hub_set) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run
