"""Quality rules: exact counts, and a hashed n-gram logistic regression with calibrated probability.

The model sees the mean of hashed word unigrams and bigrams and of character trigrams of a text.  It is
trained on a bounded sample of labelled rows, calibrated on a fifth of the sample that the
fit has not seen, and applied in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm import kernel, samples
from rollcall.stage import staged

#: Bound on the labelled rows that the classifier is fitted on.
TRAIN_ROWS = 4_000
WORDS = 1 << 16
CHARS = 1 << 16
FEATURES = 2 * WORDS + CHARS
SCALE = 30.0
STEPS = 120
#: Texts with fewer words, or a larger share of repeated ones in percent, fail the base rule.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Kept if the calibrated probability of good quality is at least this.
KEEP_PROBABILITY = 0.5
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def feature_parts(block: kernel.Block, found: kernel.Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kinds of features: buckets in reading order, and each text's first and last place among them."""
    singles = (hashes & np.uint64(WORDS - 1)).astype(np.int64)
    pairs = (kernel.grams(hashes, 2) & np.uint64(WORDS - 1)).astype(np.int64) + WORDS
    points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(points) >= 3:
        chars = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
        chars = ((chars ^ (chars >> np.uint32(15))) & np.uint32(CHARS - 1)).astype(np.int64) + 2 * WORDS
    else:
        chars = np.zeros(0, np.int64)
    places = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.offsets]  # of the texts, in code points
    lo, hi, at, end = found.first[:-1], found.first[1:], places[:-1], places[1:]
    return [(singles, lo, hi), (pairs, lo, np.maximum(hi - 1, lo)), (chars, at, np.maximum(end - 2, at))]


def base_counts(block: kernel.Block, found: kernel.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The exact counts of each text of a block."""
    data, offsets = block.data, block.offsets
    points = np.concatenate([[0], np.cumsum(~kernel.SPACE[data] & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    return {
        "n_words": found.counts, "word_chars": np.diff(points[offsets]), "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": _duplicate_lines(block), "n_repeat_words": _repeated_words(block, found, hashes),
    }


def _duplicate_lines(block: kernel.Block) -> np.ndarray:
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    lines = kernel.words(block, newline)  # empty lines have no word
    hashes = kernel.span_hashes(block.data, lines.start, lines.end)
    inked = np.concatenate([[0], np.cumsum(~kernel.SPACE[block.data])])
    worded = inked[lines.end] > inked[lines.start]
    owner = lines.owner()[worded]
    distinct = np.unique(np.stack([owner.astype(np.uint64), hashes[worded]], axis=1), axis=0)[:, 0] if len(owner) else owner
    n = len(block)
    out = np.bincount(owner, minlength=n) - np.bincount(distinct.astype(np.int64), minlength=n)
    start, end = lines.start[worded], lines.end[worded]
    for i in np.flatnonzero(out).tolist():  # equal hashes propose, bytes decide
        own = slice(*np.searchsorted(owner, [i, i + 1]))
        ids = kernel.exact_ids(block.data, start[own], end[own], hashes[worded][own])
        out[i] = len(ids) - len(np.unique(ids))
    return out


def _window_ids(ids: np.ndarray) -> np.ndarray:
    """A number for each three-word window: equal for equal runs of ``ids``, which are exact, and for no others."""
    pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    return np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True)[1]


def _repeated_words(block: kernel.Block, found: kernel.Words, hashes: np.ndarray) -> np.ndarray:
    runs, out = kernel.grams(hashes, 3), np.zeros(len(found.first) - 1, np.int64)
    for i, (lo, hi) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
        if hi - lo > 3:
            _, which, count = np.unique(runs[lo : hi - 2], return_inverse=True, return_counts=True)
            again = count[which] > 1
            if again.any():  # equal hashes propose, bytes decide
                windows = _window_ids(kernel.exact_ids(block.data, found.start[lo:hi], found.end[lo:hi], hashes[lo:hi]))
                again = np.bincount(windows)[windows] > 1
                covered = np.zeros(hi - lo, bool)
                for j in range(3):
                    covered[j : hi - lo - 2 + j] |= again
                out[i] = covered.sum()
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse mean features of each text."""
    for batch in batches:
        for block in kernel.blocks(batch.column(1)):
            found = kernel.words(block)
            parts = feature_parts(block, found, kernel.span_hashes(block.data, found.start, found.end))
            ids, values = [], []
            for i in range(len(block)):
                own = [np.unique(buckets[lo[i] : hi[i]], return_counts=True) for buckets, lo, hi in parts]
                ids.append(np.concatenate([x for x, _ in own]).astype("<i4").tobytes())
                values.append(np.concatenate([c / max(c.sum(), 1) for _, c in own]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.row0, len(block)), batch.column(2).slice(block.row0, len(block)), pa.array(ids, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "label", "ids", "vals"],
            )


def fit(ids: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias: full-batch Adam on the logistic loss with a little decay."""
    weights = np.zeros(FEATURES + 1)
    if len(labels) == 0:
        return weights
    flat, x = np.concatenate(ids).astype(np.int64), np.concatenate(values).astype(np.float64) * SCALE
    row = np.repeat(np.arange(len(labels)), [len(i) for i in ids])
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weights[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        line = np.bincount(row, weights[flat] * x, minlength=len(labels)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(line, -30, 30))) - labels
        gradient = np.bincount(flat, error[row] * x, minlength=FEATURES + 1) / len(labels)
        gradient[-1] = error.mean()
        gradient[:-1] += 1e-5 * weights[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return weights


def platt(lines: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a raw score into a probability, by Newton steps; the identity where a class is missing."""
    if len(np.unique(labels)) < 2:
        return 1.0, 0.0
    x, w = np.column_stack([lines, np.ones(len(lines))]), np.array([1.0, 0.0])
    target = np.where(labels == 1, ((labels == 1).sum() + 1) / ((labels == 1).sum() + 2), 1 / ((labels == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * (w - [1.0, 0.0]))
        w += np.clip(step, -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


SCORE_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, probability double"
)


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, offset = shared.value
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                found = kernel.words(block)
                hashes = kernel.span_hashes(block.data, found.start, found.end)
                counts = base_counts(block, found, hashes)
                line = np.full(len(block), bias)
                for buckets, lo, hi in feature_parts(block, found, hashes):
                    sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
                    line += SCALE * (sums[np.minimum(hi, len(buckets))] - sums[np.minimum(lo, len(buckets))]) / np.maximum(hi - lo, 1)
                probability = 1 / (1 + np.exp(-np.clip(slope * line + offset, -30, 30)))
                n = counts["n_words"]
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.row0, len(block)), *[pa.array(x, pa.int64()) for x in counts.values()],
                        pa.array(failed), pa.array(~failed & (probability >= KEEP_PROBABILITY)), pa.array(probability, pa.float64()),
                    ],
                    ["doc_id", *counts, "base_failed", "kept", "probability"],
                )

    return run


class QualityModel:
    """Fitted on at most ``rows`` labelled texts, one for each id; without labels every probability is one half and up."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS):
        spark = docs.sparkSession
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        sample = staged(samples.labelled_sample(labels, label_col, rows, id_col=id_col), "quality-sample")
        # The sample has at most ``rows`` rows of 12 bytes.
        train = samples.one_text_each(texts.join(F.broadcast(sample), "doc_id"), "label")
        features = train.mapInArrow(_features, "doc_id long, label int, ids binary, vals binary").orderBy("doc_id")
        ids, values, labels_, held = [], [], [], []
        for row in features.toLocalIterator():
            ids.append(np.frombuffer(row.ids, "<i4"))
            values.append(np.frombuffer(row.vals, "<f4"))
            labels_.append(row.label)
            held.append((row.doc_id * 0x9E3779B1 >> 8) % 5 == 0)
        y, held = np.array(labels_, np.float64), np.array(held, bool)
        pick = lambda xs, mask: [x for x, take in zip(xs, mask) if take]
        weights = fit(pick(ids, ~held), pick(values, ~held), y[~held])
        lines = np.array([float(np.dot(weights[i], v)) * SCALE + weights[-1] for i, v in zip(pick(ids, held), pick(values, held))])
        slope, offset = platt(lines, y[held])
        self.shared = spark.sparkContext.broadcast((weights[:-1].astype(np.float32), float(weights[-1]), slope, offset))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Counts, ``base_failed``, ``kept`` and the probability of good quality, one row per input row.

        A null or wordless text has no words and so fails the base rule.  Rows without an id
        and repeated rows are scored like others; other columns are not read; an empty table
        gives no rows.
        """
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return texts.mapInArrow(_score(self.shared), SCORE_SCHEMA)
