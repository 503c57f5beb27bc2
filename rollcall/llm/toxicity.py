"""Toxicity by maximum-scoring segments of token log-odds.

Token log-odds between toxic and other labelled texts have an informative Dirichlet prior
taken from the counts of the whole corpus.  A linear-time scan (all maximal scoring
subsequences) finds every passage whose log-odds add up, and an extreme-value law, fitted
to the best passages of non-toxic texts, says how far a passage stands out from what a
text of that length has by chance.  Passages beyond a significance level are summed, and
a logistic curve on the labelled rows turns the evidence into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm import kernel, samples, sketch
from rollcall.stage import drop_stage, staged

#: Bound on labelled rows used for training; it also bounds the broadcast of their ids.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 19
#: A word's features: itself and its first bytes, so that unseen forms of a stem share evidence.
STEMS = (7, 6, 5, 4)
#: The prior: pseudo-counts of each feature, and those shared out by the corpus.  The |z| below which a feature is
#: neutral, and a neutral token's score.
PRIOR_EACH = 0.5
PRIOR_TOKENS = 5_000.0
MIN_Z = 4.0
DRIFT = 0.03
MOST_SCORE = 6.0
#: Passages with an expected number by chance, in a text of that length, of at most this are significant.
SIGNIFICANT = 0.05
THRESHOLD = 0.3

# Anything but ASCII letters, digits, apostrophes and non-ASCII bytes separates tokens.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def token_features(block: kernel.Block) -> tuple[kernel.Words, list[np.ndarray]]:
    """Tokens of a block, and for each kind of feature the bucket of every token's feature."""
    block = kernel.lowered(block)
    found = kernel.words(block, SEPARATOR)
    ends = [found.end, *(np.minimum(found.end, found.start + n) for n in STEMS)]
    out = []
    for kind, end in enumerate(ends):
        hashes = kernel.mix(kernel.span_hashes(block.data, found.start, end) + np.uint64(kind))
        out.append((hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
    return found, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each feature, by class: 0 other labelled texts, 1 toxic ones, 2 all texts.

    A feature counts once a text, as a word that one text repeats says little about others.
    """
    counts = np.zeros((3, BUCKETS), np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for block in kernel.blocks(batch.column(0)):
            found, features = token_features(block)
            owner = found.owner()
            for buckets in features:
                once = np.unique(owner * BUCKETS + buckets)
                held, own = once % BUCKETS, labels[block.row0 + once // BUCKETS]
                counts[2] += np.bincount(held, minlength=BUCKETS)
                for label in (0, 1):
                    if (mine := held[own == label]).size:
                        counts[label] += np.bincount(mine, minlength=BUCKETS)
    yield from sketch.chunk_rows(counts.ravel())


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each feature, toxic against other, and their certainty.

    The Dirichlet prior follows the corpus, in proportion to the classes' sizes.  The
    certainty is the signed root of the likelihood ratio, which like a z-score is normal
    for a feature without a bearing but stays right for one that a class never has.
    """
    other, toxic, corpus = counts.astype(np.float64)
    sums = np.array([toxic.sum(), other.sum()]) + 1.0
    prior = PRIOR_EACH + PRIOR_TOKENS * corpus / max(corpus.sum(), 1.0)
    share = sums / sums.sum()
    odds = [np.log(own + 2 * part * prior) - np.log(total + 2 * part * prior.sum()) for own, part, total in zip((toxic, other), share, sums)]
    seen = toxic + other
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = sum(np.where(own > 0, own * np.log(own / (seen * part)), 0.0) for own, part in zip((toxic, other), share))
    return odds[0] - odds[1], np.sign(odds[0] - odds[1]) * np.sqrt(2 * np.maximum(ratio, 0.0))


def token_scores(features: list[np.ndarray], delta: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A token's score: the log-odds of its most certain feature, or a small penalty if none is certain."""
    best, score = z[features[0]], delta[features[0]]
    for buckets in features[1:]:
        other = z[buckets]
        score = np.where(np.abs(other) > np.abs(best), delta[buckets], score)
        best = np.where(np.abs(other) > np.abs(best), other, best)
    return np.where(np.abs(best) >= MIN_Z, np.clip(score, -MOST_SCORE, MOST_SCORE), 0.0) - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences ``(start, end, score)`` in linear time.

    Candidates stand on a stack; each knows the nearest earlier one whose left sum is
    lower, so a new candidate skips all that can't absorb it.
    """
    positive = scores > 0
    if not positive.any():
        return []
    change = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(scores)]])
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    runs = positive[starts]
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, link
    for start, end in zip(starts[runs].tolist(), ends[runs].tolist()):
        left, right = sums[start], sums[end]
        while True:
            at = len(stack) - 1
            while at >= 0 and stack[at][2] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= right:
                stack.append((start, end, left, right, at))
                break
            start, left = stack[at][0], stack[at][2]
            del stack[at:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


EVIDENCE_SCHEMA = "doc_id long, n_tokens long, best double, significant double, passages array<struct<start:long,end:long,score:double>>"


@dataclass
class Gumbel:
    """Extreme-value law of the best passage score of a text of n tokens: location ``mu + beta ln n``, scale ``beta``."""

    mu: float
    beta: float

    def expected(self, score: float, n: int) -> float:
        return n * math.exp(min(50.0, -(score - self.mu) / self.beta))


def _evidence(shared, law: Gumbel | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta, z = shared.value
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                found, features = token_features(block)
                scores = token_scores(features, delta, z)
                best, total, spans = [], [], []
                for i in range(len(block)):
                    lo, hi = found.first[i], found.first[i + 1]
                    segments = maximal_segments(scores[lo:hi])
                    best.append(max((s for _, _, s in segments), default=0.0))
                    if law:
                        segments = [x for x in segments if law.expected(x[2], int(hi - lo)) <= SIGNIFICANT]
                    spans.append([{"start": int(found.start[lo + s] - block.offsets[i]), "end": int(found.end[lo + e - 1] - block.offsets[i]), "score": v} for s, e, v in segments] if law else [])
                    total.append(sum(v for _, _, v in segments))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.row0, len(block)), pa.array(found.counts, pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(spans, kind)],
                    ["doc_id", "n_tokens", "best", "significant", "passages"],
                )

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls; the first column is the constant.

    A whole step from where the classes are almost apart can lead far beyond the minimum, to where
    all rows are certain and no further step comes back.
    """
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-2)
    loss = lambda w: np.logaddexp(0.0, np.where(y == 1, -1.0, 1.0) * (x @ w)).sum() + ridge @ (w * w) / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        if np.abs(step).max() < 1e-8:
            break
        now, part, gain = loss(w), 1.0, slope @ step
        while part > 1e-9 and not loss(w + part * step) <= now - 1e-4 * part * gain:
            part /= 2
        if part <= 1e-9:
            break  # as low as doubles tell
        w += part * step
    return w


def _inputs(best, significant, n, law: Gumbel, log1p, log):
    """Inputs of the calibration curve; the same formula for numpy arrays and columns."""
    standard = (best - law.mu) / law.beta - log(n + 1.0)
    return [log1p(significant), log1p(best), standard / 10.0]


def _law(n: np.ndarray, best: np.ndarray, label: np.ndarray) -> Gumbel:
    """The law of the best passages of non-toxic texts, by the method of moments; a floor keeps the scale sane where nothing scores."""
    clean = (label == 0) & (n > 0)
    if not clean.any() or not (label == 1).any():
        return Gumbel(0.0, 1.0)
    values = np.sort(best[clean])[: max(1, int(0.995 * clean.sum()))]
    beta = max(float(values.std()) * math.sqrt(6) / math.pi, 0.5)
    mu = float(np.mean(values - beta * np.log(np.sort(n[clean])[: len(values)] + 1.0)) - 0.5772 * beta)
    return Gumbel(mu, beta)


def _curve(n: np.ndarray, best: np.ndarray, significant: np.ndarray, label: np.ndarray, law: Gumbel) -> np.ndarray:
    """Weights of the logistic curve, fitted on the same evidence that is scored; a fixed low score where a class is missing."""
    if not ((label == 0) & (n > 0)).any() or not (label == 1).any():
        return np.array([-3.0, 0.0, 0.0, 0.0])
    return _logistic(np.column_stack([np.ones(len(n)), *_inputs(best, significant, n, law, np.log1p, np.log)]), label)


class ToxicityModel:
    """Trained on labelled rows that are not held out; labels, language, source and id never enter a score."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS):
        spark = docs.sparkSession
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        sample = staged(samples.labelled_sample(labels, label_col, rows, ~held_out(F.col("doc_id")), id_col), "toxic-sample")
        # The sample has at most ``rows`` rows of 12 bytes.
        known = texts.join(F.broadcast(sample), "doc_id", "left")
        counts = sketch.collect_counts(known.select("text", F.coalesce("label", F.lit(2)).alias("label")), _count, 3 * BUCKETS).reshape(3, BUCKETS)
        delta, z = log_odds(counts)
        self.table = spark.sparkContext.broadcast((delta.astype(np.float32), z.astype(np.float32)))
        train = staged(samples.one_text_each(texts.join(F.broadcast(sample), "doc_id"), "label"), "toxic-train")
        drop_stage(sample)
        n, best, _, label = self._seen(train, None)
        self.law = _law(n, best, label)
        n, best, significant, label = self._seen(train, self.law)  # now with the passages that count as significant
        self.weights = _curve(n, best, significant, label, self.law)
        drop_stage(train)

    def _seen(self, train: DataFrame, law: Gumbel | None) -> list[np.ndarray]:
        """Tokens, best passage, sum of significant passages and label of the training rows; they are bounded by the sample."""
        columns = ["n_tokens", "best", "significant", "label"]
        found = train.select("doc_id", "text").mapInArrow(_evidence(self.table, law), EVIDENCE_SCHEMA).join(train.select("doc_id", "label"), "doc_id")
        seen = found.orderBy("doc_id").select(*columns).toPandas()
        return [seen[c].to_numpy(np.float64) for c in columns]

    def evidence(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Tokens, best passage, sum of significant passages and those passages (byte spans) of every text."""
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return texts.mapInArrow(_evidence(self.table, self.law), EVIDENCE_SCHEMA)

    def clean(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that are not predicted toxic, all columns unchanged.

        Null, empty and wordless texts and rows without an id are judged like others; repeated
        rows stay or go together; an empty table gives no rows.
        """
        at, shared, law, weights = docs.columns.index(text_col), self.table, self.law, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            collect = _evidence(shared, law)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = pa.array(np.arange(batch.num_rows))
                found = pa.Table.from_batches(list(collect([pa.RecordBatch.from_arrays([ids, batch.column(at)], ["doc_id", "text"])])))
                n, best, significant = (found.column(c).to_numpy().astype(np.float64) for c in ("n_tokens", "best", "significant"))
                line = weights[0] + sum(w * x for w, x in zip(weights[1:], _inputs(best, significant, n, law, np.log1p, np.log)))
                yield batch.filter(pa.array(1 / (1 + np.exp(-line)) < THRESHOLD))

        return docs.mapInArrow(run, docs.schema)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, held_out, score, predicted`` and the evidence, one row per input row.

        A null or empty text has no tokens and gets the score of no evidence at all.  Rows
        without an id are not held out; repeated rows get equal scores; other columns are not
        read; an empty table gives no rows.
        """
        found = self.evidence(docs, id_col, text_col)
        inputs = _inputs(F.col("best"), F.col("significant"), F.col("n_tokens"), self.law, F.log1p, F.log)
        line = F.lit(float(self.weights[0]))
        for w, x in zip(self.weights[1:], inputs):
            line = line + F.lit(float(w)) * x
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-line))
        return found.withColumn("score", score).select(
            "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
            "n_tokens", "best", "significant", "passages",
        )
