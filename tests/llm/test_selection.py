"""Importance resampling, near-duplicate vectors and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import gridjoin, kernel, negatives, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _features(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + size]) for size in range(1, n + 1) for i in range(len(w) - size + 1)]


def _importance(rows, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(r[0], *_features(r[1], n)) for r in rows]
    s = Counter(bucket(f) for *_, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in _features(x[1], n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for i, words, fs in found:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, words, len(fs), weight, score))
    order = sorted((r for r in out if r[4] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], r[2], r[3]))
    ranks = Counter()
    drawn = {}
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        drawn.setdefault(r, []).append(k)
    for r in out:
        left = drawn.get(r, [])
        ranks[(*r, left.pop(0) if left else None)] += 1
    return ranks


TARGET = [(1, "The quick BROWN fox"), (2, None), (3, ""), (4, "abc deü é ß a-b c's 12 x"), (4, "abc abc")]


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (2, 500, 40), (3, 65_536, 100)])
def test_importance_scores(spark, docs, rows, n, buckets, percent):
    target = spark.createDataFrame([(*t, "x") for t in TARGET], "item_id long, text string, doc_id string")
    got = resample.importance_scores(docs, target, n=n, buckets=buckets, percent=percent).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got) == _importance(rows, TARGET, n, buckets, percent, 20)


def test_importance_of_long_texts_and_words(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcXYZ09é日") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    rows = [(1, " ".join(rng.choice(vocabulary) for _ in range(80_000))), (2, "é" * 200_000), (3, "-" * 300_000), (4, "a" * 64 + " " + "a" * 65 + " " + "b" * 300)]
    rows += [(5 + i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(40)]
    got = resample.importance_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(TARGET, "item_id long, text string"), percent=50).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got) == _importance(rows, TARGET, 1, 10_000, 50, 20)


def test_importance_of_empty_tables(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.importance_scores(empty, none).collect() == []
    got = resample.importance_scores(docs, none).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got) == _importance(rows, [], 1, 10_000, 10, 20)


def test_resample_keeps_rows_whole(spark, docs, rows):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    drawn = {i for (i, *_, rank) in _importance(rows, TARGET, 1, 10_000, 30, 20) if rank is not None}
    kept = resample.resample(docs, target, percent=30)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] in drawn)


def test_checksums_carry_on():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 63, 64, 65, 200]))) for _ in range(300)]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    before = np.array([zlib.crc32(bytes([i % 256])) for i in range(len(spans))], np.uint32)
    got = resample.crc_extend(before, data, ends - [len(s) for s in spans], ends)
    assert got.tolist() == [zlib.crc32(bytes([i % 256]) + s) for i, s in enumerate(spans)]
    values, lengths = resample.run_lengths(np.array([3, 1, 3, 3, 65535, 1], np.uint16))
    assert (values.tolist(), lengths.tolist()) == ([1, 3, 65535], [2, 3, 1])
    assert kernel.words(next(kernel.blocks(__import__("pyarrow").array([""]))), resample.SEPARATOR).counts.tolist() == [0]


def _vectors(seed, n, dims):
    """Random vectors, groups of near copies at about the threshold, exact copies, odd rows and repeated ids."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    for k in range(0, n // 2, 2):
        centre = base[(k // 20) * 20]
        base[k] = centre + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.14, 0.2])
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(3))) for i, v in enumerate(base)]
    rows += [(n + i, list(rows[i][1]), rows[i][2]) for i in range(0, n, 9)] + [(2 * n + i, [-x for x in rows[i][1]], rows[i][2]) for i in range(0, n, 15)]
    rows += [(3 * n + i, [2.0 * x for x in rows[i][1]], rows[i][2]) for i in range(0, n, 11)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [nan] * dims, [inf] + [0.0] * (dims - 1), [1.0] * (dims - 1), [1.0] * (dims - 1), [-0.0] + [1.0] * (dims - 1), [0.0] + [1.0] * (dims - 1)]
    rows += [(4 * n + 3 + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[0][1], 0), (4 * n + 50, rows[0][1], None), rows[7], rows[7]]
    return rows


def _whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _near(rows, threshold, labelled=True):
    links, ids = [0] * len(rows), {r[0] for r in rows}
    label = {i: i for i in ids}
    able = [k for k, r in enumerate(rows) if r[0] is not None and (r[2] is not None or not labelled) and _whole(r[1]) and any(r[1])]
    pairs = []
    for a in able:
        for b in able:
            x, y = rows[a][1], rows[b][1]
            if a != b and (rows[a][2] == rows[b][2] or not labelled) and len(x) == len(y):
                if sum(p * q for p, q in zip(x, y)) / (math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y))) >= threshold:
                    links[a] += 1
                    pairs.append((rows[a][0], rows[b][0]))
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if label[b] < label[a]:
                label[a], moved = label[b], True
    return Counter((r[0], n, label[r[0]], r[0] == label[r[0]]) for r, n in zip(rows, links))


EMBEDDINGS = "vec_id long, embedding array<{}>, label int, rep string, links int, component_id string, `low` int"


def _frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "r", 1, "c", 2) for r in rows], EMBEDDINGS.format(kind)).repartition(5)


@pytest.mark.parametrize(("kind", "dims", "threshold", "block"), [("float", 12, 0.98, 2048), ("double", 12, 0.98, 7), ("float", 3, 0.9, 16), ("double", 40, 0.999, 5), ("float", 12, 0.3, 32)])
def test_near_vectors(spark, kind, dims, threshold, block):
    rows = _vectors(dims, 160, dims)
    got = gridjoin.near_duplicates(_frame(spark, rows, kind), threshold, block=block).collect()
    assert Counter(tuple(r) for r in got) == _near(rows, threshold)


def test_near_vectors_without_labels_and_of_nothing(spark):
    rows = _vectors(9, 60, 6)
    got = gridjoin.near_duplicates(_frame(spark, rows), 0.95, label_col=None, block=9).collect()
    assert Counter(tuple(r) for r in got) == _near(rows, 0.95, labelled=False)
    assert gridjoin.near_duplicates(_frame(spark, []), 0.98).collect() == []
    nothing = [(1, None, 1), (2, [0.0], 1), (None, None, None)]
    assert Counter(tuple(r) for r in gridjoin.near_duplicates(_frame(spark, nothing), 0.98).collect()) == _near(nothing, 0.98)


def test_a_hot_group_gives_no_pairs(spark):
    """Half of all rows are near copies of one vector; a block pair gives a row for each vector with a link."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.02 * rng.normal(size=16) if i % 2 else rng.normal(size=16)).tolist(), 1) for i in range(600)]
    got = {r.vec_id: r for r in gridjoin.near_duplicates(_frame(spark, rows, "double"), 0.98, block=40).collect()}
    assert all(got[i].n_links == 299 and got[i].component_id == 1 for i in range(1, 600, 2))
    assert sum(r.kept for r in got.values()) == 301


def test_distant_blocks_are_skipped(spark):
    """Pairs of blocks grow with the number of blocks where the vectors have few dimensions."""
    rng = np.random.default_rng(6)
    raw = np.column_stack([np.ones(4000), rng.uniform(-3, 3, (4000, 2))])
    unit = gridjoin.unit_vectors(raw)
    grid = gridjoin.Grid(0.9995, np.linalg.eigh(np.cov(unit.T))[1][:, ::-1])
    places = grid.places(unit)
    order = np.argsort(grid.keys(places), kind="stable")
    boxes = [(k, "x", 12, places[at].min(axis=0).tolist(), places[at].max(axis=0).tolist()) for k, at in enumerate(np.array_split(order, 250))]
    frame = spark.createDataFrame(boxes, "seq long, label string, width int, low array<double>, high array<double>")
    got = {(r.i, r.j) for r in gridjoin.near_pairs(frame, len(boxes), grid).collect()}
    gap = lambda a, b: sum(max(0, lb - ha, la - hb) ** 2 for la, ha, lb, hb in zip(a[3], a[4], b[3], b[4]))
    assert got == {(a[0], b[0]) for a in boxes for b in boxes if a[0] <= b[0] and gap(a, b) <= grid.square}
    assert len(got) < 0.15 * 250 * 251 / 2


def _mined(rows, positives=5, k=10, low=30, high=90):
    use = [(i, tuple(max(-negatives.MOST, min(negatives.MOST, math.floor(256 * x))) for x in v), label) for i, v, label in rows if i is not None and label is not None and _whole(v)]
    anchors = {}
    for i, v, label in use:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(p * q for p, q in zip(a, b))

    def best(found, k):
        once = {}
        for i, s in found:
            once[i] = max(once.get(i, s), s)
        return sorted(once.items(), key=lambda x: (-x[1], x[0]))[:k]

    out = []
    for a, (label, v) in anchors.items():
        scored = [(i, score(v, w), other) for i, w, other in use]
        for p, ps in best([(i, s) for i, s, other in scored if other == label and i != a], positives):
            fits = [(i, s) for i, s, other in scored if other != label and low * ps <= 100 * s <= high * ps]
            out += [(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(best(fits, k), 1)]
    return Counter(out)


@pytest.mark.parametrize(("dims", "block", "slice_bytes"), [(8, 4096, 64 << 20), (5, 37, 64 << 20), (8, 64, 2200)])
def test_hard_negatives(spark, dims, block, slice_bytes):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(dims)
    rows = [(10 * i, (rng.normal(size=dims) * rng.choice([0.1, 1.0, 30.0])).tolist(), int(rng.integers(4))) for i in range(350)]
    rows += _vectors(dims, 40, dims)
    got = negatives.HardNegatives(_frame(spark, rows, "double"), block=block, slice_bytes=slice_bytes).mine(F.col("id") % 100 == 0).collect()
    assert Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == _mined(rows)
    assert len(got) > 100


def test_hard_negatives_of_ties_extremes_and_nothing(spark):
    from pyspark.sql import functions as F

    same = [(i, [1.0, 0.5], i % 2) for i in range(300)] + [(100, [1.0, 0.5], 0), (1000, [1e300, -1e300], 1), (1001, [3e8, 2e8], 0), (1100, [1e9, 2e9], 1)]
    same += [(2000 + i, [0.6, 0.1 * i], 1 - i % 2) for i in range(30)]
    got = negatives.HardNegatives(_frame(spark, same, "double"), block=50).mine(F.col("id") % 100 == 0).collect()
    assert Counter(tuple(r) for r in got) == _mined(same)
    assert negatives.HardNegatives(_frame(spark, [])).mine(F.col("id") % 100 == 0).collect() == []
    assert negatives.HardNegatives(_frame(spark, [(1, None, 1), (100, [], 2), (200, [1.0], None)])).mine(F.col("id") % 100 == 0).collect() == []


def test_table_scores_bound_the_true_ones():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-300, 300, (700, 13)).astype(np.int32)
    books = negatives.codebooks(vectors[:200])
    codes, rest = negatives.encoded(vectors, books)
    block = object.__new__(negatives.Block)
    block.ids, block.vectors, block.codes, block.rest = np.arange(700), vectors, codes, rest
    block.longest = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max()))
    about, off = block.bounds(vectors[:50], books)
    exact = vectors[:50].astype(np.int64) @ vectors.T.astype(np.int64)
    assert (np.abs(about - exact) <= off).all()
    assert off.mean() < 0.25 * np.abs(exact).max()
