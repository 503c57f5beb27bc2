"""The pipeline's stages, each judged on its own input by brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import words

from rollcall.llm import secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    plain = ["w%d" % k for k in range(500)]
    rows, labels = [], []
    for i in range(400):
        own = list(rng.choice(plain, 80))
        if i % 5 == 0:
            for k in rng.integers(0, 80, 8):
                own[k] = "fies" + str(rng.integers(0, 9))
        if i % 7 == 1:
            own[3] = "password=hunter2hunter2"
        rows.append((i, " ".join(own), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(400 + k, rows[1][1] + f" tail{k}", "en", "s1", 0) for k in range(20)] + [(500, None, "en", None, 0), (501, "", "en", "s0", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.cache()
        seen[name] = (before, docs.collect())
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    toxic = {i for i in range(0, 400, 5)}
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) <= 4
    before, after = seen["ngram_jaccard"]
    sets = {r.doc_id: {tuple(words(r.text)[k : k + 5]) for k in range(len(words(r.text)) - 4)} for r in before}
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    kept = {r.doc_id for r in after}
    assert all(i in kept or any(j < i and linked(sets[i], sets[j]) for j in sets) for i in sets)
    assert not any(linked(sets[i], sets[j]) for i in kept for j in kept if i < j)
    before, after = seen["secrets"]
    assert Counter((r.doc_id, secrets.redact(r.text) if r.text else r.text) for r in before) == Counter((r.doc_id, r.text) for r in after)
    assert not any("hunter2" in (r.text or "") for r in after)
    before, after = seen["mixing"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len(words(r.text))
    for r in after:
        taken[r.source] += len(words(r.text))
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 100 * len(sizes) and all(taken[s] <= 3 * sizes[s] for s in sizes)
    before, after = seen["packing"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after if r.piece == 0)
    places = {}
    for r in after:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and [o for o, _ in sorted(p)] == np.cumsum([0, *[n for _, n in sorted(p)][:-1]]).tolist() for p in places.values())


def test_run_equals_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    again = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert rows and Counter(map(key, rows)) == Counter(map(key, again))
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in rows) and zlib.crc32(b"") == 0


def _write(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long, __copy string, label int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _write(spark, tmp_path, [], [])).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text and columns with clashing names."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    rows = [(1, "one two three four five six", "en", "a", 6, 1, "x", 0)] * 2 + [(None, None, None, None, None, None, None, None), (None, "alone without an id", "en", None, 1, 2, "y", 1), (2, "", "en", "a", 0, 3, "z", 0), (3, long, "en", "b", 9, 4, "w", 1), (3, long, "en", "b", 9, 4, "w", 1)]
    folder = _write(spark, tmp_path, rows, [(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, 0)])
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= {None, 1, 2, 3} and all(0 < r.length <= 2048 for r in got)
    starts = sorted((r.start, r.length) for r in got if r.doc_id == 3 and r.piece >= 0)
    assert starts and max(s + n for s, n in starts) > 60_000
