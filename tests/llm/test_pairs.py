"""N-gram join, substring dedup and MinHash against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import ADVERSE, make_texts, words

from rollcall.llm import kernel, minhash, ngram_join, substring


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _shingles(text, n):
    w = words(_lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def _components(rows, n, num, den):
    sets = [(r[0], _shingles(r[1], n)) for r in rows]
    label = {i: i for i, _ in sets}
    links = set()
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and den * len(a & b) >= num * len(a | b):
                links.add((i, j))
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                moved = True
    return Counter((i, len(s), label[i]) for i, s in sets), links


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_ngram_components(docs, rows, n, num, den):
    got = ngram_join.NgramJoin(docs, n=n, num=num, den=den).components().collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, n, num, den)[0]


def test_ngram_links_are_complete(docs, rows):
    got = {(r.a, r.b) for r in ngram_join.NgramJoin(docs).links().collect()}
    sets = {r[0]: _shingles(r[1], 4) for r in rows if r[0] is not None}
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    want = {(i, j) for i, j in _components(rows, 4, 85, 100)[1] if sets[i] != sets[j] and least[frozenset(sets[i])] == i and least[frozenset(sets[j])] == j}
    assert got == want


def test_one_of_each(docs, rows):
    kept = ngram_join.one_of_each(docs).collect()
    assert kept[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    want = _components(rows, 5, 80, 100)[0]
    heads = {i for (i, n, c) in want if n and i is not None and i == c}
    wordless = [i for (i, n, c), k in want.items() if (not n or i is None) for _ in range(k)]
    assert Counter(r.doc_id for r in kept) == Counter([*heads, *wordless])


def _sets_at_the_threshold(rng, count):
    for _ in range(count):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.12], rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64)]))
        if len(b):
            yield a, b, len(np.intersect1d(a, b))


def test_prefix_keeps_every_link():
    """Two sets at the threshold share a prefix token in the rare-first order."""
    rng = np.random.default_rng(1)
    levels = ngram_join.quantised(rng.integers(1, 5000, ngram_join.LEAST_COUNTERS))
    for a, b, both in _sets_at_the_threshold(rng, 200):
        if 100 * both >= 85 * (len(a) + len(b) - both):
            p, q = (ngram_join.rare_prefix(s, levels, ngram_join.prefix_length(len(s), 85, 100)) for s in (a, b))
            assert np.intersect1d(p, q).size


def test_hash_orders_keep_every_link_and_reject_others(spark, monkeypatch):
    """No link fails the bounds, also where keys are equal; most pairs that share a tenth of their tokens do."""
    rng = np.random.default_rng(4)
    rows = []
    for bits in (32, 6):
        cut = lambda x: ((x.view(np.uint32) ^ np.uint32(1 << 31)) >> np.uint32(32 - bits)).astype(np.int32)  # noqa: B023, E731
        for a, b, both in _sets_at_the_threshold(rng, 300):
            arrays = [[cut(ngram_join.hash_prefix(s, o, ngram_join.prefix_length(len(s), 85, 100))).tolist() for s in (a, b)] for o in (0, 1)]
            rows.append((len(a), len(b), *arrays[0], *arrays[1], 100 * both >= 85 * (len(a) + len(b) - both), False))
    for _ in range(300):
        body = rng.integers(0, 1 << 62, 20).astype(np.uint64)
        a, b = (np.unique(np.concatenate([body, rng.integers(0, 1 << 62, 180).astype(np.uint64)])) for _ in "ab")
        arrays = [[ngram_join.hash_prefix(s, o, ngram_join.prefix_length(len(s), 85, 100)).tolist() for s in (a, b)] for o in (0, 1)]
        rows.append((len(a), len(b), *arrays[0], *arrays[1], False, True))
    frame = spark.createDataFrame(rows, "n_a int, n_b int, order1_a array<int>, order1_b array<int>, order2_a array<int>, order2_b array<int>, link boolean, apart boolean")
    got = frame.select("link", "apart", *[ngram_join._passes(f"order{k}", 85, 100).alias(f"p{k}") for k in (1, 2)]).collect()
    assert sum(r.link for r in got) > 50 and all(r.p1 and r.p2 for r in got if r.link)
    assert sum(r.p1 or r.p2 for r in got if r.apart) <= 6


def test_words_that_collide_under_power_sums(spark):
    rows = list(enumerate(ADVERSE))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.NgramJoin(docs).components().collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, 4, 85, 100)[0]
    got = substring.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _cut(rows, 50)


def test_hashes_of_words_and_windows_do_not_collide():
    rng = np.random.default_rng(3)
    spans = [t.encode() for t in ADVERSE] + [rng.integers(97, 99, int(rng.integers(1, 40))).astype(np.uint8).tobytes() for _ in range(4000)]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    hashes = kernel.span_hashes(data, ends - [len(s) for s in spans], ends)
    assert len(set(hashes.tolist())) == len(set(spans))
    symbols = np.array([int(c) for c in "".join("01"[bin(i).count("1") % 2] for i in range(4096))], np.uint64) * np.uint64(1 << 40) + np.uint64(5)
    for text in (symbols, symbols[::-1].copy()):
        windows = {text[i : i + 50].tobytes() for i in range(len(text) - 49)}
        assert len(set(substring.window_hashes(text, 50).tolist())) == len(windows)


def test_one_id_with_several_texts(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, base), (2, "head " + base), (2, base + " tail"), (2, "x y z"), (3, "head " + base)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _cut(rows, 50)


def _cut(rows, n):
    seen = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                seen[key] = min(seen.get(key, i), i)
    out = Counter()
    for i, text, *_ in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and seen[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window", [50, 20])
def test_substring_dedup(docs, rows, window):
    got = substring.remove_repeats(docs, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _cut(rows, window)


def test_substring_dedup_of_repeated_words_in_blocks_of_their_own(spark):
    """A text that shrinks to one symbol shares its windows with longer ones and with mixed blocks."""
    rows = [(1, "x " * 60), (2, "x " * 130), (3, "x " * 90 + " ".join(f"w{i}" for i in range(40))), (4, "y z " * 64), (5, "y z " * 90)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = substring.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _cut(rows, 50)


def test_window_names_of_one_symbol():
    """Windows of one repeated word have one name, however long the text is and whatever shares its block."""
    word = np.uint64(0x9E3779B97F4A7C15)
    found = set()
    for n, more in ((60, 0), (61, 0), (130, 0), (130, 30)):
        text = np.concatenate([np.full(n, word), np.arange(1, more + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)])
        owner = np.repeat([0, 1], [n, more])
        found |= set(substring.window_names(text, owner, 50, substring.window_hashes(text, 50))[: n - 49].tolist())
    assert len(found) == 1


def test_window_names_follow_from_the_window_alone():
    """A window has one name wherever it stands, also among runs and periods."""
    rng = np.random.default_rng(2)
    for alphabet in (2, 3, 50):
        seen = {}
        body = rng.integers(1, alphabet + 1, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(20):
            edges = [rng.integers(1, alphabet + 1, int(rng.integers(0, 40))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2)]
            text = np.concatenate([edges[0], body, edges[1]])
            names = substring.window_names(text, np.zeros(len(text), np.int64), 50, substring.window_hashes(text, 50))
            for at, name in enumerate(names):
                assert seen.setdefault(text[at : at + 50].tobytes(), name) == name


def test_spans(spark):
    """Against counting, for any number of bounds."""
    from pyspark.sql import functions as F

    for bounds in ([], [5], [1, 4, 4 + 9, 20, 21], list(range(0, 300, 3))):
        got = spark.range(-2, 320).select("id", minhash._span(F.col("id"), bounds).alias("s")).collect()
        assert all(r.s == sum(b < r.id for b in bounds) for r in got)


def test_fingerprints_carry_components(docs):
    got = {r.doc_id: r.component_id for r in minhash.fingerprint_and_link(docs).collect()}
    want = {}
    for r in minhash.near_duplicates(docs).collect():
        if r.doc_id is not None:
            want[r.doc_id] = min(want.get(r.doc_id, r.component_id), r.component_id)
    assert got.pop(None) is None and got == want and len(set(want.values())) < len(want)


def test_fingerprints(spark, docs, rows):
    got = sorted(minhash.fingerprint_documents(docs, ranges=4).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    assert [r.doc_id for r in got] == [r[0] for r in order]
    prints = {}
    for i, (row, text) in enumerate(zip(got, texts)):
        following = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        for other, value in ((edited, row.near_edited), (following, row.near_next)):
            a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in (words(text), words(other)))
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.2)


def test_sketches_keep_similar_pairs(spark):
    """Minima that agree in four places of five pass, those that agree in half (seven of ten for the longer ones) do not."""
    from pyspark.sql import functions as F

    coarse, fine = (minhash.PERMUTATIONS, minhash.SKETCH_BITS, minhash.MOST_DIFFERENT), (minhash.FINE_MINIMA, 1, minhash.FINE_DIFFERENT)
    for (minima, bits, most), low, passing in ((coarse, 0.5, 12), (fine, 0.68, 40)):
        rng = np.random.default_rng(6)
        base = rng.integers(0, 1 << 32, (400, minima)).astype(np.uint32)
        other = rng.integers(0, 1 << 32, base.shape).astype(np.uint32)
        rows = []
        for share in (0.8, low):
            mixed = np.where(rng.random(base.shape) < share, base, other)
            rows += [(share, x.tolist(), y.tolist()) for x, y in zip(minhash._planes(base, bits), minhash._planes(mixed, bits))]
        frame = spark.createDataFrame(rows, "share double, a array<long>, b array<long>")
        got = {r.share: r.n for r in frame.where(minhash._alike(F.col("a"), F.col("b"), minima, bits, most)).groupBy("share").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got[0.8] == 400 and got.get(low, 0) < passing


def test_edited_copies_apart_from_their_original(spark):
    """Of a group of copies edited so much that many are below the threshold to the original, every link is found and no other."""
    rng = np.random.default_rng(12)
    original = [f"w{i}" for i in range(150)]
    texts = [" ".join(original)]
    for i in range(150):
        own = list(original)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            own[at] = f"x{i}.{at}"
        texts.append(" ".join(own))
        if i % 10 == 0:  # a copy of the copy
            own[int(rng.integers(150))] = f"y{i}"
            texts.append(" ".join(own))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(100, "another text of the first id"), (103, texts[-1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of[r.doc_id] = min(of.get(r.doc_id, r.component_id), r.component_id)
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, t in rows for w in [t.split()]]
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, (i, one) in enumerate(sets):
        for j, other in sets[:k]:
            if 100 * len(one & other) >= 80 * len(one | other):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert of == {i: find(i) for i, _ in rows} and len(set(of.values())) > 10


def test_near_duplicates_find_near_copies(docs, rows):
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None}
    want, links = _components(rows, 5, 80, 100)
    exact = {i: c for i, _, c in want if i is not None}
    assert all(got[i] >= exact[i] for i in got)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    assert all(got[i] == got[j] for i, j in links if texts[i] == texts[j])
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)


def test_empty_tables(empty):
    assert ngram_join.NgramJoin(empty).components().count() == 0
    assert ngram_join.one_of_each(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert minhash.fingerprint_documents(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.fingerprint_and_link(empty).count() == 0


def test_kernel_words():
    import pyarrow as pa

    texts = make_texts(9)
    for block in kernel.blocks(pa.array(texts), 500):
        found = kernel.words(block)
        for i in range(len(block)):
            own = [bytes(block.data[s:e]).decode() for s, e in zip(found.start[found.first[i] : found.first[i + 1]], found.end[found.first[i] : found.first[i + 1]])]
            assert own == words(texts[block.row0 + i])
