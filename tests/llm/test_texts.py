"""Token output, packing, quality, mixing, toxicity, secrets and archives."""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import io
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import ADVERSE, make_texts, words
from pyspark.sql import functions as F

from rollcall.llm import kernel, mixing, packing, quality, repair, secrets, tokens, toxicity, warc
from rollcall.llm.queries import vocabulary


@functools.cache
def _tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def _ids(name, text, end):
    return [*_tokenizer(name).encode(text or "", add_special_tokens=False).ids, end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["a \n\nb c", "  x  y \n\n z ", "tail  ", " ", "it's don't  'll é ñ", "a \n\nb", "a   b", "日本 語　x", "İstanbul Σας ΣΑΣ", "<|endoftext|> a", "alpha <|endoftext|> beta", "a<|endoftext|>b  <|startoftext|>\n", "x" * 60, "é ́x"]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("slots", [tokens.SLOTS, 1 << 10])
def test_encoder_equals_the_library(monkeypatch, name, keeps, slots):
    """Also where words collide under power sums, and where a text has more distinct words than the table has room for."""
    monkeypatch.setattr(tokens, "SLOTS", slots)
    monkeypatch.setattr(tokens, "MOST_KNOWN", slots * 6 // 10)
    rng = np.random.default_rng(2)
    texts = make_texts(3) + ODD + ADVERSE + [" ".join(np.array([*"abcdefgh"])[rng.integers(0, 8, 9)].tobytes().decode("utf-32-le") for _ in range(3000))]
    encoder = tokens.Encoder(vocabulary(name), keeps)
    for block in kernel.blocks(pa.array(texts), 3000):
        ids, places = encoder.encode(block)
        for i in range(len(block)):
            assert [*ids[places[i] : places[i + 1]].tolist(), 1] == _ids(name, texts[block.row0 + i], 1)


def test_encoder_compares_bytes(monkeypatch):
    """Words whose hashes are equal have their own ids all the same."""
    monkeypatch.setattr(kernel, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    encoder = tokens.Encoder(vocabulary("byte_bpe_50k.json"), True)
    text = " ".join(f"word{i} other{i}longer" for i in range(40))
    ids, _ = next(encoder.encode(block) for block in kernel.blocks(pa.array([text])))
    assert [*ids.tolist(), 2] == _ids("byte_bpe_50k.json", text, 2)


def test_token_output(docs, rows):
    got = sorted(repair.read_shards(repair.write_shards(docs, vocabulary("byte_bpe_50k.json"))).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, text, *_) in zip(got, order, strict=True):
        ids = _ids("byte_bpe_50k.json", text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), _crc(ids))
        start += len(ids)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 50257, int(rng.integers(2, 12))) for _ in range(30)]
    parts = [np.concatenate([phrases[k] for k in rng.integers(0, 30, int(rng.integers(0, 60)))] + [np.array([2])]) for _ in range(80)] + [np.full(500, 7), np.array([2])]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    ids = np.concatenate(parts).astype(np.uint16)
    raw = repair.write_shard([None, *range(1, len(parts))], ids, first)
    shard = repair.Shard(raw)
    assert len(shard.rules) and len(shard.symbols) < 0.7 * len(ids)
    assert [len(shard.expand(np.array([repair.FIRST_RULE + k], np.uint32))) for k in range(len(shard.rules))] == shard.lengths.tolist()
    assert shard.doc_ids[0] is None
    for i, part in enumerate(parts):
        assert np.array_equal(shard.document(i), part)
    for lo, hi in rng.integers(0, len(ids), (200, 2)):
        lo, hi = min(lo, hi), max(lo, hi)
        if lo < hi:
            assert np.array_equal(shard.tokens(int(lo), int(hi)), ids[lo:hi])


@pytest.mark.parametrize("planes", [repair.PLANES, 0])
def test_grammar_leaves_no_frequent_pair(monkeypatch, planes):
    """Few copies and long repeats shrink as well."""
    monkeypatch.setattr(repair, "PLANES", planes)
    rng = np.random.default_rng(6)
    long, few = rng.integers(0, 50257, 600), rng.integers(0, 50257, 300)
    parts = [*[np.append(long, 2)] * 40, *[np.append(few, 2)] * 8, *[np.append(rng.integers(0, 50257, 50), 2) for _ in range(20)]]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    ids = np.concatenate(parts).astype(np.uint16)
    symbols, starts, _ = repair.compress(ids, first)
    left = Counter(pair for lo, hi in zip(starts[:-1], starts[1:]) for pair in zip(symbols[lo:hi].tolist(), symbols[lo + 1 : hi].tolist()))
    assert max(left.values()) < 6
    assert np.diff(starts)[:48].max() <= 4
    shard = repair.Shard(repair.write_shard(list(range(len(parts))), ids, first))
    assert all(np.array_equal(shard.document(i), part) for i, part in enumerate(parts))


def test_packing(docs, rows):
    got = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=64).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = _ids("word_bpe_49k.json", text, 0)
        for k in range(0, len(ids), 64):
            want[(doc_id, k // 64, k, len(ids[k : k + 64]), _crc(ids[k : k + 64]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.05 * total / 64 + 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(3, 60))
    counts = np.concatenate([[0], rng.integers(0, 40, capacity)])
    groups = packing.plan_groups(counts, capacity)
    placed = Counter()
    for pattern, n in groups:
        assert n > 0 and sum(length * each for length, each in pattern) <= capacity
        assert sum(each for length, each in pattern if length > capacity // 3) <= 2 or capacity // 3 * 3 < capacity
        for length, each in pattern:
            placed[length] += each * n
    assert placed == Counter({i: int(c) for i, c in enumerate(counts) if c})


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], int(len(words(r[1])) < 150)) for r in rows if r[0] is not None], "doc_id long, quality int")
    got = quality.QualityModel(docs, labels).score(docs).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        w, seen, duplicates = words(text), set(), 0
        for part in (text or "").split("\n"):
            if words(part):
                duplicates += part in seen
                seen.add(part)
        runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(doc_id, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), duplicates, len(covered), failed)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_learns(spark):
    good, bad = ("the and of to in that is was for with " * 8).split(), ["x%%%", "$$$y", "***z"]
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(rng.permutation(good) if i % 2 else rng.permutation(good[:40] + bad * 20)), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts[:200]], "doc_id long, quality int")
    got = {r.doc_id: r.probability for r in quality.QualityModel(docs, labels).score(docs).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, _, q in texts[200:]]) > 0.95


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)
            left -= target[s]
    taken, largest = Counter(), Counter()
    source_of = {}
    for doc_id, text, _, source, *_ in rows:
        source_of[(doc_id, len(words(text)))] = source
        largest[source] = max(largest[source], len(words(text)))
    for r in got:
        source = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source]) and r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    plain = ["w%d" % k for k in range(300)]
    texts = []
    for i in range(800):
        own = list(rng.choice(plain, 60))
        if i % 4 == 0:
            for k in rng.integers(0, 60, 6):
                own[k] = "grob" + str(rng.integers(0, 50))
        texts.append((i, " ".join(own), int(i % 4 == 0)))
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in texts], (None, None), (-1, ""), (-2, "grob1 " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.ToxicityModel(docs, labels)
    got = {r.doc_id: r for r in model.score(docs).collect()}
    held = [(i, y) for i, _, y in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert got[None].predicted == 0 and got[-1].score == got[None].score and got[-2].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())
    assert sorted(r.doc_id for r in model.clean(docs).where("doc_id >= 0").collect()) == sorted(i for i, r in got.items() if i is not None and i >= 0 and not r.predicted)


def test_toxicity_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.ToxicityModel(docs, labels).score(docs).where("predicted = 1").count() == 0
    assert toxicity.ToxicityModel(empty, labels).score(empty).count() == 0
    assert quality.QualityModel(docs, labels, "toxic").score(docs).count() == docs.count()


def test_toxicity_curve_where_classes_are_almost_apart():
    """Evidence that whole Newton steps overshoot on: all rows, or none, came out as toxic."""
    clean = [(65, 0.0, 0.0, 0.0), (35, 0.0, 0.7, 0.0), (28, 0.0, 1.5, 0.1), (24, 2.0, 2.0, 0.5), (1, 5.0, 5.0, 13.5)]
    toxic = [(2, 4.5, 4.5, 7.5), (4, 4.8, 4.8, 10.0), (1, 5.2, 5.2, 15.1), (1, 6.8, 6.8, 78.8)]
    for times, most in ((2, 78.8), (3, 78.8), (3, 100.0), (3, 150.0)):
        x = [[1.0, *r] for n, *r in clean for _ in range(n * times)] + [[1.0, *r[:-1], most if r[-1] == 78.8 else r[-1]] for n, *r in toxic for _ in range(n)]
        x, y = np.array(x), np.repeat([0.0, 1.0], [153 * times, 8])
        w = toxicity._logistic(x, y)
        slope = x.T @ (y - 1 / (1 + np.exp(-(x @ w)))) - 1e-2 * w
        assert np.abs(slope).max() < 1e-5
        predicted = 1 / (1 + np.exp(-(x @ w))) >= toxicity.THRESHOLD
        assert predicted[y == 1].all() and predicted[y == 0].sum() == times  # the rows of strong evidence


def test_maximal_segments():
    """Against the recursive definition: the best run, then the same left and right of it."""

    def slow(s, lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                v = s[a:b].sum()
                if v > 1e-12 and (best is None or v > best[2] + 1e-9):
                    best = (a, b, v)
        return [] if best is None else slow(s, lo, best[0]) + [best] + slow(s, best[1], hi)

    rng = np.random.default_rng(8)
    for _ in range(60):
        s = rng.normal(-0.1, 1, int(rng.integers(1, 24)))
        fast = toxicity.maximal_segments(s)
        assert [x[:2] for x in fast] == [x[:2] for x in slow(s, 0, len(s))]
        assert [x[2] for x in fast] == pytest.approx([x[2] for x in slow(s, 0, len(s))])


DER = base64.b64encode(bytes([0x30, 0x2A, 0x02, 0x01, 0x05, 0x30, 0x25, 0x04, 0x23]) + bytes(range(35))).decode()
_part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
JWT = f"{_part({'alg': 'HS256', 'typ': 'JWT'})}.{_part({'sub': 'x1'})}.c2lnbmF0dXJl"


def test_secrets(spark):
    texts = [
        None, "", "password = hunter2hunter2", "Api_Key:'abcdefgh' and TOKEN=short1", "é AKIAABCDEFGHIJKL x AKIASHORT", "d" * 32 + "G " + "0" * 31, f"see {JWT} end", f"x {DER} y", f"-----BEGIN EC KEY-----\n{DER}\n-----END EC KEY-----",
        "M" + "A" * 60, "eyJhbGciOi.notjson.x", 'secret="' + "a" * 40 + '"',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(rows).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, text in enumerate(texts):
        spans = []
        for kind, found in (("assign", assign), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))):
            for m in found.finditer(text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    spans.append((m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
        joined = ",".join(s for *_, s in sorted(spans))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {s for *_, s in spans} <= set(r.spans.split(","))
    assert got[6].spans == f"jwt:4:{4 + len(JWT)}" and got[7].spans == f"der:2:{2 + len(DER)}" and "pem:0:" in got[8].spans
    assert got[9].spans == got[10].spans == ""
    assert secrets.redact(texts[2]) == "[assign]" and secrets.redact("clean") == "clean" and JWT not in secrets.redact(texts[6])
    redacted = secrets.redacted_rows(rows.withColumn("n_chars", F.length("text").cast("long"))).collect()
    assert all((r.n_chars is None and r.text is None) or r.n_chars == len(r.text) for r in redacted)


def test_secrets_over_odd_tables(docs, empty):
    assert secrets.scan_secrets(docs).count() == docs.count() and secrets.scan_secrets(empty).count() == 0


def test_warc_round_trip(spark):
    pages = [(1, "http://a/x y", "one"), (2, "http://b", "two ü"), (3, None, "one"), (4, "a%20b%", None), (5, "u", ""), (6, "u", "z" * 300_000), (7, "u", "one"), (None, "u", "lost"), (2, "http://b", "two ü"), (2, "u", "other"), (9, "u", "other")]
    frame = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, first string")
    archives = warc.write_archives(frame)
    got = warc.read_archives(archives).collect()
    want = Counter()
    for page_id, _, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        revisit = page_id is not None and page_id != first
        want[(page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert [r.target_uri for r in sorted(got, key=lambda r: r.page_id or 0) if r.page_id in (1, 4)] == ["http://a/x%20y", "a%20b%25"]
    raw = b"".join(r.warc for r in archives.collect())
    text = gzip.GzipFile(fileobj=io.BytesIO(raw)).read()
    assert text.count(b"WARC/1.1\r\n") == len(pages)
    assert warc.read_archives(warc.write_archives(frame.limit(0))).count() == 0


def test_warc_revisits_are_held_against_their_responses(spark):
    first, other = warc.page_record(1, "u", b"one", None, "response"), warc.page_record(2, "u", b"two", None, "response")
    read = lambda *parts: warc.read_archives(spark.createDataFrame([("a", bytearray(b"".join(parts)))], "archive string, warc binary")).collect()
    assert {(r.page_id, r.refers_to) for r in read(first, other, warc.page_record(3, "u", b"one", 1, "revisit"))} == {(1, None), (2, None), (3, 1)}
    for bad in (warc.page_record(3, "u", b"one", 2, "revisit"), warc.page_record(3, "u", b"one", 9, "revisit")):
        with pytest.raises(Exception, match="does not match"):
            read(first, other, bad)


def test_warc_reader_detects_damage():
    good = warc.page_record(1, "u", b"payload", None, "response")
    assert [b for _, b in warc.read_records(good * 3)] == [b"payload"] * 3
    changed = gzip.compress(gzip.decompress(good).replace(b"payload\r\n", b"Payload\r\n"))
    for bad in (good[:-9], changed, gzip.compress(gzip.decompress(good)[:-1]), gzip.compress(b"junk")):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_records(bad))


def test_empty_tables(empty):
    path = vocabulary("word_bpe_49k.json")
    assert packing.pack_documents(empty, path).count() == 0
    assert repair.read_shards(repair.write_shards(empty, vocabulary("byte_bpe_50k.json"))).count() == 0
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


#: Texts of unlike words that the fixed hashes of words, windows or lines can't tell apart.
COLLIDING = ["password elephant one two", "emjnimmo !-])sh3o one two", "password elephant one emjnimmo !-])sh3o one", "checkboxelephant\nmmwsmatmQb=}t1~", "checkboxelephant\nmmwsmatmQb=}t1~\ncheckboxelephant x"]


def inverse_mix(x):
    """The number that ``kernel.mix`` turns into ``x``."""
    mask = (1 << 64) - 1
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        y = x
        for _ in range(64 // shift + 1):
            y = x ^ (y >> shift)
        x = y * pow(factor, -1, 1 << 64) & mask
    return x


def constructed_collisions(n):
    """Pairs of different two-word sequences of bytes whose sum of fixed hashes is equal: any other first word, then the second by inversion."""
    rng, mask = np.random.default_rng(12), (1 << 64) - 1
    step, gram = int(kernel._STEP), int(kernel._GRAM)
    hashed = lambda w: int(kernel.mix(np.array([(int.from_bytes(w, "little") + len(w) * step) & mask], np.uint64))[0])
    while n:
        a, b, c = (bytes(rng.integers(0x21, 0x7F, 8).astype(np.uint8)) for _ in range(3))
        sought = ((hashed(a) - hashed(c)) * gram + hashed(b)) & mask
        d = ((inverse_mix(sought) - 8 * step) & mask).to_bytes(8, "little")
        if not set(d) & {0x20, *range(0x09, 0x0E), 0}:
            yield a + b" " + b, c + b" " + d
            n -= 1


def test_constructed_collisions_do_not_collide_under_a_key():
    key, seen = kernel.fresh_key(2), 0
    for one, other in constructed_collisions(40):
        pair = pa.array([one, other], pa.binary())
        fixed = [x.tolist() for block in kernel.blocks(pair) for x in kernel.shingle_sets(block, 2, False)]
        keyed = [x.tolist() for block in kernel.blocks(pair) for x in kernel.shingle_sets(block, 2, False, key)]
        seen += fixed[0] == fixed[1]
        assert keyed[0] != keyed[1]
    assert seen == 40  # so the construction does what it should


def test_colliding_texts_have_exact_counts(spark):
    from rollcall.llm import ngram_join

    docs = spark.createDataFrame(list(enumerate(COLLIDING)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.QualityModel(docs, spark.createDataFrame([], "doc_id long, quality int")).score(docs).collect()}
    assert [got[i].n_repeat_words for i in range(5)] == [0] * 5
    assert [got[i].n_dup_lines for i in range(5)] == [0] * 5
    found = {r.doc_id: r.component_id for r in ngram_join.NgramJoin(docs).components().collect()}
    assert found[0] == 0 and found[1] == 1


def test_exact_ids_and_keyed_hashes_follow_the_bytes():
    rng = np.random.default_rng(1)
    spans = [bytes(rng.integers(97, 99, int(rng.integers(1, 12))).astype(np.uint8)) for _ in range(800)] + [b"x" * n for n in (255, 256, 257, 257, 300)] * 2 + [b"x" * 300 + b"y"]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    codes = {s: i for i, s in enumerate(sorted(set(spans)))}
    want = np.array([codes[s] for s in spans])
    for hashes in (kernel.span_hashes(data, starts, ends), np.zeros(len(spans), np.uint64), kernel.keyed_hashes(data, starts, ends, kernel.fresh_key(1))):
        ids = kernel.exact_ids(data, starts, ends, hashes)
        assert len(set(zip(ids.tolist(), want.tolist()))) == len(codes) == len(set(ids.tolist()))
    keyed = kernel.keyed_hashes(data, starts, ends, kernel.fresh_key(1))
    assert len(set(zip(keyed.tolist(), want.tolist()))) == len(codes) == len(set(keyed.tolist()))


def test_long_texts_of_every_kernel(spark):
    """Texts longer than a kernel block, next to short ones."""
    rng = random.Random(6)
    vocabulary_ = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(vocabulary_) for _ in range(120_000))
    texts = ["short one", long, long[:300_000], "x\n" * 400, "AKIA" + "A" * 20 + " " + long[:200_000] + " token=abcdefgh12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards = repair.write_shards(docs, vocabulary("byte_bpe_50k.json"))
    want = [_ids("byte_bpe_50k.json", t, 2) for t in texts]
    got = {r.doc_id: r for r in repair.read_shards(shards).collect()}
    assert [got[i].ids_crc32 for i in range(5)] == [_crc(x) for x in want]
    scored = {r.doc_id: r for r in quality.QualityModel(docs, spark.createDataFrame([], "doc_id long, quality int")).score(docs).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (scored[i].n_words, scored[i].n_repeat_words, scored[i].n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    assert spans[4].startswith("access:0:24,") and spans[4].endswith(f"assign:{len(texts[4]) - 16}:{len(texts[4])}")


def _pem(label, raw, headers=""):
    body = base64.b64encode(raw).decode()
    lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    return f"-----BEGIN {label}-----\n{headers}{lines}\n-----END {label}-----"


def test_public_blocks_are_no_secrets_and_private_ones_are_reported_once():
    der = bytes([0x30, 0x82, 0x01, 0x08, 0x02, 0x82, 0x01, 0x00]) + bytes(range(1, 129)) * 2 + bytes([0x02, 0x02, 0x01, 0x05])
    assert secrets.is_der(der)
    for label in ("PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE", "CERTIFICATE REQUEST", "X509 CRL", "EC PARAMETERS"):
        block = f"see {_pem(label, der)} end"
        assert secrets.confirmed_spans(block) == [] and secrets.redact(block) == block
        cut = block[: block.index("-----END")]  # no end, as where a text was cut
        assert secrets.confirmed_spans(cut) == []
    private = _pem("RSA PRIVATE KEY", der)
    assert secrets.confirmed_spans(f"ab {private}") == [(3, 3 + len(private), "pem")]
    assert secrets.redact(f"ab {private} c") == "ab [pem] c"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    legacy = _pem("RSA PRIVATE KEY", bytes((i * 37 + 11) % 256 for i in range(256)), headers)
    assert secrets.confirmed_spans(legacy) == [(0, len(legacy), "pem")]
    assert secrets.confirmed_spans(_pem("RSA PRIVATE KEY", b"not a key at all")) == []
    both = f"{_pem('PUBLIC KEY', der)}\n{base64.b64encode(der).decode()}"
    assert [kind for *_, kind in secrets.confirmed_spans(both)] == ["der"]
