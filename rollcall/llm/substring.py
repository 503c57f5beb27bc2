"""Removal of long repeated passages, found by recompression.

Recompression names runs of equal symbols and pairs of neighbours, round after round.
Names are 64-bit hashes of what they stand for, so they are global: every executor gives
equal runs and pairs equal names without exchanging a dictionary.  Which pairs merge
depends on the names alone (one half of the names may only begin a pair, the other half
only end one), so two occurrences of a passage are parsed alike except near their ends.
How far the context reaches in is known exactly for every window, and the symbols beyond
its reach are those that every occurrence of the window shares.

1. Every document names its windows by their longest such interior symbol, or by their
   whole content where none is left, and emits the distinct names.
2. Names that two documents share reveal candidate passages; windows under a shared name
   are verified by a 128-bit cryptographic digest of their words' bytes.
3. Words covered by a window that also starts in a document with a smaller id go.

Documents equal as a whole are settled before that by the SHA-256 digest of their words:
only the one with the smallest id takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm import kernel
from rollcall.stage import drop_stage, staged

WINDOW = 50
ROUNDS = 6
#: Rounds before whose pairs runs are named too.
RUN_ROUNDS = (0, 3)
_SEED = np.uint64(0xA0761D6478BD642F)
_STEP = 0xE7037ED1A0B428DB
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, from those of runs of 1, 2, 4, ... words; every step is mixed."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    runs, span, done, out = hashes, 1, 0, None
    while True:
        if n & span:
            own = runs[done : done + size]
            out = own if out is None else kernel.mix(out * np.uint64(_STEP) + own)
            done += span
        if 2 * span > n:
            return kernel.mix(out + np.uint64(n))
        runs = kernel.mix(runs[:-span] * np.uint64(_STEP) + runs[span:])
        span *= 2


def window_names(hashes: np.ndarray, owner: np.ndarray, n: int, wholes: np.ndarray) -> np.ndarray:
    """Name of the n-word window that starts at each word, from the window's content alone.

    ``owner`` tells texts apart; entries for windows that span two texts mean nothing.
    """
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    symbols, texts, start = hashes, owner, np.arange(len(hashes))
    # Of each window: the first symbol that what precedes it can't touch, and the end of those that what follows can't.
    low, high = np.arange(size), np.arange(n, len(hashes) + 1)
    spent = np.zeros(size, bool)  # windows without such a symbol, then or in a later round; the bounds below are kept in range for lookups only
    for round_ in range(ROUNDS):
        if round_ in RUN_ROUNDS:
            head = np.ones(len(symbols), bool)
            head[1:] = (symbols[1:] != symbols[:-1]) | (texts[1:] != texts[:-1])
            group = np.cumsum(head) - 1
            at = np.flatnonzero(head)
            many = np.diff(np.append(at, len(symbols)))
            low, high = group[low] + 1, group[high - 1]
            spent |= low >= high
            low, high = np.minimum(low, len(at) - 1), np.maximum(high, 1)
            named = kernel.mix(symbols[at] + many.astype(np.uint64) * np.uint64(_STEP))
            symbols, texts, start = np.where(many > 1, named, symbols[at]), texts[at], start[at]
        ends = (kernel.mix(symbols ^ (_SEED + np.uint64(round_))) >> np.uint64(63)).astype(bool)
        merged = np.zeros(len(symbols), bool)  # into the symbol before
        merged[1:] = ~ends[:-1] & ends[1:] & (texts[1:] == texts[:-1])
        group = np.cumsum(~merged) - 1
        at = np.flatnonzero(~merged)
        low_next = group[low] + ends[low]
        high_next = group[high - 1] + ends[high - 1]
        pair = np.zeros(len(symbols), bool)
        pair[:-1] = merged[1:]
        named = kernel.mix(symbols[at] * np.uint64(_STEP) + np.append(symbols, np.uint64(0))[at + 1] + np.uint64(2 * round_ + 1))
        symbols, texts, start = np.where(pair[at], named, symbols[at]), texts[at], start[at]
        spent |= low_next >= high_next
        low, high = np.minimum(low_next, len(symbols) - 1), np.maximum(high_next, 1)
    length = np.minimum(np.diff(np.append(start, len(hashes))), 255).astype(np.uint64)
    # A symbol's last word must lie in its text: the last one of a text ends there, whatever follows.
    keys = (np.maximum(length, np.uint64(1)) << np.uint64(56)) | (kernel.mix(symbols) >> np.uint64(8))
    tables = [keys]
    while 2 << (len(tables) - 1) <= n:
        half = 1 << (len(tables) - 1)
        last = tables[-1]
        up = last.copy()
        np.maximum(last[:-half], last[half:], out=up[:-half])
        tables.append(up)
    inner = np.where(spent, 0, high - low)
    out = wholes >> np.uint64(8)
    safe = np.flatnonzero(inner > 0)
    level = np.frexp(inner[safe].astype(np.float64))[1] - 1
    stacked = np.stack(tables)
    out[safe] = np.maximum(stacked[level, low[safe]], stacked[level, high[safe] - (1 << level)])
    return out


class Parsed:
    """Words, windows and window names of a block of texts."""

    def __init__(self, block: kernel.Block, n: int):
        self.words = kernel.words(block)
        hashes = kernel.span_hashes(block.data, self.words.start, self.words.end)
        self.wholes = window_hashes(hashes, n)
        self.names = window_names(hashes, self.words.owner(), n, self.wholes)
        self.n = n
        self.hashes = hashes

    def span(self, i: int) -> slice:
        """Places of the i-th text's windows."""
        lo, hi = int(self.words.first[i]), int(self.words.first[i + 1])
        return slice(lo, max(lo, hi - self.n + 1))


def _names(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                parsed = Parsed(block, n)
                digests, names, ends = [], [], [0]
                for i in range(len(block)):
                    digests.append(hashlib.sha256(b" ".join(_split(block.text(i)))).digest())
                    names.append(np.unique(parsed.names[parsed.span(i)]))
                    ends.append(ends[-1] + len(names[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.row0, len(block)), pa.array(parsed.words.counts, pa.int64()), pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(names).view(np.int64))),
                    ],
                    ["doc_id", "n_words", "digest", "names"],
                )

    return run


def _split(text: bytes) -> list[bytes]:
    return text.split()  # on the six ASCII white-space characters, 0x20 and 0x09-0x0D


def _tag(digest: bytes) -> int:
    """Tells texts of one id apart, above the bits of a place."""
    return int.from_bytes(digest[:4], "big") >> 1 << 32


def window_digests(joined: bytes, ends: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A row of two 64-bit halves for each n-word window that starts at one of ``at``: the digest of its words joined by spaces.

    ``ends`` has 0 and then the end of each word and the space after it in the joined text.
    """
    view = memoryview(joined)
    raw = [hashlib.blake2b(view[lo:hi], digest_size=16).digest() for lo, hi in zip(ends[at].tolist(), (ends[at + n] - 1).tolist())]
    return np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)


#: Windows in a batch of digests.
_MOST_WINDOWS = 1 << 15


def _windows(n: int):
    """Digests of the windows under shared names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                parsed = Parsed(block, n)
                for i in range(len(block)):
                    shared = batch.column(2)[block.row0 + i].values.to_numpy().view(np.uint64)
                    found = np.flatnonzero(np.isin(parsed.names[parsed.span(i)], shared))
                    if not found.size:
                        continue
                    doc_id, words = batch.column(0)[block.row0 + i].as_py(), _split(block.text(i))
                    joined, ends = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])
                    tag = _tag(hashlib.sha256(joined).digest())
                    for at in np.split(found, range(_MOST_WINDOWS, len(found), _MOST_WINDOWS)):
                        digests = window_digests(joined, ends, at, n)
                        columns = [np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1]), np.full(len(at), doc_id, np.int64), at + tag]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["high", "low", "doc_id", "at"])

    return run


def _cut(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, removed, kept = [], [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                words = _split((text.as_py() or "").encode())
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                edge = np.zeros(len(words) + 1, np.int64)
                at = places.values.to_numpy()
                at = at[at >> 32 == _tag(digests[-1]) >> 32] & 0xFFFFFFFF
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "digest", "n_cut", "cut_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: each text without its repeated passages, one row per input row.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a
    document with a smaller id; windows are judged on the input.  A null text has no words.
    Texts shorter than a window and rows without an id lose nothing and take nothing from
    others.  Rows that repeat an id and a text get equal results; rows with one id and several
    texts are judged each by itself, against smaller ids only.  Other columns are not read.  An
    empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parsed = staged(texts.mapInArrow(_names(window), "doc_id long, n_words long, digest binary, names array<long>"), "repeat-names")
    able = parsed.where(f"n_words >= {int(window)} AND doc_id IS NOT NULL")
    firsts = staged(able.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("names").alias("names")), "repeat-firsts")
    names = firsts.select(F.col("first").alias("doc_id"), F.explode("names").alias("name"))
    # Staged, so that both sides of the joins below are exchanges and a very common name or window is split between tasks.
    shared = staged(names.groupBy("name").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("name"), "repeat-common")
    of_doc = staged(names.join(shared, "name").groupBy("doc_id").agg(F.collect_list("name").alias("names")), "repeat-shared")  # bounded by the text
    candidates = staged(texts.join(of_doc, "doc_id"), "repeat-texts")
    windows = candidates.select("doc_id", "text", "names").mapInArrow(_windows(window), "high long, low long, doc_id long, at long")
    windows = staged(windows, "repeat-windows")
    least = windows.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("high", "low", "least")
    least = staged(least, "repeat-least")
    later = windows.join(least, ["high", "low"]).where("doc_id > least")
    places = staged(later.groupBy("doc_id").agg(F.collect_set("at").alias("places")), "repeat-places")  # bounded by the text
    drop_stage(windows, of_doc, shared, least)
    cut = candidates.select("doc_id", "text").join(places, "doc_id").select("doc_id", "text", "places")
    cut = cut.mapInArrow(_cut(window), "doc_id long, digest binary, n_cut long, cut_sha256 string")
    cut = staged(cut.groupBy(F.col("doc_id").alias("first"), "digest").agg(F.first("n_cut").alias("n_cut"), F.first("cut_sha256").alias("cut_sha256")), "repeat-cut")
    drop_stage(candidates, places)
    of_class = staged(firsts.select("digest", "first").join(cut, ["digest", "first"], "left"), "repeat-classes")
    drop_stage(firsts, cut)
    key = F.when((F.col("n_words") >= window) & F.col("doc_id").isNotNull(), F.col("digest"))
    rows = parsed.select("doc_id", "n_words", F.lower(F.hex("digest")).alias("sha256"), key.alias("digest")).join(of_class, "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )


#: The same result in DuckDB SQL, from all windows.
REPEATS_SQL = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
hashed AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda p: md5(array_to_string(ws[p:p + 49], ' ')))) AS h,
                  unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
firsts AS (SELECT h, min(doc_id) AS low FROM hashed GROUP BY h),
later AS (SELECT doc_id, p FROM hashed JOIN firsts USING (h) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, p + k AS at_word FROM later, range(0, 50) r(k)),
listed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at_word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY at_word) AS words FROM listed ANTI JOIN gone USING (doc_id, at_word) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""
