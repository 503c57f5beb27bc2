"""Token-id shards compressed by a Re-Pair grammar, with random access.

A shard holds whole documents.  Round by round its most frequent id pairs become
nonterminals, until no pair saves more than its rule costs.  No pair spans two documents, so a document is a
run of symbols.  The shard stores the rules, the length that each expands to, the symbols
and, for each document, its id, first symbol and first token; so any document, or any
range of tokens, is decoded by itself.

Layout (little endian): magic ``RPG1``; counts of documents, rules, symbols and tokens (u64
each); document ids (i64) and whether they are null (u8); first symbol and first token of each
document (u64); rules as pairs (u32); expansion lengths (u32); low 16 bits of the symbols
(u16); the symbols' bits above them, plane by plane, as many planes as the number of rules asks for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.llm import kernel, tokens
from rollcall.stage import staged, task_count

MAGIC = b"RPG1"
END_ID = 2
FIRST_RULE = 1 << 16
#: Planes at least.
PLANES = 2
#: A shard is closed once it has this many tokens.
SHARD_TOKENS = 1 << 20
#: Pairs become rules if they occur this often: a rule takes 12 bytes and saves 2.25 at each place.
MIN_COUNT = 6
#: At most so many a round; rounds go on until no pair is left.
RULES_A_ROUND = 1 << 13
BINS = 1 << 20

SHARD_SCHEMA = "part int, nth int, part_start long, n_tokens long, shard binary"
TOKEN_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _bins(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - 20)


def _frequent(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys ``left << 32 | right`` of the most frequent pairs; places in full bins, and which pair stands at each, -1 for none of them.

    Counted in hashed bins first, so that only pairs from full bins are sorted.  Of pairs in
    one bin the most frequent is taken; the others have their turn in a later round.
    """
    bins = _bins(left, right)
    full = np.flatnonzero(np.bincount(bins, minlength=BINS)[bins] >= MIN_COUNT)
    keys, bins = (left[full].astype(np.uint64) << np.uint64(32)) | right[full], bins[full]
    pairs, n = np.unique(keys, return_counts=True)
    pairs, n = pairs[n >= MIN_COUNT], n[n >= MIN_COUNT]
    if len(pairs) > RULES_A_ROUND:
        most = np.argpartition(-n, RULES_A_ROUND)[:RULES_A_ROUND]
        pairs, n = pairs[most], n[most]
    order = np.lexsort((pairs, n))
    pairs, own = pairs[order], _bins((pairs[order] >> np.uint64(32)).astype(np.uint32), pairs[order].astype(np.uint32))
    table = np.full(BINS, -1, np.int64)
    table[own] = np.arange(len(pairs))
    taken = np.flatnonzero(table[own] == np.arange(len(pairs)))
    pairs, table[own[taken]] = pairs[taken], np.arange(len(taken))
    which = table[bins]
    hit = np.flatnonzero(which >= 0)
    which[hit[pairs[which[hit]] != keys[hit]]] = -1
    return pairs, full, which


def compress(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, each document's first symbol, and rules of ``ids`` whose documents start at ``first``."""
    if len(ids) and int(ids.max()) >= FIRST_RULE:
        raise ValueError("a shard's ids are below 65,536")
    symbols = ids.astype(np.uint32)
    starts = np.zeros(len(symbols) + 1, bool)
    starts[first] = True  # the end counts as a start
    # Where a frequent pair may begin: its count only falls unless it has a new symbol, so other places need no second look.
    live = np.ones(len(symbols), bool)
    rules = np.zeros((0, 2), np.uint32)
    while len(symbols) >= 2 * MIN_COUNT:
        places = np.flatnonzero(live[:-1] & ~starts[1:-1])
        pairs, full, which = _frequent(symbols[places], symbols[places + 1])
        if not len(pairs):
            break
        places = places[full]
        live = np.zeros(len(symbols), bool)
        live[places] = True
        hit = which >= 0
        at, which = places[hit], which[hit]
        # Of places that overlap, every second one from the left is replaced.
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) > 1
        order = np.arange(len(at))
        head = np.maximum.accumulate(np.where(fresh, order, 0))
        odd = (order - head) % 2 == 0
        at, which = at[odd], which[odd]
        symbols[at] = which.astype(np.uint32) + np.uint32(FIRST_RULE + len(rules))
        live[at] = live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, live, starts = symbols[keep], live[keep], np.append(starts[:-1][keep], True)
        rules = np.concatenate([rules, np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)])
    return symbols, np.flatnonzero(starts), rules


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Number of ids that each rule stands for; a rule only uses earlier ones."""
    out = np.ones(len(rules), np.int64)
    todo = rules.astype(np.int64) - FIRST_RULE
    while True:
        parts = np.where(todo >= 0, out[np.maximum(todo, 0)], 1).sum(axis=1) if len(rules) else out
        if np.array_equal(parts, out):
            return out
        out = parts


def _planes(n_rules: int) -> int:
    return max(PLANES, (FIRST_RULE + n_rules - 1).bit_length() - 16)


def write_shard(doc_ids: list[int | None], ids: np.ndarray, first: np.ndarray) -> bytes:
    """A shard of documents whose ids start at ``first`` (with the end as last entry)."""
    symbols, starts, rules = compress(ids, first)
    planes = [np.packbits((symbols >> np.uint32(16 + k)) & np.uint32(1)).tobytes() for k in range(_planes(len(rules)))]
    return b"".join([
        MAGIC, struct.pack("<4Q", len(doc_ids), len(rules), len(symbols), len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        starts[:-1].astype("<u8").tobytes(), first[:-1].astype("<u8").tobytes(), rules.astype("<u4").tobytes(),
        expansion_lengths(rules).astype("<u4").tobytes(), (symbols & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes,
    ])


class Shard:
    """Random access to a written shard."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        n_docs, n_rules, n_symbols, self.n_tokens = struct.unpack_from("<4Q", raw, 4)
        self._at = 36

        def take(kind: str, n: int) -> np.ndarray:
            out = np.frombuffer(raw, kind, n, self._at)
            self._at += out.nbytes
            return out

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.first_symbol = np.append(take("<u8", n_docs), n_symbols).astype(np.int64)
        self.first_token = np.append(take("<u8", n_docs), self.n_tokens).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        symbols = take("<u2", n_symbols).astype(np.uint32)
        for k in range(_planes(n_rules)):
            bits = np.unpackbits(take("u1", (n_symbols + 7) // 8), count=n_symbols)
            symbols |= bits.astype(np.uint32) << np.uint32(16 + k)
        self.symbols = symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that ``symbols`` stand for."""
        sizes = self._sizes(symbols)
        out = np.empty(sizes.sum(), np.uint32)
        at = np.cumsum(sizes) - sizes
        while len(symbols):  # only what is still nested goes down a level
            nested = symbols >= FIRST_RULE
            out[at[~nested]] = symbols[~nested]
            pairs, at = self.rules[symbols[nested] - FIRST_RULE], at[nested]
            symbols, at = pairs.ravel(), np.stack([at, at + self._sizes(pairs[:, 0])], axis=1).ravel()
        return out

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids that each symbol stands for."""
        sizes = np.ones(len(symbols), np.int64)
        nested = symbols >= FIRST_RULE
        sizes[nested] = self.lengths[symbols[nested] - FIRST_RULE]
        return sizes

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.first_symbol[i] : self.first_symbol[i + 1]])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, by the stored lengths, without decoding what is before them."""
        doc = int(np.searchsorted(self.first_token, start, "right")) - 1
        last = int(np.searchsorted(self.first_token, stop, "left"))
        own = self.symbols[self.first_symbol[doc] : self.first_symbol[last]]
        sizes = self._sizes(own)
        ends = self.first_token[doc] + np.cumsum(sizes)
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - int(ends[lo] - sizes[lo]) if lo < len(own) else 0
        return self.expand(own[lo:hi])[skip : skip + stop - start]


def _write(path: str, end_id: int, special_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, done, held = TaskContext.get().partitionId(), 0, 0, 0
        encoder = tokens.encoder(path, True, special_text)
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            raw = write_shard(doc_ids, np.concatenate(parts), first)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([done], pa.int64()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())],
                ["part", "nth", "part_start", "n_tokens", "shard"],
            )

        for batch in batches:
            for block in kernel.blocks(batch.column(1), tokens.BLOCK_BYTES):
                ids, places = tokens.with_end(*encoder.encode(block), end_id)
                doc_ids += batch.column(0).slice(block.row0, len(block)).to_pylist()
                parts.append(ids)
                sizes.append(np.diff(places))
                held += len(ids)
                if held >= SHARD_TOKENS:
                    yield shard()
                    nth, done, held, doc_ids, parts, sizes = nth + 1, done + held, 0, [], [], []
        if doc_ids:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, special_text: bool = False) -> DataFrame:
    """Shards of all documents' ids in ascending order of ``doc_id``, as a stage table.

    ``tokenizer`` is the path of a byte-level vocabulary file for the tokenizers library.
    Strings of the vocabulary's special tokens in a text become these tokens, as in the library, or ordinary text with ``special_text``.
    A null text is empty and has just the end id.  Null ids come first; rows with equal ids
    stand in the order of their texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    laid = texts.repartitionByRange(task_count(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(laid.mapInArrow(_write(tokenizer, end_id, special_text), SHARD_SCHEMA), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = Shard(raw.as_py())
            ids = shard.expand(shard.symbols).astype("<u4")
            first = shard.first_token
            crc = [zlib.crc32(ids[lo:hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(start + first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each range of ids
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return shards.join(bases, "part").select((F.col("base") + F.col("part_start")).alias("start"), "shard").mapInArrow(_read, TOKEN_SCHEMA)
