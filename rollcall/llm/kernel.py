"""Vectorised text kernel: words, word hashes and n-gram hashes of whole Arrow batches.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 are
exactly the runs matched by ``[^\\x20\\x09-\\x0D]+``.  Hashes are 64 bits wide and depend on
content alone, so every executor gives equal words equal names.  A span is hashed in
chunks of eight bytes, each followed by a mixing step; a span of more than ``LONG`` bytes
has a cryptographic digest instead.  Whoever knows these fixed hashes can construct texts
that collide, so they only propose.  What decides is hashed under a ``Key`` drawn for each
run: sums of 32-bit parts times secret numbers, in two independent halves, under which any
two different spans or runs of words collide with a probability of 2**-64.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 17

#: Longer spans are hashed one by one.
LONG = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)
#: The low n bytes of a chunk.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Some texts of one Arrow batch: rows ``row0`` to ``row0 + len(offsets) - 1``."""

    row0: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow string or binary column in blocks of bounded size.  A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(column))
        lo, hi = offsets[at], offsets[end]
        yield Block(at, raw[lo:hi], offsets[at : end + 1] - lo)
        at = end


@dataclass
class Words:
    """Word spans of a block.  ``first[i]:first[i + 1]`` are the words of its i-th text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block, separator: np.ndarray = SPACE) -> Words:
    data, offsets = block.data, block.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    inside = ~separator[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edges = offsets[:-1]
    first[edges[edges < len(data)]] = True
    first &= inside
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    edges = offsets[1:]
    last[edges[edges > 0] - 1] = True
    last &= inside
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def chunk_view(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` as a little-endian number, zeros after the end; its last entry is 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[start:end]``.  Of spans of at most eight bytes and equal length no two collide."""
    size = end - start
    chunks = chunk_view(data)
    out = mix((chunks[start] & LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
    todo, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while todo.size:
        left = size[todo] - at
        out[todo] = mix(out[todo] * _GRAM + (chunks[start[todo] + at] & LOW[np.minimum(left, 8)]))
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_HALF = np.uint64(32)
_LOW_HALF = np.uint64((1 << 32) - 1)


@dataclass(frozen=True)
class Key:
    """Secret numbers of one run, two rows for the halves of a hash: for the parts of a span and its length, and for those of a run of words."""

    spans: np.ndarray
    runs: np.ndarray
    secret: bytes


def fresh_key(n: int) -> Key:
    """A key for spans and for runs of up to ``n`` words; it travels to the tasks with the functions that use it."""
    rng = np.random.Generator(np.random.PCG64(secrets.randbits(128)))
    draw = lambda size: rng.integers(0, 1 << 64, (2, size), np.uint64)
    return Key(draw(LONG // 4 + 2), draw(2 * n + 2), secrets.token_bytes(32))


def _joined_halves(sums: list[np.ndarray]) -> np.ndarray:
    return (sums[0] & ~_LOW_HALF) | (sums[1] >> _HALF)


def keyed_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: Key) -> np.ndarray:
    """64-bit hashes of the byte spans under ``key``."""
    size, chunks = end - start, chunk_view(data)
    sums = [k[-1] + size.astype(np.uint64) * k[-2] for k in key.spans]
    part = chunks[start] & LOW[np.minimum(size, 8)]
    for s, k in zip(sums, key.spans):
        s += (part & _LOW_HALF) * k[0] + (part >> _HALF) * k[1]
    todo, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while todo.size:
        left = size[todo] - at
        part = chunks[start[todo] + at] & LOW[np.minimum(left, 8)]
        for s, k in zip(sums, key.spans):
            s[todo] += (part & _LOW_HALF) * k[at // 4] + (part >> _HALF) * k[at // 4 + 1]
        todo, at = todo[left > 8], at + 8
    out = _joined_halves(sums)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.secret).digest(), "little")
    return out


def keyed_grams(hashes: np.ndarray, n: int, key: Key) -> np.ndarray:
    """Hash under ``key`` of each run of n entries of ``hashes``; the i-th result starts at the i-th entry."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    low, high = hashes & _LOW_HALF, hashes >> _HALF
    sums = [np.full(size, n, np.uint64) * k[-2] + k[-1] for k in key.runs]
    for s, k in zip(sums, key.runs):
        for j in range(n):
            s += low[j : j + size] * k[2 * j]
            s += high[j : j + size] * k[2 * j + 1]
    return _joined_halves(sums)


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each byte span: equal for equal bytes and for no others.

    Spans of equal hashes are compared byte by byte; where two differ, all spans are told apart by their bytes.
    """
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size, chunks, rep = end - start, chunk_view(data), first[which]
    same, todo, at = bool((size[rep] == size).all()), np.arange(len(start)), 0
    while same and todo.size:
        left = size[todo] - at
        same = not ((chunks[start[todo] + at] ^ chunks[start[rep[todo]] + at]) & LOW[np.minimum(left, 8)]).any()
        todo, at = todo[left > 8], at + 8
    if same:
        return which
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(start.tolist(), end.tolist())], np.int64)


def lowered(block: Block) -> Block:
    """The block with A-Z in lower case and all other characters as they are."""
    return Block(block.row0, LOWER[block.data], block.offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n entries of ``hashes``; the i-th result starts at the i-th entry."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = hashes[:size] * np.uint64(1)
    for j in range(1, n):
        total *= _GRAM
        total += hashes[j : j + size]
    return mix(total + np.uint64(n))


def shingle_sets(block: Block, n: int, lower: bool, key: Key | None = None) -> Iterator[np.ndarray]:
    """Of each text, its distinct n-word shingles as sorted hashes, fixed ones or under ``key``.

    A text of fewer words gives its whole sequence as one shingle, one without words an empty set.
    """
    if lower:
        block = lowered(block)
    found = words(block)
    hashes = keyed_hashes(block.data, found.start, found.end, key) if key else span_hashes(block.data, found.start, found.end)
    of_run = (lambda part, size: keyed_grams(part, size, key)) if key else grams
    runs = of_run(hashes, n)
    for i in range(len(block)):
        lo, hi = found.first[i], found.first[i + 1]
        if hi - lo >= n:
            yield np.unique(runs[lo : hi - n + 1])
        elif hi > lo:
            yield of_run(hashes[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def string_array(values: list) -> pa.Array:
    return pa.array(values, pa.string())
