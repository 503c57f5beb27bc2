"""Token ids of whole texts with a public tokenizer, memoised by word.

Both tokenizers used here split a text before they merge, and never merge across a space
that follows a word.  So a text's ids are those of its pieces in a row, a piece being a
word with the white space before it (byte-level kind) or a word alone (kind that drops
white space).  Pieces repeat, so each worker keeps their bytes and ids in a hash table of
fixed size and asks the tokenizers library only for new ones; a piece counts as known only
if its bytes are those in the table.  Long pieces, and what a full table has no room for,
go to the library each time.  Texts with other white space
than the six ASCII characters, whose splits look further, and texts with the string of a
special token go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from rollcall.llm import kernel

#: Slots of a worker's table of known pieces, and how many of them are used before it starts afresh.
SLOTS = 1 << 22
MOST_KNOWN = SLOTS // 2
#: Pieces given to the library at once; it takes about a kilobyte for each.
CALL = 1 << 12
BLOCK_BYTES = 1 << 19
#: Spaces other than 0x20 and 0x09-0x0D, and controls that a splitter might take for one.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    　﻿]")
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


class Encoder:
    """Ids of blocks of texts.  ``keeps_space``: pieces carry the white space before them; ``special_text``: strings of special tokens are ordinary text."""

    def __init__(self, path: str, keeps_space: bool, special_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        self.specials = [] if special_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # A byte-level token has a character for each of its bytes.
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        """An empty table: upper halves of hashes and entries by slot; of each entry its bytes and ids as places in two pools."""
        self.known = 0
        self.tags = np.zeros(SLOTS, np.uint32)
        self.entry = np.full(SLOTS, -1, np.int32)
        self.text_at, self.text_size, self.at, self.size = (np.zeros(MOST_KNOWN, kind) for kind in (np.int32, np.int16, np.int32, np.int16))
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _find(self, keys: np.ndarray, block: kernel.Block, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of pieces, -1 for unknown ones, -2 for those whose place another piece of a like hash has."""
        slot, tags = (keys & np.uint64(SLOTS - 1)).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32)
        out = np.where(self.tags[slot] == tags, self.entry[slot], -1)
        todo = np.flatnonzero((self.entry[slot] >= 0) & (self.tags[slot] != tags))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            there, same = self.entry[slot[todo]] >= 0, self.tags[slot[todo]] == tags[todo]
            out[todo[there & same]] = self.entry[slot[todo[there & same]]]
            todo = todo[there & ~same]
        found = np.flatnonzero(out >= 0)
        equal_size = self.text_size[out[found]] == size[found]
        other, todo = found[~equal_size], found[equal_size]
        mine, theirs, at = kernel.chunk_view(block.data), np.ndarray((len(self.text) - 7,), "<u8", self.text, 0, (1,)), 0
        while todo.size:  # eight bytes a round
            left = size[todo] - at
            low = kernel.LOW[np.minimum(left, 8)]
            equal = (mine[start[todo] + at] ^ theirs[self.text_at[out[todo]].astype(np.int64) + at]) & low == 0
            other = np.concatenate([other, todo[~equal]])
            todo, at = todo[equal & (left > 8)], at + 8
        out[other] = -2
        return out

    def _library(self, block: kernel.Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has, by the library.

        Pieces that can't touch their neighbours' splits are encoded many in one string, which takes
        the library less than a call for each; the ids' places in the string tell the pieces apart.
        """
        sizes, parts = np.zeros(len(start), np.int64), [np.zeros(0, self.kind)]
        odd = np.concatenate([[0], np.cumsum(_ODD_BYTES[block.data])])
        apart = (end > start) & (odd[end] == odd[start])
        if self.keeps_space:
            apart &= kernel.SPACE[block.data[np.minimum(start, len(block.data) - 1)]] & ~kernel.SPACE[block.data[end - 1]]
        gap = "" if self.keeps_space else " "
        order = [np.flatnonzero(apart), np.flatnonzero(~apart)]
        for which, joined in zip(order, (True, False)):
            for lo in range(0, len(which), CALL):
                own = which[lo : lo + CALL]
                texts = [block.data[s:e].tobytes().decode() for s, e in zip(start[own].tolist(), end[own].tolist())]
                if joined:
                    found = self.tokenizer.encode(gap.join(texts), add_special_tokens=False)
                    parts.append(np.array(found.ids, self.kind))
                    if self.keeps_space:  # nothing is dropped, so a piece ends where its tokens' bytes do
                        upto = np.searchsorted(np.cumsum(self.token_bytes[parts[-1]]), np.cumsum(end[own] - start[own]), "right")
                        sizes[own] = np.diff(upto, prepend=0)
                    else:
                        starts = np.cumsum([0, *(len(t) + len(gap) for t in texts[:-1])])
                        places = np.fromiter((at for at, _ in found.offsets), np.int64, len(found.ids))
                        sizes[own] = np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=len(own))
                else:
                    for i, one in zip(own.tolist(), self.tokenizer.encode_batch(texts, add_special_tokens=False)):
                        sizes[i] = len(one.ids)
                        parts.append(np.array(one.ids, self.kind))
        flat, turn = np.concatenate(parts), np.concatenate(order)
        if (turn[1:] > turn[:-1]).all():
            return flat, sizes
        starts = np.zeros(len(start), np.int64)  # of each piece's ids among those of the pieces in the order of the calls
        starts[turn] = np.cumsum(sizes[turn]) - sizes[turn]
        return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    def _add(self, keys: np.ndarray, block: kernel.Block, start: np.ndarray, end: np.ndarray) -> None:
        """Put pieces with distinct hashes, none of them in the table, into it."""
        flat, sizes = self._library(block, start, end)
        lengths = end - start
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.text_used + int(lengths.sum()) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        own = slice(self.known, self.known + len(keys))
        self.at[own], self.size[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.text_at[own], self.text_size[own] = self.text_used + np.cumsum(lengths) - lengths, lengths
        self.pool[self.used : self.used + len(flat)] = flat
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.text[self.text_used : self.text_used + len(within)] = block.data[np.repeat(start, lengths) + within]
        self.used, self.text_used = self.used + len(flat), self.text_used + len(within)
        slot, todo = (keys & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(keys))
        while todo.size:
            free = todo[self.entry[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.tags[slot[put]], self.entry[slot[put]] = keys[put] >> np.uint64(32), self.known + put
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = np.where(self.entry[slot[todo]] >= 0, (slot[todo] + 1) & (SLOTS - 1), slot[todo])
        self.known += len(keys)

    def _pieces(self, block: kernel.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the pieces, and each text's first piece."""
        found = kernel.words(block)
        if not self.keeps_space:
            return found.start, found.end, found.first
        starts, counts = found.start.copy(), found.counts
        if len(starts):
            starts[1:] = found.end[:-1]
            heads = found.first[:-1][counts > 0]
            starts[heads] = block.offsets[:-1][counts > 0]
        last = np.where(counts > 0, found.end[np.maximum(found.first[1:] - 1, 0)] if len(starts) else 0, block.offsets[:-1])
        tail = np.flatnonzero(last < block.offsets[1:])  # white space after a text's last word
        starts = np.insert(starts, found.first[1:][tail], last[tail])
        ends = np.insert(found.end, found.first[1:][tail], block.offsets[1:][tail])
        extra = np.zeros(len(block) + 1, np.int64)
        extra[tail + 1] = 1
        return starts, ends, found.first + np.cumsum(extra)

    def _new(self, keys: np.ndarray, entry: np.ndarray, length: np.ndarray) -> np.ndarray:
        """One place for each hash of the unknown pieces that are not long."""
        missing = np.flatnonzero((entry == -1) & (length <= kernel.LONG))
        return missing[np.unique(keys[missing], return_index=True)[1]]

    def encode(self, block: kernel.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in a row, and each text's first place."""
        start, end, first = self._pieces(block)
        length, keys = end - start, kernel.span_hashes(block.data, start, end)
        entry = self._find(keys, block, start, length)
        new = self._new(keys, entry, length)
        if self.known + len(new) > MOST_KNOWN:
            self._reset()
            entry[:] = -1
            new = self._new(keys, entry, length)[:MOST_KNOWN]
        if new.size:
            self._add(keys[new], block, start[new], end[new])
            entry = self._find(keys, block, start, length)
        known, rest = entry >= 0, np.flatnonzero(entry < 0)
        size = np.where(known, self.size[entry], 0).astype(np.int64)
        if rest.size:
            more, size[rest] = self._library(block, start[rest], end[rest])
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.where(known, self.at[entry].astype(np.int64), self.used) - upto[:-1]
        if rest.size:  # their ids stand behind the pool's
            at[rest] = self.used + np.cumsum(size[rest]) - size[rest] - upto[rest]
            pool = np.concatenate([self.pool[: self.used], more])
        else:
            pool = self.pool
        ids = pool[np.repeat(at, size) + np.arange(upto[-1])]
        places = upto[first]
        raw = block.data.tobytes()
        look = (self.keeps_space and _ODD_BYTES[block.data].any()) or any(x in raw for x in self.specials)
        return self._whole(block, ids, places) if look else (ids, places)

    def _whole(self, block: kernel.Block, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(len(block)):
            raw = block.text(i)
            text = raw.decode()
            if (self.keeps_space and ODD_SPACE.search(text)) or any(x in raw for x in self.specials):
                parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind))
            else:
                parts.append(ids[places[i] : places[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool, special_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    key = (path, keeps_space, special_text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, keeps_space, special_text)
    return _encoders[key]


def with_end(ids: np.ndarray, places: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    return np.insert(ids, places[1:], end_id), places + np.arange(len(places))
