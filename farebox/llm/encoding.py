"""Text to token ids with the tokenizers library, unit by unit.

Both tokenizers cut text before merging. Some of these cuts can be told from the
bytes alone: before a space that a non-space follows, where ASCII or Latin-1
letters, digits and marks meet, and around a line break between non-spaces. The
units between such cuts are encoded by the library once per worker and looked up
by a 64-bit hash afterwards; whatever stands between cuts that can't be told this
way (other scripts, apostrophes, runs of white space) is one longer unit, so the
ids are always those of the whole text. The table of units has a fixed size, is
touched only as far as it is filled, and starts anew when it is full. The vocabulary file is a parameter and stays where
it is. Strings of special tokens in a text are ordinary text; NULL is empty.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from farebox.llm import common as C

_OTHER, _LETTER, _DIGIT, _MARK, _WS = 0, 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x27] = _OTHER                                  # apostrophe: contractions
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _WS
#: Lead bytes of characters that are surely not white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[[*range(0xC4, 0xE1), *range(0xE4, 0xF5)]] = True
_ENCODERS: dict[str, Encoder] = {}
C.KEPT["encoding"] = _ENCODERS.clear


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start positions of the units of all texts, ascending."""
    n = len(data)
    cls = _CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if n else np.zeros(0, int)
    cls[lead] = _LETTER
    cls[lead + 1] = _LETTER
    solid = _SOLID[data]
    solid[lead] = True
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n > 1:
        a, b = cls[:-1], cls[1:]
        inner = (a != b) & (a != _OTHER) & (b != _OTHER) & (a != _WS) & (b != _WS)
        edge[1:n] |= inner
        edge[:n - 1] |= (data[:-1] == 0x20) & solid[1:]
        if n > 2:
            word = (cls != _OTHER) & (cls != _WS)
            line = np.flatnonzero((data[1:-1] == 0x0A) & word[:-2] & solid[2:]) + 1
            edge[line] = True
            edge[line + 1] = True
    return np.flatnonzero(edge[:n])


class Encoder:
    """A worker's encoder of one vocabulary file."""

    kind: type = np.uint32                                # of ids in the pool
    at = np.empty(0, np.int32)
    pool = np.empty(0, np.uint32)

    def __init__(self, path: str, slots: int = 1 << 21) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.kind = np.uint16 if top < 1 << 16 else np.uint32
        self.slots = slots
        self.reset()

    def reset(self) -> None:
        if len(self.at) != self.slots:
            self.at = np.empty(self.slots, np.int32)      # slot -> entry
            self.keys = np.empty(self.slots, np.uint64)   # entry -> hash
            self.start = np.empty(self.slots + 1, np.uint32)      # entry -> ids in the pool, up to the next one's
        self.at.fill(-1)
        if len(self.pool) != 8 * self.slots:              # new, or grown by a very long text
            self.pool = np.empty(8 * self.slots, self.kind)
        self.start[0] = self.entries = self.used = 0

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 2048):      # the library's results are many times their ids
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + 2048], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def sizes(self, entry: np.ndarray) -> np.ndarray:
        """How many ids the entries have."""
        return self.start[entry + 1].astype(np.int64) - self.start[entry]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entries of the hashes; -1 for those not yet met."""
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        entry = self.at[slot]
        todo = np.flatnonzero((entry >= 0) & (self.keys[entry] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
            entry[todo] = self.at[slot[todo]]
            todo = todo[(entry[todo] >= 0) & (self.keys[entry[todo]] != h[todo])]
        return entry

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        n, first = len(h), self.entries
        if self.used + len(ids) > len(self.pool):
            old, self.pool = self.pool, np.empty(max(self.used + len(ids), 2 * len(self.pool)), self.kind)
            self.pool[:self.used] = old[:self.used]
        self.keys[first:first + n] = h
        self.start[first + 1:first + n + 1] = self.used + np.cumsum(size)
        self.pool[self.used:self.used + len(ids)] = ids
        self.entries, self.used = first + n, self.used + len(ids)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):       # of several that want a free slot, one gets it
            free = todo[self.at[slot[todo]] < 0]
            self.at[slot[free]] = first + free
            todo = todo[self.at[slot[todo]] != first + todo]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and their offsets by text."""
        if self.entries > self.slots // 2 or self.used > 8 * self.slots:
            self.reset()
        start = units(data, offsets)
        of = np.searchsorted(start, offsets)
        end = np.append(start[1:], len(data))
        h = C.span_hashes(data, start, end)
        entry = self.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            at = new[first]
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            if self.entries + len(keys) > self.slots * 3 // 4:
                self.reset()
                return self.encode(data, offsets) if len(keys) < self.slots // 2 else self._each(data, offsets)
            self.add(keys, *self.whole(texts))
            entry[new] = self.find(h[new])
        size = self.sizes(entry)
        done = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=done[1:])
        idx = np.repeat(self.start[entry] - done[:-1], size)
        idx += np.arange(len(idx))
        return self.pool[idx].astype(np.uint32), done[of]

    def _each(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids, size = self.whole([raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        return ids, np.concatenate([[0], np.cumsum(size)])


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_column(col: pa.Array, path: str, limit: int = C.SLICE_BYTES):
    """For each range of rows of ``col`` of about ``limit`` bytes: the rows, ids and offsets."""
    one = encoder(path)
    for lo, hi in C.slices(col, limit):
        yield lo, hi, *one.encode(*C.utf8(col.slice(lo, hi - lo)))
