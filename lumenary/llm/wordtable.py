"""Words in a hash table that compares their bytes, with integers for each, all in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

from lumenary.llm.common import mix

_TAIL = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)


def eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place on as one integer, with zeros after the end."""
    padded = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    return np.ndarray((max(len(padded) - 7, 0),), "<u8", padded.data, strides=(1,))


def word_hashes(buffer: bytes, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each of the buffer's slices; equal bytes, equal hash, but not the other way."""
    eight = eights(buffer)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    long = size > 256
    for k in np.flatnonzero(long).tolist():
        piece = buffer[start[k] : start[k] + size[k]]
        out[k] ^= np.uint64(int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little"))
    at, left = start, size
    rows = None
    if long.any():
        rows = np.flatnonzero(~long)
        at, left = start[rows], size[rows]
    while len(at):
        value = eight[at] & _TAIL[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ value)
            rows = np.flatnonzero(left > 8)
            at, left = at[rows] + 8, left[rows] - 8
        else:
            out[rows] = mix(out[rows] ^ value)
            on = left > 8
            rows, at, left = rows[on], at[on] + 8, left[on] - 8
    return out


class WordTable:
    """Open addressing from words to slices of one pool of unsigned 32-bit integers.

    Words meet by their hash and are told apart by their bytes. Words of one hash that differ
    from the first of it are kept by a dictionary.
    """

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.offset, self.pool, self.count, self.filled = np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0
        self.text, self.at, self.size, self.written = np.zeros(1 << 16, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.twins: dict[bytes, int] = {}

    @property
    def full(self) -> bool:
        return self.count > 1 << (self.bits - 1) or self.written > 1 << 27

    def entries(self, buffer: bytes, start: np.ndarray, size: np.ndarray, resolve) -> np.ndarray:
        """The entry of each of the buffer's words; resolve gives new words' integers, as little-endian bytes."""
        key = word_hashes(buffer, start, size)
        entry = self._find(key)
        lack = np.flatnonzero(entry < 0)
        if len(lack):
            new, first, back = np.unique(key[lack], return_index=True, return_inverse=True)
            at = lack[first]
            words = [buffer[a:b] for a, b in zip(start[at].tolist(), (start[at] + size[at]).tolist())]
            before = self.count
            self._append(words, resolve(words))
            self._place(new, np.arange(before, self.count, dtype=np.int32))
            entry[lack] = before + back
        other = np.flatnonzero(~self._same(entry, buffer, start, size))
        if len(other):
            words = [buffer[a:b] for a, b in zip(start[other].tolist(), (start[other] + size[other]).tolist())]
            fresh = [w for w in dict.fromkeys(words) if w not in self.twins]
            self.twins |= {w: self.count + k for k, w in enumerate(fresh)}
            if fresh:
                self._append(fresh, resolve(fresh))
            entry[other] = [self.twins[w] for w in words]
        return entry

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of all entries in order, and where each entry's begin (with the end)."""
        size = self.offset[entry + 1] - self.offset[entry]
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.offset[entry] - begin[:-1], size) + np.arange(begin[-1])
        return self.pool[at], begin

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.entry[slot]
        rows = np.flatnonzero((self.key[slot] != key) & (out >= 0))
        slot = slot[rows]
        while len(rows):
            slot = (slot + 1) & mask
            got = self.entry[slot]
            out[rows] = got
            on = (got >= 0) & (self.key[slot] != key[rows])
            rows, slot = rows[on], slot[on]
        return out

    def _same(self, entry: np.ndarray, buffer: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the entries' words are the buffer's, eight bytes at a time."""
        out = self.size[entry] == size
        for k in np.flatnonzero(out & (size > 256)).tolist():
            a = self.at[entry[k]]
            out[k] = self.text[a : a + size[k]].tobytes() == buffer[start[k] : start[k] + size[k]]
        here, there = eights(buffer), np.ndarray((len(self.text) - 7,), "<u8", self.text.data, strides=(1,))
        rows = np.flatnonzero(out & (size <= 256))
        a, b, left = start[rows], self.at[entry[rows]], size[rows]
        while len(rows):
            same = ((here[a] ^ there[b]) & _TAIL[np.minimum(left, 8)]) == 0
            out[rows] = same
            on = same & (left > 8)
            rows, a, b, left = rows[on], a[on] + 8, b[on] + 8, left[on] - 8
        return out

    def _append(self, words: list[bytes], rows: list[bytes]) -> None:
        """New entries: words with their integers."""
        size = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        long = np.fromiter(map(len, words), np.int64, len(words))
        data, raw = np.frombuffer(b"".join(rows), "<u4"), np.frombuffer(b"".join(words), np.uint8)
        n = self.count + len(rows)
        self.offset, self.at, self.size = (roomy(x, n + 1) for x in (self.offset, self.at, self.size))
        self.pool, self.text = roomy(self.pool, self.filled + len(data)), roomy(self.text, self.written + len(raw) + 8)
        self.offset[self.count + 1 : n + 1] = self.filled + np.cumsum(size)
        self.at[self.count : n], self.size[self.count : n] = self.written + np.cumsum(long) - long, long
        self.pool[self.filled : self.filled + len(data)] = data
        self.text[self.written : self.written + len(raw)] = raw
        self.count, self.filled, self.written = n, self.filled + len(data), self.written + len(raw)

    def _place(self, key: np.ndarray, entry: np.ndarray) -> None:
        """Distinct new hashes into free slots."""
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slot):
            free = self.entry[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.entry[at], self.key[at] = entry[won], key[won]
            rest = np.ones(len(slot), bool)
            rest[won] = False
            slot, key, entry = (slot[rest] + 1) & mask, key[rest], entry[rest]


def roomy(x: np.ndarray, n: int) -> np.ndarray:
    """x, or x in a longer array if it has fewer than n places."""
    if n <= len(x):
        return x
    return np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])
