"""A minimal acyclic transducer: sorted words with shared prefixes and suffixes, ids as output."""

from __future__ import annotations

import json

import numpy as np


class Lexicon:
    """Compiled transducer over a file of arrays that workers map into memory.

    Each transition carries how many words sort before those behind it, so the sum along a
    word's path is the word's number, which points at its ids.
    """

    @staticmethod
    def compile(words: list[bytes], ids: list[bytes], path: str) -> None:
        """words: sorted, distinct. ids: each word's, as little-endian unsigned 32-bit integers."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []

        def settle(final: bool, edges: list[tuple[int, int]]) -> int:
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append((final, edges))
            return register[key]

        # path[k]: the open state after k bytes of the latest word; its last edge is not settled
        open_: list[list] = [[False, []]]
        last = b""
        for w in [*words, None]:
            k = 0
            if w is not None:
                while k < min(len(w), len(last)) and w[k] == last[k]:
                    k += 1
            while len(open_) > k + 1:
                final, edges = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], settle(final, edges)))
            if w is not None:
                for _ in range(k, len(w)):
                    open_.append([False, []])
                open_[-1][0], last = True, w
        root = settle(*open_[0])
        count = np.zeros(len(states), np.int64)
        key, to, skip = [], [], []
        for s, (final, edges) in enumerate(states):  # a state settles after all behind it
            n = int(final)
            for b, t in edges:
                key.append(s << 8 | b), to.append(t), skip.append(n)
                n += int(count[t])
            count[s] = n
        order = np.argsort(np.array(key, np.int64), kind="stable")
        size = np.array([len(x) // 4 for x in ids], np.int64)
        arrays = {
            "key": np.array(key, np.int64)[order], "to": np.array(to, np.int64)[order], "skip": np.array(skip, np.int64)[order],
            "final": np.array([f for f, _ in states], np.int64), "offset": np.concatenate([[0], np.cumsum(size)]).astype(np.int64),
            "ids": np.frombuffer(b"".join(ids) + b"\0" * (4 * (sum(map(len, ids)) // 4 % 2)), "<i8"),
        }
        head = json.dumps({"root": root, "words": len(words), "sizes": {k: len(v) for k, v in arrays.items()}}).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
            for v in arrays.values():
                f.write(v.astype("<i8").tobytes())

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        whole = np.memmap(path, "<i8", "r")
        at = 1 + -(-n // 8)
        for k, v in head["sizes"].items():
            setattr(self, k, whole[at : at + v])
            at += v
        self.ids, self.root, self.words = self.ids.view("<u4"), head["root"], head["words"]
        self.states, self.edges = len(self.final), len(self.key)

    def number(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for a word that isn't in it; all words advance together."""
        out = np.full(len(words), -1)
        if not self.words or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        byte = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        at = np.cumsum(size) - size
        rows, state, total = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64)
        while len(rows):
            done = size[rows] == 0
            if done.any():
                hit = done & (self.final[state] > 0)
                out[rows[hit]] = total[hit]
                rows, state, total = rows[~done], state[~done], total[~done]
            if not len(self.key):
                break
            key = state << 8 | byte[at[rows]]
            edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            on = self.key[edge] == key
            rows, edge = rows[on], edge[on]
            state, total = self.to[edge], total[on] + self.skip[edge]
            at[rows] += 1
            size[rows] -= 1
        return out

    def __call__(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids, None for a word that isn't in it."""
        out: list[bytes | None] = [None] * len(words)
        number = self.number(words)
        hit = np.flatnonzero(number >= 0)
        a, b = self.offset[number[hit]].tolist(), self.offset[number[hit] + 1].tolist()
        for k, x, y in zip(hit.tolist(), a, b):
            out[k] = self.ids[x:y].tobytes()
        return out
