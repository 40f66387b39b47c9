"""Suffix automata of word sequences, grown one sequence at a time."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of the sequences added so far; symbols are any hashable values."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, symbols) -> None:
        """Put in one more sequence; nothing is matched across two of them."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            there = nxt[last].get(c)
            if there is not None:  # this prefix occurred before
                if length[there] == length[last] + 1:
                    last = there
                else:
                    last = self._split(last, c, there)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def matching(self, symbols) -> list[int]:
        """For each position, the longest run ending there that some added sequence contains."""
        nxt, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            else:
                n = 0
            out.append(n)
        return out
