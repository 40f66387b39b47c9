"""Token counts by a deterministic transducer over text, by exact merging for what it has not compiled."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import documents, map_slices, utf8
from lumenary.llm.pairmerge import Pairs, merge_rows
from lumenary.llm.wordbpe import model_path
from lumenary.llm.wordtable import WordTable

#: States of a worker's transducer from which it compiles no more, and symbols of a unit that it
#: or a matrix row takes.
STATES, LONGEST = 150_000, 40
#: Bytes of a chunk, of which many are run side by side.
CHUNK = 64
#: The vocabulary's pieces of characters up to here are compiled from the start, others when met.
FIRST = "\u024f"
SPACE = "▁".encode()


class PieceCounter:
    """A sentencepiece BPE model of identity normalisation with byte fallback.

    Text is cut into units (a run of spaces and what follows it up to the next space or line
    feed) that no piece crosses; init checks that of the model. The unit's count is the exact
    number of pieces after merging, a byte for each byte of unknown characters.
    """

    def __init__(self, name: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path(name))
        n = self.library.get_piece_size()
        normal = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        pieces = {self.library.id_to_piece(i): i for i in normal}
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and "".join(self.library.id_to_piece(i) for i in self.library.encode(" a 　ﬁ")) == "▁▁a▁　ﬁ"
        chars = sorted({c for p in pieces for c in p})
        self.symbol = {c: pieces.get(c, n + 1 + k) for k, c in enumerate(chars)}
        code = np.arange(0x110000)
        self.table = np.full(0x110000, n, np.int32)  # by code point; n: unknown, which no pair has
        self.table[[ord(c) for c in chars]] = list(self.symbol.values())
        self.more = np.where(self.table == n, (code >= 0x80).astype(np.uint8) + (code >= 0x800) + (code >= 0x10000), 0).astype(np.uint8)
        known = {**{c: s for c, s in self.symbol.items()}, **pieces}
        self.pieces = [p.replace("▁", " ").encode() for p in pieces if p[0] == "▁" and max(p.replace("▁", " ")) <= FIRST]
        order = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: (-self.library.get_score(pieces[p]), pieces[p])))}
        found = [(known[p[:k]], known[p[k:]], order[p], pieces[p]) for p in pieces for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        self.pairs = Pairs(*np.array(found, np.int64).T, n + 1 + len(chars))

    def whole(self, text: str) -> int:
        return len(self.library.encode(text))

    def units(self, units: list[bytes]) -> np.ndarray:
        """The exact count of each unit."""
        text = [u.decode().replace(" ", "▁") for u in units]
        out = np.zeros(len(units), np.int64)
        size = np.array([len(t) for t in text])
        for n in np.unique(size):
            rows = np.flatnonzero(size == n).tolist()
            if n > LONGEST:
                for r in rows:
                    raw = units[r].decode()
                    out[r] = self.whole(raw[1:]) if raw[0] == " " else self.whole("\n" + raw) - 2
                continue
            code = np.frombuffer("".join(text[r] for r in rows).encode("utf-32-le"), "<u4").reshape(len(rows), n)
            out[rows] = merge_rows(self.table[code].astype(np.int64), self.pairs)[1] + self.more[code].sum(axis=1)
        return out


class Transducer:
    """Deterministic states over bytes, with a number of tokens on each transition.

    A state stands for a prefix of units. The transition to a longer prefix emits by how many
    tokens the merge rules make of it more than of the shorter one (or less, if a merge joins
    two), so the emissions along a unit add up to its count. A unit begins in state 0. State 1
    takes what leaves the compiled prefixes; the transition into it takes back what was emitted,
    and the unit is merged exactly. Compiled are the vocabulary's pieces and, up to STATES, units
    that come again.
    """

    def __init__(self, counter: PieceCounter):
        self.counter, self.others = counter, WordTable(21)
        self.column = np.zeros(256, np.int64)  # of bytes that some transition reads; 0: none
        self.next = np.ones((1 << 16, 1), np.int32)
        self.emit = np.zeros((1 << 16, 1), np.int16)
        self.total = np.zeros(1 << 16, np.int16)  # tokens of a state's prefix
        self.states = 2
        if counter.cuts:
            self.compile(counter.pieces)

    def compile(self, units: list[bytes]) -> None:
        """Add units of at most LONGEST bytes and their prefixes, all at once level by level."""
        if not units or self.states >= STATES:
            return
        size = np.array([len(u) for u in units])
        byte = np.frombuffer(b"".join(units), np.uint8)
        fresh = np.setdiff1d(np.unique(byte), np.flatnonzero(self.column))
        if len(fresh):
            self.column[fresh] = self.next.shape[1] + np.arange(len(fresh))
            self.next = np.hstack([self.next, np.ones((len(self.next), len(fresh)), np.int32)])
            self.emit = np.hstack([self.emit, np.repeat(-self.total[:, None], len(fresh), axis=1)])
        at, state = np.cumsum(size) - size, np.zeros(len(units), np.int64)
        width = self.next.shape[1]
        for k in range(size.max()):
            rows = np.flatnonzero(size > k)
            edge = state[rows] * width + self.column[byte[at[rows] + k]]
            new, first = np.unique(edge[self.next.reshape(-1)[edge] == 1], return_index=True)
            if len(new):
                first = rows[np.flatnonzero(self.next.reshape(-1)[edge] == 1)[first]]
                grown = np.arange(self.states, self.states + len(new))
                self.states += len(new)
                while self.states > len(self.next):
                    self.next = np.vstack([self.next, np.ones_like(self.next)])
                    self.emit, self.total = np.vstack([self.emit, np.zeros_like(self.emit)]), np.append(self.total, np.zeros_like(self.total))
                self.total[grown] = self.counted([units[u][: k + 1] for u in first.tolist()])
                self.emit[grown] = -self.total[grown, None]
                self.next.reshape(-1)[new] = grown
                self.emit.reshape(-1)[new] = self.total[grown] - self.total[new // width]
            state[rows] = self.next.reshape(-1)[edge]

    def counted(self, prefixes: list[bytes]) -> np.ndarray:
        """Tokens of each prefix, up to its last whole character."""
        whole = [p.decode(errors="ignore").encode() for p in prefixes]
        out, some = np.zeros(len(whole), np.int64), [k for k, p in enumerate(whole) if p]
        if some:
            out[some] = self.counter.units([whole[k] for k in some])
        return out

    def advance(self, state: np.ndarray, column: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The states after size bytes from start on."""
        out, flat, width = state.copy(), self.next.reshape(-1), self.next.shape[1]
        k, live = 0, np.flatnonzero((size > 0) & (state != 1))
        while len(live):
            out[live] = flat[out[live] * width + column[start[live] + k]]
            k += 1
            live = live[(size[live] > k) & (out[live] != 1)]
        return out

    def entries(self, column: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The state before each chunk, by a parallel prefix scan over the chunks' maps of states.

        A map is constant (last, 0 or more) if a unit begins in the chunk; else (-1) it is that
        of the chunk's bytes. Neighbouring maps are composed pairwise, level by level, until one
        is left; then each level hands the states before its pairs down to their halves.
        """
        n = len(start)
        if n == 1:
            return np.ones(1, np.int64)
        if n % 2:
            start, size, last = np.append(start, start[-1] + size[-1]), np.append(size, 0), np.append(last, -1)
        left, right = slice(0, None, 2), slice(1, None, 2)
        both = last[right].copy()
        open_ = np.flatnonzero((both < 0) & (last[left] >= 0))
        both[open_] = self.advance(last[left][open_], column, start[right][open_], size[right][open_])
        out = np.empty(len(start), np.int64)
        out[left] = self.entries(column, start[left], size[left] + size[right], both)
        out[right] = last[left]
        open_ = np.flatnonzero(last[left] < 0)
        out[right][open_] = self.advance(out[left][open_], column, start[left][open_], size[left][open_])
        return out[:n]

    def run(self, byte: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, tokens emitted) after each byte; start: where units begin.

        Chunks are run side by side, at first each from state 1, so right from its first unit
        on. The bytes before that are run again from the state that the scan over all chunks'
        maps gives.
        """
        n = len(byte)
        rows = -(-n // CHUNK)
        column = np.zeros(rows * CHUNK, np.int64)
        column[:n] = self.column[byte]
        begin = np.zeros(rows * CHUNK, bool)
        begin[:n] = start
        across, begin = column.reshape(rows, CHUNK).T.copy(), begin.reshape(rows, CHUNK).T.copy()
        flat, emit, width = self.next.reshape(-1), self.emit.reshape(-1), self.next.shape[1]
        states, tokens = np.empty((CHUNK, rows), np.int32), np.empty((CHUNK, rows), np.int16)
        state = np.ones(rows, np.int64)
        for k in range(CHUNK):
            state[begin[k]] = 0
            edge = state * width + across[k]
            state = flat[edge].astype(np.int64)
            states[k], tokens[k] = state, emit[edge]
        last = np.where(begin.any(axis=0), states[-1], -1).astype(np.int64)
        state = self.entries(column, np.arange(rows) * CHUNK, np.full(rows, CHUNK), last)
        live = np.flatnonzero(state != 1)
        for k in range(CHUNK):
            live = live[~begin[k, live]]
            if not len(live):
                break
            edge = state[live] * width + across[k, live]
            state[live] = flat[edge]
            states[k, live], tokens[k, live] = state[live], emit[edge]
            live = live[state[live] != 1]
        return states.T.reshape(-1)[:n], tokens.T.reshape(-1)[:n]

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The token count of each text."""
        texts = [t.replace(SPACE, b" ") for t in texts]
        if not self.counter.cuts:
            return np.array([self.counter.whole(t.decode()) for t in texts])
        # the model puts a space before every text but an empty one
        raw = b"".join(b" " + t for t in texts if t)
        total = np.zeros(len(texts), np.int64)
        if not raw:
            return total
        size = np.array([len(t) + 1 if t else 0 for t in texts])
        byte = np.frombuffer(raw, np.uint8)
        space, feed = byte == 32, byte == 10
        start = feed.copy()
        start[0] = True
        start[1:] |= space[1:] & ~space[:-1] | feed[:-1]
        begin = (np.cumsum(size) - size)[size > 0]
        start[begin] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(byte))
        states, tokens = self.run(byte, start)
        sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
        cut = np.append(begin, len(byte))
        total[size > 0] = sums[cut[1:]] - sums[cut[:-1]]
        left = np.flatnonzero(states[end - 1] == 1)  # the units that aren't compiled; they emitted 0 in sum
        if len(left):
            if self.others.full:
                self.others.clear()
            known = self.others.count
            entry = self.others.entries(raw, at[left], (end - at)[left], lambda units: [int(c).to_bytes(4, "little") for c in self.counter.units(units)])
            np.add.at(total, np.flatnonzero(size > 0)[np.searchsorted(begin, at[left], "right") - 1], self.others.pool[entry].astype(np.int64))
            # units that came before, or twice in these texts
            which, first, times = np.unique(entry, return_index=True, return_counts=True)
            often = left[first[(which < known) | (times > 1)]]
            self.compile([raw[a:b] for a, b in zip(at[often].tolist(), end[often].tolist()) if b - a <= LONGEST])
        return total


@lru_cache(1)
def transducer(tokenizer: str) -> Transducer:
    """One transducer for all tasks of a worker; what it compiles changes no count."""
    return Transducer(PieceCounter(tokenizer))


def token_counts(docs: DataFrame, id_: str = "doc_id", text: str = "text", tokenizer: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text; a null text is empty."""

    def start():
        machine = transducer(tokenizer)

        def step(part):
            raw = utf8(part)
            n = machine.count(raw)
            return [part.column("doc_id"), [len(t) for t in raw], n, n > limit]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document.

    A null or empty text has 0 tokens; a repeated row is counted again; other columns play no
    part; an empty table gives no rows; a text of any length is counted whole.
    """
    return token_counts(documents(spark, sf_dir))
