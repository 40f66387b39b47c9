"""SentencePiece BPE by a table of the last piece of each prefix, and decoding of its ids."""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import documents, map_slices, strings
from lumenary.llm.pairmerge import NONE
from lumenary.llm.tokencount import PieceCounter

#: Units and pairs that a worker remembers; they are stores of results: their size changes none.
UNITS, PAIRS = 400_000, 400_000
#: Characters of a unit that is remembered.
LONGEST = 64
SHIFT = 20

codecs.register_error("lumenary-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Compatible(dict):
    """left << SHIFT | right to whether merging the characters of both leaves just these two.

    Greedy merging makes a sequence of pieces exactly if it makes each piece of its own
    characters and each neighbouring pair of theirs: what first crosses a border between two
    pieces depends on the merges inside these two alone.
    """

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, key: int) -> bool:
        if len(self) > PAIRS:
            self.clear()
        left, right = key >> SHIFT, key & (1 << SHIFT) - 1
        model = self.model
        got = left == model.start or model.merged(model.chars[left] + model.chars[right]) == [left, right]
        self[key] = got
        return got


class PieceModel:
    """A sentencepiece BPE model of identity normalisation with byte fallback, beside its library."""

    def __init__(self, name: str):
        counter = PieceCounter(name)
        self.library, self.cuts = counter.library, counter.cuts
        n = self.library.get_piece_size()
        self.start = self.library.unk_id()
        self.end = self.library.eos_id()
        symbols = counter.pairs.symbols
        self.rule = dict(zip(counter.pairs.key.tolist(), zip(counter.pairs.rank.tolist(), counter.pairs.new.tolist())))
        self.symbols = symbols
        normal = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        text = {i: self.library.id_to_piece(i) for i in normal} | {s: c for c, s in counter.symbol.items()}
        self.chars = {s: [counter.symbol[c] for c in t] for s, t in text.items()}
        byte = {b: self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        if any(self.library.is_unknown(i) for i in byte.values()):
            raise ValueError(f"{name} has no piece for each byte")
        self.byte = byte
        #: Ids of a symbol, last one first: itself, or its bytes if it is a character that only occurs inside pieces.
        self.ids = {s: [s] if s < n else self.in_bytes(t)[::-1] for s, t in text.items()}
        #: Pieces of two characters or more that merging makes of their own characters; others never occur.
        self.automaton = ahocorasick.Automaton()
        for s, t in text.items():
            if len(t) > 1 and self.merged(self.chars[s]) == [s]:
                self.automaton.add_word(t, (s, len(t)))
        self.automaton.make_automaton()
        self.length = {s: len(t) for s, t in text.items()}
        self.single = counter.symbol
        self.compatible = Compatible(self)
        self.known: dict[str, bytes] = {}
        plain = [b"" if self.library.is_control(i) else self.library.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        for b, i in byte.items():
            plain[i] = bytes([b])
        plain[self.start] = " ⁇ ".encode()
        self.plain = plain

    def in_bytes(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode()]

    def merged(self, symbols: list[int]) -> list[int]:
        """What is left after merging the best pair (the leftmost of equal rank) until none merges."""
        out, width, nothing = list(symbols), self.symbols, (NONE, 0)
        of = lambda k: self.rule.get(out[k] * width + out[k + 1], nothing)
        rules = [of(k) for k in range(len(out) - 1)]
        while rules and (best := min(rules)) is not nothing:
            k = rules.index(best)
            out[k : k + 2] = [best[1]]
            del rules[k]
            if k:
                rules[k - 1] = of(k - 1)
            if k < len(rules):
                rules[k] = of(k)
        return out

    def table(self, text: str) -> list[int]:
        """The last symbol of the encoding of each prefix of text; text[:0] has the start.

        Of the matches that end at a place one is compatible with the last symbol of the prefix before
        it; where no longer one is, it is the single character. A character that no rule knows merges
        with nothing: after it all starts anew.
        """
        last = [self.start, *map(self.single.get, text, repeat(self.start))]
        compatible, done = self.compatible, -1
        for at, (symbol, size) in self.automaton.iter(text):
            if at != done and compatible[last[at + 1 - size] << SHIFT | symbol]:
                last[at + 1], done = symbol, at
        return last

    def learn(self, units: list[str]) -> None:
        """Put the ids of units into known: one table for all, a gap between them; ids are recovered backwards from its end."""
        whole = "".join(units)
        gap = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in self.single and c not in whole)
        text = gap.join(units)
        last, length, ids, normal = self.table(text), self.length, self.ids, len(self.plain)
        out: list[int] = []
        cuts = [0]
        i = len(text)
        while i:
            s = last[i]
            if s == self.start:
                i -= 1
                if text[i] == gap:
                    cuts.append(len(out))
                else:
                    out += self.in_bytes(text[i])[::-1]
            else:
                i -= length[s]
                if s < normal:
                    out.append(s)
                else:
                    out += ids[s]
        raw, n = np.array(out[::-1], "<u4").tobytes(), len(out)
        cuts.append(n)
        for unit, a, b in zip(reversed(units), cuts, cuts[1:]):
            self.known[unit] = raw[4 * (n - b) : 4 * (n - a)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        known = self.known
        if len(known) > UNITS:
            known.clear()
        # the model puts a space before a text
        spaced = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        split = [UNIT.findall(t) if self.cuts else [t] * bool(t) for t in spaced]
        fresh = list({u for units in split for u in units if u not in known})
        if fresh:
            self.learn(fresh)
        out = [b"".join([known[u] for u in units]) for units in split]
        for u in fresh:
            if len(u) > LONGEST:
                del known[u]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in order, bytes joined to characters, without the space put before."""
        plain, parts = self.plain, [[]]
        for i in ids if any(not plain[i] for i in ids[:-1]) else ():
            parts[-1].append(i) if plain[i] else parts.append([])  # bytes beside a control id don't join
        parts = parts if len(parts) > 1 else [ids]
        text = "".join(b"".join([plain[i] for i in part]).decode(errors="lumenary-each-byte") for part in parts)
        first = next((i for i in ids if plain[i]), self.start)
        return text[1:] if self.library.id_to_piece(first)[0] == "▁" else text


#: No piece crosses from a run of spaces and what follows into the next, nor a line feed.
UNIT = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")


@lru_cache(1)
def model(tokenizer: str) -> PieceModel:
    """One model for all tasks of a worker."""
    return PieceModel(tokenizer)


def encode(docs: DataFrame, id_: str = "doc_id", text: str = "text", tokenizer: str = "piece_bpe_32k.model", end: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers, the last one the end id if end."""

    def start():
        own = model(tokenizer)
        last = np.array([own.end] if end else [], "<u4").tobytes()

        def step(part):
            ids = [x + last for x in own.encode(strings(part))]
            return [part.column("doc_id"), [len(x) // 4 for x in ids], pa.array(ids, pa.binary())]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str = "piece_bpe_32k.model", digest: bool = False) -> DataFrame:
    """The columns of encode() with text, or only two digests: of the decimal ids, one space apart, and of the text."""

    def start():
        own = model(tokenizer)
        decimal = [str(i) for i in range(len(own.plain))]

        def step(part):
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column("ids").to_pylist()]
            texts = [own.decode(x) for x in ids]
            out = [part.column("doc_id"), part.column("n_tokens")]
            if digest:
                return [*out, [hashlib.sha256(" ".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in texts]]
            return [*out, part.column("ids"), pa.array(texts, pa.string())]

        return step

    return map_slices(encoded, start, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, text string"), "ids")


def op12_piece_prefixes(spark, sf_dir: str) -> DataFrame:
    """Ids (with an end id) and decoded text of every document, as digests.

    A null or empty text has the end id alone and decodes to the empty text; a repeated row is encoded
    again; other columns play no part; an empty table gives no rows; a text of any length is
    encoded whole, in time that grows with its length.
    """
    return decode(encode(documents(spark, sf_dir)), digest=True)
