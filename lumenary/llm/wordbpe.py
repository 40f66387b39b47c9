"""Word-wise BPE: normalise and split like the tokenizer file says, merge exactly in batches."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cached_property

import numpy as np
import public_tokenizers

from lumenary.llm.pairmerge import Pairs, merge_rows
from lumenary.llm.wordtable import WordTable

#: Words of more bytes go to the library's heap-based merge, which is linear in them.
LONGEST = 48
#: Classes of characters in splitting.
WHITE, LETTER, NUMBER, OTHER = range(4)


def model_path(name: str) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of kind BPE with word ends, byte-level, lower-casing.

    encode() splits texts in numpy where their characters allow it, else by the library's
    rules, and resolves each distinct word once. known, if given, maps words (bytes) to their
    ids or None; the rest is merged exactly.
    """

    def __init__(self, name: str, known=None):
        self.path, self.known = model_path(name), known
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names])
        self.last = np.array([vocab[c + end] for c in names])
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.pairs = Pairs([vocab[a] for a, _ in parts], [vocab[b] for _, b in parts], range(len(parts)), [vocab[a + b] for a, b in parts], len(self.token))
        self.names, self.table = names, WordTable()
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = re.compile("[^\\t-\\r -~\u00a1-\u012f\u0131-\u0148\u014a-\u017f]")
        kind = {c: "LNZ".find(unicodedata.category(chr(c))[0]) for c in range(0x180)}
        self.kind = np.array([WHITE if c in (*range(9, 14), 32, 0x85, 0xA0) else (LETTER, NUMBER, OTHER, OTHER)[kind[c]] for c in range(0x180)], np.uint8)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def near(self, text: str) -> bool:
        """True if numpy can split the text: characters below U+0180 that stay single, no special token."""
        return (text.isascii() or not self.odd.search(text)) and not ("<|" in text and self.marks and self.marks.search(text))

    def words(self, text: str) -> list[str]:
        """The words of any text in order, by the library's own rules; special tokens stay whole."""
        parts = self.marks.split(text) if self.marks else [text]
        out = []
        for k, p in enumerate(parts):
            if k % 2:
                out.append(p)
            else:
                norm = self.library.normalizer.normalize_str(p)
                out += [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def spans(self, buffer: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each word in a buffer of lower-cased near texts that begin at texts."""
        byte = np.frombuffer(buffer, np.uint8)
        kind = self.kind[np.minimum(byte, 127)]
        lead = np.flatnonzero(byte >= 0xC2)
        kind[lead] = self.kind[((byte[lead] & 31).astype(np.int64) << 6) | (byte[lead + 1] & 63)]
        kind[lead + 1] = kind[lead]
        start = np.empty(len(byte) + 1, bool)
        start[0] = start[-1] = True
        start[1:-1] = kind[1:] != kind[:-1]
        start[texts] = True
        start[:-1] |= kind == NUMBER
        start[lead + 1] = False
        mark = np.flatnonzero(byte == 39)
        if len(mark):
            mark = mark[start[mark]]
            after = np.concatenate([byte, np.zeros(3, np.uint8)])
            a, b = after[mark + 1], after[mark + 2]
            limit = np.append(texts, len(byte))
            room = limit[np.searchsorted(limit, mark, "right")] - mark
            two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (room > 2)
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (room > 1)
            start[mark[one | two] + 1] = False
            for on, n in ((one, 2), (two, 3)):
                end = mark[on] + n
                end = end[(end < len(byte))]
                start[end[kind[end] == LETTER]] = True
        at = np.flatnonzero(start)
        size = np.diff(at)
        on = kind[at[:-1]] != WHITE
        return at[:-1][on], size[on]

    def merged(self, raw: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers, by exact merging."""
        out: list[bytes] = [b""] * len(raw)
        size = np.array([len(b) for b in raw])
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            if n > LONGEST:
                for r in rows:
                    name = "".join(self.names[b] for b in raw[r])
                    out[r] = np.array([t.id for t in self.library.model.tokenize(name)], "<u4").tobytes()
                continue
            byte = np.frombuffer(b"".join(raw[r] for r in rows), np.uint8).reshape(len(rows), n)
            sym = self.inner[byte]
            sym[:, -1] = self.last[byte[:, -1]]
            ids, length = merge_rows(sym, self.pairs)
            flat, width = ids.astype("<u4").tobytes(), 4 * n
            for k, (r, m) in enumerate(zip(rows.tolist(), length.tolist())):
                out[r] = flat[k * width : k * width + 4 * m]
        return out

    def resolved(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, of those in the lexicon from there."""
        ids = self.known(words) if self.known is not None else [None] * len(words)
        miss = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(miss, self.merged([words[k] for k in miss])):
            ids[k] = x
        return ids

    def entries(self, buffer: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The table's entry for each word; what it lacks is resolved once and added."""
        return self.table.entries(buffer, start, size, self.resolved)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's begin (with the end)."""
        if self.table.full:
            self.table.clear()
        near = np.array([self.near(t) for t in texts], bool)
        parts: list = [None] * len(texts)
        lower = [t.lower().encode() for t, on in zip(texts, near) if on]
        if lower:
            buffer = b"".join(lower)
            begin = np.concatenate([[0], np.cumsum([len(b) for b in lower])])
            start, size = self.spans(buffer, begin[:-1]) if buffer else (np.zeros(0, np.int64),) * 2
            ids, at = self.table.gather(self.entries(buffer, start, size))
            cut = at[np.searchsorted(start, begin)]
            if near.all():
                return ids, cut
            for k, a, b in zip(np.flatnonzero(near).tolist(), cut.tolist(), cut[1:].tolist()):
                parts[k] = ids[a:b]
        for k in np.flatnonzero(~near).tolist():
            words = self.words(texts[k])
            raw = [w.encode() for w in words]
            size = np.array([len(b) for b in raw], np.int64)
            ids, at = self.table.gather(self.entries(b"".join(raw), np.cumsum(size) - size, size))
            marks = [j for j, w in enumerate(words) if w in self.special]
            if marks:
                pieces = np.split(ids, np.sort(np.concatenate([at[marks], at[np.array(marks) + 1]])))
                for m, j in enumerate(marks):
                    pieces[2 * m + 1] = np.array([self.special[words[j]]], np.uint32)
                ids = np.concatenate(pieces)
            parts[k] = ids
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens one space apart: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))
