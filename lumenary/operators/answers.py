"""Quality of tutor answers, and likeness of messages to a bank of known ones."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.operators.sessions import latest
from lumenary.runtime import ship

# Words that are no terms of a question or context.
NO_TERMS = ("define", "explain", "please", "what", "why", "how", "this", "that", "with", "from", "about", "again", "more", "example", "give", "tell", "the", "and")
# What an answer says that found nothing, and what gives away a text without a source.
NOT_FOUND = "i could not find this in your study material"
MARKERS = ("based on my training", "as an ai", "as a language model", "i do not have access", "i don't have access")
# Words that show that a format's promise is kept.
HINTS = {
    "definition": ("definition", "means", "refers to", "simple"),
    "comparison": ("difference", "whereas", "while", "compared", "versus"),
    "numerical": ("formula", "step", "calculate", "answer", "="),
    "exam_answer": ("key", "exam", "marks", "point", "tip"),
    "revision": ("summary", "recap", "remember", "key", "formula"),
    "quiz": ("question", "option", "answer", "try"),
    "stuck": ("simple", "example", "step", "understand", "check"),
    "planning": ("step", "minute", "plan", "priority", "next"),
}
# The weight of each dimension in the score, and of the risk against it.
WEIGHTS = {"relevance": 0.16, "grounding": 0.20, "completeness": 0.11, "clarity": 0.12, "friendliness": 0.10, "formatting": 0.09, "intent": 0.14, "readability": 0.08, "risk": -0.30}
# Phrases that the rule checker counts, and signs of a formula without subscripts.
PHRASES = ("as an ai", "i don't have access", "i cannot", "i'm not sure", "based on my training", "as a language model")
BROKEN = (r"(^|[^a-zA-Z])[A-Z][a-z]?[0-9]+[A-Z]", "H2O([^₂]|$)", "CO2([^₂]|$)", r"\^[0-9+-]")


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def answer_terms(c: Column) -> Column:
    """The first 18 distinct words of four characters or more, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z][a-z0-9_-]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*NO_TERMS))), 1, 18)


def count_of(text: Column, parts: Column) -> Column:
    """How many of the parts are in the text."""
    return F.size(F.filter(parts, lambda p: F.contains(text, p)))


def texts(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def overlap(low: Column, terms: Column, default: Column) -> Column:
    return F.when(F.size(terms) == 0, default).otherwise(F.least(F.lit(1.0), count_of(low, terms) / F.least(F.size(terms), F.lit(8))))


def readability(answer: Column) -> Column:
    """By words a sentence, a little less for a very long word."""
    sentences = F.size(F.filter(F.split(answer, "[.!?]+"), lambda s: stripped(s) != ""))
    words = F.regexp_extract_all(answer, F.lit("[A-Za-z0-9]+"), F.lit(0))
    mean = F.size(words) / F.greatest(F.lit(1), sentences)
    base = F.when(mean <= 22, 0.94).when(mean <= 32, 0.82).when(mean <= 42, 0.68).otherwise(0.5)
    long = F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)) > 28
    return F.when(F.size(words) == 0, 0.0).otherwise(base - F.when(long, 0.08).otherwise(0.0))


def scored(answers: DataFrame, strict: bool = True) -> DataFrame:
    """answers (question, answer, context, format) with the dimensions, risk, score, passed and issues.

    An empty answer has 0 for all and a risk of 1; one that says that nothing was found is full in all.
    """
    rows = answers.withColumns({"_a": stripped(F.col("answer")), "_c": stripped(F.col("context"))}).withColumn("_low", F.lower("_a"))
    a, low, c = F.col("_a"), F.col("_low"), F.col("_c")
    gone, talk = F.contains(low, F.lit(NOT_FOUND)), F.col("format") == "conversation"
    hints = F.coalesce(F.element_at(F.create_map(*(x for k, v in HINTS.items() for x in (F.lit(k), texts(*v)))), F.col("format")), F.array().cast("array<string>"))
    words = F.size(F.filter(F.split(a, r"\s+"), lambda w: w != ""))
    lines = F.size(F.split(a, "\n"))
    plain = {
        "relevance": overlap(low, answer_terms(F.col("question")), F.when(talk, 0.9).otherwise(0.72)),
        "grounding": overlap(low, answer_terms(c), F.lit(0.55 if strict else 1.0)),
        "completeness": F.when(talk, 1.0).otherwise(F.least(F.lit(1.0), F.length(a) / 420)),
        "clarity": F.when(talk | (lines >= 3), 0.94).otherwise(0.76),
        "friendliness": F.when(F.length(a) <= 4500, 0.94).otherwise(0.68),
        "formatting": F.when(talk, 1.0).when(lines > 1, 0.92).otherwise(0.74),
        "intent": F.when(talk, F.when(words.between(1, 80), 1.0).otherwise(0.72)).when(F.size(hints) == 0, 0.78).otherwise(F.least(F.lit(1.0), 0.58 + count_of(low, hints) * 0.12)),
        "readability": readability(a),
    }
    rows = rows.withColumns({k: F.when(a == "", 0.0).when(gone, 1.0).otherwise(v) for k, v in plain.items()})
    marked, bare, loose = F.exists(texts(*MARKERS), lambda m: F.contains(low, m)), (c == "") & ~gone & F.lit(strict), (F.col("grounding") < 0.2) & ~gone & F.lit(strict)
    risk = F.least(F.lit(1.0), F.when(marked, 0.45).otherwise(0.0) + F.when(bare, 0.7).otherwise(0.0) + F.when(loose, 0.25).otherwise(0.0))
    rows = rows.withColumn("risk", F.when(a == "", 1.0).otherwise(risk))
    short = (F.length(a) < 20) & ~talk
    named = (("hallucination_marker", marked), ("unsupported_without_retrieval", bare), ("low_grounding_overlap", loose), ("answer_too_short", short), ("hard_to_read", F.col("readability") < 0.6), ("intent_may_be_unsatisfied", F.col("intent") < 0.62))
    issues = F.array_join(F.array_compact(F.array(*(F.when(on, F.lit(n)) for n, on in named))), ",")
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("score", F.when(a == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))), 2)))
    rows = rows.withColumn("issues", F.when(a == "", "empty_answer").otherwise(issues))
    return rows.withColumn("passed", (F.col("score") >= 0.62) & (F.col("risk") < 0.65) & ~F.contains("issues", F.lit("answer_too_short")) & (a != "")).drop("_a", "_c", "_low")


def checked(answers: DataFrame) -> DataFrame:
    """answers (answer, mode) with points, what the mode asks for, score and passed by penalties."""
    a = F.coalesce("answer", F.lit(""))
    low = F.lower(a)
    bullets = F.regexp_count(a, F.lit("- "))
    lacks = (
        F.when(F.col("mode") == "summary", F.when(bullets < 4, 0.2)).when(F.col("mode") == "explain", F.when(F.length(a) < 150, 0.2))
        .when(F.col("mode") == "exam", F.when(~F.contains(a, F.lit("Q")) & ~F.contains(low, F.lit("question")), 0.3)).when(F.col("mode").isin("keypoints", "key"), F.when(bullets + F.regexp_count(a, F.lit("• ")) < 3, 0.2))
    )
    short = F.length(stripped(a)) < 20
    broken = sum((F.when(a.rlike(p), 1).otherwise(0) for p in BROKEN), F.lit(0))
    said = count_of(low, texts(*PHRASES))
    score = 1 - F.when(short, 0.5).otherwise(0.0) - broken * 0.15 - F.coalesce(lacks, F.lit(0.0)) - said * 0.3
    rows = answers.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))), 2))
    return rows.withColumns({"issues": short.cast("int") + broken + lacks.isNotNull().cast("int") + said, "passed": (F.col("score") >= 0.5) & ~short})


# The parts of the likeness of two messages, and what one inside the other adds.
RATIO, TOKENS, COVERAGE, GRAMS, INSIDE = 0.38, 0.28, 0.20, 0.14, 0.08


#: Characters of a block of messages and of a block of the bank.
MESSAGE_BYTES, BANK_BYTES = 1 << 20, 1 << 20
#: Messages that are answered together at most, and pairs of messages and rows that they may have; cells of one step of the ratios, and cells
#: from which a pair is matched by itself.
TOGETHER, PAIRS, CELLS, LONG = 1024, 1 << 18, 1 << 17, 4 << 20


class Message:
    """A message as the likeness looks at it: plain text, words, runs of three characters."""

    def __init__(self, text: str | None, ignored: frozenset[str]):
        kept = "".join(c if c.isascii() and c.isalnum() or c in " '" else " " for c in (text or "").lower())
        self.text = " ".join(kept.split())
        self.words = {w for w in self.text.split() if len(w) > 1 and w not in ignored}
        solid = self.text.replace(" ", "")
        self.grams = {solid[k : k + 3] for k in range(max(1, len(solid) - 2))} if solid else set()


def shares(a: Message, b: Message) -> float:
    """All of the likeness but the ratio of matching blocks."""
    alike = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    return TOKENS * alike(a.words, b.words) + COVERAGE * (len(a.words & b.words) / len(a.words) if a.words else 0.0) + GRAMS * alike(a.grams, b.grams)


def finished(a: Message, b: Message, score: float) -> float:
    if a.text == b.text:
        return 1.0
    return min(1.0, score + INSIDE) if a.text in b.text or b.text in a.text else score


def likeness(a: Message, b: Message) -> float:
    """0 to 1, to four places; 0 if either has no text."""
    if not a.text or not b.text:
        return 0.0
    return round(finished(a, b, shares(a, b) + RATIO * SequenceMatcher(None, a.text, b.text).ratio()), 4)


def pair_likeness(pairs: DataFrame, left: str, right: str, ignored: frozenset[str] = frozenset()) -> DataFrame:
    """pairs with likeness; a null text is like nothing."""
    ship(pairs.sparkSession)
    kind = T.StructType([*pairs.schema.fields, T.StructField("likeness", T.DoubleType())])

    def run(batches):
        for part in batches:
            out = [likeness(Message(x, ignored), Message(y, ignored)) for x, y in zip(part.column(left).to_pylist(), part.column(right).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], names=[*part.schema.names, "likeness"])

    return pairs.mapInArrow(run, kind)


def longest(a: np.ndarray, b: np.ndarray, high: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest equal piece of each column of a and of b, the first in a, then in b.

    a and b: a text's characters in a column, filled up with values that the other one hasn't, by falling lengths (high) in a;
    no piece is over bound.
    """
    wide, n = b.shape
    kind = np.uint8 if bound < 256 else np.int32
    size, end = np.zeros(n, kind), np.zeros(n, np.int64)
    last, run = (np.zeros((wide + 1, n), kind) for _ in range(2))
    same = np.empty((wide, n), bool)
    for y, c in enumerate(np.searchsorted(-high, -np.arange(len(a))).tolist()):  # columns that are longer than y come first
        np.equal(b[:, :c], a[y, :c], out=same[:, :c])
        np.add(last[:-1, :c], 1, out=run[1:, :c])
        np.multiply(run[1:, :c], same[:, :c].view(np.uint8), out=run[1:, :c])
        new = np.maximum.reduce(run[:, :c], axis=0)
        np.copyto(end[:c], y + 1, where=new > size[:c])
        np.maximum(size[:c], new, out=size[:c])
        last, run = run, last
    size = size.astype(np.int64)
    i, on = end - size, np.arange(n)
    here = np.ones((wide, n), bool)  # where the piece begins in b
    for k in range(size.max(initial=0)):
        on = on[size[on] > k]
        here[wide - k :, on] = False
        here[: wide - k, on] &= b[k:, on] == a[i[on] + k, on]
    return i, here.argmax(axis=0), size


def grown(texts: np.ndarray, todo: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of pairs (start, end of one text, start, end of the other) at i and j, with the equal characters around them."""
    on = np.arange(len(todo))
    while len(on := on[(i[on] > todo[on, 0]) & (j[on] > todo[on, 2])]) and len(on := on[texts[i[on] - 1] == texts[j[on] - 1]]):
        i[on], j[on], size[on] = i[on] - 1, j[on] - 1, size[on] + 1
    on = np.arange(len(todo))
    while len(on := on[(i[on] + size[on] < todo[on, 1]) & (j[on] + size[on] < todo[on, 3])]) and len(on := on[texts[i[on] + size[on]] == texts[j[on] + size[on]]]):
        size[on] += 1
    return i, j, size


def around(todo: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What is left of the pieces, then what is right of them."""
    return np.concatenate([np.stack([todo[:, 0], i, todo[:, 2], j], axis=1), np.stack([i + size, todo[:, 1], j + size, todo[:, 3]], axis=1)])


def columns(texts: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """The pieces of texts from start on as columns, each filled up to the longest one; texts has as many characters more."""
    most = int(size.max())
    rows = np.lib.stride_tricks.sliding_window_view(texts, most)[start]
    rows[np.arange(most) >= size[:, None]] = fill
    return np.ascontiguousarray(rows.T)


def matched(texts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each pair (start, end of one text, start, end of the other), as SequenceMatcher finds them.

    Of all pairs at once: the longest piece, then what is left and right of it, until nothing is left. Pairs of about
    the same width are searched together.
    """
    total, todo, owner = np.zeros(len(pairs), np.int64), pairs, np.arange(len(pairs))
    texts = np.concatenate([texts, np.zeros((pairs[:, [1, 3]] - pairs[:, [0, 2]]).max(initial=0), np.uint8)])
    while len(todo):
        found = np.zeros((len(todo), 3), np.int64)
        high, wide = todo[:, 1] - todo[:, 0], todo[:, 3] - todo[:, 2]
        kind = np.ceil(np.log2(wide)).astype(int)
        for k in np.unique(kind):
            some = np.flatnonzero(kind == k)
            some = some[np.argsort(-high[some], kind="stable")]
            step = max(1, CELLS // int(wide[some].max()))
            for at in (some[c : c + step] for c in range(0, len(some), step)):
                a, b = columns(texts, todo[at, 0], high[at], 255), columns(texts, todo[at, 2], wide[at], 0)
                found[at] = np.stack(longest(a, b, high[at], int(np.minimum(high, wide)[at].max())), axis=1)
        i, j, size = found[:, 0] + todo[:, 0], found[:, 1] + todo[:, 2], found[:, 2]
        np.add.at(total, owner, size)
        parts = around(todo, i, j, size)
        left = np.tile(size > 0, 2) & (parts[:, 0] < parts[:, 1]) & (parts[:, 2] < parts[:, 3])
        todo, owner = parts[left], np.tile(owner, 2)[left]
    return total


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): each index as many times as counts says, numbered from 0."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def matched_by_seeds(texts: np.ndarray, pairs: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """matched() where a piece begins at a seed, or where both texts do: owner, i and j are all places where a pair's texts have the same seed.

    Seeds are few, so a longest piece is looked for among the runs of such places, by the diagonal and along it.
    """
    total, todo, of = np.zeros(len(pairs), np.int64), pairs, np.arange(len(pairs))
    order = np.lexsort((i, i - j, owner))
    g, i, j = owner[order], i[order], j[order]  # g: the part of a pair that a place is in
    while len(todo):
        start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)])[: len(g)])
        run, size = g[start], np.diff(np.append(start, len(g)))
        first = np.lexsort((j[start], i[start], -size, run))
        first = first[np.flatnonzero(np.diff(run[first], prepend=-1))]  # of each part the longest, the first in one text, then in the other
        some = run[first]
        bare = np.ones(len(todo), bool)
        bare[some] = False
        rest = todo[bare]
        np.add.at(total, of[bare], grown(texts, rest, rest[:, 0].copy(), rest[:, 2].copy(), np.zeros(len(rest), np.int64))[2])
        at, bt, n = grown(texts, todo[some], i[start][first], j[start][first], size[first])
        np.add.at(total, of[some], n)
        now = np.searchsorted(some, g)
        left, right = (i < at[now]) & (j < bt[now]), (i >= (at + n)[now]) & (j >= (bt + n)[now])
        todo, of, g = around(todo[some], at, bt, n), np.tile(of[some], 2), now + np.where(right, len(some), 0)
        kept = np.flatnonzero(left | right)
        kept = kept[np.argsort(g[kept], kind="stable")]
        g, i, j = g[kept], i[kept], j[kept]
    return total


class Bank:
    """A block of known messages with inverted indexes of their words and runs of three characters.

    The indexes give what a message shares with every row at once. Matching blocks follow one another in both
    texts, so a longest common subsequence bounds them: that of all rows at once, with their places as bits of one
    number. The ratio itself is worked out only for rows whose bound reaches the k best so far, for many messages at once.
    """

    def __init__(self, ids: list, texts: list[str | None], ignored: frozenset[str]):
        rows = sorted(zip(ids, texts), key=lambda r: r[0])
        self.ids, self.ignored = [i for i, _ in rows], ignored
        self.known = [Message(t, ignored) for _, t in rows]
        self.index = [self.inverted([m.words for m in self.known]), self.inverted([m.grams for m in self.known])]
        self.sizes = [np.array([len(x) for x in sets]) for sets in ([m.words for m in self.known], [m.grams for m in self.known])]
        self.length = np.array([len(m.text) for m in self.known])
        self.rare = self.length >= 200
        # rows with rare seeds come last; behind a row's characters a place stays empty, where a carry ends
        self.order = np.argsort(self.rare, kind="stable")
        self.start = np.empty(len(rows), np.int64)
        self.start[self.order] = np.concatenate([[0], np.cumsum(self.length[self.order] + 1)])[:-1]
        self.chars = chars = np.frombuffer("\0".join([*(self.known[r].text for r in self.order), ""]).encode("ascii"), np.uint8)
        bits = lambda on: int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")
        self.places, self.all = len(chars), bits(chars != 0)
        self.dense = self.all & ((1 << int((self.length + 1)[~self.rare].sum())) - 1)
        self.where = {chr(c): bits(chars == c) for c in np.unique(chars) if c}
        # a row of 200 characters or more is not searched by those that are over a hundredth of it, as SequenceMatcher has it
        seeds = chars.copy()
        for a, n in zip(self.start[self.rare].tolist(), self.length[self.rare].tolist()):
            row = seeds[a : a + n]
            row[np.bincount(row, minlength=256)[row] > n // 100 + 1] = 0
        self.seed_at = np.flatnonzero(seeds)
        self.seed_from = np.searchsorted(self.seed_at, self.start)
        self.seeds = np.searchsorted(self.seed_at, self.start + self.length) - self.seed_from

    @staticmethod
    def inverted(sets: list[set[str]]) -> dict[str, np.ndarray]:
        index: dict[str, list[int]] = {}
        for row, items in enumerate(sets):
            for x in items:
                index.setdefault(x, []).append(row)
        return {x: np.array(rows) for x, rows in index.items()}

    def shared(self, which: int, items: set[str]) -> np.ndarray:
        index = self.index[which]
        lists = [index[x] for x in items if x in index]
        return np.bincount(np.concatenate(lists), minlength=len(self.ids)) if lists else np.zeros(len(self.ids), np.int64)

    def common(self, text: str, dense: bool = False) -> np.ndarray:
        """The length of the longest common subsequence of the text and each row, or only of rows under 200 characters."""
        free = every = self.dense if dense else self.all
        for c in text:
            if hit := free & self.where.get(c, 0):
                free = (free + hit | free ^ hit) & every
        taken = np.unpackbits(np.frombuffer((every ^ free).to_bytes(-(-self.places // 8), "little"), np.uint8), bitorder="little")
        out = np.empty(len(self.ids), np.int64)
        out[self.order] = np.add.reduceat(taken, self.start[self.order], dtype=np.int64)
        return out

    def bounds(self, own: Message) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each row gets without the ratio, what the ratio can't exceed, and what one text inside the other may add.

        The ratio of a row with rare seeds isn't bounded, as it is cheap.
        """
        words, grams = self.shared(0, own.words), self.shared(1, own.grams)
        alike = lambda n, size, m: n / np.maximum(1, size + m - n)
        sure = TOKENS * alike(words, self.sizes[0], len(own.words)) + COVERAGE * words / max(1, len(own.words)) + GRAMS * alike(grams, self.sizes[1], len(own.grams))
        ratio = np.where(self.rare, 1.0, 2 * self.common(own.text, True) / np.maximum(1, self.length + len(own.text)))
        least = np.minimum(self.sizes[1], len(own.grams))
        return sure, ratio, np.where((grams == least) | (least <= 1), 1.0, 0.0)

    def ratios(self, asked: list[tuple[Message, int]]) -> np.ndarray:
        """SequenceMatcher's ratio of each message and row."""
        size = np.array([len(m.text) for m, _ in asked])
        row = np.array([r for _, r in asked], np.int64)
        out = np.zeros(len(asked))
        far = size * self.length[row] > LONG
        for x in np.flatnonzero(far):
            out[x] = SequenceMatcher(None, asked[x][0].text, self.known[row[x]].text).ratio()
        if len(near := np.flatnonzero(~far)):
            own = {id(asked[x][0]): asked[x][0].text for x in near}
            place = {m: k for k, m in enumerate(own)}
            start = len(self.chars) + np.cumsum([0, *map(len, own.values())])
            texts = np.concatenate([self.chars, np.frombuffer("".join(own.values()).encode("ascii"), np.uint8)])
            m, r = np.array([place[id(asked[x][0])] for x in near]), row[near]
            pairs = np.stack([start[m], start[m + 1], self.start[r], self.start[r] + self.length[r]], axis=1)
            few = self.rare[r]
            common = np.zeros(len(near), np.int64)
            common[~few] = matched(texts, pairs[~few])
            common[few] = self.matched_few(texts, start, m[few], r[few], pairs[few])
            out[near] = 2.0 * common / (size[near] + self.length[r])
        return out

    def matched_few(self, texts: np.ndarray, start: np.ndarray, m: np.ndarray, r: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """matched() for rows r with rare seeds and messages m, which start there in texts; as many pairs at a time as CELLS allows."""
        kind = np.repeat(np.arange(len(start) - 1), np.diff(start)) * 256 + texts[start[0] :]  # message and character
        at, many = start[0] + np.argsort(kind, kind="stable"), np.bincount(kind, minlength=256 * len(start))
        first = np.cumsum(many) - many
        which, place = spread(self.seeds[r])
        j = self.seed_at[self.seed_from[r][which] + place]
        same = m[which] * 256 + texts[j]
        places = np.cumsum(np.bincount(which, many[same], len(r))) // CELLS
        out = np.zeros(len(r), np.int64)
        for part in np.unique(places):
            a, z = np.searchsorted(places, [part, part + 1])
            seeds = slice(*np.searchsorted(which, [a, z]))
            of, nth = spread(many[same[seeds]])
            out[a:z] = matched_by_seeds(texts, pairs[a:z], which[seeds][of] - a, at[first[same[seeds]][of] + nth], j[seeds][of])
        return out

    def best_of(self, texts: list[str | None], k: int) -> list[list[tuple[float, int]]]:
        """(likeness, row) of the k likest rows of each text, the least id first among equal ones."""
        own = [Message(t, self.ignored) for t in texts]
        asked = [q for q, m in enumerate(own) if m.text]
        # first the ratios that are cheap, then those of the rows whose bound reaches the k best so far
        cheap = np.flatnonzero(self.rare)
        known = np.full((len(own), len(self.ids)), np.nan)
        if len(asked) and len(cheap):
            known[np.ix_(asked, cheap)] = self.ratios([(own[q], r) for q in asked for r in cheap.tolist()]).reshape(-1, len(cheap))
        sure, most, order = {}, {}, {}
        for q in asked:
            sure[q], ratio, inside = self.bounds(own[q])
            most[q] = np.where(self.length > 0, sure[q] + RATIO * np.where(np.isnan(known[q]), ratio, known[q]) + inside + 1e-4, 0.0)
            order[q] = np.argsort(-most[q], kind="stable")
        best: list[list[tuple[float, int]]] = [[] for _ in own]
        done, step = [0] * len(own), k
        while True:
            todo, step = [], 4 * step
            for q in asked:
                floor = -best[q][-1][0] if len(best[q]) == k else 0.0
                rows = order[q][done[q] : done[q] + step]
                rows = rows[(most[q][rows] >= floor) & (most[q][rows] > 0)].tolist()
                done[q] += len(rows)
                todo += [(q, r) for r in rows]
            if not todo:
                return [[(-s, row) for s, row in b if s < 0] for b in best]
            if new := [(q, r) for q, r in todo if np.isnan(known[q, r])]:
                known[tuple(zip(*new))] = self.ratios([(own[q], r) for q, r in new])
            for q, row in todo:
                score = round(finished(own[q], self.known[row], float(sure[q][row]) + RATIO * float(known[q, row])), 4)
                best[q] = sorted([*best[q], (-score, row)])[:k]

    def best(self, text: str | None, k: int) -> list[tuple[float, int]]:
        return self.best_of([text], k)[0]


def bank_matches(messages: DataFrame, bank: DataFrame, k: int = 5, ignored: frozenset[str] = frozenset()) -> DataFrame:
    """(message_id, bank_id, likeness, rank): the k likest rows of the bank (bank_id, text) for each message (message_id, text).

    Both sides are dealt into blocks of a bounded size, each pair of blocks is one task's work, and
    the best k of a message are merged over the bank's blocks; neither side passes the driver. A message
    or row without text is like nothing.
    """
    size = lambda df: df.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 50)).head()[0] or 0
    # the cells are what there is to do at a time: some for each core, however small the tables are, as two may fall to one task
    across, down = max(3 * messages.sparkSession.sparkContext.defaultParallelism, -(-size(messages) // MESSAGE_BYTES)), max(1, -(-size(bank) // BANK_BYTES))
    ship(messages.sparkSession)
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = messages.select("message_id", "text", F.pmod(F.xxhash64("message_id"), F.lit(across)).cast("int").alias("s"), all_(down).alias("b"))
    right = bank.select("bank_id", "text", all_(across).alias("s"), F.pmod(F.xxhash64("bank_id"), F.lit(down)).cast("int").alias("b"))
    kind = T.StructType([messages.schema["message_id"], bank.schema["bank_id"], T.StructField("likeness", T.DoubleType())])

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if known.num_rows:
            block = Bank(known["bank_id"].to_pylist(), known["text"].to_pylist(), ignored)
            names, texts = asked["message_id"].to_pylist(), asked["text"].to_pylist()
            step = max(1, min(TOGETHER, PAIRS // known.num_rows))
            for a in range(0, len(names), step):
                for name, rows in zip(names[a : a + step], block.best_of(texts[a : a + step], k)):
                    for score, row in rows:
                        for c, v in zip(out, (name, block.ids[row], score)):
                            c.append(v)
        types = (asked.schema.field("message_id").type, known.schema.field("bank_id").type, pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["message_id", "bank_id", "likeness"])

    # a number of its own keeps small cells from being put into one task
    dealt = lambda df: df.repartition(2 * across * down, "s", "b").groupBy("s", "b")
    met = dealt(left).cogroup(dealt(right)).applyInArrow(run, kind)
    return latest(met, ["message_id"], [F.desc("likeness"), F.asc("bank_id")], k).select("message_id", "bank_id", "likeness", F.col("rn").cast("long").alias("rank"))
