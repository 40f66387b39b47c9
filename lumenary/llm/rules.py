"""Quality rules: statistics of repeated and odd text, and an isolation forest over them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.llm.common import documents, map_slices, strings, table
from lumenary.operators.ranks import global_rank
from lumenary.runtime import checkpointed

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TREES, TREE_ROWS, SEED = 100, 256, 11
#: Share of rows labelled good that the threshold may reject.
LOSS = 0.01
#: Spans of scores in which the rows above a score are counted.
SPANS = 4096
MIN_WORDS, MAX_REPEAT = 50, 50


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    pair = code[:-1] * m + code[1:]
    if m < 1 << 20:
        triple = pair[:-1] * m + code[2:]
    else:  # over 60 bits: number the pairs first
        triple = np.unique(pair[:-1], return_inverse=True)[1] * m + code[2:]
    _, back, times = np.unique(triple, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[back] > 1)
    on = np.zeros(n, bool)
    for k in range(3):
        on[hit + k] = True
    return int(on.sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """COUNTS of one text."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    copies = 0
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                copies += 1
            elif line.strip(WHITE):
                seen.add(line)
    return len(words), chars, symbols, copies, repeat_words(words)


def counts(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id and COUNTS) of each text; a null text has none of anything."""

    def start():
        def step(part):
            rows = np.array([statistics(t) for t in strings(part)], np.int64).reshape(-1, len(COUNTS))
            return [part.column("doc_id"), *rows.T]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(n: np.ndarray) -> np.ndarray:
    """What the forest looks at: rates that don't depend on length."""
    words, chars, symbols, copies, repeats = n.astype(float)
    some = np.maximum(words, 1)
    return np.stack([np.log1p(chars / some), np.log1p(100 * symbols / np.maximum(chars, 1)), np.log1p(100 * copies / some), repeats / some], axis=1)


class IsolationForest:
    """Trees of random splits; a row's score is 2 to the power of less its mean depth by the usual one.

    rows are what is normal; space, if given, holds rows of all kinds. Splits are drawn over
    the box that space spans and not only over the rows at hand, so a value that no normal row
    has is isolated early even where normal rows are all alike. picks, if given, are the rows of each
    tree, drawn elsewhere.
    """

    def __init__(self, rows: np.ndarray, space: np.ndarray | None = None, trees: int = TREES, size: int = TREE_ROWS, seed: int = SEED, picks: list[np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        space = rows if space is None else space
        self.size = len(picks[0]) if picks else min(size, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        n = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, n), np.int64)
        self.split = np.full((trees, n), np.inf)  # leaves send all rows left, at no added depth
        self.path = np.zeros((trees, n))
        for t in range(trees):
            pick = picks[t] if picks else rows[rng.choice(len(rows), self.size, replace=False)]
            self._grow(t, 0, 0, pick, space.min(axis=0), space.max(axis=0), rng)

    @staticmethod
    def usual(n: int) -> float:
        """The mean depth of n rows in such a tree."""
        return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> None:
        wide = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(wide):
            self._leaf(t, node, depth, depth + self.usual(len(rows)))
            return
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.split[t, node] = f, cut
        left = rows[:, f] < cut
        below, above = high.copy(), low.copy()
        below[f] = above[f] = cut
        self._grow(t, 2 * node + 1, depth + 1, rows[left], low, below, rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], above, high, rng)

    def _leaf(self, t: int, node: int, depth: int, path: float) -> None:
        while True:
            self.path[t, node] = path
            if depth == self.depth:
                return
            node, depth = 2 * node + 1, depth + 1

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, higher the more anomalous."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for t in range(len(self.split)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[each, self.feature[t, node]] >= self.split[t, node])
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.split) / max(self.usual(self.size), 1e-9))


def base_failed(words, repeats):
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT * words)


def fit(measured: DataFrame, labels: DataFrame) -> tuple[IsolationForest | None, float]:
    """A forest over good labelled rows, and the score over which a row is an anomaly.

    All labelled rows that pass the base rules count. The forest grows on those of quality 1, so
    that it isolates what is rare there: each tree on TREE_ROWS of them, drawn by their places
    among all, in the box that all labelled rows span. The threshold comes from scores of rows that no
    tree has seen: of each half of the rows (by crc32 of the id) under a forest grown on the other half.
    Of the thresholds that lose at most LOSS of the good rows the one is taken that tells the
    two labels apart best. Without good rows in both halves and bad ones to hold against, nothing is an anomaly.
    """
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.join(pick, "doc_id").select("doc_id", "quality", *COUNTS).distinct().where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = rows.withColumns({"good": F.col("quality") == 1, "half": F.crc32(F.col("doc_id").cast("string")) % 2 == 0})
    rows = global_rank(rows, [F.desc("good"), F.asc("half"), F.asc("doc_id"), *COUNTS], "place")
    some, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    rates = (F.col("word_chars") / some, 100 * F.col("n_symbols") / chars, 100 * F.col("n_dup_lines") / some, F.col("n_repeat_words") / some)
    n = rows.agg(F.count_if(F.col("good") & ~F.col("half")), F.count_if(F.col("good") & F.col("half")), F.count_if(~F.col("good")), *(f(c) for f in (F.min, F.max) for c in rates)).head()
    first, second, bad = n[:3]
    if not first or not second or not bad:
        return None, 1.0
    # good rows have the first places, those outside the half before those in it; the rates' logarithms keep their order
    space = np.array(n[3:], float).reshape(2, 4)
    space[:, :3] = np.log1p(space[:, :3])
    rng = np.random.default_rng(SEED)
    drawn = [[low + 1 + rng.choice(size, min(TREE_ROWS, size), replace=False) for _ in range(TREES)] for low, size in ((0, first), (first, second), (0, first + second))]
    places = np.unique(np.concatenate([x for d in drawn for x in d]))
    wanted = measured.sparkSession.createDataFrame([(int(x),) for x in places], "place long")
    got = rows.join(F.broadcast(wanted), "place").select("place", *COUNTS).toPandas().sort_values("place")
    x = features(got[list(COUNTS)].to_numpy(np.int64).T)
    forests = [IsolationForest(x, space, picks=[x[np.searchsorted(places, p)] for p in d]) for d in drawn]
    return forests[2], threshold_of(unseen_scores(rows, *forests[:2]))


def unseen_scores(rows: DataFrame, outside: IsolationForest, inside: IsolationForest) -> DataFrame:
    """(score, good, bad): how many rows of each label have a score under the forest grown on the other half."""
    shared = rows.sparkSession.sparkContext.broadcast((outside, inside))

    def start():
        def step(part):
            x = features(np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in COUNTS]))
            half = part.column("half").to_numpy(zero_copy_only=False).astype(bool)
            score = np.zeros(len(x))
            for on, forest in zip((half, ~half), shared.value):
                score[on] = forest.score(x[on])
            return [score, part.column("good")]

        return step

    scored = map_slices(rows.select("half", "good", *COUNTS), start, "score double, good boolean", None)
    return checkpointed(scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))


def threshold_of(scores: DataFrame, loss: float = LOSS) -> float:
    """The score over which most bad rows and at most that share of the good ones lie; scores: (score, good, bad), each score once.

    Rows above a score are counted by spans of scores, and within a span in order, so no task sees all scores.
    """
    scores = scores.withColumn("span", F.floor(F.col("score") * SPANS))
    spans = scores.groupBy("span").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    sizes = sorted(spans.collect(), reverse=True)
    good, bad = sum(r.g for r in sizes), sum(r.b for r in sizes)
    before, g, b = [], 0, 0
    for r in sizes:
        before.append((r.span, g, b))
        g, b = g + r.g, b + r.b
    above = Window.partitionBy("span").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, rest: F.coalesce(F.sum(c).over(above), F.lit(0)) + F.col(rest)
    rows = scores.join(F.broadcast(scores.sparkSession.createDataFrame(before, "span long, g0 long, b0 long")), "span").withColumns({"g": over("good", "g0"), "b": over("bad", "b0")})
    # the least of the scores that lose few enough good rows is the good rows' quantile, or the next above it
    options = rows.where(F.col("g") < good - math.ceil((good - 1) * (1 - loss)))
    return options.agg(F.max_by("score", F.struct(F.col("b") * good - F.col("g") * bad, -F.col("score")))).head()[0]


def judge(measured: DataFrame, forest: IsolationForest | None, threshold: float) -> DataFrame:
    """measured with base_failed, kept boolean and anomaly double (null without a forest)."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def start():
        def step(part):
            n = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in COUNTS])
            failed = base_failed(n[0], n[4])
            score = shared.value.score(features(n)) if shared.value is not None else None
            odd = score > threshold if score is not None else np.zeros(len(failed), bool)
            return [*(part.column(c) for c in ("doc_id", *COUNTS)), failed, ~failed & ~odd, score if score is not None else [None] * len(failed)]

        return step

    return map_slices(measured.select("doc_id", *COUNTS), start, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double", None)


def op4_isolation_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdict.

    A null or empty text has no words and fails the base rules; a repeated row is judged again;
    other columns play no part; an empty table gives no rows; a text is measured whole, however
    long; a score at the threshold is no anomaly.
    """
    measured = checkpointed(counts(documents(spark, sf_dir)))
    forest, threshold = fit(measured, table(spark, sf_dir, "labels"))
    return judge(measured, forest, threshold)
