"""Periodic runs of words: stretches that repeat one block of words three times or more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import ARROW, documents, map_slices, utf8


def openings(word: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, lag, length): where the words just read have come before, at a lag that may become a run.

    word has a number for each word, -1 between documents. A run of period q repeats at least
    max(least - q, (times - 1) * q) of its words q places later, so a diagonal need not be followed
    before that many words agree. Windows of a power of two are named exactly, by pairs of
    names of half the size; those that occur once are let go. Of a window's earlier occurrences the
    nearest counts: were a further one the period of a run, the nearer one would be too (Fine and Wilf).
    A window of size s opens lags from s / 2 to s - 1, the smallest one all below its size.
    """
    if times < 3:
        raise ValueError("a run repeats its block three times at least")
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, max(2, least)))
    base = 1 << (shortest.bit_length() - 1)
    n, size, found = len(word), 1, []
    name = np.where(np.bincount(word + 1, minlength=1)[word + 1] > 1, word, -1) if n else word
    while True:
        at = np.flatnonzero(name[: max(0, n - size)] >= 0)
        at = at[name[at + size] >= 0]
        if not len(at):
            break
        _, group, count = np.unique(name[at] * n + name[at + size], return_inverse=True, return_counts=True)
        again = count[group] > 1
        at, group = at[again], group[again]
        name, size = np.full(n, -1), 2 * size
        name[at] = group
        if size < base:
            continue
        order = np.argsort(group, kind="stable")
        before = np.full(len(at), -1)
        same = group[order[1:]] == group[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        lag = np.where(before >= 0, at - before, 0)
        on = np.flatnonzero((lag >= (1 if size == base else size // 2)) & (lag < size))
        at, lag = at[on], lag[on]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
        found.append((at[first] + size - 1, lag[first], np.full(int(first.sum()), size)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    end, lag, length = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((lag, end))
    return end[order], lag[order], length[order]


def diagonals(word: list[int], opened: list[tuple[int, int, int]], least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one document, by start and period.

    Words are read in order. Each active lag holds how many words up to here agree with the word that
    lag earlier; a word that agrees adds one, one that doesn't ends the diagonal, and a diagonal that is
    long enough is a run at once. Between the last diagonal and the next opening no word is read.
    """
    active: dict[int, int] = {}
    runs: list[tuple[int, int, int]] = []
    n, k, i = len(word), 0, 0

    def end(lags, here):
        starts = set()  # of what ends here, shortest period first: a multiple is the same stretch
        for d in sorted(lags):
            m = active.pop(d)
            start = here - m - d
            if m + d >= max(least, times * d) and start not in starts:
                starts.add(start)
                runs.append((start, m + d, d))

    while active or k < len(opened):
        if not active:
            i = opened[k][0]
        if i == n:
            break
        c = word[i]
        if active:
            if ended := [d for d in active if word[i - d] != c]:
                end(ended, i)
            for d in active:
                active[d] += 1
        while k < len(opened) and opened[k][0] == i:
            _, d, length = opened[k]
            active.setdefault(d, length)
            k += 1
        i += 1
    end(list(active), n)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those of a run after its first block."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each text.

    A run is a stretch of words of smallest period q, of least words and times q at least, that
    can't be extended. collapsed has the words that aren't in a run after its first q words, one
    space apart. A null or text without a word has no run and an empty collapsed text.
    """

    def start():
        kind = ARROW["stretches"].value_type

        def step(part):
            known: dict[bytes, int] = {}
            split = [t.split() for t in utf8(part)]
            ids = [[known.setdefault(w, len(known)) for w in words] for words in split]
            flat = np.array([x for words in ids for x in (*words, -1)], np.int64)
            begin = np.cumsum([0, *(len(words) + 1 for words in ids)])
            end, lag, length = openings(flat, least, times)
            doc = np.searchsorted(begin, end, "right") - 1
            found: list[list] = [[] for _ in split]
            some, first = (x.tolist() for x in np.unique(doc, return_index=True))
            for d, a, b in zip(some, first, [*first[1:], len(doc)]):
                found[d] = diagonals(ids[d], list(zip((end[a:b] - begin[d]).tolist(), lag[a:b].tolist(), length[a:b].tolist())), least, times)
            rows = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(kind)))
            kept = [b" ".join(collapse(words, r)).decode() for words, r in zip(split, found)]
            return [part.column("doc_id"), [len(w) for w in split], runs, pa.array(kept, pa.string())]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, n_words long, runs stretches, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the id, run round a block of their own from some word on.

    With h = crc32(id) and g = h div 10, the words from number a = g % n on repeat the first
    1 + (n - a) div (3 + g % 8) of them.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x != '')")
    with_words = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n = F.when(F.size("words") > 0, F.size("words"))
    a = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    block = F.slice("words", a + 1, period)
    loop = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / period).cast("int"))), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), loop), " ")
    return with_words.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


def best_run(runs: Column) -> Column:
    """The run of greatest length / period; of equal ones the first by start, then period; null without one."""
    better = lambda r, b: b.isNull() | (r.length * b.period > b.length * r.period)
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, nothing, lambda b, r: F.when(better(r, b), r).otherwise(b))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every document, as digests, with the run of greatest exponent.

    A null or empty text, and any text without a run, has n_runs 0, four nulls and the digest of no
    runs; a repeated row is read again; other columns play no part; an empty table gives no rows; a text
    of any length is read whole, in time that grows with its words and the logarithm of their number.
    """
    found = periodic_runs(looped(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best_run(F.col("runs")).alias("best"), F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return one.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
