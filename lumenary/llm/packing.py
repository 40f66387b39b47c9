"""Packing of tokenised documents into sequences of bounded length, planned on a size histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.llm.common import documents, map_slices, strings
from lumenary.llm.wordbpe import WordBpe
from lumenary.runtime import checkpointed

#: Parts that the pieces of one size are ranked in, so that no task ranks all of them.
RANK_PARTS = 64
#: Pieces of one size that a part has on average at most; the parts are as many as that needs.
RANK_ROWS = 200_000


def pieces(docs: DataFrame, id_: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end: int = 0) -> DataFrame:
    """(row long, doc_id, piece, start, length, ids_crc32): a document's ids and end, cut at capacity.

    row tells repeated ids apart: it is the same whenever the same text is read again.
    """

    def start():
        bpe = WordBpe(tokenizer)

        def step(part):
            ids, cut = bpe.encode(strings(part))
            out = [[], [], [], [], [], []]
            for row, doc, a, b in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), cut.tolist(), cut[1:].tolist()):
                raw = ids[a:b].astype("<u4").tobytes() + end.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(raw) // 4, capacity)):
                    piece = raw[4 * at : 4 * (at + capacity)]
                    for c, v in zip(out, (row, doc, k, at, len(piece) // 4, zlib.crc32(piece))):
                        c.append(v)
            return out

        return step

    rows = docs.select(F.xxhash64(F.col(id_).cast("long"), F.col(text)).alias("row"), F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_slices(rows, start, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first rank, ranks, first sequence, offset) that place all items.

    Equal bins are handled as one group with a multiplicity, so the work depends on the
    distinct sizes and not on the number of items. Items above a third of the capacity fit at
    most twice in a bin: the largest is matched with the largest that still fits beside it.
    Smaller items, largest first, each go to the bin with the least gap that holds them.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to groups (first sequence, bins)
    order: list[int] = []  # gaps with groups, ascending

    def place(size: int, bins: int, first: int, offset: int) -> None:
        runs.append((size, used[size], bins, first, offset))
        used[size] += bins
        left[size] -= bins

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, bins))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        at = bisect_left(large, capacity - s + 1) - 1
        while at >= 0 and (not left[large[at]] or large[at] == s and left[s] < 2):
            if not left[large[at]]:
                large.pop(at)
            at -= 1
        if at < 0:
            bins, mate = left[s], 0
        else:
            mate = large[at]
            bins = left[s] // 2 if mate == s else min(left[s], left[mate])
        place(s, bins, sequences, 0)
        if mate:
            place(mate, bins, sequences, s)
        leave(capacity - s - mate, sequences, bins)
        sequences += bins
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                gap, first, bins = capacity, sequences, -(-left[s] // (capacity // s))
                sequences += bins
            else:
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            fit = gap // s
            whole = min(bins, left[s] // fit)
            for k in range(fit if whole else 0):
                place(s, whole, first, capacity - gap + k * s)
            leave(gap - fit * s, first, whole)
            rest = 0
            if whole < bins and left[s]:
                rest = min(left[s], fit - 1)
                for k in range(rest):
                    place(s, 1, first + whole, capacity - gap + k * s)
                leave(gap - rest * s, first + whole, 1)
            leave(gap, first + whole + bool(rest), bins - whole - bool(rest))
    return runs


def ranked(items: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """items with rank long: from 0 within each length, in the same order whenever it runs.

    A length may hold a third of all items: each is ranked in parts by a hash, and the parts'
    counts (lengths times parts rows) give where each part's ranks begin.
    """
    split = items.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    own = Window.partitionBy("length", "part").orderBy("row", "piece", "copy")
    counts = split.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return split.withColumn("k", F.row_number().over(own) - 1).join(begins, ["length", "part"]).withColumn("rank", F.col("begin") + F.col("k")).drop("part", "begin", "k")


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """items (row, piece, length, ...) with sequence_id and offset long; each length is 1 to capacity.

    Only the histogram of lengths, at most capacity rows, comes to the driver; the plan, which
    is bounded by the capacity as well, goes to all tasks.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    parts = max(RANK_PARTS, -(-max(counts.values(), default=0) // RANK_ROWS))
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    names = items.columns
    kinds = dict(items.dtypes)
    schema = ", ".join(f"{n} {'long' if kinds[n] == 'bigint' else kinds[n]}" for n in names) + ", sequence_id long, offset long"

    def start():
        size, first, bins, sequence, offset = table.value.T
        key = size << 44 | first

        def step(part):
            rank, length = (part.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "length"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            return [*(part.column(n) for n in names), sequence[at] + rank - first[at], offset[at]]

        return step

    return map_slices(ranked(items, parts), start, schema, column=None)


def op6_best_fit(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and the place of each in sequences of at most 2048 tokens.

    A null or empty text is one piece, the end id alone; a repeated row is packed again, with
    a place of its own; other columns play no part; an empty table gives no rows; only texts over
    2048 tokens are cut; pieces of one size are placed in the order of a hash of their document.
    """
    cut = checkpointed(with_copies(pieces(documents(spark, sf_dir))))
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def with_copies(items: DataFrame) -> DataFrame:
    """items with copy long, a number that tells equal rows apart (fixed once it is written)."""
    return items.withColumn("copy", F.monotonically_increasing_id())
