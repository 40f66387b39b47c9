"""Links between texts of like shingle sets, for similarities that SimHash's radius doesn't reach."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import mix
from lumenary.runtime import checkpointed, ship

#: Bins of least hashes, and bands of ROWS bins by which texts meet: a pair of similarity 0.8
#: misses all bands with a chance of 1 in 5,000.
BINS, BANDS, ROWS = 256, 16, 4
#: Bytes of a shingle's hash in a set that is sent to others.
SET_BYTES = 6
#: Shingles whose places in the sets of a piece are laid out at once.
COLUMNS = 8192
#: Texts of a bucket that a task compares whole; larger buckets are held against their head and
#: cut into pieces of about PIECE rows a side. LEVELS: how often what is unlike a head gets another.
WHOLE, PIECE, LEVELS = 512, 256, 4


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash in each bin, all ones where a bin has none."""
    out = np.full(BINS, ~np.uint64(0))
    if len(hashes):
        h = np.sort(hashes)
        bin_ = (h & np.uint64(BINS - 1)).astype(np.int64)
        at, first = np.unique(bin_, return_index=True)  # the first of a bin is its least
        out[at] = h[first]
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of BANDS bands of a shingle set's least hashes by bin.

    An empty bin takes the nearest filled one to its right, marked by the distance, so that short
    texts meet as well.
    """
    low = minima(hashes)
    filled = low != ~np.uint64(0)
    dense = low
    if filled.any() and not filled.all():
        at = np.flatnonzero(filled)
        near = np.searchsorted(at, np.arange(BINS))
        pick = at[near % len(at)]
        gap = (pick - np.arange(BINS)) % BINS
        dense = mix(low[pick] + gap.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    used = dense[: BANDS * ROWS * (BINS // (BANDS * ROWS)) : BINS // (BANDS * ROWS)].reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = mix(key + used[:, k])
    return key


def packed_set(hashes: np.ndarray) -> bytes:
    """The distinct shingle hashes, sorted, SET_BYTES of each: sets of two texts are compared by so many."""
    low = np.unique(hashes & np.uint64((1 << 8 * SET_BYTES) - 1))
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]).tobytes()


def unpacked_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").reshape(-1)


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first left sets with all sets."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])[:left]
    out = np.zeros((left, len(sets)), np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1  # others are in no intersection but a set's with itself
    kept = often[column]
    row, column = row[kept], (np.cumsum(often) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, int(often.sum()) - start)), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        out += (has[:left] @ has.T).astype(np.int64)
    out[np.arange(left), np.arange(left)] = [len(s) for s in sets[:left]]
    return out


def jaccard(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Exact similarities of the first left sets to all sets."""
    size = np.array([len(s) for s in sets])
    both = overlaps(sets, left)
    return both / np.maximum(size[:left, None] + size[None, :] - both, 1)


def spanning(like: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever the true places of like (the first rows against all) connect."""
    group, out = np.arange(like.shape[1]), []
    for k in range(like.shape[0]):
        near = np.flatnonzero(like[k])
        roots, first = np.unique(group[near], return_index=True)
        for root, m in zip(roots.tolist(), near[first].tolist()):
            if root != group[k]:
                out.append((k, m))
                group[group == root] = group[k]
    return out


def groups(batches):
    """((band, key), left ids, ids, sets) of each (band, key, level, piece) of sorted rows, the left ones first."""
    held: list[tuple[bool, int, bytes]] = []
    last = None

    def one():
        ordered = sorted(held, key=lambda x: not x[0])
        return last[:2], sum(x[0] for x in ordered), [x[1] for x in ordered], [unpacked_set(x[2]) for x in ordered]

    for part in batches:
        for *name, left, id_, set_ in zip(*(part.column(c).to_pylist() for c in ("band", "key", "level", "piece", "left", "id", "hashes"))):
            if name != last:
                if held:
                    yield one()
                held, last = [], name
            held.append((left, id_, set_))
    if held:
        yield one()


def met(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (band, key, level, piece, left, id) with their sets, each piece in one task."""
    ship(rows.sparkSession)
    return rows.select("band", "key", "level", "piece", "left", "id").join(sets, "id").repartition("band", "key", "level", "piece").sortWithinPartitions("band", "key", "level", "piece")


def exact_links(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links of exact similarity least or more which connect what the left rows of each piece have such links to."""

    def match(batches):
        for _, left, ids, own in groups(batches):
            if left and len(ids) > 1:
                got = spanning(jaccard(own, left) >= least)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met(rows, sets).mapInArrow(match, "a long, b long").where("a <> b")


def headed(level: DataFrame, sets: DataFrame) -> DataFrame:
    """level's rows as (band, key, head, id, like): like is the exact similarity to the bucket's head.

    The head is sent to each piece of its bucket, so no piece grows with the bucket.
    """

    def match(batches):
        for (band, key), left, ids, own in groups(batches):
            like = jaccard(own, left)[0]
            n = len(ids) - left
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in ([band] * n, [key] * n, [ids[0]] * n, ids[left:])), pa.array(like[left:])], names=["band", "key", "head", "id", "like"])

    rows = level.select("band", "key", piece("id", "n").alias("piece"), F.lit(False).alias("left"), "id", "head")
    heads = rows.select("band", "key", "piece", F.lit(True).alias("left"), F.col("head").alias("id")).distinct()
    return met(rows.drop("head").unionByName(heads).withColumn("level", F.lit(0)), sets).mapInArrow(match, "band long, key long, head long, id long, like double")


def piece(id_: str, n: str) -> Column:
    return F.pmod(F.xxhash64(id_), F.ceil(F.col(n) / PIECE))


def blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (band, key, piece, left, id) in which every left row meets every right row of its (band, key)."""
    count = lambda df, n: df.groupBy("band", "key").agg(F.count("*").alias(n))
    sizes = count(left, "nl").join(count(right, "nr"), ["band", "key"])
    l, r = F.ceil(F.col("nl") / PIECE), F.ceil(F.col("nr") / PIECE)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    a = left.join(sizes, ["band", "key"]).select("band", "key", piece("id", "nl").alias("i"), r.alias("r"), upto(r).alias("j"), F.lit(True).alias("left"), "id")
    b = right.join(sizes, ["band", "key"]).select("band", "key", piece("id", "nr").alias("j"), r.alias("r"), upto(l).alias("i"), F.lit(False).alias("left"), "id")
    return a.unionByName(b).select("band", "key", (F.col("i") * F.col("r") + F.col("j")).alias("piece"), "left", "id")


def band_links(sketched: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """(a, b) of sketched (id long, bands array<long>), one row per distinct text: links between
    texts that share a band's key and whose sets have an exact similarity of least or more.

    sets(ids) gives (id, hashes binary), as packed_set() does. It is asked only for texts that meet
    another one.

    A bucket over WHOLE texts links all like its head to the head. What is unlike the head is a
    bucket of its own at the next level. Between the two, Jaccard distance being a metric, a text
    can be like one of the head's only within twice the distance of the head; those meet all of
    the head's in blocks. So no pair is left out but those that the head connects already, and a
    task holds about two PIECEs.
    """
    rows = sketched.select("id", F.posexplode("bands").alias("band", "key"))
    sized = lambda df: df.join(df.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1"), ["band", "key"])
    level = checkpointed(sized(rows))
    known = checkpointed(sets(level.select("id").distinct()))
    meets, links = [], []
    for k in range(LEVELS):
        meets.append(level.where(F.col("n") <= WHOLE).select("band", "key", F.lit(0).cast("long").alias("piece"), F.lit(True).alias("left"), "id", F.lit(k).alias("level")))
        large = level.where(F.col("n") > WHOLE)
        if not large.head(1):
            break
        if k == LEVELS - 1:
            meets.append(blocks(large, large).withColumn("level", F.lit(k)))
            break
        told = checkpointed(headed(large, known))
        near, far = told.where(F.col("like") >= least), told.where(F.col("like") < least)
        links.append(near.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
        meets.append(blocks(far.where(F.col("like") >= 2 * least - 1 - 1e-9), near).withColumn("level", F.lit(LEVELS + k)))
        level = checkpointed(sized(far.select("band", "key", "id")))
    links.append(exact_links(reduce(DataFrame.unionByName, meets), known, least))
    return reduce(DataFrame.unionByName, links).distinct()
