"""SimHash near-duplicates: covering masks find every pair of fingerprints within a radius."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import documents, map_slices, spaced, utf8
from lumenary.llm.components import components
from lumenary.llm.resemblance import band_keys, band_links, packed_set
from lumenary.runtime import checkpointed, ship

BITS, SEED = 64, 42
#: Distinct fingerprints of one bucket that a task compares at once; more are split by masks of
#: the bits that the bucket leaves open, with the same guarantee.
BUCKET = 512
LEVELS = 3


def shingle_bounds(words: bytes, size: int) -> tuple[list[int], list[int]]:
    """Start and end of each run of size words in words one space apart (of all, if fewer)."""
    if not words:
        return [], []
    gap = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    start, end = np.concatenate([[0], gap + 1]), np.append(gap, len(words))
    n = max(1, len(start) - size + 1)
    return start[:n].tolist(), end[len(end) - n :].tolist()


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of the words, A-Z in lower case, repeats included."""
    words = spaced(raw.lower())
    start, end = shingle_bounds(words, size)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(words[a:b], SEED) for a, b in zip(start, end)), np.uint64, len(start))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each list of hashes: the bits set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    place = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for k, h in enumerate(hashes):
        count = np.zeros(BITS, np.int64)
        for a in range(0, len(h), 1 << 16):
            count += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = place[2 * count > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): the 64-bit SimHash of each text's word shingles; 0 for no word."""

    def start():
        def step(part):
            return [part.column("doc_id"), majority([shingle_hashes(t, shingle) for t in utf8(part)]).view(np.int64)]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, fp long")


def covering_masks(free: int, radius: int, seed: int) -> list[int]:
    """Masks of the bits in free such that any set of radius bits misses one mask whole.

    Each free bit gets a nonzero vector of radius + 1 bits; mask v holds the bits whose vector
    has an odd product with v. Radius vectors leave some v orthogonal to all of them, so two
    values that differ in those bits alone agree under mask v.
    """
    rng = np.random.default_rng([seed, free >> 32, free & 0xFFFFFFFF])
    bits = [b for b in range(BITS) if free >> b & 1]
    size = (1 << (radius + 1)) - 1
    vector = rng.permutation(np.arange(len(bits)) % size + 1)  # each vector as often as any other
    return [sum(1 << b for b, x in zip(bits, vector.tolist()) if bin(x & v).count("1") & 1) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(values: DataFrame, radius: int, seed: int, level: int) -> DataFrame:
    """(table long, key long, fp): each value once per mask; at deeper levels within its bucket."""
    ship(values.sparkSession)

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for part in batches:
            fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            fixed = part.column("fixed").to_numpy(zero_copy_only=False).view(np.uint64)
            table = part.column("table").to_numpy(zero_copy_only=False)
            for f in np.unique(fixed).tolist():
                if f not in known:
                    known[f] = np.array(covering_masks(~f & (1 << 64) - 1, radius, seed + level), np.uint64)
                rows = np.flatnonzero(fixed == f)
                masks = known[f]
                for a in range(0, len(rows), 1 << 14):
                    r = rows[a : a + (1 << 14)]
                    all_ = (masks[None, :] | np.uint64(f)).repeat(len(r), axis=0)
                    key = fp[r][:, None] & all_
                    number = table[r][:, None] * 1000 + np.arange(1, len(masks) + 1)
                    n = len(masks)
                    columns = [number.reshape(-1), key.reshape(-1).view(np.int64), all_.reshape(-1).view(np.int64), np.repeat(fp[r], n).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["table", "key", "fixed", "fp"])

    return values.select("fp", "fixed", "table").mapInArrow(run, "table long, key long, fixed long, fp long")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within radius that connect whatever such links connect, at most one per value less one."""
    group, out = np.arange(len(values)), []
    for k in range(1, len(values)):
        near = np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= radius)
        for j in near.tolist():
            if group[j] != group[k]:
                group[group == group[k]] = group[j]
                out.append((j, k))
    return out


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of each (table, key) group; groups are small and are dealt out by key."""

    def run(batches):
        held: list[np.ndarray] = []
        last = None

        def emit(groups: list[np.ndarray]):
            size = np.array([len(g) for g in groups])
            two = [groups[k] for k in np.flatnonzero(size == 2).tolist()]
            out = [np.array(two, np.uint64).reshape(-1, 2)]
            out[0] = out[0][np.bitwise_count(out[0][:, 0] ^ out[0][:, 1]) <= radius]
            for k in np.flatnonzero(size > 2).tolist():
                at = np.array(forest(groups[k], radius), np.int64).reshape(-1, 2)
                out.append(groups[k][at])
            a = np.ascontiguousarray(np.concatenate(out)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for part in batches:
            table, key, fp = (part.column(c).to_numpy(zero_copy_only=False) for c in ("table", "key", "fp"))
            if not len(fp):
                continue
            cut = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            groups = np.split(fp.view(np.uint64), cut)
            if last == (table[0], key[0]):
                groups[0] = np.concatenate([*held, groups[0]])
            elif held:
                groups.insert(0, np.concatenate(held))
            last, held = (table[-1], key[-1]), [groups.pop()]
            if groups:
                yield emit(groups)
        if held:
            yield emit([np.concatenate(held)])

    return rows.select("table", "key", "fp").repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(run, "a long, b long")


def close_links(values: DataFrame, radius: int, seed: int = 7) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within radius.

    Every mask is a table of buckets. A bucket over BUCKET is keyed again by masks of its open
    bits; each level halves those, so after LEVELS a bucket holds few values whatever the data.
    """
    ship(values.sparkSession)
    level, out = values.select("fp", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("table")), None
    for k in range(LEVELS):
        rows = keyed(level, radius, seed, k)
        sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = rows.join(sizes, ["table", "key"])
        last = k == LEVELS - 1
        links = bucket_links(sized if last else sized.where(F.col("n") <= BUCKET), radius)
        out = links if out is None else out.unionByName(links)
        level = sized.where(F.col("n") > BUCKET).select("fp", "fixed", "table")
    return out.distinct()


def text_keys(raw: list[bytes]) -> np.ndarray:
    """A hash of each text's words, A-Z in lower case."""
    return np.array([xxhash.xxh3_64_intdigest(spaced(t.lower())) for t in raw], np.uint64).view(np.int64)


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id): documents linked by fingerprints at radius or fewer bits.

    component_id is the smallest id reachable. Equal fingerprints count as one value from the
    start, so copies never meet pairwise.
    """
    marked = checkpointed(fingerprints(docs, id_, text, shingle))
    owners = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = close_links(owners, radius)
    roots = components(links)
    classes = owners.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def resembling(docs: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents linked by fingerprints within radius or by like shingle sets.

    At a similarity of 0.8 two fingerprints differ in about ten bits, which no affordable set of
    covering masks reaches; such pairs meet by sketches of the shingle sets and are linked by the
    sets' exact Jaccard similarity. Equal texts count as one from the start.
    """

    def start():
        def step(part):
            raw = utf8(part)
            hashes = [shingle_hashes(t, shingle) for t in raw]
            bands = [band_keys(h).view(np.int64) for h in hashes]
            return [part.column("doc_id"), text_keys(raw), majority(hashes).view(np.int64), pa.array(bands, pa.list_(pa.int64()))]

        return step

    def start_sets():
        def step(part):
            raw = utf8(part)
            return [text_keys(raw), [packed_set(shingle_hashes(t, shingle)) for t in raw]]

        return step

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = checkpointed(map_slices(rows, start, "doc_id long, key long, fp long, bands longs"))
    classes = checkpointed(marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    texts = classes.where("first is not null").select(F.col("key").alias("id"), "first", "bands")

    def sets(ids: DataFrame) -> DataFrame:
        asked = texts.join(ids, "id", "left_semi").select(F.col("first").alias("doc_id"))
        own = map_slices(rows.join(asked, "doc_id", "left_semi"), start_sets, "id long, hashes binary")
        return own.join(ids, "id", "left_semi").dropDuplicates(["id"])

    like = band_links(texts.select("id", "bands"), sets, similarity)
    like = like.join(texts.select(F.col("id").alias("a"), F.col("first").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    owners = classes.groupBy("fp").agg(F.min("first").alias("owner"))
    near = close_links(owners, radius)
    named = owners.where("owner is not null")
    near = near.join(named.select(F.col("fp").alias("a"), F.col("owner").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("owner").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = classes.join(named, "fp").where("first <> owner").select(F.col("first").alias("a"), F.col("owner").alias("b"))
    roots = components(near.unionByName(equal).unionByName(like))
    known = classes.select("key", "first").join(roots.withColumnRenamed("node", "first"), "first", "left").select("key", F.coalesce("root", "first").alias("component_id"))
    return marked.select("doc_id", "key").join(known, "key").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_simhash_covering(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component.

    A text without words (null, empty) has fingerprint 0 and is linked like any other; repeated
    rows share one component; other columns play no part; an empty table gives no rows; a text of
    any length is read whole, and adds 64 bits to what is compared.
    """
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
