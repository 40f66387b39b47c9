"""Phrases whose words keep together, counted on a weighted de Bruijn graph of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.llm.common import documents, mix, slices, utf8
from lumenary.runtime import checkpointed, scratch, ship

#: Words that a task turns into edges before it hands them on, and of one part of a text (HELD + PART < 2 ** 21, so
#: three numbers of words fit a key of 63 bits); rows of a batch.
HELD, PART, BATCH = 1_500_000, 500_000, 1 << 16
#: In place of a word: the piece ends before it.
END = 0
#: Kinds of the graph's rows: two words with one key, a language, a word, a node (two words), an edge (three).
CLASH, LANGUAGE, WORD, NODE, EDGE = -1, 0, 1, 2, 3
#: Documents (about) that show which words and nodes to split, the least share of edges of one, the parts of a word's and of a node's edges.
SHOWN, SHARE, SPLIT_WORD, SPLIT_NODE = 2_000, 20_000, 256, 4096

_CUT = b"\xff"  # stands in no UTF-8 text
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _CUT * 10)
_EDGES = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "k3", "n")), ("h", pa.int32()), ("w", pa.binary())])
_GRAPH = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("k1", "k2", "k3", "n", "top")), ("lang", pa.string()), ("word", pa.string())])


def words_of(raw: bytes) -> list[bytes]:
    """The lower-cased words, and _CUT between pieces."""
    return raw.translate(_TABLE).replace(_CUT, b" \xff ").split()


def key_of(name: bytes, seed: int) -> int:
    """A signed 64-bit key of a language's word, never END."""
    return int(np.uint64(xxhash.xxh64_intdigest(name, seed) or 1).view(np.int64))


class Numbers(dict):
    """One language's words to the numbers that all languages of a task share; -1 for a cut."""

    def __init__(self, lang: str, names: list[bytes]):
        super().__init__({_CUT: -1})
        self.lang, self.names = lang.encode() + _CUT, names

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(self.lang + word)
        return n


def packed_edges(flat: list[int], again: list[int]) -> np.ndarray:
    """A key for the edge that each word begins: three numbers plus one, 0 after a piece's end (-1)."""
    x = np.array([*flat, -1, -1], np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    c = np.where(b < 0, -1, c)
    on = a >= 0
    on[again] = False
    return a[on] + 1 << 42 | b[on] + 1 << 21 | c[on] + 1


def node_code(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return (mix(k1.view(np.uint64)) ^ k2.view(np.uint64)).view(np.int64)


def found_in(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def edges(docs: DataFrame, seed: int, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(k1, k2, k3, n, h, w): how often three words follow each other within a piece, added up by each task.

    An edge goes from the node (k1, k2) to the node (k2, k3). Each occurrence of a word begins one
    edge: near a piece's end k3, or k2 and k3, are END. The edge of a word alone carries its language and
    text in w; languages have rows of their own from END. Edges of a hot word are in several parts h by their
    node, those of a hot node by their last word; h is 0 for all others.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(np.sort(x) for x in hot)) if hot else None

    def run(batches):
        names: list[bytes] = []
        numbers: dict[str, Numbers] = {}
        flat: list[int] = []
        again: list[int] = []  # places of words that the next part of a text begins with
        lengths: dict[str, int] = {}

        def hand_on():
            own = np.arange(1, len(names) + 1, dtype=np.int64) << 42  # a word by itself, for its text
            packed, n = np.unique(np.concatenate([packed_edges(flat, again), own]), return_counts=True)
            key, mask = np.array([END, *(key_of(w, seed) for w in names)], np.int64), (1 << 21) - 1
            a, b, c = packed >> 42, packed >> 21 & mask, packed & mask
            alone = packed & (1 << 42) - 1 == 0
            n = n - alone
            h = np.zeros(len(packed), np.int32)
            if sent:
                words, nodes = sent.value
                rows = np.flatnonzero(found_in(key, words)[a])
                h[rows] = 1 + mix(key[b[rows]].view(np.uint64)) % SPLIT_WORD
                rows = rows[found_in(node_code(key[a[rows]], key[b[rows]]), nodes)]
                h[rows] = 1 + SPLIT_WORD + mix(key[c[rows]].view(np.uint64)) % SPLIT_NODE
            for at in range(0, len(packed), BATCH):
                x = slice(at, at + BATCH)
                w = [names[k - 1] if one else None for k, one in zip(a[x].tolist(), alone[x].tolist())]
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (key[a[x]], key[b[x]], key[c[x]], n[x].astype(np.int64), h[x])), pa.array(w, pa.binary())], schema=_EDGES)
            rows = [(END, key_of(lang.encode(), seed), END, m, m % SPLIT_WORD, lang.encode()) for lang, m in lengths.items()]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _EDGES)], schema=_EDGES)
            names.clear(), numbers.clear(), flat.clear(), again.clear(), lengths.clear()

        for part in slices(batches):
            for lang, raw in zip(part.column("lang").to_pylist(), utf8(part)):
                words = words_of(raw)
                for a in range(0, len(words), PART):
                    if (own := numbers.get(lang)) is None:
                        own = numbers[lang] = Numbers(lang, names)
                    some = words[a : a + PART + 2]
                    flat += map(own.__getitem__, some)
                    lengths[lang] = lengths.get(lang, 0) + len(some[:PART]) - some[:PART].count(_CUT)
                    again += range(len(flat) - min(2, max(0, len(words) - a - PART)), len(flat))
                    flat.append(-1)
                    if len(flat) > HELD:
                        yield from hand_on()
        if lengths:
            yield from hand_on()

    return docs.mapInArrow(run, "k1 long not null, k2 long not null, k3 long not null, n long not null, h int not null, w binary")


class Fold:
    """Sums (or greatest values) of runs of equal keys in sorted batches; the last run stays open for the next batch."""

    def __init__(self, *by: np.ufunc):
        self.by, self.open = by, None

    def add(self, keys: list[np.ndarray], values: list[np.ndarray], last: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The runs that are over."""
        if self.open:
            keys = [np.concatenate(x) for x in zip(self.open[0], keys)]
            values = [np.concatenate(x) for x in zip(self.open[1], values)]
        if len(keys[0]):
            first = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            keys, values = [k[first] for k in keys], [f.reduceat(v, first) for f, v in zip(self.by, values)]
        if last or not len(keys[0]):
            self.open = None
            return keys, values
        self.open = [k[-1:] for k in keys], [v[-1:] for v in values]
        return [k[:-1] for k in keys], [v[:-1] for v in values]


def graph(docs: DataFrame, seed: int, least: int, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Rows (kind, k1, k2, k3, n, top, lang, word) of the phrases of one to three words that occur least times.

    Only the longest edges are counted and shuffled, once, by their first word. A node's count is its
    outgoing flow with what ends at a piece's end; a word's is that of the nodes it begins, with the same
    correction. top is a node's largest edge: one that is its whole flow makes the node a link of a unary path.
    A task reads its edges in order and holds one open edge, node and word. Hot words and nodes come in parts.
    """

    def run(batches):
        edge, node, word = Fold(np.add, np.maximum), Fold(np.add, np.maximum, np.maximum), Fold(np.add, np.maximum)
        texts: dict[int, bytes] = {}
        languages: dict[int, str] = {}
        clashes: list[int] = []

        def rows(kind, keys, values, lang=None, name=None):
            n = len(keys[0])
            full = [*keys, *(np.zeros(n, np.int64) for _ in range(3 - len(keys)))]
            cols = [pa.array(np.full(n, kind), pa.int32()), *(pa.array(x) for x in (*full, *values))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(lang or [None] * n, pa.string()), pa.array(name or [None] * n, pa.string())], schema=_GRAPH)

        def read(parts, last):
            k1, k2, k3, n, h = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in range(5)) if parts else (np.zeros(0, np.int64),) * 5
            for p in parts:
                named = p.filter(pc.is_valid(p.column(5)))
                for a, b, w in zip(*(named.column(c).to_pylist() for c in (0, 1, 5))):
                    if a == END:
                        languages[b] = w.decode()
                    elif texts.setdefault(a, w) != w:
                        clashes.append(a)
            (k1, k2, k3), (n, h) = edge.add([k1, k2, k3], [n, h], last)
            of = k1 == END
            yield rows(LANGUAGE, [k1[of], k2[of]], [n[of], n[of]], [languages[k] for k in k2[of].tolist()])
            k1, k2, k3, n, h = (x[~of] for x in (k1, k2, k3, n, h))
            on = (n >= least) & (k3 != END)
            yield rows(EDGE, [k1[on], k2[on], k3[on]], [n[on], n[on]])
            (k1, k2), (n, top, h) = node.add([k1, k2], [n, np.where(k3 != END, n, 0), h], last)
            on = ((n >= least) | (h > SPLIT_WORD)) & (k2 != END)
            yield rows(NODE, [k1[on], k2[on]], [n[on], top[on]])
            (k1,), (n, h) = word.add([k1], [n, h], last)
            on = (n >= least) | (h > 0)
            own = [texts.get(k, _CUT).split(_CUT) for k in k1[on].tolist()]
            yield rows(WORD, [k1[on]], [n[on], n[on]], [x.decode() or None for x, _ in own], [x.decode() or None for _, x in own])
            for k in k1.tolist():
                texts.pop(k, None)
            if last and clashes:
                yield rows(CLASH, [np.array(clashes)], [np.array(clashes)] * 2)

        held, size = [], 0
        for part in batches:
            held.append(part)
            size += part.num_rows
            if size >= BATCH:
                yield from read(held, False)
                held, size = [], 0
        yield from read(held, True)

    dealt = edges(docs, seed, hot).repartition("k1", "h").sortWithinPartitions("k1", "k2", "k3")
    return dealt.mapInArrow(run, "kind int, k1 long, k2 long, k3 long, n long, top long, lang string, word string")


def hot_keys(docs: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and codes of nodes that hold over a SHARE-th of the edges of some documents: at most SHARE of each.

    They only tell how edges are dealt to tasks; no count depends on them.
    """
    e = edges(docs.sample(min(1.0, SHOWN / max(1, docs.count())), 1), seed).where(F.col("k1") != END)
    e = checkpointed(e.groupBy("k1", "k2").agg(F.count("*").alias("n")))
    total = e.agg(F.sum("n")).head()[0] or 0
    often = lambda df: df.where((F.col("n") * SHARE > total) & (F.col("n") > 1)).collect()
    words = np.array([r.k1 for r in often(e.groupBy("k1").agg(F.sum("n").alias("n")))], np.int64)
    nodes = [(r.k1, r.k2) for r in often(e)]
    return words, node_code(*(np.array(x, np.int64) for x in zip(*nodes))) if nodes else np.zeros(0, np.int64)


def score(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)), exact in decimals of 38 digits."""
    big = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    return F.expr(f"CAST(1000000 * {big(a)} * {big(a)} AS DECIMAL(38, 0)) div ({big(left)} * {big(right)})")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, inside: int = 50, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the best phrases of two and three words.

    A phrase's score is the lowest over its cuts of 1000000 a a / (l r), floored. A phrase of two words goes if one of
    three words that has it inside has at least `inside` percent of its occurrences. Words without a
    language are `und`. A node whose whole flow is one edge is such a case: it is compacted into that
    edge (a link of a unary path), whose count is its own.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    folder, seed = scratch(spark, "phrases"), 0
    while True:  # until no two words share a key: the first seed, but for one time in millions
        graph(docs, seed, least, hot_keys(docs, seed)).write.parquet(f"{folder}/graph-{seed}")
        rows = spark.read.parquet(f"{folder}/graph-{seed}")
        if rows.where(F.col("kind") == CLASH).isEmpty():
            break
        seed += 1
    of = lambda kind: rows.where(F.col("kind") == kind)
    words = of(WORD).groupBy("k1").agg(F.sum("n").alias("f"), F.max("lang").alias("lang"), F.max("word").alias("word")).where(F.col("f") >= least)
    pair = of(NODE).groupBy("k1", "k2").agg(F.sum("n").alias("a"), F.max("top").alias("top")).where(F.col("a") >= least)
    pair = pair.join(words.withColumnsRenamed({"f": "l", "word": "w1"}), "k1").join(words.select(F.col("k1").alias("k2"), F.col("f").alias("r"), F.col("word").alias("w2")), "k2")
    triple = of(EDGE).select("k1", "k2", "k3", F.col("n").alias("a"))

    entering = triple.groupBy(F.col("k2").alias("k1"), F.col("k3").alias("k2")).agg(F.max("a").alias("most"))
    longest = F.greatest(F.when(F.col("top") >= least, F.col("top")), F.col("most"))
    # a unary node has top = a
    branching = pair.join(entering, ["k1", "k2"], "left").where(F.coalesce(100 * longest < inside * F.col("a"), F.lit(True)))
    two = branching.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", score("a", "l", "r").alias("score"))

    left = pair.select("k1", "k2", "lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2"))
    right = pair.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    cut = triple.join(left, ["k1", "k2"]).join(right, ["k2", "k3"]).withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    by = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    three = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", by("l1", "l2").alias("l"), by("r1", "r2").alias("r"), by("s1", "s2").alias("score"))

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    total = of(LANGUAGE).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_graph(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of all documents.

    A null or empty text has no word; a document without a language counts as `und`; a repeated row counts again; equal
    scores and counts go by the phrase's bytes; other columns play no part; an empty table gives no rows; a
    text of any length is read whole.
    """
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x : x <> '') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i : array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), kept AS (
  SELECT * FROM c x WHERE NOT EXISTS (
    SELECT 1 FROM c y WHERE x.size = 2 AND y.size = 3 AND y.lang = x.lang AND (array_to_string(y.w[1:2], ' ') = x.phrase OR array_to_string(y.w[2:3], ' ') = x.phrase) AND 100 * y.a >= 50 * x.a)
), cut AS (
  SELECT lang, phrase, a, b, array_to_string(w[1:b], ' ') AS first, array_to_string(w[b + 1:size], ' ') AS rest FROM kept, (VALUES (1), (2)) AS s(b) WHERE b < size
), s AS (
  SELECT cut.lang, cut.phrase, a, b, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first AND x.k = b JOIN f y ON y.lang = cut.lang AND y.phrase = rest
), one AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, b) = 1
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one
)
SELECT r.lang, rank, phrase, a, l, r, t.n, score FROM r JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = r.lang WHERE rank <= 2000
"""
