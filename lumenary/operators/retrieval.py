"""Lexical and vector retrieval for a table of queries over a table of chunks."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.functions import text as X
from lumenary.operators.ranks import rank_within
from lumenary.operators.sessions import latest
from lumenary.runtime import ship

#: Bytes of queries (vectors or terms) that are sent to all tasks at once.
BLOCK_BYTES = 8 << 20
#: Rows of each list that enter fusion.
TOP = 100
#: Rows that a task has at most before it hands them on, if all are wanted.
OUT_ROWS = 200_000
#: Pairs of vectors and queries that a task multiplies at once.
CELLS = 2_000_000
# What an exact match adds, and what a concept adds.
EXACT, ADDED = 1000, {"concept": 3}


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def normalised(df: DataFrame, column: str) -> DataFrame:
    """Vectors scaled to length one; a zero vector stays."""
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    return df.withColumn(column, F.when(norm > 0, F.transform(column, lambda x: x / norm)).otherwise(F.transform(column, lambda x: x.cast("double"))))


def blocks(queries: DataFrame) -> list[DataFrame]:
    """queries (query_id, query: a vector) in parts of about BLOCK_BYTES, each small enough to go to all tasks."""
    n = max(1, -(-(queries.agg(F.sum(F.size("query") * 8 + 40)).head()[0] or 0) // BLOCK_BYTES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)] if n > 1 else [queries]


def vector_matches(queries: DataFrame, vectors: DataFrame, k: int | None, least: float = 0.25) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest compatible vectors of each query, at least `least` alike.

    queries go to all tasks in blocks, each against all vectors, which are read once a block and
    never shuffled whole: a matrix product tells which pairs may count, those are summed in order, and each
    task hands on its k best of a query. Without k all such pairs come, unranked.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = T.StructType([queries.schema["query_id"], vectors.schema["vec_id"], T.StructField("similarity", T.DoubleType())])
    rows, parts = vectors.select("vec_id", "model", "embedding"), []
    for block in blocks(queries.select("query_id", "model", "query")):
        parts.append(rows.mapInArrow(nearest(spark.sparkContext.broadcast(block.toArrow()), k, least, CELLS), kind))
    pairs = reduce(DataFrame.unionByName, parts)
    if k is None:
        return pairs.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))
    return latest(pairs, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rn").cast("long").alias("rank"))


def by_model(part: pa.RecordBatch | pa.Table, id_: str, vector: str) -> dict:
    """{(model, length): (ids, matrix)} of the rows that have both; a vector with a null in it is like none."""
    found: dict = {}
    part = pa.Table.from_batches([part]) if isinstance(part, pa.RecordBatch) else part
    vectors, models = part.column(vector).combine_chunks(), part.column("model").to_numpy()
    size = pc.list_value_length(vectors)
    values = pc.list_flatten(vectors)
    nulls = np.zeros(len(vectors), bool)
    nulls[pc.filter(pc.list_parent_indices(vectors), values.is_null()).to_numpy()] = True
    nulls |= pc.is_null(vectors).to_numpy(zero_copy_only=False) | part.column("model").is_null().to_numpy()
    size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = values.to_numpy(zero_copy_only=False).astype(float), np.cumsum(size) - size
    for key in sorted({(m, n) for m, n, off in zip(models.tolist(), size.tolist(), nulls.tolist()) if not off}):
        on = np.flatnonzero(~nulls & (models == key[0]) & (size == key[1]))
        found[key] = part.column(id_).combine_chunks().take(pa.array(on)), flat[start[on][:, None] + np.arange(key[1])]
    return found


def in_order(a: np.ndarray, row: np.ndarray, b: np.ndarray, query: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Sums of products of rows of a and of b, added up from the first column on as dot() does."""
    total = np.zeros(len(row))
    for k in range(0, len(row), step):
        x, y, t = a[row[k : k + step]], b[query[k : k + step]], total[k : k + step]
        for c in range(a.shape[1]):
            t += x[:, c] * y[:, c]
    return total


def nearest(shared, k: int | None, least: float, cells: int) -> Callable:
    """A function of batches (vec_id, model, embedding) that gives (query_id, vec_id, similarity): with k, the k best of each query.

    A product of matrices may add up in another order, so what lies under a bound by less than its error is summed again.
    """

    def run(batches):
        asked = by_model(shared.value, "query_id", "query")
        best: dict = {key: (np.zeros(0, np.int64), pa.array([]), np.zeros(0)) for key in asked}
        floor = {key: np.full(len(ids), least) for key, (ids, _) in asked.items()}
        length = {key: np.sqrt((q * q).sum(axis=1)) for key, (_, q) in asked.items()}

        def told(key):
            query, ids, score = best[key]
            for a in range(0, len(query), OUT_ROWS):
                at = slice(a, a + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([asked[key][0].take(pa.array(query[at])), ids[at], pa.array(score[at])], names=["query_id", "vec_id", "similarity"])

        def met(key, ids, rows):
            queries = asked[key][1]
            # twice what a sum of so many rounded products can be off by
            error = 4 * key[1] * np.finfo(float).eps * np.sqrt((rows * rows).sum(axis=1))[:, None] * length[key]
            about = rows @ queries.T
            close = ~(about < floor[key] - error)
            if k is not None and len(rows) > k and close.sum() > 4 * k * len(queries):
                # that many of these rows are as near at least
                close &= ~(about < np.partition(about - error, len(rows) - k, axis=0)[len(rows) - k] - error)
            row, query = np.nonzero(close)
            score = in_order(rows, row, queries, query)
            on = ~(score < floor[key][query])
            row, query, score = row[on], query[on], score[on]
            query, score = np.concatenate([best[key][0], query]), np.concatenate([best[key][2], score])
            ids = pa.concat_arrays([best[key][1].cast(ids.type), ids.take(pa.array(row))])
            if k is not None:  # NaN counts as the greatest, as in Spark
                order = np.lexsort((ids.to_numpy(zero_copy_only=False), -np.where(np.isnan(score), np.inf, score), ~np.isnan(score), query))
                query, score = query[order], score[order]
                first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
                size = np.diff(np.r_[first, len(query)])
                full = first[size >= k]
                floor[key][query[full]] = np.maximum(least, score[full + k - 1])
                on = np.arange(len(query)) - np.repeat(first, size) < k
                query, score, ids = query[on], score[on], ids.take(pa.array(order[on]))
            best[key] = query, ids, score

        with np.errstate(invalid="ignore", over="ignore"):
            for part in batches:
                for key, (ids, rows) in by_model(part, "vec_id", "embedding").items():
                    if key not in asked:
                        continue
                    step = max(1, cells // len(asked[key][0]))
                    for a in range(0, len(rows), step):
                        met(key, ids[a : a + step], rows[a : a + step])
                        if k is None:
                            yield from told(key)
                            best[key] = best[key][0][:0], best[key][1][:0], best[key][2][:0]
            for key in best if k is not None else ():
                yield from told(key)

    return run


class Best:
    """The m best rows of each query among those put in so far: highest scores first, then least keys.

    Tasks fill it before anything is shuffled, and what several tasks keep is merged by the same order.
    A score below the m-th best of its query is turned away at once.
    """

    def __init__(self, queries: int, m: int):
        self.m, self.floor, self.waiting = m, np.full(queries, -np.inf), 0
        self.rows: list[tuple] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, key: tuple, query: np.ndarray, score: np.ndarray, exact: np.ndarray) -> None:
        on = score >= self.floor[query]
        if on.any():
            self.parts.append((query[on], score[on], np.full(int(on.sum()), len(self.rows)), exact[on]))
            self.rows.append(key)
            self.waiting += int(on.sum())
            if self.waiting > max(200_000, 4 * self.m * len(self.floor)):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Drop all but the m best of each query; what is left, by query and order."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        query, score, row, exact = (np.concatenate(x) for x in zip(*self.parts))
        order = sorted(range(len(self.rows)), key=self.rows.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[row], -score, query))
        query, score, row, exact = query[by], score[by], row[by], exact[by]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        size = np.diff(np.r_[first, len(query)])
        rank = np.arange(len(query)) - np.repeat(first, size)
        full = first[size >= self.m]
        self.floor[query[full]] = score[full + self.m - 1]
        on = rank < self.m
        used, row = np.unique(row[on], return_inverse=True)
        self.rows = [self.rows[r] for r in used.tolist()]
        self.parts, self.waiting = [(query[on], score[on], row, exact[on])], 0
        return self.parts[0]


def asked_terms(queries: DataFrame) -> DataFrame:
    """queries (query_id, query, topic, scope if any) as (query_id, terms, topic's key, scope, asks); what asks the same has one value of asks."""
    scope = F.col("scope") if "scope" in queries.columns else F.lit(None).cast("string").alias("scope")
    asked = queries.select("query_id", X.terms(F.concat_ws(" ", "topic", "query")).alias("terms"), X.normal_key(F.col("topic")).alias("topic"), scope)
    return asked.withColumn("asks", F.sha2(F.to_json(F.struct("terms", "topic", "scope")), 256))


def term_blocks(queries: DataFrame) -> list[tuple[list, list[list[str]], list, list]]:
    """What queries ask, each once, as blocks (asks, terms, topic keys, scopes) of about BLOCK_BYTES of text each."""
    asked = asked_terms(queries).dropDuplicates(["asks"])
    total = asked.agg(F.sum(F.length(F.concat_ws(" ", "terms")) + 40)).head()[0] or 0
    n = -(-total // BLOCK_BYTES)
    out = []
    for b in range(n):
        got = asked.where(F.pmod(F.xxhash64("asks"), F.lit(n)) == b).toArrow()
        out.append(tuple(got[c].to_pylist() for c in ("asks", "terms", "topic", "scope")))
    return out


def best_by_terms(queries: DataFrame, rows: DataFrame, columns: list[str], m: int | None, weights: Callable, keys: str | None = None, words: bool = False, scoped: bool = False) -> DataFrame:
    """(query_id, kind, id, score, exact, rank): the m best rows (kind, id, columns) of each query (query_id, query, topic), or all.

    A row's score is the sum over columns and the query's terms of weights(kind, column's number,
    occurrences without overlap, whether one stands as a word), 0 adds nothing; words: only rows that
    have a term as a word; scoped: only rows of the query's scope. With keys,
    a column of arrays, a row that has the query's topic among them is exact: EXACT more, whatever else
    it has. A kind of ADDED gets that more if it has any score or is exact. Queries of the same terms, topic and scope are
    answered once, and each gets the answer by a join at the end. Blocks of what is asked go to all
    tasks; texts are read once a block: a task keeps m rows for each. Without m a task hands on what it
    has whenever that is OUT_ROWS, and places are counted over ranges of the order.
    """
    spark = rows.sparkSession
    ship(spark)
    low = rows.select("kind", "id", *(F.lower(c).alias(f"c{k}") for k, c in enumerate(columns)), (F.col(keys) if keys else F.array().cast("array<string>")).alias("keys"), (F.col("scope") if scoped else F.lit(None).cast("string").alias("scope")))
    kind = T.StructType([T.StructField("asks", T.StringType()), T.StructField("kind", T.StringType()), rows.schema["id"], *T._parse_datatype_string("score double, exact boolean").fields])
    places, parts = len(columns), []
    for block in term_blocks(queries):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import ahocorasick

            ids, terms, topics, scopes = shared.value
            within = {s: np.array([x == s for x in scopes]) for s in set(scopes)} if scoped else {}
            nowhere = np.zeros(len(ids), bool)
            asking: dict[str, list[int]] = {}
            about: dict[str, list[int]] = {}
            for q, (own, topic) in enumerate(zip(terms, topics)):
                for t in own:
                    asking.setdefault(t, []).append(q)
                if topic:
                    about.setdefault(topic, []).append(q)
            machine = ahocorasick.Automaton()
            for t, q in asking.items():
                machine.add_word(t, (t, np.array(q)))
            machine.make_automaton()
            best, letters, types = Best(len(ids), m or sys.maxsize), set("abcdefghijklmnopqrstuvwxyz0123456789"), None

            def told():
                query, score, row, exact = best.cut()
                for a in range(0, len(query), 10_000):
                    at = slice(a, a + 10_000)
                    own = [best.rows[k] for k in row[at].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[q] for q in query[at].tolist()]), pa.array([k for k, _ in own], types[0]), pa.array([dict(zip(fields, i)) for _, i in own] if fields else [i for _, i in own], types[1]), pa.array(score[at]), pa.array(exact[at])], names=["asks", "kind", "id", "score", "exact"]
                    )

            for part in batches:
                types = [part.schema.field(c).type for c in ("kind", "id")]
                fields = [f.name for f in types[1]] if pa.types.is_struct(types[1]) else []
                cols = [part.column(c).to_pylist() for c in range(2, 2 + places)]
                for r, (kind_now, id_now, named, scope) in enumerate(zip(*(part.column(c).to_pylist() for c in ("kind", "id", "keys", "scope")))):
                    if scoped and scope not in within:
                        continue
                    if isinstance(id_now, dict):
                        id_now = tuple(id_now.values())
                    hit: list[np.ndarray] = []
                    gain: list[float] = []
                    seen: list[bool] = []
                    for place in range(places):
                        text = cols[place][r]
                        found: dict[str, list] = {}
                        for end, (t, q) in machine.iter(text) if text and asking else ():
                            at = end + 1 - len(t)
                            f = found.get(t)
                            if f is None:
                                f = found[t] = [0, False, 0, q]
                            if at >= f[2]:
                                f[0], f[2] = f[0] + 1, end + 1
                            if not f[1]:
                                f[1] = (at == 0 or text[at - 1] not in letters) and (end + 1 == len(text) or text[end + 1] not in letters)
                        for n, whole, _, q in found.values():
                            if w := weights(kind_now, place, n, whole):
                                seen.append(whole or not words)
                                hit.append(q)
                                gain.append(w)
                    exact = sorted({q for k in named or () for q in about.get(k, ())})
                    if not hit and not exact:
                        continue
                    hits, each = np.concatenate([*hit, np.zeros(0, np.int64)]), [len(q) for q in hit]
                    score = np.bincount(hits, np.repeat(gain, each), minlength=len(ids)).astype(float)  # without hits numpy counts in integers
                    if words:
                        score[np.bincount(hits, np.repeat(seen, each), minlength=len(ids)) == 0] = 0
                    if scoped:
                        score[~within.get(scope, nowhere)] = 0
                    is_exact = np.zeros(len(ids), bool)
                    is_exact[exact] = True
                    some = np.flatnonzero((score > 0) | is_exact)
                    best.put((kind_now, id_now), some, score[some] + ADDED.get(kind_now, 0) + EXACT * is_exact[some], is_exact[some])
                    if not m and best.waiting > OUT_ROWS:
                        yield from told()
                        best = Best(len(ids), sys.maxsize)
            if types:
                yield from told()

        parts.append(low.mapInArrow(run, kind))
    order = [F.desc("score"), F.asc("kind"), F.asc("id")]
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)
    ranked = latest(every, ["asks"], order, m, "rank") if m else rank_within(every, "asks", order)
    return asked_terms(queries).select("query_id", "asks").join(ranked, "asks").select("query_id", "kind", "id", "score", "exact", F.col("rank").cast("long").alias("rank"))


def shared_terms(kind: str, place: int, n: int, whole: bool) -> float:
    """Two for a term that a chunk has as a word and one for each occurrence; a concept's words don't count."""
    return n + 2 * (whole and kind == "chunk")


def lexical_best(queries: DataFrame, chunks: DataFrame, concepts: DataFrame, m: int = TOP) -> DataFrame:
    """(query_id, kind, id, lexical, exact, rank): the m best of chunks (id, text) and concepts (id, text, keys) together.

    queries have a topic (or null), whose terms count like the question's. A concept whose key (of id or title)
    is the topic is exact. Terms inside longer words count as well.
    """
    rows = chunks.select(F.lit("chunk").alias("kind"), "id", "text", F.lit(None).cast("array<string>").alias("keys")).unionByName(concepts.select(F.lit("concept").alias("kind"), "id", "text", "keys"))
    best = best_by_terms(queries, rows, ["text"], m, shared_terms, "keys")
    return best.select("query_id", "kind", "id", F.col("score").cast("long").alias("lexical"), "exact", "rank")


def lexical_scores(queries: DataFrame, chunks: DataFrame, m: int | None = None) -> DataFrame:
    """(query_id, chunk_id, lexical, rank): the chunks that share a whole term with the query, or the m best of them."""
    rows = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    best = best_by_terms(queries.withColumn("topic", F.lit(None).cast("string")), rows, ["text"], m, shared_terms, words=True)
    return best.select("query_id", F.col("id").alias("chunk_id"), F.col("score").cast("long").alias("lexical"), "rank")


def fused(lexical: DataFrame, semantic: DataFrame, k: float = 60.0) -> DataFrame:
    """(query_id, kind, id, exact, fused, position): reciprocal-rank fusion of two ranked lists (query_id, kind, id, rank).

    Exact rows of the lexical list come first, then the highest sums, then the least keys.
    """
    both = lexical.select("query_id", "kind", "id", "exact", "rank").unionByName(semantic.select("query_id", "kind", "id", F.lit(False).alias("exact"), "rank"))
    by = both.groupBy("query_id", "kind", "id").agg(F.max("exact").alias("exact"), F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("fused"))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("fused"), "kind", "id")
    return by.withColumn("position", F.row_number().over(order).cast("long"))


def packed(ranked: DataFrame, limit: int, most: int) -> DataFrame:
    """(query_id, position, kind, id, chars): blocks (n characters) in order, skipping what overflows; an oversized first one is cut.

    Twice the limit is looked at, so each query's fold is over few rows.
    """
    rows = ranked.where(F.col("position") <= 2 * limit).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "id", "n"))).alias("xs"))

    def put(acc: Column, x: Column) -> Column:
        full = F.size(acc["out"]) >= limit
        over = acc["sum"] + x["n"] > most
        take = F.when(over & (F.size(acc["out"]) == 0), F.lit(most).cast("long")).when(~over, x["n"].cast("long"))
        add = F.struct((acc["sum"] + take).alias("sum"), F.concat(acc["out"], F.array(F.struct(x["kind"].alias("kind"), x["id"].alias("id"), take.alias("chars")))).alias("out"))
        return F.when(full | take.isNull(), acc).otherwise(add)

    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<kind:string,id:bigint,chars:bigint>>").alias("out"))
    return rows.select("query_id", F.posexplode(F.aggregate("xs", zero, put, lambda a: a["out"])).alias("position", "x")).select("query_id", "position", "x.kind", "x.id", "x.chars")


def paragraph_scores(docs: DataFrame, keywords: list[str], top: int, fallback: int = 3) -> DataFrame:
    """The best paragraphs of each document: occurrences, ten times their density, marks of headings and formulas; the first ones where none scores."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "p")).where(F.trim("p") != "")
    low = F.lower("p")
    freq = sum((X.occurrences(low, F.lit(k)) for k in keywords), F.lit(0))
    words = F.greatest(F.size(F.filter(F.split(F.trim(low), r"\s+"), lambda w: w != "")), F.lit(1))
    mark = F.when(F.col("p").rlike(r"##|\*\*|Definition|General Formula"), 0.5).otherwise(0.0)
    formula = F.when(F.col("p").rlike("[₂₃₄ₙ⁺⁻]"), 0.3).otherwise(0.0)
    scored = p.select("doc_id", "no", (freq + freq / words * 10 + mark + formula).alias("score"))
    # a paragraph without a score is behind all others, so it comes only where no other does
    best = latest(scored, ["doc_id"], [F.desc("score"), F.asc("no")], max(top, fallback))
    most = Window.partitionBy("doc_id")
    best = best.withColumn("most", F.max("score").over(most)).where((F.col("score") > 0) & (F.col("rn") <= top) | (F.col("most") <= 0) & (F.col("rn") <= fallback))
    return best.select("doc_id", F.col("no").cast("long").alias("no"), F.round("score", 6).alias("score"))


# What a term adds that is found in the id, the title, the definition, the explanation, the key points.
CONCEPT_WEIGHTS = (8, 7, 4, 3, 1)


def keyword_concepts(queries: DataFrame, concepts: DataFrame, top: int) -> DataFrame:
    """Concepts by weighted hits of query terms in concept_id, title, definition, explanation and points."""
    columns = ["id", "title", "definition", "explanation", "points"]
    # concepts are short, so a file of many may be one task
    tasks = int(concepts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = concepts.select(F.lit("keyword").alias("kind"), F.col("concept_id").alias("id"), *columns[1:]).repartition(tasks, "id")
    best = best_by_terms(queries.withColumn("topic", F.lit(None).cast("string")), rows, columns, top, lambda kind, place, n, whole: CONCEPT_WEIGHTS[place])
    return best.select("query_id", F.col("id").alias("concept_id"), F.col("score").cast("long").alias("score"))


def overlap_pages(queries: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """The chunks of a query's chapter with the most distinct query terms, back in page order."""
    rows = chunks.select(F.lit("chunk").alias("kind"), F.struct(F.col("chunk_id"), F.col("page_start")).alias("id"), "text", F.col("chapter").alias("scope"))
    asked = queries.select("query_id", "query", F.lit(None).cast("string").alias("topic"), F.col("chapter").alias("scope"))
    best = best_by_terms(asked, rows, ["text"], top, lambda kind, place, n, whole: int(whole), scoped=True)
    order = Window.partitionBy("query_id").orderBy("id.page_start", "id.chunk_id")
    return best.select("query_id", "id.chunk_id", F.row_number().over(order).cast("long").alias("position"))


# What is only conversation; what goes on with the last turn, as a whole message, in front, or anywhere.
SMALL_TALK = ("hi", "hello", "hey", "thanks", "thank you", "thankyou", "ok", "okay", "got it", "clear", "great", "cool", "perfect", "yes", "no", "not now")
GOES_ON_WHOLE = ("why", "how", "why is that", "how does that work", "can you explain that", "one more example", "practice this", "test me on this", "quiz me on this")
GOES_ON_FIRST = ("this", "that", "it", "same", "again", "simpler", "more", "example", "what about", "explain again", "show me", "test me", "quiz me")
GOES_ON = (
    "explain it", "explain this", "explain that", "simplify it", "simplify this", "simpler words", "simple words", "another example", "more examples", "show another", "tell me more", "go deeper", "in short",
    "previous answer", "last answer", "same topic",
)
# An intent, its format, the declared intents that ask for it, what a message says that does; the first that holds counts.
INTENTS = (
    ("planning", "planning", ("planning", "plan"), ("study plan", "roadmap", "schedule", "what should i study")),
    ("exam", "exam_answer", ("exam", "exam_prep"), ("exam answer", "board answer", "marks", "important question")),
    ("revision", "revision", ("revision", "summary"), ("revise", "revision", "summary", "key points", "quick notes")),
    ("practice", "quiz", ("practice", "quiz", "mcq"), ("quiz me", "test me", "mcq", "practice question")),
    ("clarification", "stuck", (), ("confused", "stuck", "do not understand", "don't understand", "not getting")),
    ("comparison", "comparison", (), ("difference between", "compare", "differentiate", " versus ", " vs ")),
    ("numerical", "numerical", (), ("calculate", "find", "solve", "formula", "mass", "volume", "density")),
    ("definition", "definition", (), ("define", "what is", "what are", "meaning", "definition", "describe")),
)
NO_INTENT = ("", "general", "concept", "curiosity")
# What asks for the learner's own sources, and what may use them.
GROUNDED = (
    "from my notes", "from the notes", "from my material", "study material", "uploaded material", "uploaded notes", "selected chapter", "selected topic", "chapter data", "knowledge base", "according to my notes",
    "according to the notes", "according to ncert", "from ncert", "in ncert", "textbook says", "from the textbook", "use my notes", "check my notes", "check the chapter", "check the textbook", "use the chapter",
    "look in the notes", "verify from the notes", "latest syllabus", "current syllabus", "updated syllabus", "new syllabus", "latest notes", "updated notes", "latest study material",
)
OVERVIEWS = ("chapter overview", "lesson overview", "curriculum overview", "chapter recap")


def intents(messages: DataFrame) -> DataFrame:
    """messages (text, declared, has_history) with intent, format, retrieval_policy, is_follow_up and reasoning, by the first rule that holds.

    A null text is an empty one, which is conversation. A number and a word of calculation make a message numerical.
    """
    t = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    says = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))
    declared = F.lower(F.trim(F.coalesce("declared", F.lit(""))))
    talk = t.isin(*SMALL_TALK) | (F.length(t) <= 2)
    intent, form = F.when(talk, "conversation"), F.when(talk, "conversation")
    for name, shape, asked, phrases in INTENTS:
        hit = says(phrases) & t.rlike("[0-9]") if name == "numerical" else says(phrases)
        hit = declared.isin(*asked) | hit if asked else hit
        intent, form = intent.when(hit, name), form.when(hit, shape)
    intent = intent.otherwise(F.when(declared.isin(*NO_INTENT), "concept").otherwise(declared))
    policy = F.when(talk, "none").when(says(GROUNDED), "required").when(says(OVERVIEWS), "optional").otherwise("none")
    first = F.exists(F.array(*map(F.lit, GOES_ON_FIRST)), lambda p: (t == p) | F.startswith(t, F.concat(p, F.lit(" "))))
    follows = F.col("has_history") & (F.regexp_replace(t, "[?.!]+$", "").isin(*GOES_ON_WHOLE) | first | says(GOES_ON))
    reasoning = F.when(talk, "conversation").when(policy == "required", "source_grounded").when(follows, "contextual_reasoning").otherwise("general_reasoning")
    return messages.withColumns({"intent": intent, "format": form.otherwise("concept"), "retrieval_policy": policy, "is_follow_up": follows, "reasoning": reasoning})


def lesson_memory(turns: DataFrame, last: int = 6, corrected: int = 4) -> DataFrame:
    """Per conversation: its last turns, the latest question and its topic, and the last turns that say not or no."""
    wrong = F.contains(F.lower("text"), F.lit(" not ")) | F.contains(F.lower("text"), F.lit(" no "))
    rows = turns.withColumn("wrong", wrong)
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("turn")))
    rows = rows.withColumns({"rn": place("conv_id"), "mn": place("conv_id", "wrong")})
    user = F.when(F.col("role") == "user", F.col("turn"))
    kept = F.array_sort(F.collect_list(F.when(F.col("wrong") & (F.col("mn") <= corrected), F.col("turn"))))
    return rows.groupBy("conv_id").agg(
        F.count_if(F.col("rn") <= last).alias("window_turns"), F.min(F.when(F.col("rn") <= last, F.col("turn"))).alias("from_turn"), F.max(user).alias("open_doubt"),
        F.regexp_extract(F.lower(F.max_by("text", user)), "[a-z]{5,}", 0).alias("topic"), F.array_join(kept.cast("array<string>"), ",").alias("misconceptions"),
    )
