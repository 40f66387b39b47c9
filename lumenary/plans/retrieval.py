"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.operators import retrieval as R
from lumenary.plans.content import _KEY, _TERMS
from lumenary.plans.registry import query

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_VEC = f"""
    q AS (SELECT vec_id AS query_id, label % 2 AS model, embedding AS query FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, e.vec_id, {_DOT.format('embedding', 'query')} AS similarity FROM embeddings e JOIN q ON e.label % 2 = q.model),
    near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM s WHERE similarity >= 0.25)"""
_Q = "SELECT item_id AS query_id, text AS query FROM benchmark"
_OCC = "list_sum(list_transform(qt.terms, lambda t: CAST((LENGTH(low) - LENGTH(REPLACE(low, t, ''))) / LENGTH(t) AS INT)))"
_CONCEPT = "title || chr(10) || definition || chr(10) || explanation || chr(10) || points"
# every fourth item names a concept by its id as its topic, every fourth one by a title
_LEX = f"""
    q AS (SELECT *, {_TERMS.format("concat_ws(' ', topic, query)")} AS terms, {_KEY.format('topic')} AS key FROM (SELECT item_id AS query_id, text AS query, CASE item_id % 4 WHEN 0 THEN 'C' || CAST(item_id AS STRING) WHEN 1 THEN 'Old plate' END AS topic FROM benchmark) x), qt AS (SELECT query_id, terms, key FROM q),
    ct AS (SELECT 'chunk' AS kind, chunk_id AS id, LOWER(text) AS low, {_TERMS.format('text')} AS terms, '' AS k1, '' AS k2 FROM chunks UNION ALL SELECT 'concept', p_partkey, LOWER({_CONCEPT}), [], {_KEY.format('concept_id')}, {_KEY.format('title')} FROM concept_rows),
    p AS (SELECT query_id, kind, id, COALESCE(LEN(list_intersect(qt.terms, ct.terms)), 0) AS shared, COALESCE({_OCC}, 0) AS occ, COALESCE(kind = 'concept' AND (key = k1 OR key = k2), FALSE) AS exact FROM qt, ct),
    l AS (SELECT *, 2 * shared + occ + CASE WHEN kind = 'concept' THEN 3 ELSE 0 END + CASE WHEN exact THEN 1000 ELSE 0 END AS lexical FROM p WHERE shared + occ > 0 OR exact),
    lex AS (SELECT query_id, kind, id, CAST(lexical AS BIGINT) AS lexical, exact, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY lexical DESC, kind, id) AS rank FROM l QUALIFY rank <= 100)"""


def _queries(benchmark):
    topic = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("C"), F.col("item_id").cast("string"))).when(F.col("item_id") % 4 == 1, "Old plate")
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), topic.alias("topic"))


def _concepts(concept_rows):
    text = F.concat_ws("\n", "title", "definition", "explanation", "points")
    return concept_rows.select(F.col("p_partkey").alias("id"), text.alias("text"), F.array(X.normal_key(F.col("concept_id")), X.normal_key(F.col("title"))).alias("keys"))


def _lexical(benchmark, chunks, concept_rows):
    return R.lexical_best(_queries(benchmark), chunks.select(F.col("chunk_id").alias("id"), "text"), _concepts(concept_rows))


def _vectors(embeddings):
    q = embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2).alias("model"), F.col("embedding").alias("query"))
    return q, embeddings.select("vec_id", (F.col("label") % 2).alias("model"), "embedding")


@query("C11", "embeddings", also="C11_all", sql=f"WITH {_VEC} SELECT query_id, vec_id, ROUND(similarity, 6) AS similarity, rn AS rank FROM near WHERE rn <= 10")
def _(embeddings):
    return R.vector_matches(*_vectors(embeddings), 10)


@query("I6", "embeddings", sql=f"SELECT vec_id, ROUND({_DOT.format('embedding', 'embedding')} / {_DOT.format('embedding', 'embedding')}, 6) AS unit_length FROM embeddings")
def _(embeddings):
    """Squared lengths of normalised vectors."""
    n = R.normalised(embeddings, "embedding")
    return n.select("vec_id", F.round(R.dot(F.col("embedding"), F.col("embedding")), 6).alias("unit_length"))


@query("I5", "benchmark", "chunks", "concept_rows", also="I5_exact", sql=f"WITH {_LEX} SELECT * FROM lex")
def _(benchmark, chunks, concept_rows):
    """The hundred best chunks and concepts of each item by its terms; exact topics first."""
    return _lexical(benchmark, chunks, concept_rows)


@query("I5_all", "benchmark", "chunks", sql=f"""
    WITH qt AS (SELECT query_id, {_TERMS.format('query')} AS terms FROM ({_Q}) x), ct AS (SELECT chunk_id, LOWER(text) AS low, {_TERMS.format('text')} AS terms FROM chunks),
    p AS (SELECT query_id, chunk_id, LEN(list_intersect(qt.terms, ct.terms)) AS shared, {_OCC} AS occ FROM qt, ct)
    SELECT query_id, chunk_id, CAST(2 * shared + occ AS BIGINT) AS lexical, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY 2 * shared + occ DESC, chunk_id) AS rank FROM p WHERE shared > 0""")
def _(benchmark, chunks):
    """All chunks that share a whole term with an item, with their places."""
    return R.lexical_scores(_queries(benchmark), chunks)


# item k asks with vector k as well, and chunk k is stored with vector k if there is one
_FUSED = f"""{_LEX}, qv AS (SELECT item_id AS query_id, label % 2 AS model, embedding AS query FROM benchmark JOIN embeddings ON vec_id = item_id),
    sv AS (SELECT query_id, vec_id AS id, {_DOT.format('embedding', 'qv.query')} AS similarity FROM embeddings e JOIN qv ON e.label % 2 = qv.model WHERE vec_id IN (SELECT chunk_id FROM chunks)),
    sem AS (SELECT query_id, 'chunk' AS kind, id, FALSE AS exact, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sv WHERE similarity >= 0.25 QUALIFY rank <= 100),
    r AS (SELECT query_id, kind, id, exact, rank FROM lex UNION ALL SELECT * FROM sem),
    fu AS (SELECT query_id, kind, id, BOOL_OR(exact) AS exact, ROUND(SUM(1 / (60.0 + rank)), 8) AS fused FROM r GROUP BY 1, 2, 3),
    fp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY exact DESC, fused DESC, kind, id) AS position FROM fu)"""


def _fused(benchmark, chunks, concept_rows, embeddings):
    _, vectors = _vectors(embeddings)
    asked = benchmark.select(F.col("item_id").alias("query_id")).join(vectors.select(F.col("vec_id").alias("query_id"), "model", F.col("embedding").alias("query")), "query_id")
    stored = vectors.join(chunks.select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi")
    near = R.vector_matches(asked, stored, R.TOP).select("query_id", F.lit("chunk").alias("kind"), F.col("vec_id").alias("id"), "rank")
    return R.fused(_lexical(benchmark, chunks, concept_rows), near)


@query("I7", "benchmark", "chunks", "concept_rows", "embeddings", sql=f"WITH {_FUSED} SELECT * FROM fp")
def _(benchmark, chunks, concept_rows, embeddings):
    """Hybrid retrieval: terms and vectors, fused by reciprocal ranks; exact topics first."""
    return _fused(benchmark, chunks, concept_rows, embeddings)


@query("E10", "benchmark", "chunks", "concept_rows", "embeddings", sql=f"""
    WITH RECURSIVE {_FUSED}, size AS (SELECT 'chunk' AS kind, chunk_id AS id, CAST(n_chars AS BIGINT) AS n FROM chunks UNION ALL SELECT 'concept', p_partkey, LENGTH({_CONCEPT}) FROM concept_rows),
    t AS MATERIALIZED (SELECT query_id, kind, id, n, position AS rn FROM fp JOIN size USING (kind, id)),
    f AS (SELECT query_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS total, 0 AS k, CAST(NULL AS STRING) AS kind, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS chars FROM q
          UNION ALL SELECT f.query_id, t.rn, CASE WHEN f.k >= 5 OR f.total + t.n > 9000 AND f.k > 0 THEN f.total WHEN f.total + t.n > 9000 THEN 9000 ELSE f.total + t.n END, CASE WHEN f.k >= 5 OR f.total + t.n > 9000 AND f.k > 0 THEN f.k ELSE f.k + 1 END,
                 t.kind, CASE WHEN f.k >= 5 OR f.total + t.n > 9000 AND f.k > 0 THEN NULL ELSE t.id END, LEAST(t.n, 9000) FROM f JOIN t ON t.query_id = f.query_id AND t.rn = f.rn + 1 AND t.rn <= 10)
    SELECT query_id, k - 1 AS position, kind, id, chars FROM f WHERE id IS NOT NULL""")
def _(benchmark, chunks, concept_rows, embeddings):
    ranked = _fused(benchmark, chunks, concept_rows, embeddings)
    size = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.col("n_chars").cast("long").alias("n")).unionByName(_concepts(concept_rows).select(F.lit("concept").alias("kind"), "id", F.length("text").cast("long").alias("n")))
    return R.packed(ranked.where("position <= 10").join(size, ["kind", "id"]), 5, 9000)


@query("I8", "documents", sql="""
    WITH p AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
    f AS (SELECT doc_id, no, (LENGTH(LOWER(p)) - LENGTH(REPLACE(LOWER(p), 'the', ''))) / 3 + (LENGTH(LOWER(p)) - LENGTH(REPLACE(LOWER(p), 'de', ''))) / 2 AS freq, GREATEST(LEN(list_filter(string_split_regex(TRIM(LOWER(p)), '\\s+'), lambda w: w <> '')), 1) AS words, p FROM p WHERE TRIM(p) <> ''),
    s AS (SELECT doc_id, no, freq + freq / words * 10 + CASE WHEN regexp_matches(p, '##|\\*\\*|Definition|General Formula') THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches(p, '[₂₃₄ₙ⁺⁻]') THEN 0.3 ELSE 0.0 END AS score FROM f),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, no) AS rn, MAX(score) OVER (PARTITION BY doc_id) AS most FROM s)
    SELECT doc_id, no, ROUND(score, 6) AS score FROM r WHERE rn <= 2 AND score > 0 OR rn <= 3 AND most = 0""")
def _(documents):
    """The two best paragraphs of each text, or its first three."""
    return R.paragraph_scores(documents, ["the", "de"], 2)


@query("I10", "part", sql=f"""
    WITH q AS (SELECT query_id, UNNEST({_TERMS.format('query')}) AS term FROM (SELECT p_partkey AS query_id, p_name || ' ' || p_type AS query FROM part WHERE p_partkey % 50 = 0) x),
    c AS (SELECT CAST(p_partkey AS STRING) AS concept_id, LOWER(p_name) AS a, LOWER(p_type) AS b, LOWER(p_brand || ' ' || p_type) AS c, LOWER(p_name || ' of ' || p_size) AS d FROM part),
    w AS (SELECT query_id, concept_id, CASE WHEN contains(concept_id, term) THEN 8 ELSE 0 END + CASE WHEN contains(a, term) THEN 7 ELSE 0 END + CASE WHEN contains(b, term) THEN 4 ELSE 0 END + CASE WHEN contains(c, term) THEN 3 ELSE 0 END + CASE WHEN contains(d, term) THEN 1 ELSE 0 END AS w FROM c, q),
    s AS (SELECT query_id, concept_id, CAST(SUM(w) AS BIGINT) AS score FROM w WHERE w > 0 GROUP BY 1, 2)
    SELECT query_id, concept_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS rn FROM s) x WHERE rn <= 20""")
def _(part):
    queries = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("query"))
    explained, points = F.concat_ws(" ", "p_brand", "p_type").alias("explanation"), F.concat_ws(" of ", "p_name", F.col("p_size").cast("string")).alias("points")
    return R.keyword_concepts(queries, part.select(F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_name").alias("title"), F.col("p_type").alias("definition"), explained, points), 20)


@query("F10", "benchmark", "chunks", sql=f"""
    WITH q AS (SELECT query_id, 'src' || CAST(query_id % 20 AS STRING) AS chapter, {_TERMS.format('query')} AS terms FROM ({_Q}) x),
    p AS (SELECT query_id, chunk_id, page_start, LEN(list_intersect(q.terms, {_TERMS.format('text')})) AS n FROM chunks JOIN q USING (chapter)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS rn FROM p WHERE n > 0)
    SELECT query_id, chunk_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY page_start, chunk_id) AS position FROM r WHERE rn <= 4""")
def _(benchmark, chunks):
    return R.overlap_pages(_queries(benchmark).withColumn("chapter", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))), chunks, 4)


_SAYS = lambda phrases: "(" + " OR ".join("contains(t, '" + p.replace("'", "''") + "')" for p in phrases) + ")"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
# every turn begins in one of sixteen ways, so that each rule holds for some
_ASKED = """CASE turn % 16 WHEN 0 THEN 'What is ' WHEN 1 THEN 'Compare this: ' WHEN 2 THEN 'Find 12 of ' WHEN 3 THEN 'It is  hard. ' WHEN 4 THEN 'I am stuck. ' WHEN 5 THEN 'quiz me: ' WHEN 6 THEN 'Key points of ' WHEN 7 THEN 'Explain this from my notes: ' WHEN 8 THEN 'chapter recap ' WHEN 9 THEN 'two marks for ' WHEN 10 THEN 'my schedule ' ELSE '' END
    || CASE turn % 16 WHEN 11 THEN 'Thank  you' WHEN 12 THEN 'Why is that?!' WHEN 13 THEN 'no' ELSE text END"""
_DECLARED = "CASE conv_id % 9 WHEN 0 THEN 'Exam' WHEN 1 THEN 'summary' WHEN 2 THEN 'curiosity' WHEN 3 THEN 'Other' ELSE NULL END"


@query("I14", "conversations", sql=f"""
    WITH m AS (SELECT conv_id, turn, turn > 1 AS has_history, LOWER(TRIM(COALESCE({_DECLARED}, ''))) AS declared, TRIM(regexp_replace(LOWER({_ASKED}), '\\s+', ' ', 'g')) AS t FROM conversations),
    p AS (SELECT *, t IN ({_IN(R.SMALL_TALK)}) OR LENGTH(t) <= 2 AS talk, {_SAYS(R.GROUNDED)} AS grounded, has_history AND (regexp_replace(t, '[?.!]+$', '') IN ({_IN(R.GOES_ON_WHOLE)}) OR regexp_matches(t, '^({'|'.join(R.GOES_ON_FIRST)})( |$)') OR {_SAYS(R.GOES_ON)}) AS is_follow_up FROM m),
    i AS (SELECT *, CASE WHEN talk THEN 'conversation' {' '.join("WHEN " + (f"declared IN ({_IN(d)}) OR " if d else "") + _SAYS(w) + (" AND regexp_matches(t, '[0-9]')" if n == "numerical" else "") + f" THEN '{n}'" for n, _, d, w in R.INTENTS)} END AS rule FROM p)
    SELECT conv_id, turn, COALESCE(rule, CASE WHEN declared IN ('', 'general', 'concept', 'curiosity') THEN 'concept' ELSE declared END) AS intent, CASE rule WHEN 'exam' THEN 'exam_answer' WHEN 'practice' THEN 'quiz' WHEN 'clarification' THEN 'stuck' ELSE COALESCE(rule, 'concept') END AS format,
           CASE WHEN talk THEN 'none' WHEN grounded THEN 'required' WHEN {_SAYS(R.OVERVIEWS)} THEN 'optional' ELSE 'none' END AS retrieval_policy, is_follow_up, CASE WHEN talk THEN 'conversation' WHEN grounded THEN 'source_grounded' WHEN is_follow_up THEN 'contextual_reasoning' ELSE 'general_reasoning' END AS reasoning FROM i""")
def _(conversations):
    """What every turn asks for."""
    asked = conversations.select("conv_id", "turn", F.expr(_ASKED).alias("text"), F.expr(_DECLARED).alias("declared"), (F.col("turn") > 1).alias("has_history"))
    return R.intents(asked).select("conv_id", "turn", "intent", "format", "retrieval_policy", "is_follow_up", "reasoning")


@query("D43", "conversations", sql="""
    WITH f AS (SELECT conv_id, TRIM(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '\\s+', ' ', 'g')) AS s, COUNT(*) AS messages, MAX(turn) AS last_turn, STRING_AGG(role, ',' ORDER BY turn) AS roles, arg_max(contains(text, '?'), turn) AS asks, arg_max(LENGTH(text) > 300, turn) AS long FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN LENGTH(s) > 54 THEN RTRIM(SUBSTR(s, 1, 51)) || '...' ELSE s END AS title, messages, last_turn, roles, asks, long FROM f""")
def _(conversations):
    """Conversations: title, messages, last turn, roles in order, and the flags that the last turn sets."""
    from lumenary.functions.text import clipped, squeezed

    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    by = conversations.groupBy("conv_id").agg(first.alias("s"), F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"), F.max_by(F.contains("text", F.lit("?")), "turn").alias("asks"), F.max_by(F.length("text") > 300, "turn").alias("long"))
    return by.select("conv_id", clipped(squeezed(F.col("s")), 54).alias("title"), "messages", "last_turn", "roles", "asks", "long")


@query("I45", "conversations", sql="""
    WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, ROW_NUMBER() OVER (PARTITION BY conv_id, contains(LOWER(text), ' not ') OR contains(LOWER(text), ' no ') ORDER BY turn DESC) AS mn, contains(LOWER(text), ' not ') OR contains(LOWER(text), ' no ') AS wrong FROM conversations)
    SELECT conv_id, COUNT(*) FILTER (rn <= 6) AS window_turns, MIN(turn) FILTER (rn <= 6) AS from_turn, MAX(CASE WHEN role = 'user' THEN turn END) AS open_doubt, regexp_extract(LOWER(arg_max(text, turn) FILTER (role = 'user')), '[a-z]{5,}', 0) AS topic,
           COALESCE(STRING_AGG(CAST(turn AS STRING), ',' ORDER BY turn) FILTER (wrong AND mn <= 4), '') AS misconceptions FROM r GROUP BY conv_id""")
def _(conversations):
    """The last six turns of each lesson, its latest question and topic, and the last four turns that correct something."""
    return R.lesson_memory(conversations)


@query("I49", "chunks", "embeddings", sql="SELECT chapter, COUNT(*) AS missing, MIN(chunk_id) AS first_chunk FROM chunks LEFT JOIN embeddings ON vec_id = chunk_id WHERE embedding IS NULL OR LEN(embedding) = 0 GROUP BY chapter")
def _(chunks, embeddings):
    """Chunks that still need a vector (none stored, or an empty one), by chapter."""
    have = embeddings.where(F.size("embedding") > 0).select(F.col("vec_id").alias("chunk_id"))
    return chunks.join(have, "chunk_id", "left_anti").groupBy("chapter").agg(F.count("*").alias("missing"), F.min("chunk_id").alias("first_chunk"))


@query("D47", "embeddings", sql="SELECT label % 2 AS model, LEN(embedding) AS dims, COUNT(*) AS vectors, label % 2 = 0 AND LEN(embedding) = 64 AS compatible FROM embeddings GROUP BY 1, 2, 4")
def _(embeddings):
    """Stored models and dimensions against the configured ones."""
    by = embeddings.groupBy((F.col("label") % 2).alias("model"), F.size("embedding").alias("dims")).agg(F.count("*").alias("vectors"))
    return by.withColumn("compatible", (F.col("model") == 0) & (F.col("dims") == 64))
