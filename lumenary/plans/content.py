"""Queries over documents, pages and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.operators import content as C
from lumenary.operators.payloads import clamped, whole_number
from lumenary.plans.registry import query

_KEY = "regexp_replace(regexp_replace(LOWER({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TERMS = "list_sort(list_distinct(list_filter(regexp_extract_all(LOWER({0}), '[a-z0-9]+'), lambda w: LEN(w) > 2 AND w NOT IN (" + _STOP + "))))"


@query("B1", "part", sql=f"SELECT p_partkey, {_KEY.format('p_name')} AS k FROM part")
def _(part):
    """Normal keys of names."""
    return part.select("p_partkey", X.normal_key(F.col("p_name")).alias("k"))


@query("B2", "part", sql="SELECT DISTINCT p_type, " + "CASE " + " ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in X.TOPIC_ALIASES.items()) + f" ELSE k END AS topic FROM (SELECT p_type, COALESCE({_KEY.format('p_type')}, 'unknown') AS k FROM part) x")
def _(part):
    return part.select("p_type", X.normal_topic(F.col("p_type")).alias("topic")).distinct()


@query("B3", "part", sql="SELECT p_partkey, CASE p_size " + " ".join(f"WHEN {k} THEN '{k}'" for k in range(1, 13)) + " ELSE CAST(p_size AS STRING) END AS class_level FROM part")
def _(part):
    """Class levels out of the several ways to write them."""
    written = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("class_"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Grade "), F.col("p_size").cast("string"))).otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in X.ROMAN.items() for x in (v, k.upper()))), F.col("p_size").cast("string")), F.col("p_size").cast("string")))
    return part.select("p_partkey", X.class_level(written).alias("class_level"))


@query("B4", "orders", sql="SELECT o_orderpriority, CASE " + f"WHEN {_KEY.format('o_orderpriority')} = '' THEN 'other' ELSE {_KEY.format('o_orderpriority')} END AS exam_type, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def _(orders):
    return orders.groupBy("o_orderpriority", X.exam_type(F.col("o_orderpriority")).alias("exam_type")).agg(F.count("*").alias("n"))


@query("B5", "chunks", sql="SELECT chunk_id FROM chunks WHERE contains(LOWER(subject), 'en') AND contains(LOWER(chapter), 'src1')")
def _(chunks):
    return C.scoped(chunks, subject="EN", chapter="src1", text=None).select("chunk_id")


@query("B6", "chunks", sql="SELECT chunk_id FROM (SELECT chunk_id, contains(text, 'token') AS m, MAX(CASE WHEN contains(text, 'token') THEN 1 ELSE 0 END) OVER (PARTITION BY chapter) AS anym FROM chunks) x WHERE m OR anym = 0")
def _(chunks):
    return C.soft_topic(chunks, "chapter", F.col("text").contains("token")).select("chunk_id")


@query("B7", "part", sql="SELECT p_partkey FROM part WHERE contains(LOWER(p_name), '10') OR contains(LOWER(p_brand), '10') OR contains(LOWER(p_type), '10')")
def _(part):
    return C.searched(part, "10", "p_name", "p_brand", "p_type").select("p_partkey")


@query("C5", "chunks", sql="SELECT chunk_id FROM chunks WHERE chapter IN (SELECT chapter FROM chunks GROUP BY chapter HAVING SUM(n_chars) > 100000)")
def _(chunks):
    """Chunks of large chapters."""
    large = chunks.groupBy("chapter").agg(F.sum("n_chars").alias("n")).where("n > 100000")
    return chunks.join(large, "chapter", "left_semi").select("chunk_id")


@query("C7", "chunks", "labels", sql="""
    WITH p AS (SELECT DISTINCT chapter, CAST(doc_id % 50 AS INT) AS page FROM labels JOIN chunks ON doc_id = chunk_id WHERE toxic = 1)
    SELECT DISTINCT chunk_id FROM chunks c JOIN p ON p.chapter = c.chapter AND page_start > 0 AND page BETWEEN LEAST(page_start, page_end) AND GREATEST(page_start, page_end)""")
def _(chunks, labels):
    pages = labels.where("toxic = 1").join(chunks, F.col("doc_id") == F.col("chunk_id")).select("chapter", (F.col("doc_id") % 50).cast("int").alias("page")).distinct()
    return C.overlapping(chunks, pages)


@query("C8", "chunks", sql="""
    WITH p AS (SELECT DISTINCT chapter, page_start AS page FROM chunks WHERE chunk_id % 2 = 0), c AS (SELECT chunk_id AS concept_id, chapter, UNNEST(list_distinct([page_start, page_end, page_start + 7])) AS page FROM chunks)
    SELECT concept_id, COUNT(p.page) AS verified, COUNT(*) - COUNT(p.page) AS missing FROM c LEFT JOIN p ON p.chapter = c.chapter AND p.page = c.page GROUP BY concept_id""")
def _(chunks):
    concepts = chunks.select(F.col("chunk_id").alias("concept_id"), "chapter", F.array("page_start", "page_end", F.col("page_start") + 7).alias("source_pages"))
    return C.citations(concepts, chunks.where("chunk_id % 2 = 0").select("chapter", F.col("page_start").alias("page")))


_CHAPTERS = "SELECT chapter, CASE LENGTH(chapter) % 2 WHEN 0 THEN 'published' ELSE 'indexed' END AS status, CONCAT('class ', RIGHT(chapter, 1)) AS class_level, MIN(subject) AS subject FROM chunks GROUP BY chapter"


@query("D25", "chunks", "embeddings", "labels", sql=f"""
    WITH ch AS ({_CHAPTERS}), c AS (SELECT chapter, COUNT(*) AS chunks, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars, CAST(SUM(GREATEST(1, CAST(ROUND(LENGTH(text) / 4) AS INT))) AS BIGINT) AS tokens, COUNT(*) FILTER (LENGTH(text) < 40) AS short_chunks, COUNT(vec_id) AS embedded, CAST(COALESCE(SUM(LEN(embedding)) * 4, 0) AS BIGINT) AS vector_bytes FROM chunks LEFT JOIN embeddings ON vec_id = chunk_id GROUP BY 1),
    k AS (SELECT source AS chapter, COUNT(*) AS concepts, COUNT(*) FILTER (1 - quality + toxic > 0) AS with_issues FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    r AS (SELECT ch.*, c.* EXCLUDE (chapter), COALESCE(concepts, 0) AS concepts, COALESCE(with_issues, 0) AS with_issues FROM ch JOIN c USING (chapter) LEFT JOIN k USING (chapter))
    SELECT chapter, status, class_level, subject, COUNT(*) AS chapters, SUM(chunks) AS chunks, SUM(chars) AS chars, SUM(tokens) AS tokens, SUM(short_chunks) AS short_chunks, SUM(embedded) AS embedded, SUM(vector_bytes) AS vector_bytes, SUM(concepts) AS concepts, SUM(with_issues) AS with_issues, SUM(chars) + SUM(vector_bytes) AS memory_bytes, CASE WHEN SUM(concepts) > 0 THEN ROUND(SUM(with_issues) / SUM(concepts), 4) ELSE 0 END AS error_rate
    FROM r GROUP BY GROUPING SETS ((chapter), (status), (class_level), (subject), ())""")
def _(chunks, embeddings, labels):
    """The content report: chapters, states, classes, subjects and all; labelled texts stand for concepts."""
    sized = chunks.join(embeddings.select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dims")), "chunk_id", "left")
    chapters = chunks.sparkSession.sql(_CHAPTERS.replace("FROM chunks", "FROM {chunks}"), chunks=chunks)
    concepts = labels.join(chunks.select(F.col("chunk_id").alias("doc_id"), "chapter"), "doc_id").select("chapter", (1 - F.col("quality") + F.col("toxic")).alias("issues"))
    return C.report(sized, chapters, concepts)


@query("D27_chunks", "chunks", "embeddings", sql="""
    WITH c AS (SELECT chunks.*, LEN(embedding) AS dims FROM chunks LEFT JOIN embeddings ON vec_id = chunk_id), r AS (SELECT chapter, page_start, page_end, ROW_NUMBER() OVER (PARTITION BY chapter ORDER BY page_start, page_end) AS rn FROM (SELECT DISTINCT chapter, page_start, page_end FROM chunks WHERE page_start > 0) x),
    p AS (SELECT chapter, STRING_AGG(page_start || '-' || page_end, ',' ORDER BY rn) FILTER (rn <= 40) AS ranges, MAX(rn) > 40 AS truncated FROM r GROUP BY chapter)
    SELECT c.chapter, COUNT(*) AS chunks, COUNT(*) FILTER (dims > 0) AS embedded, ROUND(COUNT(*) FILTER (dims > 0) / COUNT(*) * 100, 1) AS embedded_percent, COALESCE(STRING_AGG(DISTINCT CAST(dims AS STRING), ','), '') AS dims, COALESCE(MAX(ranges), '') AS ranges, COALESCE(BOOL_OR(truncated), FALSE) AS truncated FROM c LEFT JOIN p ON p.chapter = c.chapter GROUP BY c.chapter""")
def _(chunks, embeddings):
    """What retrieval has of each chapter, with its first forty page ranges."""
    return C.retrieval_evidence(chunks.join(embeddings.select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dims")), "chunk_id", "left"), 40)


@query("D26", "chunks", "embeddings", sql="""
    WITH p AS (SELECT DISTINCT chapter, page_start AS page FROM chunks WHERE chunk_id % 2 = 0), c AS (SELECT chapter, UNNEST(list_distinct([page_start, page_end])) AS page, chunk_id FROM chunks),
    v AS (SELECT c.chapter, COUNT(p.page) AS verified, COUNT(*) AS cited FROM c LEFT JOIN p ON p.chapter = c.chapter AND p.page = c.page GROUP BY c.chapter)
    SELECT v.chapter, verified, cited, ROUND(100.0 * verified / NULLIF(cited, 0), 4) AS coverage, embedded, verified * 100 >= cited * 60 AS ready FROM v JOIN (SELECT chapter, ROUND(100.0 * COUNT(vec_id) / COUNT(*), 4) AS embedded FROM chunks LEFT JOIN embeddings ON vec_id = chunk_id GROUP BY 1) e ON e.chapter = v.chapter""")
def _(chunks, embeddings):
    """Verified citations of each chapter and its readiness at 60 %."""
    concepts = chunks.select(F.col("chunk_id").alias("concept_id"), "chapter", F.array("page_start", "page_end").alias("source_pages"))
    by = C.citations(concepts, chunks.where("chunk_id % 2 = 0").select("chapter", F.col("page_start").alias("page")))
    v = by.join(concepts.select("concept_id", "chapter"), "concept_id").groupBy("chapter").agg(F.sum("verified").alias("verified"), F.sum(F.col("verified") + F.col("missing")).alias("cited"))
    stored = chunks.select("chapter", "chunk_id").join(embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("has")), "chunk_id", "left").groupBy("chapter").agg(F.round(100.0 * F.count("has") / F.count("*"), 4).alias("embedded"))
    return v.join(stored, "chapter").select("chapter", "verified", "cited", F.round(100.0 * F.col("verified") / F.nullif("cited", F.lit(0)), 4).alias("coverage"), "embedded", (F.col("verified") * 100 >= F.col("cited") * 60).alias("ready"))


@query("D50", "pages", sql="SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS folder, COUNT(*) AS files, SUM(LENGTH(html)) AS chars, ROUND(100.0 * COUNT(*) FILTER (LENGTH(TRIM(regexp_replace(html, '<[^>]*>', '', 'g'))) >= 200) / COUNT(*), 4) AS extracted FROM pages GROUP BY 1")
def _(pages):
    """Files, characters and the share with 200 characters of text by top folder (host) of their address."""
    read = F.length(F.trim(F.regexp_replace("html", "<[^>]*>", ""))) >= 200
    return pages.groupBy(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")[0].alias("folder")).agg(F.count("*").alias("files"), F.sum(F.length("html")).alias("chars"), F.round(100.0 * F.count_if(read) / F.count("*"), 4).alias("extracted"))


@query("D52", "chunks", sql="SELECT subject, COUNT(*) AS chapters, STRING_AGG(chapter || '=' || n, ',' ORDER BY chapter) AS contents FROM (SELECT subject, chapter, COUNT(*) AS n FROM chunks GROUP BY 1, 2) x GROUP BY subject")
def _(chunks):
    return C.catalog(chunks)


@query("A4", "documents", sql="SELECT doc_id, sha256(text) AS digest FROM documents")
def _(documents):
    """Content digests for change detection."""
    return documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("A10", "chunks", sql="SELECT chapter, COUNT(*) AS chunks, COUNT(*) FILTER (LENGTH(text) > 0) AS filled FROM chunks GROUP BY chapter")
def _(chunks):
    """Inventory without writing."""
    return chunks.groupBy("chapter").agg(F.count("*").alias("chunks"), F.count_if(F.length("text") > 0).alias("filled"))


@query("A15", "chunks", sql="SELECT chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks o WHERE o.chunk_id % 3 = 0 AND o.chapter = c.chapter AND sha256(o.text) = sha256(c.text))")
def _(chunks):
    """Sources not yet ingested with the same digest."""
    rows = chunks.select("chunk_id", "chapter", F.sha2("text", 256).alias("digest"))
    return rows.join(rows.where("chunk_id % 3 = 0").select("chapter", "digest"), ["chapter", "digest"], "left_anti").select("chunk_id")


@query("E15", "documents", sql="""
    WITH m AS (SELECT source, quantile_cont(n_chars, 0.5) AS median FROM documents WHERE n_chars > 0 GROUP BY source)
    SELECT doc_id, n_chars >= 8000 AND n_chars > 4 * median AS abnormal, ROUND(LEAST(1.0, n_chars / 900) * CASE WHEN n_chars >= 8000 AND n_chars > 4 * median THEN 0.15 ELSE 1.0 END, 6) AS quality FROM documents JOIN m USING (source)""")
def _(documents):
    return C.abnormal_pages(documents.select("doc_id", "source", "n_chars"), "source", "n_chars").select("doc_id", "abnormal", "quality")


@query("G3", "chunks", sql="SELECT chapter, page FROM (SELECT DISTINCT chapter, page_start AS page FROM chunks WHERE chunk_id % 2 = 0 EXCEPT SELECT chapter, page_end FROM chunks WHERE chunk_id % 2 = 1) x")
def _(chunks):
    """Pages on which an even chunk starts but no odd one ends."""
    return chunks.where("chunk_id % 2 = 0").select("chapter", F.col("page_start").alias("page")).subtract(chunks.where("chunk_id % 2 = 1").select("chapter", F.col("page_end").alias("page")))


@query("G4", "documents", sql="""
    WITH l AS (SELECT doc_id, line, MIN(i) AS i FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) x GROUP BY doc_id, line)
    SELECT doc_id, sha256(STRING_AGG(line, chr(10) ORDER BY i)) AS lines_sha256, COUNT(*) AS n FROM l GROUP BY doc_id""")
def _(documents):
    """Distinct lines of each text in their order."""
    lines = F.array_distinct(F.split("text", "\n", -1))
    return documents.select("doc_id", F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"), F.size(lines).cast("long").alias("n"))


@query("G5", "documents", sql="""
    WITH k AS (SELECT source AS concept_id, sha256(text) AS digest, MIN(doc_id) AS seq FROM documents GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY concept_id ORDER BY seq) AS rn FROM k)
    SELECT CASE WHEN rn = 1 THEN concept_id ELSE concept_id || '_' || SUBSTR(digest, 1, 10) END AS final_id, concept_id, seq FROM r""")
def _(documents):
    return C.renamed_collisions(documents.select(F.col("source").alias("concept_id"), F.col("text").alias("content"), F.col("doc_id").alias("seq")))


@query("H1", "documents", sql="""
    SELECT doc_id, CASE WHEN LENGTH(s) > 54 THEN RTRIM(SUBSTR(s, 1, 51)) || '...' ELSE s END AS clip, CASE WHEN LENGTH(s) > 96 THEN RTRIM(SUBSTR(s, 1, 93)) || '...' ELSE s END AS heading, CASE WHEN LENGTH(s) > 220 THEN RTRIM(SUBSTR(s, 1, 217)) || '...' ELSE s END AS summary FROM (SELECT doc_id, TRIM(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents) x""")
def _(documents):
    """White space squeezed, then clipped to the lengths of a title, a heading and a summary."""
    s = X.squeezed(F.col("text"))
    return documents.select("doc_id", X.clipped(s, 54).alias("clip"), X.clipped(s, 96).alias("heading"), X.clipped(s, 220).alias("summary"))


@query("H2", "documents", sql="SELECT doc_id, GREATEST(1, CAST(ROUND(LENGTH(text) / 4) AS INT)) AS tokens, GREATEST(1, CAST(CEIL(LENGTH(text) / 4) AS INT)) AS tokens_up, CAST(CEIL(LENGTH(COALESCE(text, '')) / 4) AS INT) + 800 * CAST(doc_id % 3 AS INT) AS message_tokens FROM documents")
def _(documents):
    """Token estimates."""
    return documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.greatest(F.lit(1), F.ceil(F.length("text") / 4).cast("int")).alias("tokens_up"), X.message_tokens(F.col("text"), F.col("doc_id") % 3).alias("message_tokens"))


@query("H3", "traces", sql="""
    SELECT id, ROUND(estimated_input_tokens / 1000000 * CASE WHEN provider = 'p0' AND model = 'm0' THEN 3.0 WHEN model = 'm1' THEN 1.0 ELSE 0.5 END + estimated_output_tokens / 1000000 * CASE WHEN provider = 'p0' AND model = 'm0' THEN 15.0 WHEN model = 'm1' THEN 5.0 ELSE 1.5 END, 8) AS cost FROM traces""")
def _(traces):
    """Costs by a price table: provider and model, else model, else the default."""
    spark = traces.sparkSession
    prices = F.broadcast(spark.createDataFrame([("p0:m0", 3.0, 15.0), ("m1", 1.0, 5.0)], "k string, pin double, pout double"))
    a, b = prices.toDF("k1", "in1", "out1"), prices.toDF("k2", "in2", "out2")
    t = traces.join(a, F.concat_ws(":", "provider", "model") == F.col("k1"), "left").join(b, F.col("model") == F.col("k2"), "left")
    price = lambda c, d: F.coalesce(F.col(f"{c}1"), F.col(f"{c}2"), F.lit(d))
    return t.select("id", F.round(F.col("estimated_input_tokens") / 1000000 * price("in", 0.5) + F.col("estimated_output_tokens") / 1000000 * price("out", 1.5), 8).alias("cost"))


@query("H4", "conversations", sql="""
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter([TRY_CAST(NULLIF(regexp_extract(w, '[0-9]{1,9}', 0), '') AS INT) for w in string_split(text, ' ')], lambda x: x IS NOT NULL AND x > 0))), ',') AS pages FROM conversations""")
def _(conversations):
    """Page numbers out of the words of a message."""
    return conversations.select("conv_id", "turn", F.array_join(F.transform(X.page_numbers(F.split("text", " ")), lambda x: x.cast("string")), ",").alias("pages"))


@query("H5", "part", sql="SELECT p_partkey, GREATEST(1, LEAST(5, p_size)) AS level FROM part")
def _(part):
    """Difficulty out of words with numbers."""
    return part.select("p_partkey", X.difficulty(F.concat(F.lit("Level "), F.col("p_size").cast("string"))).alias("level"))


@query("H7", "part", sql="SELECT p_partkey, CASE WHEN p_retailprice > 0 AND p_retailprice <= 100 THEN p_retailprice END AS marks, CASE WHEN p_partkey % 5 = 0 THEN 0.5 WHEN p_partkey % 5 = 1 THEN 0.5 ELSE LEAST(1.0, GREATEST(0.0, (p_size - 10) / 20.0)) END AS confidence, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS whole FROM part")
def _(part):
    """Marks, null out of bounds; numbers in bounds with a default for text and NaN; whole numbers out of text."""
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    share = F.when(k == 0, "unknown").when(k == 1, "NaN").otherwise(((size - 10) / 20.0).cast("decimal(9,4)").cast("string"))
    whole = F.when(k == 0, "none").when(k == 1, F.concat(F.lit("about "), size, F.lit(" pages"))).otherwise(F.concat(size, F.lit(".0")))
    return part.select("p_partkey", X.marks(F.col("p_retailprice")).alias("marks"), clamped(share, 0.0, 1.0, 0.5).alias("confidence"), whole_number(whole, -1).alias("whole"))


@query("H9", "part", sql="SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'v' || (p_size + 1) ELSE 'v2' END AS version FROM part")
def _(part):
    """Version bumps."""
    return part.select("p_partkey", X.next_version(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("v"), F.col("p_size").cast("string"))).otherwise("draft")).alias("version"))


@query("H12", "events", sql="SELECT 'negative value' AS rule, COUNT(*) FILTER (value < 0) AS violations FROM events UNION ALL SELECT 'unknown type', COUNT(*) FILTER (event_type NOT IN ('signup', 'click', 'view', 'purchase')) FROM events UNION ALL SELECT 'value over 400', COUNT(*) FILTER (value > 400) FROM events")
def _(events):
    """Violations of rules, a row per rule, in one pass."""
    rules = {"negative value": F.col("value") < 0, "unknown type": ~F.col("event_type").isin("signup", "click", "view", "purchase"), "value over 400": F.col("value") > 400}
    one = events.groupBy().agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    return one.unpivot([], list(rules), "rule", "violations")


@query("H15", "documents", sql="SELECT doc_id, sha256(translate(text, '0123456789', '₀₁₂₃₄₅₆₇₈₉')) AS low, sha256(text) AS back FROM documents")
def _(documents):
    """Digits as subscripts, and folded back."""
    low = F.translate("text", "0123456789", "₀₁₂₃₄₅₆₇₈₉")
    return documents.select("doc_id", F.sha2(low, 256).alias("low"), F.sha2(X.subscripts(low), 256).alias("back"))


@query("H16", "events", sql="SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '[A-Za-z0-9()]+ ?= ?[A-Za-z0-9()+*/^-]+'))), '|') AS formulas FROM (SELECT event_id, 'given v=' || user_id || ' and k = ' || event_type || ', v=' || user_id AS x FROM events) e")
def _(events):
    """Distinct equations of a text."""
    text = F.concat(F.lit("given v="), F.col("user_id").cast("string"), F.lit(" and k = "), F.col("event_type"), F.lit(", v="), F.col("user_id").cast("string"))
    return events.select("event_id", F.array_join(F.array_sort(X.formulas(text)), "|").alias("formulas"))


@query("I4", "documents", sql=f"SELECT doc_id, LEN({_TERMS.format('text')}) AS n, sha256(array_to_string({_TERMS.format('text')}, ',')) AS terms_sha256 FROM documents")
def _(documents):
    """Content terms of each text."""
    return documents.select("doc_id", X.terms(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", ","), 256).alias("terms_sha256"))


@query("I2", "documents")
def _(documents):
    """Paragraph chunks of each text."""
    return X.with_chunks(documents.select("doc_id", "text"), "text", X.paragraph_chunks(F.col("text"))).select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("chunk_sha256"))


@query("I3", "documents")
def _(documents):
    """Word-bounded chunks of each text."""
    return X.with_chunks(documents.select("doc_id", "text"), "text", X.word_chunks(F.col("text"))).select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("chunk_sha256"))


# some texts in capitals with backslashes or control signs, some with glyphs of private use
_BROKEN = """CASE WHEN doc_id % 37 = 0 THEN REPLACE(REPLACE(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'E', chr(92)), ' T', CONCAT(' ', chr(1)))
    WHEN doc_id % 41 = 0 THEN REPLACE(text, ' of ', CONCAT(' ', '\ue001', ' ')) WHEN doc_id % 43 = 0 THEN CONCAT(text, ' (CID:7) /unif02B') ELSE text END"""
_PROSE = ", ".join(f"'{w}'" for w in X.PROSE)


@query("I19", "documents", sql=f"""
    WITH x AS (SELECT doc_id, {_BROKEN} AS t FROM documents),
    y AS (SELECT doc_id, LENGTH(t) AS n, GREATEST(1, LENGTH(regexp_replace(t, '\\s', '', 'g'))) AS solid, LEN(regexp_extract_all(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS controls, LEN(regexp_extract_all(t, '\\\\')) AS slashes, regexp_extract_all(t, '[A-Za-z]+') AS words,
          LEN(regexp_extract_all(t, '\\p{{Lu}}')) / GREATEST(1, LEN(regexp_extract_all(t, '\\p{{L}}'))) AS capitals, LEN(regexp_extract_all(t, '/unif[0-9A-Fa-f]+')) AS aliases, LEN(regexp_extract_all(t, '(?i)\\(cid:\\d+\\)')) AS cids, LEN(regexp_extract_all(t, '[\\x{{E000}}-\\x{{F8FF}}]')) AS private_use FROM x),
    z AS (SELECT *, LEN(words) >= 40 AND capitals >= 0.82 AND LEN(list_filter(words, lambda w: LOWER(w) IN ({_PROSE}))) / GREATEST(1, LEN(words)) < 0.025 AND (controls >= 5 OR slashes >= 5) AS cipher_like, aliases + cids + private_use AS glyphs FROM y)
    SELECT doc_id, ROUND(controls / solid, 5) AS control_ratio, ROUND(slashes / solid, 5) AS backslash_ratio, cipher_like, aliases, cids, private_use, cipher_like OR glyphs > 0 AS corrupt, controls / solid >= 0.03 OR slashes / solid >= 0.025 OR glyphs > 0 AS needs_review,
           ROUND(LEAST(1.0, n / 900) * CASE WHEN cipher_like OR glyphs > 0 THEN 0.15 ELSE 1.0 END, 3) AS quality FROM z""")
def _(documents):
    """Extraction sanity and quality of each text."""
    rows = documents.select("doc_id", F.expr(_BROKEN.replace("chr(92)", "char(92)").replace("chr(1)", "char(1)")).alias("t"))
    return rows.select("doc_id", X.extraction_sanity(F.col("t")).alias("s"), X.extraction_quality(F.col("t")).alias("quality")).select("doc_id", "s.*", "quality")


@query("I20", "documents", sql="SELECT doc_id, sha256(TRIM(regexp_replace(translate(text, '‘’“”–—', '''''\"\"--'), '[ \\t]+', ' ', 'g'))) AS clean_sha256 FROM documents")
def _(documents):
    """Repaired text."""
    return documents.select("doc_id", F.sha2(X.repaired(F.col("text")), 256).alias("clean_sha256"))


@query("I21", "documents")
def _(documents):
    """Titles by the line after UNIT n or the first title-like one, and section titles; held against a plain version in tests."""
    return documents.select("doc_id", X.inferred_title(F.col("text")).alias("title"), X.section_title(F.col("text")).alias("section"))


@query("I23", "documents", sql="""
    WITH RECURSIVE p AS (SELECT doc_id AS page, '' AS place, regexp_replace(text, '^[ \\t\\n\\r\\v\\f]+|[ \\t\\n\\r\\v\\f]+$', '', 'g') AS v FROM documents
        UNION ALL SELECT page, place || side, regexp_replace(CASE side WHEN '0' THEN SUBSTR(v, 1, c) ELSE SUBSTR(v, c + 1) END, '^[ \\t\\n\\r\\v\\f]+|[ \\t\\n\\r\\v\\f]+$', '', 'g') FROM (
            SELECT page, place, v, CASE WHEN regexp_matches(s, '[ \\n]') THEN low + LENGTH(regexp_extract(s, '(?s)^(.*)[ \\n]', 1)) ELSE mid END AS c FROM (
                SELECT *, SUBSTR(v, low + 1, LEAST(LENGTH(v) - 1, mid + mid // 2) - low) AS s FROM (SELECT *, GREATEST(1, mid // 2) AS low FROM (SELECT *, LENGTH(v) // 2 AS mid FROM p WHERE LENGTH(v) > 4000) x) y) z) d, (VALUES ('0'), ('1')) AS sides(side)),
    d AS (SELECT source || '-' || CAST(CAST(FLOOR(page / 500) AS BIGINT) AS STRING) AS paper, page, ROW_NUMBER() OVER (PARTITION BY page ORDER BY place) - 1 AS part, LENGTH(v) AS n, sha256(v) AS text_sha256, ROW_NUMBER() OVER (PARTITION BY source, FLOOR(page / 500) ORDER BY page, place) AS rn FROM p JOIN documents ON doc_id = page WHERE LENGTH(v) BETWEEN 1 AND 4000),
    f AS (SELECT paper, page, part, n, text_sha256, rn, n AS total, 0 AS batch FROM d WHERE rn = 1
          UNION ALL SELECT d.paper, d.page, d.part, d.n, d.text_sha256, d.rn, CASE WHEN f.total > 0 AND f.total + d.n > 12000 THEN d.n ELSE f.total + d.n END, CASE WHEN f.total > 0 AND f.total + d.n > 12000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN d ON d.paper = f.paper AND d.rn = f.rn + 1)
    SELECT paper, page, part, n, batch, text_sha256 FROM f""")
def _(documents):
    """Batches of each paper's pages, oversized ones split; a paper is what a source has among 500 neighbouring ids, so it is bounded."""
    paper = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 500).cast("string")).alias("paper")
    parts = C.split_texts(documents.select(paper, F.col("doc_id").alias("page"), "text"), 4000)
    return C.paper_batches(parts.select("paper", "page", "part", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text_sha256")), "paper", 12000)


@query("I51", "documents", sql="SELECT doc_id, contains(LOWER(text), 'idiot') OR contains(LOWER(text), 'worthless') AS risk FROM documents")
def _(documents):
    """High-risk texts by phrases."""
    return documents.select("doc_id", X.risky(F.col("text"), ["idiot", "worthless"]).alias("risk"))


@query("I52", "documents", sql="""
    WITH l AS (SELECT doc_id, LOWER(TRIM(line)) AS k, MIN(i) AS i FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) x WHERE TRIM(line) <> '' GROUP BY 1, 2)
    SELECT doc_id, COUNT(*) AS n, sha256(STRING_AGG(k, chr(10) ORDER BY i)) AS lines_sha256 FROM l GROUP BY doc_id""")
def _(documents):
    """Notes without repeated lines, whatever their case."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x))))
    return documents.where(F.size(lines) > 0).select("doc_id", F.size(lines).cast("long").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"))


@query("A7", "documents", sql="""
    WITH p AS (SELECT source, UNNEST(string_split_regex(text, '\\n\\s*\\n+')) AS para, doc_id FROM documents), q AS (SELECT source, COUNT(*) FILTER (TRIM(para) <> '') AS chunks, COUNT(*) FILTER (TRIM(para) <> '' AND LENGTH(TRIM(para)) < 40) AS short_chunks FROM p GROUP BY source)
    SELECT source, COUNT(*) AS files, SUM(strlen(text)) AS bytes, SUM(LENGTH(text)) AS chars, ANY_VALUE(chunks) AS chunks, ANY_VALUE(short_chunks) AS short_chunks FROM documents JOIN q USING (source) GROUP BY source""")
def _(documents):
    """A source's files, bytes, characters, paragraphs and short paragraphs."""
    paras = F.filter(F.transform(F.split("text", r"\n\s*\n+"), lambda p: F.trim(p)), lambda p: p != "")
    d = documents.select("source", F.octet_length("text").alias("bytes"), F.length("text").alias("chars"), F.size(paras).alias("chunks"), F.size(F.filter(paras, lambda p: F.length(p) < 40)).alias("short"))
    return d.groupBy("source").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("chars").alias("chars"), F.sum("chunks").alias("chunks"), F.sum("short").alias("short_chunks"))
