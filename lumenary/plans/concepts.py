"""Queries of concepts and their chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import concepts as C
from lumenary.plans.content import _KEY
from lumenary.plans.registry import query

_PAGES = "CASE WHEN p_partkey % 13 = 0 THEN [] WHEN p_partkey % 3 = 0 THEN [page] ELSE [page, page + 1] END"
_V = f"""
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chapter, concept_id ORDER BY p_partkey) AS rn, {_PAGES} AS source_pages FROM concept_rows),
    pg AS (SELECT chapter, page, MAX(chars) AS chars FROM concept_pages GROUP BY 1, 2), have AS (SELECT chapter, LIST(page) AS ps FROM pg GROUP BY 1),
    c AS (SELECT k.*, list_filter([CASE WHEN definition = '' AND explanation = '' AND points = '' THEN 'missing_teaching_content' END, CASE WHEN LEN(source_pages) = 0 THEN 'missing_source_pages' WHEN LEN(list_filter(source_pages, lambda p: NOT list_contains(COALESCE(ps, []), p))) > 0 THEN 'source_page_out_of_range' END], lambda x: x IS NOT NULL) AS issues
          FROM k LEFT JOIN have USING (chapter) WHERE rn = 1),
    v AS (SELECT *, CASE WHEN list_contains(issues, 'missing_source_pages') THEN 'error' WHEN LEN(issues) > 0 THEN 'warning' END AS severity FROM c)"""


def _rows(concept_rows):
    page, k = F.col("page"), F.col("p_partkey")
    none = F.array().cast("array<bigint>")
    pages = F.when(k % 13 == 0, none).when(k % 3 == 0, F.array(page)).otherwise(F.array(page, page + 1))
    points = F.when(F.col("points") == "", F.array().cast("array<string>")).otherwise(F.split("points", " "))
    return concept_rows.withColumns({"seq": k, "source_pages": pages, "points": points})


def _checked(concept_rows, concept_pages):
    return C.validated(_rows(concept_rows), concept_pages)


@query("I17", "concept_rows", "concept_pages", sql=f"WITH {_V} SELECT chapter, concept_id, p_partkey AS seq, array_to_string(issues, ',') AS issues, severity FROM v")
def _(concept_rows, concept_pages):
    """Concepts with their issues, the first of each id."""
    return _checked(concept_rows, concept_pages).select("chapter", "concept_id", "seq", F.array_join("issues", ",").alias("issues"), "severity")


_COVERED = f"""{_V}, h AS (SELECT chapter, COUNT(DISTINCT page) AS page_count, COUNT(DISTINCT CASE WHEN chars > 0 THEN page END) AS extracted FROM concept_pages GROUP BY 1),
    ci AS (SELECT DISTINCT chapter, UNNEST(source_pages) AS page FROM v), co AS (SELECT ci.chapter, COUNT(*) AS covered FROM ci JOIN pg ON pg.chapter = ci.chapter AND pg.page = ci.page AND pg.chars > 0 GROUP BY 1),
    b AS (SELECT chapter, COUNT(*) AS concepts, COUNT(*) FILTER (severity = 'error' OR list_contains(issues, 'missing_teaching_content')) AS blocking FROM v GROUP BY 1),
    g AS (SELECT h.chapter, page_count, extracted, COALESCE(covered, 0) AS covered, COALESCE(concepts, 0) AS concepts, COALESCE(blocking, 0) AS blocking FROM h LEFT JOIN co USING (chapter) LEFT JOIN b USING (chapter)),
    sh AS (SELECT *, CASE WHEN extracted > 0 AND concepts > 0 THEN covered / extracted ELSE 0.0 END AS share FROM g)"""


@query("I18", "concept_rows", "concept_pages", sql=f"WITH {_COVERED} SELECT chapter, page_count, extracted, covered, concepts, blocking + bad_ids AS blocking, bad_ids, ROUND(share, 3) AS coverage_score, concepts > 0 AND blocking + bad_ids = 0 AND share >= 0.6 AS ready FROM (SELECT sh.*, CAST(COALESCE(bad, 0) AS BIGINT) AS bad_ids FROM sh LEFT JOIN (SELECT chapter, SUM(n - 1) AS bad FROM (SELECT chapter, {_KEY.format('concept_id')} AS k, COUNT(*) AS n FROM concept_rows GROUP BY 1, 2) x GROUP BY 1) y USING (chapter)) z")
def _(concept_rows, concept_pages):
    """Each chapter's coverage and whether it may be approved."""
    return C.coverage(_checked(concept_rows, concept_pages), concept_pages, concept_rows)


@query("I18_vectors", "documents", "embeddings", sql="""
    WITH v AS (SELECT source AS chapter, CASE vec_id % 31 WHEN 0 THEN list_transform(embedding, lambda x: x * 2) WHEN 1 THEN embedding[1:60] WHEN 2 THEN [] ELSE embedding END AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
    w AS (SELECT chapter, CASE WHEN e IS NULL OR LEN(e) = 0 THEN 'missing' WHEN LEN(e) <> 64 THEN 'dimensions' WHEN NOT SQRT(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x))) BETWEEN 0.99 AND 1.01 THEN 'not_normalised' END AS reason FROM v)
    SELECT chapter, reason, COUNT(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY 1, 2""")
def _(documents, embeddings):
    """Vectors that keep a chapter from release; some are made wrong."""
    e = F.col("embedding")
    wrong = F.when(F.col("vec_id") % 31 == 0, F.transform(e, lambda x: x * 2)).when(F.col("vec_id") % 31 == 1, F.slice(e, 1, 60)).when(F.col("vec_id") % 31 == 2, F.slice(e, 1, 0)).otherwise(e)
    return C.vector_faults(documents.join(embeddings, F.col("vec_id") == F.col("doc_id"), "left").select(F.col("source").alias("chapter"), wrong.alias("embedding")), 64)


@query("B18", "concept_rows", "concept_pages", sql=f"""
    WITH {_V}, e AS (SELECT chapter, array_to_string(list_sort(LIST(concept_id) FILTER (severity = 'error'))[1:20], ',') AS labels, COUNT(*) FILTER (severity = 'error') AS errors, COUNT(*) FILTER (LEN(issues) > 0) % 4 AS recorded FROM v GROUP BY 1)
    SELECT chapter, COALESCE(labels, '') AS blocking_issues, CAST(GREATEST(recorded, LEAST(errors, 20)) AS INT) AS blocking_count FROM e""")
def _(concept_rows, concept_pages):
    """What blocks each chapter's release."""
    checked = _checked(concept_rows, concept_pages)
    issue = F.struct(F.col("concept_id").alias("code"), F.upper("severity").alias("severity"), F.array_join("issues", ",").alias("message"))
    reports = checked.groupBy("chapter").agg(F.array_sort(F.collect_list(F.when(F.size("issues") > 0, issue))).alias("issues"), (F.count_if(F.size("issues") > 0) % 4).cast("int").alias("recorded"))
    return C.blocking_issues(reports).select("chapter", F.array_join("blocking_issues", ",").alias("blocking_issues"), "blocking_count")


@query("D27", "concept_rows", "concept_pages", sql=f"""
    WITH {_V}, p AS (SELECT v.*, list_filter(list_distinct(source_pages), lambda x: list_contains(COALESCE(ps, []), x)) AS okay FROM v LEFT JOIN have USING (chapter)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chapter ORDER BY p_partkey) AS place, COUNT(*) OVER (PARTITION BY chapter) AS n FROM p)
    SELECT chapter, concept_id, LEN(list_distinct(source_pages)) AS cited, LEN(okay) AS proven, list_min(okay) AS first_page, list_max(okay) AS last_page, CAST(definition <> '' AS INT) + CAST(explanation <> '' AS INT) + CAST(points <> '' AS INT) AS parts, LEN(issues) = 0 AS valid, n > 500 AS truncated FROM r WHERE place <= 500""")
def _(concept_rows, concept_pages):
    """Each concept's proof and contents."""
    return C.drill_down(_checked(concept_rows, concept_pages), concept_pages)


@query("I16", "concept_rows", sql="""
    WITH m AS (SELECT *, CAST(FLOOR(page / 10) AS BIGINT) AS unit, CASE importance WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'important' THEN 3 ELSE 4 END AS rank FROM concept_rows),
    w AS (SELECT chapter, unit, array_to_string(list_sort(list_distinct(flatten(LIST(CASE WHEN points = '' THEN [] ELSE string_split(points, ' ') END)))), '|') AS points FROM m GROUP BY 1, 2),
    b AS (SELECT chapter, unit, definition, ROW_NUMBER() OVER (PARTITION BY chapter, unit ORDER BY rank DESC, LENGTH(definition) DESC, p_partkey) AS rn FROM m)
    SELECT m.chapter, m.unit, COUNT(*) AS members, MAX(m.difficulty) AS difficulty, MAX(rank) AS rank, MAX(b.definition) AS definition, MAX(w.points) AS points, STRING_AGG(concept_id, '|' ORDER BY p_partkey) AS source_ids
    FROM m JOIN w ON w.chapter = m.chapter AND w.unit = m.unit JOIN b ON b.chapter = m.chapter AND b.unit = m.unit AND b.rn = 1 GROUP BY 1, 2""")
def _(concept_rows):
    """Concepts of ten pages as one."""
    rows = _rows(concept_rows)
    return C.merged(rows.withColumns({"unit": F.floor(F.col("page") / 10), "rank": C.importance(F.col("importance"))}))


@query("I15", "concept_rows")
def _(concept_rows):
    """Each chapter's concepts in learning units; held against all ways to cut in tests."""
    rows = _rows(concept_rows)
    related = F.array(F.concat(F.lit("c"), (F.col("p_partkey") + 1).cast("string")))
    return C.learning_units(rows.withColumns({"rank": C.importance(F.col("importance")), "formulas": (F.col("p_partkey") % 2).cast("int"), "pages": F.col("source_pages").cast("array<int>"), "related": related}))
