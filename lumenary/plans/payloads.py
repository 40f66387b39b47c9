"""Queries of model payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import payloads as P
from lumenary.plans.registry import query

_LCG = f"* {P.FACTOR} + {P.STEP}) % {P.RANGE}"
_SWAP = "list_transform(o{0}, lambda x, i: CASE WHEN i = {1} + 1 THEN o{0}[s{2} % ({1} + 1) + 1] WHEN i = s{2} % ({1} + 1) + 1 THEN o{0}[{1} + 1] ELSE x END)"


@query("I29", "part", sql=f"""
    WITH q AS (SELECT p_partkey, p_name AS question, [p_type, p_brand, p_name, p_brand || ' ' || p_size] AS t, p_partkey % 4 + 1 AS correct, CASE WHEN p_size % 7 = 0 THEN 'because option B fits' ELSE 'because it fits' END AS explanation FROM part),
    s AS (SELECT *, CAST('0x' || SUBSTR(sha256(question), 1, 8) AS BIGINT) AS s0 FROM q), a AS (SELECT *, (CASE WHEN s0 = 0 THEN 1 ELSE s0 END {_LCG} AS s1, [0, 1, 2, 3] AS o0 FROM s), b AS (SELECT *, (s1 {_LCG} AS s2, {_SWAP.format(0, 3, 1)} AS o1 FROM a),
    c AS (SELECT *, (s2 {_LCG} AS s3, {_SWAP.format(1, 2, 2)} AS o2 FROM b), d AS (SELECT *, {_SWAP.format(2, 1, 3)} AS o3 FROM c), e AS (SELECT *, CASE WHEN contains(explanation, 'option B') THEN [0, 1, 2, 3] ELSE o3 END AS o FROM d)
    SELECT p_partkey, array_to_string(list_transform(o, lambda p, i: SUBSTR('ABCD', i, 1) || '. ' || t[p + 1]), '|') AS options, SUBSTR('ABCD', CAST(list_position(list_transform(o, lambda p: t[p + 1]), t[correct]) AS INT), 1) AS correct FROM e""")
def _(part):
    """Options of questions about every part, dealt anew."""
    texts = F.array("p_type", "p_brand", "p_name", F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")))
    lettered = F.transform(texts, lambda t, k: F.concat(F.substring(F.lit("ABCD"), k + 1, F.lit(1)), F.lit(". "), t))
    correct = F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    why = F.when(F.col("p_size") % 7 == 0, "because option B fits").otherwise("because it fits")
    rows = part.select("p_partkey", F.col("p_name").alias("question"), lettered.alias("options"), correct.alias("correct"), why.alias("explanation"))
    return P.dealt_options(rows).select("p_partkey", F.array_join("options", "|").alias("options"), "correct")


@query("I47", "events", sql="""
    WITH k AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)
    SELECT event_id, 0 AS position, k FROM k WHERE event_id % 5 <> 4 UNION ALL SELECT event_id, 1, k + 1 FROM k WHERE event_id % 5 IN (1, 2)""")
def _(events):
    """The events' JSON found again in fences, lists, wrappers and cut-off text."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    more = F.to_json(F.struct((k + 1).alias("k")))
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).when(kind == 1, F.concat(F.lit("["), "props", F.lit(", "), more, F.lit("]")))
        .when(kind == 2, F.concat(F.lit('{"questions": ['), "props", F.lit(","), more, F.lit("]}"))).when(kind == 3, F.concat(F.lit("[ "), "props", F.lit(', {"k": 7, "broken')))
        .otherwise(F.concat(F.lit("nothing but {"), "event_type"))
    )
    return P.salvaged(events.select("event_id", text.alias("text")), "event_id", "text").select("event_id", "position", F.get_json_object("item", "$.k").cast("int").alias("k"))


@query("I48", "questions", sql="""
    SELECT paper_id, question_number AS id, 'Define ' || topic AS question_text, 'Q1' AS question_number, CAST(marks AS DOUBLE) AS marks, LOWER(question_type) AS question_type, CASE WHEN difficulty = 'O' THEN 'medium' ELSE LOWER(difficulty) END AS difficulty,
           CASE WHEN marks % 2 = 0 THEN topic || '|' || subject ELSE topic END AS concept_tags, LEAST(1.0, marks / 40.0) AS confidence FROM questions WHERE marks % 9 <> 0""")
def _(questions):
    """Every question as raw JSON, made clean; without a text it goes."""
    tags = F.when(F.col("marks") % 2 == 0, F.to_json(F.array("topic", "subject"))).otherwise(F.to_json(F.array(F.struct(F.col("topic").alias("name")))))
    raw = F.struct(
        F.when(F.col("marks") % 9 == 0, "  ").otherwise(F.concat(F.lit(" Define   "), "topic", F.lit("\n"))).alias("question"), F.concat(F.col("marks"), F.lit(" marks")).alias("marks"), F.col("question_type").alias("question_type"),
        F.when(F.col("difficulty") == "O", "").otherwise(F.col("difficulty")).alias("difficulty"), tags.alias("concept_tags"), (F.col("marks") / 40.0).cast("decimal(9,6)").cast("string").alias("confidence"),
    )
    out = P.clean_questions(questions.select("paper_id", F.col("question_number").alias("id"), F.lit(0).alias("position"), F.to_json(raw).alias("item")))
    return out.select("paper_id", "id", "question_text", "question_number", "marks", "question_type", "difficulty", "concept_tags", "confidence")


@query("H8", "part", sql="""
    SELECT p_partkey, SUBSTR(TRIM(regexp_replace('  ' || p_name || chr(10) || p_type || '  ', '\\s+', ' ', 'g')), 1, 20) AS text,
           CASE p_partkey % 4 WHEN 0 THEN TRIM(SUBSTR(p_name, 1, 12)) || '|' || TRIM(SUBSTR(p_type, 1, 12)) WHEN 1 THEN TRIM(SUBSTR(p_type, 1, 12)) || '|' || p_brand WHEN 2 THEN p_brand ELSE '' END AS items FROM part""")
def _(part):
    """Texts made clean, and lists out of lists, objects and single values."""
    k, brand = F.col("p_partkey") % 4, F.col("p_brand")
    raw = F.when(k == 0, F.to_json(F.array("p_name", F.lit("  "), F.col("p_type")))).when(k == 1, F.to_json(F.array(F.struct(F.col("p_type").alias("point")), F.struct(brand.alias("point"))))).when(k == 2, brand)
    text = F.concat(F.lit("  "), "p_name", F.lit("\n"), "p_type", F.lit("  "))
    return part.select("p_partkey", P.clean_text(text, 20).alias("text"), F.array_join(F.transform(P.text_list(raw, 5, 12), lambda x: F.trim(x)), "|").alias("items"))
