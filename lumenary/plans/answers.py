"""Queries of answer quality and likeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import answers as A
from lumenary.plans.registry import query

_Q = lambda x: "'" + x.replace("'", "''") + "'"
_STRIP = "regexp_replace(COALESCE({0}, ''), '^\\s+|\\s+$', '', 'g')"
_IN = lambda text, parts: "(" + " + ".join(f"CASE WHEN contains({text}, {_Q(p)}) THEN 1 ELSE 0 END" for p in parts) + ")"
_NO = ", ".join(map(_Q, A.NO_TERMS))
_WORDS = "list_filter(regexp_extract_all(LOWER(COALESCE({0}, '')), '[a-z][a-z0-9_-]+'), lambda w: LEN(w) >= 4 AND w NOT IN (" + _NO + "))"
_DISTINCT = "list_filter({0}, lambda w, i: list_position({0}, w) = i)[1:18]"
_OVER = "CASE WHEN LEN({0}) = 0 THEN {1} ELSE LEAST(1.0, LEN(list_filter({0}, lambda w: contains(low, w))) / LEAST(LEN({0}), 8)) END"
_INTENT = " ".join(f"WHEN format = '{k}' THEN LEAST(1.0, 0.58 + {_IN('low', v)} * 0.12)" for k, v in A.HINTS.items())
_DIMS = [k for k in A.WEIGHTS if k != "risk"]


@query("I24", "answers", sql=f"""
    WITH a AS (SELECT *, {_STRIP.format('answer')} AS a, LOWER({_STRIP.format('answer')}) AS low, {_STRIP.format('context')} AS c, {_WORDS.format('question')} AS q0, {_WORDS.format('context')} AS c0 FROM answers),
    b AS (SELECT *, {_DISTINCT.format('q0')} AS qt, {_DISTINCT.format('c0')} AS ct, contains(low, {_Q(A.NOT_FOUND)}) AS gone, format = 'conversation' AS talk, LEN(string_split(a, chr(10))) AS lines,
          regexp_extract_all(a, '[A-Za-z0-9]+') AS words, LEN(list_filter(string_split_regex(a, '[.!?]+'), lambda s: {_STRIP.format('s')} <> '')) AS sentences FROM a),
    m AS (SELECT *, LEN(words) / GREATEST(1, sentences) AS mean FROM b),
    d0 AS (SELECT conv_id, turn, a, c, low, gone, talk, {_OVER.format('qt', 'CASE WHEN talk THEN 0.9 ELSE 0.72 END')} AS relevance, {_OVER.format('ct', '0.55')} AS grounding, CASE WHEN talk THEN 1.0 ELSE LEAST(1.0, LENGTH(a) / 420) END AS completeness,
          CASE WHEN talk OR lines >= 3 THEN 0.94 ELSE 0.76 END AS clarity, CASE WHEN LENGTH(a) <= 4500 THEN 0.94 ELSE 0.68 END AS friendliness, CASE WHEN talk THEN 1.0 WHEN lines > 1 THEN 0.92 ELSE 0.74 END AS formatting,
          CASE WHEN talk THEN CASE WHEN LEN(list_filter(string_split_regex(a, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 80 THEN 1.0 ELSE 0.72 END {_INTENT} ELSE 0.78 END AS intent,
          CASE WHEN LEN(words) = 0 THEN 0.0 ELSE CASE WHEN mean <= 22 THEN 0.94 WHEN mean <= 32 THEN 0.82 WHEN mean <= 42 THEN 0.68 ELSE 0.5 END - CASE WHEN list_max(list_transform(words, lambda w: LEN(w))) > 28 THEN 0.08 ELSE 0.0 END END AS readability FROM m),
    d AS (SELECT conv_id, turn, a, c, low, gone, talk, {", ".join(f"CAST(CASE WHEN a = '' THEN 0.0 WHEN gone THEN 1.0 ELSE {k} END AS DOUBLE) AS {k}" for k in _DIMS)} FROM d0),
    r AS (SELECT *, {_IN('low', A.MARKERS)} > 0 AS marked, c = '' AND NOT gone AS bare, grounding < 0.2 AND NOT gone AS loose FROM d),
    s AS (SELECT *, CAST(CASE WHEN a = '' THEN 1.0 ELSE LEAST(1.0, CASE WHEN marked THEN 0.45 ELSE 0 END + CASE WHEN bare THEN 0.7 ELSE 0 END + CASE WHEN loose THEN 0.25 ELSE 0 END) END AS DOUBLE) AS risk FROM r),
    t AS (SELECT *, CASE WHEN a = '' THEN 0.0 ELSE ROUND(GREATEST(0.0, LEAST(1.0, ROUND({" + ".join(f"{k} * CAST({w} AS DOUBLE)" for k, w in A.WEIGHTS.items())}, 6))), 2) END AS score,
          CASE WHEN a = '' THEN 'empty_answer' ELSE array_to_string(list_filter([CASE WHEN marked THEN 'hallucination_marker' END, CASE WHEN bare THEN 'unsupported_without_retrieval' END, CASE WHEN loose THEN 'low_grounding_overlap' END, CASE WHEN LENGTH(a) < 20 AND NOT talk THEN 'answer_too_short' END, CASE WHEN readability < 0.6 THEN 'hard_to_read' END, CASE WHEN intent < 0.62 THEN 'intent_may_be_unsatisfied' END], lambda x: x IS NOT NULL), ',') END AS issues FROM s)
    SELECT conv_id, turn, {", ".join(f"ROUND({k}, 4) AS {k}" for k in A.WEIGHTS)}, score, issues, score >= 0.62 AND risk < 0.65 AND NOT contains(issues, 'answer_too_short') AND a <> '' AS passed FROM t""")
def _(answers):
    """Quality of every answer to the turn before it, against the conversation's first text."""
    out = A.scored(answers)
    return out.select("conv_id", "turn", *(F.round(k, 4).alias(k) for k in A.WEIGHTS), "score", "issues", "passed")


@query("I25", "answers", sql=f"""
    WITH a AS (SELECT conv_id, turn, mode, COALESCE(answer, '') AS a, LOWER(COALESCE(answer, '')) AS low FROM answers),
    b AS (SELECT *, LENGTH({_STRIP.format('a')}) < 20 AS short, {" + ".join(f"CASE WHEN regexp_matches(a, {_Q(p)}) THEN 1 ELSE 0 END" for p in A.BROKEN)} AS broken, (LENGTH(a) - LENGTH(REPLACE(a, '- ', ''))) / 2 AS bullets, (LENGTH(a) - LENGTH(REPLACE(a, '• ', ''))) / 2 AS dots, {_IN('low', A.PHRASES)} AS said FROM a),
    c AS (SELECT *, CASE WHEN mode = 'summary' AND bullets < 4 OR mode = 'explain' AND LENGTH(a) < 150 OR mode = 'keypoints' AND bullets + dots < 3 THEN 0.2 WHEN mode = 'exam' AND NOT contains(a, 'Q') AND NOT contains(low, 'question') THEN 0.3 END AS lacks FROM b),
    s AS (SELECT *, ROUND(GREATEST(0.0, LEAST(1.0, ROUND(1 - CASE WHEN short THEN 0.5 ELSE 0 END - broken * 0.15 - COALESCE(lacks, 0) - said * 0.3, 6))), 2) AS score FROM c)
    SELECT conv_id, turn, mode, score, CAST(CAST(short AS INT) + broken + CAST(lacks IS NOT NULL AS INT) + said AS INT) AS issues, score >= 0.5 AND NOT short AS passed FROM s""")
def _(answers):
    """Rule checks of every answer."""
    return A.checked(answers).select("conv_id", "turn", "mode", "score", "issues", "passed")


@query("I13", "answers")
def _(answers):
    """Likeness of every turn to the one before it; held against a plain version in tests."""
    return A.pair_likeness(answers.select("conv_id", "turn", "question", "answer"), "question", "answer").select("conv_id", "turn", "likeness")


@query("C12", "conversations", "benchmark")
def _(conversations, benchmark):
    """The five likest texts of the bank for every user turn; held against all pairs in tests."""
    messages = conversations.where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), "text").withColumn("message_id", F.concat_ws(":", "id.conv_id", "id.turn")).drop("id")
    return A.bank_matches(messages, benchmark.select(F.col("item_id").alias("bank_id"), "text"))
