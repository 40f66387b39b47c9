"""Queries over papers, answers and weaknesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.operators import exams as E
from lumenary.operators.sessions import latest
from lumenary.operators import planning as P
from lumenary.operators.misc import grounded_facts
from lumenary.plans.bindings import LINE, tasks_for
from lumenary.plans.planning import _EDGES, _edges
from lumenary.plans.registry import query
from lumenary.runtime import dealt

_SHORT = ("N", "A")
_WEAK = """
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, subject, topic, weakness_type ORDER BY seen_at DESC, paper_id DESC, question_number DESC) AS rn FROM weakness_signals),
    weak AS (SELECT user_id, subject, topic, weakness_type, COUNT(*) AS frequency, MAX(seen_at) AS last_seen, MAX(CASE WHEN rn = 1 THEN suggestion END) AS suggestion,
                    STRING_AGG(CASE WHEN rn <= 8 THEN paper_id || '.' || question_number END, ',' ORDER BY rn DESC) AS evidence FROM k GROUP BY user_id, subject, topic, weakness_type)"""
_KW = "list_distinct(list_filter(regexp_extract_all(LOWER({0}), '[a-z0-9]+'), lambda w: LEN(w) > 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")))"
_EVAL = "SELECT l_orderkey * 10 + l_linenumber AS attempt_id, CAST(FLOOR(l_quantity) AS INT) % 3 AS missing_points, l_linenumber % 4 AS incorrect_points, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS weak_areas, l_tax * 10 AS exam_presentation, 1 - l_discount * 6 AS step_logic, FLOOR(l_quantity * 0.4) AS marks_awarded, l_quantity AS marks_total FROM lineitem"


@query("D30", "questions", sql="""
    WITH q AS (SELECT paper_id, COUNT(*) AS total_questions, CAST(CASE WHEN COUNT(marks) = COUNT(*) THEN SUM(marks) END AS DOUBLE) AS total_marks, COUNT(*) FILTER (question_type IN ('N', 'A')) AS short_answer, COUNT(*) FILTER (question_type NOT IN ('N', 'A')) AS long_answer FROM questions GROUP BY paper_id),
    m AS (SELECT paper_id, COALESCE(STRING_AGG(v || '=' || n, ',' ORDER BY v), '') AS marks FROM (SELECT paper_id, CAST(marks AS STRING) AS v, COUNT(*) AS n FROM questions GROUP BY 1, 2) x GROUP BY 1),
    t AS (SELECT paper_id, STRING_AGG(question_type || '=' || n, ',' ORDER BY question_type) AS types FROM (SELECT paper_id, question_type, COUNT(*) AS n FROM questions GROUP BY 1, 2) x GROUP BY 1),
    d AS (SELECT paper_id, STRING_AGG(difficulty || '=' || n, ',' ORDER BY difficulty) AS difficulties FROM (SELECT paper_id, difficulty, COUNT(*) AS n FROM questions GROUP BY 1, 2) x GROUP BY 1),
    f AS (SELECT paper_id, LOWER(topic) AS topic, COUNT(*) AS n, MIN(question_number) AS o FROM questions GROUP BY 1, 2), g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY paper_id ORDER BY n DESC, o) AS rn FROM f),
    h AS (SELECT paper_id, COALESCE(STRING_AGG(topic || '=' || n, ',' ORDER BY topic), '') AS topics, COALESCE(STRING_AGG(CASE WHEN n > 1 AND rn <= 20 THEN topic END, ',' ORDER BY rn), '') AS repeated, STRING_AGG(CASE WHEN rn <= 6 THEN topic END, ',' ORDER BY rn) AS frequent FROM g GROUP BY 1)
    SELECT * FROM q JOIN m USING (paper_id) JOIN t USING (paper_id) JOIN d USING (paper_id) JOIN h USING (paper_id)""")
def _(questions):
    return E.paper_totals(questions, _SHORT)


# per paper: its most common type as its style, its share of questions of over 5 marks as its confidence; all topics of a subject's papers
_PAPERS = """
    qs AS (SELECT paper_id, {key} AS k, question_number, marks, question_type, difficulty, LOWER(topic) AS topic FROM questions),
    pt AS (SELECT paper_id, k, topic, COUNT(*) AS n, MIN(question_number) AS o FROM qs GROUP BY 1, 2, 3), pp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY paper_id ORDER BY o, topic) - 1 AS pos FROM pt),
    tp AS (SELECT k, topic, SUM(n) AS n, ROW_NUMBER() OVER (PARTITION BY k ORDER BY SUM(n) DESC, MIN(paper_id * 1000 + pos)) AS rn FROM pp GROUP BY 1, 2),
    st AS (SELECT paper_id, k, question_type AS style, ROW_NUMBER() OVER (PARTITION BY paper_id ORDER BY COUNT(*) DESC, question_type) AS rn FROM qs GROUP BY 1, 2, 3),
    ss AS (SELECT k, LOWER(style) AS style, ROW_NUMBER() OVER (PARTITION BY k ORDER BY COUNT(*) DESC, MIN(paper_id)) AS rn FROM st WHERE rn = 1 GROUP BY 1, 2),
    pc AS (SELECT paper_id, k, SUM(CASE WHEN marks > 5 THEN 1 ELSE 0 END) / COUNT(*) AS c, COUNT(*) AS n, SUM(marks) AS m FROM qs GROUP BY 1, 2),
    tot AS (SELECT k, COUNT(*) AS papers, CAST(SUM(n) AS BIGINT) AS total_questions, CAST(SUM(m) AS DOUBLE) AS total_marks, ROUND(AVG(c), 3) AS confidence FROM pc GROUP BY 1),
    l1 AS (SELECT k, STRING_AGG(v || '=' || n, ',' ORDER BY v) AS marks FROM (SELECT k, CAST(marks AS STRING) AS v, COUNT(*) AS n FROM qs GROUP BY 1, 2) x GROUP BY 1),
    l2 AS (SELECT k, STRING_AGG(v || '=' || n, ',' ORDER BY v) AS types FROM (SELECT k, question_type AS v, COUNT(*) AS n FROM qs GROUP BY 1, 2) x GROUP BY 1),
    l3 AS (SELECT k, STRING_AGG(v || '=' || n, ',' ORDER BY v) AS difficulties FROM (SELECT k, difficulty AS v, COUNT(*) AS n FROM qs GROUP BY 1, 2) x GROUP BY 1),
    l4 AS (SELECT k, COALESCE(STRING_AGG(CASE WHEN n > 1 AND rn <= 25 THEN topic END, ',' ORDER BY rn), '') AS repeated, STRING_AGG(CASE WHEN rn <= {top} THEN topic END, ',' ORDER BY rn) AS frequent FROM tp GROUP BY 1),
    merged AS (SELECT tot.*, marks, types, difficulties, repeated, frequent, style FROM tot JOIN l1 USING (k) JOIN l2 USING (k) JOIN l3 USING (k) JOIN l4 USING (k) JOIN ss ON ss.k = tot.k AND ss.rn = 1)"""


@query("D31", "questions", sql=f"WITH {_PAPERS.format(key=1, top=8)} SELECT papers, total_questions, total_marks, confidence, marks, types, difficulties, repeated, frequent, style FROM merged")
def _(questions):
    """All papers as one pattern."""
    return E.paper_patterns(questions, [])


@query("D31_repeated", "questions", sql="""
    WITH f AS (SELECT LOWER(topic) AS topic, COUNT(*) AS n, MIN(paper_id * 100000000 + question_number) AS o FROM questions GROUP BY 1) SELECT topic, n FROM f WHERE n > 1 ORDER BY n DESC, o LIMIT 25""")
def _(questions):
    return E.cross_repeated(questions)


@query("D32", "questions", sql=f"WITH {_PAPERS.format(key='subject', top=6)} SELECT k AS subject, papers, total_questions, total_marks, confidence, marks, types, difficulties, repeated, frequent, style FROM merged")
def _(questions):
    """Each subject's papers as one pattern, with the six most frequent topics."""
    subject = F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.lit("Unspecified subject"))
    return E.paper_patterns(questions.withColumn("subject", subject), ["subject"], frequent=6)


@query("D33", "questions", sql="""
    SELECT subject, topic AS mode, n FROM (SELECT subject, topic, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY subject ORDER BY COUNT(*) DESC, MIN(paper_id * 100000000 + question_number)) AS rn FROM questions GROUP BY subject, topic) x WHERE rn = 1""")
def _(questions):
    return E.mode(questions, "subject", "topic", F.struct("paper_id", "question_number"))


@query("D34", "questions", sql="SELECT COUNT(DISTINCT paper_id) AS papers, COUNT(*) AS questions, STRING_AGG(DISTINCT subject, ',' ORDER BY subject) AS subjects, (SELECT STRING_AGG(paper_id, ',' ORDER BY paper_id DESC) FROM (SELECT DISTINCT paper_id FROM questions ORDER BY 1 DESC LIMIT 10) x) AS latest FROM questions")
def _(questions):
    return E.inventory(questions)


@query("D28", "weakness_signals", sql=f"WITH {_WEAK} SELECT * FROM weak")
def _(signals):
    return E.weaknesses(signals)


@query("D29", "weakness_signals", sql=f"""
    WITH {_WEAK}, t AS (SELECT user_id, topic, weakness_type, CAST(SUM(frequency) AS BIGINT) AS n FROM weak GROUP BY 1, 2, 3),
    a AS (SELECT user_id, topic, CAST(SUM(n) AS BIGINT) AS total, STRING_AGG(weakness_type, ',' ORDER BY n DESC, weakness_type) AS types FROM t GROUP BY 1, 2),
    s AS (SELECT user_id, topic, suggestion, ROW_NUMBER() OVER (PARTITION BY user_id, topic ORDER BY last_seen DESC, weakness_type DESC, subject DESC) AS rn FROM weak)
    SELECT a.*, suggestion FROM a JOIN s USING (user_id, topic) WHERE rn = 1""")
def _(signals):
    return E.weakness_topics(E.weaknesses(signals))


@query("F6", "weakness_signals", sql=f"WITH {_WEAK} SELECT * FROM weak ORDER BY frequency DESC, last_seen DESC, user_id, subject, topic, weakness_type LIMIT 200")
def _(signals):
    return E.weakness_report(E.weaknesses(signals), 200)


@query("C4", "attempts", "feedback", sql="""
    WITH l AS (SELECT attempt_id, arg_max(marks_awarded, id) AS marks_awarded, arg_max(marks_total, id) AS marks_total FROM feedback GROUP BY attempt_id)
    SELECT id, user_id, topic, marks_awarded, ROUND(COALESCE(100.0 * marks_awarded / NULLIF(l.marks_total, 0), 0.0), 4) AS percentage FROM attempts a LEFT JOIN l ON l.attempt_id = a.id""")
def _(attempts, feedback):
    return E.latest_feedback(attempts, feedback)


@query("C3", "attempts", "feedback", sql="SELECT f.id, attempt_id, user_id, topic, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY f.id) AS step FROM feedback f JOIN attempts a ON a.id = f.attempt_id")
def _(attempts, feedback):
    return E.replay(feedback, attempts)


@query("D48", "orders", "attempts", sql="SELECT o_orderkey AS session_id, COALESCE(n, 0) AS attempts FROM orders LEFT JOIN (SELECT session_id, COUNT(*) AS n FROM attempts GROUP BY 1) x ON session_id = o_orderkey")
def _(orders, attempts):
    return E.attempt_counts(orders.select(F.col("o_orderkey").alias("session_id")), attempts)


@query("I30", "conversations", "benchmark", sql=f"""
    WITH a AS (SELECT conv_id * 100 + turn AS attempt_id, conv_id, {_KW.format('text')} AS ak FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, {_KW.format('text')} AS pk FROM conversations WHERE role = 'user'),
    g AS (SELECT attempt_id, COUNT(*) FILTER (LEN(list_intersect(pk, ak)) / GREATEST(1, LEN(pk)) >= 0.34) AS covered, COUNT(*) AS points FROM a JOIN p USING (conv_id) GROUP BY attempt_id)
    SELECT attempt_id, covered, points, ROUND(covered / points * 5.0, 4) AS marks_awarded FROM g""")
def _(conversations, benchmark):
    """Answers graded by the points that the questions name."""
    key = (F.col("conv_id") * 100 + F.col("turn")).alias("attempt_id")
    answers = conversations.where("role = 'assistant'").select("conv_id", key, F.lit(5.0).alias("marks_total"), F.col("text").alias("answer"))
    points = answers.select("conv_id", "attempt_id").join(conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("point_no"), F.col("text").alias("point")), "conv_id")
    return E.lexical_grades(answers, points)


@query("I31", "lineitem", sql=f"""
    WITH e AS ({_EVAL}), f AS (SELECT *, list_filter([CASE WHEN missing_points > 0 THEN 'missing_key_points' END, CASE WHEN incorrect_points > 0 THEN 'concept_gap' END, CASE WHEN weak_areas > 0 THEN 'clarity' END, CASE WHEN exam_presentation < 0.5 THEN 'presentation' END, CASE WHEN step_logic < 0.5 THEN 'step_logic' END], lambda x: x IS NOT NULL) AS flags FROM e)
    SELECT attempt_id, UNNEST(flags) AS weakness_type FROM f UNION ALL SELECT attempt_id, 'incomplete' FROM f WHERE LEN(flags) = 0 AND marks_total > 0 AND marks_awarded / marks_total < 0.5""")
def _(lineitem):
    q = F.col("l_quantity")
    return E.derived_signals(lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt_id"), (F.floor(q).cast("int") % 3).alias("missing_points"), (F.col("l_linenumber") % 4).alias("incorrect_points"), (F.col("l_discount") > 0.08).cast("int").alias("weak_areas"), (F.col("l_tax") * 10).alias("exam_presentation"), (1 - F.col("l_discount") * 6).alias("step_logic"), F.floor(q * 0.4).alias("marks_awarded"), q.alias("marks_total")))


@query("I38", "units", "lineitem", "orders", sql=f"""
    WITH RECURSIVE {_EDGES}, c AS (SELECT unit_id, prereq_id FROM edges UNION SELECT c.unit_id, e.prereq_id FROM c JOIN edges e ON e.unit_id = c.prereq_id),
    a AS (SELECT o_custkey AS user_id, unit_id, p_partkey AS question_id, l_linenumber % 4 AS choice FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN units ON p_partkey = l_partkey),
    g AS (SELECT user_id, unit_id, COUNT(*) AS answered, COUNT(*) FILTER (choice = question_id % 4) AS correct, 100.0 * COUNT(*) FILTER (choice = question_id % 4) / COUNT(*) AS acc FROM a GROUP BY 1, 2),
    b AS (SELECT g.user_id, g.unit_id, COALESCE(MIN(CASE WHEN d.user_id IS NULL THEN c.prereq_id END), MIN(c.prereq_id)) AS branch_to FROM g JOIN c ON c.unit_id = g.unit_id LEFT JOIN g d ON d.user_id = g.user_id AND d.unit_id = c.prereq_id AND d.acc >= 80 WHERE g.acc < 60 GROUP BY 1, 2)
    SELECT g.user_id, g.unit_id, answered, correct, ROUND(acc, 4) AS accuracy, CASE WHEN acc >= 80 THEN 'mastered' WHEN branch_to IS NOT NULL THEN 'prerequisite_gap' ELSE 'practise' END AS outcome, branch_to FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.unit_id = g.unit_id""")
def _(units, lineitem, orders):
    """Batch grading with branches to direct and indirect prerequisites; every receipt is sent twice and counts once."""
    tasks = tasks_for(lineitem)
    rows = dealt(lineitem, tasks, "l_orderkey").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    a = rows.select(F.col("l_orderkey").alias("paper_id"), F.expr(LINE).alias("interaction_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("question_id"), F.expr("CAST(l_linenumber % 4 AS TINYINT)").alias("choice"))
    key = units.select(F.col("p_partkey").alias("question_id"), "unit_id", F.expr("CAST(p_partkey % 4 AS TINYINT)").alias("answer"))
    twice = a.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")  # a receipt's copies lie by its paper
    return E.graded_mcqs(twice, key, P.closure(_edges(units)), ("paper_id", "interaction_id"), tasks)


@query("I50_facts", "documents")
def _(documents):
    """Five questions on every text with facts, out of its own words; held against a plain version in tests."""
    facts = grounded_facts(documents).join(documents.select("doc_id", "source"), "doc_id")
    return E.fact_questions(facts, F.col("source"))


@query("I50", "questions", sql="""
    WITH c AS (SELECT subject, topic, ROW_NUMBER() OVER (PARTITION BY subject ORDER BY COUNT(*) DESC, topic) AS rn FROM questions GROUP BY 1, 2)
    SELECT subject, rn AS position, REPLACE(['Define {} with an example.', 'Explain {} step by step.', 'Compare the main cases of {}.', 'Solve a problem on {}.'][(rn - 1) % 4 + 1], '{}', topic) AS question, CASE WHEN rn <= 2 THEN 'high' ELSE 'medium' END AS priority FROM c WHERE rn <= 6""")
def _(questions):
    return E.generated_questions(questions)


@query("F11", "questions", also="F11_all", sql="SELECT user_id, paper_id, question_number, total FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS total, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY paper_id DESC, question_number DESC) AS rn FROM questions WHERE subject = '1-URGENT') x WHERE rn <= 20")
def _(questions):
    """Each owner's first page of questions of a subject, newest first, with the owner's total."""
    mine = questions.where("subject = '1-URGENT'").select("user_id", "paper_id", "question_number")
    page = latest(mine, ["user_id"], [F.desc("paper_id"), F.desc("question_number")], 20)
    return page.join(mine.groupBy("user_id").agg(F.count("*").alias("total")), "user_id").select("user_id", "paper_id", "question_number", "total")
