"""Queries of mastery and of what comes next."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import mastery as M
from lumenary.operators import misc
from lumenary.operators import planning as P
from lumenary.plans.bindings import order_lines, tasks_for
from lumenary.plans.content import _KEY
from lumenary.plans.planning import _ALIASES, _EDGES, _EVIDENCE, _MINUTES, _STATUS, _aliases, _edges, _placed_status, _timed
from lumenary.plans.registry import query
from lumenary.runtime import checkpointed

_STATES = """
    e AS (SELECT o_custkey AS user_id, unit_id, l_linenumber % 3 <> 0 AS canonical, l_linenumber AS attempts, l_quantity * 2 AS accuracy, CASE l_returnflag WHEN 'R' THEN 'revision' WHEN 'A' THEN 'exam' ELSE 'study' END AS kind, l_discount * 1000 AS confidence, l_shipdate AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN units ON l_partkey = p_partkey),
    st AS (SELECT o_custkey AS user_id, unit_id, CASE MAX(p_partkey) % 3 WHEN 0 THEN 'mastered' WHEN 1 THEN 'learning' ELSE 'practising' END AS status, COUNT(*) - 1 AS evidence_count, MAX(l_quantity) * 2 AS mastery_score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN units ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1, 2),
    b AS (SELECT user_id, unit_id, SUM(accuracy * GREATEST(1, attempts)) / SUM(GREATEST(1, attempts)) AS mean, SUM(CASE WHEN canonical AND attempts > 0 THEN attempts END) AS own_attempts, SUM(CASE WHEN canonical AND attempts > 0 THEN accuracy * attempts END) / SUM(CASE WHEN canonical AND attempts > 0 THEN attempts END) AS own_mean,
          (LIST(accuracy ORDER BY seen DESC, accuracy DESC) FILTER (canonical AND attempts > 0))[1] AS last, COALESCE(BOOL_OR(canonical AND kind = 'revision'), FALSE) AS recall, COALESCE(BOOL_OR(canonical AND kind = 'exam'), FALSE) AS practice, AVG(confidence) FILTER (canonical) AS sure FROM e GROUP BY 1, 2),
    j AS (SELECT COALESCE(b.user_id, st.user_id) AS user_id, COALESCE(b.unit_id, st.unit_id) AS unit_id, b.* EXCLUDE (user_id, unit_id), st.* EXCLUDE (user_id, unit_id) FROM b FULL JOIN st ON b.user_id = st.user_id AND b.unit_id = st.unit_id),
    w AS (SELECT j.*, difficulty % 3 + 1 AS required, COALESCE(evidence_count, 0) AS n FROM j JOIN units USING (unit_id)),
    x AS (SELECT *, CASE WHEN status <> 'mastered' THEN status WHEN n >= required AND mastery_score >= 80 THEN 'mastered' WHEN n > 0 THEN 'practising' WHEN status = 'mastered' THEN 'learning' ELSE 'not_started' END AS before, 1 + CAST(n > 0 AS INT) + CAST(COALESCE(recall, FALSE) AS INT) + CAST(COALESCE(practice, FALSE) AS INT) + CAST(COALESCE(sure >= 70, FALSE) AS INT) AS kinds FROM w)"""


@query("I33", "units", "lineitem", "orders", sql=f"WITH {_STATES} SELECT user_id, unit_id, CASE WHEN mean IS NULL THEN before WHEN last < 60 THEN 'needs_review' WHEN COALESCE(own_attempts, 0) >= required AND own_mean >= 80 AND kinds >= 2 THEN 'mastered' WHEN mean < 60 THEN 'needs_review' WHEN before = 'mastered' THEN 'mastered' ELSE 'practising' END AS status FROM x")
def _(units, lineitem, orders):
    """Unit states from stored ones and evidence."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(units, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("o_custkey", "user_id")
    kind = F.when(F.col("l_returnflag") == "R", "revision").when(F.col("l_returnflag") == "A", "exam").otherwise("study")
    evidence = rows.select("user_id", "unit_id", (F.col("l_linenumber") % 3 != 0).alias("canonical"), F.col("l_linenumber").alias("attempts"), (F.col("l_quantity") * 2).alias("accuracy"), kind.alias("kind"), (F.col("l_discount") * 1000).alias("confidence"), F.col("l_shipdate").alias("seen"))
    state = F.when(F.max("p_partkey") % 3 == 0, "mastered").when(F.max("p_partkey") % 3 == 1, "learning").otherwise("practising")
    stored = rows.where("l_linestatus = 'F'").groupBy("user_id", "unit_id").agg(state.alias("status"), (F.count("*") - 1).alias("evidence_count"), (F.max("l_quantity") * 2).alias("mastery_score"))
    return M.unit_states(units.select("unit_id", (F.col("difficulty") % 3 + 1).alias("required")), evidence, stored)


_LV = lambda c, t: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " END"


@query("F9", "units", "lineitem", "orders", sql=f"""
    WITH {_EVIDENCE}, {_STATUS}, {_EDGES}, {_MINUTES}, m AS (SELECT user_id, unit_id FROM status WHERE status = 'mastered'), s AS (SELECT DISTINCT user_id, chapter FROM status JOIN units USING (unit_id)),
    o AS (SELECT s.user_id, s.chapter, arg_min(u.unit_id, u.unit_order) AS unit_id FROM s JOIN units u ON u.chapter = s.chapter LEFT JOIN m ON m.user_id = s.user_id AND m.unit_id = u.unit_id WHERE m.unit_id IS NULL GROUP BY 1, 2),
    n AS (SELECT o.user_id, o.chapter, MIN(e.prereq_id) AS prereq_id FROM o JOIN edges e ON e.unit_id = o.unit_id LEFT JOIN m ON m.user_id = o.user_id AND m.unit_id = e.prereq_id WHERE m.unit_id IS NULL GROUP BY 1, 2),
    f AS (SELECT o.user_id, o.chapter, COALESCE(prereq_id, unit_id) AS unit_id FROM o LEFT JOIN n ON n.user_id = o.user_id AND n.chapter = o.chapter),
    g AS (SELECT user_id, chapter, COUNT(*) FILTER (status IN ('learning', 'practising')) AS active, COUNT(*) FILTER (status = 'mastered') AS done FROM status JOIN units USING (unit_id) GROUP BY 1, 2),
    k AS (SELECT f.user_id, f.chapter, f.unit_id, CAST({_LV("COALESCE(status.status, 'not_started')", M.STATUS_SCORES)} + LEAST(80, active * 24 + done * 8) + {_LV('importance', M.IMPORTANCE_SCORES)} + {_LV('exam_relevance', M.EXAM_SCORES)} AS BIGINT) AS score
          FROM f JOIN timed_units t ON t.unit_id = f.unit_id LEFT JOIN status ON status.user_id = f.user_id AND status.unit_id = f.unit_id JOIN g ON g.user_id = f.user_id AND g.chapter = f.chapter)
    SELECT user_id, chapter, unit_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, chapter) AS rn FROM k) y WHERE rn = 1""")
def _(units, lineitem, orders):
    """Each learner's best chapter to go on with."""
    status, tasks = checkpointed(_placed_status(units, lineitem, orders)), tasks_for(lineitem)
    return M.next_chapters(_timed(units), P.next_units(units, _edges(units), status, tasks), status, tasks)


@query("D35", "units", "lineitem", "orders", sql=f"""
    WITH {_ALIASES}, t AS (SELECT o_custkey AS user_id, CASE WHEN l_linenumber % 2 = 0 THEN UPPER(unit_id) ELSE chapter || ' - ' || unit_order END AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN units ON l_partkey = p_partkey WHERE l_returnflag = 'R')
    SELECT user_id, unit_id, COUNT(*) AS events FROM t JOIN aliases ON alias = {_KEY.format('topic')} GROUP BY 1, 2""")
def _(units, lineitem, orders):
    """Study events of each learner and unit, by any of the unit's names."""
    again = lineitem.where("l_returnflag = 'R'")
    rows = order_lines(again, orders, units)
    topic = F.when(F.col("l_linenumber") % 2 == 0, F.upper("unit_id")).otherwise(F.concat_ws(" - ", "chapter", F.col("unit_order").cast("string")))
    return misc.exposure(rows.select(F.col("o_custkey").alias("user_id"), topic.alias("topic")), _aliases(units), tasks_for(again))


@query("D37", "sessions", sql="""
    WITH g AS (SELECT user_id, topic, COUNT(*) AS observations, COUNT(*) FILTER (score < 3) AS support_count, LIST(accuracy_rate ORDER BY completed_at, id) AS xs, (LIST(score < 3 ORDER BY completed_at, id))[-1] AS last FROM sessions GROUP BY 1, 2),
    f AS (SELECT *, list_reduce(list_transform(xs, lambda x, i: {'n': i, 'x': x}), lambda a, b: {'n': b.n, 'x': FLOOR(((CASE WHEN a.x = 0 THEN b.x ELSE a.x END) * (b.n - 1) + b.x) / b.n * 10 + 0.5) / 10}).x AS mean FROM g)
    SELECT user_id, topic, observations, support_count, mean AS average_confidence, CASE WHEN last THEN 'concept_watch' ELSE 'concept_learning' END AS memory_type,
           ROUND(CASE WHEN observations = 1 THEN CASE WHEN last THEN 0.68 ELSE 0.56 END ELSE LEAST(1.0, 0.55 + support_count * 0.08 + observations * 0.02) END, 4) AS importance, ROUND(LEAST(1.0, GREATEST(0.35, mean / 100)), 4) AS confidence FROM f""")
def _(sessions):
    """What is remembered of every learner and topic."""
    return M.concept_memory(sessions.select("user_id", "topic", "id", F.col("completed_at").alias("seen"), (F.col("score") < 3).alias("needs_support"), F.col("accuracy_rate").alias("confidence")))
