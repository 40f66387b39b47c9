"""Queries over curriculum units and learners' evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import planning as P
from lumenary.plans.bindings import AS_OF, CHAPTER, order_lines, tasks_for
from lumenary.plans.content import _KEY
from lumenary.plans.registry import query
from lumenary.runtime import checkpointed, dealt

_ALIASES = f"aliases AS (SELECT DISTINCT {_KEY.format('n')} AS alias, unit_id FROM (SELECT unit_id, UNNEST([title, chapter || ' ' || CAST(unit_order AS STRING), unit_id]) AS n FROM units) x)"
_EDGES = "edges AS (SELECT u.unit_id, p.unit_id AS prereq_id FROM units u JOIN units p ON u.chapter = p.chapter AND p.unit_order = CAST(FLOOR(u.unit_order / 2) AS BIGINT))"
_EVIDENCE = "evidence AS (SELECT o_custkey AS user_id, unit_id, l_linenumber AS attempts, l_quantity * 2 AS accuracy FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN units ON l_partkey = p_partkey)"
_STATUS = "st AS (SELECT user_id, unit_id, SUM(attempts) AS attempts, SUM(accuracy * attempts) / NULLIF(SUM(attempts), 0) AS acc FROM evidence GROUP BY 1, 2), status AS (SELECT user_id, unit_id, CAST(attempts AS BIGINT) AS attempts, ROUND(acc, 4) AS accuracy, CASE WHEN attempts = 0 THEN 'not_started' WHEN acc < 60 THEN 'needs_review' WHEN attempts >= 3 AND acc >= 80 THEN 'mastered' ELSE 'practising' END AS status FROM st)"
_TIMED = "timed AS (SELECT *, CASE difficulty % 4 WHEN 0 THEN 'very_high' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' ELSE 'low' END AS importance, CASE difficulty % 3 WHEN 0 THEN 'foundation' WHEN 1 THEN 'steady' ELSE 'challenging' END AS hardness, CASE p_partkey % 4 WHEN 0 THEN 'very_high' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' ELSE 'low' END AS exam_relevance, CASE p_partkey % 3 WHEN 0 THEN 'overview' WHEN 1 THEN 'working' ELSE 'mastery' END AS depth, CASE p_partkey % 5 WHEN 0 THEN 'new_to_it' WHEN 1 THEN 'know_the_basics' ELSE 'confident' END AS proficiency, 10 + CAST(difficulty % 3 AS INT) * 5 AS min_minutes, 30 + CAST(difficulty % 2 AS INT) * 10 AS max_minutes FROM units)"
_LV = lambda c, t: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " END"
_EXTRA = " + ".join((_LV("importance", {"very_high": 7, "high": 4, "moderate": 2, "low": 0}), _LV("hardness", {"foundation": 0, "steady": 3, "challenging": 7}), _LV("exam_relevance", {"very_high": 5, "high": 3, "moderate": 1, "low": 0}), _LV("depth", {"overview": 0, "working": 3, "mastery": 6})))
_MINUTES = f"{_TIMED}, ex AS (SELECT *, {_EXTRA} AS extra FROM timed), sc AS (SELECT *, LEAST(max_minutes, min_minutes + GREATEST(0, CASE proficiency WHEN 'new_to_it' THEN extra + 4 WHEN 'know_the_basics' THEN round_even(extra * 0.55, 0) ELSE round_even(extra * 0.32, 0) END)) AS target FROM ex), timed_units AS (SELECT * EXCLUDE (target, extra), CAST(GREATEST(min_minutes, LEAST(max_minutes, CAST(round_even(target / 5.0, 0) * 5 AS INT))) AS INT) AS minutes FROM sc)"


def _timed(units):
    of = lambda c, n, names: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col(c) % n + 1).cast("int"))
    four = ("very_high", "high", "moderate", "low")
    return units.withColumns({"importance": of("difficulty", 4, four), "hardness": of("difficulty", 3, ("foundation", "steady", "challenging")), "exam_relevance": of("p_partkey", 4, four), "depth": of("p_partkey", 3, ("overview", "working", "mastery")), "proficiency": of("p_partkey", 5, ("new_to_it", "know_the_basics", "confident", "confident", "confident")), "min_minutes": (10 + (F.col("difficulty") % 3) * 5).cast("int"), "max_minutes": (30 + (F.col("difficulty") % 2) * 10).cast("int")})


def _aliases(units):
    return P.alias_index(units.withColumn("numbered", F.concat_ws(" ", "chapter", F.col("unit_order").cast("string"))), "title", "numbered", "unit_id")


def _edges(units):
    a = units.select("unit_id", "chapter", F.floor(F.col("unit_order") / 2).alias("unit_order"))
    return a.join(units.select(F.col("unit_id").alias("prereq_id"), "chapter", "unit_order"), ["chapter", "unit_order"]).select("unit_id", "prereq_id")


def _evidence(units, lineitem, orders, *more):
    """Evidence, with more columns of its unit; many lines are dealt to more tasks, by learner."""
    rows = order_lines(lineitem, orders, units).select(F.col("o_custkey").alias("user_id"), "unit_id", F.col("l_linenumber").alias("attempts"), (F.col("l_quantity") * 2).alias("accuracy"), *more)
    return dealt(rows, tasks_for(lineitem), "user_id")


def _placed_status(units, lineitem, orders):
    return P.unit_status(units, _evidence(units, lineitem, orders, "chapter", "unit_order")).drop("attempts", "accuracy")


@query("C18", "units", sql=f"WITH {_ALIASES} SELECT alias, COUNT(*) AS units, MIN(unit_id) AS first_unit, COUNT(*) > 1 AS ambiguous FROM aliases GROUP BY alias")
def _(units):
    return P.ownership(_aliases(units))


@query("C9", "units", "part", sql=f"WITH {_ALIASES} SELECT p_partkey, topic, unit_id FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN UPPER(p_name) ELSE {CHAPTER} || '-' || CAST(p_size AS STRING) END AS topic FROM part) e JOIN aliases ON alias = {_KEY.format('topic')}")
def _(units, part):
    topic = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat_ws("-", F.expr(CHAPTER), F.col("p_size").cast("string")))
    return P.matched_units(part.select("p_partkey", topic.alias("topic")), _aliases(units))


@query("C19", "units", "part", sql=f"""
    WITH r AS (SELECT p_partkey AS request_id, {_KEY.format("CASE p_partkey % 3 WHEN 0 THEN p_brand || ':' || p_partkey WHEN 1 THEN p_name ELSE CHAPTER || ' ' || p_size END".replace('CHAPTER', CHAPTER))} AS alias FROM part),
    t AS (SELECT {_KEY.format('unit_id')} AS alias, unit_id, 0 AS priority FROM units UNION ALL SELECT {_KEY.format('title')}, unit_id, 1 FROM units UNION ALL SELECT {_KEY.format("chapter || ' ' || unit_order")}, unit_id, 2 FROM units),
    b AS (SELECT request_id, priority, COUNT(DISTINCT unit_id) AS n, MIN(unit_id) AS unit_id FROM r JOIN t USING (alias) GROUP BY 1, 2), f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY priority) AS rn FROM b)
    SELECT r.request_id, CASE WHEN n = 1 THEN unit_id END AS unit_id, priority FROM r LEFT JOIN (SELECT * FROM f WHERE rn = 1) x ON x.request_id = r.request_id""")
def _(units, part):
    from lumenary.functions.text import normal_key

    name = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat_ws(" ", F.expr(CHAPTER), F.col("p_size").cast("string")))
    requests = part.select(F.col("p_partkey").alias("request_id"), normal_key(name).alias("alias"))
    by = lambda c: units.select(normal_key(c).alias("alias"), "unit_id").distinct()
    return P.resolved(requests, by(F.col("unit_id")), by(F.col("title")), by(F.concat_ws(" ", "chapter", F.col("unit_order").cast("string"))))


@query("C14", "units", sql=f"WITH RECURSIVE {_EDGES}, c AS (SELECT unit_id, prereq_id FROM edges UNION SELECT c.unit_id, e.prereq_id FROM c JOIN edges e ON e.unit_id = c.prereq_id) SELECT * FROM c")
def _(units):
    return P.closure(_edges(units))


@query("I34", "units", "lineitem", "orders", also="I34_all", sql=f"WITH {_EVIDENCE}, {_STATUS} SELECT * FROM status")
def _(units, lineitem, orders):
    return P.unit_status(units, _evidence(units, lineitem, orders))


@query("C13", "units", "lineitem", "orders", also="C13_all", sql=f"WITH {_EVIDENCE}, {_STATUS}, {_EDGES} SELECT s.user_id, s.unit_id, COUNT(*) AS unmet FROM status s JOIN edges e ON e.unit_id = s.unit_id LEFT JOIN status m ON m.user_id = s.user_id AND m.unit_id = e.prereq_id AND m.status = 'mastered' WHERE s.status <> 'mastered' AND m.unit_id IS NULL GROUP BY 1, 2")
def _(units, lineitem, orders):
    return P.unmet_prerequisites(_edges(units), P.unit_status(units, _evidence(units, lineitem, orders)), tasks_for(lineitem))


@query("E12", "units", "lineitem", "orders", also="E12_all", sql=f"""
    WITH {_EVIDENCE}, {_STATUS}, {_EDGES}, m AS (SELECT user_id, unit_id FROM status WHERE status = 'mastered'), s AS (SELECT DISTINCT user_id, chapter FROM status JOIN units USING (unit_id)),
    o AS (SELECT s.user_id, s.chapter, arg_min(u.unit_id, u.unit_order) AS unit_id FROM s JOIN units u ON u.chapter = s.chapter LEFT JOIN m ON m.user_id = s.user_id AND m.unit_id = u.unit_id WHERE m.unit_id IS NULL GROUP BY 1, 2),
    n AS (SELECT o.user_id, o.chapter, MIN(e.prereq_id) AS prereq_id FROM o JOIN edges e ON e.unit_id = o.unit_id LEFT JOIN m ON m.user_id = o.user_id AND m.unit_id = e.prereq_id WHERE m.unit_id IS NULL GROUP BY 1, 2)
    SELECT o.user_id, o.chapter, COALESCE(prereq_id, unit_id) AS next_unit, prereq_id IS NOT NULL AS blocked FROM o LEFT JOIN n ON n.user_id = o.user_id AND n.chapter = o.chapter""")
def _(units, lineitem, orders):
    return P.next_units(units, _edges(units), checkpointed(_placed_status(units, lineitem, orders)), tasks_for(lineitem))


@query("D44", "units", "lineitem", "orders", also="D44_all", sql=f"WITH {_EVIDENCE}, {_STATUS} SELECT user_id, COUNT(*) FILTER (status = 'mastered') AS mastered, COUNT(*) FILTER (status = 'practising') AS practising, COUNT(*) FILTER (status = 'needs_review') AS needs_review, COUNT(*) AS total, CAST(ROUND(100 * COUNT(*) FILTER (status = 'mastered') / COUNT(*)) AS INT) AS percentage FROM status GROUP BY user_id")
def _(units, lineitem, orders):
    return P.portfolio(P.unit_status(units, _evidence(units, lineitem, orders)))


@query("E8", "units", sql="""
    WITH r AS (SELECT unit_id, chapter, ROW_NUMBER() OVER (PARTITION BY chapter ORDER BY weight DESC, unit_id) - 1 AS k, COUNT(*) OVER (PARTITION BY chapter) AS n FROM units)
    SELECT unit_id, chapter, CASE WHEN k < (CASE WHEN n <= 3 THEN 1 ELSE GREATEST(1, CEIL(n * 0.34)) END) THEN 'high' WHEN k >= n - (CASE WHEN n < 3 THEN 0 ELSE GREATEST(1, FLOOR(n * 0.25)) END) THEN 'light' ELSE 'medium' END AS band FROM r""")
def _(units):
    return P.focus_bands(units)


@query("I35", "units", sql=f"WITH {_MINUTES} SELECT unit_id, minutes FROM timed_units")
def _(units):
    return P.recommended_minutes(_timed(units)).select("unit_id", "minutes")


@query("E9", "units", sql="""
    WITH r AS (SELECT chapter, unit_id, SUM(difficulty) OVER (PARTITION BY chapter ORDER BY unit_order ROWS UNBOUNDED PRECEDING) AS s, unit_order FROM units) SELECT chapter, unit_id FROM r WHERE s <= 120 OR unit_order = 1""")
def _(units):
    return P.within_budget(units, ["chapter"], [F.asc("unit_order")], "difficulty", 120).select("chapter", "unit_id")


@query("E11", "units", sql=f"""
    WITH {_MINUTES}, b AS (SELECT *, 90 - COALESCE(SUM(minutes) OVER (PARTITION BY chapter ORDER BY unit_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM timed_units),
    a AS (SELECT *, GREATEST(5, LEAST(minutes, left_over)) AS allocated FROM b WHERE (unit_order = 1 OR left_over >= 15) AND left_over > 0)
    SELECT chapter, unit_id, 'main_focus' AS role, CAST(allocated - CASE WHEN allocated >= 10 THEN 5 ELSE 0 END AS BIGINT) AS minutes, CASE WHEN allocated >= min_minutes THEN 'full_unit' ELSE 'partial' END AS scope FROM a
    UNION ALL SELECT chapter, unit_id, 'quick_check', 5, 'partial' FROM a WHERE allocated >= 10""")
def _(units):
    return P.daily_route(P.recommended_minutes(_timed(units)), 90)


@query("E14", "units", sql="SELECT unit_id, chapter, NTILE(5) OVER (PARTITION BY chapter ORDER BY unit_order) AS area FROM units")
def _(units):
    return P.balanced_groups(units)


@query("E16", "units", sql="""
    WITH g AS (SELECT *, NTILE(5) OVER (PARTITION BY chapter ORDER BY unit_order) AS area FROM units), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chapter, area ORDER BY weight DESC, unit_order) AS x FROM g),
    b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chapter ORDER BY weight DESC, unit_order) AS y FROM a WHERE x = 1)
    SELECT chapter, unit_id, ROW_NUMBER() OVER (PARTITION BY chapter ORDER BY unit_order) AS position FROM b WHERE y <= 4""")
def _(units):
    return P.representatives(units.drop("area").join(P.balanced_groups(units).drop("chapter"), "unit_id"))


@query("I37", "units", "lineitem", also="I37_all", sql="""
    WITH a AS (SELECT unit_id, AVG(l_quantity) * 2 AS accuracy FROM lineitem JOIN units ON l_partkey = p_partkey GROUP BY 1),
    s AS (SELECT u.unit_id, accuracy, difficulty % 4 * 1.6 + p_partkey % 4 * 1.2 + difficulty % 5 * 0.45 + LEAST(1.5, (p_partkey % 9) * 0.25) AS base FROM units u LEFT JOIN a USING (unit_id)),
    b AS (SELECT unit_id, ROUND(base + CASE WHEN accuracy IS NULL THEN 0.0 WHEN accuracy < 40 THEN 4.0 WHEN accuracy < 60 THEN 2.5 WHEN accuracy < 80 THEN 1.0 WHEN accuracy >= 90 THEN -1.0 ELSE 0.0 END, 4) AS focus_score, CASE WHEN accuracy IS NULL THEN 'baseline' WHEN accuracy < 40 THEN 'critical' WHEN accuracy < 60 THEN 'weak' WHEN accuracy < 80 THEN 'building' ELSE 'strong' END AS band FROM s)
    SELECT *, CASE WHEN band IN ('baseline', 'critical', 'weak') THEN 'high' WHEN band = 'building' THEN 'medium' ELSE 'stretch' END AS priority FROM b""")
def _(units, lineitem):
    acc = lineitem.join(units, F.col("l_partkey") == F.col("p_partkey")).groupBy("unit_id").agg((F.avg("l_quantity") * 2).alias("accuracy"))
    u = units.select("unit_id", (F.col("difficulty") % 4).alias("importance_score"), (F.col("p_partkey") % 4).alias("exam_score"), (F.col("difficulty") % 5).alias("difficulty"), (F.col("p_partkey") % 9).alias("concepts"))
    return P.focus_scores(u, acc)


@query("D38", "sessions", sql=f"""
    WITH s AS (SELECT *, CASE WHEN score <> 5 THEN score < 3 END AS needs FROM sessions), g AS (SELECT user_id, topic, COUNT(needs) AS observations, COUNT(*) FILTER (needs) AS support_count, AVG(accuracy_rate) AS conf, MAX(completed_at) AS last_seen FROM s GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN support_count >= 2 THEN 'simplify_and_reinforce' WHEN observations >= 3 AND conf >= 78 THEN 'increase_difficulty' WHEN observations > 0 THEN 'steady_progression' ELSE 'baseline' END AS route, FIRST_VALUE(topic) OVER (PARTITION BY user_id ORDER BY support_count DESC, topic) AS weak_topic FROM g),
    d AS (SELECT *, CAST(last_seen AS DATE) + CASE route WHEN 'simplify_and_reinforce' THEN 1 WHEN 'increase_difficulty' THEN 7 ELSE 3 END AS due_on FROM r)
    SELECT user_id, topic, observations, support_count, ROUND(conf, 4) AS average_confidence, route, weak_topic, due_on, due_on <= DATE '{AS_OF[:10]}' AS revision_due FROM d""")
def _(sessions):
    return P.mastery_routes(sessions.select("user_id", "topic", F.when(F.col("score") != 5, F.col("score") < 3).alias("needs_support"), F.col("accuracy_rate").alias("confidence"), F.col("completed_at").alias("seen")), AS_OF)
