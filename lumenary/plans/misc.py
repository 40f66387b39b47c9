"""Further queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import misc as M
from lumenary.operators import planning as P
from lumenary.operators.sessions import latest
from lumenary.plans.planning import _EVIDENCE, _STATUS, _evidence
from lumenary.plans.registry import query
from lumenary.runtime import scratch

_CONCEPTS = "concepts AS (SELECT p_partkey, p_brand AS chapter, p_size % 6 AS unit, CAST(p_partkey % 5 AS INT) AS importance, p_size % 5 + 1 AS difficulty FROM part)"


def _concepts(part):
    return part.select("p_partkey", F.col("p_brand").alias("chapter"), (F.col("p_size") % 6).alias("unit"), (F.col("p_partkey") % 5).cast("int").alias("importance"), (F.col("p_size") % 5 + 1).alias("difficulty"))


_LONG = "{0} || ' of user ' || user_id || ' with ' || props || ' at ' || event_id || '; '"


@query("A17", "events", sql=f"""
    SELECT event_id AS id, ts AS created_at, SUBSTR(LOWER('U' || user_id || '@' || REPEAT('X', CAST(event_id % 200 AS INT)) || '.ORG'), 1, 120) AS email, SUBSTR(REPEAT(event_type || ' by admin ', 7), 1, 80) AS action, SUBSTR(REPEAT({_LONG.format('event_type')}, 5), 1, 220) AS target,
           SUBSTR(REPEAT(event_type, CAST(event_id % 9 + 1 AS INT)), 1, 40) AS method, SUBSTR(REPEAT({_LONG.format('event_type')}, 12), 1, 500) AS detail FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def _(events):
    long = F.concat("event_type", F.lit(" of user "), "user_id", F.lit(" with "), "props", F.lit(" at "), "event_id", F.lit("; "))
    k = F.col("event_id")
    email = F.concat(F.lit("U"), "user_id", F.lit("@"), F.repeat(F.lit("X"), (k % 200).cast("int")), F.lit(".ORG"))
    return M.audit_rows(events.select(k.alias("id"), F.col("ts").alias("created_at"), email.alias("email"), F.repeat(F.concat("event_type", F.lit(" by admin ")), 7).alias("action"), F.repeat(long, 5).alias("target"), F.repeat(F.col("event_type"), (k % 9 + 1).cast("int")).alias("method"), F.repeat(long, 12).alias("detail")), 100)


@query("A12", "traces", sql="""
    SELECT id AS turn, 'turn' AS kind, NULL AS name, latency_ms + 7 AS latency FROM traces UNION ALL SELECT id, CASE WHEN status = 'skipped' THEN 'route' ELSE 'model' END, provider, latency_ms FROM traces
    UNION ALL SELECT id, 'model', 'p9', 7 FROM traces UNION ALL SELECT id, 'tool', model, NULL FROM traces""")
def _(traces):
    calls = F.array(F.struct("provider", "status", F.col("latency_ms").alias("latency")), F.struct(F.lit("p9").alias("provider"), F.lit("success").alias("status"), F.lit(7).alias("latency")))
    payload = F.to_json(F.struct(F.col("id").alias("turn"), calls.alias("calls"), F.array(F.struct(F.col("model").alias("name"), F.lit(True).alias("ok"))).alias("tools")))
    return M.exploded_turns(traces.select(payload.alias("payload")))


@query("A5", "part", sql="SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 1 THEN 'tutor' ELSE 'coach' END AS route FROM part WHERE p_partkey % 5 < 3")
def _(part):
    """JSON lines with blank, comment and broken ones, defaults and unknown words among them."""
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, F.concat(F.lit('{"id": '), k, F.lit(', "route": "coach"}'))).when(k % 5 == 1, F.concat(F.lit('{"id": '), k, F.lit("}"))).when(k % 5 == 2, F.concat(F.lit('{"id": '), k, F.lit(', "route": "coach"}'))).when(k % 5 == 3, F.lit("# a comment")).otherwise(F.lit('{"id": '))
    return M.jsonl(part.select(line.alias("value")), "id long, route string", {"route": "tutor"}, {"route": ["tutor", "coach"]})


@query("A13", "chunks", sql="SELECT chunk_id, chapter, n_chars FROM chunks WHERE chapter NOT IN ('src1', 'src2') UNION ALL SELECT chunk_id, chapter, 0 FROM chunks WHERE chapter = 'src1' AND chunk_id % 3 = 0")
def _(chunks):
    """A table of chunks by chapter is written, then a third of one chapter's and none of another's replace theirs, twice in vain."""
    folder = scratch(chunks.sparkSession, "children")
    rows = chunks.select("chunk_id", "n_chars", "chapter")
    M.replace_children(rows, folder, "chapter", "first")
    new = rows.where("chapter = 'src1' AND chunk_id % 3 = 0").withColumn("n_chars", F.lit(0).cast(rows.schema["n_chars"].dataType))
    for _ in range(2):
        now = M.replace_children(new, folder, "chapter", "second", rows.where("chapter IN ('src1', 'src2')"))
    return now


@query("D54", "part", sql=f"""
    WITH {_CONCEPTS}, b AS (SELECT chapter, unit, COUNT(*) AS n, MAX(importance) AS imp, AVG(difficulty) AS diff FROM concepts GROUP BY 1, 2)
    SELECT chapter, unit, CASE WHEN imp >= 4 THEN 'very_high' WHEN imp = 3 THEN 'high' WHEN imp = 2 THEN 'moderate' ELSE 'low' END AS importance, CASE WHEN diff >= 3.5 THEN 'challenging' WHEN diff >= 2.25 THEN 'steady' ELSE 'foundation' END AS difficulty,
           CAST(LEAST(30, 10 + 5 * LEAST(n, 4)) AS INT) AS min_minutes, CAST(LEAST(60, LEAST(30, 10 + 5 * LEAST(n, 4)) + CASE WHEN diff >= 3.5 THEN 10 ELSE 5 END) AS INT) AS max_minutes, LAG(unit) OVER (PARTITION BY chapter ORDER BY unit) AS prerequisite FROM b""")
def _(part):
    return M.derived_units(_concepts(part))


@query("D51", "part", sql=f"WITH {_CONCEPTS} SELECT unit, MAX(importance) AS importance, ROUND(AVG(difficulty), 4) AS difficulty, COUNT(*) AS concepts, ROUND(SUM(difficulty * importance) / SUM(importance), 4) AS weighted FROM concepts GROUP BY unit")
def _(part):
    return M.focus_signals(_concepts(part))


@query("I26", "traces", sql="""
    WITH s AS (SELECT *, quality - CASE WHEN quality < 0.72 THEN 0.08 ELSE 0 END - CASE WHEN grounded = 0 THEN 0.12 ELSE 0 END - CASE WHEN status = 'review' THEN 0.08 ELSE 0 END - CASE WHEN status = 'failed' THEN 0.04 ELSE 0 END - CASE WHEN latency_ms > 3000 THEN 0.04 ELSE 0 END AS g FROM traces),
    r AS (SELECT *, ROUND(GREATEST(0.0, LEAST(1.0, ROUND(g, 6))), 3) AS growth, list_filter([CASE WHEN quality < 0.72 THEN 'clarity' END, CASE WHEN grounded = 0 THEN 'sources' END, CASE WHEN status = 'review' THEN 'repair' END, CASE WHEN status = 'failed' THEN 'model_fallback' END, CASE WHEN latency_ms > 3000 THEN 'tool_failures' END, CASE WHEN user_id % 4 = 0 THEN 'simplify' END], lambda x: x IS NOT NULL) AS things FROM s)
    SELECT id, growth, CASE WHEN growth >= 0.85 THEN 'excellent' WHEN growth >= 0.72 THEN 'stable' WHEN growth >= 0.55 THEN 'watch' ELSE 'repair' END AS readiness, CASE WHEN LEN(things) = 0 THEN 'baseline' ELSE array_to_string(things[1:5], ',') END AS recommendations FROM r""")
def _(traces):
    style = F.when(F.col("user_id") % 4 == 0, "simplify_and_check").otherwise("steady")
    return M.growth(traces.select("id", "quality", "grounded", (F.col("status") == "review").alias("repaired"), (F.col("status") == "failed").cast("int").alias("model_errors"), (F.col("latency_ms") > 3000).cast("int").alias("tool_errors"), style.alias("support_style")))


@query("I28_parsed", "part", sql="""
    SELECT p_partkey, 1 AS no, 'What is ' || p_name || '?' AS question, p_type || '|' || p_brand || '|x' || p_size || '|none' AS options, SUBSTR('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS correct, 'It is in the notes.' AS explanation FROM part WHERE p_size % 5 <> 0
    UNION ALL SELECT p_partkey, 2, 'Which size?', p_size || '|' || (p_size + 1) || '|' || (p_size + 2) || '|' || (p_size + 3), 'A', 'By count.' FROM part""")
def _(part):
    """Questions of running text; those with equal options, and what comes before the first, go."""
    third = F.when(F.col("p_size") % 5 == 0, F.upper("p_type")).otherwise(F.concat(F.lit("x"), "p_size"))
    letter = F.substring(F.lit("abcd"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    k = lambda n: (F.col("p_size") + n).cast("string")
    one = F.concat(F.lit("Some words. Q1. What is "), "p_name", F.lit("?\n A. "), "p_type", F.lit("\n B) "), "p_brand", F.lit(" C. "), third, F.lit(" D. none\nAnswer: ("), letter, F.lit(") Explanation: It is in  the notes. "))
    two = F.concat(F.lit("Q2) Which size? A. "), k(0), F.lit(" B. "), k(1), F.lit(" C. "), k(2), F.lit(" D. "), k(3), F.lit(" Answer: A Explanation: By count.\nQ3. Broken? A. 1 B. 2"))
    rows = M.parsed_mcqs(part.select("p_partkey", F.concat(one, two).alias("text")), "p_partkey")
    return rows.select("p_partkey", "no", "question", F.array_join("options", "|").alias("options"), "correct", "explanation")


@query("I28", "part", sql="SELECT p_partkey, p_size % 4 <> 0 AND p_partkey % 3 <> 0 AS valid FROM part")
def _(part):
    """Whether four options with letters in front are a fair set."""
    k, s = F.col("p_partkey"), F.col("p_size")
    options = F.array(F.concat(F.lit("A. "), F.col("p_name")), F.when(s % 4 == 0, F.concat(F.lit("b) "), F.upper("p_name"))).otherwise(F.concat(F.lit("B) x"), k)), F.when(k % 3 == 0, F.lit("C.  ")).otherwise(F.lit("C. beta")), F.lit("D. gamma"))
    return part.select("p_partkey", M.valid_options(options).alias("valid"))


@query("I32", "documents")
def _(documents):
    """Facts of each text."""
    return M.grounded_facts(documents)


@query("D49", "traces", sql="SELECT expected, COUNT(*) AS cases, ROUND(AVG(CASE WHEN predicted = expected THEN 1 ELSE 0 END), 6) AS pass_rate, ROUND(AVG(grounded), 6) AS grounded_rate, ROUND(AVG(CASE WHEN tool THEN 1 ELSE 0 END), 6) AS tool_rate FROM (SELECT trace_type AS expected, CASE WHEN latency_ms % 3 = 0 THEN 'turn' ELSE trace_type END AS predicted, grounded, estimated_output_tokens > 50 AS tool FROM traces) x GROUP BY expected")
def _(traces):
    return M.evaluation(traces.select(F.col("trace_type").alias("expected"), F.when(F.col("latency_ms") % 3 == 0, "turn").otherwise(F.col("trace_type")).alias("predicted"), "grounded", (F.col("estimated_output_tokens") > 50).alias("tool")))


@query("D36", "sessions", sql="""
    WITH d AS (SELECT user_id, date, ROUND(AVG(accuracy_rate) FILTER (session_type = 'exam'), 4) AS day_accuracy, ROUND(AVG(focus_score) FILTER (session_type = 'exam'), 4) AS day_focus, SUM(xp_earned) AS xp FROM sessions GROUP BY 1, 2),
    l AS (SELECT user_id, ROUND(AVG(accuracy_rate), 4) AS lifetime, ROUND(AVG(focus_score), 4) AS lifetime_focus FROM sessions GROUP BY 1), t AS (SELECT user_id, topic, AVG(accuracy_rate) AS a FROM sessions GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(a, 6), topic) AS low, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(a, 6) DESC, topic) AS high FROM t),
    w AS (SELECT user_id, COALESCE(STRING_AGG(topic, ',' ORDER BY low) FILTER (low <= 5 AND a < 60), '') AS weak, COALESCE(STRING_AGG(topic, ',' ORDER BY high) FILTER (high <= 5 AND a >= 60), '') AS strong FROM r GROUP BY 1),
    f AS (SELECT d.user_id, date, COALESCE(day_accuracy, lifetime) AS accuracy, COALESCE(day_focus, lifetime_focus) AS focus, xp, lifetime, weak, strong FROM d JOIN l USING (user_id) JOIN w USING (user_id))
    SELECT *, CASE WHEN accuracy < 45 THEN 'high' WHEN accuracy < 65 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN accuracy < 45 THEN 'review basics' WHEN weak <> '' THEN 'practise weak topics' ELSE 'raise difficulty' END AS recommendation FROM f""")
def _(sessions):
    return M.daily_signals(sessions)


@query("I36", "units", "lineitem", "orders", also="I36_all", sql=f"WITH {_EVIDENCE}, {_STATUS}, a AS (SELECT user_id, SUM(accuracy * attempts) / NULLIF(SUM(attempts), 0) AS acc FROM status GROUP BY 1) SELECT user_id, ROUND(acc, 4) AS accuracy, CASE WHEN acc >= 85 THEN 'confident' WHEN acc >= 70 THEN 'know_the_basics' ELSE 'new_to_it' END AS proficiency FROM a")
def _(units, lineitem, orders):
    return M.proficiency(P.unit_status(units, _evidence(units, lineitem, orders)))


@query("F7", "conversations", sql="SELECT conv_id, turn, rn AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY LENGTH(text) DESC, turn DESC) AS rn FROM conversations) x WHERE rn <= 3")
def _(conversations):
    """The three most important memories of each conversation (by length here), the newer first."""
    return latest(conversations, ["conv_id"], [F.length("text").desc(), F.desc("turn")], 3).select("conv_id", "turn", F.col("rn").cast("long").alias("position"))


@query("H6", "part", sql="SELECT p_brand, arg_max(p_type, p_size * 1000000 + LENGTH(p_type) * 10000 + (10000 - p_partkey % 10000)) AS best FROM part GROUP BY p_brand")
def _(part):
    """The highest-ranked text, then the longest, then the first."""
    return part.groupBy("p_brand").agg(F.max_by("p_type", F.struct("p_size", F.length("p_type"), -(F.col("p_partkey") % 10000))).alias("best"))


@query("C17", "events", sql="SELECT regexp_extract(props, '[0-9]+', 0) AS session_key, COUNT(*) AS n, MAX(event_id) AS last_event FROM events GROUP BY 1")
def _(events):
    """Events grouped by a key inside their JSON."""
    return events.groupBy(F.get_json_object("props", "$.k").alias("session_key")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
