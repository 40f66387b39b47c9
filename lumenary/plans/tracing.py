"""Queries over traces and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import traces as T
from lumenary.plans.bindings import AS_OF
from lumenary.plans.registry import query

_STATE = "CASE WHEN status IN ('success', 'completed') THEN 'completed' WHEN status IN ('failed', 'error') THEN 'failed' WHEN status IN ('review', 'needs_review') THEN 'review' ELSE 'unknown' END"
_END = f"TIMESTAMP '{AS_OF}'"
_RANKED = "r AS (SELECT agent, latency_ms, ROW_NUMBER() OVER (PARTITION BY agent ORDER BY latency_ms) AS k, COUNT(*) OVER (PARTITION BY agent) AS n FROM {0} WHERE latency_ms > 0)"
_P = lambda f, n: f"MIN(CASE WHEN k >= CEIL(n * {f}) THEN latency_ms END) AS {n}"


@query("D10", "obs_events", sql=f"SELECT COUNT(*) AS events, COUNT(*) FILTER (severity IN ('error', 'critical')) AS errors, ROUND(COALESCE(SUM(estimated_cost_usd), 0.0), 6) AS cost FROM obs_events WHERE created_at > {_END} - INTERVAL 72 HOUR AND created_at <= {_END}")
def _(e):
    return T.summary(e, AS_OF, 72)


@query("D10_types", "obs_events", sql=f"SELECT event_type, COUNT(*) AS events, ROUND(AVG(latency_ms), 4) AS avg_latency FROM obs_events WHERE created_at > {_END} - INTERVAL 72 HOUR AND created_at <= {_END} GROUP BY event_type")
def _(e):
    return T.by_type(e, AS_OF, 72)


@query("D11", "traces", sql="""
    SELECT provider, model, COUNT(*) AS calls, COUNT(*) FILTER (status NOT IN ('success', 'skipped')) AS failures, ROUND(AVG(latency_ms), 4) AS avg_latency_all,
           ROUND(AVG(CASE WHEN latency_ms > 0 THEN latency_ms END), 4) AS avg_latency_positive, SUM(estimated_input_tokens + estimated_output_tokens) AS tokens, ROUND(SUM(estimated_cost_usd), 6) AS cost
    FROM traces WHERE trace_type = 'model' GROUP BY provider, model ORDER BY calls DESC, provider, model LIMIT 20""")
def _(t):
    return T.model_usage(t)


@query("D12", "traces", sql="SELECT ROUND(COUNT(*) FILTER (status NOT IN ('success', 'skipped')) / NULLIF(COUNT(*), 0), 6) AS failure_rate FROM traces")
def _(t):
    return T.failure_rate(t)


@query("D13", "traces", sql="""
    SELECT CAST(turn_id AS STRING) AS run, arg_min(status, id) FILTER (trace_type = 'turn') AS status, SUM(CASE WHEN trace_type NOT IN ('route', 'dispatch') THEN latency_ms ELSE 0 END) AS latency_ms,
           ROUND(SUM(estimated_cost_usd), 6) AS cost, COALESCE(STRING_AGG(DISTINCT model, ',' ORDER BY model) FILTER (trace_type = 'model'), '') AS models, COUNT(*) AS steps
    FROM traces GROUP BY turn_id""")
def _(t):
    return T.runs(t)


@query("D14", "traces", sql="""
    WITH l AS (SELECT * FROM traces WHERE trace_type = 'turn' ORDER BY created_at DESC, id DESC LIMIT 500)
    SELECT COUNT(*) AS turns, ROUND(AVG(quality), 6) AS avg_quality, ROUND(AVG(grounded), 6) AS grounded_rate, ROUND(AVG(CASE WHEN status = 'success' THEN 1 ELSE 0 END), 6) AS success_rate FROM l""")
def _(t):
    return T.quality(t)


@query("D15", "sessions", "traces", "profiles", sql="""
    WITH u AS (SELECT COUNT(*) AS users FROM (SELECT user_id FROM sessions UNION SELECT user_id FROM traces UNION SELECT user_id FROM profiles) x),
    a AS (SELECT COUNT(DISTINCT user_id) AS active_users FROM (SELECT user_id FROM sessions WHERE date = DATE '2024-01-30' UNION ALL SELECT user_id FROM traces WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' AND created_at <= TIMESTAMP '2024-01-30 12:00:00') y),
    s AS (SELECT COUNT(DISTINCT id) AS recent_sessions FROM sessions WHERE completed_at > TIMESTAMP '2024-01-30 11:00:00' AND completed_at <= TIMESTAMP '2024-01-30 12:00:00'),
    o AS (SELECT COUNT(*) FILTER (trace_type = 'turn') AS turns, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(DISTINCT turn_id) FILTER (created_at > TIMESTAMP '2024-01-30 11:00:00' AND created_at <= TIMESTAMP '2024-01-30 12:00:00') AS recent FROM traces)
    SELECT users, active_users, recent_sessions, turns, failed, COALESCE(NULLIF(recent_sessions, 0), recent) AS active_sessions FROM u, a, s, o""")
def _(s, t, p):
    """The platform at noon of the last day."""
    return T.overview(s, t, p, "2024-01-30 12:00:00")


@query("D16", "traces", sql=f"""
    SELECT COUNT(*) AS rows, COUNT(*) FILTER (trace_type = 'turn') AS turns, COUNT(*) FILTER (trace_type = 'model') AS models, COUNT(*) FILTER (trace_type = 'tool') AS tools, COUNT(*) FILTER (trace_type = 'dispatch') AS dispatches, COUNT(*) FILTER (trace_type = 'turn' AND quality < 0.65) AS low_quality, COUNT(*) FILTER (trace_type = 'turn' AND quality >= 0.82) AS verified, COUNT(*) FILTER (trace_type = 'turn' AND grounded = 0) AS ungrounded, COUNT(*) FILTER (latency_ms >= 7000) AS slow, COUNT(*) FILTER (trace_type = 'turn' AND latency_ms >= 4000) AS slow_turns, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status = 'failed' AND trace_type = 'turn') AS failed_turns, COUNT(*) FILTER (status = 'failed' AND trace_type = 'model') AS failed_models, COUNT(*) FILTER (status = 'failed' AND trace_type = 'tool') AS failed_tools, COUNT(*) FILTER (status = 'success') AS succeeded, COUNT(*) FILTER (status = 'skipped') AS skipped, COUNT(*) FILTER (status LIKE '%view%') AS review, COUNT(*) FILTER (agent LIKE '%1') AS first_agent, COUNT(*) FILTER (model LIKE 'm%' AND trace_type = 'model') AS named_models, COUNT(*) FILTER (estimated_input_tokens > 400) AS large_inputs, COUNT(*) FILTER (estimated_output_tokens = 0) AS empty_outputs, COUNT(*) FILTER (estimated_cost_usd > 0) AS paid, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT agent) AS agents, COUNT(DISTINCT turn_id) AS runs
    FROM traces WHERE created_at > {_END} - INTERVAL 24 HOUR AND created_at <= {_END}""")
def _(t):
    return T.console(t, AS_OF)


@query("D17", "traces", sql=f"""
    WITH t AS (SELECT *, (CAST(FLOOR(epoch({_END})) AS BIGINT) - CAST(FLOOR(epoch(created_at)) AS BIGINT)) / 3600 AS age FROM traces),
    g AS (SELECT agent, COUNT(*) FILTER (age < 24) AS runs, ROUND(AVG(quality) FILTER (age < 24), 6) AS quality, ROUND(AVG(quality) FILTER (age < 24) - AVG(quality) FILTER (age >= 24 AND age < 48), 6) AS quality_delta,
                 ROUND(AVG(latency_ms) FILTER (age < 24) - AVG(latency_ms) FILTER (age >= 24 AND age < 48), 4) AS latency_delta,
                 ROUND(COUNT(*) FILTER (status = 'success') / COUNT(*), 6) AS success_rate, COALESCE(SUM(estimated_input_tokens + estimated_output_tokens), 0) AS tokens
          FROM t WHERE age >= 0 GROUP BY agent)
    SELECT *, CASE WHEN runs = 0 THEN 'idle' WHEN quality_delta >= 0.02 THEN 'improving' WHEN quality_delta <= -0.02 THEN 'declining' ELSE 'steady' END AS trend FROM g""")
def _(t):
    return T.intelligence(t, AS_OF)


@query("D18", "traces", sql="""
    SELECT agent, provider, model, n FROM (SELECT agent, provider, model, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY agent ORDER BY COUNT(*) DESC, provider, model) AS rn FROM traces GROUP BY agent, provider, model) x WHERE rn <= 6""")
def _(t):
    return T.source_usage(t)


@query("D19", "obs_events", sql=f"""
    WITH e AS (SELECT *, CAST(FLOOR(epoch({_END})) AS BIGINT) - CAST(FLOOR(epoch(created_at)) AS BIGINT) AS age FROM obs_events)
    SELECT source, COUNT(*) FILTER (age <= 86400) AS day, COUNT(*) FILTER (age > 86400 AND age <= 604800) AS week, COUNT(*) FILTER (age > 604800) AS historical, MAX(created_at) AS latest FROM e GROUP BY source""")
def _(e):
    return T.freshness(e, AS_OF)


_SNAP = f"""
    SELECT agent, COUNT(*) AS recorded, COUNT(*) FILTER (s = 'completed') AS completed, COUNT(*) FILTER (s = 'failed') AS failed, COUNT(*) FILTER (s = 'review') AS review,
           ROUND(AVG(latency_ms) FILTER (latency_ms > 0), 4) AS avg_latency, ROUND(COUNT(*) FILTER (s = 'completed') / NULLIF(COUNT(*) FILTER (s <> 'unknown'), 0), 6) AS success_rate,
           SUM(estimated_input_tokens + estimated_output_tokens) AS tokens, ROUND(SUM(estimated_cost_usd), 6) AS cost
    FROM (SELECT *, {_STATE} AS s FROM traces) x GROUP BY agent"""


@query("D20", "traces", sql=_SNAP)
def _(t):
    return T.snapshot(t)


@query("D21", "traces", sql=f"""
    WITH newest AS (SELECT * FROM traces WHERE trace_type = 'turn' ORDER BY created_at DESC, id DESC LIMIT 1500), {_RANKED.format('newest')}
    SELECT agent, {_P(0.5, 'p50')}, {_P(0.95, 'p95')}, {_P(0.99, 'p99')} FROM r GROUP BY agent""")
def _(t):
    return T.sampled_percentiles(t)


@query("D22", "traces", sql=f"SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS recorded, COUNT(*) FILTER ({_STATE} = 'completed') AS completed, COUNT(*) FILTER ({_STATE} = 'failed') AS failed FROM traces GROUP BY 1")
def _(t):
    return T.daily(t)


@query("D23", "traces", sql=f"""
    WITH s AS ({_SNAP}), {_RANKED.format('traces')}, p AS (SELECT agent, {_P(0.95, 'p95')} FROM r GROUP BY agent)
    SELECT agent, failed, review, p95, CASE WHEN failed >= 3 THEN 'investigate failures' WHEN review >= 3 THEN 'clear reviews' WHEN p95 >= 5000 AND recorded >= 10 THEN 'reduce latency' ELSE 'none' END AS recommendation FROM s LEFT JOIN p USING (agent)""")
def _(t):
    return T.recommendations(t)


@query("D24", "traces", sql="""
    SELECT CASE WHEN trace_type = 'tool' THEN 'message' ELSE 'handoff' END AS kind, 'from' AS side, agent AS party, provider AS other, COUNT(*) AS n FROM traces WHERE trace_type IN ('tool', 'dispatch') GROUP BY 1, 2, 3, 4
    UNION ALL SELECT 'handoff', 'to', provider, agent, COUNT(*) FROM traces WHERE trace_type = 'dispatch' GROUP BY 3, 4""")
def _(t):
    return T.collaboration(t)


@query("G1", "traces", "obs_events", sql=f"""
    SELECT 'trace' AS kind, id AS ref, agent, {_STATE} AS state, created_at, latency_ms FROM traces
    UNION ALL SELECT 'event', event_version, agent_id, CASE WHEN severity IN ('error', 'critical') THEN 'failed' ELSE 'completed' END, created_at, latency_ms FROM obs_events""")
def _(t, e):
    return T.records(t, e)


@query("D39", "traces", sql=f"SELECT ROUND(COALESCE(SUM(estimated_cost_usd), 0.0), 6) AS spend, ROUND(COALESCE(SUM(estimated_cost_usd), 0.0), 6) < 1.0 AS allowed FROM traces WHERE created_at > {_END} - INTERVAL 24 HOUR AND created_at <= {_END}")
def _(t):
    return T.spend(t, AS_OF, 1.0)


@query("D40", "obs_events", sql="SELECT CAST(created_at AS DATE) AS day, event_type AS quota, sha256(session_id) AS user_hash, COUNT(*) AS used, GREATEST(0, COUNT(*) - 2) AS over FROM obs_events GROUP BY 1, 2, 3")
def _(e):
    return T.quotas(e, 2)


@query("D41", "traces", sql="SELECT turn_id, COUNT(*) FILTER (trace_type = 'turn') AS steps, COUNT(*) FILTER (trace_type = 'model') AS messages, COUNT(*) FILTER (trace_type = 'tool') AS tool_calls, COUNT(*) FILTER (trace_type = 'dispatch') AS handoffs FROM traces GROUP BY turn_id")
def _(t):
    return T.run_summary(t)


@query("D42", "obs_events", sql="""
    WITH e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id ORDER BY event_version DESC) AS rn, severity IN ('error', 'critical') AS bad FROM obs_events)
    SELECT agent_id, COUNT(*) AS events, COUNT(*) FILTER (bad) AS errors, arg_max(event_type, event_version) AS last_event, CASE WHEN arg_max(bad, event_version) THEN 'failed' ELSE 'idle' END AS status,
           ROUND(100.0 * COUNT(*) FILTER (NOT bad) / COUNT(*), 4) AS success_rate, ROUND(AVG(latency_ms) FILTER (rn <= 50), 4) AS recent_latency FROM e GROUP BY agent_id""")
def _(e):
    return T.agent_status(e)


@query("J5", "traces", sql="""
    WITH t AS (SELECT *, CAST(FLOOR(epoch(TIMESTAMP '2024-01-30 12:00:00')) AS BIGINT) - CAST(FLOOR(epoch(created_at)) AS BIGINT) AS age FROM traces)
    SELECT agent, CASE WHEN MIN(age) <= 300 THEN 'active' WHEN MIN(age) > 1800 THEN 'stale' ELSE 'idle' END AS live, MIN(age) AS seconds, COUNT(DISTINCT CASE WHEN age <= 1800 THEN turn_id END) AS overlap FROM t WHERE age >= 0 GROUP BY agent""")
def _(t):
    return T.live_status(t, "2024-01-30 12:00:00")


@query("E13", "traces", sql="SELECT turn_id, STRING_AGG(trace_type || ':' || status, ',' ORDER BY created_at, id) AS steps FROM traces GROUP BY turn_id")
def _(t):
    return T.timeline(t)


@query("B8", "obs_events", sql="SELECT event_version, agent_id, severity FROM obs_events WHERE severity = 'error' AND source = 'web'")
def _(e):
    return T.filtered(e, severity="error", source="web", event_type=None).select("event_version", "agent_id", "severity")


@query("F3", "obs_events", sql="SELECT event_version, event_type FROM obs_events WHERE event_version > 700 ORDER BY event_version LIMIT 500")
def _(e):
    return T.feed(e, 700).select("event_version", "event_type")


# references as the platform writes them for some rows, as others do for the rest; a provider's name with a blank, an unknown state
_SHOWN = "SELECT id, CASE WHEN status = 'review' THEN 'odd state' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN CONCAT('turn_', SUBSTR(sha2(CAST(turn_id AS STRING), 256), 1, 12)) WHEN id % 3 = 1 THEN CONCAT('run_', CAST(turn_id AS STRING)) END AS ref, CASE WHEN id % 7 = 0 THEN 'a b' ELSE provider END AS provider, CASE WHEN id % 11 = 0 THEN 'x/y:z' WHEN id % 11 = 1 THEN 'm 1' ELSE model END AS model, CASE WHEN id % 13 = 0 THEN 0 ELSE latency_ms END AS latency_ms FROM traces"


@query("B14", "traces", sql=f"""
    WITH t AS ({_SHOWN.replace('sha2(CAST(turn_id AS STRING), 256)', 'sha256(CAST(turn_id AS STRING))')})
    SELECT id, CASE WHEN status IN ({', '.join(f"'{x}'" for x in T.STATES)}) THEN status ELSE 'unknown' END AS state, CASE WHEN regexp_full_match(ref, '(run|turn)_[a-f0-9]{{12}}') THEN ref END AS ref, CASE WHEN regexp_full_match(provider, '[a-zA-Z0-9_.-]{{1,80}}') THEN provider END AS provider,
           CASE WHEN regexp_full_match(model, '[a-zA-Z0-9_./:-]{{1,120}}') THEN model END AS model, CASE WHEN latency_ms > 0 THEN latency_ms END AS latency_ms, CASE WHEN status = 'failed' THEN 'execution' END AS error_class FROM t""")
def _(t):
    """What may be shown of every trace."""
    return T.masked(t.sparkSession.sql(_SHOWN.replace("FROM traces", "FROM {traces}"), traces=t))


@query("B15", "traces", sql="""
    WITH t AS (SELECT id, LOWER(CONCAT_WS(' ', trace_type, status, provider, model)) AS x FROM traces)
    SELECT id, 'tutor' AS agent_name FROM t WHERE contains(x, 'turn') OR contains(x, 'm1') UNION ALL SELECT id, 'grader' FROM t WHERE contains(x, 'tool') OR contains(x, 'review')""")
def _(t):
    return T.matched_agents(t, {"tutor": ["turn", "m1"], "grader": ["tool", "review"]})


@query("A16", "traces", "obs_events", sql=f"""
    SELECT 'traces' AS table_name, COUNT(*) AS expired FROM traces WHERE turn_id IN (SELECT turn_id FROM traces GROUP BY turn_id HAVING MAX(created_at) < {_END} - INTERVAL 20 DAY)
    UNION ALL SELECT 'events', COUNT(*) FROM obs_events WHERE created_at < {_END} - INTERVAL 10 DAY""")
def _(t, e):
    return T.retention_counts(t, e, AS_OF, 20, 10)


@query("A11", "obs_events", sql="SELECT event_version, event_type FROM obs_events UNION ALL SELECT event_version, event_type FROM obs_events WHERE event_version <= 0")
def _(e):
    """Appended twice over, every positive version stays once."""
    return T.deduplicated(e.unionByName(e)).select("event_version", "event_type")


@query("J3_batch", "obs_events", sql="""
    SELECT event_version, COUNT(*) OVER w AS demand, COUNT(*) OVER w > 2 AS breach FROM obs_events
    WINDOW w AS (PARTITION BY session_id ORDER BY CAST(FLOOR(epoch(created_at)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""")
def _(e):
    return T.rate_demand(e, 3600, 2)


@query("C15", "traces", sql="SELECT a.id AS step_id, b.id AS model_id FROM traces a JOIN traces b ON a.turn_id = b.turn_id AND a.trace_type = 'turn' AND b.trace_type = 'model'")
def _(t):
    """Steps of a run with the run's model calls."""
    a, b = t.where("trace_type = 'turn'"), t.where("trace_type = 'model'")
    return a.select("turn_id", F.col("id").alias("step_id")).join(b.select("turn_id", F.col("id").alias("model_id")), "turn_id").drop("turn_id")
