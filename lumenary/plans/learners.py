"""Queries over learner sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import sessions as S
from lumenary.plans.bindings import AS_OF
from lumenary.plans.registry import query

_PCT = "COALESCE(100.0 * {0} / NULLIF({1}, 0), 0.0)"
_SANE = f"""
    SELECT id, user_id, GREATEST(0, LEAST(score, total_questions)) AS score, GREATEST(0, LEAST(score, total_questions)) * 10 AS xp_earned,
           ROUND({_PCT.format('GREATEST(0, LEAST(score, total_questions))', 'total_questions')}, 2) AS accuracy_rate,
           GREATEST(0, hint_count) AS hint_count, ROUND(GREATEST(0.0, LEAST(100.0, focus_score)), 6) AS focus_score,
           CASE WHEN time_spent_seconds > 0 THEN time_spent_seconds
                ELSE COALESCE(GREATEST(0, CAST(FLOOR(epoch(completed_at)) AS BIGINT) - CAST(FLOOR(epoch(started_at)) AS BIGINT)), 0) END AS duration_seconds
    FROM raw_sessions"""
_TOPIC = """
    running AS (
        SELECT user_id, topic, id, completed_at, SUM(total_questions) OVER w AS attempts, SUM(score) OVER w AS correct
        FROM sessions WINDOW w AS (PARTITION BY user_id, topic ORDER BY completed_at, id)),
    acc AS (SELECT *, COALESCE(100.0 * correct / NULLIF(attempts, 0), 0.0) AS accuracy FROM running),
    tr AS (SELECT *, accuracy - LAG(accuracy) OVER (PARTITION BY user_id, topic ORDER BY completed_at, id) AS trend,
                  ROW_NUMBER() OVER (PARTITION BY user_id, topic ORDER BY completed_at DESC, id DESC) AS rn FROM acc),
    topics AS (SELECT user_id, topic, attempts, correct, ROUND(accuracy, 4) AS accuracy, ROUND(COALESCE(trend, 0.0), 4) AS trend,
                      accuracy < 60 AS weak, completed_at AS last_practiced FROM tr WHERE rn = 1)"""
_COG = f"""
    recent AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY completed_at DESC, id DESC) AS rn FROM sessions),
    bydate AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS rn FROM sessions),
    cog AS (SELECT user_id, ROUND(AVG(focus_score), 4) AS focus,
                   ROUND(LEAST(100.0, COUNT(*) / GREATEST(1, DATE '2024-01-31' - MIN(date)) * 20), 4) AS consistency,
                   ROUND(LEAST(100.0, AVG(accuracy_rate) / GREATEST(1.0, AVG(GREATEST(time_spent_seconds, 0))) * 100), 4) AS efficiency
            FROM bydate WHERE rn <= 10 GROUP BY user_id)"""
_REV = f"""{_TOPIC},
    base AS (SELECT *, GREATEST(0.0, LEAST(1.0, correct / attempts)) AS acc FROM topics WHERE attempts > 0),
    st AS (SELECT *, GREATEST(1.0, LEAST(14.0, (1 + LEAST(40, attempts) * 0.15 * (0.4 + acc)) * CASE WHEN weak THEN 0.5 ELSE 1.0 END)) AS stab,
                  GREATEST(0.0, (CAST(FLOOR(epoch(TIMESTAMP '{AS_OF}')) AS BIGINT) - CAST(FLOOR(epoch(last_practiced)) AS BIGINT)) / 86400.0) AS days FROM base),
    ret AS (SELECT *, POW(CAST(0.5 AS DOUBLE), days / stab) AS r, CASE WHEN days >= 1.5 * stab THEN 'overdue' WHEN days >= 0.75 * stab THEN 'due' WHEN acc < 0.6 THEN 'strengthen' ELSE 'fresh' END AS bucket FROM st),
    scores AS (SELECT user_id, topic, ROUND(r, 3) AS retention,
                      ROUND(LEAST(100.0, (1 - r) * 70 + (1 - acc) * 30 + CASE WHEN weak THEN 12 ELSE 0 END + CASE WHEN trend < 0 THEN 6 ELSE 0 END), 1) AS priority, bucket,
                      CASE WHEN acc < 0.5 THEN 'deep_review' WHEN bucket = 'overdue' THEN 'quick_recall' ELSE 'practice_mcq' END AS mode,
                      CASE WHEN acc < 0.5 THEN 15 WHEN bucket = 'overdue' THEN 12 WHEN bucket = 'fresh' THEN 5 ELSE 10 END AS minutes, trend < 0 AS declining FROM ret),
    ordered AS (SELECT *, CASE bucket WHEN 'overdue' THEN 0 WHEN 'due' THEN 1 WHEN 'strengthen' THEN 2 ELSE 3 END AS bo FROM scores)"""


@query("B9", "raw_sessions", sql=_SANE)
def _(raw):
    return S.sanitise(raw)


@query("B10", "raw_sessions", sql=f"SELECT id, duration_seconds FROM ({_SANE}) x")
def _(raw):
    return S.effective_duration(raw)


@query("B11", "progress", sql=f"SELECT user_id, ROUND({_PCT.format('total_correct', 'total_questions')}, 4) AS accuracy, CAST(FLOOR(xp / 100) + 1 AS BIGINT) AS level FROM progress")
def _(progress):
    return S.derived(progress)


@query("B12", "sessions", sql=f"""
    SELECT id, user_id, topic, CAST(CASE WHEN time_spent_seconds > 0 AND ROUND(time_spent_seconds / 60) = 0 THEN 1 ELSE ROUND(time_spent_seconds / 60) END AS BIGINT) AS minutes,
           CAST(ROUND({_PCT.format('score', 'total_questions')}) AS BIGINT) AS performance, ROUND(confidence_after - confidence_before, 1) AS confidence_change
    FROM sessions""")
def _(sessions):
    return S.presented(sessions)


@query("D1", "sessions", sql="""
    SELECT user_id, COUNT(*) AS sessions, ROUND(COALESCE(AVG(CASE WHEN response_latency_ms > 0 THEN response_latency_ms END), 0.0), 4) AS avg_latency_ms,
           ROUND(COALESCE(AVG(CASE WHEN time_spent_seconds > 0 THEN time_spent_seconds END), 0.0), 4) AS avg_duration,
           ROUND(AVG(hint_count), 4) AS avg_hints, ROUND(AVG(retry_count), 4) AS avg_retries, SUM(time_spent_seconds) AS total_seconds,
           ROUND(AVG(confidence_before), 6) AS avg_confidence_before, ROUND(AVG(confidence_after - confidence_before), 6) AS avg_confidence_change
    FROM sessions GROUP BY user_id""")
def _(sessions):
    return S.telemetry(sessions)


@query("D2", "sessions", sql=f"WITH {_TOPIC} SELECT * FROM topics")
def _(sessions):
    return S.topic_performance(sessions)


@query("D2_pace", "sessions", sql="""
    WITH RECURSIVE xs AS (SELECT user_id, topic, time_spent_seconds / total_questions AS t, ROW_NUMBER() OVER (PARTITION BY user_id, topic ORDER BY completed_at, id) AS rn
        FROM sessions WHERE time_spent_seconds > 0 AND total_questions > 0),
    fold AS (SELECT user_id, topic, rn, CAST(t AS DOUBLE) AS a FROM xs WHERE rn = 1
        UNION ALL SELECT x.user_id, x.topic, x.rn, CASE WHEN f.a = 0 THEN x.t ELSE f.a * 0.7 + x.t * 0.3 END FROM fold f JOIN xs x ON x.user_id = f.user_id AND x.topic = f.topic AND x.rn = f.rn + 1)
    SELECT user_id, topic, ROUND(arg_max(a, rn), 4) AS avg_time FROM fold GROUP BY user_id, topic""")
def _(sessions):
    return S.question_pace(sessions)


@query("D3", "sessions", sql=f"WITH {_COG} SELECT * FROM cog")
def _(sessions):
    return S.cognitive(sessions, AS_OF)


@query("D4", "sessions", sql=f"""
    WITH {_TOPIC}, {_COG},
    weak AS (SELECT user_id, STRING_AGG(topic, ',' ORDER BY rn) AS weak_topics FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY accuracy, topic) AS rn FROM topics WHERE weak) x WHERE rn <= 3 GROUP BY user_id),
    trend AS (SELECT user_id, STRING_AGG(CAST(score AS STRING), ',' ORDER BY completed_at, id) AS recent_scores FROM recent WHERE rn <= 10 GROUP BY user_id),
    total AS (SELECT user_id, COUNT(*) AS sessions, SUM(xp_earned) AS xp, ROUND(COALESCE(100.0 * SUM(score) / NULLIF(SUM(total_questions), 0), 0.0), 4) AS accuracy,
                     GREATEST(1, DATE '2024-01-31' - MIN(date)) AS days FROM sessions GROUP BY user_id)
    SELECT t.user_id, sessions, xp, accuracy, CASE WHEN xp > 0 THEN CAST(CEIL((100 - xp % 100) * days / xp) AS BIGINT) END AS days_to_level,
           COALESCE(weak_topics, '') AS weak_topics, recent_scores, focus, consistency, efficiency
    FROM total t LEFT JOIN weak USING (user_id) LEFT JOIN trend USING (user_id) JOIN cog USING (user_id)""")
def _(sessions):
    return S.dashboard(sessions, AS_OF)


@query("D5", "sessions", sql="""
    WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY completed_at DESC, id DESC) AS rn, ROW_NUMBER() OVER (PARTITION BY user_id, topic ORDER BY completed_at DESC, id DESC) AS tn FROM sessions)
    SELECT user_id, id, topic, 'recent' AS evidence FROM r WHERE rn <= 10
    UNION ALL SELECT user_id, id, topic, 'older' FROM r o WHERE tn = 1 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.rn <= 10 AND x.user_id = o.user_id AND x.topic IS NOT DISTINCT FROM o.topic)""")
def _(sessions):
    return S.topic_evidence(sessions)


@query("E4", "sessions", sql="SELECT user_id, topic, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, topic ORDER BY completed_at DESC, id DESC) AS rn FROM sessions) x WHERE rn = 1")
def _(sessions):
    """Latest row per group."""
    return S.latest(sessions, ["user_id", "topic"], [F.desc("completed_at"), F.desc("id")], 1).select("user_id", "topic", "id")


@query("E5", "sessions", sql="SELECT user_id, id, rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY completed_at DESC, id DESC) AS rn FROM sessions) x WHERE rn <= 5")
def _(sessions):
    """Last five per learner."""
    return S.latest(sessions, ["user_id"], [F.desc("completed_at"), F.desc("id")], 5).select("user_id", "id", F.col("rn").cast("long").alias("rn"))


@query("E6", "sessions", sql="""
    WITH d AS (SELECT DISTINCT user_id, date FROM sessions), i AS (SELECT *, date - CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date) AS INT) AS island FROM d),
    r AS (SELECT user_id, island, COUNT(*) AS streak, MAX(date) AS last_day FROM i GROUP BY user_id, island)
    SELECT user_id, arg_max(streak, last_day) AS streak, MAX(last_day) AS last_day FROM r GROUP BY user_id""")
def _(sessions):
    return S.streaks(sessions)


@query("E7", "sessions", sql=f"WITH {_TOPIC} SELECT user_id, topic, trend FROM topics")
def _(sessions):
    """Accuracy trend against the state before."""
    return S.topic_performance(sessions).select("user_id", "topic", "trend")


@query("I1", "sessions", sql=f"WITH {_REV} SELECT * FROM scores")
def _(sessions):
    return S.revision_scores(S.topic_performance(sessions), AS_OF)


@query("F4", "sessions", sql=f"WITH {_REV} SELECT * FROM (SELECT user_id, topic, bucket, priority, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY bo, priority DESC, topic) AS position FROM ordered) x WHERE position <= 25")
def _(sessions):
    return S.revision_queue(S.revision_scores(S.topic_performance(sessions), AS_OF))


@query("F5", "sessions", sql=f"""
    WITH {_REV}, firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY bo, priority DESC, topic) AS rn FROM ordered),
    g AS (SELECT user_id, COUNT(*) FILTER (bucket = 'overdue') AS overdue, COUNT(*) FILTER (bucket = 'due') AS due, COUNT(*) FILTER (bucket = 'strengthen') AS strengthen, COUNT(*) FILTER (bucket = 'fresh') AS fresh,
                 MAX(CASE WHEN rn = 1 THEN topic END) AS top_topic FROM firsts GROUP BY user_id)
    SELECT *, CASE WHEN overdue > 0 THEN overdue || CASE WHEN overdue = 1 THEN ' topic overdue: start with ' ELSE ' topics overdue: start with ' END || top_topic
                   WHEN due + strengthen > 0 THEN 'review ' || top_topic || ' before it fades' ELSE 'all topics are fresh' END AS message FROM g""")
def _(sessions):
    return S.revision_summary(S.revision_scores(S.topic_performance(sessions), AS_OF))
