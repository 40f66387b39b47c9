"""Event streams drained to tables; each equals its batch form over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.plans.registry import ORACLE, QUERIES
from lumenary.runtime import scratch
from lumenary.streaming import events as S


def _put(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def j1(spark, sf_dir):
    """Events sent twice, and all of them again by a later run from new offsets, arrive once."""
    stream, folder = S.read(spark, sf_dir).withColumn("version", F.col("event_id") + 1), scratch(spark, "j1")
    S.recorded(stream.union(stream), folder, "first", "version")
    return S.recorded(stream, folder, "second", "version").select("event_id", "event_type")


def j1_watermark(spark, sf_dir):
    """Events sent twice arrive once while the watermark may still see them."""
    stream = S.read(spark, sf_dir)
    return S.drained(S.once(stream.union(stream)), "j1").select("event_id", "event_type")


def j2(spark, sf_dir):
    """The feed after a cursor."""
    return S.drained(S.read(spark, sf_dir).where("event_id > 500").select("event_id", "event_type"), "j2")


def j3(spark, sf_dir):
    """Verdicts on requests of six keys, five of each in a day, with the seconds to wait."""
    def plan(e):
        return S.limited(e.withColumn("agent", F.col("user_id") % 6), "agent", 5, 86_400)

    return S.closed(S.read(spark, sf_dir), "j3", plan).where("agent is not null")


def j3_demand(spark, sf_dir):
    """Sliding counters over the limit."""
    return S.closed(S.read(spark, sf_dir), "j3", lambda e: S.breaches(e, "60 minutes", "30 minutes", 1))


_KIND = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'complete' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'error' END WHEN 'signup' THEN 'state' ELSE 'other' END"


def j4(spark, sf_dir):
    """Live agent state: running, idle, failed or paused, health, counters, lapses, latency of the last 50 completions."""
    def plan(e):
        return S.agent_health(e.withColumns({"agent": F.col("user_id") % 6, "kind": F.expr(_KIND), "latency": F.floor(F.col("value") * 10).cast("long"), "state": F.expr("CASE WHEN event_id % 3 = 0 THEN 'paused' ELSE '' END")}), "agent")

    return S.latest_state(S.closed(S.read(spark, sf_dir), "j4", plan), "agent", "step").where("agent is not null")


def j6(spark, sf_dir):
    """Session windows of a day."""
    return S.closed(S.read(spark, sf_dir), "j6", lambda e: S.sessions(e, "12 hours")).select("user_id", "started_at", "events")


def j7(spark, sf_dir):
    """Daily counters by user."""
    return S.closed(S.read(spark, sf_dir), "j7", lambda e: S.windowed(e, "1 day", None, "user_id"))


def j8(spark, sf_dir):
    """Sliding days by type, hourly."""
    return S.closed(S.read(spark, sf_dir), "j8", lambda e: S.windowed(e, "24 hours", "1 hour", "event_type"))


def j9(spark, sf_dir):
    """All events sent again after the stream: those behind the watermark are dropped and counted."""
    again = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.late_rows(S.read(spark, sf_dir), again, "j9")


_put("J1", j1, "SELECT event_id, event_type FROM events")
_put("J1_watermark", j1_watermark, "SELECT event_id, event_type FROM events")
_put("J2", j2, "SELECT event_id, event_type FROM events WHERE event_id > 500")
_SLIDE = "SELECT time_bucket(INTERVAL '{1}', ts, TIMESTAMP '2000-01-01 00:00:00') - k * INTERVAL '{1}' AS window_start, e.* FROM events e, (SELECT UNNEST(range({0})) AS k) r WHERE ts < time_bucket(INTERVAL '{1}', ts, TIMESTAMP '2000-01-01 00:00:00') - k * INTERVAL '{1}' + {0} * INTERVAL '{1}'"
_put("J3_demand", j3_demand, f"SELECT window_start, user_id, COUNT(*) AS events FROM ({_SLIDE.format(2, '30 minutes')}) x GROUP BY 1, 2 HAVING COUNT(*) > 1")
_put("J3", j3, """
    WITH RECURSIVE e AS (SELECT user_id % 6 AS agent, event_id, epoch_us(ts) AS t, ROW_NUMBER() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT DISTINCT agent, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS b, TRUE AS allowed, CAST(NULL AS BIGINT) AS retry_after FROM e
          UNION ALL SELECT agent, rn, event_id, CASE WHEN LEN(l) < 5 THEN list_append(l, t) ELSE l END, LEN(l) < 5, CASE WHEN LEN(l) >= 5 THEN GREATEST(1, (86400000000 - (t - l[1])) // 1000000) END
          FROM (SELECT e.agent, e.rn, e.event_id, e.t, list_filter(f.b, lambda x: x > e.t - 86400000000) AS l FROM f JOIN e ON e.agent = f.agent AND e.rn = f.rn + 1) x)
    SELECT agent, event_id, allowed, retry_after FROM f WHERE rn > 0""")
_put("J4", j4, f"""
    WITH RECURSIVE e AS (SELECT user_id % 6 AS agent, epoch_us(ts) AS t, {_KIND} AS kind, CAST(FLOOR(value * 10) AS BIGINT) AS latency, event_id % 3 = 0 AS paused, ROW_NUMBER() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS rn, LEAD(ts) OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS next, ts FROM events),
    f AS (SELECT DISTINCT agent, CAST(0 AS BIGINT) AS rn, 'idle' AS status, 'healthy' AS health, CAST(0 AS BIGINT) AS requests, CAST(0 AS BIGINT) AS successes, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS lapses, CAST([] AS BIGINT[]) AS recent FROM e
          UNION ALL SELECT agent, rn, CASE WHEN status = 'running' AND gap THEN 'idle' ELSE status END, CASE WHEN status = 'running' AND gap THEN 'warning' ELSE health END, requests, successes, errors, lapses + CAST(status = 'running' AND gap AS BIGINT), recent FROM (
              SELECT e.agent, e.rn, e.next IS NULL OR epoch_us(e.next) - e.t >= 1800000000 AS gap,
              CASE kind WHEN 'start' THEN 'running' WHEN 'complete' THEN 'idle' WHEN 'critical' THEN 'failed' WHEN 'state' THEN CASE WHEN paused THEN 'paused' ELSE status END ELSE status END AS status,
              CASE WHEN kind = 'complete' THEN 'healthy' WHEN kind = 'critical' OR kind = 'error' AND errors >= 4 THEN 'critical' WHEN kind = 'error' THEN 'warning' ELSE health END AS health,
              requests + CAST(kind = 'start' AS BIGINT) AS requests, successes + CAST(kind = 'complete' AS BIGINT) AS successes, errors + CAST(kind IN ('error', 'critical') AS BIGINT) AS errors, lapses,
              CASE WHEN kind = 'complete' AND latency > 0 THEN list_append(recent, latency)[-50:] ELSE recent END AS recent FROM f JOIN e ON e.agent = f.agent AND e.rn = f.rn + 1) x)
    SELECT agent, status, health, requests, successes, errors, lapses, CASE WHEN LEN(recent) > 0 THEN ROUND(list_avg(recent), 1) ELSE 0 END AS latency_ms FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY agent ORDER BY rn DESC) = 1""")
_put("J6", j6, """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts >= LAG(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, MIN(ts) AS started_at, COUNT(*) AS events FROM s GROUP BY user_id, n""")
_put("J7", j7, "SELECT date_trunc('day', ts) AS window_start, user_id, COUNT(*) AS events, ROUND(SUM(value), 2) AS total_value FROM events GROUP BY 1, 2")
_put("J8", j8, f"SELECT window_start, event_type, COUNT(*) AS events, ROUND(SUM(value), 2) AS total_value FROM ({_SLIDE.format(24, '1 hour')}) x GROUP BY 1, 2")
_put("J9", j9, "SELECT COUNT(*) FILTER (ts < (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE) AS late, 2 * COUNT(*) AS rows FROM events")
