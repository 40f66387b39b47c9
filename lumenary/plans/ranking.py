"""Queries of rankings and weekly duels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import ranks as R
from lumenary.operators.sessions import topic_performance
from lumenary.plans.bindings import AS_OF
from lumenary.plans.learners import _TOPIC
from lumenary.plans.registry import query

WEEK = "2024-01-22"
_NAME = "CASE WHEN display_name IS NULL THEN 'Student ' || UPPER(SUBSTR(sha256(CAST(user_id AS STRING)), 1, 6)) WHEN LEN(str_split_regex(TRIM(display_name), '\\s+')) > 1 THEN str_split_regex(TRIM(display_name), '\\s+')[1] || ' ' || SUBSTR(str_split_regex(TRIM(display_name), '\\s+')[-1], 1, 1) || '.' ELSE display_name END"
_ROWS = f"rows_ AS (SELECT user_id, {_NAME} AS name, class_level, xp, streak, total_tests FROM progress LEFT JOIN profiles USING (user_id) WHERE xp > 0 OR streak > 0 OR total_tests > 0)"
_ORDER = "xp DESC, streak DESC, total_tests DESC, LOWER(name), user_id"
_SCORES = """
    ex AS (SELECT user_id, COUNT(*) AS exams, SUM(xp_earned) AS xp, COALESCE(100.0 * SUM(score) / NULLIF(SUM(total_questions), 0), 0.0) AS accuracy, MAX(date) AS last_exam
           FROM sessions WHERE session_type LIKE '%exam%' AND date >= DATE '2024-01-01' GROUP BY user_id),
    scores AS (SELECT user_id, exams, ex.xp, ROUND(accuracy, 4) AS accuracy, ROUND(0.7 * accuracy + 0.3 * LEAST(exams, 8) / 8 * 100, 4) AS seed_score
               FROM ex LEFT JOIN progress USING (user_id) WHERE GREATEST(last_exam, last_active_date) >= DATE '2024-01-17')"""
_PAIRS = f"""{_SCORES},
    r AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY seed_score DESC, user_id) AS p FROM scores),
    o AS (SELECT COALESCE(MAX(p) % 2, 0) AS odd, arg_max(user_id, p) AS last_user FROM r),
    f AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY xp DESC, user_id) - odd AS p, last_user FROM newcomers, o WHERE user_id NOT IN (SELECT user_id FROM scores)),
    taken AS (SELECT user_id, last_user AS rival_user_id, 'fallback' AS match_basis FROM f WHERE p = 0),
    back AS (SELECT rival_user_id AS user_id, user_id AS rival_user_id, match_basis FROM taken),
    seeds AS (SELECT a.user_id, b.user_id AS rival_user_id, CASE WHEN b.user_id IS NULL THEN 'unmatched' ELSE 'seed' END AS match_basis FROM r a LEFT JOIN r b ON CAST(FLOOR((a.p - 1) / 2) AS INT) = CAST(FLOOR((b.p - 1) / 2) AS INT) AND a.p <> b.p WHERE a.user_id NOT IN (SELECT user_id FROM back)),
    g AS (SELECT * FROM f WHERE p > 0),
    news AS (SELECT a.user_id, b.user_id AS rival_user_id, CASE WHEN b.user_id IS NULL THEN 'unmatched' ELSE 'newcomer' END AS match_basis FROM g a LEFT JOIN g b ON CAST(FLOOR((a.p - 1) / 2) AS INT) = CAST(FLOOR((b.p - 1) / 2) AS INT) AND a.p <> b.p),
    pairs AS (SELECT * FROM seeds UNION ALL SELECT * FROM back UNION ALL SELECT * FROM taken UNION ALL SELECT * FROM news)"""
_WEEKS = """
    wk AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week_start, date - CAST(date_trunc('week', date) AS DATE) AS day FROM sessions),
    weeks AS (SELECT user_id, week_start, SUM(xp_earned) AS xp, COUNT(*) AS sessions, ROUND(COALESCE(100.0 * SUM(score) / NULLIF(SUM(total_questions), 0), 0.0), 4) AS accuracy,
                     CAST(SUM(FLOOR(time_spent_seconds / 60)) AS BIGINT) AS minutes, COUNT(DISTINCT date) AS active_days, """ + ", ".join(f"COALESCE(SUM(CASE WHEN day = {k} THEN xp_earned END), 0) AS xp_{k}" for k in range(7)) + """
              FROM wk GROUP BY user_id, week_start)"""  # fmt: skip
_DUELS = f"""
    wx AS (SELECT user_id, xp FROM weeks WHERE week_start = DATE '{WEEK}'),
    d0 AS (SELECT p.user_id, p.rival_user_id, COALESCE(a.xp, 0) AS my_xp, COALESCE(b.xp, 0) AS rival_xp FROM pairs p LEFT JOIN wx a ON a.user_id = p.user_id LEFT JOIN wx b ON b.user_id = p.rival_user_id WHERE p.rival_user_id IS NOT NULL),
    duels AS (SELECT *, CASE WHEN my_xp > rival_xp THEN 'won' WHEN my_xp < rival_xp THEN 'lost' ELSE 'tied' END AS outcome, CASE WHEN my_xp > rival_xp THEN 150 WHEN my_xp < rival_xp THEN 0 ELSE 50 END AS reward FROM d0)"""


def _pairs(sessions, progress, newcomers):
    """Pairs of learners with exams, and of those without (customers of some nations who have no session yet among them)."""
    return R.pairings(R.monthly_scores(sessions, progress, AS_OF), newcomers)


@query("E1", "progress", "profiles", sql=f"""
    WITH {_ROWS}, x AS (SELECT ROW_NUMBER() OVER (ORDER BY {_ORDER}) AS rank, CASE WHEN class_level IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY class_level ORDER BY {_ORDER}) END AS class_rank, * FROM rows_)
    SELECT * FROM x WHERE rank <= 20""")
def _(progress, profiles):
    return R.leaderboard(progress, profiles)


@query("E1_full", "progress", "profiles", sql=f"WITH {_ROWS} SELECT user_id, ROW_NUMBER() OVER (ORDER BY {_ORDER}) AS rank FROM rows_")
def _(progress, profiles):
    return R.full_ranking(progress, profiles)


@query("C1", "progress", "profiles", sql=f"WITH {_ROWS} SELECT * FROM rows_")
def _(progress, profiles):
    return R.leaderboard_rows(progress, profiles)


@query("C2", "progress", "profiles", sql="SELECT user_id, xp, class_level FROM progress JOIN profiles USING (user_id) WHERE class_level = 'BUILDING'")
def _(progress, profiles):
    """Progress of one class."""
    return progress.join(profiles.where("class_level = 'BUILDING'"), "user_id").select("user_id", "xp", "class_level")


@query("B13", "profiles", sql=f"SELECT user_id, {_NAME} AS name, 'Student ' || UPPER(SUBSTR(sha256(CAST(user_id AS STRING)), 1, 6)) AS alias, CASE WHEN user_id = 7 THEN email END AS email FROM profiles")
def _(profiles):
    return R.privacy(profiles, 7)


@query("B16", "progress", sql="SELECT user_id, xp, streak, total_tests FROM progress WHERE xp > 0 OR streak > 0 OR total_tests > 0")
def _(progress):
    return R.active(progress).select("user_id", "xp", "streak", "total_tests")


@query("B17", "sessions", sql="SELECT session_type, CASE WHEN session_type LIKE '%exam%' THEN 'exam' WHEN session_type LIKE '%mission%' THEN 'mission' ELSE 'study' END AS label, COUNT(*) AS n FROM sessions GROUP BY ALL")
def _(sessions):
    """Sessions by type and label."""
    kind = F.lower("session_type")
    label = F.when(kind.contains("exam"), "exam").when(kind.contains("mission"), "mission").otherwise("study")
    return sessions.groupBy("session_type", label.alias("label")).agg(F.count("*").alias("n"))


@query("D6", "sessions", "progress", sql=f"WITH {_SCORES} SELECT * FROM scores")
def _(sessions, progress):
    return R.monthly_scores(sessions, progress, AS_OF)


@query("E2", "sessions", "progress", sql=f"WITH {_SCORES} SELECT user_id, seed_score, ROW_NUMBER() OVER (ORDER BY seed_score DESC, user_id) AS rank FROM scores")
def _(sessions, progress):
    return R.seed_rank(R.monthly_scores(sessions, progress, AS_OF)).select("user_id", "seed_score", "rank")


@query("E3", "sessions", "progress", "newcomers", sql=f"WITH {_PAIRS} SELECT * FROM pairs")
def _(sessions, progress, newcomers):
    return _pairs(sessions, progress, newcomers)


@query("D7", "sessions", sql=f"WITH {_WEEKS} SELECT * FROM weeks")
def _(sessions):
    return R.weekly(sessions)


@query("C10", "sessions", "progress", "newcomers", sql=f"WITH {_PAIRS}, {_WEEKS}, {_DUELS} SELECT * FROM duels")
def _(sessions, progress, newcomers):
    return R.duels(_pairs(sessions, progress, newcomers), R.weekly(sessions), WEEK)


@query("C6", "sessions", "progress", "newcomers", sql=f"WITH {_SCORES} SELECT user_id, xp FROM newcomers WHERE user_id NOT IN (SELECT user_id FROM scores)")
def _(sessions, progress, newcomers):
    """Newcomers: learners that aren't ranked."""
    return newcomers.join(R.monthly_scores(sessions, progress, AS_OF), "user_id", "left_anti")


@query("D8", "sessions", sql="""
    WITH p AS (SELECT user_id, COALESCE(SUM(CASE WHEN date = DATE '2024-01-31' THEN xp_earned END), 0) AS today_xp, COALESCE(SUM(CASE WHEN date >= DATE '2024-01-17' AND date < DATE '2024-01-31' THEN xp_earned END), 0) / 14 AS pace FROM sessions GROUP BY user_id),
    t AS (SELECT user_id, topic, COALESCE(100.0 * SUM(score) / NULLIF(SUM(total_questions), 0), 0.0) AS acc, COUNT(*) AS n FROM sessions GROUP BY user_id, topic),
    w AS (SELECT user_id, topic AS weakest_topic FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY acc, n DESC, topic) AS rn FROM t) x WHERE rn = 1)
    SELECT user_id, today_xp, ROUND(pace, 4) AS pace, weakest_topic, GREATEST(30, LEAST(150, CAST(ROUND(pace * 1.2 / 10 + 1e-9) * 10 AS INT))) AS target_xp FROM p JOIN w USING (user_id)""")
def _(sessions):
    return R.missions(sessions, AS_OF)


@query("D53", "sessions", "progress", "newcomers", sql=f"""
    WITH {_PAIRS}, {_WEEKS}, {_DUELS}, tot AS (SELECT user_id, SUM(xp_earned) AS total_xp FROM sessions GROUP BY user_id)
    SELECT d.*, COALESCE(w.sessions, 0) AS sessions, COALESCE(w.accuracy, 0) AS accuracy, COALESCE(w.active_days, 0) AS active_days, COALESCE(total_xp, 0) AS total_xp, CAST(FLOOR(COALESCE(total_xp, 0) / 100) + 1 AS BIGINT) AS level
    FROM duels d LEFT JOIN (SELECT * FROM weeks WHERE week_start = DATE '{WEEK}') w USING (user_id) LEFT JOIN tot USING (user_id)""")
def _(sessions, progress, newcomers):
    return R.challenge(sessions, _pairs(sessions, progress, newcomers), WEEK)


@query("D9", "progress", "sessions", sql="SELECT COUNT(*) AS learners, SUM(total_tests) AS tests, SUM(xp) AS xp, MAX(streak) AS best_streak, (SELECT COUNT(*) FROM sessions WHERE date >= DATE '2024-01-24') AS week_sessions FROM progress")
def _(progress, sessions):
    return R.pulse(progress, sessions, AS_OF)


@query("F8", "progress", "profiles", sql="SELECT user_id, display_name, last_active_date, xp FROM progress LEFT JOIN profiles USING (user_id) ORDER BY COALESCE(last_active_date, DATE '1970-01-01') DESC, xp DESC, user_id LIMIT 50")
def _(progress, profiles):
    return R.students(progress, profiles)


@query("C16", "progress", "sessions", sql=f"""
    WITH {_TOPIC}, five AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY completed_at DESC, id DESC) AS rn FROM sessions) x WHERE rn <= 5),
    rec AS (SELECT user_id, MAX(CASE WHEN rn = 1 THEN topic END) AS last_topic, STRING_AGG(CAST(score AS STRING), ',' ORDER BY rn) AS last_scores FROM five GROUP BY user_id),
    wk AS (SELECT user_id, COUNT(*) AS weak_topics FROM topics WHERE weak GROUP BY user_id)
    SELECT user_id, xp, last_topic, last_scores, COALESCE(weak_topics, 0) AS weak_topics FROM progress LEFT JOIN rec USING (user_id) LEFT JOIN wk USING (user_id)""")
def _(progress, sessions):
    return R.student_lookup(progress, sessions, topic_performance(sessions))


@query("F1", "sessions", sql="WITH p AS (SELECT user_id, id, completed_at, COUNT(*) OVER () AS total FROM sessions WHERE user_id = 1) SELECT id, total, total > 15 AS has_more FROM p ORDER BY completed_at DESC, id DESC LIMIT 10 OFFSET 5")
def _(sessions):
    """The second page of one learner's sessions, with the total."""
    mine = sessions.where("user_id = 1").select("id", "completed_at")
    total = mine.groupBy().agg(F.count("*").alias("total"))
    return mine.orderBy(F.desc("completed_at"), F.desc("id")).offset(5).limit(10).crossJoin(total).select("id", "total", (F.col("total") > 15).alias("has_more"))


@query("F2", "sessions", sql="SELECT id, completed_at FROM sessions WHERE completed_at < TIMESTAMP '2024-01-20 00:00:00' OR completed_at = TIMESTAMP '2024-01-20 00:00:00' AND id < 5000 ORDER BY completed_at DESC, id DESC LIMIT 51")
def _(sessions):
    """A keyset page, newest first, with one row to look ahead."""
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return sessions.where((F.col("completed_at") < at) | (F.col("completed_at") == at) & (F.col("id") < 5000)).select("id", "completed_at").orderBy(F.desc("completed_at"), F.desc("id")).limit(51)


@query("G2", "sessions", "traces", "profiles", sql="SELECT user_id FROM sessions UNION SELECT user_id FROM traces UNION SELECT user_id FROM profiles")
def _(sessions, traces, profiles):
    """The distinct users of three tables."""
    return sessions.select("user_id").union(traces.select("user_id")).union(profiles.select("user_id")).distinct()


@query("H10", "sessions", sql="SELECT DISTINCT date, CAST(date_trunc('week', date) AS DATE) AS week_start, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, 7 - (date - CAST(date_trunc('week', date) AS DATE)) AS days_remaining FROM sessions")
def _(sessions):
    """Week bounds and the days that remain, this one included."""
    start = F.date_trunc("week", "date").cast("date")
    return sessions.select("date", start.alias("week_start"), F.date_add(start, 6).alias("week_end"), (7 - F.datediff("date", start)).cast("long").alias("days_remaining")).distinct()
