"""The logical inputs as views of the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.runtime import dealt

AS_OF = "2024-01-31 00:00:00"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
#: Tells lines apart: an order has line numbers twice.
LINE = "(((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + CAST(FLOOR(l_extendedprice) AS BIGINT) % 1000)"
#: A chapter has a few hundred units at any size: those of one brand among 5,000 neighbouring parts.
CHAPTER = "CONCAT(p_brand, '-', CAST(CAST(FLOOR(p_partkey / 5000) AS BIGINT) AS STRING))"

VIEWS = {
    "sessions": f"""
        SELECT event_id AS id, user_id, CAST(ts AS DATE) AS date, event_type AS topic, 10 AS total_questions,
               {_K} % 11 AS score, ({_K} % 11) * 10 AS xp_earned, CAST(FLOOR(value) AS INT) AS time_spent_seconds,
               value % 100 AS focus_score, ({_K} % 11) * CAST(10 AS DOUBLE) AS accuracy_rate,
               CASE WHEN event_type IN ('purchase', 'click') THEN 'exam' ELSE 'study' END AS session_type,
               ts AS completed_at, CAST(FLOOR(value * 10) AS INT) AS response_latency_ms,
               CAST(event_id % 3 AS INT) AS hint_count, CAST(event_id % 2 AS INT) AS retry_count,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_K} % 6 / CAST(5 AS DOUBLE) END AS confidence_before,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE {_K} % 5 / CAST(4 AS DOUBLE) END AS confidence_after
        FROM events""",
    "raw_sessions": f"""
        SELECT event_id AS id, user_id, {_K} - 5 AS score, 10 AS total_questions, value - 50 AS focus_score,
               CAST(FLOOR(value) AS INT) - 100 AS time_spent_seconds, CAST(event_id % 5 AS INT) - 1 AS hint_count,
               ts AS started_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 90 SECOND END AS completed_at
        FROM events""",
    "progress": f"""
        SELECT user_id, COUNT(*) AS total_tests, SUM(10) AS total_questions, SUM({_K} % 11) AS total_correct,
               SUM(({_K} % 11) * 10) AS xp, CAST(user_id % 9 AS INT) AS streak, MAX(CAST(ts AS DATE)) AS last_active_date
        FROM events GROUP BY user_id""",
    "newcomers": f"""
        SELECT user_id, SUM(({_K} % 11) * 10) AS xp FROM events GROUP BY user_id
        UNION ALL SELECT c_custkey, CAST(c_custkey * 7 % 400 AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""",
    "profiles": """
        SELECT c_custkey AS user_id, c_name AS display_name, c_mktsegment AS class_level,
               LOWER(c_name) AS email, c_custkey % 7 <> 0 AS onboarding_completed
        FROM customer""",
    "traces": f"""
        SELECT event_id AS id, ts AS created_at, user_id, CAST(FLOOR(event_id / 5) AS BIGINT) AS turn_id,
               CASE event_type WHEN 'click' THEN 'model' WHEN 'purchase' THEN 'tool' WHEN 'signup' THEN 'dispatch' ELSE 'turn' END AS trace_type,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 17 = 0 THEN 'skipped' WHEN event_id % 13 = 0 THEN 'review' ELSE 'success' END AS status,
               CONCAT('agent', CAST(user_id % 6 AS STRING)) AS agent, CONCAT('p', CAST(user_id % 3 AS STRING)) AS provider,
               CONCAT('m', CAST(user_id % 4 AS STRING)) AS model, CAST(FLOOR(value * 10) AS INT) AS latency_ms,
               CAST(FLOOR(value) AS INT) AS estimated_input_tokens, {_K} AS estimated_output_tokens,
               CAST({_K} AS DOUBLE) / 100000 AS estimated_cost_usd, CAST({_K} % 101 AS DOUBLE) / 100 AS quality, {_K} % 2 AS grounded
        FROM events""",
    "obs_events": f"""
        SELECT event_id AS event_version, ts AS created_at, CONCAT('agent', CAST(user_id % 6 AS STRING)) AS agent_id, event_type,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'critical' ELSE 'info' END AS severity,
               CAST(user_id AS STRING) AS session_id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'job' END AS source,
               CAST(FLOOR(value * 10) AS INT) AS latency_ms, CAST({_K} AS DOUBLE) / 100000 AS estimated_cost_usd
        FROM events""",
    "interactions": """
        SELECT conv_id AS session_id, turn AS id, role, text AS message FROM conversations""",
    "answers": """
        SELECT conv_id, turn, role, text AS answer, LAG(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question,
               CASE WHEN turn > 1 THEN FIRST_VALUE(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS context,
               CASE (conv_id + turn) % 10 WHEN 0 THEN 'definition' WHEN 1 THEN 'comparison' WHEN 2 THEN 'numerical' WHEN 3 THEN 'exam_answer' WHEN 4 THEN 'revision'
                    WHEN 5 THEN 'quiz' WHEN 6 THEN 'stuck' WHEN 7 THEN 'planning' WHEN 8 THEN 'conversation' ELSE 'concept' END AS format,
               CASE (conv_id + turn) % 5 WHEN 0 THEN 'summary' WHEN 1 THEN 'explain' WHEN 2 THEN 'exam' WHEN 3 THEN 'keypoints' ELSE 'study' END AS mode
        FROM conversations""",
    "questions": """
        SELECT l_orderkey AS paper_id, l_linenumber * 1000000 + l_partkey AS question_number, o_custkey AS user_id, o_orderpriority AS subject,
               CAST(FLOOR(l_quantity) AS INT) AS marks, l_returnflag AS question_type, l_linestatus AS difficulty, p_brand AS topic
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "weakness_signals": """
        SELECT o_custkey AS user_id, o_orderpriority AS subject, p_brand AS topic, l_returnflag AS weakness_type, l_shipdate AS seen_at,
               CONCAT('work on ', p_brand) AS suggestion, l_orderkey AS paper_id, l_linenumber * 1000000 + l_partkey AS question_number
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "attempts": f"""
        SELECT {LINE} AS id, l_orderkey AS session_id, o_custkey AS user_id, l_quantity AS marks_total,
               o_orderpriority AS subject, p_brand AS topic, l_shipdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "feedback": f"""
        SELECT {LINE} * 10 + 1 AS id, {LINE} AS attempt_id,
               FLOOR(l_quantity * (1 - l_discount)) AS marks_awarded, l_quantity AS marks_total
        FROM lineitem WHERE l_linenumber % 3 <> 0
        UNION ALL
        SELECT {LINE} * 10 + 2, {LINE}, FLOOR(l_quantity * 0.5), l_quantity
        FROM lineitem WHERE l_linenumber % 2 = 0""",
    "units": f"""
        SELECT CONCAT(p_brand, ':', CAST(p_partkey AS STRING)) AS unit_id, {CHAPTER} AS chapter, p_name AS title, p_partkey,
               ROW_NUMBER() OVER (PARTITION BY p_brand, CAST(FLOOR(p_partkey / 5000) AS BIGINT) ORDER BY p_size, p_partkey) AS unit_order,
               p_size AS difficulty, p_retailprice AS weight
        FROM part""",
    "concept_rows": f"""
        SELECT p_partkey, {CHAPTER} AS chapter, CASE WHEN p_partkey % 11 = 0 THEN LOWER(p_brand) ELSE CONCAT('c', CAST(p_partkey AS STRING)) END AS concept_id,
               p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS definition, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS explanation,
               CASE WHEN p_partkey % 2 = 1 THEN '' ELSE p_type END AS points, CAST(p_size AS BIGINT) AS page, p_size % 5 + 1 AS difficulty,
               CASE p_partkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'important' ELSE 'core' END AS importance
        FROM part""",
    "concept_pages": f"""
        SELECT {CHAPTER} AS chapter, CAST(p_size AS BIGINT) AS page, CASE WHEN p_size % 10 = 9 THEN 0 ELSE CAST(LENGTH(p_name) AS INT) END AS chars FROM part WHERE p_size <= 46""",
    # vectors, concepts and pages of documents' sources; some sources lack a layer or a vector
    "release_rows": """
        SELECT source AS chapter, 'chunk' AS layer, doc_id AS key, text AS payload FROM documents
        UNION ALL SELECT source, 'vector', doc_id, CONCAT('v', CAST(label AS STRING)) FROM documents JOIN embeddings ON vec_id = doc_id % 100 WHERE NOT (source = 'src4' AND doc_id % 9 = 0)
        UNION ALL SELECT CONCAT('src', CAST(p_partkey % 20 AS STRING)), 'concept', p_partkey, p_name FROM part WHERE p_partkey % 20 <> 7
        UNION ALL SELECT CONCAT('src', CAST(page_id % 20 AS STRING)), 'page', page_id, html FROM pages WHERE page_id % 20 <> 9""",
    "live_rows": """
        SELECT chapter, layer, key, CASE WHEN chapter = 'src6' AND key % 11 = 0 THEN CONCAT(payload, 'x') ELSE payload END AS payload FROM (
            SELECT source AS chapter, 'chunk' AS layer, doc_id AS key, text AS payload FROM documents
            UNION ALL SELECT CONCAT('src', CAST(p_partkey % 20 AS STRING)), 'concept', p_partkey, p_name FROM part
            UNION ALL SELECT 'src2', 'concept', p_partkey + 1000000, p_name FROM part WHERE p_partkey % 50 = 0) x
        WHERE chapter <> 'src3' AND NOT (chapter = 'src5' AND key % 7 = 0)""",
    "chunks": """
        SELECT doc_id AS chunk_id, source AS chapter, lang AS subject, text, CAST(doc_id % 50 AS INT) AS page_start,
               CAST(doc_id % 50 + doc_id % 3 AS INT) AS page_end, n_chars
        FROM documents""",
}
#: Each line with its order and its part, and the views of just that.
LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
BY_LINE = {v for v, q in VIEWS.items() if LINES in q}
#: Lines that a task of a join takes at most, about.
TASK_ROWS = 250_000
#: Tables or views that each view reads.
READS = {v: [t for t in TABLES if re.search(rf"\b{t}\b", q)] for v, q in VIEWS.items()}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view of VIEWS."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    if name in BY_LINE:
        lines = order_lines(*(source(spark, sf_dir, t) for t in ("lineitem", "orders", "part")))
        return spark.sql(text.replace(LINES, "{lines}"), lines=lines)
    for t in READS[name]:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: source(spark, sf_dir, t) for t in READS[name]})


def tasks_for(rows: DataFrame) -> int | None:
    """How many tasks rows (of a table) need, if that is more than the session's number of shuffle partitions."""
    tasks = -(-rows.count() // TASK_ROWS)
    return tasks if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def order_lines(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """LINES (part: parts, or units by p_partkey), by part first and by order last, so that what follows finds an order's lines together.

    If the session's number of shuffle partitions gives tasks of over TASK_ROWS lines, they are dealt to more.
    """
    tasks = tasks_for(lineitem)
    placed = dealt(lineitem, tasks, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return dealt(placed, tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def with_views(sql: str) -> str:
    """The query with the views that it reads in front, for DuckDB."""
    used = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = re.sub(r"^\s*WITH RECURSIVE\s", "WITH ", sql, count=1).strip()
    start = "WITH RECURSIVE" if "WITH RECURSIVE" in sql else "WITH"
    return f"{start} {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"{start} {head} {body}"
