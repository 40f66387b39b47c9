"""Queries of sources."""

from __future__ import annotations


from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.plans.content import _KEY
from lumenary.plans.registry import ORACLE, QUERIES, query
from lumenary.runtime import scratch
from lumenary.sources import files as S

_TITLE = "array_to_string(list_transform(string_split(TRIM(regexp_replace(regexp_replace({0}, '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: UPPER(SUBSTR(w, 1, 1)) || LOWER(SUBSTR(w, 2))), ' ')"


def a1(spark, sf_dir: str):
    """Events of the declared types; their times are with or without a zone as the file has them."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType.simpleString()
    return S.typed(spark, f"{sf_dir}/events.parquet", f"event_id long, ts {kind}, user_id long, event_type string, value double, props string")


def a2(spark, sf_dir: str):
    """The HTML of all pages as a folder of files, a line each, read back: pages and characters of each, or why it needs review."""
    root = scratch(spark, "folder")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("class_"), F.col("page_id") % 3 + 9).alias("grade"), F.concat(F.lit("subject_"), F.col("page_id") % 5).alias("topic"), F.regexp_replace("html", "[\\r\\n\\f]+", " ").alias("html"))
    rows = pages.unionByName(pages.select("grade", F.lit("blank").alias("topic"), F.lit(" ").alias("html")).distinct())
    rows.repartition("grade", "topic").write.mode("overwrite").partitionBy("grade", "topic").text(root)
    got, errors = S.ingested(S.folder(spark, root))
    folder = F.regexp_extract("path", "^(.*)/", 1)
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    good = got.groupBy(folder.alias("folder")).agg(F.count("*").alias("pages"), F.sum(lines).cast("long").alias("lines"), F.sum(F.length(F.regexp_replace("text", "\n", ""))).cast("long").alias("chars"))
    zero = F.lit(0).cast("long")
    bad = errors.select(folder.alias("folder"), zero.alias("pages"), zero.alias("lines"), zero.alias("chars"), F.concat(F.lit("needs_review: "), F.col("error")).alias("status"))
    return good.withColumn("status", F.lit("completed")).unionByName(bad)


QUERIES["A1"], QUERIES["A2"] = a1, a2
ORACLE["A1"] = "SELECT event_id, ts, user_id, event_type, value, props FROM events"
ORACLE["A2"] = """
    SELECT 'class_' || (page_id % 3 + 9) || '/subject_' || (page_id % 5) AS folder, 1 AS pages, COUNT(*) AS lines, CAST(SUM(LENGTH(regexp_replace(html, '[\\r\\n\\f]+', ' ', 'g'))) AS BIGINT) AS chars, 'completed' AS status FROM pages GROUP BY 1
    UNION ALL SELECT DISTINCT 'class_' || (page_id % 3 + 9) || '/blank', 0, 0, 0, 'needs_review: empty' FROM pages"""

_PATH = "CASE p_partkey % 4 WHEN 0 THEN 'NCERT/Class_' || (p_size % 4 + 9) || '/' || p_brand || '/chapter_' || (p_size % 20) || '_' || p_name || '.pdf' WHEN 1 THEN 'raw/books of ' || p_brand || '/physics/' || (p_size % 20) || ' - ' || p_name || '.PDF' WHEN 2 THEN 'x/class 11/Ch-' || (p_size % 20) || '.pdf' ELSE p_name || '.pdf' END"
_F = f"""
    p AS (SELECT p_partkey, {_PATH} AS path FROM part), s AS (SELECT *, string_split(path, '/') AS parts, regexp_replace(string_split(path, '/')[-1], '\\.[A-Za-z0-9]+$', '') AS stem FROM p),
    t AS (SELECT *, CASE WHEN LEN(parts) > 1 THEN {_KEY.format('parts[-2]')} ELSE '' END AS s0, CASE WHEN LEN(parts) > 2 THEN {_KEY.format('parts[-3]')} ELSE '' END AS b0, regexp_extract(array_to_string(list_transform(parts, lambda x: {_KEY.format('x')}), '/'), 'class_?([0-9]{{1,2}})', 1) AS class_level,
          COALESCE(NULLIF(regexp_extract(stem, '(?i)(?:chapter|chap|ch)[_\\-\\s]*([0-9]{{1,3}})', 1), ''), NULLIF(regexp_extract(stem, '\\b([0-9]{{1,3}})\\b', 1), '')) AS no,
          regexp_replace(regexp_replace(regexp_replace(stem, '(?i)(?:chapter|chap|ch)[_\\-\\s]*[0-9]{{1,3}}', ''), '^[0-9]{{1,3}}[_\\-\\s]*', ''), '^[ _\\-]+|[ _\\-]+$', '', 'g') AS bare FROM s),
    u AS (SELECT *, CASE WHEN s0 LIKE 'class%' THEN '' ELSE {_TITLE.format('s0')} END AS subject, CASE WHEN b0 LIKE 'class%' THEN '' ELSE {_TITLE.format('b0')} END AS book, CAST(no AS INT) AS chapter_number, {_TITLE.format("CASE WHEN bare = '' THEN 'Chapter ' || CAST(CAST(no AS INT) AS STRING) ELSE bare END")} AS chapter_name FROM t)"""
_SLUG = _KEY.format("array_to_string(list_filter(['NCERT', CASE WHEN class_level <> '' THEN 'class_' || class_level END, NULLIF(subject, ''), 'chapter_' || COALESCE(CAST(chapter_number AS STRING), ''), chapter_name], lambda x: x IS NOT NULL), '_')")


@query("A3", "part", sql=f"WITH {_F} SELECT p_partkey, class_level, subject, book, chapter_number, chapter_name, {_SLUG} AS slug FROM u")
def _(part):
    """What the paths of chapters' files tell."""
    return part.select("p_partkey", F.expr(_PATH).alias("path")).select("p_partkey", *S.path_fields(F.col("path")))


@query("A6", "part", sql="""
    WITH r AS (SELECT p_brand AS name, p_size AS id, p_partkey, p_name AS title, ROW_NUMBER() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey DESC) AS rn FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 10 <> 7)
    SELECT name, CAST(id AS STRING) AS id, title, CAST(NULL AS STRING) AS error FROM r WHERE rn = 1 UNION ALL SELECT p_brand, NULL, NULL, CASE WHEN p_partkey % 10 = 7 THEN 'not_an_array' ELSE 'missing_id' END FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 10 = 7""")
def _(part):
    """Concepts of JSON arrays, the last of each id; items without an id, and payloads that are no array, as errors."""
    item = F.struct(F.when(F.col("p_partkey") % 9 != 0, F.col("p_size").cast("string")).alias("id"), F.col("p_name").alias("title"))
    payload = F.when(F.col("p_partkey") % 10 == 7, "{broken").otherwise(F.to_json(F.array(item)))
    items, errors = S.concept_arrays(part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"), payload.alias("payload")), "id string, title string")
    none = F.lit(None).cast("string")
    return items.withColumn("error", none).unionByName(errors.select("name", none.alias("id"), none.alias("title"), "error"))


_SAME = "p_brand AS board, p_size % 4 AS class_level, p_size % 6 AS subject, p_partkey % 40 AS chapter_number"


@query("A14", "part", sql=f"""
    WITH ch AS (SELECT p_partkey AS chapter_id, 's' || p_partkey AS slug, {_SAME}, sha256(p_type) AS h FROM part WHERE p_partkey % 3 = 0),
    f AS (SELECT p_partkey AS file_id, 's' || (p_partkey - p_partkey % 5) AS slug, {_SAME}, sha256(p_type) AS h FROM part),
    a AS (SELECT board, class_level, subject, chapter_number, COUNT(*) AS n, MIN(chapter_id) AS only_id FROM ch GROUP BY ALL), e AS (SELECT board, class_level, subject, chapter_number, h, COUNT(*) AS m, MIN(chapter_id) AS hash_id FROM ch GROUP BY ALL),
    j AS (SELECT file_id, ch.chapter_id AS slug_id, n, only_id, m, hash_id FROM f LEFT JOIN ch ON ch.slug = f.slug LEFT JOIN a ON a.board = f.board AND a.class_level = f.class_level AND a.subject = f.subject AND a.chapter_number = f.chapter_number LEFT JOIN e ON e.board = f.board AND e.class_level = f.class_level AND e.subject = f.subject AND e.chapter_number = f.chapter_number AND e.h = f.h)
    SELECT file_id, CASE WHEN slug_id IS NOT NULL THEN 'slug' WHEN m = 1 THEN 'hash' WHEN n = 1 THEN 'identity' WHEN n > 1 THEN 'ambiguous' ELSE 'new' END AS way, CASE WHEN slug_id IS NOT NULL THEN slug_id WHEN m = 1 THEN hash_id WHEN n = 1 THEN only_id END AS chapter_id FROM j""")
def _(part):
    """Which stored chapter each file is."""
    same = [F.col("p_brand").alias("board"), (F.col("p_size") % 4).alias("class_level"), (F.col("p_size") % 6).alias("subject"), (F.col("p_partkey") % 40).alias("chapter_number"), F.sha2("p_type", 256).alias("source_hash")]
    slug = lambda c: F.concat(F.lit("s"), c.cast("string")).alias("slug")
    k = F.col("p_partkey")
    return S.identified(part.select(k.alias("file_id"), slug(k - k % 5), *same), part.where(k % 3 == 0).select(k.alias("chapter_id"), slug(k), *same))


# Names of one thing in chemistry texts.
SYNONYMS = {
    "formula": ("general formula", "molecular formula", "chemical formula"), "alkane": ("alkanes", "paraffin", "paraffins", "saturated hydrocarbon"), "alkene": ("alkenes", "olefin", "olefins", "unsaturated hydrocarbon"),
    "alkyne": ("alkynes", "acetylene", "acetylenes"), "aromatic": ("aromatics", "arene", "arenes", "benzene"), "isomer": ("isomerism", "isomers", "structural isomer", "chain isomer"),
    "reaction": ("reactions", "reacts", "reactivity", "chemical reaction"), "property": ("properties", "physical properties", "chemical properties"), "preparation": ("prepare", "prepared", "synthesis", "method of preparation"),
    "nomenclature": ("naming", "iupac", "iupac nomenclature", "iupac name"), "boiling point": ("boiling points", "b.p.", "bp"), "melting point": ("melting points", "m.p.", "mp"),
}
_GROUPS = ", ".join("[" + ", ".join(f"'{x}'" for x in (k, *v)) + "]" for k, v in SYNONYMS.items())
_WORD3 = "list_filter(list_distinct(regexp_extract_all(LOWER({0}), '[a-z0-9_]+')), lambda w: LEN(w) > 2)"


@query("I9", "benchmark", sql=f"""
    WITH w AS (SELECT item_id, {_WORD3.format('text')} AS ws FROM benchmark), g AS (SELECT UNNEST([{_GROUPS}]) AS names),
    m AS (SELECT item_id, UNNEST(names) AS term FROM w, g WHERE LEN(list_filter(ws, lambda a: LEN(list_filter(names, lambda n: contains(n, a))) > 0)) > 0), a AS (SELECT item_id, term FROM m UNION SELECT item_id, UNNEST(ws) FROM w)
    SELECT item_id, COUNT(*) AS terms, sha256(STRING_AGG(term, ',' ORDER BY term)) AS terms_sha256 FROM a GROUP BY 1""")
def _(benchmark):
    """Words of every item with the names of what any of them is part of."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))), lambda w: F.length(w) > 2)
    groups = [F.array(*(F.lit(x) for x in (k, *v))) for k, v in SYNONYMS.items()]
    part_of = lambda g: F.exists("ws", lambda w: F.exists(g, lambda n: F.contains(n, w)))
    more = [F.when(part_of(g), g).otherwise(F.array().cast("array<string>")) for g in groups]
    rows = benchmark.withColumn("ws", words).select("item_id", F.array_sort(F.array_distinct(F.concat("ws", *more))).alias("terms"))
    return rows.select("item_id", F.size("terms").cast("long").alias("terms"), F.sha2(F.array_join("terms", ","), 256).alias("terms_sha256")).where("terms > 0")


@query("H11", "events", sql="SELECT event_id, CASE WHEN CAST(ts + INTERVAL 330 MINUTE AS TIME) < TIME '06:30:00' THEN date_trunc('day', ts + INTERVAL 330 MINUTE) ELSE date_trunc('day', ts + INTERVAL 330 MINUTE) + INTERVAL 1 DAY END + INTERVAL 390 MINUTE - INTERVAL 330 MINUTE AS next_run FROM events")
def _(events):
    """The next half past six in Kolkata after each event."""
    return events.select("event_id", X.next_run(F.col("ts").cast("timestamp"), "Asia/Kolkata", 6, 30).cast("timestamp_ntz").alias("next_run"))


@query("I39", "events", sql="SELECT user_id, event_type AS unit_id, CAST(FLOOR(event_id / 3) AS BIGINT) AS interaction_id, MIN(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3")
def _(events):
    """Learning events, the first of each interaction with a unit."""
    rows = events.where("event_type <> 'error'").select("user_id", F.col("event_type").alias("unit_id"), F.floor(F.col("event_id") / 3).alias("interaction_id"), "event_id")
    return rows.groupBy("user_id", "unit_id", "interaction_id").agg(F.min("event_id").alias("event_id"))
