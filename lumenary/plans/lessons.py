"""Queries of lessons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenary.operators import lessons as L
from lumenary.plans.registry import query

_Q = lambda x: "'" + x.replace("'", "''") + "'"


_LABEL = "CASE WHEN contains(LOWER({0}), ' is ') THEN split_part({0}, ' is ', 1) WHEN contains(LOWER({0}), ' are ') THEN split_part({0}, ' are ', 1) ELSE array_to_string(string_split({0}, ' ')[1:4], ' ') END"
_CUT = lambda c, other: f"COALESCE(NULLIF(TRIM(SUBSTR({_LABEL.format(c)}, 1, 34)), ''), {other})"


@query("I40", "concept_rows", sql=f"""
    WITH c AS (SELECT *, 'c' || p_partkey AS id, CASE WHEN points = '' THEN [] ELSE string_split(points, ' ') END AS pts, CASE WHEN p_partkey % 4 < 2 THEN CASE WHEN points = '' THEN [] ELSE string_split(points, ' ') END ELSE [] END AS props, p_partkey % 3 = 1 AS wrong FROM concept_rows),
    pt AS (SELECT *, UNNEST(pts) AS x, generate_subscripts(pts, 1) AS k FROM c), pr AS (SELECT *, UNNEST(props) AS x, generate_subscripts(props, 1) AS k FROM c),
    cards AS (SELECT id, 'definition' AS kind, 0 AS o, 'What is ' || title || '?' AS label, definition AS text FROM c WHERE definition <> '' UNION ALL SELECT id, 'key point', k, {_CUT('x', "'Key idea ' || k")}, x FROM pt WHERE k <= 6
        UNION ALL SELECT id, 'example', 10, 'An example of ' || title, explanation FROM c WHERE explanation <> '' UNION ALL SELECT id, 'core', 20, 'Core idea of ' || title, explanation FROM c WHERE definition = '' AND pts = [] AND explanation = ''),
    f AS (SELECT id, 'rate = ' || title || ' per ' || p_partkey AS x, title FROM c WHERE p_partkey % 5 = 0)
    SELECT id AS concept_id, 'map' AS artifact, 'core' AS kind, 0 AS position, title AS label, CASE WHEN definition <> '' THEN definition ELSE explanation END AS text, '' AS note FROM c
    UNION ALL SELECT id, 'map', 'property', k, x, x, 'includes' FROM pr WHERE k <= 7 UNION ALL SELECT id, 'map', 'property', k, {_CUT('x', "'Point ' || k")}, x, 'includes' FROM pt WHERE props = [] AND k <= 5
    UNION ALL SELECT c.id, 'map', 'related', k, COALESCE(o.title, 'C' || (c.p_partkey + k)), '', 'connects' FROM c CROSS JOIN (SELECT UNNEST([1, 2, 3]) AS k) x LEFT JOIN c o ON o.p_partkey = c.p_partkey + k
    UNION ALL SELECT c.id, 'map', 'prerequisite', k, COALESCE(o.title, 'C' || (c.p_partkey - k)), '', 'supports' FROM c CROSS JOIN (SELECT UNNEST([1, 2]) AS k) x LEFT JOIN c o ON o.p_partkey = c.p_partkey - k WHERE c.p_partkey > k
    UNION ALL SELECT * FROM (SELECT id, 'card', kind, ROW_NUMBER() OVER (PARTITION BY id ORDER BY o) AS position, label, text, '' FROM cards) y WHERE position <= 8
    UNION ALL SELECT id, 'formula', 'formula', 1, 'rate', x, array_to_string(list_filter(list_distinct_ordered, lambda w: w NOT IN ('rate', 'per')), ',') FROM (SELECT id, x, string_split(title, ' ') AS list_distinct_ordered FROM f) z
    UNION ALL SELECT id, 'mistake', 'mistake', 1, 'Mixing ' || title, CASE WHEN p_partkey % 2 = 0 THEN 'Keep ' || title ELSE 'Compare it with the key points.' END, 'medium' FROM c WHERE wrong""")
def _(concept_rows):
    """Maps, cards, formulas and mistakes of all concepts."""
    k, nothing = F.col("p_partkey"), F.array().cast("array<string>")
    ids = lambda step, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("c"), (k + step * i).cast("string")))
    before = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(k > i, F.concat(F.lit("c"), (k - i).cast("string")))), lambda x: x.isNotNull())
    points = F.when(F.col("points") == "", nothing).otherwise(F.split("points", " "))
    formula = F.when(k % 5 == 0, F.array(F.concat(F.lit("rate = "), "title", F.lit(" per "), k.cast("string"))))
    mistake = F.struct(F.concat(F.lit("Mixing "), "title").alias("mistake"), F.when(k % 2 == 0, F.concat(F.lit("Keep "), "title")).alias("correction"), F.lit("").alias("frequency"))
    return L.artifacts(concept_rows.select(F.concat(F.lit("c"), k.cast("string")).alias("concept_id"), "title", "definition", "explanation", points.alias("points"), F.when(k % 4 < 2, points).alias("properties"), ids(1, 5).alias("related"), before.alias("prerequisites"), F.array("explanation").alias("examples"), formula.alias("formulas"), F.when(k % 3 == 1, F.array(mistake)).alias("mistakes")))


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(LOWER(x), {_Q(p)}) THEN '{n}'" for n, p in L.ROLES)
_TEXT = "CONCAT(text, CASE WHEN doc_id % 2 = 0 THEN ' Example: Given 3 m in 2 s, speed = 1.5 only. Use solution must hold. Example: Find x. So x = 2.' WHEN doc_id % 3 = 0 THEN ' Then y = 4. It is SI unit free.' ELSE '' END)"
_FORMAT = "CASE doc_id % 5 WHEN 0 THEN 'conceptual' WHEN 1 THEN 'principle' WHEN 2 THEN 'formula' WHEN 3 THEN 'calculation' ELSE 'classification' END"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("I41", "documents", sql=f"""
    WITH t0 AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'essential' WHEN 1 THEN 'foundation' ELSE 'extension' END AS level, {_STRIP.format(_TEXT)} AS text, CASE doc_id % 5 WHEN 0 THEN 'concept' WHEN 1 THEN 'law' WHEN 2 THEN 'formula' WHEN 3 THEN 'numerical' ELSE 'classification' END AS form FROM documents),
    t1 AS (SELECT *, regexp_matches(text, {_Q(L.WORKS)}) AND regexp_matches(text, {_Q(L.HAS)}) AS works FROM t0 WHERE text <> ''), t2 AS (SELECT *, form = 'formula' OR form = 'numerical' AND works AS whole FROM t1),
    t AS (SELECT *, CASE WHEN whole AND regexp_matches(text, {_Q(L.BEGINS)}) AND NOT regexp_matches(text, {_Q('^' + L.BEGINS)}) THEN 'spans' WHEN whole THEN CASE WHEN works THEN 'worked' ELSE 'formula' END WHEN form = 'numerical' AND regexp_matches(text, {_Q(L.CALCULATES)}) THEN 'calculations' WHEN form = 'classification' THEN 'classification' ELSE 'prose' END AS mode FROM t2),
    p0 AS (SELECT *, string_split(CASE WHEN mode = 'spans' THEN regexp_replace(text, {_Q(L.BEGINS)}, chr(1) || '\\1', 'g') ELSE text END, chr(1)) AS ps FROM t),
    p1 AS (SELECT doc_id, level, form, mode, UNNEST(ps) AS text, generate_subscripts(ps, 1) - 1 AS part FROM p0),
    p AS (SELECT doc_id, level, form, part, text, CASE WHEN mode <> 'spans' THEN mode WHEN part = 0 THEN 'prose' ELSE 'span' END AS mode FROM p1),
    a0 AS (SELECT *, list_filter(CASE WHEN mode IN ('prose', 'classification') THEN string_split_regex(text, '\\n\\s*\\n') ELSE [text] END, lambda x: TRIM(x) <> '') AS ps FROM p WHERE mode NOT IN ('worked', 'formula')),
    a AS (SELECT doc_id, level, form, mode, part, UNNEST(ps) AS text, generate_subscripts(ps, 1) - 1 AS para FROM a0),
    s0 AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, {_Q(r'([.!?])\s+(' + L.NEXT + ')')}, '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ss FROM a),
    s AS (SELECT doc_id, level, form, mode, part, para, UNNEST(ss) AS x, generate_subscripts(ss, 1) - 1 AS no FROM s0),
    r AS (SELECT doc_id, level, part, para, no, x, CASE WHEN mode = 'span' THEN CASE WHEN regexp_matches(x, {_Q(L.GENERAL)}) THEN 'conditions' END WHEN mode = 'classification' THEN 'classification' WHEN mode = 'calculations' AND regexp_matches(x, {_Q(L.CALCULATES)}) THEN 'worked_example'
          ELSE {_ROLE} WHEN mode = 'calculations' OR para = 0 AND no = 0 THEN CASE WHEN form = 'law' THEN 'law' ELSE 'definition' END ELSE 'explanation' END END AS kind FROM s
          UNION ALL SELECT doc_id, level, part, 0, -1, {_STRIP.format('text')}, CASE WHEN mode = 'formula' THEN 'formula' ELSE 'worked_example' END FROM p WHERE mode IN ('worked', 'formula', 'span')),
    g AS (SELECT *, COALESCE(kind = 'explanation' AND LAG(kind) OVER w = 'explanation' AND LAG(part) OVER w = part AND LAG(para) OVER w = para, FALSE) AS goes_on FROM r WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY part, para, no)),
    h AS (SELECT *, SUM(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY part, para, no) - 1 AS block FROM g),
    b AS (SELECT doc_id, level, block, MAX(kind) AS kind, STRING_AGG(x, ' ' ORDER BY part, para, no) AS text FROM h GROUP BY 1, 2, 3),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, regexp_replace(text, '\\s+', ' ', 'g') ORDER BY block) AS rn FROM b),
    k AS (SELECT * FROM o WHERE rn = 1 AND (kind IN ({', '.join(_Q(x) for x in L.PROTECTED)}) OR level = 'essential' OR level = 'foundation' AND kind NOT IN ('example', 'connection')))
    SELECT doc_id, COUNT(*) AS shown, COUNT(*) FILTER (kind = 'worked_example') AS worked, COUNT(*) FILTER (kind = 'conditions') AS conditions, COUNT(*) FILTER (kind = 'law') AS laws, sha256(STRING_AGG(kind || ':' || text, '|' ORDER BY block)) AS blocks_sha256 FROM k GROUP BY doc_id""")
def _(documents):
    """The blocks that a learner new to it sees in a concise style."""
    level = F.when(F.col("doc_id") % 3 == 0, "essential").when(F.col("doc_id") % 3 == 1, "foundation").otherwise("extension")
    rows = L.teaching_blocks(documents.select("doc_id", F.expr(_TEXT).alias("text"), level.alias("level"), F.expr(_FORMAT).alias("format")), "doc_id", "new_to_it", "concise")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    ordered = F.array_sort(F.collect_list(F.struct("no", "kind", "text")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("shown"), n("worked_example").alias("worked"), n("conditions").alias("conditions"), n("law").alias("laws"), F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "|"), 256).alias("blocks_sha256"))


_LEAD = "CASE turn % 5 WHEN 0 THEN 'What is it: ' WHEN 1 THEN 'Compare these: ' WHEN 2 THEN 'Predict it: ' ELSE '' END || text"


@query("I42", "conversations", sql=f"""
    WITH q AS (SELECT conv_id AS lesson, turn AS seq, role AS subtopic, LOWER({_LEAD}) AS low, CASE turn % 7 WHEN 0 THEN '3' WHEN 1 THEN 'Exam' WHEN 2 THEN 'unknown' END AS declared FROM conversations),
    d AS (SELECT *, CASE WHEN declared = '3' THEN 3 WHEN declared = 'Exam' THEN 4 WHEN regexp_matches(low, {_Q(L.HARD)}) THEN 4 WHEN regexp_matches(low, {_Q(L.APPLIED)}) THEN 3 WHEN regexp_matches(low, {_Q(L.PLAIN)}) THEN 1 ELSE 2 END AS difficulty FROM q),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lesson, subtopic, difficulty ORDER BY seq) AS rn FROM d WHERE difficulty >= 2)
    SELECT lesson, seq, subtopic, difficulty, ROW_NUMBER() OVER (PARTITION BY lesson ORDER BY ABS(difficulty - 3), seq) AS place FROM o WHERE rn = 1""")
def _(conversations):
    """Practice of each conversation for who knows the basics."""
    declared = F.when(F.col("turn") % 7 == 0, "3").when(F.col("turn") % 7 == 1, "Exam").when(F.col("turn") % 7 == 2, "unknown")
    return L.practice(conversations.select(F.col("conv_id").alias("lesson"), F.col("turn").alias("seq"), F.col("role").alias("subtopic"), F.expr(_LEAD).alias("question"), declared.alias("declared")), 3)


@query("I43", "concept_rows", sql="""
    WITH c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chapter ORDER BY p_partkey) - 1 AS k FROM concept_rows), l AS (SELECT *, chapter || '/' || (k // 10) AS lesson, k % 10 + 1 AS page FROM c),
    p AS (SELECT lesson, page, difficulty AS subtopic, CASE WHEN definition <> '' THEN 2 ELSE 1 END + CASE WHEN explanation <> '' THEN 1 ELSE 0 END AS essential FROM l),
    w AS (SELECT DISTINCT lesson, difficulty AS subtopic FROM l WHERE p_partkey % 7 <> 0), q AS (SELECT lesson, SUM(p_partkey) % 12 AS questions FROM l GROUP BY 1),
    a AS (SELECT p.lesson, COUNT(*) AS n, MIN(essential) AS least, COUNT(*) FILTER (w.lesson IS NULL) AS astray, COUNT(DISTINCT w.subtopic) AS covered FROM p LEFT JOIN w ON w.lesson = p.lesson AND w.subtopic = p.subtopic GROUP BY 1), t AS (SELECT lesson, COUNT(*) AS wanted FROM w GROUP BY 1)
    SELECT t.lesson, array_to_string(list_filter([CASE WHEN n <> 10 THEN 'pages_out_of_order' END, CASE WHEN least < 2 THEN 'thin_page' END, CASE WHEN astray > 0 THEN 'page_off_topic' END, CASE WHEN covered <> wanted THEN 'missing_subtopic' END, CASE WHEN questions NOT BETWEEN 5 AND 10 THEN 'question_count' END], lambda x: x IS NOT NULL), ',') AS issues
    FROM t JOIN a ON a.lesson = t.lesson JOIN q ON q.lesson = t.lesson""")
def _(concept_rows):
    """What lessons of ten concepts each, of all chapters, break of the rules."""
    k = F.row_number().over(Window.partitionBy("chapter").orderBy("p_partkey")) - 1
    c = concept_rows.withColumn("k", k).withColumns({"lesson": F.concat_ws("/", "chapter", F.floor(F.col("k") / 10).cast("string")), "page": F.col("k") % 10 + 1})
    essential = F.when(F.col("definition") != "", 2).otherwise(1) + F.when(F.col("explanation") != "", 1).otherwise(0)
    pages = c.select("lesson", F.col("page"), F.col("difficulty").alias("subtopic"), essential.alias("essential"))
    wanted = c.where("p_partkey % 7 <> 0").select("lesson", F.col("difficulty").alias("subtopic"))
    asked = c.groupBy("lesson").agg((F.sum("p_partkey") % 12).alias("questions"))
    return L.lesson_issues(pages, wanted, asked, 10)


@query("I44", "concept_rows", sql="""
    WITH w AS (SELECT DISTINCT chapter AS lesson, page AS subtopic FROM concept_rows), s AS (SELECT chapter AS lesson, page AS subtopic, MIN(title) FILTER (p_partkey % 7 = 0) AS a, MIN(explanation) FILTER (p_partkey % 3 = 1) AS b, MIN(definition) FILTER (p_partkey % 2 = 0) AS c FROM concept_rows GROUP BY 1, 2)
    SELECT lesson, subtopic, CASE WHEN a IS NOT NULL THEN 'source_1' WHEN b IS NOT NULL THEN 'source_2' WHEN c IS NOT NULL THEN 'source_3' ELSE 'missing' END AS source, COALESCE(a, b, c) AS text FROM w JOIN s USING (lesson, subtopic)""")
def _(concept_rows):
    """Material of every chapter and page: reviewed, else of the section, else of the concept, else missing."""
    rows = concept_rows.withColumnsRenamed({"chapter": "lesson", "page": "subtopic"})
    of = lambda on, c: rows.where(on).select("lesson", "subtopic", F.col(c).alias("text"))
    return L.filled(rows, of("p_partkey % 7 = 0", "title"), of("p_partkey % 3 = 1", "explanation"), of("p_partkey % 2 = 0", "definition"))
