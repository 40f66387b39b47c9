"""Queries of grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import grounding as G
from lumenary.plans.registry import query

# In place of the formulas' table: each digit, n and sign of the ones that the texts and samples hold; letters first
_PRETTY = "text || ' ' || f"
for _a, _b in (("CnH2n+2", "CₙH₂ₙ₊₂"), ("CnH2n-2", "CₙH₂ₙ₋₂"), ("SO4^2-", "SO₄²⁻"), ("H2SO4", "H₂SO₄"), ("C4H10", "C₄H₁₀"), ("C2H6", "C₂H₆"), ("NH4+", "NH₄⁺"), ("H2O", "H₂O"), ("CO2", "CO₂"), ("OH-", "OH⁻"), ("H2", "H₂"), ("O2", "O₂"), ("N2", "N₂")):
    _PRETTY = f"REPLACE({_PRETTY}, '{_a}', '{_b}')"
_MORE = "CASE doc_id % 4 WHEN 0 THEN 'H2SO4 and C2H6O' WHEN 1 THEN 'CnH2n+2, CnH2n-2' WHEN 2 THEN 'NH4+ with SO4^2- in H2O' ELSE 'CO2 + OH- of C4H10' END"


@query("H14", "documents", sql=f"SELECT doc_id, sha256(regexp_replace(regexp_replace({_PRETTY}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_sha256, RIGHT({_PRETTY}, 12) AS tail FROM (SELECT doc_id, text, {_MORE} AS f FROM documents) x")
def _(documents):
    """Texts with readable formulas."""
    t = G.readable_formulas(F.concat("text", F.lit(" "), F.expr(_MORE)))
    return documents.select("doc_id", F.sha2(t, 256).alias("text_sha256"), F.right(t, F.lit(12)).alias("tail"))


_TURN = """
    g0 AS (SELECT *, CASE (conv_id + turn) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'optional' WHEN 2 THEN 'required' ELSE 'other' END AS policy, turn % 3 = 0 AS strict, LENGTH(COALESCE(context, '')) > 60 AS supported, CAST(turn % 2 AS INT) AS documents, CAST(conv_id % 2 AS INT) AS images, turn % 5 = 0 AS uploaded FROM answers),
    g1 AS (SELECT *, TRIM(COALESCE(context, '')) <> '' AS has, CASE WHEN policy IN ('none', 'optional', 'required') THEN policy ELSE 'none' END AS p FROM g0), g2 AS (SELECT *, has AND (supported OR uploaded) AS held FROM g1),
    g3 AS (SELECT *, CASE WHEN p = 'none' AND NOT strict THEN 'not_required' WHEN strict AND NOT held THEN 'missing_required_source' WHEN held THEN 'grounded' ELSE 'optional_no_source' END AS status,
           list_filter([CASE WHEN has THEN 'platform_notes' END, CASE WHEN documents > 0 THEN 'uploaded_document' END, CASE WHEN images > 0 THEN 'uploaded_image' END, CASE WHEN uploaded AND documents + images = 0 THEN 'student_upload' END], lambda x: x IS NOT NULL) AS parts FROM g2)"""


def _turns(answers):
    k = (F.col("conv_id") + F.col("turn")) % 4
    policy = F.when(k == 0, "none").when(k == 1, "optional").when(k == 2, "required").otherwise("other")
    return answers.withColumns({"policy": policy, "strict": F.col("turn") % 3 == 0, "supported": F.length(F.coalesce("context", F.lit(""))) > 60, "documents": (F.col("turn") % 2).cast("int"), "images": (F.col("conv_id") % 2).cast("int"), "uploaded": F.col("turn") % 5 == 0})


@query("I27", "answers", sql=f"WITH {_TURN} SELECT conv_id, turn, status, status <> 'missing_required_source' AS can_answer, array_to_string(CASE WHEN LEN(parts) > 1 THEN list_append(parts, 'hybrid') ELSE parts END, '+') AS source_mix FROM g3")
def _(answers):
    """Whether each turn may be answered, and from what."""
    return G.gated(_turns(answers)).select("conv_id", "turn", "status", "can_answer", "source_mix")


@query("I27_repair", "answers", sql=f"""
    WITH {_TURN}, r AS (SELECT *, LENGTH(COALESCE(answer, '')) % 10 / 10.0 AS risk, LENGTH(COALESCE(answer, '')) % 7 <> 0 AS passed, CASE WHEN turn % 4 = 0 THEN conv_id % 3 <> 0 END AS verified FROM g3)
    SELECT conv_id, turn, CASE WHEN status = 'missing_required_source' OR strict AND risk >= 0.65 THEN 'replace_with_material_not_found' WHEN NOT passed OR NOT COALESCE(verified, TRUE) THEN 'needs_review' ELSE 'deliver' END AS action FROM r""")
def _(answers):
    """What becomes of each answer."""
    n = F.length(F.coalesce("answer", F.lit("")))
    rows = G.gated(_turns(answers)).withColumns({"risk": n % 10 / 10.0, "passed": n % 7 != 0, "verified": F.when(F.col("turn") % 4 == 0, F.col("conv_id") % 3 != 0)})
    return G.repairs(rows).select("conv_id", "turn", "action")


_FEEL = "CASE turn % 5 WHEN 0 THEN 'Confused ' WHEN 1 THEN '' WHEN 2 THEN 'happy' WHEN 3 THEN 'stuck' END"


@query("I46", "answers", sql=f"""
    WITH s AS (SELECT conv_id, turn, CASE WHEN format = 'stuck' THEN 'clarification' ELSE format END AS intent, LOWER(TRIM(COALESCE({_FEEL}, ''))) AS feeling, CASE WHEN contains(LOWER(answer), 'not') THEN 'Mistake in steps' ELSE '' END AS weak, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.62 WHEN 2 THEN 140.0 ELSE 55.5 END AS c, CASE WHEN turn % 2 = 0 THEN ' ' ELSE mode END AS topic, CASE WHEN turn % 6 = 0 THEN '' ELSE format END AS anchor FROM answers)
    SELECT conv_id, turn, COALESCE(NULLIF(TRIM(topic), ''), NULLIF(TRIM(anchor), ''), 'open_concept') AS topic, ROUND(GREATEST(0.0, LEAST(100.0, CASE WHEN COALESCE(c, 66.0) <= 1 THEN COALESCE(c, 66.0) * 100 ELSE COALESCE(c, 66.0) END)), 1) AS confidence,
           intent = 'clarification' OR feeling IN ('confused', 'frustrated', 'anxious', 'stuck') OR weak <> '' AS needs_support, CASE WHEN feeling = '' THEN 'steady' ELSE feeling END AS feeling FROM s WHERE intent <> 'conversation'""")
def _(answers):
    """What each turn says of a learner's mastery."""
    k = F.col("turn") % 4
    rows = answers.select("conv_id", "turn", F.when(F.col("format") == "stuck", "clarification").otherwise(F.col("format")).alias("intent"), F.expr(_FEEL).alias("emotion"), F.when(F.contains(F.lower("answer"), F.lit("not")), "Mistake in steps").otherwise("").alias("weak_signals"),
                          F.when(k == 1, 0.62).when(k == 2, 140.0).when(k == 3, 55.5).alias("confidence"), F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("mode")).alias("topic"), F.when(F.col("turn") % 6 == 0, "").otherwise(F.col("format")).alias("anchor"))
    return G.mastery_signals(rows).select("conv_id", "turn", F.col("signal_topic").alias("topic"), F.col("signal_confidence").alias("confidence"), "needs_support", "feeling")


_PAGE = "CASE WHEN doc_id % 12 < 4 THEN CASE doc_id % 4 WHEN 0 THEN 'Logarithms' || chr(10) || n_chars WHEN 1 THEN 'TABLE II' || chr(10) || n_chars || n_chars || n_chars WHEN 2 THEN ' Notes' || chr(10) || SUBSTR(text, 1, 400) ELSE 'Anti logarithms x' END WHEN doc_id % 12 = 4 THEN 'Antilogarithms' WHEN doc_id % 12 IN (8, 9) THEN '  ' ELSE text END"


@query("I22", "documents", sql=f"""
    WITH p AS (SELECT CAST(FLOOR(doc_id / 4) AS BIGINT) AS batch, regexp_replace(COALESCE({_PAGE}, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents), h AS (SELECT *, LOWER(TRIM(string_split(t, chr(10))[1])) AS head FROM p),
    f AS (SELECT *, regexp_matches(head, '^(?:anti\\s*)?logarithms\\b') AS log, regexp_matches(head, '^table\\s+(?:i|ii|1|2)\\b') AND LENGTH(regexp_replace(t, '[^0-9]', '', 'g')) / GREATEST(1, LENGTH(regexp_replace(t, '\\s', '', 'g'))) >= 0.45 AS tab FROM h)
    SELECT batch, COALESCE(BOOL_OR(log) FILTER (t <> '') AND BOOL_AND(log OR tab OR head = 'notes' AND LENGTH(t) < 500) FILTER (t <> ''), FALSE) AS reference_only FROM f GROUP BY batch""")
def _(documents):
    """Batches of four pages that are tables and notes alone."""
    return G.reference_only(documents.select(F.floor(F.col("doc_id") / 4).alias("batch"), F.expr(_PAGE.replace("chr(10)", "'\\n'").replace("|| n_chars", "|| CAST(n_chars AS STRING)")).alias("text")), "batch")


@query("I11", "documents", sql="""
    WITH m AS (SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS query_id, CAST(doc_id AS STRING) AS section, n_chars, text, ROW_NUMBER() OVER (PARTITION BY FLOOR(doc_id / 10) ORDER BY doc_id % 7, CAST(doc_id AS STRING)) AS rn FROM documents WHERE n_chars > 400),
    t AS (SELECT * FROM m WHERE rn <= 3)
    SELECT query_id, STRING_AGG(section, ' + ' ORDER BY rn) AS sections, CAST(SUM(LEN(string_split(text, chr(10)))) AS BIGINT) AS paragraphs, sha256(CASE WHEN COUNT(*) > 1 THEN SUBSTR(STRING_AGG('## Source: ' || section || chr(10) || text, chr(10) || chr(10) ORDER BY rn), 1, 5000) ELSE MAX(text) END) AS context_sha256 FROM t GROUP BY 1""")
def _(documents):
    """The first three supported sources of ten neighbouring documents, merged."""
    rows = documents.select(F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("doc_id").cast("string").alias("section"), (F.col("doc_id") % 7).alias("rank"), (F.col("n_chars") > 400).alias("supported"), F.col("text").alias("context"), F.size(F.split("text", "\n")).cast("long").alias("paragraphs"))
    return G.merged_sources(rows).select("query_id", "sections", "paragraphs", F.sha2("context", 256).alias("context_sha256"))


@query("I12", "documents")
def _(documents):
    """A slice of each text between two of its own passages; held against a plain version in tests."""
    anchor = lambda at, n: F.upper(F.substring("text", at, n))
    rows = documents.select("doc_id", "text", anchor(20, 24).alias("start_anchor"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, anchor(300, 30)).otherwise(anchor(10, 5)).alias("end_anchor"))
    return G.anchored_slices(rows, "doc_id")


@query("D46", "traces", sql="""
    WITH a AS (SELECT agent, COUNT(*) FILTER (trace_type = 'turn') AS runs, COUNT(*) FILTER (status = 'failed') AS errors, ROUND(AVG(CASE WHEN trace_type = 'turn' THEN CASE WHEN quality >= 0.62 THEN 1 ELSE 0 END END), 6) AS pass_rate, ROUND(AVG(CASE WHEN trace_type = 'turn' THEN grounded END), 6) AS grounded_rate,
               ROUND(AVG(CASE WHEN trace_type = 'tool' THEN CASE WHEN status = 'success' THEN 1 ELSE 0 END END), 6) AS proof_rate, MAX(created_at) AS last_seen FROM traces GROUP BY agent), r AS (SELECT 'agent' || k AS agent FROM (SELECT UNNEST(range(8)) AS k) x)
    SELECT r.agent, COALESCE(runs, 0) AS runs, COALESCE(errors, 0) AS errors, pass_rate, grounded_rate, proof_rate, CASE WHEN COALESCE(runs, 0) = 0 THEN 'no_evidence' WHEN errors * 5 >= runs THEN 'attention' WHEN pass_rate < 0.35 THEN 'watch' ELSE 'healthy' END AS health, CASE WHEN last_seen IS NULL THEN 'silent' WHEN last_seen >= TIMESTAMP '2024-01-30 00:00:00' THEN 'active' ELSE 'idle' END AS state FROM r LEFT JOIN a USING (agent)""")
def _(traces):
    """Evidence of every registered agent: runs, errors, rates, health and state."""
    turn, tool = F.col("trace_type") == "turn", F.col("trace_type") == "tool"
    rate = lambda on, ok: F.round(F.avg(F.when(on, ok.cast("int"))), 6)
    by = traces.groupBy("agent").agg(F.count_if(turn).alias("runs"), F.count_if(F.col("status") == "failed").alias("errors"), rate(turn, F.col("quality") >= 0.62).alias("pass_rate"), rate(turn, F.col("grounded") == 1).alias("grounded_rate"), rate(tool, F.col("status") == "success").alias("proof_rate"), F.max("created_at").alias("last_seen"))
    known = traces.sparkSession.range(8).select(F.concat(F.lit("agent"), "id").alias("agent"))
    health = F.when(F.coalesce("runs", F.lit(0)) == 0, "no_evidence").when(F.col("errors") * 5 >= F.col("runs"), "attention").when(F.col("pass_rate") < 0.35, "watch").otherwise("healthy")
    state = F.when(F.col("last_seen").isNull(), "silent").when(F.col("last_seen") >= F.lit("2024-01-30 00:00:00").cast("timestamp"), "active").otherwise("idle")
    return known.join(by, "agent", "left").select("agent", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("errors", F.lit(0)).alias("errors"), "pass_rate", "grounded_rate", "proof_rate", health.alias("health"), state.alias("state"))


