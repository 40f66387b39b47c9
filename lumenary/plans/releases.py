"""Queries of content releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenary.operators import releases as R
from lumenary.plans.registry import query

_MOST = 6


def _tree(name: str, rows: str, sizes: str | None = None) -> str:
    """CTEs <name>0.. of the digest tree over a relation (chapter, layer, key, payload), and <name>_root."""
    item = "sha256(layer || chr(31) || CAST(key AS STRING) || COALESCE(chr(31) || payload, ''))"
    deep = " + ".join(f"CAST(m > {16 ** (k + 1)} AS INT)" for k in range(_MOST))
    out = [f"{name}_i AS (SELECT chapter, layer, key, {item} AS item, COUNT(*) AS n FROM {rows} GROUP BY ALL)"]
    out.append(f"{name}_d AS (SELECT chapter, {deep} AS depth FROM (SELECT chapter, COUNT(*) AS m FROM {sizes or name + '_i'} GROUP BY chapter) x)")
    out.append(f"{name}{_MOST} AS (SELECT chapter, depth, SUBSTR(item, 1, depth) AS prefix, SUM(n) AS n, sha256(STRING_AGG(item || ':' || n, '' ORDER BY item)) AS digest FROM {name}_i JOIN {name}_d USING (chapter) GROUP BY 1, 2, 3)")
    for k in range(_MOST - 1, -1, -1):
        out.append(f"{name}{k} AS (SELECT chapter, depth, SUBSTR(prefix, 1, {k}) AS prefix, SUM(n) AS n, CASE WHEN depth > {k} THEN sha256(STRING_AGG(digest, '' ORDER BY prefix)) ELSE MAX(digest) END AS digest FROM {name}{k + 1} GROUP BY 1, 2, 3)")
    out.append(f"{name}_root AS (SELECT chapter, CAST(n AS BIGINT) AS items, digest FROM {name}0)")
    return ", ".join(out)


_WHY = """
    keys AS (SELECT chapter, layer, key, COUNT(*) AS m, COUNT(*) FILTER (TRIM(COALESCE(payload, '')) = '') AS blank FROM release_rows GROUP BY 1, 2, 3),
    chapters AS (SELECT DISTINCT chapter FROM release_rows), layers AS (SELECT UNNEST(['chunk', 'concept', 'page', 'vector']) AS layer),
    why AS (SELECT chapter, 'missing_' || layer AS reason, 1 AS n FROM chapters, layers WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.chapter = chapters.chapter AND k.layer = layers.layer)
            UNION ALL SELECT chapter, 'duplicate_key', COUNT(*) FILTER (m > 1) FROM keys GROUP BY chapter UNION ALL SELECT chapter, 'empty_chunk', CAST(COALESCE(SUM(blank) FILTER (layer = 'chunk'), 0) AS BIGINT) FROM keys GROUP BY chapter
            UNION ALL SELECT chapter, 'no_vector', COUNT(*) FROM keys c WHERE layer = 'chunk' AND NOT EXISTS (SELECT 1 FROM keys v WHERE v.layer = 'vector' AND v.chapter = c.chapter AND v.key = c.key) GROUP BY chapter)"""


@query("A8", "release_rows", sql=f"""
    WITH {_tree('t', 'release_rows')}, {_WHY}, w AS (SELECT chapter, STRING_AGG(reason || '=' || n, ',' ORDER BY reason || '=' || n) AS refusals FROM why WHERE n > 0 GROUP BY chapter)
    SELECT chapter, items, CASE WHEN refusals IS NULL THEN digest END AS digest, COALESCE(refusals, '') AS refusals FROM t_root LEFT JOIN w USING (chapter)""")
def _(release_rows):
    """Each chapter's manifest, or why it is refused."""
    return R.export(release_rows)


@query("A8_declared", "release_rows", "live_rows", sql=f"""
    WITH {_tree('t', 'release_rows')}, {_tree('u', 'live_rows')} SELECT COALESCE(t.chapter, u.chapter) AS chapter, 'digest_mismatch' AS reason, CAST(1 AS BIGINT) AS n FROM t_root t FULL JOIN u_root u ON t.chapter = u.chapter WHERE t.digest IS DISTINCT FROM u.digest OR t.items IS DISTINCT FROM u.items""")
def _(release_rows, live_rows):
    """Chapters whose rows aren't what a manifest (here that of the live rows) declares."""
    return R.refusals(release_rows, R.manifest(live_rows)).where("reason = 'digest_mismatch'")


# src8 is live under another number, and number 10 under another slug as well
_LIVE = "SELECT chapter AS slug, CASE WHEN chapter = 'src8' THEN 'n108' ELSE 'n' || SUBSTR(chapter, 4) END AS identity FROM u_root UNION ALL SELECT 'old10', 'n10'"


@query("A9", "release_rows", "live_rows", sql=f"""
    WITH {_tree('t', 'release_rows')}, {_tree('u', 'live_rows')}, own AS (SELECT chapter AS slug, 'n' || SUBSTR(chapter, 4) AS identity FROM t_root), live AS ({_LIVE}),
    met AS (SELECT own.slug, own.slug = live.slug AND own.identity <> live.identity AS other FROM own JOIN live ON own.slug = live.slug OR own.identity = live.identity),
    clash AS (SELECT slug AS chapter, CASE WHEN BOOL_OR(other) THEN 'slug_of_other_chapter' ELSE 'ambiguous_identity' END AS reason FROM met GROUP BY slug HAVING BOOL_OR(other) OR COUNT(*) > 1),
    j AS (SELECT t.chapter, t.items, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN COALESCE(t.digest = u.digest AND t.items = u.items, FALSE) THEN 'skipped' ELSE 'restored' END AS action, u.chapter IS NULL AS fresh, COALESCE(reason, '') AS reason FROM t_root t LEFT JOIN u_root u ON u.chapter = t.chapter LEFT JOIN clash c ON c.chapter = t.chapter)
    SELECT chapter, items, action, CASE action WHEN 'restored' THEN CASE WHEN fresh THEN 'v2' ELSE 'v5' END WHEN 'skipped' THEN 'v4' END AS version, reason FROM j""")
def _(release_rows, live_rows):
    """What a restore does with each chapter: skip, restore under the next version, refuse."""
    new, live = R.manifest(release_rows).withColumn("version", F.lit("v2")), R.manifest(live_rows).withColumn("version", F.lit("v4"))
    number = F.concat(F.lit("n"), F.substring("chapter", 4, 100))
    incoming = new.select(F.col("chapter").alias("slug"), number.alias("identity"))
    there = live.select(F.col("chapter").alias("slug"), F.when(F.col("chapter") == "src8", "n108").otherwise(number).alias("identity"))
    there = there.unionByName(there.sparkSession.createDataFrame([("old10", "n10")], "slug string, identity string"))
    return R.restore(new, live, R.clashes(incoming, there))


@query("A9_changes", "release_rows", "live_rows", sql=f"""
    WITH {_tree('t', 'release_rows')}, {_tree('u', 'live_rows')}, m AS (SELECT COALESCE(t.chapter, u.chapter) AS chapter, COALESCE(t.layer, u.layer) AS layer, COALESCE(t.key, u.key) AS key, t.n AS a, u.n AS b FROM t_i t FULL JOIN u_i u ON t.chapter = u.chapter AND t.layer = u.layer AND t.key = u.key AND t.item = u.item WHERE t.n IS DISTINCT FROM u.n)
    SELECT chapter, layer, key, CASE WHEN COUNT(b) = 0 THEN 'added' WHEN COUNT(a) = 0 THEN 'removed' ELSE 'changed' END AS change FROM m GROUP BY 1, 2, 3""")
def _(release_rows, live_rows):
    """The rows that a restore adds, removes or changes, found by comparing the trees from their roots down."""
    return R.changes(release_rows, live_rows)


@query("D45", "release_rows", sql=f"""
    WITH {_tree('t', 'release_rows')}, {_WHY}, w AS (SELECT chapter, STRING_AGG(reason || '=' || n, ',' ORDER BY reason || '=' || n) AS refusals FROM why WHERE n > 0 GROUP BY chapter),
    e AS (SELECT chapter, CAST(items + CASE WHEN chapter = 'src2' THEN 1 ELSE 0 END AS BIGINT) AS expected, CASE WHEN chapter = 'src6' THEN 'other' ELSE digest END AS source FROM t_root WHERE chapter <> 'src11')
    SELECT chapter, COALESCE(items, 0) AS items, COALESCE(expected, 0) AS expected, CASE WHEN items IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN refusals IS NOT NULL THEN 'refused' WHEN items <> expected THEN 'differs' WHEN digest <> source THEN 'unproven' ELSE 'ready' END AS state FROM t_root FULL JOIN e USING (chapter) LEFT JOIN w USING (chapter)""")
def _(release_rows):
    """Published against expected items of each chapter, with its provenance: the digest that the expectation names."""
    made = R.export(release_rows)
    plain = R.manifest(release_rows)
    expected = plain.where("chapter <> 'src11'").select("chapter", (F.col("items") + F.when(F.col("chapter") == "src2", 1).otherwise(0)).alias("expected"), F.when(F.col("chapter") == "src6", "other").otherwise(F.col("digest")).alias("source"))
    both = expected.join(made, "chapter", "full_outer")
    state = F.when(F.col("items").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("refusals") != "", "refused").when(F.col("items") != F.col("expected"), "differs").when(F.col("digest") != F.col("source"), "unproven").otherwise("ready")
    return both.select("chapter", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("expected", F.lit(0)).alias("expected"), state.alias("state"))


@query("H13", "part", sql=f"""
    WITH b AS (SELECT p_brand AS chapter, 'part' AS layer, p_partkey AS key, p_name AS payload FROM part), {_tree('t', 'b')} SELECT chapter AS p_brand, items, digest AS fingerprint FROM t_root""")
def _(part):
    """Fingerprints of a brand's rows: the roots of their digest trees."""
    rows = part.select(F.col("p_brand").alias("chapter"), F.lit("part").alias("layer"), F.col("p_partkey").alias("key"), F.col("p_name").alias("payload"))
    return R.manifest(rows).select(F.col("chapter").alias("p_brand"), "items", F.col("digest").alias("fingerprint"))
