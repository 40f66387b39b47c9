"""Content releases: digest trees over a chapter's rows, what keeps a chapter from release, what a restore changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.runtime import checkpointed, scratch

#: Rows of a leaf on average, at most, and children of an inner node.
FAN = 16
#: Levels that a tree can have: enough for 16 ** 13 rows.
LEVELS = 12
#: Layers that a chapter must have.
LAYERS = ("chunk", "concept", "page", "vector")


def depth_of(n: Column) -> Column:
    """Levels of a tree of n rows below its root, so that a leaf has FAN rows on average."""
    return sum(((n > FAN ** (k + 1)).cast("int") for k in range(LEVELS)), F.lit(0))


def items(rows: DataFrame) -> DataFrame:
    """(chapter, layer, key, item, n): the digest of each distinct row (chapter, layer, key, payload) and how often it is there."""
    item = F.sha2(F.concat_ws("\x1f", "layer", F.col("key").cast("string"), "payload"), 256)
    return rows.groupBy("chapter", "layer", "key", item.alias("item")).agg(F.count("*").alias("n"))


def depths(*sides: DataFrame) -> DataFrame:
    """(chapter, depth) for trees over the items of all sides that can be compared."""
    each = [s.groupBy("chapter").agg(F.count("*").alias("m")) for s in sides]
    both = each[0]
    for e in each[1:]:
        both = both.unionByName(e)
    return both.groupBy("chapter").agg(depth_of(F.max("m")).alias("depth"))


def digest_tree(found: DataFrame, depth: DataFrame) -> DataFrame:
    """(chapter, level, prefix, n, digest): every node of each chapter's tree; the root has level 0 and prefix ''.

    A row's place is its digest's first hex digits, so leaves fill evenly whatever the keys; an inner
    node has up to 16 children, and the height grows with the rows. The tree is the same for
    any order of rows. Each level is written before the next one above it is built from it.
    """
    folder = scratch(found.sparkSession, "tree")
    line = F.concat_ws(":", "item", F.col("n").cast("string"))
    joined = lambda c: F.sha2(F.array_join(c, ""), 256)
    leaf = found.join(depth, "chapter").groupBy("chapter", "depth", F.substring("item", F.lit(1), F.col("depth")).alias("prefix"))
    now = leaf.agg(F.sum("n").alias("n"), joined(F.array_sort(F.collect_list(line))).alias("digest"))
    top = depth.agg(F.max("depth")).head()[0] or 0
    for level in range(top, -1, -1):
        if level < top:
            by = below.groupBy("chapter", "depth", F.substring("prefix", 1, level).alias("prefix"))
            children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
            # a chapter of fewer levels has its leaves further up
            now = by.agg(F.sum("n").alias("n"), F.when(F.first("depth") > level, joined(F.transform(children, lambda c: c["digest"]))).otherwise(F.max("digest")).alias("digest"))
        now.write.parquet(f"{folder}/level={level}")
        below = found.sparkSession.read.parquet(f"{folder}/level={level}")
    nodes = found.sparkSession.read.option("basePath", folder).parquet(folder)
    return nodes.where("level <= depth").select("chapter", "depth", "level", "prefix", "n", "digest")


def root(tree: DataFrame) -> DataFrame:
    """(chapter, items, digest) of each chapter."""
    return tree.where("level = 0").select("chapter", F.col("n").alias("items"), "digest")


def manifest(rows: DataFrame) -> DataFrame:
    """(chapter, items, digest) of rows (chapter, layer, key, payload)."""
    found = checkpointed(items(rows))
    return root(digest_tree(found, depths(found)))


def refusals(rows: DataFrame, declared: DataFrame | None = None, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(chapter, reason, n): what keeps a chapter from being released; nothing for one that may be.

    A missing layer, a chunk without a vector or without text, a key twice in a layer, and, with
    declared (chapter, items, digest), a digest or number of items that isn't what the rows have.
    """
    keys = rows.groupBy("chapter", "layer", "key").agg(F.count("*").alias("m"), F.count_if(F.trim(F.coalesce("payload", F.lit(""))) == "").alias("blank"))
    chunk, vector = keys.where("layer = 'chunk'"), keys.where("layer = 'vector'")
    bare = chunk.join(vector.select("chapter", "key"), ["chapter", "key"], "left_anti").groupBy("chapter").agg(F.lit("no_vector").alias("reason"), F.count("*").alias("n"))
    have = keys.groupBy("chapter").agg(F.collect_set("layer").alias("have"), F.count_if(F.col("m") > 1).alias("twice"), F.sum(F.when(F.col("layer") == "chunk", F.col("blank"))).alias("blank"))
    lacks = F.array_except(F.array(*map(F.lit, layers)), "have")
    told = F.concat(F.transform(lacks, lambda x: F.struct(F.concat(F.lit("missing_"), x).alias("reason"), F.lit(1).cast("long").alias("n"))), F.array(F.struct(F.lit("duplicate_key").alias("reason"), F.col("twice").alias("n")), F.struct(F.lit("empty_chunk").alias("reason"), F.coalesce("blank", F.lit(0)).cast("long").alias("n"))))
    out = have.select("chapter", F.explode(told).alias("x")).select("chapter", "x.*").where("n > 0").unionByName(bare)
    if declared is None:
        return out
    own, said = manifest(rows), declared.select("chapter", F.col("items").alias("s"), F.col("digest").alias("d"))
    wrong = own.join(said, "chapter", "full_outer").where(~F.col("digest").eqNullSafe(F.col("d")) | ~F.col("items").eqNullSafe(F.col("s")))
    return out.unionByName(wrong.select("chapter", F.lit("digest_mismatch").alias("reason"), F.lit(1).cast("long").alias("n")))


def export(rows: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(chapter, items, digest, refusals): each chapter's manifest, without a digest where it is refused."""
    why = refusals(rows, declared).groupBy("chapter").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))), ",").alias("refusals"))
    both = manifest(rows).join(why, "chapter", "left")
    return both.select("chapter", "items", F.when(F.col("refusals").isNull(), F.col("digest")).alias("digest"), F.coalesce("refusals", F.lit("")).alias("refusals"))


def changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(chapter, layer, key, change): rows (chapter, layer, key, payload) that a restore of new over old adds, removes or changes.

    The two trees are compared from the root down, and only below nodes that differ: the work after the
    trees are there grows with the differences and not with the rows.
    """
    a, b = checkpointed(items(new)), checkpointed(items(old))
    depth = checkpointed(depths(a, b))
    one, two = digest_tree(a, depth), digest_tree(b, depth)
    top = depth.agg(F.max("depth")).head()[0] or 0
    leaves, open_ = None, depth.select("chapter", F.lit("").alias("prefix"))
    for level in range(top + 1):
        at = lambda t, d: t.where(F.col("level") == level).join(open_.withColumnRenamed("prefix", "up"), F.expr(f"up = substring(prefix, 1, {max(0, level - 1)})") & (t["chapter"] == open_["chapter"]), "left_semi").select("chapter", "depth", "prefix", F.col("digest").alias(d))  # noqa: B023, E731
        differ = checkpointed(at(one, "x").join(at(two, "y"), ["chapter", "depth", "prefix"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("chapter", "depth", "prefix"))
        done = differ.where(F.col("depth") == level).select("chapter", "prefix")
        leaves = done if leaves is None else leaves.unionByName(done)
        open_ = differ.where(F.col("depth") > level).select("chapter", "prefix")
    leaves = checkpointed(leaves)
    pick = lambda s, c: s.join(depth, "chapter").withColumn("prefix", F.substring("item", F.lit(1), F.col("depth"))).join(leaves, ["chapter", "prefix"], "left_semi").select("chapter", "layer", "key", "item", F.col("n").alias(c))
    met = pick(a, "now").join(pick(b, "was"), ["chapter", "layer", "key", "item"], "full_outer").where(~F.col("now").eqNullSafe(F.col("was")))
    by = met.groupBy("chapter", "layer", "key").agg(F.count("now").alias("now"), F.count("was").alias("was"))
    return by.select("chapter", "layer", "key", F.when(F.col("was") == 0, "added").when(F.col("now") == 0, "removed").otherwise("changed").alias("change"))


def clashes(incoming: DataFrame, live: DataFrame) -> DataFrame:
    """(slug, reason): chapters (slug, identity) that can't be restored over live ones.

    A live slug with another identity belongs to a different chapter; several live rows of a slug or identity are ambiguous.
    """
    own = incoming.select("slug", "identity").distinct()
    theirs = live.select(F.col("slug").alias("s"), F.col("identity").alias("i"))
    met = own.join(theirs, F.col("slug") == F.col("s")).unionByName(own.join(theirs, (F.col("identity") == F.col("i")) & ~F.col("slug").eqNullSafe(F.col("s"))))
    by = met.groupBy("slug").agg(F.count_if((F.col("slug") == F.col("s")) & ~F.col("identity").eqNullSafe(F.col("i"))).alias("other"), F.count("*").alias("m"))
    return by.where("other > 0 or m > 1").select("slug", F.when(F.col("other") > 0, "slug_of_other_chapter").otherwise("ambiguous_identity").alias("reason"))


def restore(new: DataFrame, live: DataFrame, clash: DataFrame) -> DataFrame:
    """(chapter, items, action, version, reason): manifests new (chapter, items, digest, version) over live ones.

    A chapter whose digest and count are live is skipped, one with a clash refused, any other
    restored under the next version after both; one that isn't live keeps its own.
    """
    number = lambda c: F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("long"), F.lit(0))
    was = live.select("chapter", F.col("items").alias("i"), F.col("digest").alias("d"), F.col("version").alias("v"))
    rows = new.join(was, "chapter", "left").join(clash.withColumnRenamed("slug", "chapter"), "chapter", "left")
    same = F.coalesce((F.col("digest") == F.col("d")) & (F.col("items") == F.col("i")), F.lit(False))
    action = F.when(F.col("reason").isNotNull(), "refused").when(same, "skipped").otherwise("restored")
    version = F.when(F.col("v").isNull(), F.col("version")).otherwise(F.concat(F.lit("v"), F.greatest(number(F.col("v")), number(F.col("version"))) + 1))
    return rows.select("chapter", "items", action.alias("action"), F.when(action == "restored", version).when(action == "skipped", F.col("v")).alias("version"), F.coalesce("reason", F.lit("")).alias("reason"))
