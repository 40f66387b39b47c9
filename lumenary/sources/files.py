"""Sources: typed tables, folders of text files, JSON arrays, and which stored chapter a file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.functions import text as X


def typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table's columns of that schema, which it must have; the scan reads no others."""
    want = T._parse_datatype_string(schema)
    have = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in want if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise TypeError(f"{path} lacks {', '.join(wrong)}")
    return spark.read.parquet(path).select(*want.names)


def path_fields(path: Column) -> list[Column]:
    """class, subject, book, chapter number and name, and slug of a path like class_9/science/chapter_03_atoms.pdf.

    The class is the first part that names one; the parts before the file are subject and book
    unless they name a class.
    """
    parts = F.split(path, "/")
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    named = lambda c: F.when(X.normal_key(c).startswith("class"), "").otherwise(X.titled(X.normal_key(c)))
    grade = F.regexp_extract(F.array_join(F.transform(parts, X.normal_key), "/"), r"class_?(\d{1,2})", 1)
    stem = F.regexp_replace(at(-1), r"\.[A-Za-z0-9]+$", "")
    number = F.coalesce(F.nullif(F.regexp_extract(stem, r"(?i)(?:chapter|chap|ch)[_\-\s]*(\d{1,3})", 1), F.lit("")), F.nullif(F.regexp_extract(stem, r"\b(\d{1,3})\b", 1), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(stem, r"(?i)(?:chapter|chap|ch)[_\-\s]*\d{1,3}", ""), r"^\d{1,3}[_\-\s]*", "")
    bare = F.regexp_replace(bare, r"^[ _\-]+|[ _\-]+$", "")
    plain = number.cast("int").cast("string")
    name = X.titled(F.when(bare == "", F.concat_ws(" ", F.lit("Chapter"), plain)).otherwise(bare))
    slug = X.normal_key(F.concat_ws("_", F.lit("NCERT"), F.when(grade != "", F.concat(F.lit("class_"), grade)), F.nullif(named(at(-2)), F.lit("")), F.concat(F.lit("chapter_"), F.coalesce(plain, F.lit(""))), name))
    return [grade.alias("class_level"), named(at(-2)).alias("subject"), named(at(-3)).alias("book"), number.cast("int").alias("chapter_number"), name.alias("chapter_name"), slug.alias("slug")]


def folder(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, content) of every file below root with such a name; path is that below root, without key= in folders' names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.element_at(F.split(F.col("path"), f"/{root.rstrip('/').rsplit('/', 1)[-1]}/"), -1)
    return files.select(F.regexp_replace(below, r"(^|/)[^/=]+=", "$1").alias("path"), "content")


def ingested(files: DataFrame, page_mark: str = "\f") -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of (path, content): each file's pages with their numbers, and files without readable text.

    An error of one file stops no other.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = files.select("path", F.sha2("content", 256).alias("source_hash"), text.alias("text"))
    bad = F.when(F.col("text").isNull(), "not_utf8").when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty")
    pages = read.where(bad.isNull()).select("path", "source_hash", F.posexplode(F.split("text", page_mark)).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return pages, read.where(bad.isNotNull()).select("path", bad.alias("error"))


def concept_arrays(rows: DataFrame, schema: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(items, errors) of rows (name, seq, payload): each payload a JSON array of objects of that schema.

    Of items with one key in a name the last counts, by seq and place. Items without a key, and
    payloads that are no array, are errors.
    """
    parsed = rows.withColumn("xs", F.from_json("payload", f"array<struct<{schema}>>"))
    each = parsed.where("xs is not null").select("name", "seq", F.posexplode("xs").alias("place", "x"))
    blank = F.coalesce(F.col(f"x.{key}"), F.lit("")) == ""
    last = each.where(~blank).groupBy("name", F.col(f"x.{key}").alias("_key")).agg(F.max_by("x", F.struct("seq", "place")).alias("x"))
    broken = parsed.where("xs is null").select("name", "seq", F.lit(None).cast("int").alias("place"), F.lit("not_an_array").alias("error"))
    return last.select("name", "x.*"), each.where(blank).select("name", "seq", "place", F.lit("missing_id").alias("error")).unionByName(broken)


def identified(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """files (file_id, slug, board, class_level, subject, chapter_number, source_hash) with the stored chapter that each is.

    By slug; else, among chapters (chapter_id and the same columns) of the same board, class,
    subject and number, the one of the same hash; else the only one. Several are ambiguous, none is new.
    """
    same = ["board", "class_level", "subject", "chapter_number"]
    by_slug = chapters.groupBy("slug").agg(F.min("chapter_id").alias("_slug_id"))
    alike = chapters.groupBy(*same).agg(F.count("*").alias("_n"), F.min("chapter_id").alias("_only"))
    exact = chapters.groupBy(*same, "source_hash").agg(F.count("*").alias("_m"), F.min("chapter_id").alias("_hash_id"))
    rows = files.join(by_slug, "slug", "left").join(alike, same, "left").join(exact, [*same, "source_hash"], "left")
    way = F.when(F.col("_slug_id").isNotNull(), "slug").when(F.col("_m") == 1, "hash").when(F.col("_n") == 1, "identity").when(F.col("_n") > 1, "ambiguous").otherwise("new")
    found = F.when(way == "slug", F.col("_slug_id")).when(way == "hash", F.col("_hash_id")).when(way == "identity", F.col("_only"))
    return rows.select("file_id", way.alias("way"), found.alias("chapter_id"))
