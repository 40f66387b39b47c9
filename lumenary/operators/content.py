"""Chapters, pages and chunks: coverage, evidence, release manifests, grouping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.operators.sessions import latest
from lumenary.runtime import ship


def scoped(df: DataFrame, **scope: str | None) -> DataFrame:
    """Rows whose columns hold every part that is given, in any case."""
    for column, part in scope.items():
        if part:
            df = df.where(F.lower(column).contains(part.lower()))
    return df


def soft_topic(df: DataFrame, key: str, match: Column) -> DataFrame:
    """Rows of a key that match, or all of its rows if none does."""
    rows = df.withColumn("_match", F.coalesce(match, F.lit(False)))
    some = rows.where("_match").select(F.col(key).alias("_key")).distinct()
    # keys with a match are counted by tasks first, so that a hot key is one row of the other side
    return rows.join(some, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_match") | F.col("_key").isNull()).select(df.columns)


def searched(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows with the term in some column, in any case; % and _ stand for themselves."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(term.lower()))
    return df.where(hit)


def overlapping(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks whose page range (either end may lack, ends may be swapped) holds an allowed page of the chapter.

    A chunk's few pages are spread and joined by equality, so no range join is needed.
    """
    a, b = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
    spread = chunks.where(a > 0).select("chunk_id", "chapter", F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("page"))
    return spread.join(pages, ["chapter", "page"], "left_semi").select("chunk_id").distinct()


def citations(concepts: DataFrame, pages: DataFrame) -> DataFrame:
    """Per concept: cited pages that were ingested, and those that are missing."""
    cited = concepts.select("concept_id", "chapter", F.explode(F.array_distinct("source_pages")).alias("page"))
    have = pages.select("chapter", "page", F.lit(1).alias("there")).distinct()
    return cited.join(have, ["chapter", "page"], "left").groupBy("concept_id").agg(F.count("there").alias("verified"), (F.count("*") - F.count("there")).alias("missing"))


def abnormal_pages(pages: DataFrame, doc: str, length: str) -> DataFrame:
    """Pages of 8,000 characters or more and over four times their document's median; quality 0.15 of itself."""
    median = pages.where(F.col(length) > 0).groupBy(doc).agg(F.percentile(length, 0.5).alias("median"))
    odd = (F.col(length) >= 8000) & (F.col(length) > 4 * F.col("median"))
    quality = F.least(F.lit(1.0), F.col(length) / 900) * F.when(odd, 0.15).otherwise(1.0)
    return pages.join(median, doc, "left").withColumn("abnormal", F.coalesce(odd, F.lit(False))).withColumn("quality", F.round(quality, 6)).drop("median")


#: Bytes of a vector's number.
NUMBER = 4


def report(chunks: DataFrame, chapters: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per chapter, status, class and subject, and in all: chapters, chunks, characters, tokens, vectors, bytes, concepts, their share with issues.

    chunks: (chapter, text, dims: a vector's length or null). chapters: (chapter, status, class_level, subject).
    concepts: (chapter, issues: a number). Bytes are those of the text and of vectors.
    """
    n = F.length("text")
    c = chunks.groupBy("chapter").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.sum(F.greatest(F.lit(1), F.round(n / 4).cast("int"))).alias("tokens"), F.count_if(n < 40).alias("short_chunks"), F.count("dims").alias("embedded"), F.coalesce(F.sum("dims") * NUMBER, F.lit(0)).alias("vector_bytes"))
    k = concepts.groupBy("chapter").agg(F.count("*").alias("concepts"), F.count_if(F.col("issues") > 0).alias("with_issues"))
    rows = chapters.join(c, "chapter", "left").join(k, "chapter", "left").na.fill(0)
    total = lambda x: F.sum(x).alias(x)
    by = rows.groupingSets([["chapter"], ["status"], ["class_level"], ["subject"], []], "chapter", "status", "class_level", "subject").agg(
        F.count("*").alias("chapters"), *map(total, ("chunks", "chars", "tokens", "short_chunks", "embedded", "vector_bytes", "concepts", "with_issues"))
    )
    share = F.when(F.col("concepts") > 0, F.round(F.col("with_issues") / F.col("concepts"), 4)).otherwise(0.0)
    return by.withColumns({"memory_bytes": F.col("chars") + F.col("vector_bytes"), "error_rate": share})


def retrieval_evidence(chunks: DataFrame, most: int = 500) -> DataFrame:
    """Per chapter of chunks (chapter, page_start, page_end, dims: a vector's length or null): chunks, vectors, their share and lengths, the first page ranges, whether there are more.

    A range without an end is one page; one that doesn't start at a page is none.
    """
    base = chunks.groupBy("chapter").agg(F.count("*").alias("chunks"), F.count_if(F.col("dims") > 0).alias("embedded"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("dims") > 0, F.col("dims")))), ",").alias("dims"))
    ranges = chunks.where("page_start > 0").select("chapter", "page_start", F.coalesce("page_end", "page_start").alias("page_end")).distinct()
    first = latest(ranges, ["chapter"], [F.asc("page_start"), F.asc("page_end")], most + 1)
    listed = F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", F.concat_ws("-", "page_start", "page_end").alias("r")))))
    pages = first.groupBy("chapter").agg(F.array_join(F.transform(listed, lambda x: x["r"]), ",").alias("ranges"), (F.max("rn") > most).alias("truncated"))
    share = F.round(F.col("embedded") / F.col("chunks") * 100, 1).alias("embedded_percent")
    return base.join(pages, "chapter", "left").select("chapter", "chunks", "embedded", share, "dims", F.coalesce("ranges", F.lit("")).alias("ranges"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def catalog(chunks: DataFrame) -> DataFrame:
    """Subject and chapter counts nested as text: chapter=n in order."""
    by = chunks.groupBy("subject", "chapter").agg(F.count("*").alias("n"))
    return by.groupBy("subject").agg(F.count("*").alias("chapters"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "n"))), lambda x: F.concat_ws("=", x["chapter"], x["n"].cast("string"))), ",").alias("contents"))


def renamed_collisions(concepts: DataFrame) -> DataFrame:
    """Exact repeats of an id and its content go; another content under one id is renamed id_<hash>."""
    payload = F.sha2("content", 256)
    kept = concepts.withColumn("digest", payload).groupBy("concept_id", "digest").agg(F.min("seq").alias("seq"))
    # of an id, the content that came first keeps it; a minimum needs no id's contents in one place
    first = kept.groupBy("concept_id").agg(F.min(F.struct("seq", "digest")).alias("first"))
    return kept.join(first, "concept_id").select(F.when(F.col("first.digest") == F.col("digest"), F.col("concept_id")).otherwise(F.concat_ws("_", "concept_id", F.substring("digest", 1, 10))).alias("final_id"), "concept_id", "seq")


_WHITE = " \t\n\r\x0b\x0c"


def halves(text: str, most: int) -> list[str]:
    """The text in parts of at most `most` characters, in order, by cutting a longer one in two again and again.

    A cut is at the last blank or line feed of the middle half, or in the middle where there is none;
    white space around a part goes, and nothing else.
    """
    out, left = [], [text.strip(_WHITE)]
    while left:
        now = left.pop()
        if len(now) <= most or len(now) < 2:
            out += [now] if now else []
            continue
        middle = len(now) // 2
        low, high = max(1, middle // 2), min(len(now) - 1, middle + middle // 2)
        at = max(now.rfind(" ", low, high), now.rfind("\n", low, high))
        at = middle if at < 0 else at
        left += [now[at:].strip(_WHITE), now[:at].strip(_WHITE)]
    return out


def split_texts(pages: DataFrame, most: int) -> DataFrame:
    """pages with part (from 0) and text cut to parts of at most `most` characters; an empty or null text has none."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            parts = [halves(t or "", most) for t in batch.column("text").to_pylist()]
            at = pa.array([k for k, p in enumerate(parts) for _ in p], pa.int64())
            rest = [batch.column(c).take(at) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([k for p in parts for k in range(len(p))], pa.int64()), pa.array([x for p in parts for x in p], pa.string())], names=[*names, "part", "text"])

    names = [c for c in pages.columns if c not in ("text", "part")]
    kind = T.StructType([*(pages.schema[c] for c in names), T.StructField("part", T.LongType()), T.StructField("text", T.StringType())])
    return pages.select(*names, "text").mapInArrow(run, kind)


def paper_batches(pages: DataFrame, doc: str, budget: int) -> DataFrame:
    """pages (doc, page, part, n and others) with batch: in order, a new one when the next would pass the budget of characters.

    The running sum starts anew with each batch, which a window can't express: a task folds its
    documents' sorted rows as they stream by and carries only the sum and the batch.
    """
    ship(pages.sparkSession)

    def run(batches):
        last, total, batch = None, 0, 0
        for part in batches:
            out = []
            for name, n in zip(part.column(doc).to_pylist(), part.column("n").to_pylist()):
                if (name,) != last:
                    last, total, batch = (name,), 0, 0
                over = None not in (total, n) and total > 0 and total + n > budget
                batch += over
                total = n if over else None if None in (total, n) else total + n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], names=[*part.schema.names, "batch"])

    kind = T.StructType([*pages.schema.fields, T.StructField("batch", T.IntegerType())])
    return pages.repartition(doc).sortWithinPartitions(doc, "page", "part", "n").mapInArrow(run, kind)
