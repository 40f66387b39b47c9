"""A pipeline of text operators over documents, a written table after each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary.llm import packing, secrets, simhash, substrings, toxicity
from lumenary.llm.common import documents, table
from lumenary.runtime import checkpointed, scratch


def aside(docs: DataFrame) -> DataFrame:
    """doc_id and text, other columns under names that no operator uses."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_in_{c}") for c in docs.columns if c not in ("doc_id", "text")))


def back(out: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """out with exactly the columns of docs, some of them changed."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(f"`_in_{c}`")
    return out.select(*((changed[c] if c in changed else own(c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic; the model learns from labels not held out.

    A null or empty text has no toxic word and stays; a repeated row gets the verdict of its twin;
    a score of just a half is toxic; an empty table stays empty; other columns pass, whatever their
    names; a text of any length counts whole.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return back(toxicity.score(aside(docs), model).where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Groups: SimHash within 4 bits, or 5-word shingle sets of similarity 0.8 or more. All texts
    without a word are one group. Of several rows of one id the one of the least hash stays. Rows
    without an id stay; an empty table stays empty; other columns pass; a text of any length is
    compared by all its shingles.
    """
    groups = checkpointed(simhash.resembling(docs))
    gone = groups.where("doc_id > component_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    often = checkpointed(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not often.head(1):
        return rest
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
    one = rest.join(often, "doc_id", "left_semi").select(*docs.columns, place.alias("_in_place")).where("_in_place = 1").drop("_in_place")
    return rest.join(often, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows of smaller ids; a document of which no word is left goes.

    A null or empty text has no window and stays, as do rows without an id; rows of one id cut
    nothing from each other; an empty table stays empty; n_chars, if there, follows the text; a text
    of any length is cut whole.
    """
    cut = substrings.deduplicate(aside(docs)).where("n_removed = 0 or n_removed < n_words")
    return back(cut, docs, text=F.col("kept"), **shorter(docs, F.col("n_removed") > 0, "kept"))


def shorter(docs: DataFrame, changed: Column, text: str) -> dict[str, Column]:
    """n_chars of changed rows, if docs has it."""
    if "n_chars" not in docs.columns:
        return {}
    return {"n_chars": F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_in_n_chars"))}


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret or linked part of a credential replaced by its kind in brackets.

    A null or empty text stays as it is; a repeated row is masked again; an empty table stays
    empty; other columns pass; n_chars, if there, follows the text; of spans that begin together the
    first kind names the mask; a text of any length is scanned whole.
    """
    return back(secrets.scan(aside(docs)), docs, text=F.col("masked"), **shorter(docs, F.col("spans") != "", "masked"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens.

    A null or empty text is one piece, the end id alone; a repeated row has a place of its own; an
    empty table gives no rows; other columns play no part; pieces of equal length go by id; a text of any
    length is cut into as many pieces as it needs.
    """
    cut = checkpointed(packing.with_copies(packing.pieces(docs)))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written as Parquet to the shared folder and reread."""
    folder = scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Models, shingle sets, tokens and the packing plan can't be told in SQL; tests hold each stage
#: against a plain version instead.
ORACLE_SQL = None
