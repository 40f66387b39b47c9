"""Shared by the text operators: Arrow batches in bounded slices, words, arrays of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.runtime import ship

#: Bytes of text that a Python function works on at once (a longer text comes alone).
SLICE_BYTES = 2 << 20
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "longs": pa.list_(pa.int64()), "stretches": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
#: Names of ARROW that Spark knows by another.
SQL = {" longs": " array<long>", " stretches": " array<struct<start:long,length:long,period:long>>", "!": " not null"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def slices(batches: Iterator[pa.RecordBatch], column: str | None = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about limit bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if column is None:
            yield batch
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def arrow_fields(schema: str) -> pa.Schema:
    """An Arrow schema from "name type, ..." with the names of ARROW; type! is never null."""
    return pa.schema([(n, ARROW[t.rstrip("!")]) for n, t in (x.split() for x in schema.split(","))])


def map_slices(df: DataFrame, start: Callable[[], Callable], schema: str, column: str | None = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """df's slices through a function that start() makes once per task.

    The function gets an Arrow record batch and returns a list of columns (or None for no
    rows) in the order of schema. If it has an attribute rest, that is called at the task's end.
    """
    ship(df.sparkSession)
    fields = arrow_fields(schema)

    def packed(out):
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, fields)], schema=fields)

    def run(batches):
        step = start()
        for part in slices(batches, column, limit):
            out = step(part)
            if out is not None:
                yield packed(out)
        if (rest := getattr(step, "rest", None)) is not None:
            yield packed(rest())

    for own, name in SQL.items():
        schema = schema.replace(own, name)
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, start: Callable[[], Callable], schema: str, column: str) -> DataFrame:
    """All columns of df and those of schema, which replace any of their name.

    start() gives a function from a slice to a list of columns, as for map_slices.
    """
    ship(df.sparkSession)
    own = empty_like(schema)
    kept = [f for f in df.schema.fields if f.name not in own.names or f.name == column]
    out = T.StructType([*(f for f in kept if f.name not in own.names), *own.fields])
    types = arrow_fields(schema)

    def run(batches):
        step = start()
        for part in slices(batches, column):
            new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(step(part), types)]
            names = [f.name for f in kept if f.name not in own.names]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], names=[*names, *own.names])

    return df.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, out)


def utf8(part: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; a null is empty."""
    return [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def strings(part: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in part.column(column).to_pylist()]


def spaced(raw: bytes) -> bytes:
    """The words (runs without the six ASCII white-space characters), one space apart."""
    return b" ".join(raw.split())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(column: str, folds: int, fold: int):
    """True where crc32 of the id as text leaves remainder fold; never for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def empty_like(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)
