"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenary.plans.bindings import source, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None, also: str | None = None):
    """Register a function of the named inputs' DataFrames as a query; sql: its DuckDB twin; also: a second name."""

    def put(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(source(spark, sf_dir, i) for i in inputs))

        run.__name__, run.__doc__ = name, f.__doc__
        for n in (name, also) if also else (name,):
            QUERIES[n] = run
            if sql:
                ORACLE[n] = with_views(sql)
        return f

    return put


from lumenary.plans import answers, concepts, content, exams, grounding, ingestion, learners, lessons, mastery, misc, payloads, planning, ranking, releases, retrieval, streams, tracing  # noqa: E402, F401
