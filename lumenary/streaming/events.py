"""Event streams: a ledger of versions, windows, sessions, request limits and agent state, with ten minutes of lateness."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenary.runtime import scratch, ship

LATE = "10 minutes"
#: A time in microseconds that no watermark passes.
FOREVER = 250_000_000_000_000_000
#: Rows of a key that a fold takes at once.
STRETCH = 20_000


def read(spark: SparkSession, sf_dir: str, table: str = "events", files: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, `files` at a time, with a proper event time column ts."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{table}*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the data there is now, by an idempotent sink.

    append goes to a Parquet sink, which writes each batch once. update replaces the result of a
    batch under its number (_batch), so a batch that runs again changes nothing; the caller takes
    each key's last row.
    """
    spark = stream.sparkSession
    folder = scratch(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events without those that repeat a key while the watermark may still see it."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, length: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts and sums of values by event-time window and keys."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    by = events.withWatermark("ts", LATE).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total_value"))
    return by.select(F.col("w.start").alias("window_start"), *keys, "events", "total_value")


def breaches(events: DataFrame, length: str, slide: str, limit: int) -> DataFrame:
    """Windows in which a user made over limit requests."""
    return windowed(events, length, slide, "user_id").where(F.col("events") > limit).select("window_start", "user_id", "events")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no gap over the given one."""
    by = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closes_at"), "events")


def recorded(stream: DataFrame, folder: str, source: str, version: str = "event_id", span: int = 1_000_000) -> DataFrame:
    """The rows of a ledger in folder after the stream's rows are put in, each positive version once, for good.

    A batch takes its own repeats out and, by an anti-join, what the ledger has from any other batch, however
    long ago and of whatever run; only the spans of versions that the batch has are read. A batch is
    written under its source and number, so one that runs again replaces itself. Rows with a version of
    0 or less, or none, have no identity: all stay. source names the stream's offsets: a run from new offsets needs another.
    """
    spark, ledger = stream.sparkSession, f"{folder}/ledger"

    def put(rows: DataFrame, batch: int) -> None:
        known = F.col(version) > 0
        rows = rows.withColumn("span", F.coalesce(F.floor(F.col(version) / span), F.lit(-1)))
        fresh = rows.where(known).dropDuplicates([version])
        at = fresh.agg(F.min("span"), F.max("span")).head()
        own = f"source={source}/batch={batch}"
        if at[0] is not None and files.exists(path(ledger)):
            old = spark.read.option("basePath", ledger).parquet(ledger).where(F.col("span").between(at[0], at[1]) & ~((F.col("source") == source) & (F.col("batch") == batch)))
            fresh = fresh.join(old.select(version), version, "left_anti").select(rows.columns)
        both = fresh.unionByName(rows.where(~F.coalesce(known, F.lit(False))))
        both.write.mode("overwrite").partitionBy("span").parquet(f"{ledger}/{own}")

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream.writeStream.option("checkpointLocation", f"{folder}/offsets-{source}").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.option("basePath", ledger).parquet(ledger).drop("span", "source", "batch")


def in_order(events: DataFrame, key: str, columns: list[str], fold: Callable, out: str) -> DataFrame:
    """Rows of out that fold() gives for each key's events in the order of (ts, event_id), once the watermark has passed them.

    fold(key, state, rows, until) gets what it returned before (None at first), a stretch of the key's next rows as tuples
    (microseconds, event_id, *columns) and the time up to which there are no others; it returns (state, rows out, the time up to
    which the state matters or None). State is that and the rows that may still be overtaken, as a compressed Arrow table; a
    timer at the next of them or at that time calls it again, and a key without either is forgotten. Rows are
    Python objects only a stretch of STRETCH at a time.
    """
    ship(events.sparkSession)
    names = [c.split()[0] for c in out.split(", ")]
    rows = events.withWatermark("ts", LATE).select("ts", F.unix_micros("ts").alias("t"), "event_id", key, *columns)
    fields = ["t", "event_id", *columns]
    schema, size = to_arrow_schema(rows.select(*fields).schema), STRETCH

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, stored = state.get if state.exists else ("null", None)
        kept, tables = json.loads(kept), [unpacked(stored)] if stored else []
        tables += [pa.Table.from_pandas(part, schema, preserve_index=False) for part in parts]
        waiting = pa.concat_tables([schema.empty_table(), *tables]).combine_chunks()
        tables.clear()
        waiting = waiting.take(pc.sort_indices(waiting, [(c, "ascending") for c in fields]))
        mark = state.getCurrentWatermarkMs() * 1000
        n = pc.sum(pc.less_equal(waiting["t"], mark)).as_py() or 0
        for a in range(0, n or 1, size):
            stretch = waiting.slice(a, min(size, n - a))
            now = list(zip(*(stretch[c].to_pylist() for c in fields)))
            kept, told, until = fold(keys[0], kept, now, mark if a + size >= n else now[-1][0])
            yield pd.DataFrame(told, columns=names)
        left = waiting.slice(n)
        times = [x for x in (left["t"][0].as_py() if len(left) else None, until) if x is not None]
        if times:
            state.update((json.dumps(kept), packed(left)))
            state.setTimeoutTimestamp(max(min(times), mark) // 1000 + 1)
        elif state.exists:
            state.remove()

    return rows.groupBy(key).applyInPandasWithState(_only(step, fields), out, "kept string, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def packed(rows: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows, max_chunksize=100_000)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _only(step: Callable, columns: list[str]) -> Callable:
    return lambda keys, parts, state: step(keys, (p[columns] for p in parts), state)


def limited(events: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """(key, event_id, allowed, retry_after): a verdict on every request, in the order of time.

    A key may make `limit` requests in any `seconds`; one that is denied doesn't count, and learns in how many whole
    seconds (1 at least) the oldest that counts is over. State is at most `limit` times a key and goes when they are over.
    """
    span = seconds * 1_000_000

    def fold(name, taken, rows, until):
        taken, out = taken or [], []
        for t, event, *_ in rows:
            while taken and taken[0] <= t - span:
                taken.pop(0)
            allowed = len(taken) < limit
            if allowed:
                taken.append(t)
            out.append((name, event, allowed, None if allowed else max(1, (span - (t - taken[0])) // 1_000_000)))
        last = taken[-1] + span if taken else None
        return taken, out, last if last and last > until else None

    return in_order(events, key, [], fold, f"{key} long, event_id long, allowed boolean, retry_after long")


def agent_health(events: DataFrame, key: str, last: int = 50, idle: int = 1800) -> DataFrame:
    """(key, step, status, health, requests, successes, errors, lapses, latency_ms): each agent's state after each stretch of its events, at the least after each batch.

    events have kind (start, complete, error, critical, state or anything else), latency and state. A start runs,
    a completion makes it idle and healthy and enters its latency, if over 0, into the mean of the last
    ones; an error warns, the fifth or a critical one is critical, and a critical one fails. An agent that
    runs without an event for `idle` seconds turns idle by a timer and warns: it lapsed. step grows with every change.
    """
    span = idle * 1_000_000

    def fold(name, state, rows, until):
        s = state or {"status": "idle", "health": "healthy", "requests": 0, "successes": 0, "errors": 0, "lapses": 0, "recent": [], "at": None, "step": 0}
        before = s["step"]

        def lapse(now):
            if s["status"] == "running" and now - s["at"] >= span:
                s.update(status="idle", health="warning", lapses=s["lapses"] + 1, step=s["step"] + 1)

        for t, _, kind, latency, other in rows:
            lapse(t)
            s["at"], s["step"] = t, s["step"] + 1
            if kind == "start":
                s.update(status="running", requests=s["requests"] + 1)
            elif kind == "complete":
                s.update(status="idle", health="healthy", successes=s["successes"] + 1)
                if latency and latency > 0:
                    s["recent"] = [*s["recent"], latency][-last:]
            elif kind in ("error", "critical"):
                s["errors"] += 1
                s["health"] = "critical" if kind == "critical" or s["errors"] >= 5 else "warning"
                if kind == "critical":
                    s["status"] = "failed"
            elif kind == "state" and other:
                s["status"] = other
        if s["at"] is not None:
            lapse(until)
        mean = round(sum(s["recent"]) / len(s["recent"]), 1) if s["recent"] else 0.0
        out = [(name, s["step"], s["status"], s["health"], s["requests"], s["successes"], s["errors"], s["lapses"], mean)] if s["step"] > before else []
        # an agent's counters stay for good: there are as many as agents
        return s, out, s["at"] + span if s["status"] == "running" else FOREVER

    return in_order(events, key, ["kind", "latency", "state"], fold, f"{key} long, step long, status string, health string, requests long, successes long, errors long, lapses long, latency_ms double")


def latest_state(rows: DataFrame, key: str, step: str) -> DataFrame:
    """The row of each key's greatest step."""
    columns = [c for c in rows.columns if c not in (key, step)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), step).alias("x")).select(key, "x.*")


def run_twice(stream: DataFrame, more: DataFrame, name: str, plan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[dict]]:
    """(rows, progress) of plan over a stream and, once that is drained, over the rows of more as well.

    more comes through a folder beside the stream, which the query reads from the start and finds
    empty until it runs again from its own offsets and state. Rows go to a Parquet sink in append mode.
    """
    spark = stream.sparkSession
    folder = scratch(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/more")
    both = plan(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/more")))
    told = []
    for step in range(2):
        if step:
            more.select(stream.columns).write.mode("append").parquet(f"{folder}/more")
        query = both.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").start()
        query.awaitTermination()
        told += [json.loads(p.json) for p in query.recentProgress]
    return spark.read.schema(both.schema).parquet(f"{folder}/rows"), told


def closed(stream: DataFrame, name: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The windows of a drained stream, each written once when the watermark passes it.

    A last row of a far time, whose own window never ends, lets the watermark pass all others. That ends
    the stream: rows that came to its offsets later would all be late, so it is for tables that are complete.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    end = stream.sparkSession.range(1).select(*((F.lit("2250-01-01 00:00:00") if n == "ts" else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))
    return run_twice(stream, end, name, plan)[0]


def late_rows(stream: DataFrame, again: DataFrame, name: str, delay: str = LATE) -> DataFrame:
    """(late, rows): of a stream and rows that are sent again after it, how many came behind the watermark, and all."""
    def plan(rows: DataFrame) -> DataFrame:
        return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).select("event_id")

    _, told = run_twice(stream, again, name, plan)
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in told for op in p.get("stateOperators", ()))
    return stream.sparkSession.createDataFrame([(late, sum(p["numInputRows"] for p in told))], "late long, rows long")
