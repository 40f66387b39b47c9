"""Trace and event facts: unions, roll-ups, exact percentiles, deltas between periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.operators.sessions import latest

COMPLETED, FAILED, REVIEW = ("success", "completed"), ("failed", "error"), ("review", "needs_review")


def window(df: DataFrame, as_of: str, hours: int, column: str = "created_at") -> DataFrame:
    """Rows of the hours before as_of, its end included."""
    end = F.lit(as_of).cast("timestamp")
    return df.where((F.col(column) > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(column) <= end))


def positive_mean(c: str) -> Column:
    return F.avg(F.when(F.col(c) > 0, F.col(c)))


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles of the positive values of each key, at any size of a key.

    Equal values are added up first, so the running count sees each distinct value once.
    """
    counts = df.where(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("_below", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda f: F.min(F.when(F.col("_below") >= F.ceil(F.col("_all") * F.lit(f)), F.col(value)))
    return run.groupBy(*keys).agg(*(at(f).alias(n) for n, f in fractions.items()))


def summary(events: DataFrame, as_of: str, hours: int) -> DataFrame:
    """One row: events, errors and cost of the window."""
    e = window(events, as_of, hours)
    return e.groupBy().agg(F.count("*").alias("events"), F.count_if(F.col("severity").isin("error", "critical")).alias("errors"), F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 6).alias("cost"))


def by_type(events: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Events and mean latency (zeros count) of each type."""
    return window(events, as_of, hours).groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


def model_usage(traces: DataFrame, top: int = 20) -> DataFrame:
    """Calls, failures, latency (with and without zeros), tokens and cost of each model."""
    m = traces.where("trace_type = 'model'").groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("status").isin("success", "skipped")).alias("failures"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_all"),
        F.round(positive_mean("latency_ms"), 4).alias("avg_latency_positive"), F.sum(F.col("estimated_input_tokens") + F.col("estimated_output_tokens")).alias("tokens"), F.round(F.sum("estimated_cost_usd"), 6).alias("cost"),
    )
    return m.orderBy(F.desc("calls"), "provider", "model").limit(top)


def failure_rate(traces: DataFrame) -> DataFrame:
    """Share of rows that neither succeeded nor were skipped; null without rows."""
    return traces.groupBy().agg(F.round(F.count_if(~F.col("status").isin("success", "skipped")) / F.nullif(F.count("*"), F.lit(0)), 6).alias("failure_rate"))


def runs(traces: DataFrame) -> DataFrame:
    """A row per turn: its status, latency without routing, cost and distinct models."""
    key = F.coalesce(F.col("turn_id").cast("string"), F.concat_ws("-", "trace_type", "id"))
    return traces.groupBy(key.alias("run")).agg(
        F.min_by("status", F.when(F.col("trace_type") == "turn", F.col("id"))).alias("status"), F.sum(F.when(~F.col("trace_type").isin("route", "dispatch"), F.col("latency_ms")).otherwise(0)).alias("latency_ms"),
        F.round(F.sum("estimated_cost_usd"), 6).alias("cost"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("trace_type") == "model", F.col("model")))), ",").alias("models"), F.count("*").alias("steps"),
    )


def quality(traces: DataFrame, sample: int = 500) -> DataFrame:
    """Mean quality, grounded rate and success rate of the latest turns."""
    last = traces.where("trace_type = 'turn'").orderBy(F.desc("created_at"), F.desc("id")).limit(sample)
    return last.groupBy().agg(F.count("*").alias("turns"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.round(F.avg("grounded"), 6).alias("grounded_rate"), F.round(F.avg((F.col("status") == "success").cast("int")), 6).alias("success_rate"))


def console(traces: DataFrame, as_of: str) -> DataFrame:
    """Counters of the last day: low and verified quality, slow and failed turns, rows by kind."""
    t = window(traces, as_of, 24)
    n = lambda c, name: F.count_if(c).alias(name)
    kind, state = (lambda k: F.col("trace_type") == k), (lambda k: F.col("status") == k)
    turn, bad = kind("turn"), state("failed")
    return t.groupBy().agg(
        F.count("*").alias("rows"), n(turn, "turns"), n(kind("model"), "models"), n(kind("tool"), "tools"), n(kind("dispatch"), "dispatches"), n(turn & (F.col("quality") < 0.65), "low_quality"), n(turn & (F.col("quality") >= 0.82), "verified"),
        n(turn & (F.col("grounded") == 0), "ungrounded"), n(F.col("latency_ms") >= 7000, "slow"), n(turn & (F.col("latency_ms") >= 4000), "slow_turns"), n(bad, "failed"), n(bad & turn, "failed_turns"), n(bad & kind("model"), "failed_models"),
        n(bad & kind("tool"), "failed_tools"), n(state("success"), "succeeded"), n(state("skipped"), "skipped"), n(F.col("status").like("%view%"), "review"), n(F.col("agent").like("%1"), "first_agent"), n(F.col("model").like("m%") & kind("model"), "named_models"),
        n(F.col("estimated_input_tokens") > 400, "large_inputs"), n(F.col("estimated_output_tokens") == 0, "empty_outputs"), n(F.col("estimated_cost_usd") > 0, "paid"), F.count_distinct("user_id").alias("users"), F.count_distinct("agent").alias("agents"), F.count_distinct("turn_id").alias("runs"),
    )


def intelligence(traces: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Per agent: this period, the one before, and how quality and latency moved; success and tokens of all its traces until as_of."""
    end = F.lit(as_of).cast("timestamp")
    age = (F.unix_timestamp(end) - F.unix_timestamp("created_at")) / 3600
    now, past = (age >= 0) & (age < hours), (age >= hours) & (age < 2 * hours)
    t = traces.where(age >= 0)
    mean = lambda c, w: F.avg(F.when(w, F.col(c)))
    out = t.groupBy("agent").agg(
        F.count_if(now).alias("runs"), F.round(mean("quality", now), 6).alias("quality"), F.round(mean("quality", now) - mean("quality", past), 6).alias("quality_delta"), F.round(mean("latency_ms", now) - mean("latency_ms", past), 4).alias("latency_delta"),
        F.round(F.count_if(F.col("status") == "success") / F.count("*"), 6).alias("success_rate"), F.coalesce(F.sum(F.col("estimated_input_tokens") + F.col("estimated_output_tokens")), F.lit(0)).alias("tokens"),
    )
    trend = F.when(F.col("runs") == 0, "idle").when(F.col("quality_delta") >= 0.02, "improving").when(F.col("quality_delta") <= -0.02, "declining").otherwise("steady")
    return out.withColumn("trend", trend)


def source_usage(traces: DataFrame, top: int = 6) -> DataFrame:
    """Rows of each provider per agent, the six most used."""
    by = traces.groupBy("agent", "provider", "model").agg(F.count("*").alias("n"))
    order = Window.partitionBy("agent").orderBy(F.desc("n"), "provider", "model")
    return by.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top).select("agent", "provider", "model", "n")


def freshness(events: DataFrame, as_of: str) -> DataFrame:
    """Rows of the last day, the last week and before, and the latest time, by source."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")
    return events.groupBy("source").agg(F.count_if(age <= 86400).alias("day"), F.count_if((age > 86400) & (age <= 7 * 86400)).alias("week"), F.count_if(age > 7 * 86400).alias("historical"), F.max("created_at").alias("latest"))


def state(status: Column) -> Column:
    """completed, failed, review, or unknown for any other word."""
    return F.when(status.isin(*COMPLETED), "completed").when(status.isin(*FAILED), "failed").when(status.isin(*REVIEW), "review").otherwise("unknown")


def snapshot(traces: DataFrame) -> DataFrame:
    """Per agent measures, by way of one partial sum per kind, agent and state."""
    part = traces.groupBy("trace_type", "agent", state(F.col("status")).alias("state")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("ms"), F.count_if(F.col("latency_ms") > 0).alias("timed"), F.sum(F.col("estimated_input_tokens") + F.col("estimated_output_tokens")).alias("tokens"), F.sum("estimated_cost_usd").alias("cost"))
    of = lambda s: F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0))
    done = of("completed") + of("failed") + of("review")
    return part.groupBy("agent").agg(
        F.sum("n").alias("recorded"), of("completed").alias("completed"), of("failed").alias("failed"), of("review").alias("review"), F.round(F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0)), 4).alias("avg_latency"),
        F.round(of("completed") / F.nullif(done, F.lit(0)), 6).alias("success_rate"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"),
    )


def sampled_percentiles(traces: DataFrame, sample: int = 1500) -> DataFrame:
    """p50, p95 and p99 of each agent over the newest rows of all agents together."""
    newest = traces.where("trace_type = 'turn'").orderBy(F.desc("created_at"), F.desc("id")).limit(sample)
    return nearest_rank(newest, ["agent"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def daily(traces: DataFrame) -> DataFrame:
    s = state(F.col("status"))
    return traces.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("recorded"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"))


def recommendations(traces: DataFrame) -> DataFrame:
    """A rule's advice for each agent: failures, then reviews, then slowness over enough rows."""
    p = nearest_rank(traces, ["agent"], "latency_ms", {"p95": 0.95})
    s = snapshot(traces).join(p, "agent", "left")
    advice = F.when(F.col("failed") >= 3, "investigate failures").when(F.col("review") >= 3, "clear reviews").when((F.col("p95") >= 5000) & (F.col("recorded") >= 10), "reduce latency").otherwise("none")
    return s.select("agent", "failed", "review", "p95", advice.alias("recommendation"))


def collaboration(traces: DataFrame) -> DataFrame:
    """Messages and hand-offs by agent, and of each hand-off the pair as seen from both parties."""
    kinds = traces.where("trace_type IN ('tool', 'dispatch')").select(F.when(F.col("trace_type") == "tool", "message").otherwise("handoff").alias("kind"), "agent", "provider")
    seen = lambda side, a, b: F.struct(F.lit(side).alias("side"), F.col(a).alias("party"), F.col(b).alias("other"))
    sides = F.when(F.col("kind") == "message", F.array(seen("from", "agent", "provider"))).otherwise(F.array(seen("from", "agent", "provider"), seen("to", "provider", "agent")))
    return kinds.select("kind", F.explode(sides).alias("x")).groupBy("kind", "x.side", "x.party", "x.other").agg(F.count("*").alias("n"))


def records(traces: DataFrame, events: DataFrame) -> DataFrame:
    """Traces and events as one record shape."""
    a = traces.select(F.lit("trace").alias("kind"), F.col("id").alias("ref"), "agent", state(F.col("status")).alias("state"), "created_at", "latency_ms")
    b = events.select(F.lit("event").alias("kind"), F.col("event_version").alias("ref"), F.col("agent_id").alias("agent"), F.when(F.col("severity").isin("error", "critical"), "failed").otherwise("completed").alias("state"), "created_at", "latency_ms")
    return a.unionByName(b)


def spend(traces: DataFrame, as_of: str, budget: float) -> DataFrame:
    t = window(traces, as_of, 24)
    return t.groupBy().agg(F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 6).alias("spend")).withColumn("allowed", F.col("spend") < budget)


def quotas(events: DataFrame, limit: int) -> DataFrame:
    """Uses of each kind by day and hashed user, and those over the limit."""
    by = events.groupBy(F.to_date("created_at").alias("day"), F.col("event_type").alias("quota"), F.sha2("session_id", 256).alias("user_hash")).agg(F.count("*").alias("used"))
    return by.withColumn("over", F.greatest(F.lit(0), F.col("used") - limit))


def run_summary(traces: DataFrame) -> DataFrame:
    """Steps, messages, tool calls and hand-offs of each run."""
    n = lambda k: F.count_if(F.col("trace_type") == k)
    return traces.groupBy("turn_id").agg(n("turn").alias("steps"), n("model").alias("messages"), n("tool").alias("tool_calls"), n("dispatch").alias("handoffs"))


def agent_status(events: DataFrame, last: int = 50) -> DataFrame:
    """Per agent: counters, last event, success rate (100 without any), mean latency of the last ones."""
    bad = F.col("severity").isin("error", "critical")
    recent = latest(events.select("agent_id", "event_version", "latency_ms"), ["agent_id"], [F.desc("event_version")], last).groupBy("agent_id").agg(F.round(F.avg("latency_ms"), 4).alias("recent_latency"))
    return events.groupBy("agent_id").agg(
        F.count("*").alias("events"), F.count_if(bad).alias("errors"), F.max_by("event_type", "event_version").alias("last_event"), F.when(F.max_by(bad, "event_version"), "failed").otherwise("idle").alias("status"),
        F.round(F.coalesce(100.0 * F.count_if(~bad) / F.nullif(F.count("*"), F.lit(0)), F.lit(100.0)), 4).alias("success_rate"),
    ).join(recent, "agent_id")


def live_status(traces: DataFrame, as_of: str) -> DataFrame:
    """active within 5 minutes, stale after 30, with each agent's overlapping runs of that time."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")
    t = traces.withColumn("age", age).where("age >= 0")
    state_ = F.when(F.min("age") <= 300, "active").when(F.min("age") > 1800, "stale").otherwise("idle")
    return t.groupBy("agent").agg(state_.alias("live"), F.min("age").alias("seconds"), F.count_distinct(F.when(F.col("age") <= 1800, F.col("turn_id"))).alias("overlap"))


def timeline(traces: DataFrame) -> DataFrame:
    """Each turn's steps in order, as kind:status."""
    steps = F.array_sort(F.collect_list(F.struct("created_at", "id", "trace_type", "status")))
    return traces.groupBy("turn_id").agg(F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["trace_type"], s["status"])), ",").alias("steps"))


def filtered(events: DataFrame, **facets: str | None) -> DataFrame:
    """Events that match every facet given."""
    for name, value in facets.items():
        if value is not None:
            events = events.where(F.col(name) == value)
    return events


def feed(events: DataFrame, since: int, limit: int = 500) -> DataFrame:
    """Events after a cursor, oldest first."""
    return events.where(F.col("event_version") > since).orderBy("event_version").limit(limit)


def overview(sessions: DataFrame, traces: DataFrame, interactions_users: DataFrame, as_of: str) -> DataFrame:
    """Distinct users of three tables, those active on the day, sessions and else traces of the last hour, and totals."""
    users = sessions.select("user_id").union(traces.select("user_id")).union(interactions_users.select("user_id")).distinct().groupBy().agg(F.count("*").alias("users"))
    end = F.lit(as_of).cast("timestamp")
    today = F.to_date(end)
    busy = sessions.where(F.col("date") == today).select("user_id").union(traces.where((F.col("created_at") >= F.date_trunc("day", end)) & (F.col("created_at") <= end)).select("user_id"))
    active = busy.groupBy().agg(F.count_distinct("user_id").alias("active_users"))
    hour = lambda c: (F.col(c) > end - F.expr("INTERVAL 1 HOUR")) & (F.col(c) <= end)
    recent = sessions.where(hour("completed_at")).groupBy().agg(F.count_distinct("id").alias("recent_sessions"))
    ops = traces.groupBy().agg(F.count_if(F.col("trace_type") == "turn").alias("turns"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_distinct(F.when(hour("created_at"), F.col("turn_id"))).alias("recent_turns"))
    fallback = F.coalesce(F.nullif("recent_sessions", F.lit(0)), F.col("recent_turns"))
    return users.crossJoin(active).crossJoin(recent).crossJoin(ops).withColumn("active_sessions", fallback).drop("recent_turns")


# States that are shown as they are, failures, the forms of references and names that may be shown.
STATES = ("success", "completed", "done", "failed", "error", "timeout", "timed_out", "needs_review", "fallback", "running", "active", "queued", "waiting", "skipped", "cancelled", "requested", "accepted")
FAILURES, TIMED_OUT = ("failed", "error", "timeout", "timed_out"), ("timeout", "timed_out")
REFERENCE, PROVIDER, MODEL = "^(run|turn)_[a-f0-9]{12}$", "^[a-zA-Z0-9_.-]{1,80}$", "^[a-zA-Z0-9_./:-]{1,120}$"


def masked(traces: DataFrame) -> DataFrame:
    """(id, state, ref, provider, model, latency_ms, error_class): only what may be shown.

    A state that isn't known is unknown; a reference or name of another form than the platform's is null, as is a latency of 0 or less.
    """
    shown = lambda c, form: F.when(F.col(c).rlike(form), F.col(c))
    known = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("unknown")
    wrong = F.when(F.col("status").isin(*TIMED_OUT), "timeout").when(F.col("status").isin(*FAILURES), "execution")
    return traces.select("id", known.alias("state"), shown("ref", REFERENCE).alias("ref"), shown("provider", PROVIDER).alias("provider"), shown("model", MODEL).alias("model"), F.when(F.col("latency_ms") > 0, F.col("latency_ms")).alias("latency_ms"), wrong.alias("error_class"))


def matched_agents(traces: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """(id, agent_name): a row for each agent with a keyword in the row's joined text."""
    text = F.lower(F.concat_ws(" ", "trace_type", "status", "provider", "model"))
    hit = F.array(*(F.when(F.exists(F.array(*(F.lit(k) for k in ks)), lambda k: text.contains(k)), F.lit(a)) for a, ks in keywords.items()))
    return traces.select("id", F.explode(F.array_compact(hit)).alias("agent_name"))


def retained(df: DataFrame, as_of: str, days: int, column: str = "created_at") -> DataFrame:
    """Rows no older than days; 0 days keeps all."""
    return df if not days else df.where(F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def retention_counts(traces: DataFrame, events: DataFrame, as_of: str, trace_days: int, event_days: int) -> DataFrame:
    """Rows that expire of each table; a turn's children go with the turn."""
    old = traces.groupBy("turn_id").agg(F.max("created_at").alias("last")).where(F.col("last") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {trace_days} DAYS"))
    gone = traces.join(old, "turn_id", "left_semi").groupBy().agg(F.count("*").alias("expired")).select(F.lit("traces").alias("table_name"), "expired")
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {event_days} DAYS")
    return gone.unionByName(events.where(F.col("created_at") < cut).groupBy().agg(F.count("*").alias("expired")).select(F.lit("events").alias("table_name"), "expired"))


def deduplicated(events: DataFrame) -> DataFrame:
    """Events with each positive version once, in any order of arrival; version 0 rows all stay."""
    return events.where("event_version > 0").dropDuplicates(["event_version"]).unionByName(events.where("event_version <= 0 OR event_version IS NULL"))


def rate_demand(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Requests of each user in the seconds up to each event, its own included, and the breach."""
    by = Window.partitionBy("session_id").orderBy(F.unix_timestamp("created_at")).rangeBetween(-(seconds - 1), 0)
    n = F.count("*").over(by)
    return events.select("event_version", n.alias("demand"), (n > limit).alias("breach"))
