"""Learner sessions: cleaning, telemetry, topic performance, cognitive metrics, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, 0 where whole is 0 or null."""
    return F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def sanitise(raw: DataFrame) -> DataFrame:
    """Score within 0 and the total, counts not negative, focus in 0..100, duration from the ends."""
    score = F.greatest(F.lit(0), F.least("score", "total_questions"))
    ends = F.greatest(F.lit(0), F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))
    return raw.select(
        "id", "user_id", score.alias("score"), (score * 10).alias("xp_earned"), F.round(percent(score, F.col("total_questions")), 2).alias("accuracy_rate"),
        F.greatest(F.lit(0), "hint_count").alias("hint_count"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "focus_score")), 6).alias("focus_score"),
        F.when(F.col("time_spent_seconds") > 0, F.col("time_spent_seconds").cast("long")).otherwise(F.coalesce(ends, F.lit(0))).alias("duration_seconds"),
    )


def effective_duration(raw: DataFrame) -> DataFrame:
    """(id, duration_seconds): time spent if positive, else end less start, else 0."""
    return sanitise(raw).select("id", "duration_seconds")


def derived(progress: DataFrame) -> DataFrame:
    """(user_id, accuracy, level): accuracy is 0 without questions; a level is 100 xp."""
    return progress.select("user_id", F.round(percent(F.col("total_correct"), F.col("total_questions")), 4).alias("accuracy"), (F.floor(F.col("xp") / 100) + 1).alias("level"))


def presented(sessions: DataFrame) -> DataFrame:
    """A session as shown: rounded minutes (1 at least if any time), whole percent, change in confidence."""
    rounded = F.round(F.col("time_spent_seconds") / 60)
    minutes = F.when((F.col("time_spent_seconds") > 0) & (rounded == 0), 1).otherwise(rounded)
    return sessions.select("id", "user_id", "topic", minutes.cast("long").alias("minutes"), F.round(percent(F.col("score"), F.col("total_questions"))).cast("long").alias("performance"), F.round(F.col("confidence_after") - F.col("confidence_before"), 1).alias("confidence_change"))


def telemetry(sessions: DataFrame, key: str = "user_id") -> DataFrame:
    """Per learner: averages over positive latencies and durations, but over all hints and retries."""
    over = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    return sessions.groupBy(key).agg(
        F.count("*").alias("sessions"), F.round(F.coalesce(over("response_latency_ms"), F.lit(0.0)), 4).alias("avg_latency_ms"), F.round(F.coalesce(over("time_spent_seconds"), F.lit(0.0)), 4).alias("avg_duration"),
        F.round(F.avg("hint_count"), 4).alias("avg_hints"), F.round(F.avg("retry_count"), 4).alias("avg_retries"), F.sum("time_spent_seconds").alias("total_seconds"),
        F.round(F.avg("confidence_before"), 6).alias("avg_confidence_before"), F.round(F.avg(F.col("confidence_after") - F.col("confidence_before")), 6).alias("avg_confidence_change"),
    )


def topic_performance(sessions: DataFrame, weak_below: float = 60.0) -> DataFrame:
    """Per learner and topic: running accuracy, its last change, weakness, last practice."""
    order = Window.partitionBy("user_id", "topic").orderBy("completed_at", "id")
    running = sessions.select("user_id", "topic", "id", "completed_at", F.sum("total_questions").over(order).alias("attempts"), F.sum("score").over(order).alias("correct"))
    accuracy = percent(F.col("correct"), F.col("attempts"))
    trend = running.withColumn("accuracy", accuracy).withColumn("trend", F.col("accuracy") - F.lag("accuracy").over(order))
    last = trend.groupBy("user_id", "topic").agg(F.max_by(F.struct("attempts", "correct", "accuracy", "trend"), F.struct("completed_at", "id")).alias("x"), F.max("completed_at").alias("last_practiced"))
    return last.select("user_id", "topic", "x.attempts", "x.correct", F.round("x.accuracy", 4).alias("accuracy"), F.round(F.coalesce("x.trend", F.lit(0.0)), 4).alias("trend"), (F.col("x.accuracy") < weak_below).alias("weak"), "last_practiced")


def question_pace(sessions: DataFrame, keep: float = 0.7) -> DataFrame:
    """(user_id, topic, avg_time): an exponential mean of seconds a question; the first one seeds it.

    The fold needs a topic's sessions in order, so they are gathered for each learner and topic.
    """
    each = F.struct("completed_at", "id", (F.col("time_spent_seconds") / F.col("total_questions")).alias("t"))
    rows = sessions.where("time_spent_seconds > 0 and total_questions > 0").groupBy("user_id", "topic").agg(F.array_sort(F.collect_list(each)).alias("xs"))
    fold = F.aggregate("xs", F.lit(0.0), lambda a, x: F.when(a == 0, x["t"]).otherwise(a * keep + x["t"] * (1 - keep)))
    return rows.select("user_id", "topic", F.round(fold, 4).alias("avg_time"))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key in that order, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def cognitive(sessions: DataFrame, as_of: str, last: int = 10) -> DataFrame:
    """Focus, consistency and efficiency of each learner's last sessions by date.

    Consistency is sessions a day since the oldest of them, times 20; efficiency is the mean
    accuracy over the mean seconds, times 100; both end at 100.
    """
    recent = latest(sessions, ["user_id"], [F.desc("date"), F.desc("id")], last)
    days = F.datediff(F.lit(as_of).cast("date"), F.min("date"))
    seconds = F.avg(F.greatest("time_spent_seconds", F.lit(0)))
    return recent.groupBy("user_id").agg(
        F.round(F.avg("focus_score"), 4).alias("focus"), F.round(F.least(F.lit(100.0), F.count("*") / F.greatest(F.lit(1), days) * 20), 4).alias("consistency"),
        F.round(F.least(F.lit(100.0), F.avg("accuracy_rate") / F.greatest(F.lit(1.0), seconds) * 100), 4).alias("efficiency"),
    )


def topic_evidence(sessions: DataFrame, last: int = 10) -> DataFrame:
    """The last sessions, and the latest one of each topic that these lack (a null topic is one)."""
    recent = latest(sessions, ["user_id"], [F.desc("completed_at"), F.desc("id")], last)
    newest = latest(sessions, ["user_id", "topic"], [F.desc("completed_at"), F.desc("id")], 1)
    seen = recent.select(F.col("user_id").alias("u"), F.col("topic").alias("t")).distinct()
    other = newest.join(seen, (F.col("user_id") == F.col("u")) & F.col("topic").eqNullSafe(F.col("t")), "left_anti")
    columns = ["user_id", "id", "topic"]
    return recent.select(*columns, F.lit("recent").alias("evidence")).unionByName(other.select(*columns, F.lit("older").alias("evidence")))


def streaks(sessions: DataFrame) -> DataFrame:
    """(user_id, streak, last_day): the run of consecutive days that ends with the last active one."""
    days = sessions.select("user_id", "date").distinct()
    order = Window.partitionBy("user_id").orderBy("date")
    runs = days.withColumn("island", F.date_sub("date", F.row_number().over(order))).groupBy("user_id", "island").agg(F.count("*").alias("streak"), F.max("date").alias("last_day"))
    return runs.groupBy("user_id").agg(F.max_by("streak", "last_day").alias("streak"), F.max("last_day").alias("last_day"))


def dashboard(sessions: DataFrame, as_of: str) -> DataFrame:
    """Per learner: totals, weak topics (worst three), last ten accuracies ascending in time, days to level."""
    topics = topic_performance(sessions)
    weak = latest(topics.where("weak"), ["user_id"], [F.asc("accuracy"), F.asc("topic")], 3).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "topic"))), lambda x: x["topic"]), ",").alias("weak_topics"))
    recent = latest(sessions, ["user_id"], [F.desc("completed_at"), F.desc("id")], 10)
    trend = recent.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("completed_at", "id", "score"))), lambda x: x["score"].cast("string")), ",").alias("recent_scores"))
    span = F.greatest(F.lit(1), F.datediff(F.lit(as_of).cast("date"), F.min("date")))
    total = sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("xp_earned").alias("xp"), F.round(percent(F.sum("score"), F.sum("total_questions")), 4).alias("accuracy"), span.alias("days"))
    left = 100 - F.col("xp") % 100
    out = total.withColumn("days_to_level", F.when(F.col("xp") > 0, F.ceil(left * F.col("days") / F.col("xp"))))
    return out.join(weak, "user_id", "left").join(trend, "user_id", "left").join(cognitive(sessions, as_of), "user_id").drop("days").withColumn("weak_topics", F.coalesce("weak_topics", F.lit("")))


def revision_scores(topics: DataFrame, as_of: str) -> DataFrame:
    """Spaced repetition of practised topics: retention halves once per stability in days.

    A topic without a date counts as three half-lives old.
    """
    acc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("correct") / F.col("attempts")))
    base = (1 + F.least(F.lit(40), "attempts") * 0.15 * (0.4 + acc)) * F.when(F.col("weak"), 0.5).otherwise(1.0)
    stability = F.greatest(F.lit(1.0), F.least(F.lit(14.0), base))
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_practiced")
    t = topics.where("attempts > 0").withColumn("acc", acc).withColumn("stab", stability)
    t = t.withColumn("days", F.when(F.col("last_practiced").isNull(), F.col("stab") * 3).otherwise(F.greatest(F.lit(0.0), seconds / 86400.0)))
    retention = F.pow(F.lit(0.5), F.col("days") / F.col("stab"))
    priority = (1 - retention) * 70 + (1 - F.col("acc")) * 30 + F.when(F.col("weak"), 12).otherwise(0) + F.when(F.col("trend") < 0, 6).otherwise(0)
    bucket = F.when(F.col("days") >= 1.5 * F.col("stab"), "overdue").when(F.col("days") >= 0.75 * F.col("stab"), "due").when(F.col("acc") < 0.6, "strengthen").otherwise("fresh")
    mode = F.when(F.col("acc") < 0.5, "deep_review").when(bucket == "overdue", "quick_recall").otherwise("practice_mcq")
    minutes = F.when(F.col("acc") < 0.5, 15).when(bucket == "overdue", 12).when(bucket == "fresh", 5).otherwise(10)
    name = F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit("General"))
    return t.select("user_id", name.alias("topic"), F.round(retention, 3).alias("retention"), F.round(F.least(F.lit(100.0), priority), 1).alias("priority"), bucket.alias("bucket"), mode.alias("mode"), minutes.alias("minutes"), (F.col("trend") < 0).alias("declining"))


def _bucket_order() -> Column:
    return F.when(F.col("bucket") == "overdue", 0).when(F.col("bucket") == "due", 1).when(F.col("bucket") == "strengthen", 2).otherwise(3)


def revision_queue(scores: DataFrame, k: int = 25) -> DataFrame:
    """Each learner's k most pressing topics."""
    return latest(scores, ["user_id"], [_bucket_order(), F.desc("priority"), F.asc("topic")], k, "position").select("user_id", "topic", "bucket", "priority", "position")


def revision_summary(scores: DataFrame) -> DataFrame:
    """Counts of each learner's queue, its top pick and a headline."""
    n = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    out = scores.groupBy("user_id").agg(n("overdue"), n("due"), n("strengthen"), n("fresh"), F.min_by("topic", F.struct(_bucket_order(), -F.col("priority"), F.col("topic"))).alias("top_topic"))
    late = F.concat(F.col("overdue").cast("string"), F.when(F.col("overdue") == 1, " topic overdue: start with ").otherwise(" topics overdue: start with "), F.col("top_topic"))
    soon = F.concat(F.lit("review "), F.col("top_topic"), F.lit(" before it fades"))
    return out.withColumn("message", F.when(F.col("overdue") > 0, late).when(F.col("due") + F.col("strengthen") > 0, soon).otherwise("all topics are fresh"))
