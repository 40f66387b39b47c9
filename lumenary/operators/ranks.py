"""Rankings, weekly statistics, missions and pairings over all learners at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.operators.sessions import latest, percent
from lumenary.runtime import checkpointed


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with its place in that total order, from 1, without one task that sees all rows.

    Rows are dealt out by ranges of the order; each range is numbered by itself and moved by
    the number of rows in the ranges before it, a table of one row per range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: ranges are found by sampling, so a second evaluation could cut them elsewhere
    dealt = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftrightunsigned("_at", 33)).withColumn("_own", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._range") < F.col("a._range"), "left").groupBy(F.col("a._range").alias("_range")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_at", "_range", "_own", "_before")


def rank_within(df: DataFrame, key: str, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place among the rows of its key, however many those are."""
    placed = global_rank(df, [F.col(key), *order], "_place")
    first = placed.groupBy(key).agg(F.min("_place").alias("_first"))
    return placed.join(first, key).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def alias_of(user: Column) -> Column:
    return F.concat(F.lit("Student "), F.upper(F.substring(F.sha2(user.cast("string"), 256), 1, 6)))


def short_name(name: Column) -> Column:
    """First name and the initial of the last, or the only name."""
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, 1), F.lit(" "), F.substring(F.element_at(parts, -1), 1, 1), F.lit("."))).otherwise(F.element_at(parts, 1))


def privacy(profiles: DataFrame, viewer: int) -> DataFrame:
    """(user_id, name, alias, email): the e-mail only for the viewer's own row."""
    return profiles.select("user_id", short_name(F.col("display_name")).alias("name"), alias_of(F.col("user_id")).alias("alias"), F.when(F.col("user_id") == viewer, F.col("email")).alias("email"))


def active(progress: DataFrame) -> DataFrame:
    return progress.where("xp > 0 OR streak > 0 OR total_tests > 0")


def leaderboard_rows(progress: DataFrame, profiles: DataFrame) -> DataFrame:
    """Active learners with a name, an alias where there is none."""
    rows = active(progress).join(profiles.select("user_id", "display_name", "class_level"), "user_id", "left")
    return rows.select("user_id", F.coalesce(short_name(F.col("display_name")), alias_of(F.col("user_id"))).alias("name"), "class_level", "xp", "streak", "total_tests")


def rank_order() -> list[Column]:
    return [F.desc("xp"), F.desc("streak"), F.desc("total_tests"), F.lower("name").asc(), F.asc("user_id")]


def leaderboard(progress: DataFrame, profiles: DataFrame, top: int = 20) -> DataFrame:
    """The top rows with global and class rank (null without a class)."""
    rows = leaderboard_rows(progress, profiles)
    ranked = rows.orderBy(*rank_order()).limit(top)
    # the rows ahead of a top row are top rows too
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*rank_order()))
    return ranked.withColumns({"rank": number(), "class_rank": F.when(F.col("class_level").isNotNull(), number("class_level"))}).select("rank", "class_rank", "user_id", "name", "class_level", "xp", "streak", "total_tests")


def full_ranking(progress: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, rank) of every active learner."""
    return global_rank(leaderboard_rows(progress, profiles), rank_order()).select("user_id", "rank")


def monthly_scores(sessions: DataFrame, progress: DataFrame, as_of: str, days: int = 30, idle: int = 14) -> DataFrame:
    """0.7 accuracy and 0.3 exam volume (8 count in full) of exam sessions of learners seen lately."""
    day = F.lit(as_of).cast("date")
    exams = sessions.where(F.lower("session_type").contains("exam") & (F.col("date") >= F.date_sub(day, days)))
    by = exams.groupBy("user_id").agg(F.count("*").alias("exams"), F.sum("xp_earned").alias("xp"), percent(F.sum("score"), F.sum("total_questions")).alias("accuracy"), F.max("date").alias("last_exam"))
    seen = by.join(progress.select("user_id", "last_active_date"), "user_id", "left").where(F.greatest("last_exam", "last_active_date") >= F.date_sub(day, idle))
    score = 0.7 * F.col("accuracy") + 0.3 * F.least("exams", F.lit(8)) / 8 * 100
    return seen.select("user_id", "exams", "xp", F.round("accuracy", 4).alias("accuracy"), F.round(score, 4).alias("seed_score"))


def seed_rank(scores: DataFrame) -> DataFrame:
    return global_rank(scores, [F.desc("seed_score"), F.asc("user_id")])


def pairings(scores: DataFrame, newcomers: DataFrame) -> DataFrame:
    """(user_id, rival_user_id, match_basis): ranks 1-2, 3-4 and so on; an odd one out meets the best newcomer.

    newcomers (user_id, xp) pair among themselves by xp after that; who is left is unmatched.
    """
    ranked = seed_rank(scores).select("user_id", "rank")
    odd = ranked.groupBy().agg((F.max("rank") % 2).alias("odd"), F.max_by("user_id", "rank").alias("last_user"))
    fresh = global_rank(newcomers.join(scores.select("user_id"), "user_id", "left_anti"), [F.desc("xp"), F.asc("user_id")], "n")
    fresh = fresh.join(F.broadcast(odd), how="cross").withColumn("n", F.col("n") - F.coalesce("odd", F.lit(0)))
    taken = fresh.where("n = 0").select("user_id", F.col("last_user").alias("rival_user_id"), F.lit("fallback").alias("match_basis"))
    back = taken.select(F.col("rival_user_id").alias("user_id"), F.col("user_id").alias("rival_user_id"), "match_basis")

    def adjacent(rows: DataFrame, place: str, basis: str) -> DataFrame:
        rows = rows.select("user_id", F.col(place).alias("p"), F.floor((F.col(place) - 1) / 2).alias("pair"))
        a, b = rows.alias("a"), rows.alias("b")
        return a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.p") != F.col("b.p")), "left").select(F.col("a.user_id").alias("user_id"), F.col("b.user_id").alias("rival_user_id"), F.when(F.col("b.user_id").isNull(), "unmatched").otherwise(basis).alias("match_basis"))

    seeds = adjacent(ranked, "rank", "seed").join(back.select("user_id"), "user_id", "left_anti")
    return seeds.unionByName(back).unionByName(taken).unionByName(adjacent(fresh.where("n > 0"), "n", "newcomer"))


def weekly(sessions: DataFrame) -> DataFrame:
    """Per learner and Monday week: xp, sessions, accuracy, minutes (floored per session), active days, xp a day."""
    week = F.date_trunc("week", "date").cast("date")
    rows = sessions.withColumn("week_start", week).withColumn("day", F.datediff("date", week))
    days = [F.coalesce(F.sum(F.when(F.col("day") == k, F.col("xp_earned"))), F.lit(0)).alias(f"xp_{k}") for k in range(7)]
    return rows.groupBy("user_id", "week_start").agg(F.sum("xp_earned").alias("xp"), F.count("*").alias("sessions"), F.round(percent(F.sum("score"), F.sum("total_questions")), 4).alias("accuracy"), F.sum(F.floor(F.col("time_spent_seconds") / 60)).alias("minutes"), F.count_distinct("date").alias("active_days"), *days)


def duels(pairs: DataFrame, weeks: DataFrame, week_start: str) -> DataFrame:
    """Both sides' xp of the week, outcome and reward: 150 for winning, 50 for a tie each, else 0."""
    xp = weeks.where(F.col("week_start") == F.lit(week_start).cast("date")).select("user_id", "xp")
    mine = pairs.where("rival_user_id IS NOT NULL").join(xp.withColumnRenamed("xp", "my_xp"), "user_id", "left")
    both = mine.join(xp.select(F.col("user_id").alias("rival_user_id"), F.col("xp").alias("rival_xp")), "rival_user_id", "left").fillna(0, ["my_xp", "rival_xp"])
    outcome = F.when(F.col("my_xp") > F.col("rival_xp"), "won").when(F.col("my_xp") < F.col("rival_xp"), "lost").otherwise("tied")
    return both.select("user_id", "rival_user_id", "my_xp", "rival_xp", outcome.alias("outcome"), F.when(outcome == "won", 150).when(outcome == "tied", 50).otherwise(0).alias("reward"))


def missions(sessions: DataFrame, as_of: str) -> DataFrame:
    """Today's xp, the daily pace of two weeks, the weakest topic and the xp target of 30 to 150."""
    day = F.lit(as_of).cast("date")
    pace = F.coalesce(F.sum(F.when((F.col("date") >= F.date_sub(day, 14)) & (F.col("date") < day), F.col("xp_earned"))), F.lit(0)) / 14
    by = sessions.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("date") == day, F.col("xp_earned"))), F.lit(0)).alias("today_xp"), pace.alias("pace"))
    topic = sessions.groupBy("user_id", "topic").agg(percent(F.sum("score"), F.sum("total_questions")).alias("acc"), F.count("*").alias("n"))
    weakest = topic.groupBy("user_id").agg(F.min_by("topic", F.struct(F.col("acc"), -F.col("n"), F.col("topic"))).alias("weakest_topic"))
    target = F.greatest(F.lit(30), F.least(F.lit(150), (F.round(F.col("pace") * 1.2 / 10 + 1e-9) * 10).cast("int")))
    return by.join(weakest, "user_id").select("user_id", "today_xp", F.round("pace", 4).alias("pace"), "weakest_topic", target.alias("target_xp"))


def challenge(sessions: DataFrame, pairs: DataFrame, week_start: str) -> DataFrame:
    """The weekly challenge of each paired learner: own week, rival's week, outcome, level."""
    weeks = weekly(sessions)
    duel = duels(pairs, weeks, week_start)
    own = weeks.where(F.col("week_start") == F.lit(week_start).cast("date")).select("user_id", "sessions", "accuracy", "active_days")
    total = sessions.groupBy("user_id").agg(F.sum("xp_earned").alias("total_xp"))
    return duel.join(own, "user_id", "left").join(total, "user_id", "left").fillna(0, ["sessions", "accuracy", "active_days", "total_xp"]).withColumn("level", F.floor(F.col("total_xp") / 100) + 1)


def pulse(progress: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """Global counts, and sessions of the last seven days."""
    week = sessions.where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 7)).groupBy().agg(F.count("*").alias("week_sessions"))
    return progress.groupBy().agg(F.count("*").alias("learners"), F.sum("total_tests").alias("tests"), F.sum("xp").alias("xp"), F.max("streak").alias("best_streak")).crossJoin(week)


def students(progress: DataFrame, profiles: DataFrame, n: int = 50) -> DataFrame:
    """Learners by last activity (none counts as 1970), then xp, with profile."""
    rows = progress.join(profiles, "user_id", "left").select("user_id", "display_name", "last_active_date", "xp")
    return rows.orderBy(F.coalesce("last_active_date", F.lit("1970-01-01").cast("date")).desc(), F.desc("xp"), "user_id").limit(n)


def student_lookup(progress: DataFrame, sessions: DataFrame, topics: DataFrame) -> DataFrame:
    """Per learner: the latest session's topic, the last five scores, and the number of weak topics."""
    five = latest(sessions, ["user_id"], [F.desc("completed_at"), F.desc("id")], 5)
    recent = five.groupBy("user_id").agg(F.max_by("topic", F.struct("completed_at", "id")).alias("last_topic"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "score"))), lambda x: x["score"].cast("string")), ",").alias("last_scores"))
    weak = topics.where("weak").groupBy("user_id").agg(F.count("*").alias("weak_topics"))
    return progress.select("user_id", "xp").join(recent, "user_id", "left").join(weak, "user_id", "left").fillna(0, ["weak_topics"])
