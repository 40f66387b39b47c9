"""What a learner's evidence says of units, and where to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.operators.sessions import latest
from lumenary.runtime import dealt

# What a next unit's state, importance and relevance to exams add to its chapter's score.
STATUS_SCORES = {"needs_review": 500, "practising": 420, "learning": 380, "recommended": 300, "not_started": 280, "mastered": 80}
IMPORTANCE_SCORES = {"very_high": 60, "high": 45, "moderate": 25, "low": 10}
EXAM_SCORES = {"very_high": 45, "high": 30, "moderate": 15, "low": 5}
# What active and mastered units of a chapter add, at most.
ACTIVE, DONE, CONTINUITY = 24, 8, 80
# Kinds of sessions that show recall and practice.
RECALL = ("recall", "revision", "quick_revision")
PRACTICE = ("practice", "exam", "mcq", "assessment", "question_paper", "written_practice")


def table(values: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)


def unit_states(units: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """(user_id, unit_id, status) of every unit with evidence or a stored state.

    units: (unit_id, required). evidence: (user_id, unit_id, canonical, attempts, accuracy, kind,
    confidence, seen): canonical if it was recorded under the unit's own name, which alone can
    show mastery. stored: (user_id, unit_id, status, evidence_count, mastery_score). In order: a
    poor latest result asks for review; enough good attempts of two kinds of evidence are
    mastery; a poor mean asks for review; mastery that was stored stays; else it is practice.
    """
    own, tries = F.col("canonical") & (F.col("attempts") > 0), F.greatest(F.lit(1), "attempts")
    share = lambda x, w: F.sum(x * w) / F.sum(w)
    kind = F.lower("kind")
    by = evidence.groupBy("user_id", "unit_id").agg(
        share(F.col("accuracy"), tries).alias("mean"), F.sum(F.when(own, F.col("attempts"))).alias("own_attempts"), share(F.when(own, F.col("accuracy")), F.when(own, F.col("attempts"))).alias("own_mean"),
        F.max_by(F.when(own, F.col("accuracy")), F.when(own, F.struct("seen", "accuracy"))).alias("last"), F.max(F.col("canonical") & kind.isin(*RECALL)).alias("recall"), F.max(F.col("canonical") & kind.isin(*PRACTICE)).alias("practice"),
        F.avg(F.when(F.col("canonical"), F.col("confidence"))).alias("sure"),
    )
    rows = by.join(stored, ["user_id", "unit_id"], "full_outer").join(units.select("unit_id", "required"), "unit_id")
    seen = F.coalesce("evidence_count", F.lit(0))
    before = F.when(F.col("status") != "mastered", F.col("status")).when((seen >= F.col("required")) & (F.col("mastery_score") >= 80), "mastered").when(seen > 0, "practising").when(F.col("status") == "mastered", "learning").otherwise("not_started")
    kinds = 1 + (seen > 0).cast("int") + F.coalesce("recall", F.lit(False)).cast("int") + F.coalesce("practice", F.lit(False)).cast("int") + F.coalesce(F.col("sure") >= 70, F.lit(False)).cast("int")
    solid = (F.coalesce("own_attempts", F.lit(0)) >= F.col("required")) & (F.col("own_mean") >= 80) & (kinds >= 2)
    now = F.when(F.col("mean").isNull(), before).when(F.col("last") < 60, "needs_review").when(solid, "mastered").when(F.col("mean") < 60, "needs_review").when(before == "mastered", "mastered").otherwise("practising")
    return rows.select("user_id", "unit_id", now.alias("status"))


def next_chapters(units: DataFrame, following: DataFrame, status: DataFrame, tasks: int | None = None) -> DataFrame:
    """(user_id, chapter, unit_id, score): each learner's best chapter to go on with; ties go to the first by name.

    units: (unit_id, importance, exam_relevance). following: (user_id, chapter, next_unit), one of a chapter. status:
    (user_id, unit_id, chapter, status). tasks: how many the rows are dealt to, if not the session's number.
    """
    rated = dealt(following.select("user_id", "chapter", F.col("next_unit").alias("unit_id"), F.lit(True).alias("following")), tasks, "unit_id").join(units.select("unit_id", "importance", "exam_relevance"), "unit_id")
    rows = dealt(status.select("user_id", "chapter", "unit_id", "status").unionByName(rated, allowMissingColumns=True), tasks, "user_id")
    rows = rows.withColumn("now", F.max("status").over(Window.partitionBy("user_id", "unit_id")))  # a unit has one status
    chosen = F.max(F.when(F.col("following"), F.struct("unit_id", "now", "importance", "exam_relevance")))
    by = rows.groupBy("user_id", "chapter").agg(F.count_if(F.col("status").isin("learning", "practising")).alias("active"), F.count_if(F.col("status") == "mastered").alias("done"), chosen.alias("x")).where("x IS NOT NULL")
    flow = F.least(F.lit(CONTINUITY), F.col("active") * ACTIVE + F.col("done") * DONE)
    score = table(STATUS_SCORES, F.coalesce("x.now", F.lit("not_started"))) + flow + table(IMPORTANCE_SCORES, F.col("x.importance")) + table(EXAM_SCORES, F.col("x.exam_relevance"))
    scored = by.select("user_id", "chapter", "x.unit_id", score.cast("long").alias("score"))
    return latest(scored, ["user_id"], [F.desc("score"), F.asc("chapter")], 1).select("user_id", "chapter", "unit_id", "score")


def concept_memory(signals: DataFrame) -> DataFrame:
    """Running memory of each (user_id, topic) over its signals (needs_support, confidence, seen, id) in order.

    The mean is rounded to one place at each step, so it is a fold over a learner's signals of one topic.
    """
    rows = signals.groupBy("user_id", "topic").agg(F.count("*").alias("observations"), F.count_if("needs_support").alias("support_count"), F.array_sort(F.collect_list(F.struct("seen", "id", F.col("confidence").cast("double").alias("confidence"), "needs_support"))).alias("xs"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"))

    def put(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        prior = F.when(acc["mean"] == 0, x["confidence"]).otherwise(acc["mean"])
        return F.struct(n.alias("n"), (F.floor((prior * (n - 1) + x["confidence"]) / n * 10 + 0.5) / 10).alias("mean"))

    mean, last = F.aggregate("xs", start, put, lambda a: a["mean"]), F.element_at("xs", -1)["needs_support"]
    first = F.when(last, 0.68).otherwise(0.56)
    weight = F.when(F.col("observations") == 1, first).otherwise(F.least(F.lit(1.0), 0.55 + F.col("support_count") * 0.08 + F.col("observations") * 0.02))
    return rows.select("user_id", "topic", "observations", "support_count", mean.alias("average_confidence"), F.when(last, "concept_watch").otherwise("concept_learning").alias("memory_type"), F.round(weight, 4).alias("importance"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.35), mean / 100)), 4).alias("confidence"))
