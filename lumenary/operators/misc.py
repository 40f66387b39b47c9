"""Audits, nested traces, answer quality, questions and unit derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.operators.sessions import latest

TURN = "struct<turn:long,calls:array<struct<provider:string,status:string,latency:int>>,tools:array<struct<name:string,ok:boolean>>>"


def audit_rows(actions: DataFrame, n: int) -> DataFrame:
    """Actions with clipped fields and lower-case e-mail, the latest n."""
    # The most characters of each field.
    most = {"email": 120, "action": 80, "target": 220, "method": 40, "detail": 500}
    clip = lambda c: F.substring(F.lower(c) if c == "email" else F.col(c), 1, most[c]).alias(c)
    rows = actions.select("id", "created_at", *(clip(c) for c in most))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def exploded_turns(raw: DataFrame) -> DataFrame:
    """One JSON turn as fact rows: the turn, each model call (route if skipped) and each tool."""
    t = raw.select(F.from_json("payload", TURN).alias("t"))
    turn = t.select("t.turn", F.lit("turn").alias("kind"), F.lit(None).cast("string").alias("name"), F.aggregate("t.calls", F.lit(0), lambda s, c: s + c["latency"]).alias("latency"))
    calls = t.select("t.turn", F.explode("t.calls").alias("c")).select("turn", F.when(F.col("c.status") == "skipped", "route").otherwise("model").alias("kind"), F.col("c.provider").alias("name"), F.col("c.latency").alias("latency"))
    tools = t.select("t.turn", F.explode("t.tools").alias("x")).select("turn", F.lit("tool").alias("kind"), F.col("x.name").alias("name"), F.lit(None).cast("int").alias("latency"))
    return turn.unionByName(calls).unionByName(tools)


def jsonl(lines: DataFrame, schema: str, defaults: dict[str, str], allowed: dict[str, list[str]]) -> DataFrame:
    """Objects of JSON lines; blank, comment and broken lines go, defaults fill, unknown words fall back."""
    good = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    # a JSON null or list gives a null struct; a broken line has its text in _corrupt
    parsed = good.select(F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("x")).where("x IS NOT NULL AND x._corrupt IS NULL").select("x.*").drop("_corrupt")
    for c, d in defaults.items():
        v = F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
        parsed = parsed.withColumn(c, F.when(v.isin(*allowed[c]), v).otherwise(d) if c in allowed else v)
    return parsed


def replace_children(new: DataFrame, folder: str, parent: str, commit: str, parents: DataFrame | None = None) -> DataFrame:
    """The table in folder after the children of every parent in new (or in parents) are replaced by those of new.

    The rows are staged first; a dynamic partition overwrite then replaces the parents' partitions and no
    others, partitions of parents without new rows go, and a marker ends the commit. A commit that has its
    marker does nothing; one that was lost half-way is run again from its staged rows.
    """
    spark = new.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    table, staged, marker = (f"{folder}/{x}" for x in ("table", f"staged/{commit}", f"commits/{commit}"))
    if not files.exists(path(f"{marker}/_SUCCESS")):
        if not files.exists(path(f"{staged}/_SUCCESS")):
            new.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(new.schema).parquet(staged)
        rows.repartition(parent).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(table)
        if parents is not None:
            gone = parents.select(parent).distinct().join(rows.select(parent), parent, "left_anti")
            for r in gone.toLocalIterator():
                files.delete(path(f"{table}/{parent}={spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(r[0]))}"), True)
        rows.groupBy(parent).agg(F.count("*").alias("children")).write.mode("overwrite").parquet(marker)
        files.delete(path(staged), True)
    return spark.read.schema(new.schema).parquet(table)


def derived_units(concepts: DataFrame) -> DataFrame:
    """Chapters of grouped concepts as units: importance and difficulty bands, minutes, a chain of prerequisites."""
    by = concepts.groupBy("chapter", "unit").agg(F.count("*").alias("n"), F.max("importance").alias("imp"), F.avg("difficulty").alias("diff"))
    low = F.least(F.lit(30), 10 + 5 * F.least("n", F.lit(4)))
    band = F.when(F.col("imp") >= 4, "very_high").when(F.col("imp") == 3, "high").when(F.col("imp") == 2, "moderate").otherwise("low")
    hard = F.when(F.col("diff") >= 3.5, "challenging").when(F.col("diff") >= 2.25, "steady").otherwise("foundation")
    high = F.least(F.lit(60), low + F.when(F.col("diff") >= 3.5, 10).otherwise(5))
    before = F.lag("unit").over(Window.partitionBy("chapter").orderBy("unit"))
    return by.select("chapter", "unit", band.alias("importance"), hard.alias("difficulty"), low.cast("int").alias("min_minutes"), high.cast("int").alias("max_minutes"), before.alias("prerequisite"))


def focus_signals(concepts: DataFrame) -> DataFrame:
    """Per unit: largest importance, mean difficulty, and the area difficulty weighted by concepts."""
    return concepts.groupBy("unit").agg(F.max("importance").alias("importance"), F.round(F.avg("difficulty"), 4).alias("difficulty"), F.count("*").alias("concepts"), F.round(F.sum(F.col("difficulty") * F.col("importance")) / F.sum("importance"), 4).alias("weighted"))


def growth(turns: DataFrame, most: int = 5) -> DataFrame:
    """Quality less deductions, the readiness band, and what to improve: at most five things, or that nothing is."""
    named = (("clarity", F.col("quality") < 0.72, 0.08), ("sources", F.col("grounded") == 0, 0.12), ("repair", F.col("repaired"), 0.08), ("model_fallback", F.col("model_errors") > 0, 0.04), ("tool_failures", F.col("tool_errors") > 0, 0.04), ("simplify", F.col("support_style") == "simplify_and_check", 0.0))
    score = F.col("quality")
    for _, on, less in named:
        score = score - F.when(on, less).otherwise(0)
    s = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))), 3)
    things = F.array_compact(F.array(*(F.when(on, F.lit(n)) for n, on, _ in named)))
    advice = F.when(F.size(things) == 0, F.array(F.lit("baseline"))).otherwise(F.slice(things, 1, most))
    return turns.select("id", s.alias("growth"), F.when(s >= 0.85, "excellent").when(s >= 0.72, "stable").when(s >= 0.55, "watch").otherwise("repair").alias("readiness"), F.array_join(advice, ",").alias("recommendations"))


def parsed_mcqs(texts: DataFrame, id_: str) -> DataFrame:
    """(id_, no, question, options, correct, explanation) of running text (id_, text) with Q1. ... A. ... D. ... Answer: X Explanation: ...

    A question without four options that differ, an answer's letter or an explanation goes.
    """
    q = texts.select(id_, F.explode(F.split("text", r"(?=\bQ\d+[.)]\s)")).alias("t")).where(F.col("t").rlike(r"^Q\d+[.)]\s"))
    t = X.squeezed(F.col("t"))
    form = r"^Q(\d+)[.)] (.*?) A[.)] (.*?) B[.)] (.*?) C[.)] (.*?) D[.)] (.*?) Answer: ?\(?([A-Da-d])\b.*? Explanation: (.+)$"
    part = lambda k: F.trim(F.regexp_extract(t, form, k))
    rows = q.select(id_, part(1).alias("no"), part(2).alias("question"), F.array(*(part(k) for k in range(3, 7))).alias("options"), F.upper(part(7)).alias("correct"), part(8).alias("explanation"))
    return rows.where((F.col("no") != "") & (F.col("question") != "") & valid_options(F.col("options"))).withColumn("no", F.col("no").cast("int"))


def valid_options(options: Column) -> Column:
    """Four option texts that aren't empty or alike, letters in front and case aside."""
    texts = F.transform(options, lambda o: F.lower(F.trim(F.regexp_replace(F.regexp_replace(o, r"^(?i)[A-D][.)]\s*", ""), r"\s+", " "))))
    return (F.size(options) == 4) & (F.size(F.array_distinct(texts)) == 4) & ~F.exists(texts, lambda t: (t == "") | (t == "option unavailable"))


# How lines begin that state nothing.
NO_FACT = ("why ", "how ", "what ", "which ", "when ", "where ", "who ", "meaning ", "source:", "section content:", "common mistakes:", "key points:", "examples:", "formulas:")


# The patterns of marks and heads that a fact loses, and of what is none.
def clean_fact(c: Column) -> Column:
    """A line without list marks, bold heads and the words definition or explanation in front."""
    t = F.regexp_replace(X.squeezed(c), r"^[#>\-\d\.\)\s]+", "")
    t = F.regexp_replace(F.trim(t), r"^\*\*([^*]+):?\*\*\s*:?\s*", "$1: ")
    return F.regexp_replace(F.regexp_replace(t, "^(?i)(definition|explanation):\\s*", ""), "^[ -]+|[ -]+$", "")


def is_fact(t: Column) -> Column:
    """18 to 260 characters and five words or more that neither ask nor head anything."""
    words, low = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0))), F.lower(t)
    heads = F.lit(False)
    for x in NO_FACT:
        heads = heads | low.startswith(x)
    return F.length(t).between(18, 260) & (words >= 5) & ~t.rlike("[?:]$") & ~t.rlike("^['\"]") & ~t.rlike(r"^[A-Z]\.\s+") & ~heads & ~(F.concat(F.lit(" "), low, F.lit(" ")).contains(" meaning ") & (words < 8))


def grounded_facts(docs: DataFrame, most: int = 18, enough: int = 8) -> DataFrame:
    """(doc_id, facts, text): each text's distinct facts in order, of lines; of sentences too where lines give fewer than enough."""
    parts = lambda phase, pattern: docs.select("doc_id", F.lit(phase).alias("phase"), F.posexplode(F.transform(F.split("text", pattern), clean_fact)).alias("no", "fact"))
    # lines are clean before they are rows: a filter on a cleaned column would clean a line anew for each of its conditions
    rows = parts(0, r"[\r\n]+").unionByName(parts(1, r"(?<=[.!?])\s+")).where(is_fact(F.col("fact")))
    once = rows.groupBy("doc_id", F.lower("fact").alias("k")).agg(F.min(F.struct("phase", "no", "fact")).alias("x")).select("doc_id", "x.*")
    lines = once.groupBy("doc_id").agg(F.count_if(F.col("phase") == 0).alias("n"))
    kept = latest(once.join(lines, "doc_id").where((F.col("phase") == 0) | (F.col("n") < enough)), ["doc_id"], [F.asc("phase"), F.asc("no")], most)
    return kept.groupBy("doc_id").agg(F.count("*").alias("facts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "fact"))), lambda x: x["fact"]), "|").alias("text"))


def evaluation(predicted: DataFrame) -> DataFrame:
    """Pass rate of labelled routing, and the shares of turns that are grounded and that call a tool."""
    return predicted.groupBy("expected").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("predicted") == F.col("expected")).cast("int")), 6).alias("pass_rate"), F.round(F.avg("grounded"), 6).alias("grounded_rate"), F.round(F.avg(F.col("tool").cast("int")), 6).alias("tool_rate"))


def exposure(events: DataFrame, aliases: DataFrame, tasks: int | None = None) -> DataFrame:
    """Learning events of each learner and unit through the unit's names; tasks: how many the events are dealt to, if not the session's number."""
    named = events.select("user_id", X.normal_key(F.col("topic")).alias("alias"))
    return (named.repartition(tasks, "alias") if tasks else named).join(aliases, "alias").groupBy("user_id", "unit_id").agg(F.count("*").alias("events"))


def daily_signals(sessions: DataFrame, most: int = 5) -> DataFrame:
    """Each day's accuracy and focus in exams (all time's where there was none), xp, risk, weak and strong topics and what to do."""
    exam = F.col("session_type") == "exam"
    mean = lambda c, name, on=None: F.round(F.avg(F.col(c) if on is None else F.when(on, F.col(c))), 4).alias(name)
    day = sessions.groupBy("user_id", "date").agg(mean("accuracy_rate", "day_accuracy", exam), mean("focus_score", "day_focus", exam), F.sum("xp_earned").alias("xp"))
    life = sessions.groupBy("user_id").agg(mean("accuracy_rate", "lifetime"), mean("focus_score", "lifetime_focus"))
    topics = sessions.groupBy("user_id", "topic").agg(F.avg("accuracy_rate").alias("a")).withColumn("k", F.round("a", 6))
    picked = lambda order, on: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(on, F.struct(order.alias("o"), F.col("topic").alias("t"))))), 1, most), lambda x: x["t"]), ",")
    known = topics.groupBy("user_id").agg(picked(F.col("k"), F.col("a") < 60).alias("weak"), picked(-F.col("k"), F.col("a") >= 60).alias("strong"))
    rows = day.join(life, "user_id").join(known, "user_id").select("user_id", "date", F.coalesce("day_accuracy", "lifetime").alias("accuracy"), F.coalesce("day_focus", "lifetime_focus").alias("focus"), "xp", "lifetime", "weak", "strong")
    risk = F.when(F.col("accuracy") < 45, "high").when(F.col("accuracy") < 65, "medium").otherwise("low")
    return rows.withColumns({"risk": risk, "recommendation": F.when(F.col("accuracy") < 45, "review basics").when(F.col("weak") != "", "practise weak topics").otherwise("raise difficulty")})


def proficiency(status: DataFrame) -> DataFrame:
    """What a learner's weighted accuracy shows: confident from 85, basics from 70."""
    acc = F.sum(F.col("accuracy") * F.col("attempts")) / F.nullif(F.sum("attempts"), F.lit(0))
    by = status.groupBy("user_id").agg(acc.alias("acc"))
    return by.select("user_id", F.round("acc", 4).alias("accuracy"), F.when(F.col("acc") >= 85, "confident").when(F.col("acc") >= 70, "know_the_basics").otherwise("new_to_it").alias("proficiency"))
