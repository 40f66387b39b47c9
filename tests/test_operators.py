"""Small seeded cases."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.operators import content, exams, planning, ranks, retrieval, sessions, traces
from lumenary.operators.retrieval import fused, packed, vector_matches
from lumenary.plans.registry import QUERIES


def test_nearest_rank_of_four_turns(spark):
    df = spark.createDataFrame([("a", v) for v in (800, 200, 300, 400, 0)], "agent string, ms int")
    row = traces.nearest_rank(df, ["agent"], "ms", {"p50": 0.5, "p95": 0.95}).first()
    assert (row.p50, row.p95) == (300, 800)


def test_revision_skips_unpractised_topics_and_puts_overdue_first(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("u", "old", 10, 5, True, -1.0, day), ("u", "new", 10, 9, False, 0.0, dt.datetime(2024, 1, 30, 12)), ("u", "none", 0, 0, False, 0.0, None), ("u", "undated", 5, 5, False, 0.0, None)]
    topics = spark.createDataFrame(rows, "user_id string, topic string, attempts int, correct int, weak boolean, trend double, last_practiced timestamp")
    scores = sessions.revision_scores(topics, "2024-01-31 00:00:00")
    got = [(r.topic, r.bucket) for r in sessions.revision_queue(scores).orderBy("position").collect()]
    assert got == [("old", "overdue"), ("undated", "overdue"), ("new", "fresh")]


def test_latest_per_topic_keeps_rows_of_a_null_topic(spark):
    rows = [("u", k, None if k == 0 else "t", dt.datetime(2024, 1, 1 + k)) for k in range(12)]
    s = spark.createDataFrame(rows, "user_id string, id long, topic string, completed_at timestamp")
    got = {(r.id, r.evidence) for r in sessions.topic_evidence(s).collect()}
    assert (0, "older") in got and len(got) == 11


def test_odd_learner_meets_the_best_newcomer_and_all_pairs_are_mutual(spark):
    scores = spark.createDataFrame([(k, 100.0 - k) for k in range(1, 6)], "user_id long, seed_score double")
    fresh = spark.createDataFrame([(11, 50), (12, 90), (13, 10)], "user_id long, xp long")
    got = {r.user_id: (r.rival_user_id, r.match_basis) for r in ranks.pairings(scores, fresh).collect()}
    assert got[5] == (12, "fallback") and got[12] == (5, "fallback") and got[1] == (2, "seed") and got[11] == (13, "newcomer")
    assert all(got[b][0] == a for a, (b, _) in got.items() if b is not None)


def test_global_rank_is_dense_and_needs_no_single_task(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("x"))
    got = {r.x: r["rank"] for r in ranks.global_rank(df, [F.desc("x"), F.asc("id")]).collect()}
    assert got == {x: 1000 - x for x in range(1000)}


def test_tie_rewards_both(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "user_id long, rival_user_id long")
    weeks = spark.createDataFrame([(1, dt.date(2024, 1, 22), 40), (2, dt.date(2024, 1, 22), 40)], "user_id long, week_start date, xp long")
    got = {r.user_id: (r.outcome, r.reward) for r in ranks.duels(pairs, weeks, "2024-01-22").collect()}
    assert got == {1: ("tied", 50), 2: ("tied", 50)}


def test_chunks_keep_all_text_and_join_a_short_tail(spark):
    text = " ".join(f"Sentence number {k} is here." for k in range(120)) + "\n\nTail."
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(X.paragraph_chunks(F.col("t")).alias("c")).collect()
    assert "".join(row[0].c).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert len(row[0].c) > 1 and min(map(len, row[0].c)) >= 220 and row[1].c == [] and row[2].c is None
    tail = spark.createDataFrame([("a" * 1390 + "\n\n" + "b" * 30,)], "t string").select(X.paragraph_chunks(F.col("t"))).first()[0]
    assert tail == ["a" * 1390 + "\n\n" + "b" * 30]


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(X.normal_key(F.lit(" A-b  C! ")), X.class_level(F.lit("Grade XI")), X.exam_type(F.lit("Unit")), X.exam_type(F.lit("")), X.difficulty(F.lit("Very hard")), X.next_version(F.lit("v9")), X.marks(F.lit("5 marks")), X.normal_topic(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("a_b_c", "11", "unit_test", "other", 5, "v10", 5.0, "unknown")


def test_registered_sql_functions(spark):
    X.register(spark)
    got = spark.sql("SELECT normal_key('A b'), content_terms('What is an Alkane alkane ion'), unit_cosine(array(1D, 0D), array(1D, 0D)), unit_cosine(array(1D), array(1D, 0D))").first()
    assert tuple(got) == ("a_b", ["alkane", "ion"], 1.0, None)


def test_vectors_of_other_models_do_not_match(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id long, model int, query array<float>")
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 0, [0.1, 0.9]), (4, 0, [1.0])], "vec_id long, model int, embedding array<float>")
    assert [r.vec_id for r in vector_matches(q, v, 5).collect()] == [1]


def test_nearest_vectors_equal_the_sums_in_order(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32).round(1)
    x[300:700] = x[7]  # copies tie: the least ids count
    rows = [(i, i % 2, [float(c) for c in r]) for i, r in enumerate(x)]
    rows += [(900, 0, None), (901, 0, [None, *rows[0][2][1:]]), (902, None, rows[0][2]), (903, 0, [float("nan"), *rows[0][2][1:]]), (904, 1, [])]
    v = spark.createDataFrame(rows, "vec_id long, model int, embedding array<float>").repartition(5)
    q = v.where("vec_id % 3 = 0 and vec_id <> 903").select(F.col("vec_id").alias("query_id"), "model", F.col("embedding").alias("query"))
    pairs = v.join(q, "model").withColumn("s", retrieval.dot(F.col("embedding"), F.col("query"))).where("s >= 0.25")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    want = pairs.select("query_id", "vec_id", F.round("s", 6).alias("s"), rank.alias("r")).cache()
    told = lambda df: sorted(map(str, df.collect()))
    for cells in (retrieval.CELLS, 1000):
        kept, retrieval.CELLS = retrieval.CELLS, cells
        try:
            assert told(vector_matches(q, v, 7).toDF("query_id", "vec_id", "s", "r")) == told(want.where("r <= 7").withColumn("r", F.col("r").cast("long")))
            assert told(vector_matches(q, v, None).toDF("query_id", "vec_id", "s")) == told(want.drop("r"))
        finally:
            retrieval.CELLS = kept
    plan = vector_matches(q, v, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # a join makes a row of every pair


def test_over_10_000_vector_queries_are_all_answered(spark):
    q = spark.range(10_050).select(F.col("id").alias("query_id"), F.lit(0).alias("model"), F.array(F.lit(1.0), F.col("id") % 2).cast("array<float>").alias("query"))
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.5, 0.9])], "vec_id long, model int, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vector_matches(q, v, 5).collect()}
    assert got == {(i, k + 1): (2 - k if i % 2 else k + 1) for i in range(10_050) for k in range(2)}


def test_all_vector_queries_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    want = {}
    for q in (r for r in rows if r.vec_id % 50 == 0):
        scored = [(-sum(x * y for x, y in zip(q.embedding, r.embedding)), r.vec_id) for r in rows if r.label % 2 == q.label % 2]
        want[q.vec_id] = [i for s, i in sorted(scored) if s <= -0.25][:10]
    got = {i: [] for i in want}
    for r in QUERIES["C11_all"](spark, d).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == want and len(want) > 5


def test_all_benchmark_items_are_lexical_queries(spark):
    d = "/root/testdata/sf0.001"
    terms = lambda df, i: {r[0]: set(r[1]) for r in df.select(i, X.terms(F.col("text"))).collect()}
    q, c = terms(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id"), spark.read.parquet(f"{d}/documents.parquet")
    low = {r.doc_id: r.text.lower() for r in c.where("text is not null").collect()}
    docs = terms(c.where("text is not null"), "doc_id")
    want = {}
    for a, x in q.items():
        scored = sorted((-2 * len(x & y) - sum(low[b].count(t) for t in x), b) for b, y in docs.items() if x & y)
        want |= {(a, b, k): -s for k, (s, b) in enumerate(scored[:100], 1)}
    assert {(r.query_id, r.chunk_id, r["rank"]): r.lexical for r in QUERIES["I5_all"](spark, d).collect()} == want


def test_queries_that_ask_the_same_are_answered_once(spark):
    q = spark.createDataFrame([(k, ("alpha beta", "beta alpha", "gamma")[k % 3]) for k in range(300)], "query_id long, query string")
    assert [len(block[0]) for block in retrieval.term_blocks(q.withColumn("topic", F.lit(None).cast("string")))] == [2]
    c = spark.createDataFrame([(f"c{k}", ("alpha", "beta gamma", "none")[k % 3], "alpha", "", None) for k in range(40)], "concept_id string, title string, definition string, explanation string, points string")
    want = {}
    for k in range(300):
        terms = {"alpha", "beta"} if k % 3 < 2 else {"gamma"}
        score = {f"c{j}": sum(7 * (t in ("alpha", "beta gamma", "none")[j % 3]) + 4 * (t in "alpha") for t in terms) for j in range(40)}
        want |= {(k, i): s for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:20] if s}
    assert {(r.query_id, r.concept_id): r.score for r in retrieval.keyword_concepts(q, c, 20).collect()} == want


def test_fusion_and_packing(spark):
    kind = "query_id long, kind string, id long, exact boolean, rank long"
    a = spark.createDataFrame([(1, "chunk", 10, False, 1), (1, "chunk", 11, False, 2), (1, "concept", 7, True, 3)], kind)
    b = spark.createDataFrame([(1, "chunk", 11, 1)], "query_id long, kind string, id long, rank long")
    f = fused(a, b)
    assert [(r.kind, r.id) for r in f.orderBy("position").collect()] == [("concept", 7), ("chunk", 11), ("chunk", 10)]
    sized = f.join(spark.createDataFrame([("chunk", 10, 30), ("chunk", 11, 500), ("concept", 7, 60)], "kind string, id long, n long"), ["kind", "id"])
    assert [(r.id, r.chars) for r in packed(sized, 5, 100).orderBy("position").collect()] == [(7, 60), (10, 30)]
    assert [(r.id, r.chars) for r in packed(sized.where("id <> 7"), 5, 100).orderBy("position").collect()] == [(11, 100)]


def test_closure_is_transitive(spark):
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 20)], "unit_id long, prereq_id long")
    assert planning.closure(edges).count() == 19 * 20 // 2


def test_row_level_plans_have_no_unpartitioned_window(spark):
    df = ranks.seed_rank(spark.range(100).select(F.col("id").alias("user_id"), F.rand(1).alias("seed_score")))
    assert not [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]


def test_paper_batches_stream_a_large_key(spark):
    rows = [("hot", k, k * 37 % 400) for k in range(5000)] + [("cold", 1, 900), ("cold", 2, 1)]
    want, last, total, batch = {}, None, 0, 0
    for doc, page, n in rows:
        if doc != last:
            last, total, batch = doc, 0, 0
        if total > 0 and total + n > 800:
            total, batch = 0, batch + 1
        total += n
        want[doc, page] = batch
    pages = spark.createDataFrame(rows, "source string, page long, n long").withColumn("part", F.lit(0)).repartition(7)
    df = content.paper_batches(pages, "source", 800)
    assert {(r.source, r.page): r.batch for r in df.collect()} == want
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_paper_has_all_four_distributions_whole(spark):
    """More topics than the six most frequent, marks that aren't known for one question."""
    rows = [(1, k, None if k == 9 else k % 3, "N", "easy", f"Topic {k % 8}") for k in range(10)]
    questions = spark.createDataFrame(rows, "paper_id long, question_number long, marks int, question_type string, difficulty string, topic string")
    row = exams.paper_totals(questions, ("N",)).first()
    assert row.marks == "0=3,1=3,2=3" and row.topics == "topic 0=2,topic 1=2,topic 2=1,topic 3=1,topic 4=1,topic 5=1,topic 6=1,topic 7=1"
    assert (row.types, row.difficulties, row.total_marks, row.repeated) == ("N=10", "easy=10", None, "topic 0,topic 1")


def test_success_and_tokens_are_of_all_of_an_agents_traces(spark):
    """Only runs, quality and latency are of a day; an agent whose traces are older is idle."""
    rows = [("a", 1, "success", 0.5, 10), ("a", 30, "failed", 0.4, 30), ("a", 200, "success", 0.9, 50), ("b", 300, "success", 0.7, 5), ("b", -1, "failed", 0.1, 5)]
    t = spark.createDataFrame(rows, "agent string, age int, status string, quality double, latency_ms int").withColumn("created_at", F.expr("TIMESTAMP '2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, age)"))
    t = t.withColumns({"estimated_input_tokens": F.lit(2), "estimated_output_tokens": F.lit(1)})
    got = {r.agent: (r.runs, r.quality, r.quality_delta, r.latency_delta, r.success_rate, r.tokens, r.trend) for r in traces.intelligence(t, "2024-01-31 00:00:00").collect()}
    assert got == {"a": (1, 0.5, 0.1, -20.0, 0.666667, 9, "improving"), "b": (0, None, None, None, 1.0, 3, "idle")}
