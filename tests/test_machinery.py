"""Rows kept in tasks, banks in blocks, digest trees, staged writes, ledgers and ordered streams, against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.operators import answers, content, exams, mastery, misc, planning, releases, retrieval
from lumenary.plans.registry import QUERIES
from lumenary.streaming import events

DATA = "/root/testdata/sf0.001"


def test_best_rows_are_the_same_in_any_cuts():
    rng, best, every = random.Random(1), retrieval.Best(3, 4), []
    import numpy as np

    for k in range(300):
        q = np.array(sorted(rng.sample(range(3), rng.randrange(1, 4))))
        s = np.array([float(rng.randrange(20)) for _ in q])
        best.put(("chunk", k), q, s, s > 18)
        every += [(int(a), -float(b), ("chunk", k)) for a, b in zip(q, s)]
        if rng.random() < 0.1:
            best.cut()
    query, score, row, _ = best.cut()
    got = [(int(a), -float(b), best.rows[r]) for a, b, r in zip(query, score, row)]
    assert got == [x for q in range(3) for x in sorted(e for e in every if e[0] == q)[:4]]


def test_retrieval_is_brute_force_and_blocks_change_nothing(spark, monkeypatch):
    """Lexical lists with exact topics, and their fusion with vectors, from the definition."""
    terms = lambda text: sorted({w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in X.STOPWORDS})
    key = lambda t: re.sub("[^a-z0-9]+", "_", t.lower()).strip("_")
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    rows = [("chunk", r.doc_id, (r.text or "").lower(), set(terms(r.text or "")), ()) for r in read("documents")]
    for r in read("part"):
        cid = r.p_brand.lower() if r.p_partkey % 11 == 0 else f"c{r.p_partkey}"
        parts = [r.p_name, "" if r.p_partkey % 7 == 0 else r.p_type, "" if r.p_partkey % 3 == 0 else r.p_name, "" if r.p_partkey % 2 == 1 else r.p_type]
        rows.append(("concept", r.p_partkey, "\n".join(parts).lower(), set(), (key(cid), key(r.p_name))))
    vectors = {r.vec_id: (r.label % 2, r.embedding) for r in read("embeddings")}
    chunks = {i for k, i, *_ in rows if k == "chunk"}
    lexical, hybrid = {}, {}
    for q in read("benchmark"):
        topic = {0: f"C{q.item_id}", 1: "Old plate"}.get(q.item_id % 4)
        own = terms(f"{topic or ''} {q.text}")
        found = []
        for kind, i, low, words, keys in rows:
            n = 2 * len(words & set(own)) + sum(low.count(t) for t in own)
            exact = topic is not None and key(topic) in keys
            if n or exact:
                found.append((-(n + 3 * (kind == "concept") + 1000 * exact), kind, i, exact))
        lists = [[(k, i, e) for _, k, i, e in sorted(found)[:100]], []]
        lexical[q.item_id] = [(k, i, -s, e) for s, k, i, e in sorted(found)[:100]]
        if q.item_id in vectors:
            model, v = vectors[q.item_id]
            near = [(-sum(a * b for a, b in zip(v, e)), i) for i, (m, e) in vectors.items() if m == model and i in chunks]
            lists[1] = [("chunk", i, False) for s, i in sorted(near)[:100] if s <= -0.25]
        sums, exact = defaultdict(float), defaultdict(bool)
        for one in lists:
            for rank, (k, i, e) in enumerate(one, 1):
                sums[k, i] += 1 / (60 + rank)
                exact[k, i] |= e
        hybrid[q.item_id] = sorted(sums, key=lambda x: (not exact[x], -round(sums[x], 8), x))

    def check():
        got = defaultdict(list)
        for r in QUERIES["I5"](spark, DATA).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.kind, r.id, r.lexical, r.exact))
        assert got == {k: v for k, v in lexical.items() if v}

    check()
    got = defaultdict(list)
    for r in QUERIES["I7"](spark, DATA).orderBy("query_id", "position").collect():
        got[r.query_id].append((r.kind, r.id))
    assert got == {k: v for k, v in hybrid.items() if v}
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 900)
    assert len(retrieval.term_blocks(spark.read.parquet(f"{DATA}/benchmark.parquet").selectExpr("item_id as query_id", "text as query", "cast(null as string) as topic"))) > 3
    check()


def test_a_bank_in_blocks_gives_what_one_block_does(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bank = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "", "short one", "short one"])], "bank_id long, text string")
    asked = spark.createDataFrame([(f"m{k}", t[:60]) for k, t in enumerate(texts[:25])] + [("none", None), ("same", "Short  one!")], "message_id string, text string")
    best = lambda: sorted(map(tuple, answers.bank_matches(asked, bank, 3).collect()))
    want = best()
    monkeypatch.setattr(answers, "BANK_BYTES", 700), monkeypatch.setattr(answers, "MESSAGE_BYTES", 500)
    assert best() == want
    n = len(texts)
    assert [x[1:] for x in want if x[0] == "same" and x[3] < 3] == [(n + 2, 1.0, 1), (n + 3, 1.0, 2)] and not [x for x in want if x[0] == "none"]


def release(spark, rows):
    return spark.createDataFrame(rows, "chapter string, layer string, key long, payload string")


def test_trees_tell_every_difference(spark):
    rng = random.Random(4)
    rows = [("big", rng.choice(("chunk", "page")), k, f"text {k % 1700}") for k in range(9000)] + [("small", "chunk", k, "x") for k in range(5)] + [("same", "chunk", 1, None)]
    now = [r for r in rows if r[2] % 997 != 3] + [("big", "chunk", 90_000, "new"), ("fresh", "page", 1, "y")]
    now = [(c, layer, k, p + "!" if c == "big" and k % 1501 == 7 else p) for c, layer, k, p in now]
    rng.shuffle(rows)
    new, old = release(spark, now).repartition(5), release(spark, rows)
    found = releases.items(new)
    assert releases.depths(found).where("chapter = 'big'").head().depth == 3
    assert {tuple(r) for r in releases.manifest(old).collect()} == {tuple(r) for r in releases.manifest(release(spark, sorted(rows, key=str))).collect()}
    before, after = defaultdict(list), defaultdict(list)
    for c, layer, k, p in rows:
        before[c, layer, k].append(p)
    for c, layer, k, p in now:
        after[c, layer, k].append(p)
    want = set()
    for k in {*before, *after}:
        a, b = sorted(map(str, before.get(k, []))), sorted(map(str, after.get(k, [])))
        if a != b:
            want.add((*k, "added" if not a else "removed" if not b else "changed"))
    assert {tuple(r) for r in releases.changes(new, old).collect()} == want and len(want) > 10
    assert releases.changes(new, new).count() == 0
    assert releases.manifest(release(spark, [])).count() == 0


def test_a_release_is_refused_for_each_reason(spark):
    full = [("good", layer, 1, "x") for layer in releases.LAYERS]
    bad = [("a", "chunk", 1, "x"), ("a", "chunk", 1, "y"), ("a", "chunk", 2, " "), ("a", "vector", 1, "v"), ("a", "page", 1, "p"), ("a", "concept", 1, "c")]
    bare = [("b", "page", 1, "p"), ("c", "chunk", 1, None), ("c", "page", 1, "p"), ("c", "concept", 1, "c"), ("c", "vector", 1, "v")]
    rows = release(spark, full + bad + bare)
    got = {r.chapter: r.refusals for r in releases.export(rows).collect()}
    assert got == {"good": "", "a": "duplicate_key=1,empty_chunk=1,no_vector=1", "b": "missing_chunk=1,missing_concept=1,missing_vector=1", "c": "empty_chunk=1"}
    assert {r.chapter for r in releases.export(rows).collect() if r.digest} == {"good"}
    said = releases.manifest(rows).withColumn("items", F.when(F.col("chapter") == "good", 5).otherwise(F.col("items")).cast("long"))
    assert {(r.chapter, r.reason) for r in releases.refusals(rows, said.where("chapter <> 'b'")).where("reason = 'digest_mismatch'").collect()} == {("good", "digest_mismatch"), ("b", "digest_mismatch")}
    live = spark.createDataFrame([("s1", "n1"), ("s2", "n9"), ("s3", "n3"), ("other", "n3"), ("s4x", "n4")], "slug string, identity string")
    new = spark.createDataFrame([(f"s{k}", f"n{k}") for k in range(1, 6)], "slug string, identity string")
    assert {tuple(r) for r in releases.clashes(new, live).collect()} == {("s2", "slug_of_other_chapter"), ("s3", "ambiguous_identity")}


def test_a_lost_commit_is_finished_from_its_stage(spark, tmp_path):
    folder, kind = f"file://{tmp_path}/t", "child long, chapter string"
    misc.replace_children(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c/d"), (4, "e")], kind), folder, "chapter", "one")
    # what was staged counts, not what a second run brings
    spark.createDataFrame([(9, "a b")], kind).write.parquet(f"{folder}/staged/two")
    parents = spark.createDataFrame([("a b",), ("c/d",)], "chapter string")
    rows = misc.replace_children(spark.createDataFrame([(8, "a b")], kind), folder, "chapter", "two", parents)
    assert sorted(map(tuple, rows.collect())) == [(4, "e"), (9, "a b")]
    again = misc.replace_children(spark.createDataFrame([(7, "e")], kind), folder, "chapter", "two")
    assert sorted(map(tuple, again.collect())) == [(4, "e"), (9, "a b")]


def stream_of(spark, tmp_path, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in")


def test_ledger_keeps_each_version_once(spark, tmp_path):
    kind = "event_id long, ts timestamp, body string"
    at = "2024-01-01 00:00:00"
    rows = [(1, "a"), (1, "a"), (2, "b"), (0, "x"), (0, "y"), (None, "z"), (5_000_000, "far")]
    stream = stream_of(spark, tmp_path, [(i, None, b) for i, b in rows], kind).withColumn("ts", F.lit(at).cast("timestamp"))
    folder = f"file://{tmp_path}/ledger"
    first = sorted((str(r.event_id), r.body) for r in events.recorded(stream, folder, "one").collect())
    assert first == sorted([("1", "a"), ("2", "b"), ("0", "x"), ("0", "y"), ("None", "z"), ("5000000", "far")])
    assert events.recorded(stream, folder, "one").count() == 6  # nothing new after its offsets
    later = sorted((str(r.event_id), r.body) for r in events.recorded(stream, folder, "two").collect())
    assert [x for x in later if int(x[0] if x[0] != "None" else 0) > 0] == [x for x in first if x[0] not in ("0", "None")]


def test_limits_in_the_order_of_time(spark, tmp_path):
    """Out of order within the lateness; a denied request doesn't count; seconds to wait are whole, one at least."""
    at = [0, 10, 5, 20, 59.5, 60, 61, 64.9, 200]
    rows = [(k, f"2024-01-01 00:{int(t) // 60:02d}:{t % 60:09.6f}", 1) for k, t in enumerate(at)]
    stream = stream_of(spark, tmp_path, rows, "event_id long, ts string, user long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: (r.allowed, r.retry_after) for r in events.closed(stream, "limits", lambda e: events.limited(e, "user", 3)).where("user = 1").collect()}
    taken, want = [], {}
    for t, k in sorted((t, k) for k, t in enumerate(at)):
        taken = [x for x in taken if x > t - 60]
        want[k] = (True, None) if len(taken) < 3 else (False, max(1, int(60 - (t - taken[0]))))
        if want[k][0]:
            taken.append(t)
    assert got == want and {a for a, _ in want.values()} == {True, False}


def test_ordered_folds_take_stretches(spark, tmp_path, monkeypatch):
    """Many rows of one key never are one list of Python rows, and what waits is kept as bytes."""
    monkeypatch.setattr(events, "STRETCH", 100)
    at = [(k * 7919) % 3000 for k in range(3000)]
    rows = [(k, f"2024-01-01 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}", 1) for k, t in enumerate(at)]
    stream = stream_of(spark, tmp_path, rows, "event_id long, ts string, user long").withColumn("ts", F.col("ts").cast("timestamp"))

    def counted(name, state, rows, until):
        state = [state[0] + 1, state[1] + len(rows)] if state else [1, len(rows)]
        late = [r for r in rows if r[0] > until]
        return state, [(name, rows[-1][1], state[0], state[1], len(rows), len(late))] if rows else [], None

    out = events.closed(stream, "stretches", lambda e: events.in_order(e, "user", [], counted, "user long, event_id long, calls long, sum long, size long, late long"))
    got = out.where("user = 1").orderBy("sum").collect()
    assert max(r["size"] for r in got) == 100 and got[-1]["sum"] == 3000 and not any(r.late for r in got)
    assert [r.event_id for r in got] == [at.index(r["sum"] - 1) for r in got]


def test_agents_lapse_warn_and_fail(spark, tmp_path):
    said = [(1, 0, "start"), (1, 10, "complete"), (1, 20, "start"), (2, 0, "start"), (2, 40, "other"), (3, 0, "error"), (3, 1, "error"), (4, 0, "critical"), (5, 0, "start"), (5, 5, "state"), *((6, k, "error") for k in range(5))]
    rows = [(k, f"2024-01-01 00:{m:02d}:00", a, kind, 100 * m, "paused") for k, (a, m, kind) in enumerate(said)]
    stream = stream_of(spark, tmp_path, rows, "event_id long, ts string, agent long, kind string, latency long, state string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.latest_state(events.closed(stream, "agents", lambda e: events.agent_health(e, "agent")), "agent", "step").where("agent is not null")
    got = {r.agent: (r.status, r.health, r.errors, r.lapses, r.latency_ms) for r in out.collect()}
    assert got == {1: ("idle", "warning", 0, 1, 1000.0), 2: ("idle", "warning", 0, 1, 0.0), 3: ("idle", "warning", 2, 0, 0.0), 4: ("failed", "critical", 1, 0, 0.0), 5: ("paused", "healthy", 0, 0, 0.0), 6: ("idle", "critical", 5, 0, 0.0)}


def test_more_order_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    from lumenary.plans import bindings

    def paper_rows():
        return sorted(map(str, QUERIES["D30"](spark, DATA).collect()))

    want, studied = paper_rows(), sorted(map(str, QUERIES["D35"](spark, DATA).collect()))
    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert bindings.source(spark, DATA, "questions").rdd.getNumPartitions() == -(-lines // 100) > 8
    plan = QUERIES["D30"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and paper_rows() == want
    monkeypatch.setattr(bindings, "TASK_ROWS", 150)
    d35 = QUERIES["D35"](spark, DATA)
    assert d35._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3 and sorted(map(str, d35.collect())) == studied


def test_gaps_are_not_shuffled_by_prerequisite(spark, monkeypatch):
    from lumenary.plans import bindings

    rows = lambda: sorted(map(str, QUERIES["I38"](spark, DATA).collect()))
    want = rows()
    for size in (bindings.TASK_ROWS, 100):
        monkeypatch.setattr(bindings, "TASK_ROWS", size)
        plan = QUERIES["I38"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Generate")] and rows() == want


def test_graded_branches_go_to_what_is_not_mastered(spark):
    """Copies of a receipt, a gap whose first prerequisite is mastered, one with all mastered, one without any, an answer without a choice."""
    said = [(1, 1, 10, 0), (1, 1, 10, 0), (2, 1, 11, 0), (3, 1, 12, 9), (4, 1, 13, 9), (5, 2, 12, None), (6, 2, 10, 0), (7, 2, 10, 1), (8, 2, 10, 0), (9, 3, 10, 5)]
    answers_ = spark.createDataFrame(said, "interaction_id long, user_id long, question_id long, choice int")
    key = spark.createDataFrame([(10, "a", 0), (11, "b", 0), (12, "c", 0), (13, "d", 0)], "question_id long, unit_id string, answer int")
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a"), ("d", "c")], "unit_id string, prereq_id string")
    got = {(r.user_id, r.unit_id): (r.answered, r.correct, r.outcome, r.branch_to) for r in exams.graded_mcqs(answers_, key, edges).collect()}
    assert got == {
        (1, "a"): (1, 1, "mastered", None), (1, "b"): (1, 1, "mastered", None), (1, "c"): (1, 0, "prerequisite_gap", "a"), (1, "d"): (1, 0, "prerequisite_gap", "c"),
        (2, "c"): (1, 0, "prerequisite_gap", "a"), (2, "a"): (3, 2, "practise", None), (3, "a"): (1, 0, "practise", None),
    }


def test_rows_of_more_learners_are_dealt_to_more_tasks(spark, monkeypatch):
    from lumenary.plans import bindings

    rows = lambda name: sorted(map(str, QUERIES[name](spark, DATA).collect()))
    names = ("F9", "E12", "C13", "I34")
    want = {n: rows(n) for n in names}
    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    tasks = bindings.tasks_for(spark.read.parquet(f"{DATA}/lineitem.parquet"))
    for n in names:
        plan = QUERIES[n](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        parts = {int(k) for k in re.findall(r"hashpartitioning\(user_id[^()]*, (\d+)\)", plan)}
        assert parts == {tasks} and tasks > 8 and rows(n) == want[n]


def test_pairs_of_a_name_are_whole_and_come_in_short_runs(spark):
    topics = spark.range(52).select(F.col("id").alias("row"), F.when(F.col("id") == 0, "Rare").when(F.col("id") != 1, "A Name").alias("topic"))
    aliases = spark.range(400).select(F.lit("a_name").alias("alias"), F.concat(F.lit("u"), "id").alias("unit_id")).unionAll(spark.createDataFrame([("rare", "u1")], "alias string, unit_id string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with names too many to be sent to all tasks
    try:
        got = [tuple(r) for r in planning.matched_units(topics, aliases).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == sorted([(0, "Rare", "u1"), *((k, "A Name", f"u{u}") for k in range(2, 52) for u in range(400))])
    length = longest = 0
    for a, b in zip([None, *(r[0] for r in got)], (r[0] for r in got)):
        length = length + 1 if a == b else 1
        longest = max(longest, length)
    assert longest <= 16


def test_a_learner_goes_on_with_the_first_unmet_prerequisite(spark):
    """A prerequisite may be another chapter's; its status and the chapter's progress count."""
    units = spark.createDataFrame([("a1", "a", 1), ("a2", "a", 2), ("a3", "a", 3), ("b1", "b", 1), ("b2", "b", 2)], "unit_id string, chapter string, unit_order int")
    edges = spark.createDataFrame([("a2", "a1"), ("a2", "b2"), ("a2", "b1"), ("b1", "a3")], "unit_id string, prereq_id string")
    had = [(1, "a1", "mastered"), (1, "a3", "mastered"), (1, "b1", "practising"), (2, "a1", "mastered"), (2, "b1", "mastered"), (2, "b2", "mastered"), (3, "a2", "needs_review")]
    status = spark.createDataFrame(had, "user_id int, unit_id string, status string").join(units, "unit_id")
    timed = units.withColumns({"importance": F.lit("low"), "exam_relevance": F.lit("low")})
    for tasks in (None, 20):
        following = planning.next_units(units, edges, status, tasks)
        got = sorted(tuple(r) for r in following.select("user_id", "chapter", "next_unit", "blocked").collect())
        assert got == [(1, "a", "b1", True), (1, "b", "b1", False), (2, "a", "a2", False), (3, "a", "a1", False)]
        best = sorted(tuple(r) for r in mastery.next_chapters(timed, following, status, tasks).collect())
        # chapter a has two mastered units (16), chapter b one that is active (24)
        assert best == [(1, "b", "b1", 420 + 24 + 15), (2, "a", "a2", 280 + 8 + 15), (3, "a", "a1", 280 + 15)]


def test_halves_keep_all_but_white_space():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randrange(300)))
        parts = content.halves(text, 20)
        assert all(0 < len(p) <= 20 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert content.halves("x" * 50, 20) == ["x" * 12, "x" * 13, "x" * 12, "x" * 13] and content.halves(" ", 5) == []


def test_cipher_prose_is_told_from_capitals(spark):
    cipher = "QZX\\WV PLKJ\\ HGFD TRRW " * 15
    texts = [cipher, cipher.replace("\\", ""), cipher.lower(), "THE LAW OF THE LAND IS THE LAW\\\\\\\\\\\\ " * 9, None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.s for r in df.select("k", X.extraction_sanity(F.col("t")).alias("s")).collect()}
    assert [bool(got[k] and got[k].cipher_like) for k in range(6)] == [True, False, False, False, False, False]
    assert got[0].corrupt and not got[3].corrupt and got[3].needs_review


def test_merged_analyses_fall_back_to_what_papers_repeat(spark):
    kind = "paper_id long, total_questions long, total_marks double, marks map<string,long>, types map<string,long>, difficulties map<string,long>, topics map<string,long>, repeated array<string>, style string, confidence double"
    rows = [(1, 4, 10.0, {"5": 2}, {"mcq": 4}, {}, {"b": 1}, ["Ions", "Acids"], "Mixed", 0.5), (2, 2, 6.0, {"5": 1, "1": 1}, {"mcq": 1, "long": 1}, {"hard": 2}, {"c": 1}, ["ions"], "mixed", None)]
    r = exams.merged_analyses(spark.createDataFrame(rows, kind), []).head()
    assert (r.papers, r.total_questions, r.total_marks, r.confidence, r.style) == (2, 6, 16.0, 0.25, "mixed")
    assert (r.marks, r.types, r.difficulties, r.repeated, r.frequent) == ("1=1,5=3", "long=1,mcq=5", "hard=2", "ions,acids", "b,c")
    rows[1] = (*rows[1][:2], None, *rows[1][3:6], {"a": 2}, *rows[1][7:])
    r = exams.merged_analyses(spark.createDataFrame(rows, kind), []).head()
    assert r.total_marks is None and r.repeated == "a" and r.frequent == "a,b"


def test_fact_questions_ask_of_the_second_fact(spark):
    df = spark.createDataFrame([(1, 2, "first fact here|second fact here"), (2, 1, "only fact"), (3, 0, "")], "doc_id long, facts long, text string")
    got = {(r.doc_id, r.position): (r.question, r.marks) for r in exams.fact_questions(df, F.lit("Ions")).collect()}
    assert len(got) == 10 and got[1, 3] == ("Explain this statement from the selected material: second fact here", 3) and got[2, 3][0].endswith("only fact") and got[1, 5][1] == 5


def test_batches_keep_a_size_that_was_set(spark):
    from lumenary import runtime

    own = spark.newSession()
    own.conf.set(runtime.BATCH, 10_000)
    runtime.ship(own)
    assert own.conf.get(runtime.BATCH) == "10000"


@pytest.mark.parametrize("name", ["A8", "A9_changes"])
def test_digests_are_of_sha256(spark, name):
    if name == "A8":
        one = releases.manifest(release(spark, [("c", "chunk", 1, "x")])).head()
        item = hashlib.sha256("chunk\x1f1\x1fx".encode()).hexdigest()
        assert one.digest == hashlib.sha256(f"{item}:1".encode()).hexdigest() and one["items"] == 1
    else:
        assert QUERIES[name](spark, DATA).where("change = 'changed'").count() > 0


def test_requests_meet_an_alias_of_many_units_once(spark):
    units = spark.range(3000).select(F.lit("same").alias("alias"), F.col("id").cast("string").alias("unit_id"))
    exact = spark.createDataFrame([("same7", "7"), ("only", "9"), ("only", "9")], "alias string, unit_id string")
    asked = spark.createDataFrame([(1, "same7"), (2, "same"), (3, "only"), (4, "none"), (5, None)], "request_id long, alias string")
    df = planning.resolved(asked, exact, units)
    assert {tuple(r) for r in df.collect()} == {(1, "7", 0), (2, None, 1), (3, "9", 0), (4, None, None), (5, None, None)}
    many = planning.resolved(units.select(F.col("unit_id").cast("long").alias("request_id"), "alias"), exact, units)
    rows = []
    todo = [many._jdf.queryExecution().optimizedPlan()]
    while todo:  # a join's inputs: the requests and one row an alias
        node = todo.pop()
        kids = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            rows.append([k.nodeName() for k in kids])
        todo += kids
    assert rows and all("Aggregate" in r for r in rows)


@pytest.mark.parametrize("keys", [[], ["subject"]])
def test_patterns_are_the_merged_analyses_of_papers(spark, keys):
    rng = random.Random(5)
    rows = [(p, p * 7 % 3 if keys else 0, rng.choice([None, 1, 5, 6, 9]) if p % 2 else rng.randrange(1, 9), rng.choice("ABC"), rng.choice(["x", "y", None]), rng.choice(["Heat", "heat", "Optics", None, "Atoms"]), k) for p in range(60) for k in rng.sample(range(100), rng.randrange(1, 9))]
    q = spark.createDataFrame(rows, "paper_id long, subject int, marks int, question_type string, difficulty string, topic string, question_number long")
    papers = exams.paper_analyses(q, ("A",), tuple(keys))
    most = F.array_sort(F.transform(F.map_entries("types"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"))))[0]["key"]
    sure = F.aggregate(F.filter(F.map_entries("marks"), lambda e: e["key"].cast("int") > 5), F.lit(0).cast("long"), lambda a, e: a + e["value"]) / F.col("total_questions")
    want = exams.merged_analyses(papers.withColumns({"style": most, "confidence": sure, "repeated": exams.common(F.col("topics"), 20, 2)}), keys)
    got = exams.paper_patterns(q, keys)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_patterns_read_the_questions_once_and_sum_in_hash_tables(spark):
    for name in ("D31", "D32"):
        df = QUERIES[name](spark, DATA)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Generate explode") == 1 and plan.count("lineitem.parquet") == 1 and "SortAggregate" not in plan


def test_all_chunks_that_share_a_term_come(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "OUT_ROWS", 50)
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("heat "), F.repeat(F.lit("heat "), (F.col("id") % 7).cast("int")))).otherwise("reheats").alias("text"))
    asked = spark.createDataFrame([(1, "Heat"), (2, "heat and work"), (3, "light")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): (r.lexical, r["rank"]) for r in retrieval.lexical_scores(asked, chunks).collect()}
    score = {k: 3 + k % 7 for k in range(400) if k % 4}
    place = {k: i for i, k in enumerate(sorted(score, key=lambda k: (-score[k], k)), 1)}
    assert got == {(q, k): (score[k], place[k]) for q in (1, 2) for k in score}


def test_ratios_of_many_pairs_are_those_of_the_sequence_matcher(monkeypatch):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    rows = ["".join(rng.choice("ab cdefgh"[: rng.choice([2, 4, 9])]) for _ in range(rng.choice([1, 5, 60, 199, 200, 330]))).strip() for _ in range(40)] + ["", "heat"]
    bank = answers.Bank(list(range(len(rows))), rows, frozenset())
    asked = [m for m in (answers.Message(x[::-1] if k % 2 else x[3:] + x[:3], frozenset()) for k, x in enumerate(rows)) if m.text]
    pairs = [(m, r) for m in asked for r in range(len(rows)) if bank.known[r].text]
    want = [SequenceMatcher(None, m.text, bank.known[r].text).ratio() for m, r in pairs]
    assert bank.ratios(pairs).tolist() == want
    monkeypatch.setattr(answers, "CELLS", 1000)
    monkeypatch.setattr(answers, "LONG", 20_000)
    assert bank.ratios(pairs).tolist() == want

    def common(a, b):
        old = [0] * (len(b) + 1)
        for x in a:
            line = [0]
            for k, y in enumerate(b, 1):
                line.append(old[k - 1] + 1 if x == y else max(line[-1], old[k]))
            old = line
        return old[-1]

    for m in asked[:6]:
        assert bank.common(m.text).tolist() == [common(m.text, k.text) for k in bank.known]


def test_rows_with_rare_seeds_are_matched_by_their_seeds(monkeypatch):
    """No cells are searched for rows of 200 characters or more; prefixes count where no seed is shared, and one text inside the other does."""
    rng = random.Random(5)
    rows = ["".join(rng.choice("etaoin shrdlu etaoin etaoin qzx"[: rng.choice([7, 31])]) for _ in range(rng.choice([280, 300, 400]))) for _ in range(30)]
    rows = [answers.Message(r, frozenset()).text for r in rows]
    rows += [rows[0][:199] + "q", "ab" * 130, "qz" + rows[1], rows[2] * 2]
    bank = answers.Bank(list(range(len(rows))), rows, frozenset())
    assert min(map(len, rows)) >= 200
    monkeypatch.setattr(answers, "longest", None)
    asked = [*rows[:6], rows[0][:40], rows[1][5:90], "ab", "q", "abab x", *(r[7:80][::-1] for r in rows[6:20])]
    for text, got in zip(asked, bank.best_of(asked, 4)):
        every = [(-answers.likeness(answers.Message(text, frozenset()), answers.Message(r, frozenset())), k) for k, r in enumerate(rows)]
        assert got == [(-s, k) for s, k in sorted(every)[:4] if s < 0]


def test_lines_are_cleaned_once_each(spark):
    df = misc.grounded_facts(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]
