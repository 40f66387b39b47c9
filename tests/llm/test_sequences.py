"""Periodic runs, pieces and phrases against brute force and the library, on odd and empty rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lumenary.llm import phrases, pieces, queries, repeats

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, runs string, ids string"
BLOCK = " ".join(f"b{k}" for k in range(50))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an id with two texts, clashing columns."""
    texts = [None, "", " \n\t ", "one", "a b", "Hello  World!! it's 3²½ <|endoftext|> <s></s> <0x0A> ﬁ é é 日本語 👍▁\r\n", " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000)), "x" * 3000, BLOCK,
             " ".join([BLOCK] * 3), "start " + " ".join([BLOCK] * 4) + " end", "go " * 20_000, "a b " * 12, "a b " * 11, "of the. of the, of\tthe of"]
    rows = [(k, t, "en", "s", 1, "clash", "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[9], (9, "another text of one id", None, None, None, None, None, None), (None, "a " * 30, "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain_runs(w, least=24, times=3):
    """By the definition: for each period its longest stretches; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i > first and i - first + q >= max(least, times * q):
                found.setdefault((first - q, i - first + q), q)
            i += i == first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets_are_the_definitions():
    rng = random.Random(5)

    def one():
        letters = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            block = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = block * rng.randrange(1, 6) + block[: rng.randrange(len(block))]
        return w

    for least, times in [(24, 3)] * 40 + [(3, 3), (10, 4), (1, 3), (40, 3)] * 10:
        many = [one() for _ in range(8)]
        flat = np.array([x for w in many for x in (*w, -1)], np.int64)
        begin = np.cumsum([0, *(len(w) + 1 for w in many)])
        found = list(zip(*(x.tolist() for x in repeats.openings(flat, least, times))))
        for k, w in enumerate(many):
            own = [(e - int(begin[k]), d, n) for e, d, n in found if begin[k] <= e < begin[k + 1]]
            assert repeats.diagonals(w, own, least, times) == plain_runs(w, least, times)
    with pytest.raises(ValueError):
        repeats.openings(flat, 24, 2)


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_rows(odd, none):
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in repeats.periodic_runs(odd).collect())
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in odd.collect()]
    want = []
    for i, w in rows:
        w = [x.decode() for x in w]
        runs = plain_runs(w) if len(w) < 3000 else ([(0, len(w), 1)] if w[0] == "go" else plain_long(w))
        want.append((str(i), len(w), runs, plain_collapse(w, runs)))
    assert got == sorted(want)
    assert repeats.periodic_runs(none).collect() == []


def plain_long(w):
    """The 40,000 words of the long text repeat after 977 * 31 words, too late for a run."""
    assert w[: 40_000 - 977 * 31] == w[977 * 31 :]
    return []


def test_query_of_runs_is_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    changed = 0
    for r in rows:
        w = [x.decode() for x in (r.text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        runs = plain_runs(w)
        o = got[r.doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (o.n_runs, o.start, o.length, o.period, o.exponent_milli) == ((len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None))
        assert o.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert o.collapsed_sha256 == hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest()
    assert changed > 5


def test_pieces_are_the_librarys(odd, none, docs):
    own = pieces.model("piece_bpe_32k.model")
    for df in (odd, docs, none):
        got = sorted((str(r.doc_id), r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in pieces.decode(pieces.encode(df)).collect())
        ids = [(i, own.library.encode(t or "", add_eos=True)) for i, t in ((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())]
        assert got == sorted((str(i), len(x), x, own.library.decode(x)) for i, x in ids)


def test_pieces_of_random_texts_and_ids():
    own, rng = pieces.model("piece_bpe_32k.model"), random.Random(7)
    letters = "ab e\nth▁in日é👍0 ing　\x00⁇"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["a" * 997, "日本" * 300, "▁" * 70]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == own.library.encode(texts)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3, 32_000), 0, 1, 2, 29_871]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == own.library.decode(ids)


def test_full_stores_change_no_id(monkeypatch):
    own = pieces.PieceModel("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "UNITS", 5), monkeypatch.setattr(pieces, "PAIRS", 20), monkeypatch.setattr(pieces, "LONGEST", 4)
    texts = ["some words that the small stores can't hold", "some other words", "", "some words"]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == own.library.encode(texts)


def test_query_of_pieces_has_decimal_digests(spark, docs):
    own = pieces.model("piece_bpe_32k.model").library
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_piece_prefixes"](spark, DATA).collect()}
    for r in docs.collect():
        ids = own.encode(r.text or "", add_eos=True)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids))) in got


def plain_collocations(rows, least=10, inside=50, first=2000):
    """By the definition, with all counts in memory."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n, found = sum(m for p, m in c.items() if len(p) == 1), []
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((p, a, c[p[:k]], c[p[k:]], s))
        longer = [(q, a) for q, a, *_ in found if len(q) == 3]
        most = Counter()
        for q, a in longer:
            for part in (q[:2], q[1:]):
                most[part] = max(most[part], a)
        found = [x for x in found if len(x[0]) == 3 or not most[x[0]] or 100 * most[x[0]] < inside * x[1]]
        found.sort(key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        out += [(lang, k, " ".join(p), a, left, right, n, s) for k, (p, a, left, right, s) in enumerate(found[:first], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_phrases_are_brute_force_and_the_twins(spark, odd, none, docs, monkeypatch):
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = plain_collocations(rows)
    assert len(want) > 100 and found(docs) == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(duck.execute(phrases.OP13_SQL).fetchall()) == want
    assert found(none) == []
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert found(odd, least=2, first=50) == plain_collocations(rows, 2, 50, 50)
    for name, value in (("PART", 7), ("HELD", 40), ("BATCH", 3), ("SHARE", 30), ("SPLIT_WORD", 3), ("SPLIT_NODE", 2)):
        monkeypatch.setattr(phrases, name, value)
    small = odd.where("length(text) < 4000 or text is null")
    assert found(small, least=2, first=50) == plain_collocations([(r.lang, r.text) for r in small.collect()], 2, 50, 50)


def test_two_words_with_one_key_take_another_seed(spark, monkeypatch):
    own = phrases.key_of
    monkeypatch.setattr(phrases, "key_of", lambda name, seed: len(name) + 1 if seed == 0 else own(name, seed))
    df = spark.createDataFrame([("en", "ab cd. ab cd. cd ab"), (None, "ab cd ab cd")], "lang string, text string")
    assert found(df, least=2) == plain_collocations([("en", "ab cd. ab cd. cd ab"), (None, "ab cd ab cd")], 2)


def test_hot_words_and_nodes_are_split(spark, monkeypatch):
    """A pair in all lines with a new word after it: its edges go to many tasks, and no count changes."""
    rows = [("en", " ".join(f"hot pair n{k}x{j}." for j in range(30))) for k in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    words, nodes = phrases.hot_keys(df, 0)
    assert phrases.key_of(b"en\xffhot", 0) in words and len(nodes) >= 1
    parts = phrases.edges(df, 0, (words, nodes)).where(f"k1 = {phrases.key_of(b'en' + b'\xff' + b'hot', 0)} and k3 <> 0").select("h").distinct().count()
    assert parts > 500
    assert found(df) == plain_collocations(rows)


def test_scores_are_exact_past_64_bits(spark):
    a, left, right = 3_000_000_000_001, 3_100_000_000_007, 3_200_000_000_011
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.score("a", "l", "r")).head()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_flows_are_word_counts(docs):
    """A word's flow and ends are its occurrences, and a language's row has all of them."""
    got = {(r.lang, r.word): r.n for r in phrases.graph(docs.selectExpr("coalesce(lang, 'und') as lang", "text"), 0, 1).where("kind = 1").collect()}
    want = Counter()
    for r in docs.collect():
        want.update((r.lang or "und", w.decode()) for w in phrases.words_of((r.text or "").encode()) if w != b"\xff")
    assert got == dict(want)
