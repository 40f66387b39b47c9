"""Toxicity of disguised text: characters are restored by Viterbi decoding, then words are scored."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import add_columns, documents, held_out, map_slices, strings, table
from lumenary.runtime import checkpointed

#: Labelled rows that words are weighed on at most: those of least hash of the id. Features and
#: patterns of features are those of these rows, so the model is bounded by them too.
SAMPLE = 30_000
#: Labelled documents that a word needs at least, and how far it must stand out (in deviations).
LEAST, STANDS_OUT = 3, 4.0
#: What a sign may stand for besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i"}
#: Log-probabilities of the channel: a letter stays; stands as a sign; is repeated; a sign of no
#: letter is put in, one that may be a letter is; a sign parts two words; a wide gap joins a word.
KEEP, SUBSTITUTE, REPEAT, FILLER, SIGN, BREAK, WIDE = -0.05, -1.0, -1.0, -0.5, -2.0, -0.5, -4.0
#: Log-probability of a word of the vocabulary, where the letter model gives it less.
WORD = -5.0
#: Steps after which what all paths of the decoder share is written out.
SETTLE = 64
#: Letters of the language model: a to z, and 0 for all others and the ends of words.
LETTERS = 27
REMEMBERED = 150_000
FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
#: A run of characters that stand alone, so perhaps words spaced out. The hint is a cheap first look.
SPACED_HINT = re.compile(r"(?:^|\s)\S[ .\-_*]+\S[ .\-_*]+\S")
SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*]+[^\W_]|[ .\-_*]+[@$!|+€(¡]){2,}(?!\S)|(?<!\S)[@$!|+€(¡](?:[ .\-_*]+[^\W_]){2,}(?!\S)")
#: A token that may be disguised: signs among letters, a thrice repeated letter, dots between.
DISGUISED = re.compile(r"[a-z][0-9@$!|+€(¡.*_\-]+[a-z]|^[0-9@$!|+€(¡]+[a-z]{2}|[a-z]{2}[0-9@$!|+€(¡]+$|([a-z])\1\1")
#: A letter twice, or a sign anywhere: the token may be a word of the vocabulary if its skeleton is one's.
PERHAPS = re.compile(r"([a-z])\1|[0-9@$!|+€(¡.*_\-]")
#: Letters that a sign may stand for count as one; signs of no letter as none.
CLASSES = {ord("l"): "i", **{ord(c): x[0] for c, x in LEET.items()}, **{ord(c): None for c in ".*_-"}}
#: Signs that may be a sentence's at the end of a token.
LAST = "!|(+¡"
#: Letters of a word that is looked for across gaps, at least.
GAPPED = 4
AGAIN = re.compile(r"(.)\1+")
EDGE = re.compile(r"^[^\w@$!|+€(¡]+|[^\w@$!|+€(¡]+$")
#: Letters of the beginnings of words that are features beside whole words.
STEMS = (5, 7)
#: Features that a task counts before it hands on its counts.
COUNTED = 100_000


def skeleton(word: str) -> str:
    """A folded word without repeats, its signs as letters; the same for a word and its disguises of one token."""
    letters = word.replace("l", "i") if word.isalpha() else word.translate(CLASSES)
    return AGAIN.sub(r"\1", letters)


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each run of three letters occurs in all texts: an array of LETTERS cubed.

    Tasks hand on at most that many sums, and so does the final aggregate to the driver.
    """

    def start():
        number = np.zeros(256, np.int64)
        for k in range(26):
            number[97 + k] = number[65 + k] = k + 1
        total = np.zeros(LETTERS**3, np.int64)

        def step(part):
            raw = " ".join(t.translate(FOLD) for t in strings(part)).encode()
            code = number[np.frombuffer(b"  " + raw + b"  ", np.uint8)]
            np.add(total, np.bincount(code[:-2] * LETTERS**2 + code[1:-1] * LETTERS + code[2:], minlength=LETTERS**3), out=total)

        step.rest = lambda: [np.flatnonzero(total), total[total > 0]]
        return step

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    got = map_slices(rows, start, "run int, n long").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS**3)
    out[got["run"].to_numpy()] = got["n"].to_numpy()
    return out.reshape((LETTERS,) * 3)


class Restorer:
    """The likeliest plain words behind disguised ones: a noisy channel over a letter model."""

    def __init__(self, counts: np.ndarray, words: set[str]):
        two = counts.sum(axis=2, keepdims=True)
        one = counts.sum(axis=(0, 1))
        back = (one + 1) / (one.sum() + LETTERS)
        self.log = np.log((counts + 20 * back) / (two + 20)).tolist()
        self.memo: dict[str, tuple[str, ...]] = {}
        self.vocabulary, self.skeletons = words, {skeleton(w) for w in words}
        #: Beginnings of the words that are looked for across gaps.
        self.begun = {w[:k] for w in words if len(w) >= GAPPED for k in range(1, len(w))}
        # the vocabulary as a tree: of each node its children by letter, and whether a word ends
        self.next: list[dict[int, int]] = [{}]
        self.ends = [False]
        for w in sorted(words):
            node = 0
            for c in w:
                node = self.next[node].setdefault(ord(c) - 96, len(self.next))
                if node == len(self.next):
                    self.next.append({}), self.ends.append(False)
            self.ends[node] = True

    @staticmethod
    def arcs(c: str, k: int) -> list[tuple[str, float]]:
        """What k equal characters c may have been, with log-probabilities; a space parts words."""
        if "a" <= c <= "z":
            most = min(k, 3) if k < 4 else 2
            return [(c * j, j * KEEP + (most - j) * REPEAT) for j in range(most, 0, -1)]
        if c == " ":
            return [(" ", BREAK), ("", FILLER)] if k == 1 else [(" ", 0.0), ("", WIDE)]
        if c in LEET:
            return [(x * j, j * SUBSTITUTE + (min(k, 2) - j) * REPEAT) for x in LEET[c] for j in range(min(k, 2), 0, -1)] + [(" ", BREAK), ("", SIGN)]
        return [(c, KEEP)] if c.isalpha() else [(" ", BREAK), ("", FILLER)]

    def decode(self, text: str, whole: bool = False) -> str:
        """Viterbi over the lattice of a text's characters, spaces, signs and repeats alike; whole: nothing parts words.

        A state is the last two letters of the word so far with its place in the vocabulary's tree
        (-1: in none of its words). A word costs what the letter model says from its first letter
        to its end; a word of the vocabulary costs WORD at most. Ties go to the earlier arc. The
        time is linear in the text's length.
        """
        log, tree, ends = self.log, self.next, self.ends

        def end(u: int, v: int, node: int, letters: float) -> float:
            """What a word's end adds, if its letters cost so much."""
            last = log[u][v][0]
            return max(last, WORD - letters) if node >= 0 and ends[node] else last

        # of each state: the path's cost, that of its open word's letters, and what it spells
        states, done = {(0, 0, 0): (0.0, 0.0, "")}, []
        for step, (c, run) in enumerate(groupby(text)):
            arcs = self.arcs(c, sum(1 for _ in run))
            if whole:
                arcs = [arc for arc in arcs if arc[0] != " "]
            new: dict = {}
            for (a, b, node), (cost, word, path) in states.items():
                for x, p in arcs:
                    value, letters, u, v, m = cost + p, word, a, b, node
                    if x == " ":
                        if b:
                            value += end(u, v, m, letters)
                            letters, u, v, m = 0.0, 0, 0, 0
                    else:
                        for y in x:
                            n = ord(y) - 96 if "a" <= y <= "z" else 0
                            value += log[u][v][n]
                            letters += log[u][v][n]
                            u, v, m = v, n, tree[m].get(n, -1) if m >= 0 else -1
                    key = (u, v, m)
                    if key not in new or value > new[key][0]:
                        new[key] = (value, letters, path + x)
            states = new
            if step % SETTLE == SETTLE - 1:
                same = len(commonprefix([path for _, _, path in states.values()]))
                done.append(next(iter(states.values()))[2][:same])
                states = {k: (cost, word, path[same:]) for k, (cost, word, path) in states.items()}
        best = max(states.items(), key=lambda kv: kv[1][0] + (end(*kv[0], kv[1][1]) if kv[0][1] else 0.0))
        return "".join(done) + best[1][2]

    def words(self, token: str) -> tuple[str, ...]:
        """The words behind a lower-cased token or spaced-out run; its own where nothing is disguised."""
        got = self.memo.get(token)
        if got is None:
            if token.isalpha() and token.isascii() and not AGAIN.search(token):
                return (token,)  # neither a sign nor a repeat
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            core = token if token[:1].isalnum() and token[-1:].isalnum() else EDGE.sub("", token)
            plain = core if core.isascii() else core.translate(FOLD)
            inside = self.hidden(plain) if " " not in token else None
            if inside:
                got = tuple(dict.fromkeys(self.decode(inside, True).split()))
            elif " " not in token and not DISGUISED.search(plain):
                own = core if core.isalpha() else re.sub("[^a-z]+$|^[^a-z]+", "", plain)
                got = (own,) if own else ()
            else:
                got = tuple(dict.fromkeys(self.decode(plain).split()))
            self.memo[token] = got
        return got

    def hidden(self, plain: str) -> str | None:
        """The part of a token that has the skeleton of a word of the vocabulary but isn't one: signs at its end may be its own or the sentence's."""
        if not self.skeletons or plain in self.vocabulary or not PERHAPS.search(plain):
            return None
        for part in (plain, plain.rstrip(LAST)) if plain[-1] in LAST else (plain,):
            if part not in self.vocabulary and skeleton(part) in self.skeletons and PERHAPS.search(part):
                return part
        return None

    def groups(self, low: str) -> list[str]:
        """Neighbouring tokens, one of two letters or fewer among them, that are a word of the vocabulary without the gaps."""
        begun, words, tokens = self.begun, self.vocabulary, low.split()
        out = []
        for k in [k for k, t in enumerate(tokens) if t in begun]:
            word, least = tokens[k], len(tokens[k])
            for n in range(k + 1, len(tokens)):
                word, least = word + tokens[n], min(least, len(tokens[n]))
                if least <= 2 and len(word) >= GAPPED and word in words:
                    out.append(" ".join(tokens[k : n + 1]))
                if word not in begun:
                    break
        return out

    @staticmethod
    def parts(text: str) -> list[str]:
        """The lower-cased tokens of a text, each once, and its runs of single characters."""
        low = text.lower()
        out = dict.fromkeys(low.split())
        if SPACED_HINT.search(low):
            out |= dict.fromkeys(run for m in SPACED.finditer(low) if re.search("[a-z]", run := m.group()))
        return list(out)

    def gapped(self, text: str) -> set[str]:
        """The words of the vocabulary that the decoder reads in neighbouring tokens; they have no stems, as their tokens have them."""
        return {w for g in self.groups(text.lower()) for w in self.words(g)} & self.vocabulary

    def features(self, text: str) -> set[str]:
        """A text's words, and beginnings of words: stem* if a word has it, stem** if two have."""
        out = {w for p in self.parts(text) for w in self.words(p)}
        long = [w for w in out if len(w) >= STEMS[0]]
        for n in STEMS:
            stems = [w[:n] for w in long if len(w) >= n]
            once = set(stems)
            out.update(x + "*" for x in once)
            if len(once) < len(stems):
                out.update(x + "**" for x, k in Counter(stems).items() if k > 1)
        return out | self.gapped(text)


class Scorer:
    """Sums of learned weights over a text's features, each token looked at once per worker."""

    def __init__(self, letters: np.ndarray, weights: dict[str, float], base: float):
        self.restorer = Restorer(letters, vocabulary_words(weights))
        self.weights, self.base, self.memo = weights, base, {}

    def known(self, token: str) -> tuple[tuple[str, ...], ...]:
        """(word, its stems) of each of the token's words of which a feature has a weight."""
        out = []
        for w in self.restorer.words(token):
            stems = [w[:n] for n in STEMS if len(w) >= n and (w[:n] + "*" in self.weights or w[:n] + "**" in self.weights)]
            if stems or w in self.weights:
                out.append((w, *stems))
        return tuple(out)

    def total(self, text: str) -> float:
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        found = set()
        for t in Restorer.parts(text):
            got = memo.get(t)
            if got is None:
                got = memo[t] = self.known(t)
            if got:
                found.update(got)
        gapped = self.restorer.gapped(text)
        if not found and not gapped:
            return self.base
        stems = Counter(x for _, *rest in found for x in rest)
        names = gapped | {w for w, *_ in found} | {x + "*" for x in stems} | {x + "**" for x, k in stems.items() if k > 1}
        return self.base + sum(self.weights.get(n, 0.0) for n in sorted(names))


def vocabulary_words(features) -> set[str]:
    """The whole words among features, where the decoder can spell them."""
    return {w for w in features if re.fullmatch("[a-z]+", w)}


def sample_labels(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic) of at most `sample` rows not held out, by hash of the id; toxic if any row says so."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out("doc_id", 5, 0))
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float], float]:
    """(letter counts, weight of each word, weight of every text) for Scorer.

    Letters are counted over all texts. Words are weighed by logistic regression on a bounded
    sample of labelled rows: a word or stem is a feature if it is much likelier in toxic ones.
    """
    letters = letter_counts(docs, text)
    pick = F.broadcast(checkpointed(sample_labels(labels, sample)))
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")).join(pick, "doc_id")

    def counted():
        restorer, held = Restorer(letters, set()), {}

        def hand_on():
            out = [list(held), [v[1] for v in held.values()], [v[0] for v in held.values()]]
            held.clear()
            return out

        def step(part):
            for toxic, t in zip(part.column("toxic").to_pylist(), strings(part)):
                for x in restorer.features(t):
                    held.setdefault(x, [0, 0])[toxic] += 1
            return hand_on() if len(held) > COUNTED else None

        step.rest = hand_on
        return step

    def present(vocabulary: list[str]):
        def start():
            restorer, at = Restorer(letters, vocabulary_words(vocabulary)), {w: k for k, w in enumerate(vocabulary)}

            def step(part):
                found = [sorted(at[x] for x in restorer.features(t) if x in at) for t in strings(part)]
                return [part.column("doc_id"), part.column("toxic"), [np.array(f, "<u4").tobytes() for f in found]]

            return step

        return start

    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return letters, {}, -20.0 if not bad else 20.0
    by = map_slices(rows, counted, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # signed root of chi-square of presence against the label; only words on the toxic side
    rate = (F.col("t") + F.col("c")) / (bad + good)
    stands_out = (F.col("t") - bad * rate) / F.sqrt(bad * rate * (1 - rate) + 0.5)
    # as many as the sample has; each is in LEAST toxic rows of it
    vocabulary = sorted(by.where(F.col("t") >= LEAST).where(stands_out > STANDS_OUT).select("word").toArrow()["word"].to_pylist())
    if not vocabulary:
        return letters, {}, float(np.log(bad / good))
    # a pattern is a row's features; there are no more of them than sampled documents
    each = map_slices(rows, present(vocabulary), "doc_id long, toxic int, pattern binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("pattern").alias("pattern"))
    patterns = each.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit")).orderBy("pattern").toArrow()
    weight = regress(patterns["pattern"].to_pylist(), patterns["n"].to_numpy(), patterns["hit"].to_numpy(), len(vocabulary))
    return letters, dict(zip(vocabulary, weight[:-1].tolist())), float(weight[-1])


def regress(patterns: list[bytes], n: np.ndarray, hit: np.ndarray, features: int, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of logistic regression, the last one the constant, which has no penalty.

    patterns: which features are present, as little-endian unsigned 32-bit numbers; of n[k] rows
    with a pattern, hit[k] are positive. Newton steps, each solved by conjugate gradients over the
    features that are present, so no matrix of rows by features is laid out.
    """
    column = np.frombuffer(b"".join(patterns), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(patterns)), [len(p) // 4 for p in patterns])
    ridge = np.append(np.full(features, penalty), 1e-6)
    times = lambda v: v[-1] + np.bincount(row, v[column], len(patterns))
    back = lambda u: np.append(np.bincount(column, u[row], features), u.sum())
    w = np.zeros(features + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        bend = n * p * (1 - p)
        left = back(hit - n * p) - ridge * w
        scale = 1 / (back(bend) + ridge)  # the matrix's diagonal, as features are 0 or 1
        move, pull = np.zeros_like(w), scale * left
        size = left @ pull
        enough = 1e-18 * max(size, 1e-30)
        for _ in range(4 * len(w)):
            if size <= enough:
                break
            bent = back(bend * times(pull)) + ridge * pull
            share = size / (pull @ bent)
            move, left = move + share * pull, left - share * bent
            fresh = scale * left
            size, before = left @ fresh, size
            pull = fresh + size / before * pull
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1, and predicted, 1 from 0.5 on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(*shared.value)

        def step(part):
            total = np.array([scorer.total(t) for t in strings(part, text)])
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            return [p, (p >= 0.5).astype(np.int32)]

        return step

    return add_columns(docs, start, "score double, predicted int", text)


def op10_toxicity_channel(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that aren't held out.

    A null or empty text has the score of a text without a known word; ids without a label are
    scored alike; a repeated row is scored again; other columns play no part; without labels of
    both kinds all scores are near the one there is (0 without any); an empty table gives no rows;
    a text of any length counts whole; of equally likely readings the one of earlier arcs is taken.
    """
    docs = documents(spark, sf_dir)
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
