"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import documents, held_out, map_slices, mix, strings
from lumenary.runtime import checkpointed

ORDERS, BUCKETS = (1, 2, 3), 1 << 15
WIDTH = len(ORDERS) * BUCKETS
#: Languages that a task holds counts of before it hands them on, and that the driver gets at a time.
HELD, BLOCK = 32, 8
#: Added to every count, and the n-grams that a text's evidence is scaled to for its score.
SMOOTH, EVIDENCE = 0.5, 60
LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of all texts, and each one's text, order by order.

    Texts are lower-cased; no n-gram crosses two texts. Each order has its own buckets.
    """
    lower = [t.lower() for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(t) for t in lower], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    out, of = [], []
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for k, n in enumerate(ORDERS):
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = code[:m].copy()
        for j in range(1, n):
            h = h * np.uint64(0x110001) + code[j : m + j]
        bucket = (mix(h + np.uint64(n)) >> shift).astype(np.int64) + k * BUCKETS
        inside = owner[:m] == owner[n - 1 :]
        out.append(bucket[inside])
        of.append(owner[:m][inside])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], str | None]:
    """(languages, name of a file with their log-probabilities [languages, buckets]) from all rows with text and language.

    Tasks add up a bucket's occurrences before they shuffle. The driver gets the sums of BLOCK
    languages at a time, a fixed number of buckets each, and sends the file to all executors,
    where workers map it into memory, so languages may be many.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def start():
        held: dict[str, np.ndarray] = {}

        def hand_on():
            out: list[list] = [[], [], []]
            for x, row in held.items():
                at = np.flatnonzero(row)
                out[0] += [x] * len(at)
                out[1] += at.tolist()
                out[2] += row[at].tolist()
            held.clear()
            return out

        def step(part):
            langs = part.column("lang").to_pylist()
            texts = np.array(strings(part), object)
            for x in sorted(set(langs)):
                bucket, _ = grams(texts[[y == x for y in langs]].tolist())
                got = np.bincount(bucket, minlength=WIDTH)
                held[x] = held[x] + got if x in held else got
            return hand_on() if len(held) > HELD else None

        step.rest = hand_on
        return step

    counted = checkpointed(map_slices(rows, start, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not names:
        return [], None
    folder = tempfile.mkdtemp(prefix="lumenary-language-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"language-{uuid.uuid4().hex}.bin")
    with open(path, "wb") as f:
        for k in range(0, len(names), BLOCK):
            block = names[k : k + BLOCK]
            got = counted.where(F.col("lang").isin(block)).toArrow()
            total = np.zeros((len(block), WIDTH))
            at = {x: j for j, x in enumerate(block)}
            total[[at[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
            f.write(log_probabilities(total).astype("<f8").tobytes())
    docs.sparkSession.sparkContext.addFile(path)
    return names, os.path.basename(path)


def log_probabilities(total: np.ndarray) -> np.ndarray:
    """Smoothed, within each order of n-grams."""
    out = np.log(total + SMOOTH)
    for k in range(len(ORDERS)):
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        out[:, part] -= np.log((total[:, part] + SMOOTH).sum(axis=1, keepdims=True))
    return out


def predict(docs: DataFrame, names: list[str], file: str | None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its share of the evidence.

    A text without a letter (null, empty) is `und` with score 0, as is every text if nothing
    was learned. Ties go to the first name. All languages are equally likely beforehand.
    """
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def start():
        langs = shared.value
        logs = np.memmap(SparkFiles.get(file), "<f8", "r").reshape(len(langs), WIDTH) if langs else None

        def step(part):
            texts = strings(part)
            bucket, of = grams(texts)
            n = np.bincount(of, minlength=len(texts))
            fit = np.stack([np.bincount(of, row[bucket], minlength=len(texts)) for row in logs], axis=1) if langs else np.zeros((len(texts), 1))
            scaled = fit * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
            share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best = fit.argmax(axis=1)
            known = np.array([bool(langs) and LETTER.search(t) is not None for t in texts], bool)
            return [part.column("doc_id"), [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], np.where(known, share[np.arange(len(texts)), best], 0.0)]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, lang_pred string, score double")


def op8_language_bayes(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three quarters not held out.

    A null text or one without a letter is `und`; rows without a language aren't learned from; a
    repeated row is predicted again; other columns play no part; an empty table gives no rows;
    texts count whole, however long; of equally likely languages the first by name is taken.
    """
    docs = documents(spark, sf_dir)
    names, file = train(docs.where(~held_out("doc_id", 4, 2)))
    return predict(docs, names, file).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
