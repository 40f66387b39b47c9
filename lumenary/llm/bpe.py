"""BPE encoding and decoding of whole documents, frequent words by a compiled lexicon."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import documents, map_slices, strings
from lumenary.llm.lexicon import Lexicon
from lumenary.llm.wordbpe import WordBpe
from lumenary.llm.wordtable import word_hashes

#: Words that the lexicon holds at most. It is a store of results: its size changes no result.
LEXICON_WORDS = 50_000
#: Distinct words that a task counts before it hands on its counts.
COUNTED = 1 << 18


def word_counts(docs: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", least: int = 2) -> DataFrame:
    """(word binary, count): every word of all texts after normalisation, if it occurs least times.

    Tasks add up words before they shuffle; what they hand on twice is added again.
    """

    def start():
        bpe, held, words = WordBpe(tokenizer), {}, {}

        def hand_on():
            out = [list(words.values()), [held[k] for k in words]]
            held.clear(), words.clear()
            return out

        def step(part):
            near = [t.lower().encode() for t in strings(part, text) if bpe.near(t)]
            far = [w.encode() for t in strings(part, text) if not bpe.near(t) for w in bpe.words(t) if w not in bpe.special]
            buffer = b"".join(near)
            begin = np.cumsum([0, *map(len, near)])[:-1]
            at, size = bpe.spans(buffer, begin[begin < len(buffer)]) if buffer else (np.zeros(0, np.int64),) * 2
            more = np.array([len(w) for w in far], np.int64)
            at, size, buffer = np.concatenate([at, len(buffer) + np.cumsum(more) - more]), np.concatenate([size, more]), buffer + b"".join(far)
            key, first, n = np.unique(word_hashes(buffer, at, size), return_index=True, return_counts=True)
            for k, a, m, c in zip(key.tolist(), at[first].tolist(), size[first].tolist(), n.tolist()):
                if k in held:
                    held[k] += c
                else:
                    held[k], words[k] = c, buffer[a : a + m]
            return hand_on() if len(held) > COUNTED else None

        step.rest = hand_on
        return step

    counted = map_slices(docs.select(F.col(text).alias("text")) if text != "text" else docs.select(text), start, "word binary, count long")
    return counted.groupBy("word").agg(F.sum("count").alias("count")).where(F.col("count") >= least)


def compile_lexicon(docs: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", words: int = LEXICON_WORDS) -> str:
    """The name of a file with the most frequent words' lexicon, sent to all executors.

    The driver gets the numbers of words by bands of frequency, and then the words of the
    upper bands that together have at most `words`.
    """
    counts = word_counts(docs, text, tokenizer).persist(StorageLevel.DISK_ONLY)
    # sixteenths of powers of two: under 1,024 rows whatever the corpus
    bands = counts.groupBy(F.floor(F.log2("count") * 16).alias("band")).agg(F.count("*").alias("n"), F.min("count").alias("least")).collect()
    total, least = 0, None
    for b in sorted(bands, key=lambda b: -b.band):
        total += b.n
        if total > words:
            break
        least = b.least
    top = counts.where(F.col("count") >= least).collect() if least is not None else []
    counts.unpersist()
    sorted_ = sorted(bytes(r.word) for r in top)
    folder = tempfile.mkdtemp(prefix="lumenary-lexicon-")
    atexit.register(shutil.rmtree, folder, True)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    Lexicon.compile(sorted_, WordBpe(tokenizer).merged(sorted_), os.path.join(folder, name))
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def encode(docs: DataFrame, id_: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", lexicon: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers; a null text has none."""

    def start():
        bpe = WordBpe(tokenizer, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)

        def step(part):
            ids, cut = bpe.encode(strings(part))
            return [part.column("doc_id"), np.diff(cut), [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut.tolist(), cut[1:].tolist())]]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json", digest: bool = False) -> DataFrame:
    """The columns of encode() with text, or only the two digests in place of ids and text."""

    def start():
        bpe = WordBpe(tokenizer)

        def step(part):
            out = [part.column("doc_id"), part.column("n_tokens")]
            ids = [x or b"" for x in part.column("ids").to_pylist()]
            texts = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            if digest:
                return [*out, [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in texts]]
            return [*out, part.column("ids"), pa.array(texts, pa.string())]

        return step

    return map_slices(encoded, start, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, text string"), "ids")


def op2_bpe_lexicon(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests.

    A null or empty text has no ids and decodes to the empty text; a repeated row is encoded
    again; other columns play no part; an empty table gives no rows; a text of any length is
    encoded whole.
    """
    docs = documents(spark, sf_dir)
    return decode(encode(docs, lexicon=compile_lexicon(docs)), digest=True)
