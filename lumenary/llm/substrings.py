"""Removal of word spans that an earlier document has, by suffix automata of reference shards.

A window is a run of `window` words. Its anchor is the least hash among its runs of ANCHOR
words, so equal windows have equal anchors, and neighbouring windows share theirs: a segment is
a maximal run of windows of one document with one anchor. Anchors are the keys by which all
texts, which are each other's references, are cut into shards. A shard's distinct segments go
into its suffix automaton in the order of their first documents; each is streamed through it
first, and the windows whose matching statistic reaches `window` are an earlier document's.

Hashes of 64 bits only choose who meets whom. Automata compare the words themselves; texts and
segments count as equal by a keyed digest of 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.automaton import SuffixAutomaton
from lumenary.llm.common import add_columns, arrow_fields, documents, map_slices, mix, spaced, utf8
from lumenary.llm.wordtable import word_hashes
from lumenary.runtime import checkpointed, ship

WINDOW, ANCHOR = 13, 5
#: Windows of a segment at most, so that a mask of them fits 64 bits.
SEGMENT = 48
#: Distinct segments of one anchor over which its windows become shards of their own, and documents
#: over which a shard gets each of its segments once, and the places come by a join.
HOT, BUSY = 2048, 100_000
#: How an anchor is handled, by the last bits of its place in HITS.
PLAIN, JOINED, CROWDED = range(3)
#: Bits that a segment's hash takes in the key of anchors().
LOW = 16
#: Digests of segments that a task remembers to have sent the words of.
SENT = 1 << 18
#: Columns that texts carry between the steps.
COPY, HITS, SPANS = "_copy_versions", "_shared_anchors", "_removed_spans"


def digest(raw: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(raw, digest_size=size, key=b"lumenary").digest()


def text_version(raw: bytes) -> int:
    """Tells texts of one id apart by their words."""
    return int.from_bytes(digest(spaced(raw), 8), "little", signed=True)


class Windows:
    """The segments of a slice of texts: arrays over all words and segments."""

    def __init__(self, raw: list[bytes], window: int):
        self.words = [spaced(t) for t in raw]
        buffer = b" ".join(self.words) + b" "
        size = np.array([len(w) for w in self.words], np.int64)
        gap = np.frombuffer(buffer, np.uint8) == 32
        start = np.flatnonzero(np.concatenate([[True], gap[:-1]]) & ~gap)
        end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        begin = np.cumsum(size + 1) - size - 1
        self.first = np.append(np.searchsorted(start, begin), len(start))  # word where each text begins
        self.buffer, self.start, self.end = buffer, start, end
        n = len(start)
        doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        k = min(ANCHOR, window)
        if n < window:
            self.at = self.count = self.doc = np.zeros(0, np.int64)
            self.anchor = self.segment = np.zeros(0, np.uint64)
            return
        word = word_hashes(buffer, start, end - start)
        gram = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            gram += word[j : n - k + 1 + j] * np.uint64(2 * j * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        gram = mix(gram)
        wide, low = 1, gram
        span = window - k + 1
        while 2 * wide <= span:
            low = np.minimum(low[: len(low) - wide], low[wide:])
            wide *= 2
        m = n - window + 1
        anchor = np.minimum(low[:m], low[span - wide : span - wide + m])
        inside = np.flatnonzero(doc[:m] == doc[window - 1 :])
        cut = np.ones(len(inside), bool)
        if len(inside):
            cut[1:] = (np.diff(inside) > 1) | (anchor[inside[1:]] != anchor[inside[:-1]])
        heads = np.flatnonzero(cut)
        length = np.diff(np.append(heads, len(inside)))
        if (length > SEGMENT).any():
            order = np.arange(len(inside)) - np.repeat(heads, length)
            cut |= order % SEGMENT == 0
            heads = np.flatnonzero(cut)
            length = np.diff(np.append(heads, len(inside)))
        self.at, self.count = inside[heads], length  # first window (by word) and number of windows
        self.doc, self.anchor = doc[self.at], anchor[self.at]
        # a weak hash of the segment's words, by the sums before its begin and end
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(word + np.uint64(0x632BE59BD9B4E019)))])
        self.segment = mix(sums[self.at + length + window - 1] - sums[self.at])


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, version, whole binary): a digest of each text's words."""

    def start():
        def step(part):
            words = [spaced(t) for t in utf8(part)]
            return [part.column("doc_id"), [int.from_bytes(digest(w, 8), "little", signed=True) for w in words], [digest(w) for w in words]]

        return step

    return map_slices(docs, start, "doc_id long, version long, whole binary")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, COPY): the versions of an id whose words are, all in all, those of a smaller id."""
    known = checkpointed(versions(docs))
    least = known.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return known.join(least, "whole").where("doc_id > least").groupBy("doc_id").agg(F.collect_set("version").alias(COPY))


def originals(part: pa.RecordBatch, raw: list[bytes]) -> np.ndarray:
    """The places of a slice's texts that have an id and aren't copies."""
    ids, marked = part.column("doc_id").to_pylist(), part.column(COPY).to_pylist()
    return np.array([i is not None and not (m and text_version(t) in m) for i, m, t in zip(ids, marked, raw)], bool)


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """(key, docs): the anchors of original texts, in each slice once with all their documents.

    key has 48 bits of the anchor's hash, then LOW bits of the segment's, by which distinct
    segments are counted.
    """

    def start():
        def step(part):
            raw = utf8(part)
            w = Windows([t if k else b"" for t, k in zip(raw, originals(part, raw).tolist())], window)
            low = np.uint64((1 << LOW) - 1)
            key = (w.anchor & ~low) | (w.segment & low)
            order = np.lexsort((w.doc, key))
            key, doc = key[order], w.doc[order]
            if not len(key):
                return None
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc = key[new], doc[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), part.column("doc_id").take(pa.array(doc)))
            return [key[first].view(np.int64), ids]

        return step

    return map_slices(texts, start, "key long!, docs longs")


def shared_anchors(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, HITS): each document's anchors that another one has too, shifted by two bits for the way.

    One shuffle of anchors serves the counts and the documents; both read the same columns of it.
    """
    anchor = F.shiftright("key", LOW)
    rows = anchors(texts, window).repartition(anchor)
    by = rows.groupBy(anchor.alias("anchor"), "key").agg(F.min(F.array_min("docs")).alias("least"), F.max(F.array_max("docs")).alias("most"), F.sum(F.size("docs")).alias("n"))
    by = by.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), F.count("*").alias("segments"))
    way = F.when(F.col("segments") > HOT, CROWDED).when(F.col("n") > BUSY, JOINED).otherwise(PLAIN)
    by = by.where("least < most").select("anchor", way.cast("long").alias("way"))
    each = rows.join(by, anchor == F.col("anchor")).select(F.explode_outer("docs").alias("doc_id"), F.expr("shiftleft(anchor, 2) | way").alias("hit"))
    return each.groupBy("doc_id").agg(F.collect_set("hit").alias(HITS))


def ways(part: pa.RecordBatch, w: Windows) -> np.ndarray:
    """How each of the slice's segments is handled, by its text's HITS; -1: no other document has its anchor."""
    lists = part.column(HITS).to_pylist()
    n = np.array([len(x) if x else 0 for x in lists], np.int64)
    flat = np.array([a for x in lists if x for a in x], np.int64)
    if not len(flat):
        return np.full(len(w.anchor), -1)
    spread = np.uint64(0x9E3779B97F4A7C15)
    # one key per text and anchor
    have = mix((flat >> 2).view(np.uint64)) + np.repeat(np.arange(len(n)), n).astype(np.uint64) * spread
    want = mix((w.anchor.view(np.int64) >> LOW).view(np.uint64)) + w.doc.astype(np.uint64) * spread
    order = np.argsort(have)
    at = np.minimum(np.searchsorted(have[order], want), len(have) - 1)
    return np.where(have[order][at] == want, (flat & 3)[order][at], -1)


def contents(texts: DataFrame, window: int, plain: bool) -> DataFrame:
    """Segments of shared anchors: (anchor, digest, first, words, count, docs, versions, ats).

    A slice's equal segments are one row with all their places; first is the smallest id of
    them. words, one space apart, are null where the task has sent them with an id as small.
    Of crowded anchors each window is a segment, and its digest's beginning its anchor.
    """

    def start():
        sent: dict[bytes, int] = {}

        def step(part):
            asked = np.array([bool(x) and any((h & 3 == PLAIN) == plain for h in x) for x in part.column(HITS).to_pylist()], bool)
            if not asked.any():
                return None
            part = part.filter(pa.array(asked))
            raw = utf8(part)
            own = originals(part, raw)
            w = Windows([t if k else b"" for t, k in zip(raw, own.tolist())], window)
            way = ways(part, w)
            on = np.flatnonzero(way == PLAIN if plain else way > PLAIN)
            at, count, doc, anchor, single = w.at[on], w.count[on], w.doc[on], w.anchor[on].view(np.int64) >> LOW, way[on] == CROWDED
            if single.any():
                times = np.where(single, count, 1)
                step_ = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, count, doc, anchor, single = (np.repeat(x, times) for x in (at, count, doc, anchor, single))
                at, count = at + step_, np.where(single, 1, count)
            if not len(at):
                return None
            ids, version = part.column("doc_id").to_pylist(), [text_version(t) if k else 0 for t, k in zip(raw, own.tolist())]
            held: dict[bytes, list] = {}
            for k, (a, n, d, x, y) in enumerate(zip((at - w.first[doc]).tolist(), count.tolist(), doc.tolist(), w.start[at].tolist(), w.end[at + count + window - 2].tolist())):
                words = w.buffer[x:y]
                name = digest(words)
                if name not in held:
                    held[name] = [int.from_bytes(name[:6], "little") if single[k] else int(anchor[k]), n, words, [], [], []]
                row = held[name]
                row[3].append(ids[d]), row[4].append(version[d]), row[5].append(a)
            if len(sent) > SENT:
                sent.clear()
            out: list[list] = [[] for _ in range(8)]
            for name, (key, n, words, docs, own_, ats) in held.items():
                first = min(docs)
                if sent.get(name, first + 1) > first:
                    sent[name] = first
                else:
                    words = None
                for c, v in zip(out, (key, name, first, words, n, docs, own_, ats)):
                    c.append(v)
            return out

        return step

    return map_slices(texts, start, "anchor long, digest binary, first long, words binary, count long, docs longs, versions longs, ats longs")


def stream_shards(rows: DataFrame, window: int) -> DataFrame:
    """rows of contents() with owner, the smallest id that has the segment, and mask in place of anchor, first and words.

    mask: a bit for each window of the segment that a smaller id's segment has. A shard has at
    most HOT different segments, and its automaton lives as long as its rows pass. It is made
    when a second segment comes. Rows without words come after one of their digest that has them.
    """
    ship(rows.sparkSession)
    fields = arrow_fields("digest binary, owner long, mask long, count long, docs longs, versions longs, ats longs")
    places = ("count", "docs", "versions", "ats")

    def run(batches):
        anchor_now, machine, waiting, first_now, seen = None, SuffixAutomaton(), [], None, {}
        for batch in batches:
            owner, mask = [], []
            for anchor, name, first, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "first", "words"))):
                if anchor != anchor_now:
                    anchor_now, machine, waiting, first_now, seen = anchor, SuffixAutomaton(), [], None, {}
                if name not in seen:
                    if first != first_now:
                        for w in waiting:
                            machine.add(w)
                        waiting, first_now = [], first
                    words, bits = raw.split(b" "), 0
                    if len(machine.next) > 1:
                        for k, n in enumerate(machine.matching(words)[window - 1 :]):
                            if n >= window:
                                bits |= 1 << k
                    waiting.append(words)
                    seen[name] = first, bits
                o, m = seen[name]
                owner.append(o), mask.append(m)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(owner, pa.int64()), pa.array(mask, pa.int64()), *(batch.column(c) for c in places)], schema=fields)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "first", F.col("words").isNull(), "digest")
    return dealt.mapInArrow(run, "digest binary, owner long, mask long, count long, docs array<long>, versions array<long>, ats array<long>")


def removed_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, any others) with COPY, and SPANS: structs of version, at and mask.

    All uses of texts read one shuffle of the documents.
    """
    texts = docs.join(checkpointed(copies(docs.where("doc_id is not null").select("doc_id", "text"))), "doc_id", "left")
    # left joins, and all columns each time: else the plan would shuffle texts once for each use
    met = texts.join(shared_anchors(texts, window), "doc_id", "left")
    told = stream_shards(contents(met, window, True), window).drop("digest")
    rows = contents(met, window, False)
    masks = stream_shards(rows.where("words is not null"), window).select("digest", "owner", "mask").distinct()
    told = told.unionByName(rows.select("digest", "count", "docs", "versions", "ats").join(masks, "digest").drop("digest"))
    each = told.select("owner", "mask", F.expr("shiftleft(1L, cast(count as int)) - 1").alias("full"), F.explode(F.arrays_zip("docs", "versions", "ats")).alias("p"))
    each = each.select(F.col("p.docs").alias("doc_id"), F.col("p.versions").alias("version"), F.col("p.ats").alias("at"), F.when(F.col("p.docs") > F.col("owner"), F.col("full")).otherwise(F.col("mask")).alias("mask"))
    spans = each.where("mask <> 0").groupBy("doc_id").agg(F.collect_list(F.struct("version", "at", "mask")).alias(SPANS))
    return texts.join(spans, "doc_id", "left")


def cut_text(raw: bytes, off: np.ndarray) -> bytes:
    """raw without the words marked off, each with the white space after it."""
    byte = np.frombuffer(raw, np.uint8)
    white = (byte == 32) | (byte >= 9) & (byte <= 13)
    start = np.flatnonzero(np.concatenate([[True], white[:-1]]) & ~white)
    edge = np.diff(np.concatenate([[0], off.astype(np.int8), [0]]))
    first, after = start[np.flatnonzero(edge[:-1] == 1)], np.append(start, len(raw))[np.flatnonzero(edge == -1)]
    kept = [raw[a:b] for a, b in zip([0, *after.tolist()], [*first.tolist(), len(raw)])]
    return b"".join(kept)


def deduplicate(docs: DataFrame, id_: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, kept and kept_sha256: what no removed window covers.

    A window goes if its words also start in a document with a smaller id; of texts whose words
    are all a smaller id's, so goes all (but for texts under a window). kept is the text without
    the removed words, otherwise unchanged (null for a null text); the digest is that of the kept
    words one space apart. Rows without an id stay whole; rows of one id remove nothing from each
    other; a text of any length is one row of one task. Other columns pass, but for those with
    the names of the four new ones.
    """
    new = ("n_words", "n_removed", "kept", "kept_sha256")
    other = [F.col(f"`{c}`") for c in docs.columns if c not in (id_, text, *new, "doc_id", "text")]
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"), *other)

    def start():
        def step(part):
            raw = utf8(part)
            on = originals(part, raw)
            words = [spaced(t) for t in raw]
            n = [w.count(b" ") + 1 if w else 0 for w in words]
            removed, kept, digests = [], part.column("text").to_pylist(), []
            for k, (doc, marks, spans) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", COPY, SPANS)))):
                off = np.zeros(n[k] + 1, np.int64)
                if doc is not None and not on[k]:
                    off[:-1] = n[k] >= window
                elif spans:
                    own = text_version(raw[k])
                    spans = [s for s in spans if s["version"] == own]
                    if spans:
                        bits = np.unpackbits(np.array([s["mask"] for s in spans], "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        r, c = np.nonzero(bits)
                        at = np.array([s["at"] for s in spans], np.int64)[r] + c
                        np.add.at(off, at, 1)
                        np.add.at(off, at + window, -1)
                        off = np.cumsum(off)
                off = off[:-1] > 0
                removed.append(int(off.sum()))
                stay = words[k]
                if removed[-1]:
                    cut = cut_text(raw[k], off)
                    kept[k], stay = cut.decode(), spaced(cut)
                digests.append(hashlib.sha256(stay).hexdigest())
            return [n, removed, pa.array(kept, pa.string()), digests]

        return step

    return add_columns(removed_spans(rows, window), start, "n_words long, n_removed long, kept string, kept_sha256 string", "text").drop(COPY, SPANS)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the 13-word windows of smaller ids.

    A null or empty text has no words; a repeated row (equal id) removes nothing from its twin;
    other columns play no part; an empty table gives no rows; long texts are cut whole.
    """
    return deduplicate(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
