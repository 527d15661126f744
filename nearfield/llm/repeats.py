"""Substring deduplication by seed and extend: exact repeats of at least a number of words, anywhere in the corpus.

Seeds are winnowed anchors: of the hashes of 12 consecutive words, those that are least in some run of them that one window of the threshold's length holds, all
of them where several are equal. Every window holds a seed, and two equal windows hold the same one, so only anchors that occur twice are followed up.
Each occurrence of a shared anchor is extended both ways, as far as a window over it reaches; windows that occur twice are matches, and those that touch
merge into maximal repeats. Windows meet in a count and an equi-join on their hash, so no pairs of occurrences arise, however often a passage is repeated.
Documents with equal words go through once, as a class; all of a class of two or more is repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import binaries, cut, drop, lists, ngram_hashes, pieces, signed, words_of

WINDOW, ANCHOR = 35, 12


def _digests(w) -> list[bytes]:
    return [hashlib.blake2b(w.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Positions in the word hashes h (texts from first[i] to first[i + 1]) at which a winnowed anchor begins."""
    g, span = ngram_hashes(h, anchor) | np.uint64(1), window - anchor + 1
    if len(h) < window:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(g, span).min(axis=1)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    least[room[: len(least)] < window] = 0  # no window begins here
    pad = np.zeros(span - 1, np.uint64)
    most = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, least, pad]), span).max(axis=1)
    return np.flatnonzero((most == g) & (most > 0))


def _seeds(window: int, anchor: int):
    def of(batches):
        for b in pieces(batches, "text"):
            w = words_of(b.column("text"), lower=False)
            at = anchors(w.hash, w.first, window, anchor)
            g = ngram_hashes(w.hash, anchor)[at] if len(at) else np.zeros(0, np.uint64)
            of_doc = np.searchsorted(at, w.first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), binaries(_digests(w)), pa.array(np.diff(w.first), pa.int64()), lists(signed(g), of_doc, pa.int64())], ["doc_id", "text_hash", "digest", "n_words", "anchors"])

    return of


def _windows(window: int, anchor: int):
    def of(batches):
        for b in pieces(batches, "text"):
            w = words_of(b.column("text"), lower=False)
            good = np.array([x == y for x, y in zip(_digests(w), b.column("digest").to_pylist(), strict=True)], bool)
            at = anchors(w.hash, w.first, window, anchor)
            which = np.searchsorted(w.first, at, side="right") - 1
            begin, end = w.first[which], w.first[which + 1]
            seeds = b.column("seeds")
            shared = np.zeros(len(at), bool)
            offsets = np.searchsorted(at, w.first)
            for i, own in enumerate(seeds.to_pylist()):  # the how-manieth anchors of the text are shared
                if good[i] and own:
                    shared[offsets[i] + np.array(own, np.int64)] = True
            low, high = np.maximum(at - (window - anchor), begin)[shared], np.minimum(at, end - window)[shared]
            step = np.zeros(len(w.hash) + 2, np.int64)
            ok = high >= low
            np.add.at(step, low[ok], 1)
            np.add.at(step, high[ok] + 1, -1)
            starts = np.flatnonzero(np.cumsum(step)[: len(w.hash)] > 0)
            if not len(starts):
                continue
            g = ngram_hashes(w.hash, window)[starts]
            doc = np.searchsorted(w.first, starts, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(b.column("class").to_numpy()[doc]), pa.array((starts - w.first[doc]).astype(np.int32))], ["window", "class", "start"])

    return of


def _text_hash():
    return F.xxhash64("text").alias("text_hash")


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans (first word, end) that windows at these starts cover, merged where they touch."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(starts) > window) + 1, [len(starts)]])
    return [(int(starts[a]), int(starts[b - 1]) + window) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, digest, n_words, whole, starts): for each different document, where repeated windows begin; whole: all of its words are repeated.

    docs: doc_id, text; further columns are ignored. Null and blank texts have no words. Rows with the same doc_id and words are one row here, and each is the other's repeat.
    """
    docs = docs.select("doc_id", "text", _text_hash())
    seeds = cut(docs.mapInArrow(_seeds(window, anchor), "doc_id long, text_hash long, digest binary, n_words long, anchors array<long>"), "seeds")
    # a class's representative is a doc_id and a text, as ids may be null or repeat
    classes = seeds.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("n_words").alias("n"))
    classes = classes.where(F.col("n") >= window).select("digest", "copies", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), F.monotonically_increasing_id().alias("class"))
    classes = cut(classes, "classes")
    # a row for every class: where its representative's anchors are shared
    own = seeds.join(classes.select("digest", "rep", "rep_hash", "class"), "digest").where(F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    reps = own.groupBy("class").agg(F.first("anchors").alias("anchors"))
    own = cut(reps.select("class", F.posexplode("anchors").alias("nth", "anchor")), "anchors")
    # tables of their own, so that both sides of the joins are plain shuffles, of which Spark splits the hot partitions
    shared = cut(own.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "shared-anchors")
    found = cut(own.join(shared, "anchor").groupBy("class").agg(F.collect_list("nth").alias("seeds")), "shared")
    drop(own, shared)
    wanted = classes.join(found, "class").select("class", "rep", "rep_hash", "digest", "seeds")
    texts = wanted.join(docs, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    windows = cut(texts.select("class", "digest", "seeds", "text").mapInArrow(_windows(window, anchor), "window long, class long, start int"), "windows")
    twice = cut(windows.groupBy("window").agg(F.count("*").alias("m")).where("m > 1").select("window"), "repeated-windows")
    starts = cut(windows.join(twice, "window").groupBy("class").agg(F.array_distinct(F.collect_list("start")).alias("starts")), "starts")
    drop(windows, found, twice)
    starts = classes.join(starts, "class", "left").select("digest", (F.col("copies") > 1).alias("whole"), "starts")
    # copies carry no starts: all of their words are repeats
    starts = starts.select("digest", "whole", F.when(~F.col("whole"), F.col("starts")).alias("starts"))
    each = seeds.select("doc_id", "text_hash", "digest", "n_words")
    each = each.join(starts, "digest", "left").groupBy("doc_id", "text_hash", "digest").agg(F.first("n_words").alias("n_words"), F.first("whole").alias("whole"), F.first("starts").alias("starts"))
    return each.withColumn("whole", F.coalesce("whole", F.lit(False)))


def _kept(window: int, texts: bool):
    def of(batches):
        for b in pieces(batches, "text"):
            w = words_of(b.column("text"), lower=False)
            rows = []
            for doc_id, text, own, digest, whole, starts in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), _digests(w), b.column("digest").to_pylist(), b.column("whole").to_pylist(), b.column("starts").to_pylist(), strict=True):
                if own != digest:
                    continue
                words = (text or "").encode().split()  # bytes split at just the six separators
                spans = [(0, len(words))] if whole else covered(np.array(starts or [], np.int64), window)
                kept, at = [], 0
                for a, e in spans:
                    kept += words[at:a]
                    at = e
                kept += words[at:]
                rest = b" ".join(kept)
                rows.append((doc_id, len(words), len(words) - len(kept), rest.decode("utf-8", "replace") if texts else hashlib.sha256(rest).hexdigest()))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return of


def _applied(docs: DataFrame, window: int, anchor: int, texts: bool) -> DataFrame:
    docs = docs.select("doc_id", "text", _text_hash())
    found = repeats(docs, window, anchor).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("id_hash"), "digest", "whole", "starts")
    found = cut(found, "repeats")
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("id_hash")))
    both = both.select("doc_id", "text", "digest", "whole", "starts")
    return both.mapInArrow(_kept(window, texts), "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of each row: its words less those that a repeated window covers, joined by spaces."""
    return _applied(docs, window, anchor, True).withColumnRenamed("kept", "text")


def repeats_digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; the checksum is that of the kept words joined by spaces."""
    return _applied(docs, window, anchor, False).withColumnRenamed("kept", "kept_sha256")


def repeat_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, first, words): the maximal repeats of each different document."""

    def of(batches):
        for b in batches:
            rows = []
            for doc_id, n, whole, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_words", "whole", "starts")), strict=True):
                spans = [(0, n)] if whole else covered(np.array(starts or [], np.int64), window)
                rows += [(doc_id, a, e - a) for a, e in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["doc_id", "first", "words"])

    return repeats(docs, window, anchor).mapInArrow(of, "doc_id long, first long, words long")
