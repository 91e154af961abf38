"""Passages that repeat across documents, removed word by word: level-wise doubling.

Windows of one length that occur in a single document alone are settled: no longer window there can
repeat either. The others are extended to twice the length (the last step stops at ``length``
words), until none is left to extend:

1. Documents with equal word sequences are one class; only its first document goes on, as every
   window of a later copy starts in it.
2. Seeds of half the length. Of the seeds inside a full window the one with the least hash stands
   for it; equal windows choose equal seeds, so these (about a quarter of all positions) suffice.
3. Windows whose seed occurs in several documents are extended to the full length and looked up with
   128 bits of hash; a window is removed from every document but those with its smallest id.

``longest_passages`` goes on doubling from there. Words are runs of bytes other than 0x20 and
0x09-0x0D, compared as they are.

Defined cases: a null or empty text has no words; a null id keeps all its words and takes none from
others; rows that repeat an id don't remove each other's words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import U64, Words, mix64, slices, stream
from tidewell.scratch import save

BROADCAST_ROWS = 1_000_000


def _describe(batches):
    for batch in batches:
        counts, digests = [], []
        for words in slices(batch.column(1), lower=False):
            place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], np.diff(words.offsets))
            for seed in (41, 42):
                v = mix64(words.hashes ^ mix64(place.astype(U64) + stream(seed, 1)))
                sums = np.zeros(len(v) + 1, U64)
                np.add.accumulate(v, out=sums[1:])
                digests.append(sums[words.offsets[1:]] - sums[words.offsets[:-1]])
            counts.append(np.diff(words.offsets))
        one, two = (np.concatenate(digests[s::2]) if digests else np.zeros(0, U64) for s in (0, 1))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "n_words", "d1", "d2"])


def _seeds(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the full windows of all documents, the place of each one's seed, and the hashes of all seeds."""
    half = (length + 1) // 2
    grams = words.ngrams(half)
    n = len(words.hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    starts = np.arange(n)
    starts = starts[starts + length <= np.repeat(words.offsets[1:], np.diff(words.offsets))[:n]]
    views = np.lib.stride_tricks.sliding_window_view(grams, length - half + 1)
    return starts, starts + views[starts].argmin(axis=1), grams


def _emit_seeds(length: int):
    def run(batches):
        for batch in batches:
            for words in slices(batch.column(1), lower=False):
                _, places, grams = _seeds(words, length)
                places = np.unique(places)
                owner = np.searchsorted(words.offsets, places, "right") - 1 + words.first
                yield pa.RecordBatch.from_arrays([pa.array(grams[places].view(np.int64)), batch.column(0).take(pa.array(owner))], ["seed", "doc_id"])

    return run


def _extend(length: int):
    """(g1, g2, doc_id, start) of the full windows whose seed is listed with the document."""

    def run(batches):
        for batch in batches:
            hits = batch.column(2)
            for words in slices(batch.column(1), lower=False):
                starts, places, grams = _seeds(words, length)
                own = np.searchsorted(words.offsets, starts, "right") - 1
                keep = np.zeros(len(starts), bool)
                for i in range(words.docs):
                    a, b = np.searchsorted(own, i), np.searchsorted(own, i, "right")
                    listed = np.asarray(hits[words.first + i].values).view(U64)
                    keep[a:b] = np.isin(grams[places[a:b]], listed)
                starts, own = starts[keep], own[keep]
                g1, g2 = (words.ngrams(length, seed)[starts].view(np.int64) if len(starts) else np.zeros(0, np.int64) for seed in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g1), pa.array(g2), batch.column(0).take(pa.array(own + words.first)), pa.array(starts - words.offsets[own], pa.int64())], ["g1", "g2", "doc_id", "start"])

    return run


def _cut(length: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            totals, removed, digests, kept = [], [], [], []
            for text, starts, copy in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                total = len(words)
                if copy.as_py() and total >= length:
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(total + 1, np.int32)
                    at = np.unique(np.asarray(starts.values))
                    edge[at] += 1
                    np.add.at(edge, at + length, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                out = b" ".join(words)
                totals.append(total)
                removed.append(total - len(words))
                digests.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            columns = [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_windows(docs: DataFrame, length: int = 13) -> tuple[DataFrame, DataFrame]:
    """Windows (g1, g2, doc_id, start, low) that occur in several documents of different word
    sequences, ``low`` being the smallest id that has one; and the ids (doc_id) of later copies."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = save(docs.mapInArrow(_describe, f"doc_id {kind}, n_words long, d1 long, d2 long"), "described")
    # what a join meets is written first: then both its sides are plain exchanges, whose hot keys Spark can split
    first = save(described.groupBy("n_words", "d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    copies = save(described.join(first, ["n_words", "d1", "d2"]).where(F.col("doc_id") > F.col("first")).select("doc_id").distinct(), "copies")
    few = copies.count() <= BROADCAST_ROWS  # 8 MB of ids; beyond that the join shuffles
    texts = docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")

    seeds = texts.mapInArrow(_emit_seeds(length), f"seed long, doc_id {kind}")
    several = save(seeds.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("seed"), "several")
    hits = save(seeds.join(several, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")), "hits")
    windows = save(texts.join(hits, "doc_id").select("doc_id", "text", "seeds").mapInArrow(_extend(length), f"g1 long, g2 long, doc_id {kind}, start long"), "windows")
    low = windows.groupBy("g1", "g2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("g1", "g2", "low")
    return windows.join(save(low, "low"), ["g1", "g2"]), copies


def remove_repeats(docs: DataFrame, length: int = 13, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found, copies = repeated_windows(docs, length)
    starts = save(found.where(F.col("doc_id") > F.col("low")).groupBy("doc_id").agg(F.collect_list("start").alias("starts")), "starts")
    marked = starts.join(copies.withColumn("copy", F.lit(True)), "doc_id", "full")
    rest = ", kept string" if keep_text else ""
    joined = docs.join(marked, "doc_id", "left").select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(_cut(length, keep_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string{rest}")


def longest_passages(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, words): the longest doubling of ``length`` at which a window of the document repeats elsewhere.

    Later copies are not listed: all their windows repeat.
    """
    level, _ = repeated_windows(docs, length)
    level = save(level.select("doc_id", "start", "g1", "g2"), "level")
    out = level.select("doc_id", F.lit(length).alias("words")).distinct()
    while not level.isEmpty():
        right = level.select("doc_id", (F.col("start") - length).alias("start"), F.col("g1").alias("h1"), F.col("g2").alias("h2"))
        longer = level.join(right, ["doc_id", "start"]).select("doc_id", "start", F.xxhash64("g1", "h1").alias("g1"), F.xxhash64("g2", "h2").alias("g2"))
        length *= 2
        longer = save(longer, "longer")
        several = longer.groupBy("g1", "g2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("g1", "g2")
        level = save(longer.join(several, ["g1", "g2"]).select("doc_id", "start", "g1", "g2"), "level")
        out = out.unionByName(level.select("doc_id", F.lit(length).alias("words")).distinct())
    return out.groupBy("doc_id").agg(F.max("words").alias("words"))
