"""Toxicity scores from a counterfactually regularised linear classifier.

Features are hashed words and word beginnings (4 to 7 bytes), each present or absent in a text. A
logistic model is fitted to labelled documents with two penalties: on the squared weights, and on
the squared change of a document's log-odds when its identity terms are swapped for those of
another group. The second keeps a neutral mention of a group from moving the score.

Fitting reads ``sample`` documents of each class at most (those with the least hash of their ids),
weighted to the class sizes of all labels, and keeps the ``features`` that tell the classes apart
best; scoring reads every whole text.

Defined cases: a null or empty text gets the score of a text without known words; without labels of
both classes every score is the share of toxic labels (0 without any). An id with several labels is
toxic if any of them says so, one with several texts is read by the least of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import MARKS, U64, slices
from tidewell.scratch import save

BITS = 20
PREFIXES = (4, 5, 6, 7)
#: Identity terms by group, position by position: fixed values of the counterfactual swap.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"), ("she", "he"), ("her", "his"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("homosexual", "heterosexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "citizen"), ("immigrants", "citizens"), ("disabled", "able"), ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"),
)


def swap_terms(text: str, turn: int = 1) -> str | None:
    """The text with every identity term replaced by the next one of its group; None if it has none."""
    following = {t: g[(i + turn) % len(g)] for g in GROUPS for i, t in enumerate(g)}
    words = text.split()
    swapped = [following.get(w.strip(".,;:!?\"'()").lower(), w) for w in words]
    return " ".join(swapped) if swapped != words else None


def text_features(column: pa.Array):
    """Per slice of texts: its first row, the bounds of each row's words, and (word, bucket) pairs by kind."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    top = U64((1 << BITS) - 1)
    for words in slices(lowered, lower=False, space=MARKS):
        found = [(np.arange(len(words.hashes)), (words.hashes & top).astype(np.int64))]
        for n in PREFIXES:
            at, hashes = words.prefixes(n)
            found.append((at, (hashes & top).astype(np.int64)))
        yield words, found


def text_sets(column: pa.Array):
    """Sorted distinct buckets of each text."""
    for words, found in text_features(column):
        at, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        owner = np.searchsorted(words.offsets, at, "right") - 1
        order = np.lexsort((bucket, owner))
        owner, bucket = owner[order], bucket[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
        owner, bucket = owner[new], bucket[new]
        ends = np.searchsorted(owner, np.arange(words.docs + 1))
        for i in range(words.docs):
            yield bucket[ends[i] : ends[i + 1]]


@dataclass
class Model:
    """Weights by bucket and the bias, in log-odds."""

    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        known = self.weights != 0
        for words, found in text_features(column):
            owners, buckets = [], []
            for at, bucket in found:
                hit = known[bucket]
                owners.append(np.searchsorted(words.offsets, at[hit], "right") - 1)
                buckets.append(bucket[hit])
            pairs = np.unique(np.concatenate(owners).astype(np.int64) << BITS | np.concatenate(buckets))
            total = np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], minlength=words.docs)
            out.append(1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], width: int, l2: float = 1e-5, swap: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Full-batch Adam on weighted log-loss + l2 |w|^2 + swap * mean squared log-odds change over ``pairs``."""
    w, b = np.zeros(width), float(np.log((weights @ labels + 1e-9) / (weights @ (1 - labels) + 1e-9)))
    flat, owner = np.concatenate([*rows, np.zeros(0, int)]).astype(int), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    diff = np.concatenate([np.concatenate(p) for p in pairs] or [np.zeros(0, int)]).astype(int)
    sign = np.concatenate([np.r_[np.ones(len(x)), -np.ones(len(y))] for x, y in pairs] or [np.zeros(0)])
    pair = np.repeat(np.arange(len(pairs)), [len(x) + len(y) for x, y in pairs])
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[flat], minlength=len(rows)) + b
        error = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = np.r_[np.bincount(flat, error[owner], minlength=width) + 2 * l2 * w, error.sum()]
        if len(pairs):
            change = np.bincount(pair, sign * w[diff], minlength=len(pairs))
            grad[:-1] += 2 * swap / len(pairs) * np.bincount(diff, sign * change[pair], minlength=width)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _class_frequencies(batches):
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), int)
        counts = np.zeros((2, 1 << BITS), np.int64)
        for y, buckets in zip(labels, text_sets(batch.column(2)), strict=True):
            counts[y, buckets] += 1
        at = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "clean", "toxic"])


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[dict[int, int], DataFrame]:
    """Labelled documents by class, and (doc_id, toxic, text) of at most ``sample`` of each class.

    Only ids are joined and drawn; the drawn ones, a bounded list, are broadcast to read their texts.
    """
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = save(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    drawn = first[0].unionByName(first[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return sizes, save(texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")), "sample")


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = 3000, features: int = 4096, least: int = 4) -> Model:
    """A model from texts (doc_id, text) and labels (doc_id, toxic 0/1), by default columns of ``docs`` too."""
    sizes, chosen = _sample(docs, docs if labels is None else labels, sample)
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS), 30.0 if 1 in sizes else -30.0)

    counted = chosen.mapInArrow(_class_frequencies, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    read = {y: min(n, sample) for y, n in sizes.items()}
    a, b = (F.col("toxic") + 0.5) / (read[1] + 1), (F.col("clean") + 0.5) / (read[0] + 1)
    gain = F.abs(F.log(a / b)) * F.sqrt(F.col("toxic") + F.col("clean"))
    top = counted.where(F.col("toxic") + F.col("clean") >= least).orderBy(gain.desc(), "bucket").limit(features).select("bucket").collect()
    buckets = np.sort(np.array([r["bucket"] for r in top], np.int64))

    def select(batches):
        def known(found):
            at = np.searchsorted(buckets, found)
            at = at[(at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == found)] if len(buckets) else at[:0]
            return at.astype(np.int32).tobytes()

        for batch in batches:
            own = [known(x) for x in text_sets(batch.column(2))]
            swapped = [swap_terms(t or "") for t in batch.column(2).to_pylist()]
            there = [i for i, s in enumerate(swapped) if s is not None]
            other = dict(zip(there, map(known, text_sets(pa.array([swapped[i] for i in there], pa.string()))), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.binary()), pa.array([other.get(i) for i in range(len(own))], pa.binary())], ["toxic", "own", "swapped"])

    rows = chosen.orderBy("doc_id").mapInArrow(select, "toxic int, own binary, swapped binary").collect()  # known features of the sample
    sets = [np.frombuffer(r["own"], np.int32) for r in rows]
    labels = np.array([r["toxic"] for r in rows], float)
    pairs = [(s, np.frombuffer(r["swapped"], np.int32)) for r, s in zip(rows, sets, strict=True) if r["swapped"] is not None]
    weight = np.where(labels == 1, sizes[1] / max(1, labels.sum()), sizes[0] / max(1, (1 - labels).sum())) / sum(sizes.values())
    w, b = fit_logistic(sets, labels, weight, pairs, len(buckets))
    full = np.zeros(1 << BITS)
    full[buckets] = w
    return Model(full, b)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
