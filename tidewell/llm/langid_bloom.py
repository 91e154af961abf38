"""Language identification by n-gram filters that answer for all languages at once.

A bit-sliced Bloom filter holds in every slot one bit per language; the AND of an n-gram's slots is
the mask of the languages that contain it. A text's n-grams are counted per language (a popcount of
each mask bit), the count is corrected for the false positives that the language's fill predicts,
and the largest corrected count decides (the smaller name between equals).

A language contains the n-grams that a share of its learning documents have, unless another
language has them far more often. Learning reads ``sample`` documents of each language on average
(drawn by a hash of their ids, all where there are fewer); prediction reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where
nothing was learned; a text with no known n-gram gets the most frequent language with score 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import MARKS, U64, mix64, text_buffers

N = 4
HASHES = 3
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[MARKS] = 0x20
_LETTER = re.compile(r"[^\W\d_]")


def gram_windows(column: pa.Array, size: int = 1 << 20):
    """(first row, bounds, grams) of slices of texts: row first+i has grams[bounds[i]:bounds[i+1]] less its last N-1."""
    before, after, joint = (pa.scalar(x, pa.large_string()) for x in (" ", "  ", ""))
    padded = pc.binary_join_element_wise(before, pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), after, joint)
    offsets, data = text_buffers(padded)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        part = _BLANK[data[offsets[at] : offsets[to]]].astype(np.uint32)
        m = len(part) - N + 1
        grams = part[:m].copy()
        for j in range(1, N):
            grams |= part[j : j + m] << np.uint32(8 * j)
        yield at, offsets[at : to + 1] - offsets[at], grams
        at = to


@dataclass
class Filters:
    """The slots, one bit a language, with each language's false-positive rate and the commonest language."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    common: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        h = mix64(grams.astype(U64) + U64(0x51ED270B))
        step, top = (h >> U64(32)) | U64(1), U64(len(self.slots) - 1)
        out = self.slots[h & top]
        for _ in range(HASHES - 1):
            h = h + step
            out = out & self.slots[h & top]
        return out

    def counts(self, bounds: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Corrected counts: a row for each text, a column for each language."""
        masks = self.masks(grams)
        totals = np.diff(bounds) - N + 1
        out = np.zeros((len(totals), len(self.languages)))
        for i in range(len(self.languages)):
            run = np.zeros(len(masks) + 1, np.int64)
            np.cumsum((masks >> masks.dtype.type(i)) & masks.dtype.type(1), out=run[1:])
            out[:, i] = run[bounds[1:] - N + 1] - run[bounds[:-1]]
        return np.maximum(0.0, (out - totals[:, None] * self.rates) / (1 - self.rates))


def build(languages: list[str], grams: np.ndarray, holders: np.ndarray, common: int) -> Filters:
    """Filters of at least 16 slots for each distinct n-gram; ``holders[i]`` is the index of a language that has grams[i]."""
    kinds = [np.uint8, np.uint16, np.uint32, np.uint64]
    kind = next((k for k in kinds if len(languages) <= 8 * np.dtype(k).itemsize), None)
    if kind is None:
        raise ValueError("at most 64 languages")
    slots = np.zeros(1 << int(np.ceil(np.log2(16 * max(64, len(np.unique(grams)))))), kind)
    h = mix64(grams.astype(U64) + U64(0x51ED270B))
    step, top = (h >> U64(32)) | U64(1), U64(len(slots) - 1)
    for _ in range(HASHES):
        np.bitwise_or.at(slots, h & top, (np.ones(len(grams), kind) << holders.astype(kind)))
        h = h + step
    fill = np.array([np.mean((slots >> kind(i)) & kind(1)) for i in range(len(languages))])
    return Filters(languages, slots, fill**HASHES, common)


def _gram_frequencies(batches):
    """(lang, gram, n): in how many of the texts of a language an n-gram occurs."""
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        langs = batch.column(0).to_pylist()
        for first, bounds, grams in gram_windows(batch.column(1)):
            for i in range(len(bounds) - 1):
                own = np.unique(grams[bounds[i] : bounds[i + 1] - N + 1])
                by_lang.setdefault(langs[first + i], []).append(own)
        for lang, found in by_lang.items():
            grams, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def learn(docs: DataFrame, sample: int = 1500, share: float = 0.01, contrast: float = 0.25) -> Filters | None:
    """Filters from labelled documents (doc_id, lang, text) with a non-null ``lang``; None without any."""
    labelled = docs.where("lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    bound = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(1_000_000 * sample // size)) for lang, size in sizes.items()])
    chosen = labelled.where(draw < bound)
    counted = chosen.select("lang", "text").mapInArrow(_gram_frequencies, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(max(1.0, share * min(sample, size)))) for lang, size in sizes.items()])
    rows = summed.where(F.col("n") >= least).collect()  # at most 1 / share n-grams for each n-gram of a text
    index = {lang: i for i, lang in enumerate(languages)}
    grams = np.array([r["gram"] for r in rows], np.uint32)
    holders = np.array([index[r["lang"]] for r in rows], np.int64)
    rate = np.array([r["n"] / min(sample, sizes[r["lang"]]) for r in rows])
    distinct, at = np.unique(grams, return_inverse=True)
    best = np.zeros(len(distinct))
    np.maximum.at(best, at, rate)
    kept = rate >= contrast * best[at] if len(rows) else np.zeros(0, bool)
    common = index[max(languages, key=lambda lang: (sizes[lang], lang))]
    return build(languages, grams[kept], holders[kept], common)


def identify(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text); the score is the winner's share of the counts."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        known = shared.value
        for batch in batches:
            texts = batch.column(1)
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if known is not None:
                lettered = [t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()]
                for first, bounds, grams in gram_windows(texts):
                    counts = known.counts(bounds, grams)
                    total, best = counts.sum(axis=1), counts.argmax(axis=1)
                    for i in range(len(total)):
                        if lettered[first + i]:
                            names[first + i] = known.languages[best[i] if total[i] > 0 else known.common]
                            scores[first + i] = counts[i, best[i]] / total[i] if total[i] > 0 else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
