"""Benchmark items in documents, by embedding edit distance into Hamming distance.

Words are lower-cased runs of letters and digits. A document holds an item of n words if some run of
its words is within floor(share * n) word edits of it.

1. Seeds. An item within k edits keeps one of k+1 pieces of it unchanged, so only regions around an
   unchanged piece can hold it: this loses nothing and leaves few item-sized windows.
2. CGK embedding. The item-sized windows of a region are walked: at each step a keyed bit of the
   current word and step says whether to advance. Windows few edits apart fall into step again, so
   their walks agree in many places; unrelated ones agree by chance. Bit-sampling LSH compares
   ``samples`` places of both walks, drawn where walks are still inside their windows (LIVE steps a
   word); a window is a candidate if any draw over any of WALKS walks agrees. There are so many draws
   that pairs at the limit are found with at least ``recall`` (tests measure it), while few of the
   unrelated regions pass.
3. The exact edit distance between the item and the best run inside the region decides.

Items are met in blocks of bounded size, each broadcast, so memory doesn't grow with the benchmark.

Defined cases: null or empty texts and items hold nothing; repeated rows are all reported; an empty
benchmark gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.words import MARKS, U64, mix64, slices, stream

BLOCK = 4000  # items in one broadcast
WALKS = 12  # independent walks that places are drawn from
LIVE = 1.4  # steps a word at which most walks haven't left their window
FILTER_BITS = 22


def repetitions(samples: int, recall: float, differing: float = 0.55) -> int:
    """Draws of ``samples`` places that find two walks differing in that share of places with ``recall``.

    Draws from one walk aren't independent, so there are twice as many as if they were.
    """
    return 2 * math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing) ** samples))


def item_words(column: pa.Array) -> list[np.ndarray]:
    """Word hashes of each text."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    return [w.hashes[w.offsets[i] : w.offsets[i + 1]] for w in slices(lowered, lower=False, space=MARKS) for i in range(w.docs)]


def embed(windows: np.ndarray, steps: int, seed: int = 77) -> np.ndarray:
    """The CGK walks of windows of equal length: [walk, window, step] is the word under the walker, 0 once it is past the end."""
    count, n = windows.shape
    keys = stream(seed, WALKS * steps).reshape(WALKS, steps, 1)
    padded = np.concatenate([windows, np.zeros((count, 1), U64)], axis=1)
    row = np.arange(count)
    at = np.zeros((WALKS, count), np.int64)
    out = np.zeros((WALKS, count, steps), U64)
    for j in range(steps):
        word = padded[row, at]
        out[:, :, j] = word
        at += ((word ^ keys[:, j]) * U64(0x9E3779B97F4A7C15) >> U64(63)).astype(np.int64)
        np.minimum(at, n, out=at)
    return out


def edit_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any run of the region, and where that run ends."""
    row = np.arange(len(item) + 1)
    best, end = row[-1], 0
    ramp = np.arange(len(item) + 1)
    for j, word in enumerate(region, 1):
        new = np.empty_like(row)
        new[0] = 0
        new[1:] = np.minimum(row[:-1] + (item != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        if row[-1] < best:
            best, end = row[-1], j
    return int(best), end


class Items:
    """A block of items: pieces by length, sampled walks and limits."""

    def __init__(self, ids: list, words: list[np.ndarray], share: float, samples: int, recall: float):
        self.rows = [(i, w, int(share * len(w) + 1e-9)) for i, w in zip(ids, words, strict=True) if len(w)]
        self.samples, self.draws = samples, math.ceil(repetitions(samples, recall) / WALKS)
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for at, (_, w, k) in enumerate(self.rows):
            edges = [round(j * len(w) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                value = int(_gram(w[a:b]))
                pieces.setdefault(b - a, {}).setdefault(value, []).append((at, a))
        self.pieces = pieces
        self.sorted = {n: np.sort(np.array(list(p), U64)) for n, p in pieces.items()}
        self.filters = {}
        for n, values in self.sorted.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[values >> U64(64 - FILTER_BITS)] = True
            self.filters[n] = bits
        self.sampled: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def agrees(self, item: int, windows: np.ndarray) -> bool:
        """Whether any draw of places finds a window's walk equal to the item's."""
        words = self.rows[item][1]
        steps = max(1, int(LIVE * len(words)))
        if item not in self.sampled:
            places = (stream(1000, WALKS * self.draws * self.samples) % U64(steps)).astype(np.int64).reshape(WALKS, -1)
            own = embed(words[None, :], steps)[:, 0]
            self.sampled[item] = places, np.take_along_axis(own, places, axis=1)
        places, own = self.sampled[item]
        found = np.take_along_axis(embed(windows, steps), places[:, None, :], axis=2) == own[:, None, :]
        return bool(found.reshape(WALKS, len(windows), self.draws, self.samples).all(axis=3).any())

    def search(self, words: np.ndarray, grams: dict[int, np.ndarray], lookup) -> list[tuple]:
        """(item id, edits, first word, words of the item) for the items that one document holds."""
        found: dict[int, tuple[int, int]] = {}
        regions: dict[int, set[int]] = {}
        for n, at in grams.items():
            for p in at:
                for item, offset in self.pieces[n][int(lookup(n, p))]:
                    regions.setdefault(item, set()).add(int(p) - offset)
        for item, starts in regions.items():
            _, target, k = self.rows[item]
            for start in sorted(starts):
                low, high = max(0, start - k), min(len(words), start + len(target) + k)
                region = words[low:high]
                if item in found and found[item][0] == 0:
                    break
                result = self._judge(item, region.tobytes())
                if result is not None and (item not in found or result[0] < found[item][0]):
                    found[item] = (result[0], low + max(0, result[1] - len(target)))
        return [(self.rows[i][0], e, s, len(self.rows[i][1])) for i, (e, s) in sorted(found.items())]

    @lru_cache(maxsize=50_000)  # passages that many documents share are judged once a process
    def _judge(self, item: int, region: bytes) -> tuple[int, int] | None:
        _, target, k = self.rows[item]
        words = np.frombuffer(region, U64)
        if len(words) < len(target):
            words = np.concatenate([words, np.zeros(len(target) - len(words), U64)])
        if not self.agrees(item, np.lib.stride_tricks.sliding_window_view(words, len(target))):
            return None
        edits, end = edit_within(target, words)
        return (edits, end) if edits <= k else None


def _gram(words: np.ndarray) -> np.uint64:
    weights = stream(101 + len(words), len(words)) | U64(1)
    return mix64(np.array([(words * weights).sum(dtype=U64)], U64))[0]


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, samples: int = 3, recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, edits, n_words, first_word) of the benchmark items (item_id, text) that documents hold."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, n_words int, first_word long"
    result = spark.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(ids, item_words(pa.array(texts, pa.string())), share, samples, recall))
        result = result.unionByName(docs.mapInArrow(_scan(shared, to_arrow_type(benchmark.schema["item_id"].dataType)), schema))
    return result


def _blocks(benchmark: DataFrame):
    """(ids, texts) of bounded size, streamed through the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if len(ids) >= BLOCK or size >= 8_000_000:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _held(items: Items, column: pa.Array):
    """(row, item id, edits, words of the item, first word) for each item that a text holds."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    for words in slices(lowered, lower=False, space=MARKS):
        hits = {}
        for n, filled in items.filters.items():
            grams = words.ngrams(n, seed=n)
            at = np.flatnonzero(filled[grams >> U64(64 - FILTER_BITS)])
            at = at[np.isin(grams[at], items.sorted[n])]
            owner = np.searchsorted(words.offsets, at, "right") - 1
            inside = at + n <= words.offsets[owner + 1]
            hits[n] = (grams, at[inside], owner[inside])
        for i in np.unique(np.concatenate([o for _, _, o in hits.values()])) if hits else ():
            a, b = words.offsets[i], words.offsets[i + 1]
            own = {n: at[np.searchsorted(o, i) : np.searchsorted(o, i, "right")] - a for n, (_, at, o) in hits.items()}
            for item, edits, start, size in items.search(words.hashes[a:b], own, lambda n, p, a=a, hits=hits: hits[n][0][a + p]):
                yield words.first + int(i), item, edits, size, start


def _scan(shared, ids: pa.DataType):
    types = [ids, pa.int32(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = list(_held(shared.value, batch.column(1)))
            row, *rest = zip(*rows, strict=True) if rows else [[]] * 5
            columns = [batch.column(0).take(pa.array(row, pa.int64()))] + [pa.array(c, t) for c, t in zip(rest, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "n_words", "first_word"])

    return run


def _drop(shared, at: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _held(shared.value, batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_leaked(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, samples: int = 3, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for ids, texts in _blocks(benchmark):
        items = Items(ids, item_words(pa.array(texts, pa.string())), share, samples, recall)
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(items), docs.columns.index("text")), docs.schema)
    return docs
