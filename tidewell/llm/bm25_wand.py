"""Exact BM25 top-k search: block-max WAND on shards of an inverted index, merged globally.

Document frequencies, the number of documents and their mean length are counted over all documents
first, so a shard's scores are the global ones and its top k can simply be merged with the others'.

Equal texts have equal scores: one document of each text is searched, for one query of each text, and
the copies are joined to the results.

Documents are met in waves, drawn by a hash of their ids: the first is small, each later one has
WAVE - 1 times the documents before it. After a wave the k best so far of every query are merged
and their last (score, id) is the bar for the next wave: a shard prunes by it from its first document
and returns only what beats it, about k * (WAVE - 1) rows a query and wave, however many shards there are.

A shard is a slice of documents with its postings of the searched terms. A query of few terms walks
its lists, in blocks with their highest contribution, in step; a document is only scored if the
maxima of the lists, and then of the blocks, that reach it can still pass the bar. Over the terms of
a whole text the maxima add up to bounds that hardly prune, so a longer query sums all its lists
at once, and scores again exactly only what can pass the bar. Ties are never pruned: equal scores
are ordered by the smaller id.

Queries come in blocks of bounded (query, term) rows, each broadcast to its own waves.

Words are lower-cased runs of letters and digits. Defined cases: rows with a null id are ignored; null
and empty texts are documents of length 0 and match nothing; a query without known terms has no
results; repeated rows are all found; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.words import MARKS, U64, slices, text_buffers
from tidewell.scratch import save

BLOCK = 64  # postings in a block
ROWS = 4_000_000  # (query, term) rows in one broadcast
WAND_TERMS = 16  # known terms up to which a query is searched by WAND
SHARD = 20_000  # documents in a shard
POSTINGS = 6_000_000  # postings from which a shard takes no more documents
START = 2_500  # documents in the first wave
SHARD_BYTES = 32_000_000  # text of a shard whose terms are counted, if it has several documents
WAVE = 4  # growth of the documents met from wave to wave
GROUP = 2048  # queries with the same common terms
KINDS = 6  # kinds of queries by their most frequent term
PRODUCT = 128  # queries whose sums over common terms are formed at once
COMMON = 250  # a term is common if at least one in so many pairs of a query of the group and a document of the shard share it
FIRST = 8  # blocks of a shard that give a walk its first bar
ROOM = 1e-3  # relative room for the error of sums in single precision


def _tokens(column: pa.Array):
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    return slices(lowered, lower=False, space=MARKS)


def _term_counts(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of the slice, term, occurrences), sorted by document and term."""
    owner = np.repeat(np.arange(words.docs), np.diff(words.offsets))
    order = np.lexsort((words.hashes, owner))
    owner, terms = owner[order], words.hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])
    at = np.flatnonzero(new)
    return owner[at], terms[at], np.diff(np.append(at, len(owner)))


def _shards(batches):
    """The columns of runs of documents that are bounded in rows and in bytes of text, the last column."""
    kept, rows, size = [], 0, 0

    def joined():
        return [pa.concat_arrays([b.column(i) for b in kept]) for i in range(kept[0].num_columns)]

    for batch in batches:
        while batch.num_rows:
            ends = text_buffers(batch.column(batch.num_columns - 1))[0]
            fits = int(np.searchsorted(ends, ends[0] + SHARD_BYTES - size, "right")) - 1
            taken = min(batch.num_rows, SHARD - rows, max(fits, 0 if kept else 1))
            kept.append(batch.slice(0, taken))
            rows, size = rows + taken, size + int(ends[taken] - ends[0])
            batch = batch.slice(taken)
            if batch.num_rows or rows == SHARD:
                yield joined()
                kept, rows, size = [], 0, 0
    if kept:
        yield joined()


def _frequencies(batches):
    """(term, df, tokens) of each shard; the row without a term counts documents and tokens."""
    for (texts,) in _shards(batches):
        seen, tokens = [], 0
        for words in _tokens(texts):
            seen.append(_term_counts(words)[1])
            tokens += len(words.hashes)
        terms, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, U64), np.zeros(0, np.int64))
        del seen
        term = pa.concat_arrays([pa.array(terms.view(np.int64)), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([term, pa.array(np.append(counts, len(texts))), pa.array(np.append(np.zeros(len(terms), np.int64), tokens))], ["term", "df", "tokens"])


def _query_terms(batches):
    for batch in batches:
        for words in _tokens(batch.column(1)):
            owner, terms, _ = _term_counts(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + words.first)), pa.array(terms.view(np.int64))], ["query_id", "term"])


class Posting:
    """One term's documents in a shard, with their contributions and block maxima."""

    __slots__ = ("docs", "values", "block", "ends", "top")

    def __init__(self, docs: np.ndarray, values: np.ndarray):
        self.docs, self.values = docs.tolist(), values.tolist()
        self.block = [max(self.values[i : i + BLOCK]) for i in range(0, len(self.values), BLOCK)]
        self.ends = [self.docs[min(i + BLOCK, len(self.docs)) - 1] for i in range(0, len(self.docs), BLOCK)]
        self.top = max(self.block)


def top_k(lists: list[Posting], ids: list, k: int, least: float = 0.0) -> list[tuple[float, object]]:
    """The k best (score, id) of a shard, in no order; ids[d] names document d of the postings.

    Documents that score less than ``least`` may be missing.
    """
    slack = 1 + 1e-12
    heap: list[tuple[float, object]] = []
    at = [0] * len(lists)
    live = sorted(range(len(lists)), key=lambda i: lists[i].docs[0])
    while live:
        bound, pivot = 0.0, -1
        for n, i in enumerate(live):
            bound += lists[i].top
            if bound * slack >= least:
                pivot = n
                break
        if pivot < 0:
            break
        doc = lists[live[pivot]].docs[at[live[pivot]]]
        while pivot + 1 < len(live) and lists[live[pivot + 1]].docs[at[live[pivot + 1]]] == doc:
            pivot += 1
        if lists[live[0]].docs[at[live[0]]] == doc:
            reach = sum(lists[i].block[at[i] // BLOCK] for i in live[: pivot + 1])
            if reach * slack >= least:
                score = 0.0
                for i in sorted(live[: pivot + 1]):
                    score += lists[i].values[at[i]]
                    at[i] += 1
                entry = (score, _Reversed(ids[doc]))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    least = max(least, heap[0][0])
            else:  # no document before the nearest block end, or the next list, can enter
                to = min(lists[i].ends[at[i] // BLOCK] for i in live[: pivot + 1]) + 1
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]].docs[at[live[pivot + 1]]])
                for i in live[: pivot + 1]:
                    at[i] = bisect_left(lists[i].docs, max(to, doc + 1), at[i])
        else:
            for i in live[:pivot]:
                if lists[i].docs[at[i]] < doc:
                    at[i] = bisect_left(lists[i].docs, doc, at[i])
        live = sorted((i for i in live if at[i] < len(lists[i].docs)), key=lambda i: lists[i].docs[at[i]])
    return [(score, name.id) for score, name in heap]


class _Reversed:
    """Orders ids downwards, so that of equal scores the largest id leaves the heap first."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other):
        return other.id < self.id

    def __eq__(self, other):
        return self.id == other.id


class QueryBlock:
    """Queries of one pass: the terms of query i are ``places[starts[i]:starts[i + 1]]``, in order.

    Queries that share a frequent term, as texts of one language do, are neighbours by their number of terms;
    ``groups`` are runs of them.
    """

    def __init__(self, rows: list[tuple], documents: int, mean: float, k: int, k1: float, b: float):
        self.k, self.k1, self.b, self.mean = k, k1, b, max(mean, 1e-9)
        self.ids = [query for query, _, _ in rows]
        self.starts = np.append(0, np.cumsum([len(terms) for _, terms, _ in rows]))
        self.terms, first, places = np.unique(np.concatenate([terms for _, terms, _ in rows]).view(U64), return_index=True, return_inverse=True)
        df = np.concatenate([n for _, _, n in rows])[first].astype(float)
        self.idf = np.log(1 + (documents - df + 0.5) / (df + 0.5))
        # terms are found by their first bits, of which few share the same
        self.shift = U64(64 - max(8, len(self.terms).bit_length() + 2))
        heads = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.int64)
        self.heads = np.searchsorted((self.terms >> self.shift).astype(np.int64), heads).astype(np.int32)
        owner = np.repeat(np.arange(len(rows)), np.diff(self.starts))
        self.places = places[np.lexsort((places, owner))].astype(np.int32)
        self.groups = self._groups(owner)

    def _groups(self, owner: np.ndarray) -> list[np.ndarray]:
        """All queries: first those that are walked, then by the most frequent terms of the others, each time among those left."""
        sizes = np.diff(self.starts)
        kind = np.where(sizes <= WAND_TERMS, 0, KINDS)
        for n in range(1, KINDS):
            left = kind[owner] == KINDS
            if not left.any():
                break
            term = np.bincount(self.places[left]).argmax()
            kind[owner[left & (self.places == term)]] = n
        order = np.lexsort((sizes, kind))
        edges = np.flatnonzero(np.diff(kind[order])) + 1
        return [run[i : i + GROUP] for run in np.split(order, edges) for i in range(0, len(run), GROUP)]

    def lookup(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are searched terms, and the places of these."""
        head = (found >> self.shift).astype(np.int64)
        at, end = self.heads[head], self.heads[head + 1]
        open_ = np.flatnonzero(at < end)
        place = np.full(len(found), -1, np.int32)
        while len(open_):
            here = at[open_]
            equal = self.terms[here] == found[open_]
            place[open_[equal]] = here[equal]
            at[open_] += 1
            open_ = open_[~equal & (here + 1 < end[open_])]
        hit = np.flatnonzero(place >= 0)
        return hit, place[hit].astype(np.int64)

    def postings(self, column: pa.Array, first: int = 0):
        """(term, document, contribution) of each slice of the texts, by term; documents are numbered from ``first``."""
        for words in _tokens(column):
            length = np.diff(words.offsets)
            hit, at = self.lookup(words.hashes)
            owner = np.repeat(np.arange(words.docs), length)[hit]
            pairs, n = np.unique(at << 32 | owner, return_counts=True)
            term, doc, tf = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), n.astype(float)
            yield term, doc + np.int32(first + words.first), self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[doc] / self.mean))

    def search(self, ids: list, column: pa.Array, best: dict[int, list], bars: dict[int, tuple]):
        """Merge the shard that these documents form into ``best``: of query i the k best (score, id) so far that beat its bar."""
        self.search_postings(ids, list(self.postings(column)), best, bars)

    def search_postings(self, ids: list, parts: list[tuple], best: dict[int, list], bars: dict[int, tuple]):
        """``search`` for documents whose postings are at hand, in slices; the list is emptied."""
        if not sum(len(x[0]) for x in parts):
            return
        term, doc, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(term, kind="stable")  # documents ascend already
        term, doc, value = term[order], doc[order], value[order]
        del order
        least = np.zeros(len(self.ids))
        for i in range(len(self.ids)):
            before, bar = best.get(i, ()), bars.get(i)
            least[i] = max(before[-1][0] if len(before) >= self.k else 0.0, bar[0] if bar else 0.0)
        shard = Shard(term, doc, value, len(ids), len(self.terms))
        del term, doc, value
        for group in self.groups:
            lists = [self.places[self.starts[i] : self.starts[i + 1]] for i in group.tolist()]
            if len(lists[0]) <= WAND_TERMS:
                answers = (top_k(shard.lists(x, bar, self.k), ids, self.k, bar) for x, bar in zip(lists, least[group].tolist(), strict=True))
            else:
                answers = shard.best(lists, least[group], ids, self.k)
            self._merge(zip(group.tolist(), answers, strict=True), best, bars)

    def _merge(self, answers, best: dict[int, list], bars: dict[int, tuple]):
        for i, found in answers:
            bar = bars.get(i)
            if bar:
                found = [x for x in found if x[0] > bar[0] or (x[0] == bar[0] and x[1] < bar[1])]
            if found:
                best[i] = sorted(best.get(i, []) + found, key=lambda x: (-x[0], x[1]))[: self.k]


class Shard:
    """Postings of the searched terms in a slice of documents, by term and by document.

    Terms that many queries of a group share with many documents are also rows of a matrix in single
    precision: the group's sums over them are products. They only choose which documents are scored, with room for error.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int, terms: int):
        self.term, self.doc, self.value, self.docs = term, doc.astype(np.intp, copy=False), value, docs
        self.sizes = np.bincount(term, minlength=terms)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.room = np.empty(0, np.intp), np.empty(0)
        self.maxima: dict[int, np.ndarray] = {}

    def part(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """A term's documents and contributions."""
        found = slice(int(self.starts[t]), int(self.starts[t] + self.sizes[t]))
        return self.doc[found], self.value[found]

    def block_maxima(self, t: int) -> np.ndarray:
        """A term's highest contribution in each block of BLOCK neighbouring documents."""
        if t not in self.maxima:
            docs, values = self.part(t)
            block = docs // BLOCK
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            self.maxima[t] = np.zeros(self.docs // BLOCK + 1)
            self.maxima[t][block[at]] = np.maximum.reduceat(values, at)
        return self.maxima[t]

    def lists(self, asked: np.ndarray, least: float, k: int) -> list[Posting]:
        """Lists to walk for the terms asked, without the documents whose blocks' maxima stay below ``least``.

        Without a bar, the k-th best of the blocks with the highest maxima is one.
        """
        terms = [t for t in asked.tolist() if self.sizes[t]]
        if not terms:
            return []
        maxima = [self.block_maxima(t) for t in terms]
        bound = sum(maxima) * (1 + 1e-12)
        docs, values = (np.concatenate(x) for x in zip(*(self.part(t) for t in terms), strict=True))
        block, owner = docs // BLOCK, np.repeat(np.arange(len(terms)), self.sizes[terms])
        if not least and len(bound) > FIRST:
            tried = np.zeros(len(bound), bool)
            tried[np.argpartition(bound, -FIRST)[-FIRST:]] = True
            tried = tried[block]
            scores = np.bincount(docs[tried], values[tried], self.docs)
            if np.count_nonzero(scores) >= k:
                least = np.partition(scores, -k)[-k] * (1 - 1e-12)
        if not least:
            return [Posting(*self.part(t)) for t in terms]
        keep = np.flatnonzero((bound >= least)[block])
        docs, values, block, owner = docs[keep], values[keep], block[keep], owner[keep]
        reach = np.bincount(docs, np.stack(maxima)[owner, block], self.docs) * (1 + 1e-12)
        keep = np.flatnonzero((reach >= least)[docs])
        docs, values, owner = docs[keep], values[keep], owner[keep]
        edges = np.flatnonzero(np.diff(owner)) + 1
        return [Posting(d, v) for d, v in zip(np.split(docs, edges), np.split(values, edges), strict=True)] if len(docs) else []

    def best(self, lists: list[np.ndarray], least: np.ndarray, ids: list, k: int) -> list[list[tuple[float, object]]]:
        """Of each query, by all its terms, the k best (score, id) of at least its ``least``."""
        wanted = np.bincount(np.concatenate(lists), minlength=len(self.sizes))
        common = np.flatnonzero(self.sizes * wanted * COMMON >= self.docs * len(lists))
        row = np.full(len(self.sizes), -1)
        row[common] = np.arange(len(common))
        matrix = np.zeros((len(common), self.docs), np.float32)
        for n, t in enumerate(common.tolist()):
            docs, values = self.part(t)
            matrix[n, docs] = values
        found = []
        for low in range(0, len(lists), PRODUCT):
            some = lists[low : low + PRODUCT]
            weights = np.zeros((len(some), len(matrix)), np.float32)
            for i, asked in enumerate(some):
                at = row[asked]
                weights[i, at[at >= 0]] = 1
            for asked, sums, bar in zip(some, weights @ matrix, least[low : low + PRODUCT].tolist(), strict=True):
                near = self.add(asked[row[asked] < 0]) + sums
                passed = np.flatnonzero(near >= bar * (1 - ROOM)) if bar else np.flatnonzero(near)
                if len(passed) > k:
                    passed = passed[near[passed] >= np.partition(near[passed], -k)[-k] * (1 - ROOM)]
                found.append(passed)
        return self.scored(lists, found, ids, k)

    def add(self, terms: np.ndarray) -> np.ndarray:
        """The sum of these terms' lists, by document."""
        sizes = self.sizes[terms]
        terms, sizes = terms[sizes > 0], sizes[sizes > 0]
        flat = _ranges(self.starts[terms], sizes)
        if len(flat) > len(self.room[0]):
            self.room = np.empty(2 * len(flat), np.intp), np.empty(2 * len(flat))
        docs, values = self.room[0][: len(flat)], self.room[1][: len(flat)]
        np.take(self.doc, flat, out=docs, mode="clip")
        np.take(self.value, flat, out=values, mode="clip")
        return np.bincount(docs, values, self.docs)

    def scored(self, lists: list[np.ndarray], found: list[np.ndarray], ids: list, k: int) -> list[list[tuple[float, object]]]:
        """The k best (score, id) of each query among the documents found for it.

        In double precision, always added in the order of the terms: equal documents have equal scores.
        """
        wanted = np.zeros(self.docs, bool)
        for docs in found:
            wanted[docs] = True
        flat = np.flatnonzero(wanted[self.doc])
        flat = flat[np.argsort(self.doc[flat], kind="stable")]  # of one document, by term
        term_of, value_of = self.term[flat], self.value[flat]
        doc_sizes = np.bincount(self.doc[flat], minlength=self.docs)
        doc_starts = np.cumsum(doc_sizes) - doc_sizes
        open_, answers = np.zeros(len(self.sizes), bool), []
        for asked, docs in zip(lists, found, strict=True):
            if not len(docs):
                answers.append([])
                continue
            lengths = doc_sizes[docs]
            flat = _ranges(doc_starts[docs], lengths)
            open_[asked] = True
            hit = np.flatnonzero(open_[term_of[flat]])
            open_[asked] = False
            scores = np.bincount(np.repeat(np.arange(len(docs)), lengths)[hit], value_of[flat[hit]], len(docs))
            if len(scores) > k:
                kept = scores >= np.partition(scores, -k)[-k]
                docs, scores = docs[kept], scores[kept]
            answers.append(sorted(zip(scores.tolist(), (ids[d] for d in docs), strict=True), key=lambda x: (-x[0], x[1]))[:k])
        return answers


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents (doc_id, text) of each query (query_id, text).

    A query is a whole text and is searched by all of its words that any document has, each once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    queries = queries.select("query_id", "text").where("query_id is not null").dropDuplicates(["query_id"])
    kinds = docs.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kinds[1]}, doc_id {kinds[0]}, score double"
    counted = docs.select("text").mapInArrow(_frequencies, "term long, df long, tokens long")
    frequencies = save(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")), "frequencies")
    documents, tokens = (n or 0 for n in frequencies.where("term is null").agg(F.max("df"), F.max("tokens")).first())
    heads, copies = _classes(docs, k)
    alike = save(queries.withColumn("first", F.min("query_id").over(Window.partitionBy(_digest()))).select("query_id", "first", F.when(F.col("query_id") == F.col("first"), F.col("text")).alias("text")), "queries")
    asked = alike.where(F.col("query_id") == F.col("first")).select("query_id", "text").mapInArrow(_query_terms, f"query_id {kinds[1]}, term long").join(frequencies.select("term", "df"), "term")
    asked = save(asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "df")).alias("x")).select("query_id", "x.term", "x.df"), "asked")
    waves = _waves(heads, documents)
    result = spark.createDataFrame([], schema)
    for rows in _blocks(asked):
        block = spark.sparkContext.broadcast(QueryBlock(rows, documents, tokens / max(documents, 1), k, k1, b))
        best, bars = None, {}
        for n, wave in enumerate(waves, 1):
            shared = spark.sparkContext.broadcast(bars)
            found = wave.mapInArrow(_scan(block, shared, to_arrow_type(queries.schema["query_id"].dataType)), schema)
            best = save(_ranked(found if best is None else best.drop("rank").unionByName(found), k), "best")
            if n < len(waves):
                at = {query: i for i, (query, _, _) in enumerate(rows)}
                bars = {at[r["query_id"]]: (r["score"], r["doc_id"]) for r in best.where(F.col("rank") == k).toLocalIterator()}
        result = result.unionByName(best.drop("rank"))
    if copies is not None:
        result = result.unionByName(result.withColumnRenamed("doc_id", "head").join(copies, "head").select("query_id", "doc_id", "score"))
    result = _ranked(result, k).withColumnRenamed("query_id", "first").join(alike.select("query_id", "first"), "first")
    return result.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _digest():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _classes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """One document, the first, of each text, and (head, doc_id) of its next k - 1 copies.

    Copies have equal scores, so those of the k best texts have the k best documents. Where ids repeat,
    all rows are searched.
    """
    keys = save(docs.select("doc_id", _digest().alias("digest")), "digests")
    rows, ids, texts = keys.agg(F.count("*"), F.count_distinct("doc_id"), F.count_distinct("digest")).first()
    if ids < rows or texts == rows:
        return docs, None
    heads = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))
    early = keys.withColumn("place", place).where(F.col("place") <= k)
    copies = save(early.where("place > 1").drop("place").join(heads.withColumnRenamed("doc_id", "head"), "digest").select("head", "doc_id"), "copies")
    # by digest and id together: copies of one text are dealt to all tasks
    return docs.withColumn("digest", _digest()).join(heads.hint("shuffle_hash"), ["digest", "doc_id"], "left_semi").drop("digest"), copies


def _waves(docs: DataFrame, documents: int) -> list[DataFrame]:
    """The documents in waves, of which each but the first is WAVE - 1 times as large as all before it; written once."""
    every = max(1, -(-documents // min(START, SHARD)))  # the first wave is about one document of so many
    ends = [every]
    while ends[0] > 1:
        ends.insert(0, -(-ends[0] // WAVE))
    if len(ends) == 1:
        return [docs.repartition(1)]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(every))
    wave = sum((F.when(place >= end, 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    written = save(docs.withColumn("wave", wave), "waves", ("wave",))
    cores, waves = docs.sparkSession.sparkContext.defaultParallelism, []
    for n, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
        size = documents * (high - low) // every
        tasks = max(1, -(-size // SHARD), min(cores, size // START))
        if tasks > cores:
            tasks = -(-tasks // cores) * cores
        waves.append(written.where(F.col("wave") == n).select(*docs.columns).coalesce(tasks))
    return waves


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(asked: DataFrame):
    """(query, terms, document frequencies) of whole queries, with at most ROWS terms or one query at a time."""
    rows, size = [], 0
    for r in asked.toLocalIterator():
        if rows and size + len(r["term"]) > ROWS:
            yield rows
            rows, size = [], 0
        size += len(r["term"])
        rows.append((r["query_id"], np.array(r["term"], np.int64), np.array(r["df"], np.int64)))
    if rows:
        yield rows


def _scan(block, bars, queries: pa.DataType):
    def run(batches):
        known: QueryBlock = block.value
        best, kind, ids, parts, size = {}, pa.null(), [], [], 0
        for batch in batches:
            kind = batch.column(0).type
            for low in range(0, batch.num_rows, SHARD):
                column = batch.column(1).slice(low, SHARD)
                if ids and (len(ids) + len(column) > SHARD or size > POSTINGS):
                    known.search_postings(ids, parts, best, bars.value)
                    ids, parts, size = [], [], 0
                parts += known.postings(column, len(ids))
                ids += batch.column(0).slice(low, SHARD).to_pylist()
                size = sum(len(x[0]) for x in parts)
        known.search_postings(ids, parts, best, bars.value)
        found = [(known.ids[i], doc, score) for i, rows in best.items() for score, doc in rows]
        for low in range(0, len(found), 10_000):
            query, doc, score = zip(*found[low : low + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, queries), pa.array(doc, kind), pa.array(score, pa.float64())], ["query_id", "doc_id", "score"])

    return run
