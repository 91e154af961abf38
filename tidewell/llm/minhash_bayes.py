"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every document becomes its set of distinct k-word shingles (a shorter text is one shingle), a
   digest of the set and MinHash band keys. Documents with equal sets form one class; classes are
   what is compared, so copies never meet each other. Sets and signatures are kept of those
   classes alone that share a band with another one.
2. Classes that agree on any band of the signature are candidates. A bucket of classes isn't
   expanded into pairs: each round tests its members against one centre. Buckets that still hold
   several components once a round finds few links are searched in blocks, across components
   only, so no link between components is lost.
3. A pair's signatures are compared batch by batch. The matches so far give a posterior of the
   similarity (uniform prior); a pair is dropped as soon as the chance that it reaches the
   threshold is below ``miss``. The search in blocks, where most pairs are near misses, goes on
   from 192 to 704 hashes. What remains is verified on the full sets.
4. Components over the verified links give each document its component and the kept one.

Bands of 6 rows miss a pair at similarity 0.8 with probability (1 - 0.8^6)^32 = 6e-5 (0.85: 3e-7).
Signatures are compared by 8 bits of each hash: chance agreements only keep pairs that the exact
step then drops.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; a null id
is kept and linked with nothing; repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.graph import components
from tidewell.llm.words import U64, Words, mix64, slices, stream
from tidewell.scratch import save

BANDS, ROWS = 32, 6
SIGNATURE = BANDS * ROWS
LONG = SIGNATURE + 512
BATCH = 32
#: A round of centres is the last one if it confirms less than this share of the pairs it drew.
YIELD = 0.02
_ROW, _BAND = stream(24, ROWS) | U64(1), stream(25, BANDS)
_MULTIPLY, _ADD = stream(21, LONG) | U64(1), stream(22, LONG)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    for words in slices(column, lower=True):
        grams = words.ngrams(k)
        for i in range(words.docs):
            yield _set(words, grams, i, k)


def _set(words: Words, grams: np.ndarray, i: int, k: int) -> np.ndarray:
    a, b = words.offsets[i], words.offsets[i + 1]
    if a == b:
        return np.zeros(0, U64)
    if b - a < k:
        own = words.hashes[a:b] * (stream(31, k)[: b - a] | U64(1))
        return mix64(own.sum(keepdims=True, dtype=U64) + U64(b - a))
    found = np.sort(grams[a : b - k + 1])
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def signature(found: np.ndarray, length: int = SIGNATURE) -> np.ndarray:
    """The MinHash signature of a set: for each of ``length`` functions the least 32-bit value."""
    best = np.full(length, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 1024):
        values = (found[at : at + 1024, None] * _MULTIPLY[:length] + _ADD[:length]) >> U64(32)
        np.minimum(best, values.min(axis=0).astype(np.uint32), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's rows and number."""
    rows = sig.astype(U64).reshape(BANDS, ROWS)
    return mix64((rows * _ROW).sum(axis=1, dtype=U64) + _BAND)


def _digest(found: np.ndarray) -> bytes:
    return np.array([mix64(found ^ s).sum(dtype=U64) for s in stream(23, 2)], U64).tobytes()


def _describe(k: int):
    def run(batches):
        for batch in batches:
            ids, sizes, classes, keys = batch.column(0), [], [], []
            for found in shingle_sets(batch.column(1), k):
                sizes.append(len(found))
                classes.append(_digest(found) if len(found) else None)
                keys.append(band_keys(signature(found)).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "class", "keys"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            full = [x for x in shingle_sets(batch.column(1), k) if len(x)]
            long = [signature(x, LONG).astype(np.uint8) for x in full]
            columns = {
                "class": [_digest(x) for x in full],
                "n": np.array([len(x) for x in full], np.int64),
                "sig": [x[:SIGNATURE].tobytes() for x in long],
                "long": [x.tobytes() for x in long],
                "items": [x.tobytes() for x in full],
            }
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c == "n" else pa.binary()) for c, v in columns.items()], list(columns))

    return run


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of compared hashes (by batches): matches below which a pair is dropped.

    With m matches of n and a uniform prior the similarity is Beta(m + 1, n - m + 1); its chance to
    reach the threshold is a binomial tail: P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, LONG + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            ways = lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m)
            tail += exp(ways + m * log(threshold) + ((n + 1 - m) * log(1 - threshold) if m <= n else 0))
        out.append(m)
    return tuple(out)


def survives(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature matrices outlast the sequential test over all their columns."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for step, least in enumerate(least_matches(threshold, miss)[: left.shape[1] // BATCH]):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _matrix(column: pa.Array, length: int = SIGNATURE) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, length)


def _prune(threshold: float, miss: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                alive = survives(_matrix(part.column(2)), _matrix(part.column(3)), threshold, miss)
                yield part.select([0, 1]).take(pa.array(alive))

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _search(threshold: float, miss: float):
    """Pairs of a block of minor members and a block of a bucket, across components, that outlast the test.

    A pair that meets in several open buckets is given by the one with the least key.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        a, b = (_matrix(t.column("long"), LONG) for t in (left, right))
        la, lb, ca, cb = (np.array(t.column(c).to_pylist(), object) for c in ("label", "class") for t in (left, right))
        minor = right.column("minor").to_numpy()
        key = left.column("key")[0].as_py()
        lower = [[{k for k in keys if k < key} for keys in t.column("open").to_pylist()] for t in (left, right)]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for x in range(len(a)):  # two minor members meet both ways round
            others = np.flatnonzero((lb != la[x]) & (~minor | (cb > ca[x])))
            found = others[survives(np.broadcast_to(a[x], (len(others), LONG)), b[others], threshold, miss)]
            found = np.array([y for y in found if lower[0][x].isdisjoint(lower[1][y])], np.int64)
            out[0].append(np.full(len(found), x))
            out[1].append(found)
        x, y = (pa.array(np.concatenate(o)) for o in out)
        return pa.table({"a": left.column("class").take(x), "b": right.column("class").take(y)})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-3, rounds: int = 5, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    ``component_id`` is the smallest id reachable, the document's own included.
    """
    threshold = percent / 100
    docs = docs.select("doc_id", "text")
    described = save(docs.mapInArrow(_describe(k), _as(docs, "n_shingles long, class binary, keys array<long>")), "described")
    known = described.where("doc_id is not null and class is not null")
    classes = save(known.groupBy("class").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")), "classes")

    bands = classes.select("class", F.explode("keys").alias("key"))
    shared = save(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = save(bands.join(shared, "key"), "members")
    labels = save(members.groupBy("class").agg(F.sum("size").alias("degree")).withColumn("label", F.col("class")), "labels")
    members = members.drop("size")
    sets = _stored_sets(docs, classes, labels, k)
    tested: list[DataFrame] = []

    def link(pairs: DataFrame) -> tuple[DataFrame, int]:
        """Test pairs (a, b, a < b); the labels after it and the number of links found."""
        sig = sets.select("class", "sig", "n")
        both = pairs.join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b")
        both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        likely = save(both.select("a", "b", "sa", "sb").mapInArrow(_prune(threshold, miss), "a binary, b binary"), "likely")
        return confirm(likely)

    def confirm(likely: DataFrame) -> tuple[DataFrame, int]:
        items = sets.select("class", "items")
        both = likely.join(items.toDF("a", "xa"), "a").join(items.toDF("b", "xb"), "b")
        found = save(both.select("a", "b", "xa", "xb").mapInArrow(_confirm(percent), "a binary, b binary"), "edges")
        nodes = components(labels.select(F.col("class").alias("node"), "label"), found)
        return save(labels.drop("label").join(nodes.withColumnRenamed("node", "class"), "class"), "labels"), found.count()

    open_members = members
    for turn in range(rounds):
        # the first centre is the class that most buckets share, later ones are drawn by a hash
        rank = F.struct(F.col("degree"), "class") if turn == 0 else F.struct(F.xxhash64("class", "key", F.lit(turn)), "class")
        labelled = open_members.join(labels, "class")
        centre = labelled.groupBy("key").agg(F.max_by(F.struct("class", "label"), rank).alias("centre"))
        pairs = labelled.join(centre, "key").where("label <> centre.label").select(F.least("class", "centre.class").alias("a"), F.greatest("class", "centre.class").alias("b")).distinct()
        pairs = save(_untested(pairs, tested), "pairs")
        tested.append(pairs)
        labels, links = link(pairs)
        open_members, largest = _open(members, labels)
        if largest <= block or links <= YIELD * pairs.count():
            break
    if largest:
        labels, _ = confirm(_across(open_members, labels, sets, tested, threshold, miss, block))

    top = labels.join(classes.select("class", "first"), "class")
    low = top.groupBy("label").agg(F.min("first").alias("low"))
    found = top.join(low, "label").select("class", "low")
    named = save(classes.select("class", "first").join(found, "class", "left").select("class", F.coalesce("low", "first").alias("low")), "named")
    result = described.drop("keys").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _as(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"


def _stored_sets(docs: DataFrame, classes: DataFrame, labels: DataFrame, k: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Shingle sets and signatures of the classes that share a bucket, read again from one text of each."""
    wanted = save(classes.join(labels.select("class"), "class").select(F.col("first").alias("doc_id")), "wanted")
    count = wanted.count()
    few = count <= broadcast_rows  # 8 MB of ids; beyond that the join shuffles
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    found = save(texts.mapInArrow(_sets(k), "class binary, n long, sig binary, long binary, items binary"), "sets")
    if found.count() == count:  # each class gives a row at least, so this is one row of each
        return found
    return save(found.join(labels.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")


def _open(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Members of the buckets that still hold several components, and the size of the largest (0: none)."""
    labelled = members.join(labels.select("class", "label"), "class")
    several = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y and size > 2")
    found = save(members.join(several.select("key", "size"), "key"), "open")
    return found.drop("size"), found.agg(F.max("size")).first()[0] or 0


def _untested(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    if not tested:
        return pairs
    return pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, tested: list[DataFrame], threshold: float, miss: float, block: int) -> DataFrame:
    """Likely pairs across components in buckets that the rounds left open, in blocks of bounded size.

    A bucket's commonest component isn't searched within itself: only its other, minor members are
    compared, with all members. A class is in a bucket of each band at most, so its open keys are few.
    """
    labelled = save(members.join(labels.select("class", "label"), "class"), "labelled")
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    buckets = save(counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("size"), F.max("n").alias("most")), "buckets")
    rows = labelled.join(buckets, "key").withColumn("minor", F.col("label") != F.col("major"))
    lefts = F.ceil((F.col("size") - F.col("most")) / block).cast("int")
    rights = F.ceil(F.col("size") / block).cast("int")
    draw = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), n).cast("int")
    sig = sets.select("class", "long").join(labelled.groupBy("class").agg(F.collect_list("key").alias("open")), "class")
    left = rows.where("minor").join(sig, "class").select("key", draw(lefts, 1).alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"), "class", "label", "long", "open")
    right = rows.join(sig, "class").select("key", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), draw(rights, 2).alias("j"), "class", "label", "minor", "long", "open")
    right = right.toDF(*right.columns)
    pairs = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(_search(threshold, miss), "a binary, b binary")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return save(_untested(pairs, tested), "across")
