"""Contiguous shards of near-equal bytes: minimax partition of ordered atomic groups.

Equal texts form one atomic group; groups are ordered by their smallest id (then by digest). A group
of at least the mean shard's bytes gets a shard of its own, from the last one down. For the others, the
smallest capacity C for which a greedy left-to-right fill needs no more than the given number of
shards is found by binary search, and the groups are cut where the greedy fill with C cuts.

The driver never holds all groups. It holds the running totals at the ends of a bounded number of
blocks of groups. Which blocks can hold a cut follows from bounds on C that these totals give; only
those blocks are then refined into smaller ones, until the cuts are exact.

Defined cases: a null text has no bytes (size 8, CRC 0) and null texts are one group; ids may be
null or repeated; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.scratch import save


def greedy_cuts(ends: Sequence[int], capacity: int) -> list[int]:
    """Where a greedy fill cuts: indices into ``ends`` (running totals) after which a shard is full."""
    cuts, start, at = [], 0, 0
    while at < len(ends):
        to = bisect_right(ends, start + capacity, at)
        if to == at:
            raise ValueError("a group exceeds the capacity")
        cuts.append(to - 1)
        start, at = ends[to - 1], to
    return cuts


def smallest_capacity(ends: Sequence[int], largest: int, shards: int) -> int:
    """Binary search for the least capacity that needs at most ``shards`` shards."""
    if not ends:
        return 0
    low, high = max(largest, -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(ends, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


Block = tuple[int, int]  # running totals at the ends of its last and of its first group
Refine = Callable[[list[Block]], dict[int, list[Block]]]


def refined_cuts(found: list[Block], largest: int, shards: int, refine: Refine) -> tuple[list[int], int]:
    """Totals at which the greedy fill of the smallest capacity C cuts, and C.

    ``found`` are consecutive blocks of groups; ``refine`` gives for blocks of several groups, by
    their end, the smaller blocks that they consist of. A fill of whole blocks is a fill of groups, so its capacity ``high`` is at least C; moving each
    cut to its block's end costs at most one block, so C is at least ``high`` less the largest
    block in which a cut can lie. Every fill within these bounds looks for its cuts in known ranges
    of totals: the blocks that meet one are refined, and so on until each is one group.
    """
    if not found:
        return [], 0
    low, loose = max(largest, -(-found[-1][0] // shards)), {end for end, _ in found}
    while True:
        ends, whole = [end for end, _ in found], [end == first for end, first in found]
        sizes = [e - s for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        high = smallest_capacity(ends, max(low, *sizes), shards)
        low = max(low, high - max((n for n, e, w in zip(sizes, ends, whole, strict=True) if e in loose and not w), default=0))
        touched, near, far = set(), 0, 0
        for _ in range(shards):
            i, j = bisect_right(ends, near + low), bisect_right(ends, far + high)
            touched.update(k for k in range(i, min(j + 1, len(ends))) if not whole[k])
            near = max(near, ends[i - 1] if i else 0)
            far = min(ends[-1], far + high)
        if not touched:
            return [ends[i] for i in greedy_cuts(ends, high)], high
        pieces = refine([found[k] for k in sorted(touched)])
        loose = {end for piece in pieces.values() for end, _ in piece}
        found = [piece for block in found for piece in pieces.get(block[0], [block])]


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_documents(docs: DataFrame, shards: int = 24, blocks: int = 4096) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs`` (doc_id, text).

    ``slot`` numbers the rows of a shard from 0 without gaps, by id.
    """
    spark = docs.sparkSession
    text = F.col("text")
    crc = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")
    rows = save(docs.select("doc_id", _bytes(text).alias("size"), crc.alias("text_crc32"), F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))).alias("digest"), text.isNull().alias("none")), "rows")
    groups = rows.groupBy("digest", "none").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    groups = save(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = groups.where(F.col("bytes") * shards >= max(total, 1)).orderBy(F.desc("bytes"), "digest").limit(shards).collect()
    large = large[: shards - 1] if len(large) == shards else large
    alone = [(r["digest"], r["none"], shards - 1 - i) for i, r in enumerate(large)]
    own = F.broadcast(spark.createDataFrame(alone, "digest binary, none boolean, shard int"))  # fewer rows than shards
    placed, total = _placed(groups.join(own, ["digest", "none"], "left_anti"))

    def split(within: list[Block], pieces: int) -> dict[int, list[Block]]:
        """Each of some blocks in at least 2 and at most ``pieces`` smaller ones, by the block's end."""
        spans = F.array(*[F.struct(F.lit(first).alias("a"), F.lit(end).alias("b")) for end, first in within])
        hit = F.get(F.filter(spans, lambda x: (F.col("end") >= x["a"]) & (F.col("end") <= x["b"])), F.lit(0))
        hits = placed.where(F.col("end").between(within[0][1], within[-1][0])).select("end", hit.alias("hit")).where("hit is not null")
        piece = F.floor((F.col("end") - F.col("hit.a")).cast("double") / (F.col("hit.b") - F.col("hit.a") + 1) * pieces)
        parts = hits.groupBy(F.col("hit.b").alias("b"), piece.alias("piece")).agg(F.max("end").alias("end"), F.min("end").alias("first")).collect()
        out: dict[int, list[Block]] = {}
        for r in sorted(parts, key=lambda r: r["end"]):
            out.setdefault(r["b"], []).append((r["end"], r["first"]))
        return out

    top = [x for part in split([(total, 1)], blocks).values() for x in part] if total else []
    largest = placed.agg(F.max("bytes")).first()[0] or 0
    cuts, _ = refined_cuts(top, largest, shards - len(alone), lambda touched: split(touched, 64))
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")
    assigned = placed.select("digest", "none", shard.alias("shard")).unionByName(own)
    dealt = save(rows.join(assigned, ["digest", "none"]).drop("digest", "none"), "dealt")
    return with_slots(dealt).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _placed(groups: DataFrame) -> tuple[DataFrame, int]:
    """Groups in order with the running total of bytes at their end, and the total."""
    spark = groups.sparkSession
    order = ["first", "digest", "none"]
    ranged = save(groups.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()), "ranged")
    sums = dict(ranged.groupBy("part").agg(F.sum("bytes")).collect())  # a row for each partition
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("bytes").over(running)).join(offsets, "part")
    return save(placed.select("digest", "none", "bytes", (F.col("upto") + F.col("before")).alias("end")), "placed"), total


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 by (doc_id, text_crc32), over ranges of ids of bounded size."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    span = F.aggregate(F.array(*[F.lit(b) for b in bounds]), F.lit(0), lambda n, b: n + F.when(F.col("doc_id") >= b, 1).otherwise(0)) if bounds else F.lit(0)
    spanned = rows.withColumn("span", span)
    counts = sorted((r["shard"], r["span"], r["count"]) for r in spanned.groupBy("shard", "span").count().collect())
    before, seen = [], {}
    for s, b, n in counts:
        before.append((s, b, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    offsets = F.broadcast(spark.createDataFrame(before, "shard int, span int, before long"))  # shards times partitions rows
    number = F.row_number().over(Window.partitionBy("shard", "span").orderBy("doc_id", "text_crc32")) - 1
    return spanned.withColumn("own", number).join(offsets, ["shard", "span"]).withColumn("slot", F.col("own") + F.col("before"))
