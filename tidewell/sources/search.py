"""Paged searches and timelines: which parts of a time range a capped provider gives, and a reader for one.

A search page holds at most PAGE posts. A range whose page is full while there is more is halved, to
the second, until its parts are complete or too short to halve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, LEAST_SECONDS = 20, 30
#: What must be known of a provider's terms before it is read.
TERMS = ("reviewed_at", "reviewed_by", "permitted_storage", "raw_retention_days", "deletion_sync_required", "redistribution_allowed", "commercial_use_allowed", "model_training_allowed")


def require_terms(terms: dict | None) -> dict:
    """``terms`` if none of TERMS is open; raises otherwise."""
    missing = [t for t in TERMS if (terms or {}).get(t) is None]
    if missing:
        raise PermissionError(f"terms review isn't complete: {', '.join(missing)}")
    return terms


def page_capped(found: Column, more: Column, seconds: Column) -> tuple[Column, Column]:
    """Whether a page is cut off, and whether its range can be halved."""
    capped = (found >= PAGE) & more
    return capped, capped & (seconds > LEAST_SECONDS)


def resolve_windows(asked: DataFrame, posts: DataFrame, max_posts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts, records): how each range of ``asked`` (request, asset, lo, hi: seconds) is fetched from ``posts`` (asset, at: seconds).

    A part (request, lo, hi, found, taken, complete, fetched) is a range that isn't halved any more; one
    without posts isn't listed. The newest parts come first: once ``max_posts`` are taken no further
    part is fetched. A record tells whether the range is complete, why not, and the count. Posts are
    counted by second once, then by all the ranges around their second that halving can come to.
    """
    met = asked.select("request", "asset", "lo", "hi").join(posts.select("asset", "at"), "asset").where(F.col("at").between(F.col("lo"), F.col("hi")))
    seconds = met.groupBy("request", "lo", "hi", "at").agg(F.count("*").alias("n"))
    longest = asked.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    none = F.lit(None).cast("long")
    path = F.array(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), none.alias("above_lo"), none.alias("above_hi")))
    if longest > LEAST_SECONDS:
        path = F.aggregate(F.sequence(F.lit(1), F.lit(int(longest).bit_length())), path, _halve)
    counted = seconds.select("request", "n", F.inline(path)).groupBy("request", "lo", "hi", "above_lo", "above_hi").agg(F.sum("n").alias("found"))
    capped, split = page_capped(F.col("found"), F.col("found") > PAGE, F.col("hi") - F.col("lo"))
    counted = counted.withColumns({"complete": ~capped, "split": split})
    halved = counted.where("split").select("request", F.col("lo").alias("above_lo"), F.col("hi").alias("above_hi"), F.lit(True).alias("reached"))
    leaves = counted.where("not split").join(halved, ["request", "above_lo", "above_hi"], "left").where("reached or above_lo is null")
    leaves = leaves.select("request", "lo", "hi", "found", "complete", F.when(F.col("complete"), F.col("found")).otherwise(PAGE).alias("taken"))
    newer = F.coalesce(F.sum("taken").over(Window.partitionBy("request").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leaves = leaves.withColumn("fetched", newer < max_posts if max_posts is not None else F.lit(True))
    got = leaves.where("fetched").groupBy("request").agg(F.sum("taken").alias("fetched_count"), F.min("lo").alias("oldest"), F.bool_and("complete").alias("whole"))
    records = asked.select("request", "asset", "lo", "hi").join(got, "request", "left").withColumn("fetched_count", F.coalesce("fetched_count", F.lit(0)))
    capped = F.coalesce((F.col("fetched_count") >= max_posts) & (F.col("oldest") > F.col("lo")), F.lit(False)) if max_posts is not None else F.lit(False)
    why = F.when(capped, "budget_cap").when(~F.coalesce("whole", F.lit(True)), "provider_limit")
    return leaves.select("request", "lo", "hi", "found", "taken", "complete", "fetched"), records.select("request", "asset", "fetched_count", why.isNull().alias("complete"), why.alias("truncation_reason"))


def _halve(path: Column, _: Column) -> Column:
    """The path of ranges around a second, with the half of its last one that holds the second, if that is still long."""
    last = F.element_at(path, -1)
    middle = F.floor((last["lo"] + last["hi"]) / 2).cast("long")
    upper = F.col("at") > middle
    half = F.struct(F.when(upper, middle + 1).otherwise(last["lo"]).alias("lo"), F.when(upper, last["hi"]).otherwise(middle).alias("hi"), last["lo"].alias("above_lo"), last["hi"].alias("above_hi"))
    return F.when(last["hi"] - last["lo"] > LEAST_SECONDS, F.concat(path, F.array(half))).otherwise(path)


def read_timeline(posts: DataFrame, since: Column, max_pages: int = 50) -> tuple[DataFrame, DataFrame]:
    """(posts, records) of authors' timelines (author, at, post_id), newest first in pages, back to ``since``.

    Pages are read until one holds a post before ``since`` or is the last; reading all of ``max_pages`` makes the window partial.
    """
    newest = Window.partitionBy("author").orderBy(F.desc("at"), F.desc("post_id"))
    # one post more than can be read tells that there is more; older ones needn't be sorted
    near = posts.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= max_pages * PAGE + 1)
    paged = near.withColumn("page", F.floor((F.col("place") - 1) / PAGE)).drop("place")
    ends = paged.groupBy("author").agg(F.min(F.when(F.col("at") < since, F.col("page"))).alias("stop"), F.max("page").alias("last"))
    read = F.least(F.coalesce("stop", "last") + 1, F.lit(max_pages))
    kept = paged.where((F.col("page") < max_pages) & F.coalesce(F.col("at") >= since, F.lit(True))).drop("page")
    counts = kept.groupBy("author").agg(F.count("*").alias("fetched_count"))
    partial = F.col("pages") >= max_pages
    records = ends.select("author", read.alias("pages")).join(counts, "author", "left").withColumn("fetched_count", F.coalesce("fetched_count", F.lit(0)))
    return kept, records.select("author", "pages", "fetched_count", (~partial).alias("complete"), F.when(partial, "partial_window").alias("truncation_reason"))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


def search_source(name: str, schema: str, fetch: Callable[[dict, int, int], tuple[list[tuple], bool]]) -> type[DataSource]:
    """A Spark source over a search: ``fetch(options, lo, hi)`` gives a page of rows of a range of seconds and whether there is more.

    Options ``lo`` and ``hi`` bound the range, ``step`` cuts it into partitions; a partition halves what
    is too full, newest part first, and keeps the first page of what can't be halved.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            lo, hi = int(self.options["lo"]), int(self.options["hi"])
            step = int(self.options.get("step", hi - lo + 1))
            return [_Range(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

        def read(self, partition: _Range) -> Iterator[tuple]:
            todo = [(partition.lo, partition.hi)]
            while todo:
                lo, hi = todo.pop()
                rows, more = fetch(self.options, lo, hi)
                if len(rows) >= PAGE and more and hi - lo > LEAST_SECONDS:
                    middle = (lo + hi) // 2
                    todo += [(lo, middle), (middle + 1, hi)]
                else:
                    yield from rows

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Source


def register_search(spark: SparkSession, terms: dict | None, name: str, schema: str, fetch) -> None:
    """Make ``spark.read.format(name)`` read the search, once its terms are reviewed."""
    require_terms(terms)
    spark.dataSource.register(search_source(name, schema, fetch))
