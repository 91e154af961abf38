"""Bitemporal posts: revisions, as-of reads, canonical copies, fetch windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.scratch import save


def build_revisions(seen: DataFrame, key: str, time: str, content: str) -> DataFrame:
    """Revisions of observations: an unchanged content extends the current one, a change opens the next.

    (key, content_revision, content, first_seen, last_seen)
    """
    w = Window.partitionBy(key).orderBy(time)
    changed = F.when(F.lag(content).over(w).eqNullSafe(F.col(content)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = seen.withColumn("changed", changed).withColumn("content_revision", F.sum("changed").over(w) - 1)
    return marked.groupBy(key, "content_revision").agg(F.first(content).alias(content), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def as_of(revisions: DataFrame, key: str, cutoff: Column) -> DataFrame:
    """The newest revision of each key that was seen by the cutoff."""
    known = revisions.where(F.col("first_seen") <= cutoff)
    w = Window.partitionBy(key).orderBy(F.desc("content_revision"))
    return known.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def mark_deleted(revisions: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``is_deleted`` on the newest revision of every deleted key."""
    last = revisions.groupBy(key).agg(F.max("content_revision").alias("content_revision"))
    gone = last.join(deleted.select(key).distinct(), key).withColumn("gone", F.lit(True))
    return revisions.join(gone, [key, "content_revision"], "left").withColumn("is_deleted", F.coalesce("gone", F.lit(False))).drop("gone")


def assign_canonical(posts: DataFrame, text_key: str, order: list[str], author: str) -> DataFrame:
    """Copies by equal text key: the first of each group and the group's size and authors, on every row.

    The key, which may be long and costly to build, is made once and replaced by its digest
    ``dedup_id``; ``posts`` keeps its other columns. Groups are summed up first and joined back, so a
    text that very many posts share is never gathered by one task. Posts without a text are their own canonical.
    """
    digest = F.when(F.length(text_key) > 0, F.sha2(F.col(text_key), 256))
    marked = save(posts.withColumn("digest", digest).drop(text_key), "marked")
    groups = marked.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct(*order)).getField(order[-1]).alias("canonical_id"), F.count("*").alias("copies"), F.count_distinct(F.when(F.length(F.col(author).cast("string")) > 0, F.col(author))).alias("authors")
    )
    joined = marked.join(groups, "digest", "left")
    return joined.withColumns({
        "canonical_id": F.coalesce("canonical_id", order[-1]), "copies": F.coalesce("copies", F.lit(1)), "authors": F.coalesce("authors", F.lit(1)),
        "dedup_id": F.concat(F.lit("dedup:"), F.left("digest", F.lit(16))),
    }).drop("digest")


def overlapping(windows: DataFrame, asked: DataFrame, key: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Pairs of windows (start, end) and asked ranges (from, to) of one key with start < to and end > from.

    Both sides are listed in the time buckets that they touch and meet there by equality; the pair is
    taken in the first bucket that they share.
    """
    def listed(df: DataFrame, a: str, b: str) -> DataFrame:
        lo, hi = (F.floor(F.unix_timestamp(c) / bucket_seconds) for c in (a, b))
        return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("bucket", F.explode(F.sequence(lo, hi)))

    met = listed(windows, "start", "end").join(listed(asked, "from", "to"), [key, "bucket"])
    first = F.floor(F.unix_timestamp(F.greatest("start", "from")) / bucket_seconds)
    return met.where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")) & (F.col("bucket") == first)).drop("bucket")


def window_health(asked: DataFrame, pairs: DataFrame, by: list[str], components: list[str]) -> DataFrame:
    """Completeness and health of asked ranges: no window at all means incomplete and a health of 0."""
    means = [F.avg(F.coalesce(c, F.lit(1.0))).alias(c) for c in components]
    found = pairs.groupBy(*by).agg(F.bool_and("complete").alias("complete"), *means)
    joined = asked.select(*by).join(found, by, "left")
    cols = {c: F.coalesce(c, F.lit(0.0)) for c in components}
    return joined.withColumns({"complete": F.coalesce("complete", F.lit(False)), **cols}).withColumn("data_health", F.least(*components))


def latest(df: DataFrame, keys: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    """The newest row of each key, or all rows that tie for it."""
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("n", rank.over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")
