"""Streaming forms of the windowed operators: same results as the batch ones once all data has arrived."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed(posts: DataFrame, time: str, key: str, value: str, length: str = "24 hours", slide: str = "1 hour", late: str = "48 hours") -> DataFrame:
    """Count and mean of each key in sliding windows; rows later than ``late`` are dropped."""
    window = F.window(time, length, slide)
    return posts.withWatermark(time, late).groupBy(window, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("window.end").alias("end"), "n", "mean")


def first_copies(posts: DataFrame, time: str, keys: list[str], lookback: str = "48 hours") -> DataFrame:
    """Posts without those that repeat a key within the lookback: state is dropped with the watermark."""
    return posts.withWatermark(time, lookback).dropDuplicatesWithinWatermark(keys)


def revisions(posts: DataFrame, key: str, time: str, content: str) -> DataFrame:
    """(key, content_revision, content, seen) of every observation that opens a revision of its post.

    The state of a post is its revision, content and time, however often it is seen. Observations of
    one batch are taken in order of time; one older than the state's is late and opens nothing.
    """
    kind = posts.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, text, last = state.get if state.exists else (-1, None, None)
        rows, out = pd.concat(list(frames)).sort_values([time, content], kind="stable"), []
        for at, said in zip(rows[time], rows[content], strict=True):
            if last is not None and at.value < last:
                continue
            if revision < 0 or said != text:
                revision, text = revision + 1, said
                out.append((group[0], revision, said, at))
            last = at.value
        state.update((revision, text, last))
        yield pd.DataFrame(out, columns=[key, "content_revision", content, "seen"])

    schema = f"{key} {kind}, content_revision long, {content} string, seen timestamp"
    rows = posts.select(key, time, content).where(F.col(time).isNotNull()).groupBy(key)
    return rows.applyInPandasWithState(step, schema, "revision long, text string, last long", "append", GroupStateTimeout.NoTimeout)


def first_claims(claims: DataFrame, key: str, time: str, claimer: str) -> DataFrame:
    """(key, claimer, at) of at most one claim a key, for good: the earliest of the batch that brings the first ones."""
    kinds = {f.name: f.dataType.simpleString() for f in claims.schema}

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([time, claimer], kind="stable")
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame({key: [group[0]], claimer: [rows[claimer].iloc[0]], "at": [rows[time].iloc[0]]})

    schema = f"{key} {kinds[key]}, {claimer} {kinds[claimer]}, at timestamp"
    return claims.select(key, time, claimer).groupBy(key).applyInPandasWithState(step, schema, "taken boolean", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that has arrived into Parquet, then stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
