"""Scoring posts by a model that is loaded once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import scorer_input

#: What a scorer adds to a post; all but the version and flags are NULL where scoring a text failed.
FIELDS = "p_negative double, p_neutral double, p_positive double, sentiment double, confidence double, scorer_version string, quality_flags array<string>, error string"


def score_posts(posts: DataFrame, text: str, load: Callable[[], Callable[[str], tuple[float, float, float]]], version: str) -> DataFrame:
    """``posts`` with FIELDS from a scorer of (negative, neutral, positive) probabilities.

    ``load`` is called once a partition and gives a function of a prepared text: trimmed, cut and never
    NULL. A text that it raises on becomes an unscored row; no other row suffers.
    """
    fields = T.StructType.fromDDL(FIELDS)
    schema = T.StructType([*posts.schema.fields, *fields.fields])

    def one(score, prepared: str) -> tuple:
        try:
            negative, neutral, positive = map(float, score(prepared))
        except Exception as problem:  # the contract: a text never fails its batch
            return None, None, None, None, None, version, ["unscored"], str(problem)
        return negative, neutral, positive, positive - negative, max(negative, neutral, positive), version, [], None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            rows = [one(score, t) for t in batch.pop("_prepared")]
            found = pd.DataFrame(rows, columns=fields.names, index=batch.index)
            yield pd.concat([batch, found], axis=1)

    return posts.withColumn("_prepared", scorer_input(F.col(text))).mapInPandas(run, schema)


def score_queue(posts: DataFrame, key: str, most: int = 500) -> DataFrame:
    """The posts to score next: no sentiment yet and not deleted, at most ``most`` by key."""
    return posts.where(F.col("sentiment").isNull() & ~F.coalesce("is_deleted", F.lit(False))).orderBy(key).limit(most)
