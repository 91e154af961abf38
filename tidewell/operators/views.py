"""Reads that a dashboard makes: filtered pages of posts, payload fields, merged histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import sign_label
from tidewell.operators.sentiment import population_means

HOURS, ROWS = 2160, 2000


def listed_posts(posts: DataFrame, now: Column, hours: int = 168, asset: str | None = None, label: str | None = None) -> DataFrame:
    """Scored posts that aren't deleted, of the last hours, on an asset, with a label."""
    since = now - F.make_dt_interval(hours=F.lit(min(hours, HOURS)))
    rows = posts.where(F.col("sentiment").isNotNull() & ~F.coalesce("is_deleted", F.lit(False)) & (F.col("event_time") >= since))
    rows = rows.where(F.array_contains("asset_mentions", asset)) if asset else rows
    rows = rows.withColumn("label", sign_label(F.col("sentiment")))
    return rows.where(F.col("label") == label) if label else rows


def post_page(posts: DataFrame, now: Column, limit: int = 100, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(total, page): how many ``listed_posts`` there are, and a page of them, newest first."""
    rows = listed_posts(posts, now, **filters)
    return rows.agg(F.count("*").alias("total")), rows.orderBy(F.desc("event_time"), "post_id").offset(offset).limit(min(limit, ROWS))


def popularity() -> Column:
    """What posts are ranked by: likes, reposts twice, a hundredth of the views."""
    return F.coalesce("likes", F.lit(0)) + 2 * F.coalesce("reposts", F.lit(0)) + 0.01 * F.coalesce("views", F.lit(0))


def payload_value(payload: str, field: str, kind: str) -> Column:
    """A field of a JSON payload; NULL where the payload is missing, broken, or has none."""
    return F.try_variant_get(F.try_parse_json(payload), f"$.{field}", kind)


def forecast_history(ledger: DataFrame, research: DataFrame, since: Column) -> DataFrame:
    """Forecasts of both ledgers in order of time, those of the research one by their abstention and marked."""
    value = lambda field, kind: payload_value("payload", field, kind)
    own = ledger.select("generated_at", "advisor_id", "instrument_id", value("action", "string").alias("action"), value("raw_score", "double").alias("raw_score"), value("calibrated_probability_positive", "double").alias("p_plus"))
    action = F.when(F.coalesce(value("abstain", "boolean"), F.lit(False)), "flat").otherwise(value("direction", "string"))
    other = research.select("generated_at", F.concat("advisor_id", F.lit(" (research)")).alias("advisor_id"), "instrument_id", action.alias("action"), value("confidence", "double").alias("raw_score"), value("probability_positive", "double").alias("p_plus"))
    return own.unionByName(other).where(F.col("generated_at") >= since).orderBy("generated_at", "advisor_id", "instrument_id")


def hourly_sentiment(posts: DataFrame) -> DataFrame:
    """(asset, hour, n, sent_mean, sent_weighted) of all posts by hour, author-first."""
    rows = posts.withColumn("hour", F.date_trunc("hour", "event_time"))
    counts = rows.groupBy("asset", "hour").agg(F.count("*").alias("n"))
    return counts.join(population_means(rows, ["asset", "hour"]).select("asset", "hour", "sent_mean", "sent_weighted"), ["asset", "hour"], "left")


def exposure_totals(positions: DataFrame, by: list[str]) -> DataFrame:
    """Gross and net exposure of positions (by, notional)."""
    return positions.groupBy(*by).agg(F.sum(F.abs("notional")).alias("gross"), F.sum("notional").alias("net"))
