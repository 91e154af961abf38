"""Windowed sentiment of authored, scored posts.

Posts are (post_id, author_id, asset, source_class, sentiment, p_negative, p_neutral, p_positive,
confidence, followers, age_days, event_time, available_time, exclusions, canonical_id, ambiguity).
Averages are author-first: the median of each author's posts, then a median over authors, so one
author's volume doesn't move them. All windows are closed at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import entropy, label
from tidewell.operators.revisions import overlapping, window_health

#: Measures of a fetch window whose means, and their minimum, tell the health of the data.
HEALTH = ("time_coverage", "fetch_success_rate", "completeness", "scoring_success_rate", "schema_valid_rate")
POPULATIONS = ("broad", "curated")
LOW_CONFIDENCE, NEW_AUTHOR_DAYS, TOP_AUTHORS = 0.5, 30, 5


def eligible(cutoff: Column) -> Column:
    """Available by the cutoff, not excluded, and not a later copy; an unknown availability is none."""
    own = F.col("canonical_id").isNull() | (F.col("canonical_id") == F.col("post_id"))
    return F.coalesce((F.col("available_time") <= cutoff) & (F.size("exclusions") == 0) & own, F.lit(False))


def unambiguous() -> Column:
    return ~F.col("ambiguity").eqNullSafe("multi_asset")


def exclusion_flags(min_followers: int | None = None, min_age_days: float | None = None, author_cap: int | None = None) -> Column:
    """Why a post is left out; a rule without a threshold doesn't apply."""
    flag = lambda on, name: F.when(on, name)
    rules = []
    if min_followers is not None:
        rules.append(flag(F.col("followers").isNull() | (F.col("followers") < min_followers), "low_followers"))
    if min_age_days is not None:
        rules.append(flag(F.col("age_days").isNull() | (F.col("age_days") < min_age_days), "young_account"))
    if author_cap is not None:
        rules.append(flag(F.col("author_posts") > author_cap, "author_over_window_cap"))
    rules += [flag(F.col("sentiment").isNull(), "unscored"), flag(F.coalesce("is_deleted", F.lit(False)), "deleted")]
    rules += [flag(F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col("post_id")), "non_canonical_duplicate")]
    rules += [flag(F.col("ambiguity").eqNullSafe("multi_asset"), "multi_asset_ambiguous")]
    return F.array_compact(F.array(*rules))


def left_out_of_population(flags: Column) -> Column:
    return F.exists(flags, lambda f: f != "multi_asset_ambiguous")


def with_author_counts(posts: DataFrame, keys: list[str]) -> DataFrame:
    """The number of posts of each author within the keys, counted first and joined back."""
    counts = posts.groupBy(*keys, "author_id").agg(F.count("*").alias("author_posts"))
    return posts.join(counts, [*keys, "author_id"])


def _authors(on: Column | None = None) -> Column:
    """The number of authors, unknown ones together counting as one."""
    author = F.coalesce(F.concat(F.lit("a"), F.col("author_id").cast("string")), F.lit(""))
    return F.count_distinct(author if on is None else F.when(on, author))


def author_medians(posts: DataFrame, by: list[str]) -> DataFrame:
    """(by, author_id, m, w): each author's median sentiment and follower weight."""
    scored = posts.where(unambiguous() & F.col("sentiment").isNotNull())
    weight = 1 + F.log1p(F.greatest(F.max(F.coalesce("followers", F.lit(0))), F.lit(0)).cast("double"))
    return scored.groupBy(*by, "author_id").agg(F.median("sentiment").alias("m"), weight.alias("w"))


def population_means(posts: DataFrame, by: list[str]) -> DataFrame:
    """Median of author medians, its follower-weighted mean and the dispersion (of two authors at least)."""
    medians = author_medians(posts, by)
    return medians.groupBy(*by).agg(
        F.median("m").alias("sent_mean"), F.try_divide(F.sum(F.col("m") * F.col("w")), F.sum("w")).alias("sent_weighted"),
        F.when(F.count("*") >= 2, F.stddev_pop("m")).alias("dispersion"), F.count("*").alias("authors"),
    )


def quality(posts: DataFrame, by: list[str]) -> DataFrame:
    """Label shares, entropy and confidence over unambiguous posts, and how concentrated their authors are."""
    rows = posts.where(unambiguous())
    scored = F.col("sentiment").isNotNull()
    named = label(F.col("p_negative"), F.col("p_neutral"), F.col("p_positive"))
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("p_negative", "p_neutral", "p_positive")]
    share = lambda on: F.avg(F.when(scored, F.when(on, 1.0).otherwise(0.0)))
    whole = rows.groupBy(*by).agg(
        share(named == "positive").alias("positive_fraction"), share(named == "negative").alias("negative_fraction"),
        F.avg(F.when(scored, parts[1])).alias("neutral_mean"), F.avg(F.when(scored, entropy(*parts))).alias("entropy_mean"),
        F.avg(F.when(F.col("confidence").isNotNull(), F.when(F.col("confidence") < LOW_CONFIDENCE, 1.0).otherwise(0.0))).alias("low_confidence"),
    )
    authors = rows.groupBy(*by, "author_id").agg(F.count("*").alias("n"), F.min_by("age_days", F.struct("event_time", "post_id")).alias("age"))
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), "author_id")
    ranked = authors.withColumn("k", F.row_number().over(rank))
    concentrated = ranked.groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"),
        (F.sum(F.when(F.col("k") <= TOP_AUTHORS, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_share"),
        F.avg(F.when(F.col("age").isNotNull(), F.when(F.col("age") < NEW_AUTHOR_DAYS, 1.0).otherwise(0.0))).alias("new_authors"), F.median("age").alias("median_age"),
    )
    return whole.join(concentrated.withColumn("effective_authors", 1 / F.col("hhi")), by)


def sentiment_delta(posts: DataFrame, by: list[str], now: Column, least_posts: int, least_authors: int) -> DataFrame:
    """Mean of the last hour less that of the hour six hours before; NULL unless both have enough posts and authors."""
    hours = (F.unix_micros(now) - F.unix_micros("event_time")) / 3.6e9
    part = F.when(hours.between(0, 1), "recent").when(hours.between(6, 7), "prior")
    rows = posts.withColumn("part", part).where(F.col("part").isNotNull())
    counted = rows.where(unambiguous() & F.col("sentiment").isNotNull())
    enough = counted.groupBy(*by, "part").agg(F.count("*").alias("n"), _authors().alias("a"))
    means = population_means(rows, [*by, "part"]).join(enough, [*by, "part"]).where((F.col("n") >= least_posts) & (F.col("a") >= least_authors))
    pick = lambda name: F.max(F.when(F.col("part") == name, F.col("sent_mean")))
    return posts.select(*by).distinct().join(means.groupBy(*by).agg((pick("recent") - pick("prior")).alias("delta")), by, "left")


def features(
    posts: DataFrame, windows: DataFrame, assets: DataFrame, now: Column, volume_baseline: DataFrame | None = None, authors_baseline: DataFrame | None = None,
    threshold: float = 0.8, spike_volume: float = 3.0, spike_authors: float = 2.0, least_posts: int = 5, least_authors: int = 3,
) -> DataFrame:
    """Each asset's six health values, 27 features and quality flags as of ``now``.

    ``windows`` (asset, start, end, complete and HEALTH) are the fetches; their means over the last
    24 hours are the health, at its minimum below ``threshold`` all features are NULL. Volumes need
    every fetch of their hours complete. The baselines are ``seasonal_baseline`` of posts and authors
    by quarter hour, keyed by asset; their bucket at ``now`` gives z-scores and the spike.
    """
    hours = (F.unix_micros(now) - F.unix_micros("event_time")) / 3.6e9
    known = posts.where(eligible(now) & hours.between(0, 24)).withColumn("hours", hours)
    hour = known.where("hours <= 1")

    def fetched(back: int) -> DataFrame:
        asked = assets.select("asset", (now - F.make_dt_interval(hours=F.lit(back))).alias("from"), now.alias("to"))
        return window_health(asked, overlapping(windows, asked, "asset"), ["asset", "from", "to"], list(HEALTH)).drop("from", "to")

    def means(rows: DataFrame, name: str) -> DataFrame:
        found = population_means(rows, ["asset", "source_class"])
        pick = lambda p, c: F.max(F.when(F.col("source_class") == p, F.col(c)))
        return found.groupBy("asset").agg(*[pick(p, c).alias(f"sent_mean_{name}_{p}{end}") for p in POPULATIONS for c, end in (("sent_mean", ""), ("sent_weighted", "_weighted"))])

    near = F.col("hours") <= 1
    volume = known.groupBy("asset").agg(F.count("*").alias("volume_24h"), F.count_if(near).alias("volume_1h"), _authors(near).alias("authors_1h"))
    spread = population_means(hour, ["asset"]).select("asset", F.col("dispersion").alias("dispersion_1h"))
    delta = sentiment_delta(posts.where(eligible(now)), ["asset"], now, least_posts, least_authors).withColumnRenamed("delta", "sent_delta_6h")
    health = fetched(24).withColumnRenamed("complete", "complete_24h").join(fetched(1).select("asset", F.col("complete").alias("complete_1h")), "asset")
    joined = health
    for part in (volume, means(hour, "1h"), means(known, "24h"), spread, delta, quality(hour, ["asset"]), _bucket(volume_baseline, now, "volume"), _bucket(authors_baseline, now, "authors")):
        joined = joined if part is None else joined.join(part, "asset", "left")
    counted = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("volume_1h", "volume_24h", "authors_1h")})
    none = F.struct(F.lit(0.0).alias("center"), F.lit(1e-6).alias("scale"), F.lit(0).cast("long").alias("n"), F.lit("none").alias("method"))
    for name, value in (("volume", "volume_1h"), ("authors", "authors_1h")):
        base = F.coalesce(F.col(f"{name}_baseline"), none) if f"{name}_baseline" in joined.columns else none
        base = F.when(F.col("complete_1h"), base)
        z = F.when(base["n"] > 0, (F.col(value) - base["center"]) / base["scale"])
        counted = counted.withColumns({f"{name}_baseline": base, f"{name}_zscore": z})
    counted = counted.withColumn("spike_flag", spike(F.col("complete_1h"), F.col("volume_zscore"), F.col("authors_zscore"), spike_volume, spike_authors))
    good, whole = F.col("data_health") >= threshold, {"1h": F.col("complete_1h"), "24h": F.col("complete_24h")}
    flags = F.when(good, F.array_compact(F.array(*[F.when(~on, f"incomplete_window_{h}") for h, on in whole.items()]))).otherwise(F.array(F.lit("low_data_health")))
    out = {c: F.when(good & whole[h], F.col(c)) for c, h in (("volume_1h", "1h"), ("volume_24h", "24h"))}
    rest = [c for c in counted.columns if c not in ("asset", "data_health", "complete_1h", "complete_24h", "authors_1h", *HEALTH, *out)]
    return counted.select("asset", *HEALTH, "data_health", *[x.alias(c) for c, x in out.items()], *[F.when(good, F.col(c)).alias(c) for c in rest], flags.alias("quality_flags"))


def _bucket(baseline: DataFrame | None, now: Column, name: str) -> DataFrame | None:
    if baseline is None:
        return None
    own = baseline.where(F.col("bucket") == F.floor((F.hour(now) * 60 + F.minute(now)) / 15))
    return own.select("asset", F.struct("center", "scale", F.col("n").cast("long").alias("n"), "method").alias(f"{name}_baseline"))


def _turn(population: str, most: Column):
    """A step that adds the next post of tercile n % 3 by an author not yet used, while there are fewer than ``most``."""

    def step(acc: Column, n: Column) -> Column:
        used = lambda x: F.exists(acc["taken"], lambda t: t["post"]["author_id"].eqNullSafe(x["post"]["author_id"]))
        free = F.filter(F.col("list"), lambda x: (x["source_class"] == population) & (x["part"] == n % 3) & ~used(x))
        return F.struct(F.when((F.size(acc["taken"]) >= most) | (F.size(free) == 0), acc["taken"]).otherwise(F.concat(acc["taken"], F.slice(free, 1, 1))).alias("taken"))

    return step


def snapshot_samples(posts: DataFrame, keys: list[str], quotas: dict[str, int] | None = None, most: int = 5) -> DataFrame:
    """Up to ``most`` posts a key for a prompt: each population's quota in turn, one post an author.

    Within a population the terciles negative, neutral, positive take turns, each giving its first
    post (by event_time, post_id) of an author not yet used; a tercile without one is passed over.
    Posts are (keys, post_id, author_id, source_class, sentiment, exclusions, canonical_id, event_time,
    text). The turns can only reach the first sum(quotas) authors of a population and tercile, by
    their earliest post there, so a key's turns are played over a list of bounded size.
    """
    quotas = quotas or {"broad": 3, "curated": 2}
    own = F.col("canonical_id").isNull() | (F.col("canonical_id") == F.col("post_id"))
    rows = posts.where(F.col("sentiment").isNotNull() & (F.size(F.coalesce("exclusions", F.array().cast("array<string>"))) == 0) & own & F.col("source_class").isin(*quotas))
    part = F.when(F.col("sentiment") <= -1 / 3, 0).when(F.col("sentiment") >= 1 / 3, 2).otherwise(1)
    shown = F.struct("event_time", "post_id", "author_id", "source_class", "sentiment", F.col("text").alias("display_text"))
    single = rows.groupBy(*keys, "source_class", part.alias("part"), "author_id").agg(F.min(shown).alias("post"))
    reach = Window.partitionBy(*keys, "source_class", "part").orderBy("post.event_time", "post.post_id")
    listed = single.withColumn("nth", F.row_number().over(reach)).where(F.col("nth") <= sum(quotas.values()))
    folded = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source_class", "part", "nth", "post"))).alias("list"))
    start = F.struct(F.array().cast(folded.schema["list"].dataType).alias("taken"))
    for name, quota in quotas.items():
        # a turn is a tercile; a population has had its quota or all its turns after ten rounds
        folded = folded.withColumn("state", F.aggregate(F.sequence(F.lit(0), F.lit(quota * 10 - 1)), start, _turn(name, F.size(start["taken"]) + quota)))
        start = F.col("state")
    out = folded.select(*keys, F.posexplode(F.slice("state.taken", 1, most)).alias("place", "x"))
    return out.select(*keys, "place", *[F.col(f"x.post.{c}").alias(c) for c in ("post_id", "author_id", "source_class", "sentiment", "display_text")])


def seasonal_baseline(history: DataFrame, key: str, now: Column, days: int = 28, least: int = 14, alpha: float = 0.3) -> DataFrame:
    """(key, bucket, center, scale, n, method) by quarter hour of the day over the trailing days.

    Enough values give median and scaled MAD, fewer an exponentially weighted mean and variance in
    time order. A bucket's history is bounded by the trailing days.
    """
    recent = history.where(F.col("value").isNotNull() & (F.col("time") <= now) & (F.col("time") >= now - F.make_dt_interval(F.lit(days))))
    rows = recent.withColumn("bucket", F.floor((F.hour("time") * 60 + F.minute("time")) / 15).cast("int"))
    centers = rows.groupBy(key, "bucket").agg(F.median("value").alias("median"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("time", "value"))).alias("ordered"))
    deviations = rows.join(centers.select(key, "bucket", "median"), [key, "bucket"]).groupBy(key, "bucket").agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("var"))

    def step(acc: Column, x: Column) -> Column:
        diff = x["value"] - acc["mean"]
        return F.when(acc["mean"].isNull(), F.struct(x["value"].cast("double").alias("mean"), F.lit(0.0).alias("var"))).otherwise(
            F.struct((acc["mean"] + alpha * diff).alias("mean"), ((1 - alpha) * (acc["var"] + alpha * diff * diff)).alias("var")))

    folded = centers.withColumn("fold", F.aggregate("ordered", start, step)).join(deviations, [key, "bucket"])
    robust = F.col("n") >= least
    return folded.select(
        key, "bucket", F.when(robust, F.col("median")).otherwise(F.col("fold.mean")).alias("center"),
        F.greatest(F.when(robust, 1.4826 * F.col("mad")).otherwise(F.sqrt("fold.var")), F.lit(1e-6)).alias("scale"),
        "n", F.when(robust, "seasonal").otherwise("ewma_fallback").alias("method"),
    )


def baseline_zscore(values: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """``values`` (key, time, value) with z against the baseline of their bucket; NULL without one."""
    bucket = F.floor((F.hour("time") * 60 + F.minute("time")) / 15).cast("int")
    joined = values.withColumn("bucket", bucket).join(baseline, [key, "bucket"], "left")
    return joined.withColumn("z", F.when(F.col("n") > 0, (F.col("value") - F.col("center")) / F.col("scale")))


def spike(complete: Column, volume_z: Column, authors_z: Column, over_volume: float = 3.0, over_authors: float = 2.0) -> Column:
    return F.when(complete & volume_z.isNotNull() & authors_z.isNotNull(), (volume_z > over_volume) & (authors_z > over_authors))
