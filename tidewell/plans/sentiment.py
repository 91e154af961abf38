"""Sentiment queries over ``events`` as scored posts: users are authors, event types are assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import sentiment as S
from tidewell.session import read_table

NOW = "2024-01-15 12:00:00"


def posts(spark, d):
    e = read_table(spark, d, "events")
    p = F.col("value") / 500
    return e.select(
        F.col("event_id").alias("post_id"), F.col("user_id").alias("author_id"), F.col("event_type").alias("asset"),
        F.when(F.col("user_id") % 3 == 0, "curated").otherwise("broad").alias("source_class"), F.when(F.col("event_id") % 11 != 0, F.col("value") / 250 - 1).alias("sentiment"),
        ((1 - p) * 0.8).alias("p_negative"), F.lit(0.2).alias("p_neutral"), (p * 0.8).alias("p_positive"), F.when(F.col("event_id") % 13 != 0, F.abs(p - 0.5) * 2).alias("confidence"),
        F.when(F.col("user_id") % 17 != 0, F.col("user_id") * 37 % 1000).alias("followers"), F.when(F.col("user_id") % 19 != 0, (F.col("user_id") * 7 % 400).cast("double")).alias("age_days"),
        F.col("ts").cast("timestamp").alias("event_time"), (F.col("ts").cast("timestamp") + F.expr("interval 5 minutes")).alias("available_time"), F.array().cast("array<string>").alias("exclusions"),
        F.when(F.col("event_id") % 23 == 0, F.col("event_id") - 1).alias("canonical_id"), F.when(F.col("event_id") % 29 == 0, "multi_asset").when(F.col("event_id") % 31 != 0, "single").alias("ambiguity"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def post_exclusions(spark, d):
    flagged = S.with_author_counts(posts(spark, d), ["asset"]).withColumn("is_deleted", F.col("post_id") % 37 == 0)
    flags = S.exclusion_flags(100, 30, 20)
    return flagged.withColumn("flags", flags).select("post_id", F.array_join("flags", ",").alias("flags"), S.left_out_of_population(F.col("flags")).alias("out"))


def daily_sentiment(spark, d):
    rows = posts(spark, d).withColumn("day", F.to_date("event_time"))
    means = S.population_means(rows, ["asset", "source_class", "day"])
    return means.select("asset", "source_class", F.unix_date("day").alias("day"), *_r("sent_mean", "sent_weighted", "dispersion"), "authors")


def daily_quality(spark, d):
    rows = posts(spark, d).withColumn("day", F.to_date("event_time"))
    names = ["positive_fraction", "negative_fraction", "neutral_mean", "entropy_mean", "low_confidence", "hhi", "top_share", "new_authors", "median_age", "effective_authors"]
    return S.quality(rows, ["asset", "day"]).select("asset", F.unix_date("day").alias("day"), *_r(*names))


def sentiment_deltas(spark, d):
    return S.sentiment_delta(posts(spark, d), ["asset"], _now(), 1, 1).select("asset", *_r("delta"))


def _fetches(spark, d):
    """Fetch windows of six hours with their measures; those without a scoring rate count as whole."""
    at = F.timestamp_seconds(F.floor(F.unix_timestamp("event_time") / 21_600) * 21_600)
    n = F.col("n")
    w = posts(spark, d).groupBy("asset", at.alias("start")).agg(F.count("*").alias("n"))
    measures = {"time_coverage": 1 - (n % 4) / 12, "fetch_success_rate": 1 - (n % 5) / 20, "completeness": F.when(n > 1, 1.0).otherwise(0.9), "scoring_success_rate": F.when(n % 7 != 0, 0.98), "schema_valid_rate": F.lit(0.99)}
    return w.select("asset", "start", (F.col("start") + F.expr("interval 6 hours")).alias("end"), (n > 1).alias("complete"), *[c.alias(k) for k, c in measures.items()])


def sentiment_features(spark, d):
    """All health values and features of every asset at one time of decision."""
    p, now = posts(spark, d), _now()
    counted = p.groupBy("asset", F.timestamp_seconds(F.floor(F.unix_timestamp("event_time") / 900) * 900).alias("time"))
    history = lambda value: S.seasonal_baseline(counted.agg(value.cast("double").alias("value")), "asset", now, least=5)
    found = S.features(p, _fetches(spark, d), p.select("asset").distinct(), now, history(F.count("*")), history(F.count_distinct("author_id")), threshold=0.85, spike_volume=0.5, spike_authors=0.5, least_posts=1, least_authors=1)
    base = [F.col(f"{c}_baseline.{x}").alias(f"{c}_{x}") for c in ("volume", "authors") for x in ("n", "method")]
    rounded = [c for c in found.columns if c not in ("asset", "volume_1h", "volume_24h", "spike_flag", "quality_flags", "volume_baseline", "authors_baseline")]
    centers = [F.round(f"{c}_baseline.{x}", 6).alias(f"{c}_{x}") for c in ("volume", "authors") for x in ("center", "scale")]
    return found.select("asset", "volume_1h", "volume_24h", "spike_flag", *_r(*rounded), *base, *centers, F.array_join("quality_flags", ",").alias("flags"))


def prompt_samples(spark, d):
    """Sample posts of each asset and day for a prompt."""
    rows = posts(spark, d).withColumns({"day": F.unix_date(F.to_date("event_time")), "text": F.concat(F.lit("post "), F.col("post_id").cast("string"))})
    return S.snapshot_samples(rows, ["asset", "day"]).select("asset", "day", "place", "post_id", "author_id", "source_class", "display_text")


def _quarters(spark, d):
    e = read_table(spark, d, "events")
    quarter = F.from_unixtime(F.floor(F.unix_timestamp("ts") / 900) * 900).cast("timestamp")
    return e.groupBy(F.col("event_type").alias("asset"), quarter.alias("time")).agg(F.round(F.sum("value"), 2).alias("value"))


def seasonal_baselines(spark, d):
    found = S.seasonal_baseline(_quarters(spark, d), "asset", _now(), least=5)
    return found.select("asset", "bucket", *_r("center", "scale"), "n", "method")


def seasonal_zscores(spark, d):
    rows = _quarters(spark, d)
    base = S.seasonal_baseline(rows, "asset", _now(), least=5)
    return S.baseline_zscore(rows.where(F.col("time") > _now()), base, "asset").select("asset", F.unix_timestamp("time").alias("t"), F.round("z", 4).alias("z"))


QUERIES = {f.__name__: f for f in (post_exclusions, daily_sentiment, daily_quality, sentiment_deltas, sentiment_features, prompt_samples, seasonal_baselines, seasonal_zscores)}

_POSTS = """posts AS (SELECT event_id AS post_id, user_id AS author_id, event_type AS asset, CASE WHEN user_id % 3 = 0 THEN 'curated' ELSE 'broad' END AS source_class,
CASE WHEN event_id % 11 <> 0 THEN value / 250 - 1 END AS sentiment, (1 - value / 500) * 0.8 AS p_negative, 0.2::DOUBLE AS p_neutral, value / 500 * 0.8 AS p_positive,
CASE WHEN event_id % 13 <> 0 THEN abs(value / 500 - 0.5) * 2 END AS confidence, CASE WHEN user_id % 17 <> 0 THEN user_id * 37 % 1000 END AS followers,
CASE WHEN user_id % 19 <> 0 THEN (user_id * 7 % 400)::DOUBLE END AS age_days, ts AS event_time, ts + INTERVAL 5 MINUTE AS available_time,
CASE WHEN event_id % 23 = 0 THEN event_id - 1 END AS canonical_id, CASE WHEN event_id % 29 = 0 THEN 'multi_asset' WHEN event_id % 31 <> 0 THEN 'single' END AS ambiguity FROM events)"""
_CLEAR = "ambiguity IS DISTINCT FROM 'multi_asset'"


def _means(source: str, by: str) -> str:
    return f"""(SELECT {by}, median(m) AS sent_mean, sum(m * w) / sum(w) AS sent_weighted, CASE WHEN count(*) >= 2 THEN stddev_pop(m) END AS dispersion, count(*) AS authors FROM
(SELECT {by}, author_id, median(sentiment) AS m, 1 + ln(1 + greatest(max(coalesce(followers, 0)), 0)::DOUBLE) AS w FROM {source} WHERE {_CLEAR} AND sentiment IS NOT NULL GROUP BY {by}, author_id) GROUP BY {by})"""


_NOW = f"TIMESTAMP '{NOW}'"
_HRS = f"(epoch_us({_NOW}) - epoch_us(event_time)) / 3.6e9"
_QUARTERS = "q AS (SELECT event_type AS asset, CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 AS t, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"


def _base(p: str) -> str:
    """Tables that end in ``{p}b``, the baseline of ``{p}q`` (asset, t, value)."""
    return f"""{p}r AS (SELECT asset, t, value, CAST(t % 86400 // 900 AS INT) AS bucket FROM {p}q WHERE t <= epoch({_NOW}) AND t >= epoch({_NOW}) - 28 * 86400),
{p}c AS (SELECT asset, bucket, median(value) AS med, count(*) AS n, list(value ORDER BY t) AS vs FROM {p}r GROUP BY 1, 2),
{p}m AS (SELECT asset, bucket, median(abs(value - med)) AS mad FROM {p}r JOIN {p}c USING (asset, bucket) GROUP BY 1, 2),
{p}f AS (SELECT *, list_reduce(list_transform(vs, lambda v: {{'a': v, 'v': 0.0::DOUBLE}}), lambda s, x: {{'a': s.a + 0.3 * (x.a - s.a), 'v': 0.7 * (s.v + 0.3 * (x.a - s.a) * (x.a - s.a))}}) AS e FROM {p}c JOIN {p}m USING (asset, bucket)),
{p}b AS (SELECT asset, bucket, CASE WHEN n >= 5 THEN med ELSE e.a END AS center, greatest(CASE WHEN n >= 5 THEN 1.4826 * mad ELSE sqrt(e.v) END, 1e-6) AS scale, n, CASE WHEN n >= 5 THEN 'seasonal' ELSE 'ewma_fallback' END AS method FROM {p}f)"""


_BASE = f"{_QUARTERS}, {_base('')}"


def _quality(source: str, by: str) -> str:
    """Tables that end in ``w`` and ``h``, shares and author concentration of ``source`` by its columns ``by``."""
    return f"""w AS (SELECT {by}, avg(CASE WHEN sentiment IS NOT NULL THEN CASE WHEN NOT (p_negative >= p_neutral AND p_negative >= p_positive) AND NOT p_neutral >= p_positive THEN 1.0 ELSE 0.0 END END) AS positive_fraction,
avg(CASE WHEN sentiment IS NOT NULL THEN CASE WHEN p_negative >= p_neutral AND p_negative >= p_positive THEN 1.0 ELSE 0.0 END END) AS negative_fraction, avg(CASE WHEN sentiment IS NOT NULL THEN p_neutral END) AS neutral_mean,
avg(CASE WHEN sentiment IS NOT NULL THEN CASE WHEN p_negative > 0 THEN -p_negative * ln(p_negative) ELSE 0 END - p_neutral * ln(p_neutral) + CASE WHEN p_positive > 0 THEN -p_positive * ln(p_positive) ELSE 0 END END) AS entropy_mean,
avg(CASE WHEN confidence IS NOT NULL THEN CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END END) AS low_confidence FROM {source} GROUP BY {by}),
a AS (SELECT {by}, author_id, count(*) AS n, arg_min_null(age_days, row(event_time, post_id)) AS age FROM {source} GROUP BY {by}, author_id),
k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, author_id) AS k FROM a),
h AS (SELECT {by}, sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE AS hhi, sum(CASE WHEN k <= 5 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS top_share, avg(CASE WHEN age IS NOT NULL THEN CASE WHEN age < 30 THEN 1.0 ELSE 0.0 END END) AS new_authors, median(age) AS median_age FROM k GROUP BY {by})"""


_MEASURES = ("time_coverage", "fetch_success_rate", "completeness", "scoring_success_rate", "schema_valid_rate")
_SHARES = ("positive_fraction", "negative_fraction", "neutral_mean", "entropy_mean", "low_confidence", "hhi", "top_share", "new_authors", "median_age")


def _populations(name: str) -> str:
    pick = lambda p, c: f"max(CASE WHEN source_class = '{p}' THEN {c} END)"
    return f"{name} AS (SELECT asset, {', '.join(f'{pick(p, c)} AS sent_mean_{name}_{p}{end}' for p in S.POPULATIONS for c, end in (('sent_mean', ''), ('sent_weighted', '_weighted')))} FROM {name}_means GROUP BY 1)"


def _features() -> str:
    means = [(f"sent_mean_h{w}_{p}{end}", f"sent_mean_{w}h_{p}{end}") for w in (1, 24) for p in S.POPULATIONS for end in ("", "_weighted")]
    tables = ["v", "h1", "h24", "spread", "delta", "w", "h", "volume", "authors"]
    based = [f"CASE WHEN complete_1h THEN coalesce({n}.{c}, {none}) END AS {n}_{c}" for n in ("volume", "authors") for c, none in (("n", "0"), ("method", "'none'"), ("center", "0.0"), ("scale", "1e-6"))]
    good = lambda c: f"CASE WHEN data_health >= 0.85 THEN {c} END"
    rounded = {m: m for _, m in means} | {m: m for m in _SHARES} | {"dispersion_1h": "dispersion", "sent_delta_6h": "delta", "effective_authors": "1 / hhi", "volume_zscore": "vz", "authors_zscore": "az"}
    rounded |= {f"{n}_{c}": f"{n}_{c}" for n in ("volume", "authors") for c in ("center", "scale")}
    plain = {"volume_1h": "CASE WHEN complete_1h THEN coalesce(v1, 0)::BIGINT END", "volume_24h": "CASE WHEN complete_24h THEN coalesce(v24, 0) END", "spike_flag": "CASE WHEN complete_1h AND vz IS NOT NULL AND az IS NOT NULL THEN vz > 0.5 AND az > 0.5 END"}
    plain |= {f"{n}_{c}": f"{n}_{c}" for n in ("volume", "authors") for c in ("n", "method")}
    return f"""WITH {_POSTS}, n0 AS (SELECT asset, CAST(floor(epoch(event_time) / 21600) AS BIGINT) * 21600 AS s, count(*) AS n FROM posts GROUP BY 1, 2),
win AS (SELECT asset, s, n > 1 AS complete, 1 - (n % 4) / 12.0::DOUBLE AS time_coverage, 1 - (n % 5) / 20.0::DOUBLE AS fetch_success_rate, CASE WHEN n > 1 THEN 1.0 ELSE 0.9 END::DOUBLE AS completeness, CASE WHEN n % 7 <> 0 THEN 0.98 END::DOUBLE AS scoring_success_rate, 0.99::DOUBLE AS schema_valid_rate FROM n0),
assets AS (SELECT DISTINCT asset FROM posts),
hm AS (SELECT asset, bool_and(complete) AS complete_24h, {', '.join(f'avg(coalesce({m}, 1.0)) AS {m}' for m in _MEASURES)} FROM win WHERE s < epoch({_NOW}) AND s + 21600 > epoch({_NOW}) - 86400 GROUP BY 1),
h1w AS (SELECT asset, bool_and(complete) AS complete_1h FROM win WHERE s < epoch({_NOW}) AND s + 21600 > epoch({_NOW}) - 3600 GROUP BY 1),
health AS (SELECT asset, coalesce(complete_24h, false) AS complete_24h, coalesce(complete_1h, false) AS complete_1h, {', '.join(f'coalesce({m}, 0.0) AS {m}' for m in _MEASURES)}, least({', '.join(f'coalesce({m}, 0.0)' for m in _MEASURES)}) AS data_health FROM assets LEFT JOIN hm USING (asset) LEFT JOIN h1w USING (asset)),
known AS (SELECT *, {_HRS} AS hours FROM posts WHERE available_time <= {_NOW} AND (canonical_id IS NULL OR canonical_id = post_id)),
e AS (SELECT * FROM known WHERE hours BETWEEN 0 AND 24), o AS (SELECT * FROM e WHERE hours <= 1), clear AS (SELECT * FROM o WHERE {_CLEAR}),
v AS (SELECT asset, count(*) AS v24, count_if(hours <= 1) AS v1, count(DISTINCT CASE WHEN hours <= 1 THEN author_id END) AS a1 FROM e GROUP BY 1),
h1_means AS {_means('o', 'asset, source_class')}, h24_means AS {_means('e', 'asset, source_class')}, {_populations('h1')}, {_populations('h24')}, spread AS {_means('o', 'asset')},
parts AS (SELECT *, CASE WHEN hours BETWEEN 0 AND 1 THEN 'r' WHEN hours BETWEEN 6 AND 7 THEN 'p' END AS part FROM known), near AS (SELECT * FROM parts WHERE part IS NOT NULL), dm AS {_means('near', 'asset, part')},
delta AS (SELECT asset, max(CASE WHEN part = 'r' THEN sent_mean END) - max(CASE WHEN part = 'p' THEN sent_mean END) AS delta FROM dm GROUP BY 1), {_quality('clear', 'asset')},
vq AS (SELECT asset, CAST(floor(epoch(event_time) / 900) AS BIGINT) * 900 AS t, count(*)::DOUBLE AS value FROM posts GROUP BY 1, 2), {_base('v')},
uq AS (SELECT asset, CAST(floor(epoch(event_time) / 900) AS BIGINT) * 900 AS t, count(DISTINCT author_id)::DOUBLE AS value FROM posts GROUP BY 1, 2), {_base('u')},
volume AS (SELECT * FROM vb WHERE bucket = epoch({_NOW})::BIGINT % 86400 // 900), authors AS (SELECT * FROM ub WHERE bucket = epoch({_NOW})::BIGINT % 86400 // 900)
, j AS (SELECT health.*, v1, v24, a1, {', '.join(f'{x} AS {y}' for x, y in means)}, spread.dispersion, delta, {', '.join(_SHARES)}, {', '.join(based)} FROM health {' '.join(f'LEFT JOIN {t} ON health.asset = {t}.asset' for t in tables)}),
z AS (SELECT *, CASE WHEN volume_n > 0 THEN (coalesce(v1, 0) - volume_center) / volume_scale END AS vz, CASE WHEN authors_n > 0 THEN (coalesce(a1, 0) - authors_center) / authors_scale END AS az FROM j)
SELECT asset, {', '.join(f'round({m}, 6) AS {m}' for m in (*_MEASURES, 'data_health'))}, {', '.join(f'round({good(c)}, 6) AS {n}' for n, c in rounded.items())}, {', '.join(f'{good(c)} AS {n}' for n, c in plain.items())},
CASE WHEN data_health < 0.85 THEN 'low_data_health' ELSE concat_ws(',', CASE WHEN NOT complete_1h THEN 'incomplete_window_1h' END, CASE WHEN NOT complete_24h THEN 'incomplete_window_24h' END) END AS flags FROM z"""


ORACLES = {
    "post_exclusions": f"""WITH {_POSTS}, c AS (SELECT *, count(*) OVER (PARTITION BY asset, author_id) AS n FROM posts),
f AS (SELECT post_id, list_filter([CASE WHEN followers IS NULL OR followers < 100 THEN 'low_followers' END, CASE WHEN age_days IS NULL OR age_days < 30 THEN 'young_account' END,
CASE WHEN n > 20 THEN 'author_over_window_cap' END, CASE WHEN sentiment IS NULL THEN 'unscored' END, CASE WHEN post_id % 37 = 0 THEN 'deleted' END,
CASE WHEN canonical_id <> post_id THEN 'non_canonical_duplicate' END, CASE WHEN ambiguity = 'multi_asset' THEN 'multi_asset_ambiguous' END], lambda x: x IS NOT NULL) AS f FROM c)
SELECT post_id, array_to_string(f, ',') AS flags, len(list_filter(f, lambda x: x <> 'multi_asset_ambiguous')) > 0 AS out FROM f""",
    "daily_sentiment": f"""WITH {_POSTS}, p AS (SELECT *, CAST(epoch(date_trunc('day', event_time)) / 86400 AS INT) AS day FROM posts)
SELECT asset, source_class, day, round(sent_mean, 6) AS sent_mean, round(sent_weighted, 6) AS sent_weighted, round(dispersion, 6) AS dispersion, authors FROM {_means('p', 'asset, source_class, day')}""",
    "daily_quality": f"""WITH {_POSTS}, p AS (SELECT *, CAST(epoch(date_trunc('day', event_time)) / 86400 AS INT) AS day FROM posts WHERE {_CLEAR}), {_quality('p', 'asset, day')}
SELECT asset, day, {', '.join(f'round({n}, 6) AS {n}' for n in _SHARES)}, round(1 / hhi, 6) AS effective_authors FROM w JOIN h USING (asset, day)""",
    "sentiment_deltas": f"""WITH {_POSTS}, p AS (SELECT *, CASE WHEN {_HRS} BETWEEN 0 AND 1 THEN 'r' WHEN {_HRS} BETWEEN 6 AND 7 THEN 'p' END AS part FROM posts), q AS (SELECT * FROM p WHERE part IS NOT NULL), m AS {_means('q', 'asset, part')}
SELECT asset, round(max(CASE WHEN part = 'r' THEN sent_mean END) - max(CASE WHEN part = 'p' THEN sent_mean END), 6) AS delta FROM (SELECT DISTINCT asset FROM posts) LEFT JOIN m USING (asset) GROUP BY 1""",
    "sentiment_features": _features(),
    "seasonal_baselines": f"WITH {_BASE} SELECT asset, bucket, round(center, 6) AS center, round(scale, 6) AS scale, n, method FROM b",
    "seasonal_zscores": f"WITH {_BASE} SELECT q.asset, t, round((value - center) / scale, 4) AS z FROM q LEFT JOIN b ON q.asset = b.asset AND t % 86400 // 900 = bucket WHERE t > epoch({_NOW})",
}
