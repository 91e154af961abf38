"""Queries over bars, which the ``events`` table stands in for: one instrument for each event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import bars as B
from tidewell.session import read_table

def _hour():
    return F.unix_timestamp("close_time").alias("hour")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_from_ticks(read_table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


def _rounded(df: DataFrame, *names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def bars_hourly(spark, d):
    return hourly(spark, d).select("instrument_id", _hour(), "open", "high", "low", "close", "volume")


def bar_window_features(spark, d):
    f = B.with_features(hourly(spark, d))
    return f.select("instrument_id", _hour(), *_rounded(f, "ret_1", "ret_24", "rvol", "atr", "sma_fast", "sma_slow"), "trend")


def bar_features(spark, d):
    f = B.last_bars(B.with_features(hourly(spark, d)))
    return f.select("instrument_id", _hour(), *_rounded(f, "close", "ret_1", "ret_24", "rvol", "atr", "sma_fast", "sma_slow"), "trend")


def bar_feature_rows(spark, d):
    f = B.feature_rows(B.with_features(hourly(spark, d)))
    return f.select("feature_id", F.round("value", 6).alias("value"))


def running_zscores(spark, d):
    f = hourly(spark, d).withColumns({"z": B.running_zscore("volume"), "change": B.change_pct("volume")})
    return f.select("instrument_id", _hour(), F.round("z", 6).alias("z"), F.round("change", 6).alias("change"))


def momentum_forecasts(spark, d):
    return B.momentum(hourly(spark, d)).select("instrument_id", F.round("z", 6).alias("z"), "action")


def next_day_labels(spark, d):
    return B.next_label(hourly(spark, d)).select("instrument_id", _hour(), F.round("label", 6).alias("label"))


def nearest_close(spark, d):
    """For every bar the close nearest to 24 hours and 20 minutes later."""
    bars = hourly(spark, d)
    asked = bars.select("instrument_id", (F.col("close_time") + F.expr("interval 24 hours 20 minutes")).alias("at"))
    return B.nearest_price(asked, bars).select("instrument_id", F.unix_timestamp("at").alias("at"), "price")


def contrarian_forecasts(spark, d):
    """Volume z-scores with their sign, a busy hour as the spike."""
    z = hourly(spark, d).withColumn("z", B.running_zscore("volume")).withColumn("spike", F.col("volume") >= 3).withColumn("data_health", F.when(F.col("close") > 20, 0.9).otherwise(0.5))
    return B.contrarian(z).select("instrument_id", _hour(), "action", "probability", "abstain")


def cross_source_check(spark, d):
    """Open against close as two sources of one price, and the bar's age at the end of its day."""
    bps, far = B.cross_source(F.col("close"), F.col("open"), 500)
    end = F.date_trunc("day", "close_time") + F.expr("interval 1 day")
    return hourly(spark, d).select("instrument_id", _hour(), F.round(bps, 6).alias("bps"), far.alias("divergent"), B.stale(F.col("close_time"), end, 720).alias("stale"))


def daily_first_bars(spark, d):
    return B.daily_cohort(hourly(spark, d), "instrument_id", "close_time", "open").select("instrument_id", _hour(), "close")


QUERIES = {f.__name__: f for f in (
    bars_hourly, bar_window_features, bar_features, bar_feature_rows, running_zscores, momentum_forecasts, next_day_labels,
    nearest_close, contrarian_forecasts, cross_source_check, daily_first_bars,
)}

BARS = """bars AS (SELECT event_type AS instrument_id, date_trunc('hour', ts) AS t, min_by(value, row(ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, max_by(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
_H = "CAST(epoch(t) AS BIGINT) AS hour"
_FEATURED = f"""WITH {BARS}, b AS (SELECT *, lag(close) OVER w AS p1, lag(close, 24) OVER w AS p24 FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY t)),
c AS (SELECT *, CASE WHEN close > 0 AND p1 > 0 THEN ln(close / p1) END AS ret_1, CASE WHEN close > 0 AND p24 > 0 THEN ln(close / p24) END AS ret_24,
  CASE WHEN p1 IS NOT NULL THEN greatest(high - low, abs(high - p1), abs(low - p1)) END AS tr FROM b),
f AS (SELECT instrument_id, t, close, ret_1, ret_24,
  CASE WHEN count(ret_1) OVER w24 = 24 THEN stddev_pop(ret_1) OVER w24 * sqrt(8760) END AS rvol,
  CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr,
  CASE WHEN count(close) OVER w24 = 24 THEN avg(close) OVER w24 END AS sma_fast,
  CASE WHEN count(close) OVER w168 = 168 THEN avg(close) OVER w168 END AS sma_slow FROM c
  WINDOW w24 AS (PARTITION BY instrument_id ORDER BY t ROWS 23 PRECEDING), w14 AS (PARTITION BY instrument_id ORDER BY t ROWS 13 PRECEDING),
   w168 AS (PARTITION BY instrument_id ORDER BY t ROWS 167 PRECEDING)),
g AS (SELECT *, CASE WHEN sma_fast IS NULL OR sma_slow IS NULL THEN NULL
  WHEN (close - sma_fast) / sma_fast > 0.002 AND (close - sma_slow) / sma_slow > 0.002 THEN 'up'
  WHEN (close - sma_fast) / sma_fast < -0.002 AND (close - sma_slow) / sma_slow < -0.002 THEN 'down' ELSE 'chop' END AS trend FROM f)"""
_R = ", ".join(f"round({n}, 6) AS {n}" for n in ("ret_1", "ret_24", "rvol", "atr", "sma_fast", "sma_slow"))
_LAST = "QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY t DESC) = 1"
_Z = """CASE WHEN count(volume) OVER r >= 2 AND stddev_pop(volume) OVER r > 0 THEN (volume - avg(volume) OVER r) / stddev_pop(volume) OVER r END"""
_RUN = "WINDOW r AS (PARTITION BY instrument_id ORDER BY t ROWS UNBOUNDED PRECEDING)"

ORACLES = {
    "bars_hourly": f"WITH {BARS} SELECT instrument_id, {_H}, open, high, low, close, volume FROM bars",
    "bar_window_features": f"{_FEATURED} SELECT instrument_id, {_H}, {_R}, trend FROM g",
    "bar_features": f"{_FEATURED} SELECT instrument_id, {_H}, round(close, 6) AS close, {_R}, trend FROM g {_LAST}",
    "bar_feature_rows": f"""{_FEATURED}, l AS (SELECT instrument_id, ret_1, ret_24, rvol, atr, sma_fast, sma_slow FROM g {_LAST})
SELECT lower(instrument_id) || '_' || name || '@v1' AS feature_id, round(value, 6) AS value
FROM l UNPIVOT INCLUDE NULLS (value FOR name IN (ret_1, ret_24, rvol, atr, sma_fast, sma_slow))""",
    "running_zscores": f"""WITH {BARS} SELECT instrument_id, {_H}, round({_Z}, 6) AS z,
round(CASE WHEN lag(volume) OVER w <> 0 THEN (volume - lag(volume) OVER w) / lag(volume) OVER w * 100 END, 6) AS change
FROM bars {_RUN}, w AS (PARTITION BY instrument_id ORDER BY t)""",
    "momentum_forecasts": f"""WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(close / lag(close, 168) OVER w) AS total FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY t)),
v AS (SELECT instrument_id, t, total, CASE WHEN count(r) OVER w = 168 THEN stddev_pop(r) OVER w * sqrt(8760) END AS vol FROM a WINDOW w AS (PARTITION BY instrument_id ORDER BY t ROWS 167 PRECEDING)),
z AS (SELECT instrument_id, CASE WHEN vol > 1e-9 AND total IS NOT NULL THEN total / vol ELSE 0 END AS z FROM v {_LAST})
SELECT instrument_id, round(z, 6) AS z, CASE WHEN z > 0.25 THEN 'long' WHEN z < -0.25 THEN 'short' ELSE 'flat' END AS action FROM z""",
    "next_day_labels": f"""WITH {BARS}, a AS (SELECT *, lead(close, 24) OVER (PARTITION BY instrument_id ORDER BY t) AS later FROM bars)
SELECT instrument_id, {_H}, round(ln(later / close), 6) AS label FROM a WHERE later > 0 AND close > 0""",
    "nearest_close": f"""WITH {BARS}, a AS (SELECT instrument_id AS i, CAST(epoch(t) AS BIGINT) + 87600 AS asked FROM bars)
SELECT i AS instrument_id, asked AS "at", min_by(close, row(abs(asked - epoch(t)), epoch(t))) AS price
FROM a JOIN bars b ON i = b.instrument_id GROUP BY 1, 2""",
    "contrarian_forecasts": f"""WITH {BARS}, z AS (SELECT instrument_id, t, {_Z} AS z, volume >= 3 AS spike, CASE WHEN close > 20 THEN 0.9 ELSE 0.5 END AS h FROM bars {_RUN}),
k AS (SELECT *, coalesce(h >= 0.8 AND z IS NOT NULL, false) AS ok FROM z)
SELECT instrument_id, {_H}, CASE WHEN ok AND z <= -2 AND spike THEN 'long' WHEN ok AND z >= 2 AND spike THEN 'short' ELSE 'flat' END AS action,
CAST(CASE WHEN NOT ok THEN NULL WHEN z <= -2 AND spike THEN 0.56 WHEN z >= 2 AND spike THEN 0.44 ELSE 0.5 END AS DOUBLE) AS probability, NOT ok AS abstain FROM k""",
    "cross_source_check": f"""WITH {BARS} SELECT instrument_id, {_H}, round(abs(close - open) / open * 10000, 6) AS bps, abs(close - open) / open * 10000 > 500 AS divergent,
epoch(date_trunc('day', t) + INTERVAL 1 DAY) - epoch(t) > 43200 AS stale FROM bars""",
    "daily_first_bars": f"WITH {BARS} SELECT instrument_id, {_H}, close FROM bars QUALIFY row_number() OVER (PARTITION BY instrument_id, CAST(t AS DATE) ORDER BY t) = 1",
}
