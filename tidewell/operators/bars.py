"""Bar (OHLCV) time series: returns, volatility, range, trend and rule forecasts.

Every function takes bars (instrument_id, close_time, open, high, low, close, volume) and returns
a DataFrame; history is counted in bars, not in wall time. A value that can't be computed is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS_PER_YEAR = 8760
#: Band around both averages inside which a trend counts as none, and the averages' lengths.
TREND_BAND, FAST, SLOW = 0.002, 24, 168


def bars_from_ticks(ticks: DataFrame, instrument: str, time: str, value: str, tie: str, every: str = "hour") -> DataFrame:
    """Bars of one row for each instrument and period that has ticks; ties in time are ordered by ``tie``."""
    at = F.struct(time, tie)
    return ticks.groupBy(F.col(instrument).alias("instrument_id"), F.date_trunc(every, F.col(time)).alias("close_time")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"),
    )


def _w() -> Window:
    return Window.partitionBy("instrument_id").orderBy("close_time")


def _last(n: int):
    return _w().rowsBetween(-(n - 1), 0)


def _full(n: int, value: Column, seen: Column) -> Column:
    return F.when(F.count(seen).over(_last(n)) == n, value)


def log_return(k: int = 1) -> Column:
    """ln(close / close k bars ago); NULL without k earlier bars or where a price isn't positive."""
    before = F.lag("close", k).over(_w())
    return F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before))


def sma(n: int) -> Column:
    return _full(n, F.avg("close").over(_last(n)), F.col("close"))


def true_range() -> Column:
    before = F.lag("close").over(_w())
    widest = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before.isNotNull(), widest)


def with_features(bars: DataFrame, vol_bars: int = 24, atr_bars: int = 14) -> DataFrame:
    """Bars with ret_1, ret_24, rvol, atr, sma_fast, sma_slow and trend."""
    base = bars.withColumns({"ret_1": log_return(1), "ret_24": log_return(24), "tr": true_range(), "sma_fast": sma(FAST), "sma_slow": sma(SLOW)})
    # pairs with a price that isn't positive are skipped, not counted: volatility runs over the returns that exist
    returns = base.where(F.col("ret_1").isNotNull()).select("instrument_id", "close_time", _full(vol_bars, F.stddev_pop("ret_1").over(_last(vol_bars)) * F.sqrt(F.lit(HOURS_PER_YEAR)), F.col("ret_1")).alias("rvol_own"))
    joined = base.join(returns, ["instrument_id", "close_time"], "left")
    carried = F.last("rvol_own", ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, 0))
    atr = _full(atr_bars, F.avg("tr").over(_last(atr_bars)), F.col("tr"))
    return joined.withColumns({"rvol": carried, "atr": atr, "trend": trend(F.col("close"), F.col("sma_fast"), F.col("sma_slow"))}).drop("tr", "rvol_own")


def _offset(price: Column, reference: Column) -> Column:
    return F.when(reference == 0, 0.0).otherwise((price - reference) / reference)


def trend(price: Column, fast: Column, slow: Column) -> Column:
    """up or down where the price is beyond the band of both averages, else chop; NULL without an average."""
    a, b = _offset(price, fast), _offset(price, slow)
    found = F.when((a > TREND_BAND) & (b > TREND_BAND), "up").when((a < -TREND_BAND) & (b < -TREND_BAND), "down").otherwise("chop")
    return F.when(fast.isNotNull() & slow.isNotNull(), found)


def last_bars(bars: DataFrame) -> DataFrame:
    """The newest bar of each instrument."""
    newest = Window.partitionBy("instrument_id").orderBy(F.desc("close_time"))
    return bars.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def feature_rows(featured: DataFrame, version: str = "v1") -> DataFrame:
    """(feature_id, value) of the last bars, ids being ``{instrument}_{name}@{version}``."""
    names = ["ret_1", "ret_24", "rvol", "atr", "sma_fast", "sma_slow"]
    long = last_bars(featured).unpivot("instrument_id", names, "name", "value")
    return long.select(F.concat(F.lower("instrument_id"), F.lit("_"), "name", F.lit(f"@{version}")).alias("feature_id"), "value")


def running_zscore(value: str) -> Column:
    """Z-score against all of an instrument's values so far, the current one included."""
    run = _w().rowsBetween(Window.unboundedPreceding, 0)
    spread = F.stddev_pop(value).over(run)
    return F.when((F.count(value).over(run) >= 2) & (spread > 0), (F.col(value) - F.avg(value).over(run)) / spread)


def change_pct(value: str) -> Column:
    before = F.lag(value).over(_w())
    return F.when(before != 0, (F.col(value) - before) / before * 100)


def momentum(bars: DataFrame, bars_back: int = 168, dead_zone: float = 0.25) -> DataFrame:
    """Volatility-normalised momentum of the last bars: z, action and confidence."""
    run = bars.withColumns({"r": log_return(1), "total": log_return(bars_back)})
    vol = F.stddev_pop("r").over(_last(bars_back)) * F.sqrt(F.lit(HOURS_PER_YEAR))
    run = last_bars(run.withColumn("vol", _full(bars_back, vol, F.col("r"))))
    z = F.when((F.col("vol") > 1e-9) & F.col("total").isNotNull(), F.col("total") / F.col("vol")).otherwise(0.0)
    action = F.when(F.col("z") > dead_zone, "long").when(F.col("z") < -dead_zone, "short").otherwise("flat")
    return run.withColumn("z", z).select("instrument_id", "close_time", "z", action.alias("action"))


def next_label(bars: DataFrame, ahead: int = 24) -> DataFrame:
    """(instrument_id, close_time, label): log return over the next ``ahead`` bars, where they exist."""
    later = F.lead("close", ahead).over(_w())
    return bars.select("instrument_id", "close_time", F.when((F.col("close") > 0) & (later > 0), F.ln(later / F.col("close"))).alias("label")).where("label is not null")


def nearest_price(asked: DataFrame, bars: DataFrame) -> DataFrame:
    """Every row of ``asked`` (instrument_id, at) with the close nearest in time, the earlier bar on a tie.

    The last bar before and the first one after come from running windows over asked times and bars
    together, a day at a time; where the day has none, from the days' own first and last bars. The
    price is NULL only without a time or any bar of the instrument.
    """
    bar = F.struct(F.unix_micros(F.col("close_time").cast("timestamp")).alias("t"), "close")
    known = bars.where("instrument_id is not null and close_time is not null").select("instrument_id", F.lit(None).cast(asked.schema).alias("ask"), bar.alias("bar"))
    wanted = asked.select("instrument_id", F.struct(*asked.columns).alias("ask"), F.lit(None).cast(known.schema["bar"].dataType).alias("bar"))
    rows = wanted.unionByName(known).withColumn("t", F.coalesce("bar.t", F.unix_micros(F.col("ask.at").cast("timestamp")))).withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    day, days = Window.partitionBy("instrument_id", "day"), Window.partitionBy("instrument_id")
    so_far = lambda c, w, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    # of equal times the bars come first in either direction
    within = rows.withColumns({"before": so_far("bar", day.orderBy("t", F.col("bar").isNull()), 0), "after": so_far("bar", day.orderBy(F.desc("t"), F.col("bar").isNull()), 0)}).where("ask is not null")
    ends = rows.groupBy("instrument_id", "day").agg(F.min("bar").alias("first"), F.max("bar").alias("last"))
    around = ends.select("instrument_id", "day", so_far("last", days.orderBy("day"), -1).alias("day_before"), so_far("first", days.orderBy(F.desc("day")), -1).alias("day_after"))
    found = within.join(around, ["instrument_id", "day"], "left").withColumns({"before": F.coalesce("before", "day_before"), "after": F.coalesce("after", "day_after")})
    later = F.col("before").isNull() | (F.col("after.t") - F.col("t") < F.col("t") - F.col("before.t"))
    return found.select("ask.*", F.when(later, F.col("after.close")).otherwise(F.col("before.close")).alias("price"))


def contrarian(scored: DataFrame, health: float = 0.8, bound: float = 2.0) -> DataFrame:
    """Rule forecasts from (z, spike, data_health): fade an extreme that a spike confirms; NULL inputs abstain."""
    ok = F.coalesce((F.col("data_health") >= health) & F.col("z").isNotNull() & F.col("spike").isNotNull(), F.lit(False))
    low, high = ok & (F.col("z") <= -bound) & F.col("spike"), ok & (F.col("z") >= bound) & F.col("spike")
    return scored.withColumns({
        "action": F.when(low, "long").when(high, "short").otherwise("flat"),
        "probability": F.when(~ok, None).when(low, 0.56).when(high, 0.44).otherwise(0.5),
        "abstain": ~ok,
    })


def cross_source(left: Column, right: Column, threshold_bps: float) -> tuple[Column, Column]:
    """Divergence of two prices in basis points of the second, and whether it exceeds the threshold."""
    bps = F.try_divide(F.abs(left - right), right) * 10_000
    return bps, bps > threshold_bps


def stale(newest: Column, now: Column, minutes: float) -> Column:
    """Whether the age exceeds the limit; the limit itself isn't stale."""
    return (F.unix_micros(now) - F.unix_micros(newest)) / 60e6 > minutes


def daily_cohort(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The first row of each key and UTC day."""
    first = Window.partitionBy(key, F.to_date(time)).orderBy(time, tie)
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
