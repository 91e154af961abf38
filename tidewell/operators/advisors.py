"""Model advisors as table functions, their budget and degradation rules, and the trail of a cycle.

Replies are a table (decision_id, attempt, text, tokens_in, tokens_out); asking a model is not part of
the engine. The first of two attempts that parses as a whole counts; whatever is missing, over budget
or unreadable ends as the safe default, flat or abstaining.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import token_cost
from tidewell.operators.bars import cross_source, feature_rows, stale, with_features

ATTEMPTS, THESIS_CHARS, HEALTH_LEAST = 2, 500, 0.8
ACTIONS = ("long", "short", "flat")
TREND = "instrument_id string, action string, raw_score double, thesis string, invalidation_condition string, evidence_feature_ids array<string>"
SENTIMENT = "instrument_id string, direction string, abstain boolean, probability_positive double, expected_excess_return_bps double, confidence double, thesis string, evidence_feature_ids array<string>"


def _loads(text: str):
    text = text.strip()
    if text.startswith("```"):
        text = text.strip("`").strip()
        text = text.removeprefix("json").strip()
    return json.loads(text)


def _number(value) -> bool:
    return isinstance(value, (int, float))


def _texts(value) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def read_trend(text: str | None, known: list[str]) -> list[dict] | None:
    """The forecasts of a trend reply; None unless every one names a known instrument, an action and a numeric score."""
    try:
        found = {}
        for x in _loads(text)["forecasts"]:
            note, ids = x.get("invalidation_condition"), x.get("evidence_feature_ids", [])
            if x["instrument_id"] not in known or x["action"] not in ACTIONS or not _number(x["raw_score"]) or not isinstance(x.get("thesis", ""), str) or not (note is None or isinstance(note, str)) or not _texts(ids):
                return None
            found[x["instrument_id"]] = {"instrument_id": x["instrument_id"], "action": x["action"], "raw_score": float(x["raw_score"]), "thesis": x.get("thesis", "")[:THESIS_CHARS], "invalidation_condition": note, "evidence_feature_ids": ids}
        return list(found.values())
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def read_sentiment(text: str | None, known: list[str]) -> list[dict] | None:
    """The forecasts of a sentiment reply on known instruments, others being skipped; None if one of them is malformed."""
    try:
        found = {}
        for x in _loads(text)["forecasts"]:
            if x["instrument_id"] not in known:
                continue
            if x["direction"] not in ACTIONS:
                return None
            number = lambda key, x=x: None if x.get(key) is None else float(x[key])
            found[x["instrument_id"]] = {
                "instrument_id": x["instrument_id"], "direction": x["direction"], "abstain": bool(x["abstain"]), "probability_positive": number("probability_positive"), "expected_excess_return_bps": number("expected_excess_return_bps"),
                "confidence": float(x["confidence"]), "thesis": str(x.get("thesis", ""))[:THESIS_CHARS], "evidence_feature_ids": [str(i) for i in x.get("evidence_feature_ids", [])],
            }
        return list(found.values())
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _parsed(replies: DataFrame, universe: DataFrame, reader, schema: str) -> DataFrame:
    """The first attempt of each decision whose reply can be read: (decision_id, attempt, entries)."""
    known = universe.groupBy("decision_id").agg(F.collect_set("instrument_id").alias("known"))  # a decision's universe is a handful

    @F.pandas_udf(T.ArrayType(T._parse_datatype_string(f"struct<{schema}>")))
    def read(text: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([reader(t, list(k)) for t, k in zip(text, ids, strict=True)], dtype=object)

    rows = replies.where(F.col("attempt").between(1, ATTEMPTS)).join(known, "decision_id").withColumn("entries", read("text", "known"))
    return rows.where("entries is not null").groupBy("decision_id").agg(F.min("attempt").alias("attempt"), F.min_by("entries", "attempt").alias("entries"))


def over_budget(spent: Column, budget: float, most_per_decision: float) -> Column:
    """Whether an advisor must stay silent: the month's money is used up, or nothing may be spent on a decision."""
    return F.coalesce(spent >= budget, F.lit(False)) | F.lit(most_per_decision <= 0)


def degraded(data_health: Column, features: Column) -> Column:
    """Health below the least, unknown, or no feature (map) with a value."""
    empty = F.coalesce(F.forall(F.map_values(features), lambda v: v.isNull()), F.lit(True))
    return F.coalesce(data_health < HEALTH_LEAST, F.lit(True)) | empty


def provenance(replies: DataFrame, parsed: DataFrame, prices: DataFrame) -> DataFrame:
    """(decision_id, attempt, model_id, reply_hash, cost_usd) of every attempt made: none after one that could be read.

    ``prices`` is (model_id, price_in, price_out) per million tokens; an unknown model costs nothing.
    """
    made = replies.where(F.col("attempt").between(1, ATTEMPTS)).join(parsed.select("decision_id", F.col("attempt").alias("read_at")), "decision_id", "left")
    made = made.where(F.col("read_at").isNull() | (F.col("attempt") <= F.col("read_at"))).join(prices, "model_id", "left")
    cost = token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    return made.select("decision_id", "attempt", "model_id", F.sha2(F.col("text"), 256).alias("reply_hash"), cost.alias("cost_usd"))


def trend_signals(universe: DataFrame, replies: DataFrame, budget: float, most_per_decision: float) -> tuple[DataFrame, DataFrame]:
    """(signals, parsed): one signal for every row of ``universe`` (decision_id, instrument_id, generated_at, spent).

    Over budget, or without a readable entry, the signal is flat with a score of 0.
    """
    asked = universe.withColumn("silent", over_budget(F.col("spent"), budget, most_per_decision))
    parsed = _parsed(replies.join(asked.where("not silent").select("decision_id").distinct(), "decision_id", "left_semi"), universe, read_trend, TREND)
    entries = parsed.select("decision_id", F.col("attempt").alias("run"), F.inline("entries"))
    joined = asked.join(entries, ["decision_id", "instrument_id"], "left").withColumn("answered", F.col("action").isNotNull())
    why = F.when(F.col("silent"), "budget exceeded").when(~F.col("answered"), "no readable reply").otherwise(F.col("thesis"))
    expires = F.col("generated_at") + F.expr("interval 4 hours")
    signals = joined.select("decision_id", "instrument_id", "generated_at", expires.alias("expires_at"), F.coalesce("action", F.lit("flat")).alias("action"), F.coalesce("raw_score", F.lit(0.0)).alias("raw_score"), why.alias("thesis"),
                            "invalidation_condition", F.coalesce("evidence_feature_ids", F.array().cast("array<string>")).alias("evidence_feature_ids"), "run")
    return signals, parsed


def sentiment_forecasts(universe: DataFrame, replies: DataFrame, budget: float, most_per_decision: float) -> tuple[DataFrame, DataFrame]:
    """(forecasts, parsed): one forecast for every row of ``universe`` (decision_id, instrument_id, generated_at, spent, data_health, features).

    Degraded data abstains before the budget is looked at; then as in ``trend_signals``, abstaining by default.
    """
    silent = degraded(F.col("data_health"), F.col("features")) | over_budget(F.col("spent"), budget, most_per_decision)
    asked = universe.withColumn("silent", silent)
    parsed = _parsed(replies.join(asked.where("not silent").select("decision_id").distinct(), "decision_id", "left_semi"), universe, read_sentiment, SENTIMENT)
    entries = parsed.select("decision_id", F.col("attempt").alias("run"), F.inline("entries")).drop("thesis")
    joined = asked.join(entries, ["decision_id", "instrument_id"], "left")
    said = lambda c: F.when(~F.col("silent"), F.col(c))
    forecasts = joined.select(
        "decision_id", "instrument_id", "generated_at", F.coalesce(said("direction"), F.lit("flat")).alias("direction"), F.coalesce(said("abstain"), F.lit(True)).alias("abstain"), said("probability_positive").alias("probability_positive"),
        said("expected_excess_return_bps").alias("expected_excess_return_bps"), F.coalesce(said("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(said("evidence_feature_ids"), F.array().cast("array<string>")).alias("evidence_feature_ids"), said("run").alias("run"),
    )
    return forecasts, parsed


def cycle_trail(universe: DataFrame, intents: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(instrument_id, line): what was decided on every instrument of ``universe`` (instrument_id, current), holding included.

    ``intents`` (instrument_id, side, quantity, effect), ``forecasts`` (instrument_id, advisor_id, action).
    """
    order = F.format_string("%s %s (%s)", "side", F.col("quantity").cast("string"), "effect")
    orders = intents.groupBy("instrument_id").agg(F.array_join(F.array_sort(F.collect_list(order)), "; ").alias("orders"))
    views = forecasts.groupBy("instrument_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "advisor_id", "action"))), ", ").alias("views"))
    joined = universe.join(orders, "instrument_id", "left").join(views, "instrument_id", "left")
    now = F.format_string("current $%.2f", F.col("current").cast("double"))
    hold = F.concat_ws(" | ", F.lit("hold"), now, F.concat(F.lit("views "), F.coalesce("views", F.lit("none"))))
    return joined.select("instrument_id", F.when(F.col("orders").isNull(), hold).otherwise(F.concat_ws(" | ", "orders", now)).alias("line"))


def data_cycle(bars: DataFrame, prices: DataFrame, now: Column, threshold_bps: float, stale_minutes: float, days: int = 7) -> DataFrame:
    """(data_cutoff_at, instruments, features, quality_flags): one snapshot of the last ``days`` of bars, never refused as stale.

    ``prices`` is (instrument_id, mark, reference); an instrument without a mark has features only. The
    oldest of the newest bars tells whether the data is stale.
    """
    recent = bars.where((F.col("close_time") <= now) & (F.col("close_time") >= now - F.make_dt_interval(days=F.lit(days))))
    rows = feature_rows(with_features(recent))
    features = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_id", "value")))).alias("features"))  # nine values an instrument
    bps, far = cross_source(F.col("mark"), F.col("reference"), threshold_bps)
    seen = prices.where("mark is not null").select("instrument_id", "mark", "reference", bps.alias("divergence_bps"), F.when(far, "divergent").otherwise("ok").alias("status"))
    listed = seen.agg(F.array_sort(F.collect_list(F.struct("instrument_id", "mark", "reference", "divergence_bps", "status"))).alias("instruments"))
    newest = recent.groupBy("instrument_id").agg(F.max("close_time").alias("t")).agg(F.min("t").alias("newest"))
    one = features.crossJoin(listed).crossJoin(newest)  # three single rows
    return one.select(now.alias("data_cutoff_at"), "instruments", "features", F.array_compact(F.array(F.when(stale(F.col("newest"), now, stale_minutes), "stale_data"))).alias("quality_flags"))


def newest_forecasts(forecasts: DataFrame, now: Column, most_minutes: float) -> DataFrame:
    """Signals from stored forecasts: the newest of each instrument unless stale, abstaining, flat or without a probability.

    Expected basis points that aren't stated are (p - 0.5) * 200 with a short's sign; the score is the confidence likewise.
    """
    last = Window.partitionBy("instrument_id").orderBy(F.desc("generated_at"), "forecast_id")
    rows = forecasts.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    usable = ~F.coalesce("abstain", F.lit(False)) & F.col("direction").isin("long", "short") & F.col("probability_positive").isNotNull()
    rows = rows.where(~stale(F.col("generated_at"), now, most_minutes) & usable)
    short, size = F.col("direction") == "short", (F.col("probability_positive") - 0.5) * 200
    bps = F.coalesce("expected_excess_return_bps", F.when(short, -F.abs(size)).otherwise(size))
    confidence = F.coalesce("confidence", F.lit(0.0))
    return rows.select("forecast_id", "instrument_id", F.col("direction").alias("action"), F.col("probability_positive").alias("probability"), bps.alias("bps"), F.when(short, -confidence).otherwise(confidence).alias("raw_score"))
