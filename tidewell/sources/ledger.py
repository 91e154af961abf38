"""Append-only ledger tables over Parquet: keyed inserts, references, latest states, outcomes.

Every table is a log. An insert is checked against its keys and references and refused as a whole if
a row breaks them; what a store would update in place is the newest row of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tables: schema, key (None: rows have none), and references (column, table).
TABLES = {
    "forecasts": ("signal_id string, advisor_id string, instrument_id string, generated_at timestamp, snapshot_id string, payload string", "signal_id", ()),
    "intents": ("intent_id string, decision_id string, instrument_id string, created_at timestamp, expires_at timestamp, payload string", "intent_id", ()),
    "risk_verdicts": ("verdict_id string, intent_id string, evaluated_at timestamp, verdict string, payload string", "verdict_id", (("intent_id", "intents"),)),
    "orders": ("order_id string, intent_id string, instrument_id string, state string, at timestamp, payload string", None, (("intent_id", "intents"),)),
    "fills": ("fill_id string, order_id string, instrument_id string, filled_at timestamp, quantity decimal(20,8), price decimal(18,8), payload string", "fill_id", (("order_id", "orders"),)),
    "positions": ("instrument_id string, quantity decimal(20,8), avg_price decimal(18,8), at timestamp, payload string", None, ()),
    "model_provenance": ("model_run_id string, model_provider string, model_id string, request_at timestamp, cost_usd decimal(18,8), payload string", "model_run_id", ()),
    "cost_log": ("model_run_id string, advisor_id string, at timestamp, cost_usd decimal(18,8), payload string", None, ()),
    "halt_state": ("state string, reason string, at timestamp, human_restart_required boolean", None, ()),
    "outbox": ("topic string, at timestamp, payload string", None, ()),
    "research_forecasts": ("forecast_id string, advisor_id string, instrument_id string, generated_at timestamp, horizon_seconds long, payload string", "forecast_id", ()),
    "research_outcomes": ("forecast_id string, realized double, window_close_at timestamp, scored_at timestamp", "forecast_id", (("forecast_id", "research_forecasts"),)),
    "engagement": ("post_id string, observed_at timestamp, likes long, reposts long, replies long, views long", None, ()),
    "query_windows": ("asset string, window_start timestamp, window_end timestamp, complete boolean, payload string", None, ()),
}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's rows; empty if nothing was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], TABLES[table][0])
    return spark.read.schema(TABLES[table][0]).parquet(f"{root}/{table}")


def violations(rows: DataFrame, known: DataFrame, key: str | None, references: tuple[tuple[str, DataFrame, str], ...] = ()) -> DataFrame:
    """(why, value) of new rows that repeat a key, among themselves or of ``known``, or point to nothing: (column, target, its column)."""
    bad = rows.sparkSession.createDataFrame([], "why string, value string")
    if key:
        repeated = rows.groupBy(key).count().where("count > 1").select(key)
        taken = rows.select(key).join(known.select(key), key, "left_semi")
        bad = bad.unionByName(repeated.unionByName(taken).distinct().select(F.lit(f"duplicate {key}").alias("why"), F.col(key).cast("string").alias("value")))
    for column, target, own in references:
        lost = rows.where(F.col(column).isNotNull()).select(column).distinct().join(target.select(F.col(own).alias(column)), column, "left_anti")
        bad = bad.unionByName(lost.select(F.lit(f"unknown {column}").alias("why"), F.col(column).cast("string").alias("value")))
    return bad


def append(rows: DataFrame, root: str, table: str) -> None:
    """Add rows to a table in one job commit; raises and writes nothing if one breaks its key or a reference."""
    spark = rows.sparkSession
    schema, key, references = TABLES[table]
    names = spark.createDataFrame([], schema).columns
    rows = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in names]).to(spark.createDataFrame([], schema).schema)
    targets = tuple((column, read(spark, root, target), column) for column, target in references)
    bad = violations(rows, read(spark, root, table), key, targets).limit(5).collect()
    if bad:
        raise ValueError(f"{table}: " + "; ".join(f"{b.why} {b.value}" for b in bad))
    rows.write.mode("append").parquet(f"{root}/{table}")


def current(log: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """The newest row of each key of a log; with no keys the newest of all. Of equal times the largest row counts."""
    newest = F.max_by(F.struct(*log.columns), F.struct(at, *[c for c in log.columns if c not in (*keys, at)])).alias("x")
    return log.groupBy(*keys).agg(newest).where("x is not null").select("x.*")


def halt_now(log: DataFrame) -> DataFrame:
    """The state in force; NORMAL if none was ever set."""
    one = log.sparkSession.range(1).select(F.lit(1).alias("one"))
    found = one.join(current(log, []).withColumn("one", F.lit(1)), "one", "left")
    return found.select(F.coalesce("state", F.lit("NORMAL")).alias("state"), "reason", "at", F.coalesce("human_restart_required", F.lit(False)).alias("human_restart_required"))


def positions_of(fills: DataFrame) -> DataFrame:
    """(instrument_id, quantity, avg_price) from fills (instrument_id, side, quantity, price): signed sum, and the mean price of its buys."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    bought = F.when(F.col("side") == "buy", F.col("quantity"))
    return fills.groupBy("instrument_id").agg(F.sum(signed).alias("quantity"), F.try_divide(F.sum(bought * F.col("price")), F.sum(bought)).alias("avg_price"))


def order_states(events: DataFrame) -> DataFrame:
    """Each order with its first time, and its newest state and payload; an event without a payload keeps the one before."""
    order = Window.partitionBy("order_id").orderBy("at", "state")
    filled = events.withColumn("payload", F.last("payload", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("at", "state")
    return filled.groupBy("order_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.max_by("state", at).alias("state"), F.max_by("payload", at).alias("payload"))


def resolve_outcomes(outcomes: DataFrame, forecasts: DataFrame, now: Column) -> DataFrame:
    """``outcomes`` (forecast_id, realized) with window_close_at and ``refused``: unknown forecast, window still open, or NULL."""
    known = forecasts.select("forecast_id", F.timestamp_seconds(F.unix_micros("generated_at") / 1_000_000 + F.col("horizon_seconds")).alias("window_close_at"))
    joined = outcomes.join(known, "forecast_id", "left")
    refused = F.when(F.col("window_close_at").isNull(), "unknown forecast").when(now < F.col("window_close_at"), "window open")
    return joined.select("forecast_id", "realized", "window_close_at", refused.alias("refused"))


def record_outcomes(outcomes: DataFrame, root: str, now: Column) -> None:
    """Append the outcomes of closed windows; raises if one is refused."""
    judged = resolve_outcomes(outcomes, read(outcomes.sparkSession, root, "research_forecasts"), now)
    bad = judged.where("refused is not null").limit(5).collect()
    if bad:
        raise ValueError("research_outcomes: " + "; ".join(f"{b.refused} {b.forecast_id}" for b in bad))
    append(judged.drop("refused").withColumn("scored_at", now), root, "research_outcomes")


def with_scores(posts: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """``posts`` with the newest of ``scores`` (key, scored_at, p_negative, p_neutral, p_positive): sentiment = p_positive - p_negative."""
    last = current(scores.select(key, "scored_at", "p_negative", "p_neutral", "p_positive"), [key], "scored_at")
    return posts.join(last, key, "left").withColumn("sentiment", F.col("p_positive") - F.col("p_negative"))


def reconcile(reservations: DataFrame, reports: DataFrame) -> DataFrame:
    """``reservations`` (reservation_id, est_credits, est_usd, ...) with what was reported last, and usd: reported, else estimated.

    ``reports`` is (reservation_id, at, reported_credits, reported_usd, records_returned); repeating one changes nothing.
    """
    last = current(reports, ["reservation_id"]).drop("at")
    joined = reservations.join(last, "reservation_id", "left")
    return joined.withColumns({"reconciled": F.col("reported_usd").isNotNull(), "usd": F.coalesce("reported_usd", "est_usd")})


def snapshot_json(snapshots: DataFrame, flags: str = "quality_flags") -> DataFrame:
    """(snapshot_id, json) of rows to be stored as immutable documents: decimals as strings, flags sorted and distinct."""
    def plain(c: str, kind: str) -> Column:
        return F.col(c).cast("string").alias(c) if kind.startswith("decimal") else F.array_sort(F.array_distinct(c)).alias(c) if c == flags else F.col(c)

    return snapshots.select("snapshot_id", F.to_json(F.struct(*[plain(c, kind) for c, kind in sorted(snapshots.dtypes)])).alias("json"))


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """One line a snapshot, by its id; a snapshot is never written again."""
    snapshot_json(snapshots).write.mode("append").partitionBy("snapshot_id").text(path)
