"""Raw landing zone and other files: immutable JSON lines by source and day, snapshots, labelled CSV."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "payload string, payload_hash string, ingested_at string"
LABELS = ("negative", "neutral", "positive")


@F.pandas_udf(T.StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; text that isn't JSON is NULL. Key order is beyond to_json."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return payload.map(one)


def write_records(records: DataFrame, path: str) -> None:
    """Append (source_id, day, payload, ingested_at) with the hash of each payload's canonical form."""
    canonical = records.withColumn("payload", canonical_json("payload"))
    canonical.withColumn("payload_hash", F.sha2("payload", 256)).write.mode("append").partitionBy("source_id", "day").json(path)


def read_records(spark: SparkSession, path: str, source_id: str, day: str) -> DataFrame:
    """The records of one source and day; other partitions aren't read, and a day without files is empty."""
    schema = f"{RECORD}, source_id string, day string"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).where((F.col("source_id") == source_id) & (F.col("day") == day))


def verify_records(records: DataFrame) -> DataFrame:
    """Records whose payload doesn't have its hash."""
    return records.where(~F.sha2("payload", 256).eqNullSafe(F.col("payload_hash")))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV rows with a known label, trimmed and in lower case."""
    schema = "post_id string, model_input_text string, p_negative double, p_neutral double, p_positive double, human_label string"
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.withColumn("human_label", F.lower(F.trim("human_label"))).where(F.col("human_label").isin(*LABELS))


def write_labelling(posts: DataFrame, path: str) -> None:
    posts.write.mode("overwrite").csv(path, header=True)


def newest_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(kind, path) of the newest file of each kind, the kind being the name up to its first dash."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    kind = F.regexp_extract("path", r"([^/]+?)(?:-[^/]*)?\.json$", 1)
    newest = Window.partitionBy("kind").orderBy(F.desc("modificationTime"), F.desc("path"))
    return files.withColumn("kind", kind).withColumn("n", F.row_number().over(newest)).where("n = 1").select("kind", "path")


def book_levels(raw: DataFrame, column: str = "levels") -> DataFrame:
    """(side, level, price, size) of order books given as JSON {"bids": [{"px", "sz"}], "asks": [...]}."""
    parsed = raw.withColumn("b", F.from_json(column, "bids array<struct<px:string,sz:string>>, asks array<struct<px:string,sz:string>>"))
    both = parsed.select(*[c for c in raw.columns if c != column], F.explode(F.create_map(F.lit("bid"), "b.bids", F.lit("ask"), "b.asks")).alias("side", "rows"))
    listed = both.select(*[c for c in both.columns if c != "rows"], F.posexplode("rows").alias("level", "x"))
    return listed.withColumns({"price": F.col("x.px").cast("decimal(18,8)"), "size": F.col("x.sz").cast("decimal(20,8)")}).drop("x")


def middle_prices(raw: DataFrame, column: str = "mids") -> DataFrame:
    """(instrument_id, price) of a JSON map of prices, without keys that start with # or @."""
    prices = F.map_filter(F.from_json(column, "map<string,string>"), lambda k, v: ~F.regexp_like(k, F.lit("^[#@]")))
    return raw.select(F.explode(prices).alias("instrument_id", "text")).select("instrument_id", F.col("text").cast("decimal(18,8)").alias("price"))


def candles(raw: DataFrame, column: str = "candles") -> DataFrame:
    """Bars of JSON arrays of {"s","T","o","h","l","c","v"} with times in milliseconds."""
    schema = "array<struct<s:string,T:bigint,o:string,h:string,l:string,c:string,v:string>>"
    rows = raw.select(F.explode(F.from_json(column, schema)).alias("x"))
    values = [F.col(f"x.{a}").cast("double").alias(b) for a, b in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)]
    return rows.select(F.col("x.s").alias("instrument_id"), F.timestamp_millis("x.T").alias("close_time"), *values)


def asset_contexts(raw: DataFrame, coins: list[str], column: str = "contexts") -> DataFrame:
    """Prices and rates of the coins from JSON {"universe": [{"name"}], "contexts": [...]}, whose arrays match by position."""
    fields = {"markPx": "mark_px", "midPx": "mid_px", "oraclePx": "oracle_px", "funding": "funding", "openInterest": "open_interest", "prevDayPx": "prev_day_px", "dayNtlVlm": "day_volume"}
    schema = f"universe array<struct<name:string>>, contexts array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    rows = raw.withColumn("x", F.from_json(column, schema)).select(*[c for c in raw.columns if c != column], F.explode(F.arrays_zip(F.col("x.universe").alias("asset"), F.col("x.contexts").alias("context"))).alias("x"))
    return rows.where(F.col("x.asset.name").isin(*coins)).select(*[c for c in rows.columns if c != "x"], F.col("x.asset.name").alias("instrument_id"), *[F.col(f"x.context.{a}").cast("decimal(38,18)").alias(b) for a, b in fields.items()])


def spot_prices(raw: DataFrame, column: str = "spot") -> DataFrame:
    """(instrument_id, price, currency) of JSON {"data": {"base", "amount", "currency"}}."""
    rows = raw.select(F.from_json(column, "data struct<base:string,amount:string,currency:string>").alias("x"))
    return rows.select(F.col("x.data.base").alias("instrument_id"), F.col("x.data.amount").cast("decimal(18,8)").alias("price"), F.col("x.data.currency").alias("currency"))


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that each hold one JSON list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_snapshot(spark: SparkSession, path: str, snapshot_id: str, schema: str) -> DataFrame:
    """A stored snapshot by its id; only its own partition is read."""
    lines = spark.read.text(path).where(F.col("snapshot_id") == snapshot_id)
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def load_config(text: str, required: tuple[str, ...] = ()) -> dict:
    """Settings from a YAML document, dotted names of ``required`` being there and not empty."""
    import yaml  # only this function needs it

    config = yaml.safe_load(text) or {}
    for name in required:
        value = config
        for part in name.split("."):
            value = (value or {}).get(part)
        if value is None:
            raise KeyError(name)
    return config
