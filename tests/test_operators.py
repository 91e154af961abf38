"""Hand-computed facts of the operators."""

import datetime as dt
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import bars as B
from tidewell.operators import evaluation as E
from tidewell.operators import portfolio as P
from tidewell.operators import revisions as R
from tidewell.operators import risk as K
from tidewell.sources import landing
from tidewell.streaming import posts as stream

T0 = dt.datetime(2026, 1, 1)


def bars(spark, closes):
    rows = [("btc", T0 + dt.timedelta(hours=i), c, c, c, float(c), 1.0) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "instrument_id string, close_time timestamp, open double, high double, low double, close double, volume double")


def test_returns_and_volatility(spark):
    df = bars(spark, [100, 110, 121]).withColumn("r", B.log_return(1))
    assert [r.r for r in df.orderBy("close_time").collect()][1:] == pytest.approx([math.log(1.1)] * 2)
    got = B.with_features(bars(spark, [100, 110, 100]), vol_bars=2).orderBy("close_time").collect()[-1]
    assert got.rvol == pytest.approx(math.log(1.1) * math.sqrt(8760))
    assert got.atr is None and got.trend is None


@pytest.mark.parametrize("closes, want", [(range(100, 268), "up"), (range(300, 132, -1), "down"), ([100] * 168, "chop")])
def test_trend(spark, closes, want):
    assert B.last_bars(B.with_features(bars(spark, closes))).first().trend == want


def test_evaluation_facts(spark):
    rows = [("BTC", "long", 1.0, 0.8, 0.02), ("ETH", "long", 1.0, 0.6, -0.01), ("BTC", "short", -1.0, 0.3, -0.02), ("ETH", "flat", 0.0, None, 0.05)]
    df = spark.createDataFrame(rows, "key string, action string, raw_score double, probability double, realized double")
    got = E.summary(df, []).first()
    assert (got.coverage, got.hit_rate) == pytest.approx((0.75, 2 / 3))
    assert got.brier == pytest.approx(0.49 / 3)
    assert got.net_ic == pytest.approx(0.6933752452815364)
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert constant.agg(E.pearson(F.col("x"), F.col("y"))).first()[0] == 0.0


def test_bootstrap_and_logistic(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(200)], "i int, v double")
    got = E.bootstrap(df, ["v"], ["i"], lambda x: float(x.mean()), reps=50).first()
    assert got.low <= got.middle <= got.high and abs(got.middle - 4.5) < 0.5
    one = spark.createDataFrame([(0.3, 1.0), (0.4, 1.0)], "p double, y double")
    assert E.logistic_calibration(one, "p", "y") == (1.0, 0.0)


def test_random_baseline_has_equal_frequency(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "flat").when(F.col("id") % 4 == 1, "long").otherwise("short").alias("action"), F.lit(1.0).alias("raw_score"), F.lit(None).cast("double").alias("probability"), F.lit(0.1).alias("realized"))
    got = E.baselines(df).where("tag = 'random'").agg(F.avg((F.col("action") == "flat").cast("int")), F.avg((F.col("action") == "long").cast("int"))).first()
    assert tuple(got) == pytest.approx((0.25, 0.25), abs=0.03)


def test_positions_of_a_known_book(spark):
    df = spark.createDataFrame([("b", "BTC", 0.6, 1.0), ("b", "ETH", 0.8, 1.0)], "book string, instrument_id string, vol double, edge double")
    got = {r.instrument_id: r.notional for r in P.size_positions(df, 0.5, 0.2, 10, 1000, 1000, 1000, 1000).collect()}
    assert got["BTC"] / got["ETH"] == pytest.approx(4 / 3)
    risk = (got["BTC"] * 0.6) ** 2 + (got["ETH"] * 0.8) ** 2 + 2 * 0.4 * got["BTC"] * 0.6 * got["ETH"] * 0.8
    assert math.sqrt(risk) == pytest.approx(100)


def test_clusters(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    members = spark.range(1, 8).withColumnRenamed("id", "n")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = {r.n: r.cluster for r in P.cluster(members, edges, "n").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_book_walk(spark):
    levels = spark.createDataFrame([("b", 0, 100.0, 1.0), ("b", 1, 100.1, 1.0), ("b", 2, 100.3, 2.0)], "book string, place int, price double, size double")
    got = K.walk_book(levels, spark.createDataFrame([("b", 2.5)], "book string, quantity double"), 4.5, 20).first()
    assert (got.vwap, got.fee, got.partial, got.rejected) == (pytest.approx(100.1), pytest.approx(0.1126125), False, False)
    assert got.slippage_bps == pytest.approx(10)


def test_halts_and_budget(spark):
    days = spark.createDataFrame([("a", 1, -6.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 3, -13.0, 0.0, 0.0), ("a", 4, 0.0, 0.0, 0.0), ("a", 5, 0.0, 0.0, -30.0), ("a", 6, 0.0, 0.0, 0.0)], "account string, day int, daily double, weekly double, drawdown double")
    assert [r.state for r in K.halt_states(days, 5, 12, 20, 28).orderBy("day").collect()] == ["SOFT", "NORMAL", "HARD", "HARD", "KILL", "KILL"]
    tries = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 7.0), ("k", 3, 4.0), ("k", 4, 1.0)], "k string, i int, v double")
    assert [r.granted for r in K.reserve(tries, "k", "i", "v", 2, 10.0).orderBy("i").collect()] == [True, False, True, False]


def test_revisions(spark):
    seen = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "id int, t int, text string")
    revisions = R.build_revisions(seen, "id", "t", "text")
    assert [(r.content_revision, r.text, r.first_seen, r.last_seen) for r in revisions.orderBy("content_revision").collect()] == [(0, "a", 1, 2), (1, "b", 3, 3), (2, "a", 4, 4)]
    assert R.as_of(revisions, "id", F.lit(2)).first().text == "a"


def test_text(spark):
    df = spark.createDataFrame([("Buy <b>BTC</b> now &amp; https://x.y @me  ok",)], "t string")
    got = df.select(X.dedup_key(F.col("t")).alias("k"), X.model_input(F.col("t"))[0].alias("m"), X.mentions(F.col("t"), {"btc": "bitcoin", "eth": "ether"}).alias("a"), X.compose("t").alias("c"), X.unescape("t").alias("u")).first()
    assert got.k == "buy <b>btc</b> now &amp; ok" and got.m.endswith("<URL> <USER> ok") and got.a == ["btc"] and "& https" in got.u
    ns = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    made = df.select(X.uuid5(str(ns), F.lit("a:b:buy")).alias("u"), X.round_price(F.lit(123456.7), 1).alias("p"), X.token_cost(F.lit(1000), F.lit(500), F.lit(3.0), F.lit(None).cast("double")).alias("c")).first()
    assert made.u == str(uuid.uuid5(ns, "a:b:buy")) and made.p == 123460.0 and made.c == 0.0
    times = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("Fri Jan 02 03:04:05 +0000 2026",), ("x",)], "t string").select(X.parse_time(F.col("t")).alias("t"))
    assert [r.t for r in times.collect()] == [dt.datetime(2026, 1, 2, 3, 4, 5)] * 2 + [None]
    assert df.select(X.json_block(F.lit('```json\n{"a": 1}\n```'))).first()[0] == '{"a": 1}'


def test_landing(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = spark.createDataFrame([("s", "2026-01-01", '{"b": 1, "a": 2}', "x"), ("s", "2026-01-02", "{}", "y")], "source_id string, day string, payload string, ingested_at string")
    landing.write_records(rows, path)
    got = landing.read_records(spark, path, "s", "2026-01-01")
    assert [r.payload for r in got.collect()] == ['{"a":2,"b":1}'] and landing.verify_records(got).isEmpty()
    assert landing.verify_records(got.withColumn("payload", F.lit("{}"))).count() == 1
    assert landing.read_records(spark, str(tmp_path / "none"), "s", "d").isEmpty()
    raw = spark.createDataFrame([('{"bids": [{"px": "99.9", "sz": "1"}], "asks": [{"px": "100", "sz": "2"}]}', '{"BTC": "1.5", "@1": "2"}', '[{"s":"BTC","T":0,"o":"1","h":"2","l":"1","c":"2","v":"3"}]')], "levels string, mids string, candles string")
    assert landing.book_levels(raw.select("levels")).count() == 2
    assert [r.instrument_id for r in landing.middle_prices(raw).collect()] == ["BTC"]
    assert landing.candles(raw).first().close == 2.0


def test_stream_equals_batch(spark, tmp_path):
    folder, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    live = stream.windowed(events(stream.read_stream(spark, folder, schema, "events.parquet")), "ts", "event_type", "value", "6 hours", "6 hours", "1 hour")
    stream.run_available(live, out, str(tmp_path / "check"))
    batch = stream.windowed(events(spark.read.parquet(f"{folder}/events.parquet")), "ts", "event_type", "value", "6 hours", "6 hours", "1 hour")
    got, want = ({(r.event_type, r.end): r.n for r in df.collect()} for df in (spark.read.parquet(out), batch))
    last = max(end for _, end in want)
    assert got and all(got.get(k) == n for k, n in want.items() if k[1] < last - dt.timedelta(hours=6))
