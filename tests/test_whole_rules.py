"""The operators do the whole job, by rules that the SQL twins don't state."""

import datetime as dt
import re

import duckdb
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import bars as B
from tidewell.plans import market, posts

DIR = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1)
SARCASM = ("sure", "totally", "\U0001f644", '"')
INCIDENTS = ("hack", "exploit", "outage", "halt", "depeg", "rug", "liquidation", "insolvent", "delist", "breach")


def strata(text):
    found = ["sarcasm"] * any(m in text.lower() for m in SARCASM)
    found += ["emoji"] * (len(re.findall("[\U0001f300-\U0001faff☀-➿\U0001f1e6-\U0001f1ff]", text)) >= 2)
    found += ["price_target"] * bool(re.search(r"\$\s?\d|\d+\s?%", text))
    return found + ["incident"] * any(k in text.lower() for k in INCIDENTS)


def test_strata_by_the_whole_rules(spark):
    texts = [*SARCASM, *(f"x{k.upper()}ing" for k in INCIDENTS), "up 5 %", "12%", "5 %", "$\x1f9", "$ 7", "to 7", "yeah right /s", "☀✅", "\U0001f1e9\U0001f1ea", "☀", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strata(F.col("t"), 0).alias("s"))
    assert {r.t: r.s for r in df.collect()} == {t: strata(t) for t in texts}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: [s for s in r.strata.split(",") if s and s != "multi_asset"] for r in posts.post_strata(spark, DIR).collect()}
    assert got == {i: strata(t) for i, t in texts.items()}


def test_nearest_price_without_a_bound(spark):
    bars = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), float(h)) for h in (0, 10, 100)] + [("b", T0, 7.0)], "instrument_id string, close_time timestamp, close double")
    asked = [("a", -500, 0.0), ("a", 0, 0.0), ("a", 5, 0.0), ("a", 6, 10.0), ("a", 55, 10.0), ("a", 56, 100.0), ("a", 56, 100.0), ("a", 5000, 100.0), ("b", 900, 7.0), ("c", 1, None)]
    rows = spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), n) for n, (i, h, _) in enumerate(asked)], "instrument_id string, at timestamp, n int")
    assert [r.price for r in B.nearest_price(rows, bars).orderBy("n").collect()] == [p for _, _, p in asked]


def test_nearest_close_equals_unbounded_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DIR}/events.parquet'")
    want = con.execute(f"""WITH {market.BARS}, a AS (SELECT instrument_id AS i, CAST(epoch(t) AS BIGINT) + 87600 AS asked FROM bars)
SELECT i, asked, min_by(close, row(abs(asked - epoch(t)), epoch(t))) FROM a JOIN bars b ON i = b.instrument_id GROUP BY 1, 2""").fetchall()
    got = [(r.instrument_id, r["at"], r.price) for r in market.nearest_close(spark, DIR).collect()]
    assert sorted(got) == sorted(want)
