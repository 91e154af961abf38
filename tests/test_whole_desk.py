"""Halts are lifted by people, calls are reserved under all three limits, clusters of any length stay whole."""

import datetime as dt

from tidewell.operators import portfolio as P
from tidewell.operators import risk as K
from tidewell.plans import desk

DIR = "/root/testdata/sf0.01"


def test_halts_are_lifted_by_actions(spark):
    days = spark.createDataFrame([("a", 1, -13.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 3, 0.0, 0.0, 0.0), ("a", 4, 0.0, 0.0, -30.0), ("a", 5, 0.0, 0.0, 0.0), ("a", 6, -6.0, 0.0, 0.0), ("b", 3, -13.0, 0.0, 0.0)], "account string, day int, daily double, weekly double, drawdown double")
    actions = spark.createDataFrame([("a", 3, "human_restart"), ("a", 5, "human_restart"), ("a", 6, "manual_reset"), ("b", 3, "human_restart")], "account string, day int, action string")
    got = {(r.account, r.day): r.state for r in K.halt_states(days, 5, 12, 20, 28, actions).collect()}
    assert [got["a", i] for i in range(1, 7)] == ["HARD", "HARD", "NORMAL", "KILL", "KILL", "SOFT"] and got["b", 3] == "HARD"


def test_calls_meet_three_limits_in_order(spark):
    t = lambda day, hour: dt.datetime(2026, 1, day, hour)
    rows = [(1, t(1, 0), "x", 50, 1.0), (2, t(1, 1), "x", 60, 1.0), (3, t(1, 2), "y", 60, 1.0), (4, t(1, 3), None, 1, 1.0), (5, t(1, 4), "z", 1, 1.0), (6, t(2, 0), "x", 100, 6.5), (7, t(2, 1), "w", 1, 1.0), (8, t(2, 2), "w", 101, 99.0), (9, dt.datetime(2026, 2, 1), "x", 1, 9.0)]
    df = spark.createDataFrame([("k", *r) for r in rows], "account string, attempt long, at timestamp, cycle string, tweets long, usd double")
    got = [r.refused_by for r in K.reserve_calls(df, 3, 100, 10.0).orderBy("attempt").collect()]
    assert got == [None, "max_tweets_per_cycle", None, None, "max_requests_per_day", None, "max_monthly_usd", "max_tweets_per_cycle", None]


def test_cluster_of_a_long_chain(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    members = spark.range(1, 101).withColumnRenamed("id", "n")
    edges = spark.range(1, 90).selectExpr("id as a", "id + 1 as b")
    assert {r.n: r.cluster for r in P.cluster(members, edges, "n").collect()} == {i: 1 if i <= 90 else i for i in range(1, 101)}


def test_supplier_clusters(spark):
    links = [(r.a, r.b) for r in desk.supplier_overlap(spark, DIR).collect()]
    assert links
    got = {r.s_suppkey: r.cluster for r in desk.supplier_clusters(spark, DIR).collect()}
    want = {i: i for i in got}
    while any(want[a] != want[b] for a, b in links):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
