"""Fetches, ledger tables, samples, advisors and orders against brute force and hand-computed facts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import advisors as A
from tidewell.operators import evaluation as E
from tidewell.operators import portfolio as P
from tidewell.operators import risk as K
from tidewell.functions import text as X
from tidewell.operators import scoring
from tidewell.operators import sentiment as S
from tidewell.plans import desk
from tidewell.sources import landing, ledger, search
from tidewell.streaming import posts as stream

T0 = dt.datetime(2026, 1, 1)


def brute_fetch(seconds, lo, hi, most):
    """(posts taken, why incomplete) of a range, newest half first."""
    taken, why = 0, None

    def visit(lo, hi):
        nonlocal taken, why
        if most is not None and taken >= most:
            why = "budget_cap"
            return
        found = sum(lo <= s <= hi for s in seconds)
        if found <= search.PAGE:
            taken += found
        elif hi - lo <= search.LEAST_SECONDS:
            taken, why = taken + search.PAGE, "provider_limit"
        else:
            middle = (lo + hi) // 2
            visit(middle + 1, hi)
            visit(lo, middle)

    visit(lo, hi)
    return taken, why


@pytest.mark.parametrize("most", [None, 45])
def test_search_windows(spark, most):
    rng = random.Random(1)
    rows = {"a": [rng.randrange(5000) for _ in range(150)], "b": [rng.randrange(900, 940) for _ in range(70)] + [4000], "c": [7] * 25, "d": [1, 2]}
    posts = spark.createDataFrame([(k, s) for k, v in rows.items() for s in v], "asset string, at long")
    asked = spark.createDataFrame([(k, k, 0, 4999) for k in [*rows, "e"]], "request string, asset string, lo long, hi long")
    got = {r.request: (r.fetched_count, r.truncation_reason) for r in search.resolve_windows(asked, posts, most)[1].collect()}
    assert got == {k: brute_fetch(rows.get(k, []), 0, 4999, most) for k in [*rows, "e"]}


def test_timeline_stops_at_its_bounds(spark):
    rows = [("a", T0 - dt.timedelta(hours=h), h) for h in range(70)] + [("b", T0, 1)]
    df = spark.createDataFrame(rows, "author string, at timestamp, post_id long")
    kept, records = search.read_timeline(df, F.lit(T0 - dt.timedelta(hours=45)), 50)
    assert kept.where("author = 'a'").count() == 46
    assert {r.author: (r.pages, r.complete) for r in records.collect()} == {"a": (3, True), "b": (1, True)}
    kept, records = search.read_timeline(df, F.lit(T0 - dt.timedelta(hours=45)), 2)
    assert kept.where("author = 'a'").count() == 40 and records.where("author = 'a'").first().truncation_reason == "partial_window"


def test_search_source(spark):
    def page(options, lo, hi):
        found = [(s, "x") for s in range(0, 300, int(options["every"])) if lo <= s <= hi]
        return found[-20:], len(found) > 20

    terms = dict.fromkeys(search.TERMS, "yes")
    with pytest.raises(PermissionError, match="reviewed_by"):
        search.register_search(spark, terms | {"reviewed_by": None}, "tests_search", "at long, text string", page)
    search.register_search(spark, terms, "tests_search", "at long, text string", page)
    got = spark.read.format("tests_search").option("lo", 0).option("hi", 299).option("step", 150).option("every", 2).load()
    assert sorted(r["at"] for r in got.collect()) == list(range(0, 300, 2)) and got.rdd.getNumPartitions() == 2


def test_ledger_tables(spark, tmp_path):
    root = str(tmp_path)
    frame = lambda table, *rows: spark.createDataFrame([tuple(r) for r in rows], ", ".join(ledger.TABLES[table][0].split(", ")[: len(rows[0])]))
    ledger.append(frame("intents", ("i1", "d"), ("i2", "d")), root, "intents")
    with pytest.raises(ValueError, match="duplicate intent_id i1"):
        ledger.append(frame("intents", ("i1", "d"), ("i3", "d")), root, "intents")
    assert ledger.read(spark, root, "intents").count() == 2
    with pytest.raises(ValueError, match="unknown intent_id i9"):
        ledger.append(frame("risk_verdicts", ("v1", "i9")), root, "risk_verdicts")
    ledger.append(frame("risk_verdicts", ("v1", "i1")), root, "risk_verdicts")
    assert ledger.halt_now(ledger.read(spark, root, "halt_state")).first().state == "NORMAL"
    ledger.append(frame("halt_state", ("HARD", "loss", T0), ("SOFT", "x", T0 - dt.timedelta(1))), root, "halt_state")
    assert ledger.halt_now(ledger.read(spark, root, "halt_state")).first().state == "HARD"
    ledger.append(frame("research_forecasts", ("f1", "a", "BTC", T0, 3600)), root, "research_forecasts")
    outcome = spark.createDataFrame([("f1", 0.1)], "forecast_id string, realized double")
    with pytest.raises(ValueError, match="window open f1"):
        ledger.record_outcomes(outcome, root, F.lit(T0 + dt.timedelta(minutes=59)))
    ledger.record_outcomes(outcome, root, F.lit(T0 + dt.timedelta(minutes=60)))
    with pytest.raises(ValueError, match="duplicate"):
        ledger.record_outcomes(outcome, root, F.lit(T0 + dt.timedelta(minutes=61)))
    assert ledger.read(spark, root, "research_outcomes").first().window_close_at == T0 + dt.timedelta(hours=1)
    snap = spark.sql("select 's1' snapshot_id, cast(1.50 as decimal(18,8)) price, array('b', 'a', 'b') quality_flags")
    assert json.loads(ledger.snapshot_json(snap).first().json) == {"snapshot_id": "s1", "price": "1.50000000", "quality_flags": ["a", "b"]}
    posts = spark.createDataFrame([(1,), (2,)], "post_id long")
    scores = spark.createDataFrame([(1, T0, 0.1, 0.2, 0.7), (1, T0 - dt.timedelta(1), 0.9, 0.0, 0.1)], "post_id long, scored_at timestamp, p_negative double, p_neutral double, p_positive double")
    assert {r.post_id: r.sentiment for r in ledger.with_scores(posts, scores, "post_id").collect()} == {1: pytest.approx(0.6), 2: None}


def test_prompt_samples(spark):
    rng = random.Random(3)
    rows = [("k%d" % rng.randrange(6), i, rng.choice([*range(8), None]), rng.choice(["broad", "curated", "other"]), rng.choice([None, *[rng.uniform(-1, 1)] * 6]), ["x"] if rng.random() < 0.1 else [], i - 1 if rng.random() < 0.1 else None, T0 + dt.timedelta(minutes=rng.randrange(30)), f"t{i}") for i in range(160)]
    df = spark.createDataFrame(rows, "k string, post_id long, author_id long, source_class string, sentiment double, exclusions array<string>, canonical_id long, event_time timestamp, text string")
    got = {}
    for r in S.snapshot_samples(df, ["k"]).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.post_id)
    want = {}
    for k in {r[0] for r in rows}:
        used, out = set(), []
        usable = sorted((r for r in rows if r[0] == k and r[4] is not None and not r[5] and r[6] is None), key=lambda r: (r[7], r[1]))
        for population, quota in (("broad", 3), ("curated", 2)):
            own, n = [r for r in usable if r[3] == population], 0
            part = lambda s: 0 if s <= -1 / 3 else 2 if s >= 1 / 3 else 1
            for turn in range(quota * 10):
                found = next((r for r in own if part(r[4]) == turn % 3 and r[2] not in used), None)
                if n < quota and found:
                    used.add(found[2])
                    out.append(found[1])
                    n += 1
        if out:
            want[k] = out[:5]
    assert got == want


def test_stratified_sample(spark):
    rows = [(i, [s for s in ("a", "b") if (i * 7) % {"a": 3, "b": 5}[s] == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, strata array<string>")
    quotas = {"a": 10, "b": 90}
    got = {r.id: r.drawn_for for r in E.stratified_sample(df, "id", "strata", quotas, 12).collect()}
    strata = dict(rows)
    count = lambda name: sum(v == name for v in got.values())
    assert count("a") == 10 and count("random_fill") == 12
    assert count("b") == 60 - sum("b" in strata[i] for i, v in got.items() if v == "a")
    assert all(v == "random_fill" or v in strata[i] for i, v in got.items())


def test_replies(spark):
    good = {"forecasts": [{"instrument_id": "BTC", "action": "long", "raw_score": 1, "thesis": "x" * 600}]}
    assert A.read_trend("```json\n" + json.dumps(good) + "\n```", ["BTC"])[0]["thesis"] == "x" * 500
    bad = [None, "no", "[]", "{}", '{"forecasts": 3}', json.dumps({"forecasts": [{"instrument_id": "ETH", "action": "long", "raw_score": 1}]}), json.dumps({"forecasts": [{"instrument_id": "BTC", "action": "up", "raw_score": 1}]}), json.dumps({"forecasts": [{"instrument_id": "BTC", "action": "long", "raw_score": "1"}]})]
    assert all(A.read_trend(t, ["BTC"]) is None for t in bad if t is not None) and A.read_trend("", ["BTC"]) is None
    entry = {"instrument_id": "BTC", "direction": "short", "abstain": False, "probability_positive": 0.4, "confidence": 0.7}
    reply = json.dumps({"forecasts": [{"instrument_id": "ETH"}, entry]})
    universe = spark.createDataFrame([(1, "BTC", T0, 0.0, 0.9, {"a": 1.0}), (1, "SOL", T0, 0.0, 0.9, {"a": 1.0}), (2, "BTC", T0, 0.0, 0.5, {"a": 1.0}), (3, "BTC", T0, 0.0, 0.9, {"a": None}), (4, "BTC", T0, 30.0, 0.9, {"a": 1.0})],
                                     "decision_id long, instrument_id string, generated_at timestamp, spent double, data_health double, features map<string,double>")
    replies = spark.createDataFrame([(i, a, t) for i in (1, 2, 3, 4) for a, t in ((1, "oops"), (2, reply))], "decision_id long, attempt int, text string")
    found, parsed = A.sentiment_forecasts(universe, replies, 25, 1.0)
    got = {(r.decision_id, r.instrument_id): (r.direction, r.abstain, r.probability_positive, r.run) for r in found.collect()}
    assert got == {(1, "BTC"): ("short", False, 0.4, 2), (1, "SOL"): ("flat", True, None, None), (2, "BTC"): ("flat", True, None, None), (3, "BTC"): ("flat", True, None, None), (4, "BTC"): ("flat", True, None, None)}
    assert [r.attempt for r in parsed.collect()] == [2]


def test_verdicts_and_protection(spark):
    row = {"effect": "open", "side": "buy", "quantity": 1.0, "quantity_unit": "BTC", "mark_price": 100.0, "equity": 1000.0, "atr": 2.0, "limit_price": 100.0, "stop_price": 98.0, "expires_at": T0, "now": T0 - dt.timedelta(hours=1), "halt_state": "NORMAL", "hour_orders": 0, "gross_pct": 0.0, "net_pct": 0.0, "position_pct": 0.0}
    limits = desk.LIMITS | {"max_single_position_pct": 8}
    cases = [({}, "approve_reduced", 0.8), ({"quantity": 0.5}, "approve", 0.5), ({"halt_state": "SOFT"}, "reject", 0), ({"now": T0}, "reject", 0), ({"stop_price": 90.0}, "reject", 0), ({"position_pct": 8.0}, "reject", 0),
             ({"effect": "close", "halt_state": "KILL", "hour_orders": 99, "quantity": 50.0}, "approve", 50.0), ({"effect": "reduce", "now": T0}, "reject", 0), ({"hour_orders": 11}, "reject", 0), ({"side": "sell", "net_pct": -28.0}, "approve_reduced", 0.2), ({"stop_price": None, "quantity": 0.1}, "approve", 0.1)]
    schema = "effect string, side string, quantity double, quantity_unit string, mark_price double, equity double, atr double, limit_price double, stop_price double, expires_at timestamp, now timestamp, halt_state string, hour_orders long, gross_pct double, net_pct double, position_pct double, n int"
    df = spark.createDataFrame([(*(row | change).values(), i) for i, (change, _, _) in enumerate(cases)], schema)
    got = K.evaluate(df, limits).orderBy("n").collect()
    assert [(r.verdict, r.approved_quantity) for r in got] == [(v, pytest.approx(q)) for _, v, q in cases]
    assert got[0].reason_codes == ["max_single_position_pct", "quantity_shrunk_to_pass_caps"] and len(got[10].checks) == 8
    orders = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0), (4, 2.0)], "order_id long, quantity double")
    fills = spark.createDataFrame([(1, 1.5), (2, 0.0), (3, 2.5)], "order_id long, filled double")
    assert {r.order_id: (r.quantity, r.resized) for r in K.resize_protection(orders, fills).collect()} == {1: (1.5, True), 2: (2.0, False), 3: (2.0, False)}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, [f"e{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(0, 9))]) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, n long, items array<string>")
    for over in (0.3, 0.5, 0.8):
        got = {(r.a, r.b): round(r.jaccard, 9) for r in P.similar_pairs(df, "k", "n", "items", over).collect()}
        want = {}
        for k, a, x in rows:
            for h, b, y in rows:
                both, either = len({*x} & {*y}), len({*x} | {*y})
                if k == h and a < b and either and both / either > over:
                    want[a, b] = round(both / either, 9)
        assert got == want


def test_orders_of_a_decision(spark):
    forecasts = spark.createDataFrame([("s1", P.BASELINE, "BTC-PERP", "long", 1.0, None, None, ["a", "b"]), ("s2", "x", "BTC-PERP", "long", 1.0, None, None, ["a", "b"]), ("s3", "y", "BTC-PERP", "short", -1.0, 0.9, -50.0, ["c"])],
                                      "signal_id string, advisor_id string, instrument_id string, action string, raw_score double, probability double, bps double, evidence array<string>")
    records, buckets = P.track_records(spark.createDataFrame([("x", "provisional", True, 0.25), ("y", "provisional", False, 1.0)], "advisor_id string, status string, enabled boolean, provisional_reliability double"))
    market = spark.createDataFrame([("b", "d1", T0, "BTC-PERP", 0.5, 100.0, 2.0, 0.1, 0.0, 5.0), ("b", "d1", T0, "ETH-PERP", 0.5, 10.0, 1.0, 0.1, 30.0, 5.0)], "book string, decision_id string, created_at timestamp, instrument_id string, vol double, price double, atr double, lot double, current double, cost_bps double")
    got = {r.instrument_id: r for r in P.run_cycle(forecasts, records, buckets, market, equity=1000.0, target_pct=10, caps=(100.0, 100.0, 100.0, 100.0), multiple=1.0).collect()}
    assert (got["BTC-PERP"].side, got["BTC-PERP"].effect, got["BTC-PERP"].stop_price, got["BTC-PERP"].quantity_unit) == ("buy", "open", 98.0, "BTC")
    assert (got["ETH-PERP"].side, got["ETH-PERP"].effect, got["ETH-PERP"].quantity, got["ETH-PERP"].reduce_only) == ("sell", "close", 3.0, True)
    assert got["BTC-PERP"].expires_at == T0 + dt.timedelta(hours=4)


def test_features_without_health_or_windows(spark):
    posts = spark.createDataFrame([(1, 7, "BTC", "broad", 0.5, 0.1, 0.2, 0.7, 0.9, 10, 5.0, T0, T0, [], None, "single")], "post_id long, author_id long, asset string, source_class string, sentiment double, p_negative double, p_neutral double, p_positive double, confidence double, followers long, age_days double, event_time timestamp, available_time timestamp, exclusions array<string>, canonical_id long, ambiguity string")
    measures = ", ".join(f"{m} double" for m in S.HEALTH)
    window = lambda *rows: spark.createDataFrame([tuple(r) for r in rows], f"asset string, start timestamp, end timestamp, complete boolean, {measures}")
    assets = spark.createDataFrame([("BTC",), ("ETH",)], "asset string")
    day = dt.timedelta(1)
    whole = S.features(posts, window(("BTC", T0 - day, T0, True, 1.0, 1.0, None, 0.9, 1.0)), assets, F.lit(T0))
    got = {r.asset: r for r in whole.collect()}
    assert (got["BTC"].volume_1h, got["BTC"].sent_mean_1h_broad, got["BTC"].data_health, got["BTC"].quality_flags) == (1, 0.5, pytest.approx(0.9), [])
    assert got["BTC"].volume_baseline.method == "none" and got["BTC"].volume_zscore is None and got["BTC"].spike_flag is None
    assert (got["ETH"].data_health, got["ETH"].volume_1h, got["ETH"].quality_flags) == (0.0, None, ["low_data_health"])
    health = [*S.HEALTH, "data_health", "asset", "quality_flags"]
    assert len(whole.columns) == 27 + len(health) and all(got["ETH"][c] is None for c in whole.columns if c not in health)
    part = S.features(posts, window(("BTC", T0 - day, T0, False, *[1.0] * 5)), assets.where("asset = 'BTC'"), F.lit(T0)).first()
    assert (part.volume_1h, part.volume_24h, part.sent_mean_24h_broad, part.quality_flags) == (None, None, 0.5, ["incomplete_window_1h", "incomplete_window_24h"])


def test_scorer_never_fails_a_batch(spark):
    def load():
        def score(text):
            if text == "bad":
                raise RuntimeError("no")
            return (0.1, 0.2, 0.7) if text else (0.2, 0.6, 0.2)

        return score

    df = spark.createDataFrame([(1, " good "), (2, "bad"), (3, None)], "post_id long, text string")
    got = {r.post_id: r for r in scoring.score_posts(df, "text", load, "v1").collect()}
    assert got[1].sentiment == pytest.approx(0.6) and got[1].confidence == 0.7 and got[1].quality_flags == []
    assert (got[2].sentiment, got[2].quality_flags, got[2].error) == (None, ["unscored"], "no") and got[3].p_neutral == 0.6
    queue = df.withColumns({"sentiment": F.when(F.col("post_id") == 1, 0.5), "is_deleted": F.col("post_id") == 2})
    assert [r.post_id for r in scoring.score_queue(queue, "post_id").collect()] == [3]


def test_streamed_revisions_and_claims(spark, tmp_path):
    folder = tmp_path / "seen"
    batches = [[(1, 1, "a"), (1, 2, "a"), (2, 1, "x")], [(1, 3, "b"), (2, 5, "x"), (3, 1, "n")], [(1, 4, "a"), (1, 2, "late"), (2, 6, "y")]]
    schema = "id long, at timestamp, text string"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), t) for k, m, t in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name, build in (("rev", lambda df: stream.revisions(df, "id", "at", "text")), ("claim", lambda df: stream.first_claims(df, "id", "at", "text"))):
            live = build(spark.readStream.schema(schema).parquet(str(folder)))
            stream.run_available(live, str(tmp_path / name), str(tmp_path / f"{name}-check"))
    got = sorted((r.id, r.content_revision, r.text) for r in spark.read.parquet(str(tmp_path / "rev")).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "x"), (2, 1, "y"), (3, 0, "n")]
    assert sorted((r.id, r.text) for r in spark.read.parquet(str(tmp_path / "claim")).collect()) == [(1, "a"), (2, "x"), (3, "n")]


def test_landing_of_contexts_and_times(spark, tmp_path):
    raw = spark.createDataFrame([('{"universe": [{"name": "BTC"}, {"name": "X"}, {"name": "ETH"}], "contexts": [{"markPx": "1.5"}, {"markPx": "9"}, {"markPx": "2", "funding": "0.1"}]}', '{"data": {"base": "BTC", "amount": "3.25", "currency": "USD"}}')], "contexts string, spot string")
    assert {r.instrument_id: float(r.mark_px) for r in landing.asset_contexts(raw.select("contexts"), ["BTC", "ETH"]).collect()} == {"BTC": 1.5, "ETH": 2.0}
    assert float(landing.spot_prices(raw).first().price) == 3.25
    times = ["Fri, 02 Jan 2026 03:04:05 +0000", "2 Jan 2026 05:04:05 +0200", "Fri, 02 Jan 2026 03:04:05 GMT", "2026-01-02T03:04:05Z", "Fri Jan 02 03:04:05 +0000 2026", "soon"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").select("i", X.parse_created(F.col("t")).alias("t"), X.query_time(X.parse_created(F.col("t"))).alias("q"))
    got = df.orderBy("i").collect()
    assert [r.t for r in got] == [dt.datetime(2026, 1, 2, 3, 4, 5)] * 5 + [None] and got[0].q == "2026-01-02_03:04:05_UTC"
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in landing.read_json_list(spark, str(tmp_path / "a.json"), "a long").collect()) == [1, 2]
    snaps = spark.createDataFrame([("s1", 1), ("s2", 2)], "snapshot_id string, v long")
    ledger.write_snapshots(snaps, str(tmp_path / "snaps"))
    assert landing.read_snapshot(spark, str(tmp_path / "snaps"), "s2", "snapshot_id string, v long").first().v == 2


def test_effective_sample_size(spark):
    df = spark.createDataFrame([(600, 6.0), (600, 0.0), (600, -1.0)], "n long, o double")
    assert [r[0] for r in df.select(E.effective_sample_size(F.col("n"), F.col("o"))).collect()] == [100.0, 600.0, 600.0]
