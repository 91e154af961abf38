"""Queries around a decision cycle: fetches, advisors, ledger logs, reports. Orders, events and nations stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import advisors as A
from tidewell.operators import evaluation as E
from tidewell.operators import portfolio as P
from tidewell.operators import views as V
from tidewell.plans import evaluation, market, posts, sentiment
from tidewell.session import read_table
from tidewell.sources import ledger, search

NOW = "2024-01-20 12:00:00"
QUOTAS = {"sarcasm": 60, "emoji": 60, "price_target": 60, "multi_asset": 40, "incident": 40}


def _now():
    return F.lit(NOW).cast("timestamp")


def _searches(spark, d):
    """Every event type over ranges of five days; its events are the posts."""
    e = read_table(spark, d, "events").select(F.col("event_type").alias("asset"), F.unix_timestamp("ts").alias("at"))
    start = F.floor(F.col("at") / 432_000) * 432_000
    asked = e.select("asset", start.alias("lo"), (start + 431_999).alias("hi")).distinct()
    return asked.withColumn("request", F.concat_ws(":", "asset", F.col("lo").cast("string"))), e


def search_parts(spark, d):
    asked, e = _searches(spark, d)
    return search.resolve_windows(asked, e, 100)[0].select("request", "lo", "hi", "found", F.col("taken").cast("long").alias("taken"), "complete", "fetched")


def search_records(spark, d):
    asked, e = _searches(spark, d)
    return search.resolve_windows(asked, e, 100)[1].select("request", "asset", F.col("fetched_count").cast("long").alias("fetched_count"), "complete", "truncation_reason")


def timelines(spark, d):
    """Users' events as timelines, read back to a time over at most three pages."""
    e = read_table(spark, d, "events").select((F.col("user_id") % 60).alias("author"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("post_id"))
    found = search.read_timeline(e, F.lit("2024-01-10").cast("timestamp"), 3)[1]
    return found.select("author", F.col("pages").cast("long").alias("pages"), "fetched_count", "complete", "truncation_reason")


def order_logs(spark, d):
    """Each user's events as the log of one order."""
    e = read_table(spark, d, "events").select(F.col("user_id").alias("order_id"), F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"), F.when(F.col("value") > 50, F.col("props")).alias("payload"))
    found = ledger.order_states(e)
    return found.select("order_id", F.col("created_at.event_id").alias("first_event"), F.col("updated_at.event_id").alias("last_event"), "state", "payload")


def positions(spark, d):
    fills = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("instrument_id"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return ledger.positions_of(fills).select("instrument_id", F.round("quantity", 4).alias("quantity"), F.round("avg_price", 4).alias("avg_price"))


def refused_rows(spark, d):
    """Line items as fills that repeat a key or belong to no finished order."""
    o = read_table(spark, d, "orders").where("o_orderstatus = 'F'")
    fills = read_table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("order_id"), (F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4).alias("fill_id"))
    known = read_table(spark, d, "lineitem").where("l_orderkey % 100 = 0").select((F.col("l_orderkey") * 4).alias("fill_id"))
    return ledger.violations(fills, known, "fill_id", (("order_id", o, "o_orderkey"),))


def resolved_outcomes(spark, d):
    """Orders as forecasts of 1 to 90 days, line items as their outcomes."""
    o = read_table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("forecast_id"), F.col("o_orderdate").cast("timestamp").alias("generated_at"), ((F.col("o_custkey") % 90 + 1) * 86_400).alias("horizon_seconds"))
    l = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("forecast_id")).agg(F.max("l_tax").alias("realized"))  # noqa: E741
    found = ledger.resolve_outcomes(l, o, F.lit("1998-06-01").cast("timestamp"))
    return found.select("forecast_id", "realized", F.unix_timestamp("window_close_at").alias("window_close"), "refused")


def reconciled(spark, d):
    """Orders as reservations, some line items as reports; the newest report of a reservation counts."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("reservation_id"), (F.col("o_totalprice") / 1000).alias("est_usd"))
    l = read_table(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("reservation_id"), F.struct("l_shipdate", "l_linenumber", "l_quantity").alias("at"), F.col("l_quantity").alias("reported_credits"), (F.col("l_extendedprice") / 1000).alias("reported_usd"), F.col("l_linenumber").alias("records_returned"))  # noqa: E741
    return ledger.reconcile(o, l).select("reservation_id", F.round("usd", 6).alias("usd"), "reconciled")


def newest_signals(spark, d):
    o = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("forecast_id"), F.col("o_custkey").alias("instrument_id"), F.col("o_orderdate").cast("timestamp").alias("generated_at"), (F.col("o_orderkey") % 11 == 0).alias("abstain"),
        F.when(F.col("o_orderstatus") == "F", "long").when(F.col("o_orderstatus") == "O", "short").otherwise("flat").alias("direction"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 100 / 100).alias("probability_positive"),
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 300).cast("double")).alias("expected_excess_return_bps"), F.when(F.col("o_orderkey") % 7 != 0, 0.5 + F.col("o_custkey") % 5 / 10).alias("confidence"),
    )
    found = A.newest_forecasts(o, F.lit("1998-08-01").cast("timestamp"), 525_600)
    return found.select("forecast_id", "instrument_id", "action", "probability", F.round("bps", 6).alias("bps"), "raw_score")


def _universe(spark, d):
    """Regions decide on their nations; the third has no money left."""
    n = read_table(spark, d, "nation")
    return n.select(F.col("n_regionkey").alias("decision_id"), F.col("n_name").alias("instrument_id"), _now().alias("generated_at"), F.when(F.col("n_regionkey") == 2, 30.0).otherwise(5.0).alias("spent"), (F.col("n_nationkey") * 1000 - 9000).cast("double").alias("current"))


def _replies(spark, d):
    """Two attempts a region: names another region's nation first, no JSON first, fenced, or without the first nation."""
    n, k = read_table(spark, d, "nation"), F.col("n_nationkey")
    entry = F.to_json(F.struct(F.col("n_name").alias("instrument_id"), F.element_at(F.array(*[F.lit(a) for a in A.ACTIONS]), (k % 3 + 1).cast("int")).alias("action"), (k / 10 - 1).alias("raw_score"), F.concat(F.lit("on "), "n_name").alias("thesis")))
    listed = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", entry.alias("entry")))).alias("x"))
    whole = lambda x: F.concat(F.lit('{"forecasts": ['), F.array_join(F.transform(x, lambda e: e["entry"]), ", "), F.lit("]}"))
    r, x = F.col("n_regionkey"), F.col("x")
    other = F.concat(F.lit('{"forecasts": [{"instrument_id": "ELSEWHERE", "action": "long", "raw_score": 1}]}'))
    first = F.when(r == 0, other).when(r == 1, "I can't say").when(r == 4, whole(F.slice(x, 2, 100))).otherwise(F.concat(F.lit("```json\n"), whole(x), F.lit("\n```")))
    row = lambda i, text: listed.select(r.alias("decision_id"), F.lit(i).alias("attempt"), text.alias("text"), F.lit("m1").alias("model_id"), (1000 * i + r).alias("tokens_in"), F.lit(500).alias("tokens_out"))
    return row(1, first).unionByName(row(2, F.when(r == 0, F.lit("{}")).otherwise(whole(x))))


def trend_signals(spark, d):
    found, _ = A.trend_signals(_universe(spark, d), _replies(spark, d), 25, 0.05)
    return found.select("decision_id", "instrument_id", F.unix_timestamp("expires_at").alias("expires"), "action", F.round("raw_score", 6).alias("raw_score"), "thesis", "run")


def reply_costs(spark, d):
    _, parsed = A.trend_signals(_universe(spark, d), _replies(spark, d), 25, 0.05)
    prices = spark.createDataFrame([("m1", 3.0, 15.0)], "model_id string, price_in double, price_out double")
    asked = _replies(spark, d).where("decision_id <> 2")
    return A.provenance(asked, parsed, prices).select("decision_id", "attempt", "model_id", F.round("cost_usd", 6).alias("cost_usd"))


def cycle_lines(spark, d):
    """What is decided on every nation: trades of those that a customer count moves, views of the signals."""
    u = _universe(spark, d)
    trades = u.where("current % 2000 = 0").select("instrument_id", F.when(F.col("current") > 0, "sell").otherwise("buy").alias("side"), F.abs(F.col("current") / 100).cast("int").alias("quantity"), F.lit("reduce").alias("effect"))
    signals, _ = A.trend_signals(u, _replies(spark, d), 25, 0.05)
    return A.cycle_trail(u, trades, signals.select("instrument_id", F.lit("trend").alias("advisor_id"), "action"))


def provisional_records(spark, d):
    """Records of customers' segments as advisors, with the baseline's buckets."""
    c = read_table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("advisor_id")).agg(F.when(F.min("c_custkey") % 2 == 0, "provisional").otherwise("retired").alias("status"), F.lit(True).alias("enabled"), F.lit(0.25).alias("provisional_reliability"))
    records, buckets = P.track_records(c)
    return buckets.join(records, "advisor_id").select("advisor_id", "reliability", "samples", "place", "low", "high", "rate")


def report_metrics(spark, d):
    """The weekly report's figures; the random rule is tested on its frequencies."""
    f = evaluation.forecasts(spark, d).withColumnRenamed("key", "advisor_id")
    costs = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("advisor_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    found = E.report_metrics(f, costs, "1-URGENT").where("against <> 'random_same_frequency'")
    return found.select("advisor_id", "against", "n", *[F.round(c, 6).alias(c) for c in ("coverage", "abstention", "hit_rate", "brier", "net_ic")], F.round(F.col("spent").cast("double"), 2).alias("spent"))


def weekly_reports(spark, d):
    f = evaluation.forecasts(spark, d).withColumnRenamed("key", "advisor_id")
    costs = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("advisor_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    return E.weekly_report(E.report_metrics(f, costs, "1-URGENT"), "all weeks")


def effective_samples(spark, d):
    o = read_table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), (F.count_distinct("o_custkey") % 7 - 1).alias("overlap"))
    return o.select("o_orderpriority", F.round(E.effective_sample_size(F.col("n"), F.col("overlap")), 6).alias("effective"))


def labelling_sample(spark, d):
    """Documents drawn for labelling by stratum."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    rows = docs.withColumn("strata", X.strata(F.col("text"), F.size(X.mentions(F.col("text"), posts.ASSETS))))
    return E.stratified_sample(rows, "doc_id", "strata", QUOTAS, 40).select("doc_id", "drawn_for")


def data_snapshot(spark, d):
    """A snapshot of the events' bars, the last close as mark and the last open as reference."""
    bars, at = market.hourly(spark, d), F.col("close_time")
    last = bars.where(at <= _now()).groupBy("instrument_id").agg(F.max_by("close", "close_time").alias("mark"), F.max_by("open", "close_time").alias("reference"))
    found = A.data_cycle(bars, last, _now(), 500, 240)
    return found.select(F.explode("instruments").alias("x"), F.size("features").alias("features"), F.array_join("quality_flags", ",").alias("flags")).select("x.instrument_id", "x.mark", "x.reference", F.round("x.divergence_bps", 4).alias("divergence_bps"), "x.status", "features", "flags")


def sentiment_history(spark, d):
    """Author-first sentiment of every asset and hour."""
    found = V.hourly_sentiment(sentiment.posts(spark, d))
    return found.select("asset", F.unix_timestamp("hour").alias("hour"), "n", F.round("sent_mean", 6).alias("sent_mean"), F.round("sent_weighted", 6).alias("sent_weighted"))


def listed_posts(spark, d):
    """The second page of negative posts of ten days, on either half of the assets."""
    rows = sentiment.posts(spark, d).withColumns({"is_deleted": F.col("post_id") % 37 == 0, "asset_mentions": F.when(F.col("post_id") % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))})
    page = V.post_page(rows, _now(), limit=50, offset=20, hours=240, asset="B", label="negative")[1]
    return page.select("post_id", "label", F.round("sentiment", 6).alias("sentiment"))


def merged_history(spark, d):
    """Orders as both ledgers' forecasts with JSON payloads, some of them broken."""
    o = read_table(spark, d, "orders")
    text = lambda c: F.when(F.col("o_orderkey") % 9 == 0, "{broken").otherwise(F.to_json(c))
    own = F.struct(F.when(F.col("o_orderstatus") == "F", "long").otherwise("short").alias("action"), (F.col("o_custkey") % 7).cast("double").alias("raw_score"))
    other = F.struct((F.col("o_orderkey") % 5 == 0).alias("abstain"), F.lit("long").alias("direction"), (F.col("o_custkey") % 5 / 10).alias("confidence"), F.when(F.col("o_orderkey") % 3 == 0, 0.5).alias("probability_positive"))
    base = [F.col("o_orderdate").cast("timestamp").alias("generated_at"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("advisor_id"), F.col("o_orderkey").alias("instrument_id")]
    found = V.forecast_history(o.where("o_orderkey % 2 = 0").select(*base, text(own).alias("payload")), o.where("o_orderkey % 2 = 1").select(*base, text(other).alias("payload")), F.lit("1997-01-01").cast("timestamp"))
    return found.select(F.unix_timestamp("generated_at").alias("generated"), "advisor_id", "instrument_id", "action", "raw_score", "p_plus")


def book_exposures(spark, d):
    """Gross and net of customers' balances by segment."""
    c = read_table(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("notional"))
    return V.exposure_totals(c, ["c_mktsegment"]).select("c_mktsegment", F.round("gross", 2).alias("gross"), F.round("net", 2).alias("net"))


def validation_lines(spark, d):
    return E.validation_report(evaluation.labelled(spark, d), "true", "said", "confidence")


QUERIES = {f.__name__: f for f in (
    sentiment_history, listed_posts, merged_history, book_exposures, validation_lines, search_parts, search_records, timelines, order_logs, positions, refused_rows, resolved_outcomes, reconciled, newest_signals, trend_signals, reply_costs, cycle_lines, provisional_records,
    report_metrics, weekly_reports, effective_samples, labelling_sample, data_snapshot,
)}

_PARTS = """RECURSIVE e AS (SELECT event_type AS asset, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), asked AS (SELECT DISTINCT asset, sec // 432000 * 432000 AS lo, sec // 432000 * 432000 + 431999 AS hi FROM e),
cut AS (SELECT asset || ':' || lo AS request, asset, lo, hi, (SELECT count(*) FROM e WHERE e.asset = asked.asset AND sec BETWEEN lo AND hi) AS found FROM asked UNION ALL
SELECT request, asset, a, b, (SELECT count(*) FROM e WHERE e.asset = h.asset AND sec BETWEEN a AND b) FROM (SELECT request, asset, unnest([lo, (lo + hi) // 2 + 1]) AS a, unnest([(lo + hi) // 2, hi]) AS b FROM cut WHERE found > 20 AND hi - lo > 30) h),
leaf AS (SELECT request, lo, hi, found, found <= 20 AS complete, least(found, 20) AS taken FROM cut WHERE found > 0 AND (found <= 20 OR hi - lo <= 30)),
parts AS (SELECT *, coalesce(sum(taken) OVER (PARTITION BY request ORDER BY lo DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 AS fetched FROM leaf)"""
_SIGNALS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation),
s AS (SELECT n_regionkey AS decision_id, n_name AS instrument_id, n_nationkey AS k, CASE n_regionkey WHEN 2 THEN NULL WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 4 THEN CASE WHEN i > 1 THEN 1 END ELSE 1 END::INT AS run FROM n),
signals AS (SELECT decision_id, instrument_id, epoch(TIMESTAMP '{NOW}' + INTERVAL 4 HOUR)::BIGINT AS expires, CASE WHEN run IS NULL THEN 'flat' ELSE ['long', 'short', 'flat'][k % 3 + 1] END AS action, round(CASE WHEN run IS NULL THEN 0 ELSE k / 10.0::DOUBLE - 1 END, 6) AS raw_score,
CASE WHEN decision_id = 2 THEN 'budget exceeded' WHEN run IS NULL THEN 'no readable reply' ELSE 'on ' || instrument_id END AS thesis, run FROM s)"""

ORACLES = {
    "sentiment_history": f"""WITH {sentiment._POSTS}, p AS (SELECT *, date_trunc('hour', event_time) AS hour FROM posts), c AS (SELECT asset, hour, count(*) AS n FROM p GROUP BY 1, 2), m AS {sentiment._means('p', 'asset, hour')}
SELECT asset, epoch(hour)::BIGINT AS hour, n, round(sent_mean, 6) AS sent_mean, round(sent_weighted, 6) AS sent_weighted FROM c LEFT JOIN m USING (asset, hour)""",
    "listed_posts": f"""WITH {sentiment._POSTS} SELECT post_id, 'negative' AS label, round(sentiment, 6) AS sentiment FROM posts WHERE sentiment < -0.2 AND post_id % 37 <> 0 AND post_id % 2 <> 0 AND event_time >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY ORDER BY event_time DESC, post_id LIMIT 50 OFFSET 20""",
    "merged_history": """SELECT epoch(o_orderdate)::BIGINT AS generated, 'a' || o_custkey || CASE WHEN o_orderkey % 2 = 1 THEN ' (research)' ELSE '' END AS advisor_id, o_orderkey AS instrument_id,
CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'flat' ELSE 'long' END WHEN o_orderstatus = 'F' THEN 'long' ELSE 'short' END AS action,
CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN o_custkey % 5 / 10.0::DOUBLE ELSE (o_custkey % 7)::DOUBLE END AS raw_score, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 0.5::DOUBLE END AS p_plus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""",
    "book_exposures": "SELECT c_mktsegment, round(sum(abs(c_acctbal)), 2) AS gross, round(sum(c_acctbal), 2) AS net FROM customer GROUP BY 1",
    "search_parts": f"WITH {_PARTS} SELECT request, lo, hi, found, taken, complete, fetched FROM parts",
    "search_records": f"""WITH {_PARTS}, g AS (SELECT request, sum(taken) AS n, min(lo) AS oldest, bool_and(complete) AS whole FROM parts WHERE fetched GROUP BY 1),
r AS (SELECT g.request, asset, n, CASE WHEN n >= 100 AND oldest > a.lo THEN 'budget_cap' WHEN NOT whole THEN 'provider_limit' END AS why FROM asked a JOIN g ON g.request = asset || ':' || a.lo)
SELECT request, asset, n::BIGINT AS fetched_count, why IS NULL AS complete, why AS truncation_reason FROM r""",
    "timelines": """WITH p AS (SELECT user_id % 60 AS author, ts, (row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts DESC, event_id DESC) - 1) // 20 AS page FROM events),
g AS (SELECT author, least(coalesce(min(CASE WHEN ts < TIMESTAMP '2024-01-10' THEN page END), max(page)) + 1, 3)::BIGINT AS pages, count_if(page < 3 AND ts >= TIMESTAMP '2024-01-10') AS n FROM p GROUP BY 1)
SELECT author, pages, n::BIGINT AS fetched_count, pages < 3 AS complete, CASE WHEN pages >= 3 THEN 'partial_window' END AS truncation_reason FROM g""",
    "order_logs": """SELECT user_id AS order_id, arg_min(event_id, row(ts, event_id)) AS first_event, arg_max(event_id, row(ts, event_id)) AS last_event, arg_max(event_type, row(ts, event_id)) AS state,
arg_max(props, row(ts, event_id)) FILTER (WHERE value > 50 AND props IS NOT NULL) AS payload FROM events GROUP BY 1""",
    "positions": """WITH f AS (SELECT l_suppkey AS s, l_returnflag = 'R' AS sold, l_quantity AS q, l_extendedprice / l_quantity AS p FROM lineitem)
SELECT s AS instrument_id, round(sum(CASE WHEN sold THEN -q ELSE q END), 4) AS quantity, round(sum(CASE WHEN NOT sold THEN q * p END) / sum(CASE WHEN NOT sold THEN q END), 4) AS avg_price FROM f GROUP BY 1""",
    "refused_rows": """WITH f AS (SELECT l_orderkey AS o, l_orderkey * 4 + l_linenumber % 4 AS k FROM lineitem WHERE l_returnflag = 'A'), t AS (SELECT l_orderkey * 4 AS k FROM lineitem WHERE l_orderkey % 100 = 0)
SELECT 'duplicate fill_id' AS why, k::VARCHAR AS value FROM f GROUP BY k HAVING count(*) > 1 OR k IN (SELECT k FROM t) UNION ALL SELECT DISTINCT 'unknown order_id', o::VARCHAR FROM f WHERE o NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "resolved_outcomes": """WITH l AS (SELECT l_orderkey AS k, max(l_tax) AS realized FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT + (o_custkey % 90 + 1) * 86400 AS c FROM orders WHERE o_orderkey % 3 <> 0)
SELECT l.k AS forecast_id, realized, c AS window_close, CASE WHEN c IS NULL THEN 'unknown forecast' WHEN c > epoch(TIMESTAMP '1998-06-01') THEN 'window open' END AS refused FROM l LEFT JOIN o ON l.k = o.k""",
    "reconciled": """WITH r AS (SELECT l_orderkey AS k, arg_max(l_extendedprice / 1000, row(l_shipdate, l_linenumber, l_quantity, l_quantity, l_extendedprice)) AS usd FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT o_orderkey AS reservation_id, round(coalesce(usd, o_totalprice / 1000), 6) AS usd, usd IS NOT NULL AS reconciled FROM orders LEFT JOIN r ON k = o_orderkey""",
    "newest_signals": """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'long' WHEN 'O' THEN 'short' ELSE 'flat' END AS a, o_custkey % 100 / 100.0::DOUBLE AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)
SELECT o_orderkey AS forecast_id, o_custkey AS instrument_id, a AS action, p AS probability, round(CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 300)::DOUBLE WHEN a = 'short' THEN -abs((p - 0.5) * 200) ELSE (p - 0.5) * 200 END, 6) AS bps,
CASE WHEN o_orderkey % 7 <> 0 THEN 0.5 + o_custkey % 5 / 10.0::DOUBLE ELSE 0 END::DOUBLE * CASE a WHEN 'short' THEN -1 ELSE 1 END AS raw_score
FROM o WHERE epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate) <= 31536000 AND o_orderkey % 11 <> 0 AND a <> 'flat' AND o_orderkey % 5 <> 0""",
    "trend_signals": f"WITH {_SIGNALS} SELECT decision_id, instrument_id, expires, action, raw_score, thesis, run FROM signals",
    "reply_costs": """WITH r AS (SELECT r_regionkey AS k, unnest(CASE WHEN r_regionkey <= 1 THEN [1, 2] ELSE [1] END) AS a FROM region WHERE r_regionkey <> 2) SELECT k AS decision_id, a::INT AS attempt, 'm1' AS model_id, round(((1000 * a + k) * 3.0::DOUBLE + 500 * 15.0::DOUBLE) / 1000000, 6) AS cost_usd FROM r""",
    "cycle_lines": f"""WITH {_SIGNALS}, u AS (SELECT n_name AS i, (n_nationkey * 1000 - 9000)::DOUBLE AS c FROM nation)
SELECT i AS instrument_id, CASE WHEN c::INT % 2000 = 0 THEN CASE WHEN c > 0 THEN 'sell ' ELSE 'buy ' END || abs(c / 100)::INT || ' (reduce) | ' || printf('current $%.2f', c) ELSE 'hold | ' || printf('current $%.2f', c) || ' | views trend:' || action END AS line FROM u JOIN signals ON i = instrument_id""",
    "provisional_records": f"""WITH a AS (SELECT c_mktsegment AS advisor_id, 0.25::DOUBLE AS reliability, 1 AS samples FROM customer GROUP BY 1 HAVING min(c_custkey) % 2 = 0 UNION ALL SELECT '{P.BASELINE}', 1.0, 200),
b(place, low, high, rate) AS (VALUES {', '.join(f'({i}, {lo}::DOUBLE, {hi}::DOUBLE, {r}::DOUBLE)' for i, (lo, hi, r) in enumerate(P.BASELINE_BUCKETS))}) SELECT advisor_id, reliability, samples, place, low, high, rate FROM a, b""",
    "report_metrics": f"""WITH {evaluation._F}, u AS (SELECT key AS advisor_id, 'advisor' AS against, action, p, y, realized, signed FROM g UNION ALL SELECT key, 'always_flat', 'flat', 0.5, y, realized, 0 FROM g UNION ALL SELECT key, 'buy_and_hold', 'long', 1, y, realized, abs(s) FROM g),
m AS (SELECT advisor_id, against, count(*) AS n, {evaluation._SUM}, round(1 - avg((action <> 'flat')::INT), 6) AS abstention FROM u GROUP BY 1, 2), c AS (SELECT o_orderpriority AS k, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE, 2) AS spent FROM orders GROUP BY 1),
r AS (SELECT * FROM m UNION ALL SELECT a.advisor_id, '1-URGENT', b.* EXCLUDE (advisor_id, against) FROM (SELECT DISTINCT advisor_id FROM m WHERE advisor_id <> '1-URGENT') a, (SELECT * FROM m WHERE advisor_id = '1-URGENT' AND against = 'advisor') b)
SELECT advisor_id, against, n, coverage, abstention, hit_rate, brier, net_ic, spent FROM r JOIN c ON k = advisor_id""",
    "effective_samples": """WITH o AS (SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) % 7 - 1 AS v FROM orders GROUP BY 1) SELECT o_orderpriority, round(CASE WHEN v > 0 THEN n / v::DOUBLE ELSE n END, 6) AS effective FROM o""",
    "data_snapshot": f"""WITH {market.BARS}, r AS (SELECT * FROM bars WHERE t <= TIMESTAMP '{NOW}'), m AS (SELECT instrument_id, arg_max(close, t) AS mark, arg_max(open, t) AS reference FROM r GROUP BY 1),
w AS (SELECT count(DISTINCT instrument_id) * 6 AS features, min(x) AS newest FROM (SELECT instrument_id, max(t) AS x FROM r WHERE t >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1))
SELECT instrument_id, mark, reference, round(abs(mark - reference) / reference * 10000, 4) AS divergence_bps, CASE WHEN abs(mark - reference) / reference * 10000 > 500 THEN 'divergent' ELSE 'ok' END AS status, features::INT AS features, CASE WHEN epoch(TIMESTAMP '{NOW}') - epoch(newest) > 14400 THEN 'stale_data' ELSE '' END AS flags FROM m, w""",
}
