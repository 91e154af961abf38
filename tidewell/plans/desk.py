"""Portfolio, risk and ledger queries over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import portfolio as P
from tidewell.operators import risk as K
from tidewell.operators import revisions as R
from tidewell.session import read_table


def _forecasts(spark, d):
    o = read_table(spark, d, "orders")
    action = F.when(F.col("o_orderstatus") == "F", "long").when(F.col("o_orderstatus") == "O", "short").otherwise("flat")
    return o.select(F.col("o_orderkey").alias("signal_id"), (F.col("o_custkey") % 7).cast("int").alias("advisor_id"), F.col("o_orderpriority").alias("instrument_id"), action.alias("action"), (F.col("o_totalprice") / 500000).alias("raw_score"),
                    F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") % 100 / 100).alias("probability"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 300).cast("double")).alias("bps"))


def _calibrated(spark, d):
    records = spark.createDataFrame([(i, i / 10, 50 * i, 120) for i in range(6)], "advisor_id int, reliability double, samples int, least_samples int")
    buckets = spark.createDataFrame([(i, b, b / 4, (b + 1) / 4, 0.3 + 0.1 * b) for i in range(5) for b in range(3)], "advisor_id int, place int, low double, high double, rate double")
    return P.calibrate(_forecasts(spark, d), records, buckets, 0.2)


def calibrated_forecasts(spark, d):
    return _calibrated(spark, d).select("signal_id", "instrument_id", *[F.round(c, 6).alias(c) for c in ("p", "excess", "weight")])


def net_edges(spark, d):
    merged = P.merge_clusters(_calibrated(spark, d).withColumn("cluster", F.col("advisor_id")))
    return merged.groupBy("instrument_id").agg(F.round(F.sum(F.col("weight") * F.col("excess")), 4).alias("edge"), F.count("*").alias("clusters"))


def _part_groups(spark, d):
    l = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % 400).alias("part"))  # noqa: E741
    return l.groupBy("s_suppkey").agg(F.collect_set("part").alias("parts")).join(read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")


def supplier_overlap(spark, d):
    """Suppliers of one nation whose ordered part groups overlap, as evidence sets."""
    return P.similar_pairs(_part_groups(spark, d), "s_nationkey", "s_suppkey", "parts", 0.6).select("s_nationkey", "a", "b", F.round("jaccard", 6).alias("jaccard"))


def supplier_clusters(spark, d):
    """Suppliers with the least supplier that overlaps lead to."""
    members = read_table(spark, d, "supplier").select("s_suppkey")
    return P.cluster(members, P.similar_links(_part_groups(spark, d), "s_nationkey", "s_suppkey", "parts", 0.6), "s_suppkey").select("s_suppkey", "cluster")


def _market(spark, d):
    """Regions are books, nations instruments, the spread of their customers' balances the volatility."""
    c = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.stddev_pop("c_acctbal") / 10000).alias("vol"), (F.avg("c_acctbal") - 4500).alias("edge"))
    return read_table(spark, d, "nation").join(c, "n_nationkey").select(F.col("n_regionkey").alias("book"), F.col("n_name").alias("instrument_id"), "vol", "edge")


def position_sizes(spark, d):
    return P.size_positions(_market(spark, d), 0.5, 0.2, 10, 1_000_000, 10, 30, 15).select("book", "instrument_id", F.round("notional", 4).alias("notional"))


def covariances(spark, d):
    return P.covariance(_market(spark, d).select("book", "instrument_id", "vol"), 0.5, 0.2).select("book", "a", "b", F.round("cov", 8).alias("cov"))


def _targets(spark, d):
    c = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("balance"))
    k, n = F.col("n_nationkey"), read_table(spark, d, "nation")
    created = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return n.join(c, "n_nationkey").select(
        F.col("n_regionkey").cast("string").alias("decision_id"), F.concat("n_name", F.lit("-PERP")).alias("instrument_id"), created.alias("created_at"), (F.col("balance") - 4500 * (k % 3)).alias("target"),
        ((k % 5 - 2) * 1000).cast("double").alias("current"), (50 + k * 7.5).alias("price"), (1 + k / 10).alias("atr"), F.lit(0.5).alias("lot"),
    )


def order_intents(spark, d):
    """Nations as instruments whose customers' balances are the target; regions decide."""
    found = P.order_intents(_targets(spark, d), 50_000, 20, 10, 1.5)
    return found.select("intent_id", "decision_id", "instrument_id", F.unix_timestamp("expires_at").alias("expires"), "side", "effect", F.round("quantity", 4).alias("quantity"), "quantity_unit", F.round("limit_price", 4).alias("limit_price"), F.round("stop_price", 4).alias("stop_price"), "reduce_only")


def crash_covariances(spark, d):
    return P.crash_covariance(_market(spark, d).select("book", "instrument_id", "vol"), 0.9).select("book", "a", "b", F.round("cov", 8).alias("cov"))


def order_effects(spark, d):
    """Rounded targets against the running position of each part."""
    l = read_table(spark, d, "lineitem")  # noqa: E741
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    df = l.withColumn("target", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("current", F.col("target") - signed)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lots = P.to_lots(F.col("target") * 100, F.lit(7.0), F.lit(0.5))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", P.effect(F.col("current"), F.col("target")).alias("effect"), F.round(lots, 4).alias("lots"), F.round(P.recap(lots, F.lit(7.0), F.lit(0.5), 10_000, 10, 20), 4).alias("capped"), (price > 2000).alias("dear"))


def book_fills(spark, d):
    l = read_table(spark, d, "lineitem").where("l_partkey <= 500")  # noqa: E741
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice") / F.col("l_quantity"), "l_orderkey", "l_linenumber"))
    levels = l.select(F.col("l_partkey").alias("book"), place.alias("place"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"))
    orders = levels.select("book").distinct().withColumn("quantity", (F.col("book") % 400 + 50).cast("double"))
    return K.walk_book(levels, orders, 4.5, 20_000).select("book", "filled", *[F.round(c, 3).alias(c) for c in ("vwap", "slippage_bps", "fee")], "partial", "rejected")


LIMITS = {
    "max_leverage": 1, "min_stop_distance_atr": 0.5, "max_stop_distance_atr": 3, "max_orders_per_hour": 11,
    "max_gross_exposure_pct": 85, "max_net_directional_pct": 30, "max_single_position_pct": 20, "max_order_size_pct_equity": 12,
}


def _intents(spark, d):
    """Orders as intents in a book that their customers stand for."""
    o, c = read_table(spark, d, "orders"), F.col("o_custkey")
    effect = F.when(F.col("o_orderstatus") == "P", "reduce").when(c % 3 == 0, "increase").otherwise("open")
    return o.select(
        F.col("o_orderkey").alias("intent_id"), effect.alias("effect"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("o_totalprice") / 317).alias("quantity"), F.when(c % 7 == 0, K.USD).otherwise("lots").alias("quantity_unit"),
        (100 + c % 50).cast("double").alias("mark_price"), F.when(c % 97 != 0, 1_000_000.0).otherwise(0.0).alias("equity"), F.when(c % 89 != 0, 2.0).otherwise(0.0).alias("atr"), F.when(c % 4 != 0, 100.0).alias("limit_price"), F.when(effect == "open", 95.0 + c % 11).alias("stop_price"),
        (F.col("o_orderdate") + F.expr("interval 4 hours")).alias("expires_at"), (F.col("o_orderdate") + F.make_dt_interval(hours=(c % 6).cast("int"))).alias("now"), F.when(c % 17 == 0, "SOFT").otherwise("NORMAL").alias("halt_state"), (c % 13).alias("hour_orders"),
        (c % 90).cast("double").alias("gross_pct"), (c % 61 - 30).cast("double").alias("net_pct"), (c % 15).cast("double").alias("position_pct"),
    )


def risk_verdicts(spark, d):
    """All mechanical, halt, rate and exposure checks of every intent, and what they come to."""
    found = K.evaluate(_intents(spark, d), LIMITS)
    return found.select("intent_id", "verdict", F.round("approved_quantity", 6).alias("approved_quantity"), F.array_join("reason_codes", ",").alias("codes"), F.size("checks").alias("checks"), *[F.round(n, 6).alias(n) for n in ("order_pct", "gross_after", "net_after", "position_after")])


def resized_protection(spark, d):
    """Line items as fills of protective orders of 30 lots."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(30.0).alias("quantity"), F.col("o_orderstatus").alias("status"))
    fills = read_table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min(F.col("l_quantity") - 1).alias("filled"))
    return K.resize_protection(orders, fills)


def stress_losses(spark, d):
    c = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("book")).agg(F.sum(F.abs("c_acctbal")).alias("gross"), F.sum("c_acctbal").alias("net"), F.lit(0.05).alias("daily_vol"), F.lit(50000.0).alias("equity"))
    scenarios = spark.createDataFrame([("gap_down", "net", -0.15), ("funding_spike", "gross", 0.02), ("venue_outage", "vol", 2.0)], "name string, on string, factor double")
    return K.stress(c, scenarios, 100).select("book", "name", F.round("loss", 4).alias("loss"), "within")


def halt_history(spark, d):
    e = read_table(spark, d, "events").groupBy(F.col("event_type").alias("account"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    days = e.select("account", F.unix_date("day").alias("day"), (F.col("v") - 55).alias("daily"), (F.col("v") - 60).alias("weekly"), (F.col("v") - 65).alias("drawdown"))
    lifted = days.where("day % 5 = 0").select("account", "day", F.lit("human_restart").alias("action")).unionByName(days.where("day % 13 = 0").select("account", "day", F.lit("manual_reset").alias("action")))
    return K.halt_states(days, 5, 12, 20, 28, lifted)


def uncovered_positions(spark, d):
    l = read_table(spark, d, "lineitem")  # noqa: E741
    side = F.when(F.col("l_linestatus") == "O", "sell").otherwise("buy")
    positions = l.groupBy(F.col("l_suppkey").alias("account")).agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(-F.col("l_quantity") / 2)).alias("quantity"))
    orders = l.select(F.col("l_suppkey").alias("account"), side.alias("side"), (F.col("l_quantity") / 10).alias("quantity"), F.when(F.col("l_returnflag") == "N", "open").otherwise("done").alias("status"))
    return K.unprotected(positions, orders).select("account", F.round("quantity", 4).alias("quantity"), F.round("covered", 4).alias("covered"))


def position_mismatches(spark, d):
    o = read_table(spark, d, "orders")
    venue = o.groupBy("o_custkey").agg(F.count("*").cast("double").alias("size"))
    ledger = o.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").cast("double").alias("size"))
    return K.mismatches(venue, ledger, "o_custkey", "size")


def bad_transitions(spark, d):
    log = read_table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    allowed = [("view", "click"), ("click", "view"), ("view", "view"), ("click", "purchase"), ("error", "view")]
    return K.invalid_transitions(log, "user_id", "event_id", allowed).select("user_id", "event_id", "before", "state")


def claimed_once(spark, d):
    return K.first_claims(read_table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey")


def reservations(spark, d):
    e = read_table(spark, d, "events")
    return K.reserve(e.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 20, 900.0)


def call_reservations(spark, d):
    """Events as calls in cycles of four hours, under the three limits in order."""
    at = F.col("ts").cast("timestamp")
    e = read_table(spark, d, "events").select(F.col("event_type").alias("account"), F.col("event_id").alias("attempt"), at.alias("at"), F.floor(F.hour(at) / 4).cast("string").alias("cycle"), (F.col("user_id") % 50).alias("tweets"), (F.col("value") / 100).alias("usd"))
    return K.reserve_calls(e, 9, 60, 60.0).select("account", "attempt", "refused_by")


def pending_outcomes(spark, d):
    """Orders past their window without a line item, by anti join."""
    o, l = read_table(spark, d, "orders"), read_table(spark, d, "lineitem").where("l_returnflag = 'R'")  # noqa: E741
    return o.where(F.col("o_orderdate") + F.expr("interval 90 days") <= F.lit("2000-01-01").cast("timestamp")).join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def latest_ties(spark, d):
    return R.latest(read_table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], [F.desc("o_orderdate")], ties=True).select("o_orderkey", "o_orderpriority", "o_orderstatus")


def monthly_spend(spark, d):
    o = read_table(spark, d, "orders")
    cost = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(cost, 2).alias("spent"), F.count("*").alias("calls"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


def spend_rollup(spark, d):
    return read_table(spark, d, "orders").rollup("o_orderpriority").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("spent"))


def last_orders(spark, d):
    return read_table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def order_page(spark, d):
    return read_table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


def tagged_history(spark, d):
    a = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("tag"))
    b = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("fill").alias("tag"))
    return a.unionByName(b).groupBy("tag", (F.col("id") % 10).alias("part")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def hourly_live(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("asset"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


QUERIES = {f.__name__: f for f in (
    calibrated_forecasts, net_edges, supplier_overlap, supplier_clusters, position_sizes, covariances, crash_covariances, order_intents, order_effects, book_fills, risk_verdicts, resized_protection, stress_losses, halt_history, uncovered_positions,
    position_mismatches, bad_transitions, claimed_once, reservations, call_reservations, pending_outcomes, latest_ties, monthly_spend, spend_rollup, last_orders, order_page, tagged_history, hourly_live,
)}

_C = """f AS (SELECT o_orderkey AS signal_id, (o_custkey % 7)::INT AS advisor_id, o_orderpriority AS instrument_id, CASE o_orderstatus WHEN 'F' THEN 'long' WHEN 'O' THEN 'short' ELSE 'flat' END AS action, o_totalprice / 500000 AS raw,
CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey % 100)::DOUBLE / 100 END AS pr, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 300)::DOUBLE END AS bps FROM orders),
r AS (SELECT *, CASE WHEN advisor_id < 5 THEN CASE WHEN raw >= 0 AND raw < 0.25 THEN 0.3::DOUBLE WHEN raw >= 0.25 AND raw < 0.5 THEN 0.4::DOUBLE WHEN raw >= 0.5 AND raw < 0.75 THEN 0.5::DOUBLE END END AS rate FROM f),
c AS (SELECT signal_id, advisor_id, instrument_id, CASE WHEN pr IS NOT NULL AND bps IS NOT NULL THEN pr WHEN action = 'flat' OR rate IS NULL THEN 0.5 ELSE rate END AS p,
CASE WHEN action = 'flat' THEN 0.0 WHEN pr IS NOT NULL AND bps IS NOT NULL THEN bps WHEN rate IS NULL THEN 0.0 ELSE abs((rate - 0.5) * 2 * coalesce(abs(bps), 100)) * CASE action WHEN 'long' THEN 1 ELSE -1 END END AS excess,
CASE WHEN advisor_id < 6 AND 50 * advisor_id >= 120 THEN advisor_id / 10.0::DOUBLE * 0.8 ELSE 0.0 END AS weight FROM r)"""
_MK = "c AS (SELECT c_nationkey AS k, stddev_pop(c_acctbal) / 10000 AS vol, avg(c_acctbal) - 4500 AS edge FROM customer GROUP BY 1), m AS (SELECT n_regionkey AS book, n_name AS instrument_id, vol, edge FROM nation JOIN c ON n_nationkey = k)"

_OVERLAP = """WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 400 AS p FROM lineitem), n AS (SELECT s, s_nationkey, p, count(*) OVER (PARTITION BY s) AS n FROM s JOIN supplier ON s_suppkey = s)
SELECT a.s_nationkey, a.s AS a, b.s AS b, round(count(*)::DOUBLE / (a.n + b.n - count(*)), 6) AS jaccard FROM n a JOIN n b ON a.s_nationkey = b.s_nationkey AND a.p = b.p AND a.s < b.s GROUP BY 1, 2, 3, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) > 0.6"""

ORACLES = {
    "calibrated_forecasts": f"WITH {_C} SELECT signal_id, instrument_id, round(p, 6) AS p, round(excess, 6) AS excess, round(weight, 6) AS weight FROM c",
    "net_edges": f"""WITH {_C}, k AS (SELECT instrument_id, advisor_id, CASE WHEN sum(weight) > 0 THEN sum(excess * weight) / sum(weight) ELSE avg(excess) END AS excess, CASE WHEN sum(weight) > 0 THEN avg(weight) ELSE 0 END AS weight FROM c GROUP BY 1, 2)
SELECT instrument_id, round(sum(weight * excess), 4) AS edge, count(*) AS clusters FROM k GROUP BY 1""",
    "supplier_overlap": _OVERLAP,
    "supplier_clusters": f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_OVERLAP})), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT s_suppkey AS s, s_suppkey AS t FROM supplier UNION SELECT r.s, u.b FROM r JOIN u ON r.t = u.a)
SELECT s AS s_suppkey, min(t) AS cluster FROM r GROUP BY 1""",
    "position_sizes": f"""WITH {_MK}, w AS (SELECT *, 1 / vol / sum(1 / vol) OVER (PARTITION BY book) * sign(edge) AS w FROM m), cov AS (SELECT a.book, sum(a.w * b.w * CASE WHEN a.instrument_id = b.instrument_id THEN a.vol * b.vol ELSE 0.4::DOUBLE * a.vol * b.vol END) AS v FROM w a JOIN w b ON a.book = b.book GROUP BY 1),
n AS (SELECT w.book, instrument_id, greatest(least(CASE WHEN v > 0 THEN w * 0.1 / sqrt(v) * 1e6 ELSE 0 END, 1e5), -1e5) AS n FROM w JOIN cov USING (book)),
g AS (SELECT *, n * CASE WHEN sum(abs(n)) OVER (PARTITION BY book) > 3e5 THEN 3e5 / sum(abs(n)) OVER (PARTITION BY book) ELSE 1 END AS o FROM n)
SELECT book, instrument_id, round(o * CASE WHEN abs(sum(o) OVER (PARTITION BY book)) > 1.5e5 THEN 1.5e5 / abs(sum(o) OVER (PARTITION BY book)) ELSE 1 END, 4) AS notional FROM g""",
    "covariances": f"WITH {_MK} SELECT x.book, x.instrument_id AS a, y.instrument_id AS b, round(x.vol * y.vol * CASE WHEN x.instrument_id = y.instrument_id THEN 1 ELSE 0.4::DOUBLE END, 8) AS cov FROM m x JOIN m y ON x.book = y.book",
    "order_effects": """WITH s AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q FROM lineitem),
t AS (SELECT *, sum(q) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS t FROM s), u AS (SELECT *, t - q AS c, sign(t) * floor(abs(t * 100) / 7.0::DOUBLE / 0.5::DOUBLE) * 0.5 AS lots FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN t = 0 AND c <> 0 THEN 'close' WHEN c = 0 OR sign(c) <> sign(t) THEN 'open' WHEN abs(t) > abs(c) THEN 'increase' WHEN abs(t) < abs(c) THEN 'reduce' ELSE 'open' END AS effect, round(lots, 4) AS lots,
round(CASE WHEN abs(lots) * 7 <= 1000 THEN lots ELSE sign(lots) * floor(1000 / 7.0::DOUBLE / 0.5::DOUBLE) * 0.5 END, 4) AS capped, l_extendedprice / l_quantity > 2000 AS dear FROM u""",
    "book_fills": """WITH l AS (SELECT l_partkey AS book, l_extendedprice / l_quantity AS price, l_quantity AS size, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice / l_quantity, l_orderkey, l_linenumber) AS place FROM lineitem WHERE l_partkey <= 500),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY book ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, book % 400 + 50 AS q FROM l), t AS (SELECT *, greatest(0, least(size, q - before)) AS take FROM b),
g AS (SELECT book, q, sum(take) AS filled, sum(take * price) AS cost, min_by(price, place) AS top FROM t GROUP BY 1, 2)
SELECT book, filled, round(cost / filled, 3) AS vwap, round(abs(cost / filled - top) / top * 10000, 3) AS slippage_bps, round(cost * 4.5 / 10000, 3) AS fee, filled < q AS partial, abs(cost / filled - top) / top * 10000 > 20000 AS rejected FROM g""",
    "risk_verdicts": f"""WITH i AS (SELECT o_orderkey AS intent_id, CASE WHEN o_orderstatus = 'P' THEN 'reduce' WHEN o_custkey % 3 = 0 THEN 'increase' ELSE 'open' END AS effect, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sign, o_totalprice / 317 AS q,
o_custkey % 7 = 0 AS usd, (100 + o_custkey % 50)::DOUBLE AS mark, CASE WHEN o_custkey % 97 <> 0 THEN 1e6 ELSE 0 END::DOUBLE AS equity, CASE WHEN o_custkey % 89 <> 0 THEN 2 ELSE 0 END::DOUBLE AS atr, CASE WHEN o_custkey % 4 <> 0 THEN 100.0::DOUBLE END AS lim, 95.0::DOUBLE + o_custkey % 11 AS stop0,
o_custkey % 6 AS h, o_custkey % 17 = 0 AS halted, o_custkey % 13 AS n, o_custkey % 90 AS g0, o_custkey % 61 - 30 AS n0, o_custkey % 15 AS p0 FROM orders),
x AS (SELECT *, CASE WHEN effect = 'open' THEN stop0 END AS stop, CASE WHEN equity = 0 THEN 0 ELSE CASE WHEN usd THEN q ELSE q * mark END / equity * 100 END::DOUBLE AS pct FROM i),
y AS (SELECT *, g0 + pct AS g1, n0 + sign * pct AS n1, p0 + pct AS p1, CASE WHEN atr = 0 THEN 0 ELSE abs(coalesce(lim, mark) - stop) / atr END AS dist, CASE WHEN equity > 0 THEN CASE WHEN usd THEN 100 ELSE mark * 100 END / equity END AS unit,
least(85 - g0, 20 - p0, 12, 30 - sign * n0) AS room FROM x),
f AS (SELECT *, list_filter([CASE WHEN h >= 4 THEN 'expiry_not_passed' END, CASE WHEN stop IS NOT NULL AND NOT dist BETWEEN 0.5 AND 3 THEN 'stop_distance_atr' END], lambda c: c IS NOT NULL) AS mech,
list_filter([CASE WHEN halted THEN 'halt_gate' END, CASE WHEN n >= 11 THEN 'max_orders_per_hour' END], lambda c: c IS NOT NULL) AS gates,
list_filter([CASE WHEN g1 > 85 THEN 'max_gross_exposure_pct' END, CASE WHEN abs(n1) > 30 THEN 'max_net_directional_pct' END, CASE WHEN p1 > 20 THEN 'max_single_position_pct' END, CASE WHEN pct > 12 THEN 'max_order_size_pct_equity' END], lambda c: c IS NOT NULL) AS caps,
least(CASE WHEN unit > 0 AND room > 0 THEN room / unit ELSE 0 END, q) AS most FROM y),
v AS (SELECT *, CASE WHEN effect = 'reduce' THEN CASE WHEN len(mech) = 0 THEN 'approve' ELSE 'reject' END WHEN len(mech) + len(gates) + len(caps) = 0 THEN 'approve' WHEN len(mech) + len(gates) > 0 OR most <= 0 THEN 'reject' ELSE 'approve_reduced' END AS verdict FROM f)
SELECT intent_id, verdict, round(CASE verdict WHEN 'approve' THEN q WHEN 'approve_reduced' THEN most ELSE 0 END, 6) AS approved_quantity, CASE WHEN effect = 'reduce' THEN array_to_string(list_concat(['reduce_close_bypasses_exposure_caps'], mech), ',')
ELSE array_to_string(list_concat(mech, gates, caps, CASE WHEN verdict = 'approve_reduced' THEN ['quantity_shrunk_to_pass_caps'] ELSE [] END), ',') END AS codes,
(CASE WHEN stop IS NULL THEN 2 ELSE 3 END + CASE WHEN effect = 'reduce' THEN 0 ELSE 6 END)::INT AS checks, round(pct, 6) AS order_pct, round(g1, 6) AS gross_after, round(n1, 6) AS net_after, round(p1, 6) AS position_after FROM v""",
    "resized_protection": """WITH f AS (SELECT l_orderkey AS order_id, min(l_quantity - 1) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT o_orderkey AS order_id, CASE WHEN q > 0 AND q <= 30 THEN q ELSE 30 END AS quantity, o_orderstatus AS status, q > 0 AND q <= 30 AS resized FROM orders JOIN f ON o_orderkey = order_id""",
    "crash_covariances": f"WITH {_MK} SELECT x.book, x.instrument_id AS a, y.instrument_id AS b, round(x.vol * y.vol * CASE WHEN x.instrument_id = y.instrument_id THEN 1 ELSE 0.9::DOUBLE END, 8) AS cov FROM m x JOIN m y ON x.book = y.book",
    "order_intents": f"""WITH c AS (SELECT c_nationkey AS k, sum(c_acctbal) AS b FROM customer GROUP BY 1), t AS (SELECT n_regionkey::VARCHAR AS d, n_name || '-PERP' AS i, n_name AS unit, b - 4500 * (k % 3) AS target, (k % 5 - 2) * 1000.0::DOUBLE AS cur, 50 + k * 7.5::DOUBLE AS price, 1 + k / 10.0::DOUBLE AS atr FROM nation JOIN c ON k = n_nationkey),
r AS (SELECT *, sign(target) * floor(abs(target) / price / 0.5::DOUBLE) * 0.5::DOUBLE AS q FROM t), w AS (SELECT *, CASE WHEN abs(q) * price <= 5000 THEN q ELSE sign(q) * floor(5000 / price / 0.5::DOUBLE) * 0.5::DOUBLE END * price AS wanted FROM r),
x AS (SELECT *, wanted - cur AS delta, floor(abs(wanted - cur) / price / 0.5::DOUBLE) * 0.5::DOUBLE AS quantity FROM w), e AS (SELECT *, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side,
CASE WHEN wanted = 0 AND cur <> 0 THEN 'close' WHEN cur = 0 OR sign(cur) <> sign(wanted) THEN 'open' WHEN abs(wanted) > abs(cur) THEN 'increase' WHEN abs(wanted) < abs(cur) THEN 'reduce' ELSE 'open' END AS effect FROM x WHERE delta <> 0 AND quantity <> 0),
n AS (SELECT *, sha1(unhex('{P.INTENTS.replace("-", "")}') || encode(d || ':' || i || ':' || side)) AS x FROM e),
s AS (SELECT *, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', x[17]), 1) || x[18:20] || '-' || x[21:32] AS intent_id FROM n)
SELECT intent_id, d AS decision_id, i AS instrument_id, epoch(TIMESTAMP '2026-01-01 04:00:00')::BIGINT AS expires, side, effect, round(quantity, 4) AS quantity, unit AS quantity_unit, round(price, 4) AS limit_price,
round(CASE WHEN effect = 'open' THEN price + 1.5::DOUBLE * atr * CASE side WHEN 'buy' THEN -1 ELSE 1 END END, 4) AS stop_price, effect IN ('reduce', 'close') AS reduce_only FROM s""",
    "stress_losses": """WITH c AS (SELECT c_nationkey AS book, sum(abs(c_acctbal)) AS g, sum(c_acctbal) AS n FROM customer GROUP BY 1), s AS (SELECT book, 'gap_down' AS name, abs(n * 0.15) AS loss FROM c UNION ALL SELECT book, 'funding_spike', g * 0.02 FROM c UNION ALL SELECT book, 'venue_outage', g * 0.05 * 2 FROM c)
SELECT book, name, round(loss, 4) AS loss, loss <= 50000 AS within FROM s""",
    "halt_history": """WITH RECURSIVE e AS (SELECT event_type AS account, CAST(epoch(date_trunc('day', ts)) / 86400 AS INT) AS day, avg(value) AS v FROM events GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN v - 65 <= -28 THEN 3 WHEN v - 55 <= -12 OR v - 60 <= -20 THEN 2 WHEN v - 55 <= -5 THEN 1 ELSE 0 END AS level, row_number() OVER (PARTITION BY account ORDER BY day) AS i FROM e),
h AS (SELECT account, day, i, level AS state FROM l WHERE i = 1 UNION ALL
SELECT l.account, l.day, l.i, greatest(level, CASE WHEN l.day % 13 = 0 OR state < 2 OR (l.day % 5 = 0 AND state = 2) THEN 0 ELSE state END) FROM h JOIN l ON l.account = h.account AND l.i = h.i + 1)
SELECT account, day, ['NORMAL', 'SOFT', 'HARD', 'KILL'][state + 1] AS state FROM h""",
    "call_reservations": """WITH RECURSIVE e AS (SELECT event_type AS account, event_id AS attempt, date_trunc('day', ts) AS day, date_trunc('month', ts) AS month, hour(ts) // 4 AS cycle, user_id % 50 AS tweets, value / 100 AS usd, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT account, attempt, i, day, month, cycle, tweets, usd, 0::BIGINT AS requests, 0::BIGINT AS used, 0.0::DOUBLE AS spent, NULL::VARCHAR AS why FROM e WHERE false UNION ALL SELECT account, 0, 0, NULL, NULL, 0, 0, 0, 0, 0, 0, NULL FROM (SELECT DISTINCT account FROM e)),
r AS (SELECT account, attempt, i, day, month, cycle, requests, used, spent, why FROM s UNION ALL
SELECT account, attempt, i, day, month, cycle, q + (why IS NULL)::INT, u + CASE WHEN why IS NULL THEN tweets ELSE 0 END, m + CASE WHEN why IS NULL THEN usd ELSE 0 END, why FROM
(SELECT *, CASE WHEN q + 1 > 9 THEN 'max_requests_per_day' WHEN u + tweets > 60 THEN 'max_tweets_per_cycle' WHEN m + usd > 60 THEN 'max_monthly_usd' END AS why FROM
(SELECT e.*, CASE WHEN r.day = e.day THEN requests ELSE 0 END AS q, CASE WHEN r.day = e.day AND r.cycle = e.cycle THEN used ELSE 0 END AS u, CASE WHEN r.month = e.month THEN spent ELSE 0 END AS m FROM r JOIN e ON e.account = r.account AND e.i = r.i + 1)))
SELECT account, attempt, why AS refused_by FROM r WHERE i > 0""",
    "uncovered_positions": """WITH p AS (SELECT l_suppkey AS a, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity / 2 END) AS q FROM lineitem GROUP BY 1), o AS (SELECT l_suppkey AS a, CASE WHEN l_linestatus = 'O' THEN 'sell' ELSE 'buy' END AS s, sum(l_quantity / 10) AS c FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT p.a AS account, round(q, 4) AS quantity, round(coalesce(c, 0), 4) AS covered FROM p LEFT JOIN o ON p.a = o.a AND s = CASE WHEN q > 0 THEN 'sell' ELSE 'buy' END WHERE q <> 0 AND coalesce(c, 0) < abs(q)""",
    "position_mismatches": """SELECT o_custkey, count(*)::DOUBLE AS venue, count_if(o_orderstatus <> 'P')::DOUBLE AS ledger FROM orders GROUP BY 1 HAVING count(*) <> count_if(o_orderstatus <> 'P')""",
    "bad_transitions": """WITH s AS (SELECT user_id, event_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, before, state FROM s WHERE before IS NOT NULL AND (before, state) NOT IN (('view', 'click'), ('click', 'view'), ('view', 'view'), ('click', 'purchase'), ('error', 'view'))""",
    "claimed_once": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1",
    "reservations": """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, value, i, value <= 900 AS granted, (value <= 900)::INT AS n, CASE WHEN value <= 900 THEN value ELSE 0 END AS used FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.value, e.i, n < 20 AND used + e.value <= 900, n + (n < 20 AND used + e.value <= 900)::INT, used + CASE WHEN n < 20 AND used + e.value <= 900 THEN e.value ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, value, granted FROM r""",
    "pending_outcomes": "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '2000-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "latest_ties": "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders QUALIFY rank() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC) = 1",
    "monthly_spend": "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE, 2) AS spent, count(*) AS calls, count_if(o_orderstatus = 'F') AS done FROM orders GROUP BY 1",
    "spend_rollup": "SELECT o_orderpriority, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE, 2) AS spent FROM orders GROUP BY ROLLUP (o_orderpriority)",
    "last_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
    "order_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "tagged_history": "WITH u AS (SELECT o_orderkey AS id, 'order' AS tag FROM orders UNION ALL SELECT l_orderkey, 'fill' FROM lineitem) SELECT tag, id % 10 AS part, count(*) AS n, count(DISTINCT id) AS ids FROM u GROUP BY 1, 2",
    "hourly_live": "SELECT event_type AS asset, hour(ts)::INT AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
}
