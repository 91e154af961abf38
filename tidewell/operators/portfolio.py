"""From forecasts to positions: calibration, clustering, covariance, sizing, caps, rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import base_symbol, uuid5
from tidewell.graph import components
from tidewell.scratch import save


#: The namespace of order ids, and what the momentum baseline's scores have meant (low, high, rate of gains).
INTENTS = "6f1e2a2e-6b8b-4a2a-9d2e-3a2b6c1d9e10"
BASELINE = "ts_momentum_baseline"
BASELINE_BUCKETS = ((-10.0, -0.75, 0.44), (-0.75, -0.25, 0.47), (-0.25, 0.25, 0.50), (0.25, 0.75, 0.53), (0.75, 10.0, 0.56))


def calibrate(forecasts: DataFrame, records: DataFrame, buckets: DataFrame, shrinkage: float = 0.0) -> DataFrame:
    """Probability p, expected excess bps and weight of each forecast.

    ``forecasts`` (signal_id, advisor_id, instrument_id, action, raw_score, probability, bps),
    ``records`` (advisor_id, reliability, samples, least_samples), ``buckets`` (advisor_id, place, low, high, rate).
    """
    ranged = forecasts.select("signal_id", "advisor_id", "raw_score").join(buckets, "advisor_id").where((F.col("low") <= F.col("raw_score")) & (F.col("raw_score") < F.col("high")))
    first = ranged.groupBy("signal_id").agg(F.min_by("rate", "place").alias("rate"))
    df = forecasts.join(records, "advisor_id", "left").join(first, "signal_id", "left")
    stated = F.col("probability").isNotNull() & F.col("bps").isNotNull()
    flat = F.col("action") == "flat"
    size = F.abs((F.col("rate") - 0.5) * 2 * F.coalesce(F.abs("bps"), F.lit(100.0)))
    signed = F.when(F.col("action") == "long", size).when(F.col("action") == "short", -size).otherwise(0.0)
    p = F.when(stated, F.col("probability")).when(flat | F.col("rate").isNull(), 0.5).otherwise(F.col("rate"))
    excess = F.when(flat, 0.0).when(stated, F.col("bps")).when(F.col("rate").isNull(), 0.0).otherwise(signed)
    weight = F.when(F.coalesce(F.col("samples") >= F.col("least_samples"), F.lit(False)), F.col("reliability") * (1 - shrinkage)).otherwise(0.0)
    return df.select("signal_id", "advisor_id", "instrument_id", p.alias("p"), excess.alias("excess"), weight.alias("weight"))


def similar_pairs(members: DataFrame, key: str, node: str, evidence: str, over: float = 0.5) -> DataFrame:
    """(key, a, b, jaccard) of members of a key that share evidence beyond a Jaccard index.

    A prefix filter finds the pairs: with the items of a set ordered by how rare they are, two sets
    beyond the index share one of the first n - ceil(over * n) + 1 of either, so only those meet by
    an equi-join and common items hardly ever do. The whole sets of such pairs are then compared.
    In a key whose items are so common that these would meet more often than there are pairs, all
    pairs are compared, as products of blocks of sets; keys of fewer than 16 members aren't worth a group.
    ``members`` has one row for each member of a key; an empty or NULL set is like none.
    """
    return _similar(members, key, node, evidence, over, False)


def similar_links(members: DataFrame, key: str, node: str, evidence: str, over: float = 0.5) -> DataFrame:
    """(a, b): links that connect just what ``similar_pairs`` connect, but few of them where most pairs are similar."""
    return _similar(members, key, node, evidence, over, True).select("a", "b")


def _similar(members: DataFrame, key: str, node: str, evidence: str, over: float, linked: bool) -> DataFrame:
    items = F.array_distinct(F.array_compact(evidence))
    sets = members.select(F.col(key).alias("key"), F.col(node).alias("node"), items.alias("items"), F.size(items).alias("n"))
    sets = save(sets.where("n > 0 and key is not null and node is not null"), "evidence")
    head = (F.col("n") - F.ceil(F.col("n") * over - 1e-9) + 1).cast("int")
    size = sets.groupBy("key").agg(F.count("*").alias("members"), F.sum(head.cast("double")).alias("heads"))
    single = sets.select("key", "node", F.explode("items").alias("item"))
    counts = save(single.groupBy("key", "item").agg(F.count("*").alias("rows")), "items")
    often = lambda meet: (F.col("members") >= 16) & (meet >= F.col("members") * F.col("members"))
    # heads spread evenly over all items would meet heads^2 / items times, and no less often however they are spread
    sizes = save(size.join(counts.groupBy("key").agg(F.count("*").alias("items")), "key").withColumn("dense", often(F.col("heads") * F.col("heads") / F.col("items"))), "sizes")
    met = single.join(sizes.where("not dense").select("key"), "key", "left_semi").join(counts, ["key", "item"])
    ordered = met.groupBy("key", "node").agg(F.array_sort(F.collect_list(F.struct("rows", "item"))).alias("items"), F.count("*").alias("n"))
    heads = save(ordered.select("key", "node", "n", F.explode(F.slice("items", F.lit(1), head)).alias("x")).select("key", "node", "n", F.col("x.item").alias("item")), "heads")
    meet = heads.groupBy("key", "item").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum(F.col("c") * F.col("c")).alias("meet"))
    known = save(sizes.join(meet, "key", "left").select("key", "members", (F.col("dense") | often(F.col("meet"))).alias("dense")), "sizes")
    heads = heads.join(known.where("dense").select("key"), "key", "left_anti")
    left, right = heads.toDF("key", "a", "na", "item"), heads.toDF("key", "b", "nb", "item")
    near = left.join(right, ["key", "item"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * over)).select("key", "a", "b").distinct()
    whole = near.join(sets.toDF("key", "a", "xa", "na"), ["key", "a"]).join(sets.toDF("key", "b", "xb", "nb"), ["key", "b"])
    both = F.size(F.array_intersect("xa", "xb"))
    sparse = whole.withColumn("jaccard", both / (F.col("na") + F.col("nb") - both)).where(F.col("jaccard") > over).select("key", "a", "b", "jaccard")
    return sparse.unionByName(_all_pairs(sets, known.where("dense").select("key", "members"), over, linked)).withColumnRenamed("key", key)


def _all_pairs(sets: DataFrame, keys: DataFrame, over: float, linked: bool, block: int = 1000, columns: int = 4096) -> DataFrame:
    """(key, a, b, jaccard) of the similar pairs of these (key, members), or links that connect the same members.

    Members are dealt to blocks of about ``block`` sets; every two blocks of a key are compared in one group.
    """
    kind = {c: sets.schema[c].dataType.simpleString() for c in ("key", "node")}
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = sets.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "items", F.col("n").cast("double").alias("n"))

    def run(group: pa.Table) -> pa.Table:
        nodes, items = group.column("node").combine_chunks(), group.column("items").combine_chunks()
        own, n = group.column("own").to_numpy(), group.column("n").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        rank = pc.rank(nodes, tiebreaker="dense").to_numpy().astype(np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        both = _shared(items, left, right, columns)
        jaccard = both / (n[left, None] + n[right] - both)
        similar = (jaccard > over) & ((rank[left, None] < rank[right]) if i == j else (rank[left, None] != rank[right]))
        if linked:
            a, b = _connect(similar, left, right, len(nodes))
            value = np.ones(len(a))
        else:
            x, y = np.nonzero(similar)
            a, b, value = left[x], right[y], jaccard[x, y]
        a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
        found = [pa.repeat(group.column("key")[0], len(a)), nodes.take(pa.array(a)), nodes.take(pa.array(b)), pa.array(value)]
        whole = pa.RecordBatch.from_arrays(found, ["key", "a", "b", "jaccard"])
        return pa.Table.from_batches([whole.slice(at, 50_000) for at in range(0, max(len(a), 1), 50_000)])

    parts = 4 * sets.sparkSession.sparkContext.defaultParallelism  # results are far larger than the sets, by which Spark would join partitions
    return dealt.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(run, f"key {kind['key']}, a {kind['node']}, b {kind['node']}, jaccard double")


def _shared(items: pa.ListArray, left: np.ndarray, right: np.ndarray, columns: int) -> np.ndarray:
    """How many items each set of ``left`` shares with each of ``right``, from products over ``columns`` items at a time."""
    code = items.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(items)), items.value_lengths().to_numpy())
    both = np.zeros((len(left), len(right)))
    place = np.zeros((2, len(items)), np.int64)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    held = [np.isin(owner, side) for side in (left, right)]
    common = np.intersect1d(code[held[0]], code[held[1]])
    for low in range(0, len(common), columns):
        part = common[low : low + columns]
        at = np.searchsorted(part, code).clip(max=len(part) - 1)
        hit = part[at] == code
        sides = []
        for side, rows in enumerate((left, right)):
            matrix, on = np.zeros((len(rows), len(part)), np.float32), hit & held[side]
            matrix[place[side, owner[on]], at[on]] = 1
            sides.append(matrix)
        both += sides[0] @ sides[1].T
    return both


def _connect(similar: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from one row of each component of a block pair's similar rows to its others."""
    near = np.zeros((rows, rows), bool)
    near[np.ix_(left, right)] = similar
    near |= near.T
    new, a, b = near.any(axis=1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while new.any():
        first = int(np.argmax(new))
        new[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & new)
            new[front] = False
            a.append(np.full(len(front), first))
            b.append(front)
    return np.concatenate(a), np.concatenate(b)


def cluster(members: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``members`` with the smallest node that each one's links reach, over any number of links, as ``cluster``."""
    nodes = members.select(F.col(node).alias("node")).where("node is not null").distinct()
    return members.join(components(nodes.withColumn("label", F.col("node")), edges.select("a", "b")).toDF(node, "cluster"), node)


def merge_clusters(clustered: DataFrame) -> DataFrame:
    """One forecast for each cluster: weighted means (plain ones where all weights are 0).

    It stands in the name of the least (advisor_id, signal_id); where forecasts carry evidence, with all of it.
    """
    w = F.sum("weight")
    mean = lambda c: F.when(w > 0, F.try_divide(F.sum(F.col(c) * F.col("weight")), w)).otherwise(F.avg(c))
    first = F.min(F.struct("advisor_id", F.col("signal_id").cast("string").alias("signal_id"), F.col("signal_id").alias("id")))
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")] if "evidence" in clustered.columns else []
    found = clustered.groupBy("instrument_id", "cluster").agg(mean("p").alias("p"), mean("excess").alias("excess"), F.when(w > 0, F.avg("weight")).otherwise(0.0).alias("weight"), first.alias("first"), *more)
    return found.select("instrument_id", "cluster", "first.advisor_id", F.col("first.id").alias("signal_id"), "p", "excess", "weight", *(["evidence"] if more else []))


def covariance(vols: DataFrame, correlation: float, shrink: float = 0.0) -> DataFrame:
    """(a, b, cov) of all instrument pairs of a book: variances, and (1 - shrink) * rho * va * vb apart from them.

    The result is the whole matrix by definition; ``vols`` (book, instrument_id, vol) are the few instruments of a book.
    """
    a, b = vols.toDF("book", "a", "va"), vols.toDF("book", "b", "vb")
    return a.join(b, "book").select("book", "a", "b", F.when(F.col("a") == F.col("b"), F.col("va") * F.col("vb")).otherwise((1 - shrink) * correlation * F.col("va") * F.col("vb")).alias("cov"))


def crash_covariance(vols: DataFrame, correlation: float) -> DataFrame:
    """The covariance with every correlation forced to one value, for exposure and stress checks; sizing uses ``covariance``."""
    return covariance(vols, correlation, 0.0)


def size_positions(market: DataFrame, correlation: float, shrink: float, target_pct: float, equity: float, single_pct: float, gross_pct: float, net_pct: float) -> DataFrame:
    """(book, instrument_id, notional) from (book, instrument_id, vol, edge).

    Inverse-volatility weights signed by the edge, scaled to the target volatility, then three caps in
    turn. w'Cw of the constant-correlation matrix needs two sums a book, not the matrix.
    """
    book = Window.partitionBy("book")
    inverse = F.when(F.col("vol") > 0, 1 / F.col("vol")).otherwise(0.0)
    df = market.withColumn("inv", inverse).withColumn("w", F.try_divide("inv", F.sum("inv").over(book)) * F.signum(F.coalesce("edge", F.lit(0.0))))
    x = F.col("w") * F.col("vol")
    rho = (1 - shrink) * correlation
    df = df.withColumn("var", (1 - rho) * F.sum(x * x).over(book) + rho * F.pow(F.sum(x).over(book), 2))
    df = df.withColumn("notional", F.when(F.col("var") > 0, F.col("w") * (target_pct / 100) / F.sqrt("var") * equity).otherwise(0.0))
    cap = equity * single_pct / 100
    df = df.withColumn("notional", F.greatest(F.least("notional", F.lit(cap)), F.lit(-cap)))
    for total, limit in ((F.sum(F.abs("notional")).over(book), equity * gross_pct / 100), (F.abs(F.sum("notional").over(book)), equity * net_pct / 100)):
        df = df.withColumn("total", total).withColumn("notional", F.when(F.col("total") > limit, F.col("notional") * limit / F.col("total")).otherwise(F.col("notional")))
    return df.select("book", "instrument_id", "notional")


def keep_if_costly(target: Column, current: Column, cost_bps: Column, multiple: float) -> Column:
    """The current position where the change is smaller than its cost times the multiple."""
    change = F.abs(target - current)
    return F.when(change < change * cost_bps / 10_000 * multiple, current).otherwise(target)


def to_lots(notional: Column, price: Column, lot: Column) -> Column:
    """Quantity in whole lots, towards zero; 0 without a price or lot."""
    lots = F.floor(F.try_divide(F.try_divide(F.abs(notional), price), lot))
    return F.coalesce(F.signum(notional) * lots * lot, F.lit(0))


def recap(quantity: Column, price: Column, lot: Column, equity: float, single_pct: float, order_pct: float) -> Column:
    limit = equity * min(single_pct, order_pct) / 100
    return F.when(F.abs(quantity) * price <= limit, quantity).otherwise(F.signum(quantity) * F.floor(limit / price / lot) * lot)


def effect(current: Column, target: Column) -> Column:
    return (
        F.when((target == 0) & (current != 0), "close").when((current == 0) | (F.signum(current) != F.signum(target)), "open")
        .when(F.abs(target) > F.abs(current), "increase").when(F.abs(target) < F.abs(current), "reduce").otherwise("open")
    )


def order_intents(targets: DataFrame, equity: float, single_pct: float, order_pct: float, atr_multiple: float = 1.0, hours: int = 4) -> DataFrame:
    """Orders that move each book from its current to its target notional.

    ``targets`` is (decision_id, instrument_id, created_at, target, current, price, atr, lot). The
    target is rounded to lots and capped, the difference to the current notional traded in whole lots;
    where that is nothing there is no order. Opening orders get a stop ``atr_multiple`` ranges away.
    """
    wanted = recap(to_lots(F.col("target"), F.col("price"), F.col("lot")), F.col("price"), F.col("lot"), equity, single_pct, order_pct)
    moved = targets.withColumn("wanted", wanted * F.col("price")).withColumn("change", F.col("wanted") - F.col("current"))
    moved = moved.withColumn("quantity", F.abs(to_lots(F.col("change"), F.col("price"), F.col("lot")))).where("change <> 0 and quantity <> 0")
    side = F.when(F.col("change") > 0, "buy").otherwise("sell")
    away = F.col("atr") * atr_multiple * F.when(side == "buy", -1).otherwise(1)
    done = effect(F.col("current"), F.col("wanted"))
    unit = base_symbol(F.col("instrument_id"))
    name = F.concat_ws(":", F.col("decision_id").cast("string"), "instrument_id", side)
    return moved.select(
        uuid5(INTENTS, name).alias("intent_id"), "decision_id", "instrument_id", "created_at", (F.col("created_at") + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"), side.alias("side"), done.alias("effect"), "quantity",
        unit.alias("quantity_unit"), F.col("price").alias("limit_price"), F.when(done == "open", F.col("price") + away).alias("stop_price"), done.isin("reduce", "close").alias("reduce_only"),
    )


def track_records(advisors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, buckets) for ``calibrate``: the baseline at full weight, provisional advisors that are enabled at their own reliability.

    ``advisors`` is (advisor_id, status, enabled, provisional_reliability).
    """
    own = advisors.where("status = 'provisional' and enabled").select("advisor_id", F.coalesce("provisional_reliability", F.lit(0.0)).alias("reliability"), F.lit(1).alias("samples"), F.lit(1).alias("least_samples"))
    base = advisors.sparkSession.createDataFrame([(BASELINE, 1.0, 200, 200)], "advisor_id string, reliability double, samples int, least_samples int")
    records = base.unionByName(own.where(F.col("advisor_id") != BASELINE))
    table = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(r).alias("rate")) for i, (a, b, r) in enumerate(BASELINE_BUCKETS)])
    return records, records.select("advisor_id", F.inline(table))


def run_cycle(forecasts: DataFrame, records: DataFrame, buckets: DataFrame, market: DataFrame, *, equity: float, target_pct: float, caps: tuple[float, float, float, float], multiple: float, shrinkage: float = 0.0, correlation: float = 0.5, shrink: float = 0.2, atr_multiple: float = 1.0) -> DataFrame:
    """Orders of a decision, from its forecasts to ``order_intents``.

    ``forecasts`` as in ``calibrate`` with evidence arrays; ``market`` (book, decision_id, created_at,
    instrument_id, vol, price, atr, lot, current, cost_bps); ``caps`` single, gross, net and order per cent of equity.
    Forecasts of an instrument that share most of their evidence count as one.
    """
    single, gross, net, order = caps
    calibrated = save(calibrate(forecasts, records, buckets, shrinkage), "calibrated")
    evidence = forecasts.select("instrument_id", "signal_id", "evidence")
    clusters = cluster(evidence.select("signal_id"), similar_links(evidence, "instrument_id", "signal_id", "evidence", 0.5), "signal_id")
    merged = merge_clusters(calibrated.join(clusters, "signal_id").join(evidence.select("signal_id", "evidence"), "signal_id"))
    edges = merged.groupBy("instrument_id").agg(F.sum(F.col("weight") * F.col("excess")).alias("edge"))
    rows = market.join(edges, "instrument_id", "left")
    sized = size_positions(rows.select("book", "instrument_id", "vol", "edge"), correlation, shrink, target_pct, equity, single, gross, net)
    kept = market.join(sized, ["book", "instrument_id"]).withColumn("target", keep_if_costly(F.col("notional"), F.col("current"), F.col("cost_bps"), multiple))
    return order_intents(kept, equity, single, order, atr_multiple)
