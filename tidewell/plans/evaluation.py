"""Evaluation queries: orders stand in for forecasts with outcomes, labelled documents for a classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import evaluation as E
from tidewell.session import read_table

EDGES = [0.0, 0.25, 0.5, 0.75, 1.0]


def forecasts(spark, d):
    o = read_table(spark, d, "orders")
    action = F.when(F.col("o_orderstatus") == "F", "long").when(F.col("o_orderstatus") == "O", "short").otherwise("flat")
    score = F.round(F.col("o_totalprice") / 250000, 2)
    p = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 100 / 100)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("key"), action.alias("action"), score.alias("raw_score"), p.alias("probability"), (F.col("o_custkey") % 41 - 19).cast("double").alias("realized"))


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def forecast_summary(spark, d):
    return E.summary(forecasts(spark, d), ["key"]).select("key", *_r("coverage", "abstention", "hit_rate", "brier", "net_ic"))


def forecast_calibration(spark, d):
    return E.calibration_table(forecasts(spark, d), EDGES).select("bucket", "low", "high", "n", *_r("mean_p", "rate"))


def forecast_calibration_error(spark, d):
    return E.calibration_error(E.calibration_table(forecasts(spark, d), EDGES)).select(*_r("ece"))


def forecast_baselines(spark, d):
    """The deterministic baselines; the random one is tested on its frequencies."""
    tagged = E.baselines(forecasts(spark, d)).where("tag <> 'random'")
    return E.summary(tagged, ["tag"]).select("tag", *_r("coverage", "hit_rate", "brier", "net_ic"))


def forecast_contract(spark, d):
    return E.contract_status(forecasts(spark, d), 1000, 100, 0.3).select("n", *_r("brier"), "status")


def rank_correlation(spark, d):
    rows = forecasts(spark, d).withColumn("s", E.signed_score())
    return E.spearman(rows, ["key"], "s", "realized").select("key", *_r("ic"), "n")


def probability_scores(spark, d):
    rows = forecasts(spark, d).where("probability is not null").withColumn("y", (F.col("realized") > 0).cast("double"))
    said, true = F.col("probability") >= 0.5, F.col("y") == 1
    found = rows.groupBy("key").agg(E.log_loss(F.col("probability"), F.col("y")).alias("log_loss"), E.balanced_accuracy(said, true).alias("balanced"), F.avg(F.pow(F.col("probability") - F.col("y"), 2)).alias("brier"))
    return found.select("key", *_r("log_loss", "balanced", "brier"))


def hac_errors(spark, d):
    return E.hac_error(forecasts(spark, d), ["key"], ["at", "id"], E.signed_score() * F.col("realized")).select("key", "n", *_r("error"))


def labelled(spark, d):
    """Length stands in for the classifier's label and confidence."""
    docs = read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id")
    name = lambda c: F.when(c == 0, "negative").when(c == 1, "neutral").otherwise("positive")
    return docs.select("doc_id", name(F.col("quality") + F.col("toxic")).alias("true"), name(F.col("n_chars") % 3).alias("said"), (F.col("n_chars") % 101 / 100).alias("confidence"))


def confusion_matrix(spark, d):
    return E.confusion(labelled(spark, d), "true", "said")


def class_metrics(spark, d):
    return E.class_scores(E.confusion(labelled(spark, d), "true", "said")).select("label", *_r("precision", "recall", "f1"), "support")


def confidence_calibration(spark, d):
    return E.confidence_table(labelled(spark, d), "confidence", F.col("true") == F.col("said")).select("bin", "n", *_r("mean_confidence", "accuracy"))


def bootstrap_interval(spark, d):
    """Percentiles of the mean outcome over block resamples of 5000 ordered orders: rows only."""
    return E.bootstrap(forecasts(spark, d).where("key = '1-URGENT'"), ["realized"], ["at", "id"], lambda x: float(x[:, 0].mean()), reps=200)


def logistic_fit(spark, d):
    slope, intercept = E.logistic_calibration(forecasts(spark, d).withColumn("y", F.col("realized") > 0), "probability", "y")
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")


QUERIES = {f.__name__: f for f in (
    forecast_summary, forecast_calibration, forecast_calibration_error, forecast_baselines, forecast_contract, rank_correlation, probability_scores,
    hac_errors, confusion_matrix, class_metrics, confidence_calibration, bootstrap_interval, logistic_fit,
)}

_F = """f AS (SELECT o_orderkey AS id, o_orderdate AS t, o_orderpriority AS key, CASE o_orderstatus WHEN 'F' THEN 'long' WHEN 'O' THEN 'short' ELSE 'flat' END AS action,
round(o_totalprice / 250000, 2) AS s, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 100)::DOUBLE / 100 END AS probability, (o_custkey % 41 - 19)::DOUBLE AS realized FROM orders),
g AS (SELECT *, coalesce(probability, CASE WHEN action = 'flat' THEN 0.5 WHEN action = 'long' THEN 1 / (1 + exp(-abs(s))) ELSE 1 / (1 + exp(abs(s))) END) AS p, CASE WHEN realized > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
CASE action WHEN 'long' THEN abs(s) WHEN 'short' THEN -abs(s) ELSE 0 END::DOUBLE AS signed FROM f)"""
_IC = lambda x, y: f"CASE WHEN count({x}) >= 2 THEN coalesce(CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 0) END"
_A = "CASE WHEN action <> 'flat' THEN {} END"
_SUM = f"""round(avg((action <> 'flat')::INT), 6) AS coverage, round(avg({_A.format("((action = 'long') = (realized > 0))::INT")}), 6) AS hit_rate,
round(avg({_A.format('(p - y) ** 2')}), 6) AS brier, round({_IC(_A.format('signed'), _A.format('realized'))}, 6) AS net_ic"""
_CAL = f"""WITH {_F}, b AS (SELECT CASE WHEN p >= 0.75 THEN 3 WHEN p >= 0.5 THEN 2 WHEN p >= 0.25 THEN 1 ELSE 0 END AS bucket, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM g WHERE action <> 'flat' GROUP BY 1),
c AS (SELECT i::INT AS bucket, i * 0.25::DOUBLE AS low, (i + 1) * 0.25::DOUBLE AS high, coalesce(n, 0) AS n, mean_p, rate FROM range(4) r(i) LEFT JOIN b ON i = bucket)"""
_L = """l AS (SELECT doc_id, CASE quality + toxic WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS t, CASE n_chars % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS s,
(n_chars % 101)::DOUBLE / 100 AS c FROM documents JOIN labels USING (doc_id)), n AS (SELECT unnest(['negative', 'neutral', 'positive']) AS v),
m AS (SELECT a.v AS "true", b.v AS said, count(doc_id) AS n FROM n a CROSS JOIN n b LEFT JOIN l ON t = a.v AND s = b.v GROUP BY 1, 2)"""

ORACLES = {
    "forecast_summary": f"WITH {_F} SELECT key, {_SUM}, round(1 - avg((action <> 'flat')::INT), 6) AS abstention FROM g GROUP BY 1",
    "forecast_calibration": f"{_CAL} SELECT bucket, low, high, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM c",
    "forecast_calibration_error": f"{_CAL} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM c",
    "forecast_baselines": f"""WITH {_F}, u AS (SELECT 'advisor' AS tag, action, p, y, realized, signed FROM g UNION ALL SELECT 'always_flat', 'flat', 0.5, y, realized, 0 FROM g UNION ALL SELECT 'buy_and_hold', 'long', 1, y, realized, abs(s) FROM g)
SELECT tag, {_SUM} FROM u GROUP BY 1""",
    "forecast_contract": f"WITH {_F}, r AS (SELECT * FROM g ORDER BY t DESC, id DESC LIMIT 1000), b AS (SELECT avg({_A.format('(p - y) ** 2')}) AS brier FROM r) SELECT (SELECT count(*) FROM g) AS n, round(brier, 6) AS brier, CASE WHEN (SELECT count(*) FROM g) < 100 THEN 'insufficient' WHEN brier > 0.3 THEN 'breach' ELSE 'active' END AS status FROM b",
    "rank_correlation": f"""WITH {_F}, r AS (SELECT key, rank() OVER (PARTITION BY key ORDER BY signed) + (count(*) OVER (PARTITION BY key, signed) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY key ORDER BY realized) + (count(*) OVER (PARTITION BY key, realized) - 1) / 2.0::DOUBLE AS y FROM g)
SELECT key, round(coalesce({_IC('x', 'y')}, 0), 6) AS ic, count(*) AS n FROM r GROUP BY 1""",
    "probability_scores": f"""WITH {_F}, q AS (SELECT *, greatest(least(probability, 1 - 1e-12), 1e-12) AS c, probability >= 0.5 AS said FROM g WHERE probability IS NOT NULL)
SELECT key, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss, round((count_if(said AND y = 1)::DOUBLE / count_if(y = 1) + count_if(NOT said AND y = 0)::DOUBLE / count_if(y = 0)) / 2, 6) AS balanced, round(avg((probability - y) ** 2), 6) AS brier FROM q GROUP BY 1""",
    "hac_errors": f"""WITH {_F}, v AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t, id) AS i, signed * realized AS v, avg(signed * realized) OVER (PARTITION BY key) AS m, count(*) OVER (PARTITION BY key) AS n FROM g),
e AS (SELECT key, i, n, v - m AS e, least(greatest(1, floor(4 * (n / 100.0::DOUBLE) ** (2.0::DOUBLE / 9))), n - 1) AS lags FROM v),
s AS (SELECT a.key, a.n, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (a.lags + 1)) END * a.e * b.e) AS s FROM e a JOIN e b ON a.key = b.key AND b.i BETWEEN a.i - a.lags AND a.i GROUP BY 1, 2)
SELECT key, n, round(sqrt(greatest(s, 0)) / n, 6) AS error FROM s""",
    "confusion_matrix": f'WITH {_L} SELECT "true", said, n FROM m',
    "class_metrics": f"""WITH {_L}, r AS (SELECT "true" AS label, sum(CASE WHEN "true" = said THEN n ELSE 0 END)::DOUBLE AS h, sum(n) AS support FROM m GROUP BY 1), c AS (SELECT said AS label, sum(n) AS told FROM m GROUP BY 1),
p AS (SELECT label, h / nullif(told, 0) AS precision, h / nullif(support, 0) AS recall, support::BIGINT AS support FROM r JOIN c USING (label))
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM p""",
    "confidence_calibration": f"""WITH {_L}, b AS (SELECT least(floor(c * 10), 9)::INT AS bin, count(*) AS n, avg(c) AS a, avg((t = s)::INT) AS r FROM l GROUP BY 1)
SELECT i::INT AS bin, coalesce(n, 0) AS n, round(a, 6) AS mean_confidence, round(r, 6) AS accuracy FROM range(10) x(i) LEFT JOIN b ON i = bin""",
}
