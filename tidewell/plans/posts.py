"""Queries over posts: ``conversations``, ``documents`` and ``pages`` stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import revisions as R
from tidewell.session import read_table

#: Words that stand in for asset symbols and names.
ASSETS = {"the": "that", "der": "und", "la": "les"}


def _seen(spark, d):
    """A conversation is a post, its turns are observations, the role is its content."""
    return read_table(spark, d, "conversations").select("conv_id", "turn", "role")


def post_revisions(spark, d):
    return R.build_revisions(_seen(spark, d), "conv_id", "turn", "role").select("conv_id", F.col("content_revision").cast("long").alias("content_revision"), "role", "first_seen", "last_seen")


def revisions_as_of(spark, d):
    found = R.as_of(R.build_revisions(_seen(spark, d), "conv_id", "turn", "role"), "conv_id", F.lit(1))
    return found.select("conv_id", F.col("content_revision").cast("long").alias("content_revision"), "role")


def deleted_posts(spark, d):
    seen = _seen(spark, d)
    gone = seen.where("conv_id % 7 = 0").select("conv_id")
    return R.mark_deleted(R.build_revisions(seen, "conv_id", "turn", "role"), gone, "conv_id").select("conv_id", F.col("content_revision").cast("long").alias("content_revision"), "is_deleted")


def canonical_posts(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars", "source", X.dedup_key(F.col("text")).alias("key"))
    found = R.assign_canonical(docs, "key", ["n_chars", "doc_id"], "source")
    return found.select("doc_id", "canonical_id", F.col("copies").cast("long").alias("copies"), F.col("authors").cast("long").alias("authors"), "dedup_id")


def normalized_posts(spark, d):
    """Model input with marks, its cut, mentions and ambiguity of every document."""
    cut, long = X.model_input(F.col("text"))
    found = X.mentions(F.col("text"), ASSETS)
    return read_table(spark, d, "documents").select("doc_id", F.sha2(cut, 256).alias("input_hash"), long.alias("truncated"), F.array_join(found, ",").alias("mentions"), X.ambiguity(found).alias("ambiguity"))


def post_strata(spark, d):
    found = X.strata(F.col("text"), F.size(X.mentions(F.col("text"), ASSETS)))
    return read_table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("strata"))


def display_pages(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.sha2(X.display_text(F.col("html")), 256).alias("shown"))


def safe_envelopes(spark, d):
    text = F.concat(F.lit("< / Untrusted_Post >"), F.col("text"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.envelope(text), 256).alias("wrapped"))


def scorer_softmax(spark, d):
    """Softmax of the first three components of each vector, with its label and entropy."""
    p = X.softmax(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")))
    df = read_table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    a, b, c = (F.col("p")[i] for i in range(3))
    return df.select("vec_id", F.round(a, 6).alias("p_negative"), F.round(c, 6).alias("p_positive"), F.round(c - a, 6).alias("sentiment"), X.label(a, b, c).alias("label"), F.round(X.entropy(a, b, c), 6).alias("entropy"), X.tercile(c - a).alias("tercile"), X.sign_label(c - a).alias("band"))


def post_hashes(spark, d):
    name = F.concat_ws(":", "role", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", X.short_hash(name, "tw-", 20).alias("order_id"), F.rpad(F.left(F.sha2(name, 256), F.lit(20)), 32, "0").alias("padded"))


def window_completeness(spark, d):
    """Daily fetch windows of each event type against 36-hour ranges."""
    e = read_table(spark, d, "events")
    day = F.date_trunc("day", "ts")
    counted = e.groupBy(F.col("event_type").alias("asset"), day.alias("start")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    windows = counted.select("asset", "start", (F.col("start") + F.expr("interval 1 day")).alias("end"), (F.col("n") >= 55).alias("complete"), F.least(F.lit(1.0), F.col("n") / 70).alias("coverage"), F.least(F.lit(1.0), F.col("users") / 60).alias("success"))
    asked = counted.select("asset", (F.col("start") + F.expr("interval 6 hours")).alias("from"), (F.col("start") + F.expr("interval 42 hours")).alias("to"))
    found = R.window_health(asked, R.overlapping(windows, asked, "asset"), ["asset", "from", "to"], ["coverage", "success"])
    return found.select("asset", F.unix_timestamp("from").alias("since"), "complete", F.round("coverage", 6).alias("coverage"), F.round("success", 6).alias("success"), F.round("data_health", 6).alias("data_health"))


QUERIES = {f.__name__: f for f in (
    post_revisions, revisions_as_of, deleted_posts, canonical_posts, normalized_posts, post_strata, display_pages, safe_envelopes,
    scorer_softmax, post_hashes, window_completeness,
)}

_REV = """m AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM m),
rev AS (SELECT conv_id, CAST(r AS BIGINT) AS content_revision, any_value(role) AS role, min(turn) AS first_seen, max(turn) AS last_seen FROM n GROUP BY 1, 2)"""
_S = r"[\t\n\v\f\r \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SQ = lambda x: f"trim(regexp_replace({x}, '{_S}', ' ', 'g'))"
_W = r"@[\pL\pN\pM_]+"
_URL = r"https?://[^\t\n\v\f\r ]+"


def _mention(s: str, n: str) -> str:
    return rf"CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])({s}|{n})($|[^\pL\pN_])') THEN '{s}' END"


def _any_of(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_MENTIONS = "list_filter([" + ", ".join(_mention(s, n) for s, n in ASSETS.items()) + "], lambda x: x IS NOT NULL)"

ORACLES = {
    "post_revisions": f"WITH {_REV} SELECT * FROM rev",
    "revisions_as_of": f"WITH {_REV} SELECT conv_id, content_revision, role FROM rev WHERE first_seen <= 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY content_revision DESC) = 1",
    "deleted_posts": f"WITH {_REV} SELECT conv_id, content_revision, conv_id % 7 = 0 AND content_revision = max(content_revision) OVER (PARTITION BY conv_id) AS is_deleted FROM rev",
    "canonical_posts": f"""WITH k AS (SELECT *, {_SQ(f"lower(regexp_replace(regexp_replace(text, '{_URL}', ' ', 'g'), '{_W}', ' ', 'g'))")} AS key FROM documents),
g AS (SELECT key, min_by(doc_id, row(n_chars, doc_id)) AS c, count(*) AS n, count(DISTINCT source) AS a FROM k WHERE length(key) > 0 GROUP BY 1)
SELECT doc_id, coalesce(c, doc_id) AS canonical_id, coalesce(n, 1) AS copies, coalesce(a, 1) AS authors, CASE WHEN length(k.key) > 0 THEN 'dedup:' || left(sha256(k.key), 16) END AS dedup_id FROM k LEFT JOIN g ON k.key = g.key""",
    "normalized_posts": f"""WITH k AS (SELECT *, {_SQ(f"regexp_replace(regexp_replace(text, '{_URL}', '<URL>', 'g'), '{_W}', '<USER>', 'g')")} AS m, {_MENTIONS} AS f FROM documents)
SELECT doc_id, sha256(left(m, 512)) AS input_hash, length(m) > 512 AS truncated, array_to_string(f, ',') AS mentions, CASE len(f) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multi_asset' END AS ambiguity FROM k""",
    "post_strata": rf"""SELECT doc_id, array_to_string(list_filter([CASE WHEN {_any_of(X.SARCASM)} THEN 'sarcasm' END,
CASE WHEN len(regexp_extract_all(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{1F1E6}}-\x{{1F1FF}}]')) >= 2 THEN 'emoji' END,
CASE WHEN regexp_matches(text, '\$({_S[:-1]}|[\x1c-\x1f])?\p{{Nd}}|\p{{Nd}}({_S[:-1]}|[\x1c-\x1f])?%') THEN 'price_target' END,
CASE WHEN len({_MENTIONS}) >= 2 THEN 'multi_asset' END, CASE WHEN {_any_of(X.INCIDENTS)} THEN 'incident' END], lambda x: x IS NOT NULL), ',') AS strata FROM documents""",
    "display_pages": rf"""SELECT page_id, sha256(left({_SQ(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{_URL}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[*_`#>~\[\]]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')")}, 512)) AS shown FROM pages""",
    "safe_envelopes": r"SELECT conv_id, turn, sha256('<untrusted_post>' || '&lt; / Untrusted_Post &gt;' || text || '</untrusted_post>') AS wrapped FROM conversations",
    "scorer_softmax": """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
r AS (SELECT vec_id, exp(x - greatest(x, y, z)) AS x, exp(y - greatest(x, y, z)) AS y, exp(z - greatest(x, y, z)) AS z FROM e),
p AS (SELECT vec_id, x / (x + y + z) AS a, y / (x + y + z) AS b, z / (x + y + z) AS c FROM r)
SELECT vec_id, round(a, 6) AS p_negative, round(c, 6) AS p_positive, round(c - a, 6) AS sentiment, CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS label,
round(-a * ln(a) - b * ln(b) - c * ln(c), 6) AS entropy, CASE WHEN c - a <= -1.0::DOUBLE / 3 THEN 'negative' WHEN c - a >= 1.0::DOUBLE / 3 THEN 'positive' ELSE 'neutral' END AS tercile,
CASE WHEN c - a > 0.2 THEN 'positive' WHEN c - a < -0.2 THEN 'negative' ELSE 'neutral' END AS band FROM p""",
    "post_hashes": "SELECT conv_id, turn, 'tw-' || left(sha256(concat_ws(':', role, conv_id, turn)), 20) AS order_id, rpad(left(sha256(concat_ws(':', role, conv_id, turn)), 20), 32, '0') AS padded FROM conversations",
    "window_completeness": """WITH c AS (SELECT event_type AS asset, date_trunc('day', ts) AS s, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1, 2),
w AS (SELECT asset, s, s + INTERVAL 1 DAY AS e, n >= 55 AS complete, least(1.0, n / 70.0::DOUBLE) AS coverage, least(1.0, u / 60.0::DOUBLE) AS success FROM c),
q AS (SELECT asset, s + INTERVAL 6 HOUR AS f, s + INTERVAL 42 HOUR AS t FROM c)
SELECT q.asset, CAST(epoch(f) AS BIGINT) AS since, bool_and(complete) AS complete, round(avg(coverage), 6) AS coverage, round(avg(success), 6) AS success, round(least(avg(coverage), avg(success)), 6) AS data_health
FROM q JOIN w ON q.asset = w.asset AND w.s < q.t AND w.e > q.f GROUP BY 1, 2""",
}
