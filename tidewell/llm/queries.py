"""The registered queries of the text-corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bm25_wand, bpe_automaton, cgk_decontam, langid_bloom, minhash_bayes, minimax_shards, pii_feistel, substring_dedup, toxicity, url_filter
from tidewell.session import read_table

#: Folder of the public tokenizers' files, and the one that op10 encodes with.
TOKENIZERS = os.environ.get("TIDEWELL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"

#: Key of the pseudonyms; production sets its own in the environment of the driver.
PRIVATE_KEY = os.environ.get("TIDEWELL_PRIVATE_KEY", "tidewell-demonstration-key").encode()

URL_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]


def _remainder(n: int):
    """crc32 of the id as text, modulo n: it tells learning rows from held-out ones."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(n))


def op1_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 is a query against all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return bm25_wand.search(docs, queries, k=10)


def op2_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_bayes.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(4) == 2
    model = toxicity.fit(docs.where(~held_out), read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), length=13, keep_text=False)


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_feistel.replace_private(docs, PRIVATE_KEY)
    kinds = [F.coalesce(F.try_element_at("private", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in pii_feistel.KINDS]
    return found.select("doc_id", "text", "n_private", *kinds)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op8_langid_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _remainder(3) == 1
    found = langid_bloom.identify(docs, langid_bloom.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.shard_documents(read_table(spark, sf_dir, "documents"), shards=24)


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(read_table(spark, sf_dir, "documents"), VOCABULARY, keep=False)


QUERIES = {f.__name__: f for f in (op1_bm25_wand, op2_minhash_bayes, op3_cgk_decontam, op4_toxicity, op5_substring_dedup, op6_pii_feistel, op7_url_filter, op8_langid_bloom, op9_minimax_shards, op10_bpe_automaton)}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

#: Words of a text, apart at blanks.
_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES = {
    "op1_bm25_wand": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents),
n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM t)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
tf AS (SELECT doc_id, w, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2), len AS (SELECT doc_id, sum(c) AS l FROM tf GROUP BY 1), df AS (SELECT w, count(*)::DOUBLE AS d FROM tf GROUP BY 1),
v AS (SELECT tf.doc_id, tf.w, ln(1 + (docs - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)) AS v FROM tf JOIN len ON tf.doc_id = len.doc_id JOIN df ON tf.w = df.w, n),
s AS (SELECT q.doc_id AS query_id, v.doc_id, sum(v) AS score FROM tf q JOIN v ON q.w = v.w WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10
""",
    "op2_minhash_bayes": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, u.b FROM r JOIN u ON r.t = u.a),
c AS (SELECT s, min(t) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, low = d.doc_id AS kept FROM documents d JOIN c ON s = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT k, min(doc_id) AS low FROM g GROUP BY 1), hit AS (SELECT doc_id, i FROM g JOIN low ON g.k = low.k WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS at FROM hit, range(13) r(j)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.at) AS t, count(*) AS n FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.at = gone.at GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op7_url_filter": f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), rules(h, p, v) AS (VALUES {_RULE_ROWS}), fits AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, h || p) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.n = fits.n AND k = 1
""",
}
