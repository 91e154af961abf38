"""A corpus cleaned and encoded in five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe_automaton, cgk_decontam, minhash_bayes, pii_feistel, toxicity
from tidewell.llm.queries import PRIVATE_KEY, VOCABULARY
from tidewell.scratch import save
from tidewell.session import prepare, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents and drop what scores 0.3 or more."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate component, and every other one."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    judged = minhash_bayes.near_duplicates(docs, k=5, percent=80)
    dropped = save(judged.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    few = dropped.count() <= 1_000_000  # 8 MB of ids; beyond that the join shuffles
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within a fifth of its words in edits."""
    prepare(spark)
    return cgk_decontam.drop_leaked(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private values in the text; n_chars follows it."""
    prepare(spark)
    out = pii_feistel.replace_private(docs.select(*COLUMNS), PRIVATE_KEY, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of every document."""
    prepare(spark)
    return bpe_automaton.encode_documents(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", hide_private),
    ("bpe", encode),
]

#: A classifier, MinHash and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
