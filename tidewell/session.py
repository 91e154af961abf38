"""Session settings and the table reader that every query shares."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parent.parent)

#: Settings the operators rely on: UTC timestamps, ANSI arithmetic, AQE with skew handling.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows that go to a Python worker at once: whole texts are long, and a worker and its JVM each hold a batch.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package, wherever the driver was started from, and keep them small.

    Their Arrow memory comes from the system, which takes a batch back once it is gone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    workers = spark.sparkContext.environment
    workers.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
