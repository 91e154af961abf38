"""Intermediate tables in the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``. A written table cuts lineage the way
``checkpoint()`` does, and keeps column pruning and file statistics for what reads it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of our own only where none is set (tests)."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = _own = _own or tempfile.mkdtemp(prefix="tidewell-")
    return found.rstrip("/")


def save(df: DataFrame, name: str = "table", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders ``by`` columns, and return the reader of that copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append((spark, path))
    # the plan that wrote the copy is garbage now; collecting it lets Spark delete its shuffle files at once
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table written by ``save``. Call it once results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the cluster's own clean-up applies
            return


atexit.register(release)
