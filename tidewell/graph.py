"""Connected components over DataFrames of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.scratch import save


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node with the smallest node it can reach.

    ``nodes`` has (node, label), the label being any label reached before (at first the node
    itself); ``edges`` has (a, b), each a link between two nodes. Labels are contracted first: a
    round lets each label adopt the smallest neighbouring label, then follows the chosen pointers
    to their end, so the number of rounds grows with the logarithm of a component's diameter.
    A node that many links share is only ever met by joins and partial minima.
    """
    labels = nodes
    joined = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"
    )
    links = save(joined.where("la <> lb").select(F.greatest("la", "lb").alias("hi"), F.least("la", "lb").alias("lo")).distinct(), "links")
    while not links.isEmpty():
        parent = save(links.groupBy(F.col("hi").alias("child")).agg(F.min("lo").alias("root")), "parent")
        while True:  # pointer jumping: halves every chain
            above = parent.select(F.col("child").alias("root"), F.col("root").alias("up"))
            jumped = parent.join(above, "root", "left").select("child", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
            jumped = save(jumped, "parent")
            parent = jumped.select("child", "root")
            if jumped.where("moved").isEmpty():
                break
        labels = save(_follow(labels, "label", parent), "labels")
        moved = _follow(_follow(links, "hi", parent), "lo", parent).where("hi <> lo")
        links = save(moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "links")
    return labels


def _follow(df: DataFrame, name: str, parent: DataFrame) -> DataFrame:
    found = df.join(parent.withColumnRenamed("child", name), name, "left")
    return found.withColumn(name, F.coalesce("root", name)).select(*df.columns)
