"""Connected components of a graph that Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end of the edges (a, b): the smallest id that can be reached.

    Each round takes the least label among neighbours and then follows labels once, so distances
    halve. Labels are held in the shared folder after each step; both sides of every join are plain
    shuffles of such tables, so Spark can split a hub. No edges: no rows.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("root").alias("m"))
        stepped = stage(labels.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "m").alias("root")), "labels")
        ahead = stepped.select(F.col("v").alias("root"), F.col("root").alias("next"))
        jumped = stage(stepped.join(ahead, "root").select("v", F.col("next").alias("root"), (F.col("next") != F.col("was")).alias("moved")), "labels")
        labels = jumped.select("v", "root")
        if jumped.where("moved").isEmpty():
            return labels
