"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.shared import held


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end of the edges (a, b), which may be any sortable type: the smallest that can be reached.

    Each round takes the least label among neighbours and follows labels once; labels are tables in the
    shared folder.
    """
    both = held(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = held(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("root").alias("m"))
        stepped = held(labels.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "m").alias("root")), "labels")
        ahead = stepped.select(F.col("v").alias("root"), F.col("root").alias("next"))
        jumped = held(stepped.join(ahead, "root").select("v", F.col("next").alias("root"), (F.col("next") != F.col("was")).alias("moved")), "labels")
        labels = jumped.select("v", "root")
        if jumped.where("moved").isEmpty():
            return labels
