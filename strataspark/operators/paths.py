"""Operators over paths: ordered points of a branch, track or cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trace_length(points: DataFrame, key: str, order: list[str], x: Column, y: Column, ratio: float = 1.0) -> DataFrame:
    """Length of each path: distances between consecutive points, times a ratio. One point: 0."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.sqrt(F.pow(x - F.lag(x).over(w), 2) + F.pow(y - F.lag(y).over(w), 2))
    return points.withColumn("step_", step).groupBy(key).agg((F.coalesce(F.sum("step_"), F.lit(0.0)) * ratio).alias("trace_mm"), F.count("*").alias("n_points"))


def numbered(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """points with pos, the 0-based place in the path."""
    return points.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def sampled(points: DataFrame, every: int = 10) -> DataFrame:
    return points.where(F.col("pos") % every == 0)


def reference_points(points: DataFrame, key: str, value: str, at: int = 50) -> DataFrame:
    """The point `at` steps from either end, for paths longer than that."""
    n = points.groupBy(key).agg(F.count("*").alias("n"))
    both = points.join(n, key).where(F.col("n") > at)
    return both.groupBy(key).agg(F.max(F.when(F.col("pos") == at, F.col(value))).alias("from_start"), F.max(F.when(F.col("pos") == F.col("n") - 1 - at, F.col(value))).alias("from_end"))


def branch_table(points: DataFrame, key: str, value: Column) -> DataFrame:
    """Length and centre of each branch."""
    return points.groupBy(key).agg(F.count("*").alias("length"), F.avg(value).alias("center"))


def residual_statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and population deviation of the distances from each group's mean."""
    mean = df.groupBy(key).agg(F.avg(value).alias("mean_"))
    far = df.join(mean, key).withColumn("far_", F.abs(F.col(value) - F.col("mean_")))
    return far.groupBy(key).agg(F.avg("far_").alias("mean_residual"), F.stddev_pop("far_").alias("std_residual"))


def class_vote(df: DataFrame, key: str, label: str, preference: list[str]) -> DataFrame:
    """The most frequent label of each key; ties go to the one first in preference."""
    rank = F.array_position(F.array(*(F.lit(p) for p in preference)), F.col(label))
    votes = df.groupBy(key, label).agg(F.count("*").alias("hits"))
    return votes.groupBy(key).agg(F.max_by(label, F.struct("hits", -rank)).alias("winner"), F.max("hits").alias("hits"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Nodes that occur once among the ends of all edges (src, dst)."""
    both = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return both.groupBy("node").agg(F.count("*").alias("degree")).where("degree = 1")
