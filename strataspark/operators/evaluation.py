"""Scores of predicted planes against a reference log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.geometry import normal_of


def score_matrix(predicted: DataFrame, reference: DataFrame, key: str, length: Column | float) -> DataFrame:
    """For each pair of a predicted and a reference plane of the same hole: position, angle and joint score.

    Inputs have key, id, depth, azimuth, dip. Position is 1 - |difference in depth| / length and may be negative;
    angle is |n n'| within [0, 1]. A hole's planes are few, and pairs are made within holes only.
    """
    p = predicted.select(key, F.col("id").alias("p_id"), F.col("depth").alias("p_depth"), *(c.alias(f"p_{n}") for n, c in zip("xyz", normal_of(F.col("azimuth"), F.col("dip")), strict=True)))
    r = reference.select(key, F.col("id").alias("r_id"), F.col("depth").alias("r_depth"), *(c.alias(f"r_{n}") for n, c in zip("xyz", normal_of(F.col("azimuth"), F.col("dip")), strict=True)))
    length = F.lit(length) if isinstance(length, float) else length
    pairs = p.join(r, key)
    angle = F.least(F.lit(1.0), F.abs(F.col("p_x") * F.col("r_x") + F.col("p_y") * F.col("r_y") + F.col("p_z") * F.col("r_z")))
    pairs = pairs.withColumn("position", 1.0 - F.abs(F.col("p_depth") - F.col("r_depth")) / length).withColumn("angle", angle)
    return pairs.select(key, "p_id", "r_id", "position", "angle", (F.col("position") * F.col("angle")).alias("joint"))


def best_assignment(score: np.ndarray) -> float:
    """The largest sum of scores over one-to-one assignments (rows to columns; both padded with zeros to a square).

    Shortest augmenting paths with potentials, O(n^3).
    """
    n = max(score.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : score.shape[0] + 1, 1 : score.shape[1] + 1] = -score
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[at]:
            used[at] = True
            gap = cost[match[at]] - u[match[at]] - v
            better = ~used & (gap < least)
            better[0] = False
            least[better], way[better] = gap[better], at
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            to = int(free.argmin())
            step = free[to]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return float(-cost[match[1:], np.arange(1, n + 1)].sum())


def quality_indices(pairs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """QPI, QAI and CEI of each hole: three independent best assignments over max(predicted, reference) planes.

    counts: key, n_pred, n_ref for every hole with a reference; without predictions all are zero. Holes are put
    together by a hash, so a Python call serves many of them.
    """
    schema = f"{key} {dict(counts.dtypes)[key]}, n_pred long, n_ref long, qpi double, qai double, cei double"
    rows = counts.join(pairs, key, "left").withColumn("lot_", F.pmod(F.xxhash64(key), F.lit(64)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for hole, own in pdf.groupby(key, sort=False):
            n_pred, n_ref = int(own["n_pred"].iloc[0]), int(own["n_ref"].iloc[0])
            values = [0.0, 0.0, 0.0]
            if n_pred and n_ref:
                p, r = pd.factorize(own["p_id"], sort=True)[0], pd.factorize(own["r_id"], sort=True)[0]
                for k, c in enumerate(("position", "angle", "joint")):
                    m = np.zeros((n_pred, n_ref))
                    m[p, r] = own[c]
                    values[k] = best_assignment(m) / max(n_pred, n_ref)
            out.append((hole, n_pred, n_ref, *values))
        return pd.DataFrame(out, columns=[key, "n_pred", "n_ref", "qpi", "qai", "cei"])

    return rows.groupBy("lot_").applyInPandas(run, schema)
