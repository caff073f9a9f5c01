"""Centroid clustering with Ptolemaic pivots: exact integer k-means whose assignments skip most centroids by lower bounds.

Vectors become integers floor(SCALE * x). Centroids start as the vectors whose hashed ids come first. The
starting centroids also stay as fixed pivots p, and each vector's exact squared distances to them are
cached with it, once. In Euclidean space Ptolemy's inequality holds for any four points, so for a fixed pair of
pivots

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

costs three multiplications where a distance costs one for each component. A round takes a vector's most
promising centroid exactly, then exactly every other whose bound isn't above that distance. Bounds are rounded
down by more than float arithmetic can be wrong, and equal distances stay candidates, so assignments are those of
a full search.

Tasks add up their vectors' components; the driver gets a row for each centroid and component, and keeps the
centroids: bounded by the parameters, not by the data.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones are left
out; components beyond CLAMP count as CLAMP, so that a distance fits a long, and sums of distances stop at the
largest long; fewer vectors than centroids: as many centroids as vectors; an empty table: no rows; rows that repeat a
vec_id are vectors of their own, equal hashes go by components; a null vec_id is hashed as the empty text; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, stage

CENTROIDS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Starting centroids that serve as pivots; each makes a pair with the next one.
PIVOTS = 16
CLAMP = 1 << 27
ROWS = 8192
_TOP = (1 << 63) - 1
#: Relative slack of a bound: float operations on it are wrong by a few units of 2^-53 each.
_SLACK = 2.0**-46


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) for the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fit = (F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(e, lambda v: F.least(F.greatest(F.floor(v * F.lit(float(scale))), F.lit(-CLAMP)), F.lit(CLAMP)).cast("int"))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long"), whole.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to one point c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Lower bounds from fixed pairs of pivots, and exact assignments."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        pairs = [(i, (i + 1) % len(pivots)) for i in range(len(pivots) if len(pivots) > 2 else len(pivots) - 1)]
        apart = [(i, j, np.sqrt(float(squared(pivots[i : i + 1], pivots[j])[0]))) for i, j in pairs]
        self.pairs = [(i, j, d) for i, j, d in apart if d]

    def cached(self, x: np.ndarray) -> np.ndarray:
        return np.stack([squared(x, p) for p in self.pivots], axis=1)

    def below(self, cached: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared lower bounds [row, centroid]."""
        dx, dc = np.sqrt(cached.astype(np.float64)), np.sqrt(self.cached(centroids).astype(np.float64))
        out = np.zeros((len(cached), len(centroids)))
        for i, j, apart in self.pairs:
            a, b = dx[:, i, None] * dc[None, :, j], dx[:, j, None] * dc[None, :, i]
            np.maximum(out, (np.abs(a - b) - (a + b) * _SLACK) / (apart * (1 + _SLACK)), out=out)
        return out * out * (1 - _SLACK)

    def assign(self, x: np.ndarray, cached: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number), its squared distance, and how many were checked exactly."""
        low = self.below(cached, centroids)
        near = low.argmin(1)
        d = x - centroids[near]
        best = np.einsum("ij,ij->i", d, d)
        first, checked = near.copy(), np.ones(len(x), np.int64)
        for c in range(len(centroids)):
            left = np.flatnonzero((low[:, c] <= best) & (first != c))
            if len(left):
                d = squared(x[left], centroids[c])
                better = (d < best[left]) | ((d == best[left]) & (c < near[left]))
                best[left[better]], near[left[better]] = d[better], c
                checked[left] += 1
        return near, best, checked


def _rows_of(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _cache(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(pivots)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d = bounds.cached(_rows_of(part.column(1), pivots.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(d), pa.list_(pa.int64()))], ["vec_id", "x", "to_pivots"])

    return run


def _assigned(pivots: np.ndarray, centroids: np.ndarray, sums: bool):
    """A row for each vector or, with sums, for each centroid and component of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(pivots)
        k, dim = centroids.shape
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _rows_of(part.column(1), dim)
                near, best, checked = bounds.assign(x, _rows_of(part.column(2), len(pivots)), centroids)
                if sums:
                    for c in np.unique(near):
                        own = near == c
                        total[c] += x[own].sum(0)
                        count[c] += own.sum()
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near, pa.int32()), pa.array(best), pa.array(checked, pa.int32())], ["vec_id", "cluster", "distance", "n_checked"])
        if sums:
            full = np.flatnonzero(count)
            at = (np.repeat(full, dim), np.tile(np.arange(dim), len(full)))
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at]), pa.array(np.repeat(count[full], dim))], ["cluster", "component", "total", "n"])

    return run


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, n_checked, cluster_inertia, inertia, centroid_sha256) for each vector (vec_id, embedding) that takes part."""
    spark = vectors.sparkSession
    rows = stage(integers(vectors, dim, scale), "integers")
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = [r["x"] for r in rows.select("x", order.alias("h")).orderBy("h", "x").limit(centroids).collect()]
    out = "vec_id long, cluster int, distance long, n_checked int"
    if not start:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.array(start, dtype=np.int64)
    pivots = now[:PIVOTS].copy()
    table = stage(rows.mapInArrow(_cache(pivots), "vec_id long, x array<int>, to_pivots array<long>"), "pivots")
    for _ in range(rounds):
        parts = table.mapInArrow(_assigned(pivots, now, True), "cluster int, component int, total long, n long")
        now = now.copy()
        for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            now[r["cluster"], r["component"]] = r["total"] // r["n"]  # Python's // is the floor
    found = stage(table.mapInArrow(_assigned(pivots, now, False), out), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(sums.values()), _TOP)
    named = [(c, min(d, _TOP), sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    each = spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(each), "cluster")  # a row for each centroid
    return joined.select("vec_id", "cluster", "distance", "n_checked", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")


def op13_pivot_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings")).drop("n_checked")


def _oracle() -> str:
    def assigned(k: int) -> str:
        return f"""a{k} as (select rid, vec_id, x, min(cluster) filter (distance = least_) as cluster, any_value(least_) as distance from (
  select *, min(distance) over (partition by rid) as least_ from (
    select kept.rid, vec_id, x, c{k}.cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(x, c)])::bigint as distance from kept, c{k})) group by rid, vec_id, x)"""

    def moved(k: int) -> str:
        return f"""m{k} as (select cluster, component, sum(v)::bigint as s, count(*)::bigint as n from (
  select cluster, unnest(x) as v, unnest(range(1, {DIM + 1})) as component from a{k - 1}) group by all),
c{k} as (select c{k - 1}.cluster, coalesce(new.c, c{k - 1}.c) as c from c{k - 1} left join (
  select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by component) as c from m{k} group by cluster) as new using (cluster))"""

    rounds = ",\n".join(x for k in range(1, ROUNDS + 1) for x in (moved(k), assigned(k)))
    return f"""with numbered as (select row_number() over () as rid, vec_id, [v::double for v in embedding] as e from embeddings),
kept as (select rid, vec_id, [greatest(least(floor({SCALE} * v), {CLAMP}), -{CLAMP})::bigint for v in e] as x from numbered
  where len(e) = {DIM} and len([v for v in e if v is null or isnan(v) or isinf(v)]) = 0),
c0 as (select (row_number() over (order by h, x) - 1)::int as cluster, x as c from (
  select x, sha256('1:' || coalesce(vec_id::varchar, '')) as h from kept order by h, x limit {CENTROIDS})),
{assigned(0)},
{rounds}
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256 from a{ROUNDS} join c{ROUNDS} using (cluster)"""


ORACLE = _oracle()
