"""Embedding near-duplicates: p-stable hashing of normalised vectors, exact cosines.

Vectors are scaled to length one, so cosine >= c is Euclidean distance <= sqrt(2 - 2 c). A table hashes
a vector by HASHES quantised random projections floor((a x + b) / width); TABLES tables make a link's
chance of sharing no bucket small (about 0.01 at the threshold itself, less above it). Within each bucket all
pairs are compared by their exact cosine in double precision.

Equal vectors are one point, known by a 128-bit digest, with a number of copies. A bucket of more than BLOCK
points is compared in pairs of sub-blocks, spread over tasks. First only sketches travel: a point's components
as bytes, with the length of what rounding took away. The cosine of two sketches is within a known bound of the
true one, so places in buckets where no other sketch may link are left out, and whole vectors travel to the rest
only. A pair that shares buckets of several tables counts in the first of them only, so links are counted
without bringing pairs together; tasks return one row for each point of a block that has links: their number
and the smallest point of its connected part.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing; vectors of
different lengths don't link; repeated vectors link with each other; an empty table gives no rows; rows that repeat
a vec_id are vectors of their own; a null vec_id counts as a vector, but not for component_id, which is null
where a component has no other id; such rows are not kept; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, stage
from .components import components

COSINE = 0.95
TABLES, HASHES, WIDTH, SEED = 16, 8, 1.6, 11
BLOCK = 256


def _hashed(cosine: float):
    """Unit vectors as bytes, their sketches and what these lack, and a bucket for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(SEED).integers(1, 1 << 62, TABLES * HASHES, dtype=np.int64) | 1
        width = WIDTH * np.sqrt(2 - 2 * cosine) / np.sqrt(0.1)
        for batch in batches:
            groups: dict[int, list] = {}
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.setdefault(len(v), []).append((key, v))
            for dim, rows in groups.items():
                if dim not in planes:
                    rng = np.random.default_rng((SEED, dim))
                    planes[dim] = rng.normal(size=(dim, TABLES * HASHES)), rng.random(TABLES * HASHES)
                a, b = planes[dim]
                x = np.array([v for _, v in rows], dtype=np.float64)
                x /= np.abs(x).max(1, keepdims=True)  # no overflow below
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                h = np.floor(x @ a / width + b).astype(np.int64)
                keys = (h * mix).reshape(len(x), TABLES, HASHES).sum(2) + np.arange(TABLES) + dim * TABLES
                scale = np.abs(x).max(1) / 127
                sketch = np.rint(x / scale[:, None]).astype(np.int8)
                lack = np.linalg.norm(x - sketch * scale[:, None], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([u.tobytes() for u in x], pa.binary()), pa.array([q.tobytes() for q in sketch], pa.binary()), pa.array(scale), pa.array(lack), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["key", "unit", "sketch", "scale", "lack", "buckets"])

    return run


def _part(link: np.ndarray) -> np.ndarray:
    """For each point the smallest position in its connected part of a link matrix."""
    root = np.arange(len(link))
    while True:
        near = np.where(link, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_GROUP = ("table", "bucket", "low", "high")


def _by_group(schema: str, group):
    """Runs group(rows, out) over the rows of each _GROUP of sorted batches; out gathers tuples of `schema`."""
    named = [x.split() for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(named)
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, named, strict=True)], [n for n, _ in named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if held and any(r[c] != held[0][c] for c in _GROUP):
                    group(held, out)
                    held = []
                held.append(r)
            yield table(out)
        out = []
        if held:
            group(held, out)
        yield table(out)

    return run


def _crossing(rows: list[dict]) -> np.ndarray:
    """Pairs to compare: those of two sub-blocks, or of one with itself, and never a point with itself."""
    side = np.array([r["own"] for r in rows])
    return ~np.eye(len(rows), dtype=bool) if rows[0]["low"] == rows[0]["high"] else side[:, None] != side[None, :]


def _likely(cosine: float):
    """Places where another sketch of the group may link."""

    def group(rows: list[dict], out: list[tuple]) -> None:
        q = np.stack([np.frombuffer(r["sketch"], np.int8) for r in rows]).astype(np.float64) * np.array([r["scale"] for r in rows])[:, None]
        lack = np.array([r["lack"] for r in rows])
        # x y = (q + e) (q' + e') and q has a length of 1 + |e| at most
        bound = lack[:, None] + lack[None, :] + 3 * lack[:, None] * lack[None, :] + 1e-9
        may = (q @ q.T >= cosine - bound) & _crossing(rows)
        out += [(r["key"], *(r[c] for c in _GROUP), r["own"]) for r, m in zip(rows, may.any(1), strict=True) if m]

    return _by_group("key binary, table int, bucket long, low int, high int, own int", group)


def _compared(cosine: float):
    """Links inside groups, by exact cosines."""

    def group(rows: list[dict], out: list[tuple]) -> None:
        rows.sort(key=lambda r: r["key"])
        ids = [r["key"] for r in rows]
        x = np.stack([np.frombuffer(r["unit"]) for r in rows])
        keys = np.array([r["buckets"] for r in rows], dtype=np.int64)
        copies = np.array([r["copies"] for r in rows], dtype=np.int64)
        link = (x @ x.T >= cosine) & _crossing(rows)
        for t in range(rows[0]["table"]):  # counted where they met first
            if not link.any():
                return
            link &= keys[:, t][:, None] != keys[:, t][None, :]
        n = link @ copies
        root = _part(link)
        out += [(ids[i], int(n[i]), ids[root[i]]) for i in np.flatnonzero(n)]

    return _by_group("key binary, n long, root binary", group)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    digest = F.unhex(F.md5(F.array_join(F.transform("e", lambda x: (x + 0.0).cast("string")), ",").cast("binary")))
    rows = stage(rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), digest)), "vectors")
    # any copy will do as the vector: copies have the same numbers
    points = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("e").alias("e"))
    points = stage(points, "points")
    hashed = points.select("key", "e").mapInArrow(_hashed(cosine), "key binary, unit binary, sketch binary, scale double, lack double, buckets array<bigint>")
    hashed = stage(hashed, "hashed")

    placed = hashed.select("key", "sketch", "scale", "lack", F.posexplode("buckets").alias("table", "bucket"))
    sizes = stage(placed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = placed.join(sizes, ["table", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("key", "table"), F.col("blocks")).cast("int")
    paired = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select("key", *_GROUP, "own", "sketch", "scale", "lack")
    likely = paired.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_likely(cosine), "key binary, table int, bucket long, low int, high int, own int")
    whole = hashed.select("key", "unit", "buckets").join(points.select("key", "copies"), "key")
    ready = stage(likely, "likely").join(whole, "key").select(*_GROUP, "key", "copies", "own", "unit", "buckets")
    found = stage(ready.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_compared(cosine), "key binary, n long, root binary"), "links")

    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "key")
    linked = points.select("key", "first", "copies").join(counts, "key", "left").join(roots, "key", "left")
    linked = stage(linked.select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "key").alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    classes = stage(linked.join(least, "root").select("key", "n", "component"), "classes")
    named = rows.select("vec_id", "key").join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return named.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
