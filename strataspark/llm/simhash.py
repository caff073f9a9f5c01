"""SimHash near-duplicates, found with a vantage-point tree over whole fingerprints.

A text's fingerprint has a bit set where over half of the hashes of its three-word shingles have.
Fingerprints link when they differ in at most `max_distance` bits.

Equal fingerprints are one point. A tree of vantage points parts them by Hamming distance: at each node
the points no farther from the vantage point than the node's radius go to the inner child, the others to
the outer one; a leaf is a shard. Vantage points and radii (medians) come from a bounded sample of points;
below the sample's reach vantage points are drawn by hash and the radius is 32, the median of hashes.

Search goes down the same tree. By the triangle bound a point x beyond the radius t of a vantage point p has
no partner inside where d(x, p) - max_distance > t, so that branch is pruned; where the bound leaves it open,
x also visits the inner child. A visitor goes on to each child that the bound leaves open. Each pair of linked
points so meets once as owners of one shard, or where one of them visits the other's shard, for any distance.
Shards compare owners with owners and with visitors over all 64 bits. A shard of more than SUB_BLOCK points is
compared in pairs of sub-blocks, spread over tasks; tasks return stars, not pairs.

What this costs: distances of hashes crowd around 32 (deviation 4), so at distance 2 about 39 % of visitors go
both ways at a level, and rows grow as the number of points to the power 1.48.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of one or
two words have one shingle; repeated rows get the same class; a null doc_id counts only where a component
has no other id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices, stage, text_of
from .components import components

BITS, SHINGLE, SEED = 64, 3, 42
MAX_DISTANCE = 2
#: Points that a shard owns on average, points compared at once, and points from which vantage points are taken.
SHARD, SUB_BLOCK, SAMPLE = 1024, 16_384, 16_384


def fingerprint(text: str) -> int:
    """The signed 64-bit fingerprint."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    k = min(SHINGLE, len(words))
    starts = [0, *ends]
    h = np.array([xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = [fingerprint(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """Vantage points and radii by node: the root is 1, the children of k are 2 k (inner) and 2 k + 1."""

    def __init__(self, sample: np.ndarray, depth: int):
        """sample: fingerprints as uint64."""
        self.depth, known = depth, 1
        while known < 1 << depth and len(sample) >> known.bit_length() >= 4:
            known <<= 1
        self.points, self.radii = self._drawn(np.arange(known, dtype=np.uint64)), np.full(known, BITS // 2, np.int64)
        rows = {1: sample}
        for node in range(1, known):
            own = rows.pop(node, sample[:0])
            if not len(own):
                continue
            self.points[node] = own[0]
            d = np.bitwise_count(own ^ own[0]).astype(np.int64)
            self.radii[node] = t = int(np.median(d))
            rows[2 * node], rows[2 * node + 1] = own[d <= t], own[d > t]

    @staticmethod
    def _drawn(node: np.ndarray) -> np.ndarray:
        x = (node + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def shards(self, x: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, place in x, whether as a visitor) of each point and of each visit that the bound leaves open."""
        node, at, visits = np.ones(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
        for _ in range(self.depth):
            here = node < len(self.points)
            safe = np.where(here, node, 0)
            d = np.bitwise_count(x[at] ^ np.where(here, self.points[safe], self._drawn(node.astype(np.uint64)))).astype(np.int64)
            t = np.where(here, self.radii[safe], BITS // 2)
            inner = np.where(visits, d - max_distance <= t, d <= t)
            outer = np.where(visits, d + max_distance > t, d > t)
            calls = ~visits & outer & (d - max_distance <= t)  # an owner of the outer child visits the inner one
            node = np.r_[2 * node[inner], 2 * node[outer] + 1, 2 * node[calls]]
            at, visits = np.r_[at[inner], at[outer], at[calls]], np.r_[visits[inner], visits[outer], np.ones(calls.sum(), bool)]
        return node, at, visits


def _routed(tree: Tree, max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            x = batch.column(0).to_numpy(zero_copy_only=False)
            shard, at, visits = tree.shards(x.view(np.uint64), max_distance)
            for k in range(0, len(shard), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(shard[part]), pa.array(x[at[part]]), pa.array(visits[part])], ["shard", "fp", "visits"])

    return run


def _stars(max_distance: int):
    """Links within the groups (shard, low, high) of sorted batches, as a star for each connected part of a group."""

    def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the parts of a and b; root holds each point's smallest place."""
        while (differ := root[a] != root[b]).any():
            a, b = a[differ], b[differ]
            one, other = root[a], root[b]
            np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
            while (root[root] != root).any():
                root[:] = root[root]

    def stars(own: np.ndarray, x: np.ndarray, visits: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        sides = [(own == low, own == low)] if low == high else [(own == low, own == high), (own == high, own == low)]
        root = np.arange(len(x))
        for k, (one, other) in enumerate(sides):  # owners of one block with owners (once) and visitors of the other
            p, q = np.flatnonzero(one & ~visits), np.flatnonzero(other & (visits | (k == 0)))
            step = max(1, (1 << 20) // max(1, len(q)))
            for at in range(0, len(p), step):  # a million pairs at a time
                i, j = np.nonzero(np.bitwise_count(x[p[at : at + step], None] ^ x[q][None, :]) <= max_distance)
                join(root, p[at + i], q[j])
        moved = np.flatnonzero(x[root] != x)
        return x[moved].view(np.int64), x[root[moved]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(6)]

        def out() -> pa.RecordBatch:
            shard, low, high, own, fp, visits = (np.concatenate(h) for h in held)
            a, b = stars(own, fp.view(np.uint64), visits, low[0], high[0])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            for s, e in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if held[0] and any(h[0][0] != c[s] for h, c in zip(held[:3], columns, strict=False)):
                    yield out()
                    held = [[] for _ in range(6)]
                for h, c in zip(held, columns, strict=True):
                    h.append(c[s:e])
        if held[0]:
            yield out()

    return run


def links(points: DataFrame, max_distance: int = MAX_DISTANCE, shard: int = SHARD, sub_block: int = SUB_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) that connect exactly what the links between distinct fingerprints (fp) connect.

    The driver gets the number of points and at most `sample` of them.
    """
    n = points.count()
    depth = max(0, (-(-n // shard) - 1).bit_length())
    some = [r["fp"] for r in points.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(sample).collect()] if depth else []
    tree = Tree(np.array(some, np.int64).view(np.uint64), depth)
    rows = stage(points.select("fp").mapInArrow(_routed(tree, max_distance), "shard long, fp long, visits boolean"), "shards")
    # a shard where two meet: two owners, or one and a visitor
    sizes = stage(rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(~F.col("visits")).alias("owners")).where("n > 1 and owners > 0").select("shard", F.ceil(F.col("n") / sub_block).cast("int").alias("blocks")), "sizes")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = rows.join(sizes, "shard").withColumn("own", own)
    # a point meets its own sub-block and, as the first or the second of a pair, each other one
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    grouped = paired.select(*group, "own", "fp", "visits").repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high")
    return grouped.mapInArrow(_stars(max_distance), "a long, b long").distinct()


def named(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of prints (doc_id, fp; a table): the smallest fingerprint and doc_id of its component."""
    points = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    found = components(links(points, max_distance)).withColumnRenamed("v", "fp")
    rooted = stage(points.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    return stage(rooted.join(least, "root").select("fp", "root", "component_id"), "named")


def classes(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """prints (doc_id, fp, ...; a table) with component_id, the smallest doc_id of the component."""
    return prints.join(named(prints, max_distance).drop("root"), "fp")


def keep_first(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; docs is read twice, so it should be a table.

    Rows that repeat an id are one document. A row without an id goes where its component has one with an id;
    else one such row of the component stays. Texts are not shuffled, but for those of rows without an id.
    """
    prints = stage(fingerprints(docs), "prints")
    names = named(prints, max_distance)
    copies = stage(prints.join(names, "fp").where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    own = F.pandas_udf(lambda texts: texts.map(fingerprint), "long")
    rest = docs.where("doc_id is null").withColumn("fp_", own(text_of())).join(names.where("component_id is null").select(F.col("fp").alias("fp_"), F.col("root").alias("root_")), "fp_").dropDuplicates(["root_"])
    return docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").select(*docs.columns).union(rest.select(*docs.columns))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    prints = stage(fingerprints(read_table(spark, sf_dir, "documents")), "prints")
    return classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
