"""Steps that must do many groups at once and send little, at 60 times sf0.1 as well."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.functions import groups, packed
from strataspark.operators import aperture, branches, contours, planes, raster, reconnect

from test_contours import pixels
from test_growth import plain_clusters


def traces(rng, n, width):
    """Branches near three curves, of whole and of other numbers."""
    out = []
    for k in range(n):
        long, at = int(rng.integers(4, 60)), int(rng.integers(0, width))
        x = ((at + np.arange(long)) % width).astype(float)
        trace = int(rng.integers(0, 3))
        z = 200 + 90 * trace + (12 + 9 * trace) * np.cos(2 * np.pi * x / width - trace) + rng.choice([0.3, 1.0, 3.0]) * rng.normal(size=long)
        z = np.rint(z) if k % 3 else z
        out.append((k * 7 % n, str(rng.choice(["filled", "unfilled", "cemented", "unknown"])), z, x))
    return out


def test_clusters_of_many_segments_grow_together_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(branches, "POINTS", 2000)
    rng, width = np.random.default_rng(31), 80
    segments = {s: traces(rng, n, width) for s, n in enumerate([30, 1, 2, 24, 40, 12, 8])}
    rows = []
    for s, left in segments.items():
        for ident, kind, z, x in left:
            for low in range(0, len(z), 9):
                rows.append((s, ident, kind, low, [(float(a), float(b)) for a, b in zip(z[low : low + 9], x[low : low + 9])]))
    rng.shuffle(rows)
    schema = "segment_id int, branch_id int, fractype string, pos int, path array<struct<z:double,x:double>>"
    rows = [(int(s), int(i), str(k), int(p), path) for s, i, k, p, path in rows]
    made = branches.cluster_branches(spark.createDataFrame(rows, schema), width)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.segment_id, r.cluster_id, r.place)):
        clusters = got.setdefault(r.segment_id, [])
        if r.place == 0:
            clusters.append([])
        clusters[-1].append(r.branch_id)
        assert (r.cluster_id, r.place) == (len(clusters) - 1, len(clusters[-1]) - 1)
    assert got == {s: want for s, left in segments.items() if (want := plain_clusters(left, width, 1.7, 1.5))}
    assert sum(len(c) - 1 for clusters in got.values() for c in clusters) > 20


def test_few_unions_of_a_cluster_are_measured_alone(monkeypatch):
    rng = np.random.default_rng(5)
    left = [(k, "filled", np.rint(rng.uniform(0, 250) + np.arange(n) * rng.uniform(-1, 1)), (rng.integers(0, 250) + np.arange(n)) % 256) for k, n in enumerate(rng.integers(8, 30, 200))]
    seen, measure = [], branches._residuals
    monkeypatch.setattr(branches, "_residuals", lambda points: seen.append(len(points)) or measure(points))
    got = branches.greedy_clusters(left, 64, 1.7, 1.5)
    assert sum(len(c) - 1 for c in got) > 50 and len(seen) < 50
    assert got == plain_clusters(left, 64, 1.7, 1.5)


@pytest.mark.parametrize("n", [1, 40])
def test_paths_become_rows_of_whole_branches(spark, n):
    rows = [(s, 5, k, 1, 12, p, 5 + p // 2, k + p, False) for s in range(n) for k in (3, 50) for p in range(12)]
    paths = spark.createDataFrame(rows, "segment_id int, root_y int, root_x int, branch_type int, n_px long, pos int, y int, x int, joint boolean").repartition(2, "segment_id", "root_x").sortWithinPartitions("x")
    got = {(r.segment_id, r.root_x): [(p.z, p.x) for p in r.path] for r in branches.path_arrays(paths).collect()}
    assert got == {(s, k): [(float(5 + p // 2), float(k + p)) for p in range(12)] for s in range(n) for k in (3, 50)}


def test_points_come_back_from_their_bytes():
    rng = np.random.default_rng(2)
    parts = [rng.integers(-9, 300, (n, 2)).astype(float).cumsum(0) % 4096 for n in (0, 1, 7, 300)]
    parts += [np.cumsum(rng.integers(-127, 128, (n, 2)), 0) + 2.0**40 for n in (1, 50)] + [rng.random((5, 2)), np.array([[0.0, 0.0], [128.0, 0.0]]), np.zeros((0, 2)), np.array([[0.5, 1.0]])]
    n = np.array([len(p) for p in parts])
    found = packed.coded(np.concatenate(parts), n)
    assert np.array_equal(packed.points_of(found, n), np.concatenate(parts))
    assert np.array_equal(packed.points_of(found.slice(3, 4), n[3:7]), np.concatenate(parts[3:7]))
    assert len(found[4].as_py()) == 16 and len(found[5].as_py()) == 16 + 2 * 49


@pytest.mark.parametrize("small", [1024, 25])
def test_normals_are_told_by_exact_sums_where_paths_arrive(spark, monkeypatch, small):
    """Also where four points lie in a square, which has no direction of least spread; paths are dealt once, as bytes."""
    monkeypatch.setattr(aperture, "SMALL", small)
    monkeypatch.setattr(planes, "SMALL", small)
    rng, rows = np.random.default_rng(12), []
    for k, size in enumerate([1, 2, 3, 4, 11, 25, 26, 60]):
        step = rng.integers(-1, 2, (size, 2)).cumsum(0) + 50 * k
        rows += [(k % 2, k, 3, size, p, int(y), int(x)) for p, (y, x) in enumerate(step)]
    rows += [(0, 99, 3, 4, p, 7 + p // 2, 7 + p % 2) for p in range(4)]
    order = rng.permutation(len(rows))
    paths = spark.createDataFrame([rows[i] for i in order], "segment_id int, root_y int, root_x int, n_px long, pos int, y int, x int")
    found = aperture.sampled_normals(paths, 5)
    if small == 1024:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "points_" in plan
    got = {(r.root_y, r.pos): (r.y, r.x, r.normal_deg) for r in found.collect()}
    assert len(got) == sum(p % 5 == 0 for *_, p, _, _ in rows)
    checked = 0
    for (root, pos), (y, x, normal) in got.items():
        near = sorted(((b - y) ** 2 + (c - x) ** 2, p, b, c) for _, r, _, _, p, b, c in rows if r == root)[:4]
        n, a, c, b = len(near), *(len(near) * sum(q[i] * q[j] for *_, q in [(0, (f[3], f[2])) for f in near]) - sum(f[3 - i] for f in near) * sum(f[3 - j] for f in near) for i, j in ((0, 0), (1, 1), (0, 1)))
        if small == 1024 or (a, b) != (c, 0):
            want = (np.degrees(0.5 * np.arctan2(2.0 * b, float(a - c))) + 90) % 180
            assert min(abs(normal - want), 180 - abs(normal - want)) < 1e-9
            checked += 1
    assert checked > 20 and (small < 1024 or got[99, 0][2] == 90.0)


def test_rays_and_edges_travel_packed(spark):
    """A row for many rays of a tile, and a contour's edges as bytes: a few for each, where they were 32 before."""
    mask = np.zeros((70, 90), bool)
    mask[5:60, 8:80] = True
    mask[12:20, 12:20] = False
    samples = spark.createDataFrame([(0, k, 6 + k % 50, 9 + k % 60, 3.0 * k) for k in range(300)], "segment_id int, id long, y int, x int, normal_deg double").coalesce(1)
    edges = aperture.contour_edges(contours.contours(pixels(spark, [mask])))
    plan = aperture.ray_hits(samples, edges)._jdf.queryExecution().executedPlan().toString()
    assert "array<double>" in plan or plan.count("MapInArrow") > 2
    assert "ay:double" not in aperture._PART
    ends = [np.arange(40) // 2, *(np.arange(40) + k for k in range(4))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(20, np.int32)), pa.array(np.arange(20))], ["segment_id", "contour_id"])
    made = next(aperture._dealt([batch], lambda b: ends))
    assert made.num_rows == 20 and made.column("points_").nbytes < 40 * 16 + 200
    rays = pa.RecordBatch.from_arrays([pa.array(np.zeros(300, np.int32)), *(pa.array(np.arange(300) // 150) for _ in range(2)), pa.array(np.arange(300)), *(pa.array(np.ones(300)) for _ in range(4)), pa.array(np.ones(300, bool))], ["segment_id", "cy", "cx", "id", *aperture._RAY])
    lists = next(aperture._together([rays]))
    assert lists.num_rows == 6 and lists.column("id").flatten().to_pylist() == list(range(300))


def coloured_strokes(rng, n, tall, wide, strokes=26):
    """Short strokes in rows, columns and diagonals of n images, in four classes, as (segment, y, x, class); classes may share pixels."""
    out = set()
    for s in range(n):
        for _ in range(strokes):
            y, x, (dy, dx) = int(rng.integers(0, tall)), int(rng.integers(0, wide)), [(0, 1), (1, 0), (1, 1), (1, -1)][rng.integers(0, 4)]
            kind = ["red", "green", "yellow", "mixed"][min(3, int(rng.integers(0, 8)) // 2)]
            out |= {(s, y + k * dy + w, x + k * dx, kind) for k in range(int(rng.integers(7, 16))) for w in range(int(rng.integers(1, 3))) if 0 <= y + k * dy + w < tall and 0 <= x + k * dx < wide}
    return sorted(out)


def test_growth_and_its_regions_across_bands_are_those_within_one(spark, monkeypatch):
    rows = coloured_strokes(np.random.default_rng(17), 24, 70, 64, 40)
    called = []
    for name in ("_across_bands", "_extensions_across"):
        monkeypatch.setattr(reconnect, name, lambda *a, name=name, f=getattr(reconnect, name): called.append(name) or f(*a))
    made = []
    for by in (40, raster.BAND - 33):
        shown = spark.createDataFrame([(s, y + by, x, kind) for s, y, x, kind in rows], "segment_id int, y int, x int, class string")
        one = raster.one_class(shown)
        mask = one.select("segment_id", "y", "x")
        ends = reconnect.path_ends(branches.branch_paths(raster.skeletonize(mask)), 4)
        wide = reconnect.local_widths(ends, mask, 9).withColumn("width", F.greatest("width", F.lit(2)))
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        found = {(r.segment_id, r.y - by, r.x): (r.ref_y - by, r.ref_x, r.dir_y, r.dir_x, r.width) for r in wide.collect()}
        assert found == {(r.segment_id, r.y - by, r.x): (r.ref_y - by, r.ref_x, r.dir_y, r.dir_x, r.width) for r in reconnect._widths_by_steps(ends, mask, 9).withColumn("width", F.greatest("width", F.lit(2))).collect()}
        counted = reconnect.growth_counts(wide, mask, 4, by + 110, 64)
        counts = {(r.segment_id, r.y - by, r.x): r.expand_count for r in counted.collect()}
        assert {r.endpoint_id for r in counted.collect()} <= {r.endpoint_id for r in ends.collect()}
        new = sorted((r.segment_id, r.y - by, r.x, r["class"]) for r in reconnect.extensions(one, reconnect.growth_pixels(counted, by + 110, 64)).collect())
        made.append((found, counts, new))
        assert len(called) == (0 if by == 40 else 2)
    assert made[0] == made[1]
    assert len(made[0][1]) > 20 and len(set(made[0][1].values())) > 2 and len(made[0][2]) > 50


@pytest.mark.parametrize("by", [0, 480])
def test_extensions_within_bands_are_those_of_joins(spark, by):
    rng = np.random.default_rng(23)
    rows = [(s, y + by, x, kind) for s, y, x, kind in coloured_strokes(rng, 5, 60, 60)]
    blobs = [(s, int(y) + a + by, int(x) + b) for s in range(6) for y, x in rng.integers(3, 55, (9, 2)) for a in range(-2, 3) for b in range(-3, 4)]
    shown = spark.createDataFrame(rows, "segment_id int, y int, x int, class string")
    growth = spark.createDataFrame(blobs, "segment_id int, y int, x int")
    got = reconnect.extensions(shown, growth).collect()
    want = reconnect._extensions_across(shown, growth.distinct()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r["class"] for r in want}) > 2 and len(want) > 100


def test_one_class_is_the_least_and_travels_packed(spark):
    rows = coloured_strokes(np.random.default_rng(29), 3, 50, 50)
    shown = spark.createDataFrame(rows * 2, "segment_id int, y int, x int, class string").withColumn("y", F.col("y") + 490)
    one = raster.one_class(shown)
    want = shown.groupBy("segment_id", "y", "x").agg(F.min("class").alias("class"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect()))
    assert raster.packed_bands(shown.coalesce(1), ["segment_id", "class"]).count() < len(rows) / 20


@pytest.mark.parametrize("rows", [5, 1 << 17])
def test_ends_of_branches_that_were_cut(spark, monkeypatch, rows):
    monkeypatch.setattr(groups, "ROWS", rows)
    shown = [(0, 7 * k, 1, 0, n, p, 7 * k, 1 + p, False) for k, n in enumerate([4, 5, 6, 9, 10, 30]) for p in range(n)]
    paths = spark.createDataFrame(shown, "segment_id int, root_y int, root_x int, branch_type int, n_px long, pos int, y int, x int, joint boolean").repartition(3)
    ends = reconnect.path_ends(paths, 4)
    assert "Join" not in ends._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.y, r.x, r.ref_y, r.ref_x, round(r.dir_y, 6), round(r.dir_x, 6)) for r in ends.collect())
    assert got == sorted((7 * k, *at, 0.0, d) for k, n in enumerate([4, 5, 6, 9, 10, 30]) if n > 4 for at, d in (((1, 7 * k, 5), -1.0), ((n, 7 * k, n - 4), 1.0)))
