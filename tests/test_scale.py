"""Steps whose work must grow no faster than their input: no copies sent whole, few rows shuffled, many groups at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.functions import groups
from strataspark.operators import aperture, branches, contours, mosaic, planes, raster
from strataspark.sources import png

from test_contours import brute_force_nearest, pixels


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rays_are_neither_broadcast_nor_followed_beyond_the_edges(spark):
    found = contours.contours(pixels(spark, [np.ones((3, 3), bool)] * 3))
    samples = spark.createDataFrame([(k, k, 1, 1, 90.0 * k + 10) for k in range(3)], "segment_id int, id long, y int, x int, normal_deg double")
    hits = aperture.ray_hits(samples, aperture.contour_edges(found), 1000)
    assert hits.count() == 3
    assert "Broadcast" not in plan_of(hits)
    rays = samples.select("segment_id", "id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.sin(F.radians("normal_deg")).alias("dy"), F.cos(F.radians("normal_deg")).alias("dx"))
    bounds = spark.createDataFrame([(k, 0, 2, 0, 2) for k in range(2)], "segment_id int, y0 int, y1 int, x0 int, x1 int")
    inside = aperture.ray_cells(aperture.within_bounds(rays, bounds, 1000), 1000)
    assert inside.groupBy("segment_id").count().count() == 2
    assert inside.where("cy not between -1 and 0 or cx not between -1 and 0").count() == 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_groups_stay_whole_across_batches(monkeypatch, rows):
    monkeypatch.setattr(groups, "ROWS", rows)
    sizes = [1, 3, 2, 40, 1, 1, 9]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    table = pa.table({"a": pa.array([None if k == 0 else str(k) for k in keys]), "b": keys, "v": np.arange(len(keys))})
    got = list(groups.whole_groups(table.to_batches(max_chunksize=5), ["a", "b"]))
    assert pa.concat_tables([t for t, _ in got]).equals(table)
    for t, starts in got:
        b = t["b"].to_numpy()
        assert len(starts) == len(set(b.tolist())) and [int(v) for v in b[starts]] == sorted(set(b.tolist()))
    assert sum(len(starts) for _, starts in got) == len(sizes)


@pytest.fixture(scope="module")
def tall():
    """Masks that cross the border of two bands, and one that doesn't."""
    rng = np.random.default_rng(3)
    out = [rng.random((48, 30)) < 0.5, rng.random((40, 24)) < 0.6, np.zeros((40, 20), bool)]
    out[2][2:38, 4:16] = True
    out[2][6:34, 7:13] = False
    return out


def moved(spark, masks, by):
    return pixels(spark, masks).withColumn("y", F.col("y") + by)


def collected(df, by):
    return sorted(tuple(tuple(sorted((p.y - by, p.x) for p in v)) if isinstance(v, list) else v for v in r) for r in df.collect())


def test_branches_are_the_same_wherever_bands_end(spark, tall):
    made = []
    for by in (0, raster.BAND - 20):
        df = moved(spark, tall, by)
        paths = branches.branch_paths(raster.skeletonize(df))
        made.append(sorted((r.segment_id, r.root_y - by, r.root_x, r.branch_type, r.n_px, r.pos, r.y - by, r.x, r.joint) for r in paths.collect()))
    assert made[0] == made[1] and made[0]


def test_nodes_and_paths_are_dealt_once_a_pixel(spark, tall):
    skeleton = raster.skeletonize(pixels(spark, tall))
    n = skeleton.count()
    coded = raster.in_bands(skeleton, ["segment_id"], 1, lambda p, own: {"of": np.arange(p.n), "y": p.y}, "y int")
    assert coded.count() <= 1.2 * n
    assert raster.ring_code(skeleton, ["segment_id"]).count() == n
    # no aggregate over nine rows a pixel
    assert "Aggregate" not in plan_of(raster.ring_code(skeleton, ["segment_id"]))


def test_contours_are_the_same_wherever_bands_end(spark, tall):
    made = []
    for by in (0, raster.BAND - 20):
        found = contours.contours(moved(spark, tall, by))
        made.append(collected(found.withColumn("root_y", F.col("root_y") - by), by))
    assert made[0] == made[1] and made[0]


def test_small_components_are_followed_together(spark):
    """No group, and no aggregate that puts an outline together, for each component."""
    plan = plan_of(raster.in_bands(pixels(spark, [np.ones((2, 2), bool)]), ["segment_id"], 1, lambda p, own: {"of": np.arange(p.n), "y": p.y}, "y int"))
    assert "FlatMapGroups" not in plan and "Aggregate" not in plan
    p = raster.Pixels(np.repeat(np.arange(3000), 4), np.tile([0, 0, 1, 1], 3000), np.tile([0, 1, 0, 1], 3000))
    got = contours.borders(p, np.repeat(np.arange(0, 12000, 4), 4), p.ring())
    assert len(got["of"]) == 3000 and set(got["area"].tolist()) == {1.0}
    assert got["path"][2999].as_py() == [{"y": 0, "x": 0}, {"y": 0, "x": 1}, {"y": 1, "x": 1}, {"y": 1, "x": 0}]


def test_pruning_is_the_same_wherever_bands_end(spark, tall):
    made = []
    for by in (0, raster.BAND - 20):
        kept = raster.prune_spurs(raster.skeletonize(moved(spark, tall, by)), 4).collect()
        made.append(sorted((r.segment_id, r.y - by, r.x) for r in kept))
    assert made[0] == made[1] and made[0]


def test_painting_does_not_keep_planes_apart(spark):
    rows = [(0, k, k, y, x) for k in range(200) for y, x in ((5, 5), (k % 3 + 20, 7))]
    points = spark.createDataFrame(rows, "segment_id int, plane int, paint int, row int, column int")
    done = mosaic.painted(points, ["segment_id"], "plane", "paint", 64, 64)
    # many planes at one place are one row before they become pixels
    assert "rows_" not in plan_of(done) and "collect_set" not in plan_of(done)
    got = {(r.y, r.x): r.paint for r in done.collect()}
    expected = {}
    for _, plane, _, row, column in rows:
        for y in range(max(0, row - 3), min(64, row + 27)):
            for x in range(max(0, column - 3), min(64, column + 27)):
                expected[y, x] = max(plane, expected.get((y, x), -1))
    assert got == expected


def test_masks_meet_without_a_table_of_their_pixels(spark):
    a = pixels(spark, [np.eye(5, dtype=bool)] * 2)
    b = a.withColumn("x", F.lit(2))
    both = raster.masks_together(a.union(a), b.union(b))
    assert "HashAggregate" not in plan_of(both) and plan_of(both).count("Exchange hashpartitioning") == 1
    assert sorted(both.where("segment_id = 1").drop("segment_id").collect()) == sorted([(k, k, True, k == 2) for k in range(5)] + [(k, 2, False, True) for k in range(5) if k != 2])


def test_pixels_of_an_image_are_dealt_once(spark):
    rows = [(k, y, y % 3, c, 9 - c, 5) for k in range(3) for y in range(4) for c in (1, 7, 4)]
    made = png.render(spark.createDataFrame(rows, "segment_id int, y int, x int, r int, g int, b int"), 4, 3)
    assert plan_of(made).count("Exchange hashpartitioning") == 1
    got = sorted(tuple(r) for r in png.foreground(made).collect())
    assert got == [(k, y, y % 3, 7, 2, 5) for k in range(3) for y in range(4)]


def test_few_candidates_of_a_cluster_are_decomposed(monkeypatch):
    rng = np.random.default_rng(5)
    left = [(k, "filled", rng.uniform(0, 250) + np.arange(n) * rng.uniform(-1, 1), (rng.uniform(0, 250) + np.arange(n)) % 256) for k, n in enumerate(rng.integers(8, 30, 200))]
    seen, spread = [0, 0], branches._least_spread
    screen = branches._may_spread_less

    def counted(moments):
        seen[0] += len(moments)
        return spread(moments)

    def all_of(moments, bound):
        seen[1] += len(moments)
        return screen(moments, bound)

    monkeypatch.setattr(branches, "_least_spread", counted)
    monkeypatch.setattr(branches, "_may_spread_less", all_of)
    got = branches.greedy_clusters(left, 64, 1.7, 1.5)
    assert seen[0] < seen[1] / 5
    monkeypatch.setattr(branches, "_may_spread_less", lambda moments, bound: np.arange(len(moments)))
    assert got == branches.greedy_clusters(left, 64, 1.7, 1.5)


@pytest.mark.parametrize("small", [0, 20, 1024])
def test_nearest_points_of_small_and_large_groups(spark, monkeypatch, small):
    monkeypatch.setattr(planes, "SMALL", small)
    rng = np.random.default_rng(8)
    sizes = {1: 40, 2: 3, 3: 1, 4: 20}
    rows = [(g, k, float(rng.integers(0, 9)), float(rng.integers(0, 9))) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double")
    found = planes.nearest(df, "g", "id", ["x", "y"], 4)
    if small == 1024:
        assert plan_of(found).count("Exchange hashpartitioning") == 1
    got = {}
    for r in found.collect():
        got.setdefault(r.g, set()).add((r.id, r.neighbour, r["rank"]))
    assert got == {g: brute_force_nearest([r[1:] for r in rows if r[0] == g], 4) for g in sizes}


def test_rays_and_edges_meet_in_tiles(spark):
    """Rays are not paired with edges by a join, and widths are the same within a tile and across the border of four."""
    half = aperture.TILE // 2
    mask = np.zeros((40, 60), bool)
    mask[5:35, 8:30] = True
    mask[12:20, 12:20] = False
    mask[10:30, 40:50] = True
    samples = [(k, 3 + 4 * k % 34, 4 + 7 * k % 50, 11.0 * k + 0.5) for k in range(40)]
    made = []
    for by in (0, half - 16):
        df = pixels(spark, [mask]).select("segment_id", (F.col("y") + by).alias("y"), (F.col("x") + by).alias("x"))
        points = spark.createDataFrame([(0, k, y + by, x + by, d) for k, y, x, d in samples], "segment_id int, id long, y int, x int, normal_deg double")
        made.append({r.id: round(r.width_mm, 5) for r in aperture.ray_widths(points, df).collect()})
        plan = plan_of(aperture.ray_hits(points, aperture.contour_edges(contours.contours(df)), 1000))
        assert plan.count("SortMergeJoin") == 1
    assert made[0] == made[1] and len(made[0]) > 5


def test_pixels_travel_packed_and_once(spark, tall):
    """A row for an image and band of a portion, no copies, and the same pixels when they are opened."""
    whole = pixels(spark, [np.ones((60, 50), bool), *tall]).coalesce(1)
    twice = whole.unionByName(whole).coalesce(1)
    schema = pa.schema([("segment_id", pa.int64()), ("band_", pa.int32()), ("y", pa.list_(pa.int32())), ("x", pa.list_(pa.int32()))])
    batches = twice.select(F.col("segment_id").cast("long").alias("segment_id"), "y", "x").toArrow().combine_chunks().to_batches()
    packed = list(raster._packed(batches, ["segment_id"], 0, schema))
    n = whole.count()
    assert sum(b.num_rows for b in packed) <= n / raster.PACK + 5
    opened = [r for b in raster._unpacked(packed) for r in zip(*(b.column(c).to_pylist() for c in ("segment_id", "y", "x")), strict=True)]
    assert len(opened) == n and set(opened) == {tuple(r) for r in whole.select("segment_id", "y", "x").collect()}
    plan = plan_of(raster.in_bands(whole, ["segment_id"], 64, lambda p, own: {"of": np.arange(p.n), "y": p.y}, "y int"))
    assert "array<int>" in plan or plan.count("MapInArrow") == 2
    assert "Generate" not in plan


def test_scattered_pixels_and_their_halo_take_few_rows():
    """Thinning's wide halo does not send a row for each pixel and band: images of fewer rows than the halo would all go twice."""
    rng = np.random.default_rng(4)
    table = pa.table({"segment_id": rng.integers(0, 20, 40000), "y": rng.integers(0, 64, 40000).astype(np.int32), "x": rng.integers(0, 64, 40000).astype(np.int32)})
    schema = pa.schema([("segment_id", pa.int64()), ("band_", pa.int32()), ("y", pa.list_(pa.int32())), ("x", pa.list_(pa.int32()))])
    rows = sum(b.num_rows for b in raster._packed(table.to_batches(), ["segment_id"], raster.HALO, schema))
    assert rows <= 20 * 2 * 2


def scattered(n, images, ty=pa.int32()):
    rng = np.random.default_rng(4)
    return pa.table({"segment_id": rng.integers(0, images, n), "y": pa.array(rng.integers(0, 64, n), ty), "x": pa.array(rng.integers(0, 64, n), ty)})


def packed_schema(ty=pa.int32()):
    return pa.schema([("segment_id", pa.int64()), ("band_", pa.int32()), ("y", pa.list_(ty)), ("x", pa.list_(ty))])


def test_small_images_send_no_halo_to_a_band_without_pixels():
    packed = list(raster._packed(scattered(40000, 20).to_batches(), ["segment_id"], raster.HALO, packed_schema()))
    assert {v for b in packed for v in b.column("band_").to_pylist()} == {0}
    assert sum(b.column("y").value_lengths().to_numpy().sum() for b in packed) == len(set(zip(*scattered(40000, 20).to_pydict().values(), strict=True)))


def test_more_images_do_not_take_more_bytes_a_pixel():
    """Ten times the input has ten times the images, so a task's rows hold fewer pixels of each."""
    took = []
    for k in (1, 10):
        n = 50000 * k
        packed = list(raster._packed(scattered(n, 400 * k).to_batches(max_chunksize=10000), ["segment_id"], raster.HALO, packed_schema()))
        assert sum(b.num_rows for b in packed) <= 400 * k
        took.append(sum(b.nbytes for b in raster._encoded(packed)) / n)
    assert took[1] < 1.05 * took[0] and took[0] < 3


@pytest.mark.parametrize("ty", [pa.int32(), pa.int64()])
def test_steps_come_back_from_their_bytes(ty):
    table = scattered(5000, 40, ty)
    far = pa.table({"segment_id": [1, 1, 2, 2], "y": pa.array([-2000000, -1, 0, 70000], ty), "x": pa.array([2**31 - 1, -(2**30), 0, 2**30], ty)})
    packed = list(raster._packed(pa.concat_tables([table, far]).to_batches(), ["segment_id"], raster.HALO, packed_schema(ty)))
    coded = [b.slice(k, n) for b in raster._encoded(packed) for k, n in ((0, 3), (3, 0), (3, None))]
    assert pa.Table.from_batches(raster._decoded(coded, packed_schema(ty))).equals(pa.Table.from_batches(packed))


def test_rows_above_an_image_are_in_its_first_band(spark, tall):
    """Masks that cross row 0, or the border of the band above, are thinned and pruned as anywhere else."""
    made = []
    for by in (0, -20, -raster.BAND - 20):
        kept = raster.prune_spurs(raster.skeletonize(moved(spark, tall, by)), 4).collect()
        made.append(sorted((r.segment_id, r.y - by, r.x) for r in kept))
    assert made[0] == made[1] == made[2] and made[0]


def test_rows_of_many_portions_are_put_together(monkeypatch):
    """Images of which a portion has few pixels take a row for many portions; large ones keep rows of about PACK pixels, in any case the same pixels."""
    monkeypatch.setattr(raster, "PORTION", 2000)
    for images, most in ((1000, 1000), (3, 3 * 7)):
        packed = list(raster._packed(scattered(20000, images).to_batches(max_chunksize=500), ["segment_id"], raster.HALO, packed_schema()))
        joined = list(raster._joined(raster._encoded(packed), ["segment_id"]))
        assert sum(b.num_rows for b in joined) <= most < sum(b.num_rows for b in packed)
        assert max(int(b.column("steps_").nbytes / b.num_rows) for b in joined) <= 4 * 2 * raster.PACK
        got, want = (sorted(zip(*pa.Table.from_batches(raster._unpacked(v)).to_pydict().values(), strict=True)) for v in (raster._decoded(joined, packed_schema()), packed))
        assert got == want
