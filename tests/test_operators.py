"""Operators against brute force, literal fixtures and invariants."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.functions.geometry import normal_of, orientation_of
from strataspark.operators import evaluation, planes, raster, tables
from strataspark.sources import png, xlsx


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        m = rng.random((rng.integers(1, 6), rng.integers(1, 6))) - 0.2
        n = max(m.shape)
        square = np.zeros((n, n))
        square[: m.shape[0], : m.shape[1]] = m
        best = max(sum(square[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert evaluation.best_assignment(m) == pytest.approx(best, abs=1e-12)


@pytest.mark.parametrize(
    ("pred", "ref", "length", "expected"),
    [
        ([[1, 0, 0], [2, 125, 45]], [[1, 0, 0], [2, 125, 45]], 10.0, (1, 1, 1)),
        ([], [[1, 0, 20]], 10.0, (0, 0, 0)),
        ([[1, 10, 30], [4, 200, 60]], [[1.5, 15, 35], [3, 190, 50], [9, 0, 0]], 10.0, (0.616666666667, 0.656610795598, 0.607534772411)),
    ],
)
def test_quality_indices(spark, pred, ref, length, expected):
    schema = "hole int, id int, depth double, azimuth double, dip double"
    make = lambda rows: spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], schema)
    counts = spark.createDataFrame([(1, len(pred), len(ref))], "hole int, n_pred long, n_ref long")
    got = evaluation.quality_indices(evaluation.score_matrix(make(pred), make(ref), "hole", length), counts, "hole").first()
    assert (got.qpi, got.qai, got.cei) == pytest.approx(expected, abs=1e-9)


def test_north_dipping_normal(spark):
    assert spark.range(1).select(*normal_of(F.lit(0.0), F.lit(90.0))).first() == pytest.approx((0, 1, 0), abs=1e-12)


def test_orientation_round_trip(spark):
    df = spark.createDataFrame([(float(a), float(d)) for a in range(5, 360, 17) for d in range(5, 90, 9)], "a double, d double")
    x, y, z = normal_of(F.col("a"), F.col("d"))
    az, dip = orientation_of(F.col("x"), F.col("y"), F.col("z"))
    for r in df.select("a", "d", x.alias("x"), y.alias("y"), z.alias("z")).select("a", "d", az.alias("az"), dip.alias("dip")).collect():
        assert (r.az, r.dip) == pytest.approx((r.a, r.d), abs=1e-5)


@pytest.mark.parametrize(("azimuth", "dip", "center"), [(120, 45, 1000), (359.5, 60, 2000), (180, 10, 100), (0, 30, 500)])
def test_analytic_plane_is_recovered(spark, azimuth, dip, center):
    theta = [2 * math.pi * k / 952 for k in range(952)]
    z = [center + 38 * math.tan(math.radians(dip)) * math.cos(t - math.radians(azimuth)) for t in theta]
    points = spark.createDataFrame([(1, 38 * math.cos(t), 38 * math.sin(t), v) for t, v in zip(theta, z, strict=True)], "g int, x double, y double, z double")
    fit = planes.axis_crossings(planes.fit_planes(points, ["g"], F.col("x"), F.col("y"), F.col("z")), F.lit(38.0), F.lit(3000.0))
    # z points down, theta 0 is north: turn into (east, north, up)
    az, d = orientation_of(F.col("n_y"), F.col("n_x"), -F.col("n_z"))
    r = fit.select(az.alias("a"), d.alias("d"), "center").first()
    assert r.center == pytest.approx(center, abs=1e-6)
    assert r.d == pytest.approx(dip, abs=1e-4) or 90 - abs(r.d - 0) == pytest.approx(90 - dip, abs=1e-4)


def test_small_component_goes_and_line_stays(spark):
    blob = [(1, y, x) for y in (2, 3) for x in (2, 3)]
    line = [(1, y, 10) for y in range(2, 26)]
    df = spark.createDataFrame(blob + line, "segment_id int, y int, x int")
    kept = {(r.y, r.x) for r in raster.eliminate(df, area=10).collect()}
    assert kept == {(y, 10) for y in range(2, 26)}


def thin_by_numpy(image):
    """Two-step thinning over a dense array, pixel by pixel."""
    image = np.pad(image.astype(int), 1)
    while True:
        before = image.sum()
        for step in (0, 1):
            gone = []
            for y, x in zip(*np.nonzero(image), strict=True):
                p = [image[y + dy, x + dx] for dy, dx in raster.RING]
                turns = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
                n, e, s, w = p[0], p[2], p[4], p[6]
                sides = n * e * s == 0 and e * s * w == 0 if step == 0 else n * e * w == 0 and n * s * w == 0
                if 2 <= sum(p) <= 6 and turns == 1 and sides:
                    gone.append((y, x))
            for at in gone:
                image[at] = 0
        if image.sum() == before:
            return image[1:-1, 1:-1]


def test_skeleton_equals_dense_thinning(spark):
    rng = np.random.default_rng(3)
    images = [rng.random((14, 14)) < 0.6 for _ in range(2)]
    images.append(np.zeros((14, 14), bool))
    images[2][4:8, 2:12] = True
    df = spark.createDataFrame([(k, int(y), int(x)) for k, i in enumerate(images) for y, x in zip(*np.nonzero(i), strict=True)], "segment_id int, y int, x int")
    got = {tuple(r) for r in raster.skeletonize(df).select("segment_id", "y", "x").collect()}
    assert got == {(k, int(y), int(x)) for k, i in enumerate(images) for y, x in zip(*np.nonzero(thin_by_numpy(i)), strict=True)}


def test_spurs_are_pruned_and_junctions_stay(spark):
    stem = [(1, 10, x) for x in range(30)]
    spur = [(1, y, 15) for y in (7, 8, 9)]
    df = spark.createDataFrame(stem + spur, "segment_id int, y int, x int")
    left = {(r.y, r.x) for r in raster.prune_spurs(df, 5).collect()}
    assert (7, 15) not in left and (10, 15) in left and (10, 0) in left and (10, 29) in left


def test_running_offset_over_many_blocks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    got = {r.id: r.row_offset for r in tables.running_offset(df, "id", "n", block=16).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for shape in ((5, 7, 3), (9, 4)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(image)) == image).all()
    (tmp_path / "a.png").write_bytes(png.encode(image))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = png.pixels(png.scan(spark, f"file://{tmp_path}")).orderBy("path", "band").collect()
    assert [r.error is None for r in rows] == [True, False]
    assert np.frombuffer(rows[0].data, np.uint8).tolist() == image.ravel().tolist()


def test_xlsx_round_trip(spark, tmp_path):
    book = xlsx.workbook({"a" * 40: pd.DataFrame({"depth": [1.0], "value": [float("nan")]}), "b": pd.DataFrame({"x": ["<&>", "é"]})})
    (tmp_path / "t.xlsx").write_bytes(book)
    rows = {(r.sheet, r.row): r.cells for r in xlsx.scan(spark, f"file://{tmp_path}").collect()}
    assert rows["a" * 31, 1] == ["depth", "value"]
    assert rows["a" * 31, 2] == ["1.0"]
    assert rows["b", 2] == ["<&>"] and rows["b", 3] == ["é"]
    with pytest.raises(ValueError):
        xlsx.workbook({})


def test_area_resize_keeps_rows_and_means(spark):
    df = spark.createDataFrame([(0, 2, 4, bytes([0, 10, 20, 30, 4, 4, 8, 8]))], "frame_idx long, height int, width int, data binary")
    assert list(png.resized_rows(df, 2).first().data) == [5, 25, 4, 8]


def test_page_queries_use_whole_texts(spark, tmp_path):
    import hashlib

    from strataspark.plans import carriers

    head = "the same sixty-four characters begin each of these documents ok "
    texts = [head, head + "one end", head + "two ends", head * 700 + "a long tail", "é ü 😀" * 30, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    small = {r.frame_idx: bytes.fromhex(r.data) for r in carriers.QUERIES["resize_area"](spark, str(tmp_path)).collect()}
    classes = {r.doc_id: r.classes for r in carriers.QUERIES["tile_predict"](spark, str(tmp_path)).collect()}
    assert len(small) == len(classes) == len(texts)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        page = np.frombuffer(data + b" " * (-len(data) % 64 if data else 64), np.uint8).reshape(-1, 64)
        assert small[i] == np.rint(page.reshape(len(page), 16, 4).mean(2)).astype(np.uint8).tobytes()
        assert classes[i] == hashlib.sha256((page // 64).tobytes()).hexdigest()
    assert len(set(classes.values())) == len(texts) - 1


def test_mixed_joins_repaint_their_regions(spark):
    from strataspark.operators import reconnect

    bars = {"a": ("red", range(0, 10)), "b": ("green", range(12, 16)), "c": ("red", range(18, 19)), "d": ("green", range(30, 34)), "e": ("green", range(36, 40))}
    coloured = {(1, 0, x): c for c, xs in bars.values() for x in xs}
    growth = {(1, 0, x) for x in (*range(9, 13), *range(15, 19), *range(33, 37))}
    new, repaint = {}, {}
    for xs, parts in ((range(9, 13), "ab"), (range(15, 19), "bc"), (range(33, 37), "de")):
        areas = {k: sum(len(bars[p][1]) for p in parts if bars[p][0] == k) for k in ("red", "green")}
        share = areas["red"] / (areas["red"] + areas["green"])
        to = "red" if share > 0.7 else "green" if share < 0.3 else "mixed"
        new |= {(1, 0, x): to for x in xs if (1, 0, x) not in coloured}
        if 0 < share < 1:
            repaint |= {(1, 0, x): to for p in parts for x in bars[p][1]}
    got = reconnect.extensions(
        spark.createDataFrame([(*k, c) for k, c in coloured.items()], "segment_id int, y int, x int, class string"),
        spark.createDataFrame(sorted(growth), "segment_id int, y int, x int"),
    ).collect()
    assert len(got) == len(new | repaint)
    assert {(r.segment_id, r.y, r.x): r["class"] for r in got} == new | repaint
    assert repaint[1, 0, 13] == "green" and repaint[1, 0, 3] == "red"
