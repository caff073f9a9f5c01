"""Contours, rays and nearest points against dense brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import aperture, contours, planes

from test_growth import labels_of


def pixels(spark, masks):
    return spark.createDataFrame([(s, int(y), int(x)) for s, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)], "segment_id int, y int, x int")


def regions(mask):
    """4-connected regions of the background of a padded mask, 1 being the outside."""
    image = np.pad(mask, 1)
    out, n = np.zeros(image.shape, int), 0
    for y, x in [(0, 0), *zip(*np.nonzero(~image), strict=True)]:
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                y0, x0 = todo.pop()
                for y1, x1 in ((y0 + 1, x0), (y0 - 1, x0), (y0, x0 + 1), (y0, x0 - 1)):
                    if 0 <= y1 < image.shape[0] and 0 <= x1 < image.shape[1] and not image[y1, x1] and not out[y1, x1]:
                        out[y1, x1] = n
                        todo.append((y1, x1))
    return out


def dense_borders(mask):
    """{(component's first pixel, hole?, region): set of border pixels}, and the region in which each component lies."""
    part, region = labels_of(mask), regions(mask)
    firsts, found = {}, {}
    for y, x in zip(*np.nonzero(mask), strict=True):
        firsts.setdefault(part[y, x], (int(y), int(x)))
    outside = {first: region[first[0], first[1] + 1] for first in firsts.values()}  # north of the first pixel
    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy, dx in ((-1, 0), (0, 1), (1, 0), (0, -1)):
            if r := region[y + 1 + dy, x + 1 + dx]:
                found.setdefault((firsts[part[y, x]], r), set()).add((int(y), int(x)))
    return found, outside


def nested():
    """Rings in rings, a component that touches itself over a corner, and lone pixels."""
    m = np.zeros((40, 44), bool)
    m[2:34, 2:36] = True
    m[5:31, 5:33] = False
    m[8:28, 8:20] = True
    m[11:25, 11:17] = False
    m[14:20, 12:16] = True
    m[9:14, 23:28] = True
    m[11, 25] = False
    m[20:24, 23:27] = True
    m[24:27, 27:30] = True
    m[36, 40] = m[38, 41] = True
    return m


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(7)
    return [nested(), rng.random((24, 24)) < 0.55, rng.random((20, 30)) < 0.4, np.ones((3, 3), bool)]


def test_contours_equal_dense_borders(spark, masks):
    got = contours.contours(pixels(spark, masks)).collect()
    for s, mask in enumerate(masks):
        expected, outside = dense_borders(mask)
        own = [r for r in got if r.segment_id == s]
        assert len(own) == len(expected)
        for r in own:
            path = [(p.y, p.x) for p in r.path]
            region = [k for (first, k), border in expected.items() if first == (r.root_y, r.root_x) and border == set(path) and (k == outside[first]) != r.hole]
            assert region, (s, path)
            assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, [*path[1:], path[0]])) or len(path) == 1
            area = abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(path, [*path[1:], path[0]]))) / 2
            assert r.area == area and (r.contour == 0) == (not r.hole)
            assert path[0] == min(path)


def test_hierarchy_of_nested_rings(spark, masks):
    found = contours.contours(pixels(spark, masks))
    rows = contours.hierarchy(found).collect()
    holes = {(r.segment_id, r.root_y, r.root_x, r.contour): {(p.y, p.x) for p in r.path} for r in found.collect()}
    for s, mask in enumerate(masks):
        expected, outside = dense_borders(mask)
        for r in (r for r in rows if r.segment_id == s):
            if r.hole:
                assert tuple(r.parent) == (r.root_y, r.root_x, 0)
                continue
            around = outside[(r.root_y, r.root_x)]
            if around == 1:
                assert r.parent is None
            else:
                p = (s, *r.parent)
                assert any(k == around and border == holes[p] and first == p[1:3] for (first, k), border in expected.items())
    depth = {(r.root_y, r.root_x, r.contour): r for r in rows if r.segment_id == 0}
    inner = depth[(14, 12, 0)]
    chain = []
    while inner.parent:
        inner = depth[tuple(inner.parent)]
        chain.append(inner.hole)
    assert chain == [True, False, True, False]


def brute_force_width(y, x, degrees, found, reach, least):
    """The rule for one sample over all edges of all contours."""
    dy, dx = (0.0 if abs(v) < 1e-15 else v for v in (math.sin(math.radians(degrees)), math.cos(math.radians(degrees))))
    ahead, behind = [], []
    for path, area in found:
        if area <= least or len(path) < 2:
            continue
        ts, lies = [], False
        for (ay, ax), (by, bx) in zip(path, [*path[1:], path[0]]):
            ey, ex = by - ay, bx - ax
            det = dx * ey - dy * ex
            off = (ax - x) * dy - (ay - y) * dx
            if abs(det) < 1e-9:
                at = [(qx - x) * dx + (qy - y) * dy for qy, qx in ((ay, ax), (by, bx))]
                lies |= abs(off) < 1e-9 and min(at) <= reach and max(at) >= -reach
                continue
            t, u = ((ax - x) * ey - (ay - y) * ex) / det, off / det
            if -1e-9 <= u <= 1 + 1e-9 and abs(t) <= reach:
                ts.append(round(t, 7))
        if lies or len(set(ts)) < 2:
            continue
        ahead += [t for t in ts if t > 1e-6]
        behind += [-t for t in ts if t < -1e-6]
    return min(ahead) + min(behind) if ahead and behind else None


@pytest.mark.parametrize(("reach", "least"), [(1000, 0.0), (1000, 20.0), (9, 0.0)])
def test_rays_equal_brute_force(spark, masks, reach, least):
    rng = np.random.default_rng(1)
    df = pixels(spark, masks)
    samples = []
    for s, mask in enumerate(masks):
        ys, xs = np.nonzero(mask)
        for k in rng.integers(0, len(ys), 40):
            samples.append((s, len(samples), int(ys[k]), int(xs[k]), float(rng.choice([0.0, 90.0, 45.0, 135.0, 107.799127, rng.random() * 180]))))
    got = {r.id: r.width_mm for r in aperture.ray_widths(spark.createDataFrame(samples, "segment_id int, id long, y int, x int, normal_deg double"), df, reach, 1.0, least).collect()}
    polygons = {}
    for r in contours.contours(df).collect():
        polygons.setdefault(r.segment_id, []).append(([(p.y, p.x) for p in r.path], r.area))
    expected = {i: w for s, i, y, x, a in samples if (w := brute_force_width(y, x, a, polygons[s], reach, least)) is not None}
    assert got == pytest.approx(expected, abs=1e-6)
    assert len(expected) > 10


def test_rays_reach_wide_bands_and_clip_corners(spark):
    wide = {(y, x) for y in range(301) for x in range(40)}
    df = spark.createDataFrame([(0, *p) for p in wide], "segment_id int, y int, x int")
    sample = spark.createDataFrame([(0, 1, 150, 20, 89.0)], "segment_id int, id long, y int, x int, normal_deg double")
    assert aperture.ray_widths(sample, df).first().width_mm == pytest.approx(300 / math.sin(math.radians(89)), abs=1e-6)
    corner = {(y, x) for y in range(59, 64) for x in range(6, 11)} | {(48, 48), (49, 49)}
    # the ray leaves a cell by its very corner
    rays = spark.createDataFrame([(0, k, float(y), float(x), d) for k, (y, x, d) in enumerate([(8, 8, 45.0), (0, 0, 45.0), (14, 59, 107.799127)])], "segment_id int, id long, y double, x double, normal_deg double")
    rays = rays.select("id", "y", "x", F.sin(F.radians("normal_deg")).alias("dy"), F.cos(F.radians("normal_deg")).alias("dx"))
    cells = {}
    for r in aperture.ray_cells(rays, 100).collect():
        cells.setdefault(r.id, set()).add((r.cy, r.cx))
    for r in rays.collect():
        for t in np.arange(-100, 100, 0.001):
            y, x = r.y + t * r.dy, r.x + t * r.dx
            edge = min(abs(y / 16 - round(y / 16)), abs(x / 16 - round(x / 16))) * 16
            assert edge < 1e-3 or (math.floor(y / 16), math.floor(x / 16)) in cells[r.id]
    assert len(corner) == 27


def test_a_lone_point_and_a_common_stretch_do_not_count(spark):
    block = {(y, x) for y in range(10, 15) for x in range(10, 15)}
    df = spark.createDataFrame([(0, *p) for p in block], "segment_id int, y int, x int")
    samples = spark.createDataFrame([(0, 0, 5, 9, 135.0), (0, 1, 10, 12, 0.0), (0, 2, 12, 12, 0.0)], "segment_id int, id long, y int, x int, normal_deg double")
    hits = aperture.ray_hits(samples, aperture.contour_edges(contours.contours(df)), 1000).collect()
    assert [(r.id, r.hits) for r in hits] == [(2, [-2.0, 2.0])]


def brute_force_nearest(points, k):
    out = set()
    for i, *p in points:
        far = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, *q in points)
        out |= {(i, j, n) for n, (_, j) in enumerate(far[:k], 1)}
    return out


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    spread = [(k, *map(float, rng.normal(size=2))) for k in range(150)]
    crowd = [(k, *map(float, rng.normal(size=2) * 1e-5 + 3)) for k in range(200)] + [(200 + k, *map(float, rng.normal(size=2) * 50)) for k in range(12)]
    copies = [(k, 1.0, float(k // 40)) for k in range(120)]
    few = [(0, 1.0, 1.0), (1, 5.0, 5.0)]
    groups = {"spread": spread, "crowd": crowd, "copies": copies, "few": few, "line": [(k, 0.0, float(k)) for k in range(90)]}
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps] + [("few", 9, None, 1.0)], "g string, id long, x double, y double")
    got = {}
    for r in planes.nearest(df, "g", "id", ["x", "y"], 4).collect():
        got.setdefault(r.g, set()).add((r.id, r.neighbour, r["rank"]))
    assert got == {g: brute_force_nearest(ps, 4) for g, ps in groups.items()}
    some = planes.nearest(df, "g", "id", ["x", "y"], 4, df.where("id % 10 = 0 and g = 'spread'")).collect()
    assert {(r.id, r.neighbour, r["rank"]) for r in some} == {x for x in got["spread"] if x[0] % 10 == 0}
    assert planes.nearest(df.where("false"), "g", "id", ["x", "y"]).count() == 0
