"""Growth of trace ends and ordering of branches against dense brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import branches, raster, reconnect

H, W, STEPS = 48, 64, 4


def labels_of(mask):
    """8-connected components by flooding."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                y0, x0 = todo.pop()
                for y1 in range(max(0, y0 - 1), min(mask.shape[0], y0 + 2)):
                    for x1 in range(max(0, x0 - 1), min(mask.shape[1], x0 + 2)):
                        if mask[y1, x1] and not out[y1, x1]:
                            out[y1, x1] = n
                            todo.append((y1, x1))
    return out


def thin(mask):
    """Two-step thinning pixel by pixel, over the whole image."""
    image = np.pad(mask, 1).astype(int)
    while True:
        gone = 0
        for step in (0, 1):
            out = []
            for y, x in zip(*np.nonzero(image), strict=True):
                p = [image[y - 1, x], image[y - 1, x + 1], image[y, x + 1], image[y + 1, x + 1], image[y + 1, x], image[y + 1, x - 1], image[y, x - 1], image[y - 1, x - 1]]
                a = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
                open_ = p[0] * p[2] * p[4] == 0 and p[2] * p[4] * p[6] == 0 if step == 0 else p[0] * p[2] * p[6] == 0 and p[0] * p[4] * p[6] == 0
                if 2 <= sum(p) <= 6 and a == 1 and open_:
                    out.append((y, x))
            for y, x in out:
                image[y, x] = 0
            gone += len(out)
        if not gone:
            return image[1:-1, 1:-1] > 0


def disc(end, k):
    """Pixels of disc k of an end, or None where its centre is off the image."""
    r = int(round(end["width"] / 2))
    cy, cx = (int(round(end[c] + k * end[f"dir_{c}"] * end["width"] / 2)) for c in "yx")
    if not (0 <= cy < H and 0 <= cx < W):
        return None
    y, x = np.mgrid[:H, :W]
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


def brute_force_growth(mask, ends):
    """(endpoint_id, count) of the ends that can meet something."""
    part = labels_of(mask)
    own = {e["endpoint_id"]: part[e["y"], e["x"]] for e in ends}
    ahead = {e["endpoint_id"]: np.any([d for k in range(1, STEPS + 1) if (d := disc(e, k)) is not None] or [np.zeros((H, W), bool)], axis=0) for e in ends}
    kept = []
    for e in ends:
        i = e["endpoint_id"]
        other = (part > 0) & (part != own[i])
        for o in ends:
            if own[o["endpoint_id"]] != own[i]:
                other |= ahead[o["endpoint_id"]]
        if (ahead[i] & other).any():
            kept.append(e)
    out = {}
    for e in kept:
        i = e["endpoint_id"]
        others = (part > 0) & (part != own[i])
        rest = others.copy()
        for o in kept:
            if o["endpoint_id"] != i:
                rest |= ahead[o["endpoint_id"]]
        skeleton, union, count = thin(rest), np.zeros((H, W), bool), 0
        for k in range(STEPS + 1):
            d = disc(e, k)
            if d is None:
                break
            union |= d
            if (thin(union) & skeleton).any():
                break
            count += 1
        if count == STEPS + 1:
            count, union = 0, np.zeros((H, W), bool)
            for k in range(STEPS + 1):
                d = disc(e, k)
                if d is None:
                    break
                union |= d
                if (union & others).any():
                    count = k
                    break
        out[i] = count
    return out


def scenes():
    """Random strokes with ends of random directions and widths."""
    out = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        mask = np.zeros((H, W), bool)
        for _ in range(7):
            y, x, n, t = rng.integers(4, H - 4), rng.integers(4, W - 4), rng.integers(3, 16), rng.integers(1, 4)
            (mask[y : y + t, x : x + n] if rng.random() < 0.6 else mask[y : y + n, x : x + t]).fill(True)
        ys, xs = np.nonzero(mask)
        ends = []
        for k in rng.permutation(len(ys))[:9]:
            angle = rng.random() * 2 * np.pi
            ends.append({"endpoint_id": len(ends), "y": int(ys[k]), "x": int(xs[k]), "dir_y": float(np.sin(angle)), "dir_x": float(np.cos(angle)), "width": int(rng.integers(0, 9))})
        out.append((mask, ends))
    return out


def test_growth_equals_dense_brute_force(spark):
    drawn = scenes()
    mask = spark.createDataFrame([(s, int(y), int(x)) for s, (m, _) in enumerate(drawn) for y, x in zip(*np.nonzero(m), strict=True)], "segment_id int, y int, x int")
    ends = spark.createDataFrame([(s, 100 * s + e["endpoint_id"], *(e[c] for c in ("y", "x", "dir_y", "dir_x", "width"))) for s, (_, es) in enumerate(drawn) for e in es], "segment_id int, endpoint_id long, y int, x int, dir_y double, dir_x double, width int")
    counted = reconnect.growth_counts(ends, mask, STEPS, H, W)
    got = {r["endpoint_id"]: r["expand_count"] for r in counted.collect()}
    expected = {100 * s + i: n for s, (m, es) in enumerate(drawn) for i, n in brute_force_growth(m, es).items()}
    assert got == expected
    assert len(set(expected.values())) >= 4 and len(expected) < sum(len(es) for _, es in drawn)
    painted = {(r["endpoint_id"], r["y"], r["x"]) for r in reconnect.growth_pixels(counted, H, W).collect()}
    dense = {(100 * s + e["endpoint_id"], int(y), int(x)) for s, (_, es) in enumerate(drawn) for e in es if 100 * s + e["endpoint_id"] in got for k in range(got[100 * s + e["endpoint_id"]] + 1) if (d := disc(e, k)) is not None for y, x in zip(*np.nonzero(d), strict=True)}
    assert painted == dense


def test_a_broken_band_is_reconnected(spark):
    band = {(y, x) for y in range(20, 25) for x in [*range(5, 40), *range(52, 90)]}
    far = {(y, x) for y in range(60, 63) for x in range(5, 40)}
    coloured = spark.createDataFrame([(1, y, x, "red") for y, x in band] + [(1, y, x, "green") for y, x in far], "segment_id int, y int, x int, class string")
    whole, ends = reconnect.reconnect(coloured, 96, 128, 10, 5)
    rows = whole.collect()
    assert len({(r.y, r.x) for r in rows}) == len(rows)
    filled = {(r.y, r.x) for r in rows if r["class"] == "red"}
    assert all((22, x) in filled for x in range(5, 90)) and band <= filled
    assert {(r.y, r.x) for r in rows if r["class"] == "green"} == far
    assert {(r.y, r.x) for r in ends.collect()} <= {(y, x) for y in (21, 22, 23) for x in range(30, 60)}


def test_without_ends_nothing_changes(spark):
    dot = spark.createDataFrame([(1, 3, 3, "red"), (1, 3, 4, "red")], "segment_id int, y int, x int, class string")
    whole, ends = reconnect.reconnect(dot, 10, 10)
    assert sorted(map(tuple, whole.collect())) == [(1, 3, 3, "red"), (1, 3, 4, "red")] and ends.count() == 0
    whole, ends = reconnect.reconnect(dot.where("false"), 10, 10)
    assert whole.count() == 0 and ends.count() == 0


# --- branches


def walk(pixels, joints, lines):
    """A plain walk of the graph without junctions, from either end."""
    left = set(pixels)
    near = lambda p: [q for q in left if q != p and max(abs(q[0] - p[0]), abs(q[1] - p[1])) == 1]
    start = min(left, key=lambda p: (len(near(p)) > 1, p))
    path = [start]
    left.discard(start)
    while found := near(path[-1]):
        straight = [q for q in found if abs(q[0] - path[-1][0]) + abs(q[1] - path[-1][1]) == 1]
        path.append(min(straight or found))
        left.discard(path[-1])
    return path


@pytest.mark.parametrize("seed", range(3))
def test_paths_run_from_node_to_node(spark, seed):
    rng = np.random.default_rng(seed)
    mask = np.zeros((60, 60), bool)
    for _ in range(9):
        y, x, n = rng.integers(2, 40), rng.integers(2, 40), rng.integers(8, 20)
        kind = rng.integers(0, 3)
        for k in range(n):
            mask[y + (k if kind else 0), x + (k if kind != 1 else 0)] = True
    skeleton = thin(mask)
    pixels = {(int(y), int(x)) for y, x in zip(*np.nonzero(skeleton), strict=True)}
    df = spark.createDataFrame([(1, *p) for p in pixels], "segment_id int, y int, x int")
    nodes = {(r.y, r.x): r.lines for r in raster.skeleton_nodes(df).collect()}
    junctions = {p for p, n in nodes.items() if n > 2}
    rows = branches.branch_paths(df).orderBy("pos").collect()
    paths = {}
    for r in rows:
        paths.setdefault((r.root_y, r.root_x), []).append(r)
    seen = set()
    for rs in paths.values():
        assert [r.pos for r in rs] == list(range(len(rs)))
        own = [(r.y, r.x) for r in rs if not r.joint]
        joints = [(r.y, r.x) for r in rs if r.joint]
        assert set(joints) <= junctions and not set(own) & junctions and not set(own) & seen
        seen |= set(own)
        plain = walk(own, joints, nodes)
        assert len(plain) == len(own) and own in (plain, plain[::-1])
        if rs[0].branch_type != branches.CYCLE:
            assert all(max(abs(a.y - b.y), abs(a.x - b.x)) == 1 for a, b in zip(rs, rs[1:]))
        assert (rs[0].y, rs[0].x) <= (rs[-1].y, rs[-1].x)
        assert not any(r.joint for r in rs[1:-1])
        if rs[0].branch_type == branches.END_END:
            assert not joints
        elif rs[0].branch_type == branches.JUNCTION_END:
            assert len(joints) == 1
        elif rs[0].branch_type == branches.JUNCTION_JUNCTION:
            assert 1 <= len(joints) <= 2
    assert seen == pixels - junctions and len(junctions) > 0


def test_arms_share_their_junction(spark):
    tee = {(20, x) for x in range(41)} | {(y, 20) for y in range(21, 35)}
    df = spark.createDataFrame([(1, *p) for p in tee], "segment_id int, y int, x int")
    paths = branches.branch_paths(df)
    arms = paths.groupBy("root_y", "root_x").agg(F.count("*").alias("n"), F.count_if("joint").alias("joints")).collect()
    assert len(arms) == 3 and all(r.joints == 1 for r in arms)
    ends = reconnect.path_ends(paths, 10).collect()
    assert {(r.y, r.x) for r in ends} == {(20, 0), (20, 40), (34, 20)}
    assert {(round(r.dir_y), round(r.dir_x)) for r in ends} == {(0, -1), (0, 1), (1, 0)}


# --- clusters


def plain_clusters(left, width, most_mean, most_std):
    """The greedy rule measured on all points of every candidate."""
    radius = width / (2 * np.pi)
    weight = lambda a, b: 1.2 if a == b != "unknown" else 0.6 if (a == "cemented") != (b == "cemented") else 0.8 if {a, b} == {"filled", "unfilled"} else 1.0
    place = lambda z, x: np.stack([radius * np.cos(2 * np.pi * x / width), radius * np.sin(2 * np.pi * x / width), z], axis=1)

    def residuals(points):
        far = points - points.mean(0)
        d = np.abs(far @ np.linalg.svd(far, full_matrices=False)[2][-1])
        return d.mean(), d.std()

    left = sorted(left, key=lambda b: (-len(b[2]), b[2].min(), b[3].min(), b[0]))
    out = []
    while len(left) >= 2 and len(left[0][2]) >= width / 4:
        seed = left.pop(0)
        points, members = place(seed[2], seed[3]), [seed[0]]
        near = [b for b in left if abs(b[2].mean() - seed[2].mean()) < 3 * width]
        while True:
            mean, std = residuals(points)
            for b in near:
                union = np.concatenate([points, place(b[2], b[3])])
                m, s = residuals(union)
                k, grown = weight(seed[1], b[1]), len(union) / len(points)
                if m < min(k * most_mean * grown * mean, width / 50) and s < min(k * most_std * grown * std, width / 50):
                    points = union
                    members.append(b[0])
                    near = [x for x in near if x[0] != b[0]]
                    left = [x for x in left if x[0] != b[0]]
                    break
            else:
                break
        out.append(members)
    return out


def test_clusters_equal_the_plain_rule():
    rng = np.random.default_rng(9)
    width, kinds = 120, ["filled", "unfilled", "cemented", "halffilled", "unknown"]
    joined = 0
    for _ in range(6):
        left = []
        for k in range(40):
            n, at = int(rng.integers(10, 60)), int(rng.integers(0, width))
            x = (at + np.arange(n)) % width
            trace = int(rng.integers(0, 3))
            z = 200 + 90 * trace + (12 + 9 * trace) * np.cos(2 * np.pi * x / width - trace) + np.rint(rng.normal(size=n) * rng.choice([0.3, 1.0, 3.0]))
            left.append((k, str(rng.choice(kinds)), z, x.astype(float)))
        got = branches.greedy_clusters(left, width, 1.7, 1.5)
        assert got == plain_clusters(left, width, 1.7, 1.5)
        joined += sum(len(m) - 1 for m in got)
    assert joined > 20


def test_growth_is_told_within_tasks(spark):
    """The rest is thinned once, not once an end: its pixels are not dealt again for each end, and ends are not collected into lists."""
    ys = [(y, x) for y in range(5, 40, 6) for x in [*range(5, 20), *range(24, 40)]]
    mask = spark.createDataFrame([(1, *p) for p in ys], "segment_id int, y int, x int")
    ends = spark.createDataFrame([(1, k, y, x, 0.0, d, 2) for k, (y, x, d) in enumerate((y, x, d) for y in range(5, 40, 6) for x, d in ((19, 1.0), (24, -1.0)))], "segment_id int, endpoint_id long, y int, x int, dir_y double, dir_x double, width int")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("growth", "growth")
    got = {r.endpoint_id: r.expand_count for r in reconnect.growth_counts(ends, mask, 5, 64, 64).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 12 and len(set(got.values())) == 1
    assert len(jobs.getJobIdsForGroup("growth")) < 15
    assert not hasattr(reconnect, "_near_parts")
