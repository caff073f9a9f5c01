"""Branches of skeletons: ordered paths, types, and coplanar clusters of branches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.geometry import pair_weight
from strataspark.functions.groups import _starts, by_groups, codes
from strataspark.functions.packed import coded, pieces, points_of
from strataspark.functions.shared import held

from .raster import NODE_HALO, RING, Pixels, in_bands, own_branches, rooted

#: Branch types: two free ends, one junction and one end, two junctions, a cycle.
END_END, JUNCTION_END, JUNCTION_JUNCTION, CYCLE = range(4)
#: Candidates of an image's cluster that are measured at once, and how near to a bound a measure is taken again on all points.
TOGETHER, UNSURE = 6, 1e-6
#: Points of segments whose clusters grow at the same time; one segment may have more.
POINTS = 1 << 20

#: Places of RING by how near they are, straight ones before diagonal ones: as a walk goes on, and by row and column.
_WALK = (0, 2, 4, 6, 1, 3, 5, 7)
_NEAREST = (0, 6, 2, 4, 7, 1, 5, 3)
_DY, _DX = (np.array([d[k] for d in RING]) for k in (0, 1))


def _first_joint(y: np.ndarray, x: np.ndarray, joints: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The nearest junction pixel beside each pixel, as a place in RING, -1 for none; taken: a place that doesn't count, or -1."""
    out = np.full(len(y), -1)
    for k in _NEAREST[::-1]:
        out[(joints >> k & 1 == 1) & (taken != k)] = k
    return out


def ordered_paths(p: Pixels, root: np.ndarray, lines: np.ndarray, joints: np.ndarray) -> dict:
    """Branches from node to node, one after another, with a junction pixel at each end that has one.

    p: pixels of whole branches; root: the place of the first pixel of each one's branch; lines: the lines that leave each; joints: bit k set
    where RING[k] is a junction pixel. Arrays by name: of (the place of the branch's first pixel), branch_type, n_px, pos, y, x, joint. A walk
    begins at the branch's first end (or first pixel) and takes straight steps before diagonal ones; all branches walk at the same time. The
    nearest junction pixel to an end counts, the first by row and column among equally near ones. Paths begin
    at the node that is first by row and column.
    """
    near = p.near[list(_WALK)]
    # copies of images lie apart, so a neighbour is of the same branch if it has the same root
    same = np.append(root, -1)[near] == root
    inner = same.sum(0) > 1
    by = np.lexsort((np.arange(p.n), inner, root))
    first = by[np.r_[True, root[by][1:] != root[by][:-1]][: p.n]]
    heads, walk, at = first, [first], first
    left = np.ones(p.n + 1, bool)
    left[first] = left[p.n] = False
    branch, who = [np.arange(len(first))], np.arange(len(first))
    while len(at):
        free = same[:, at] & left[near[:, at]]
        goes = free.any(0)
        at, who = near[free.argmax(0), at][goes], who[goes]
        left[at] = False
        walk.append(at)
        branch.append(who)
    step = np.repeat(np.arange(len(walk)), [len(w) for w in walk])
    walk, branch = np.concatenate(walk), np.concatenate(branch)
    order = np.lexsort((step, branch))
    walk, branch = walk[order], branch[order]
    count = np.bincount(branch, minlength=len(first))
    a, b = heads, walk[np.cumsum(count) - 1]
    none = np.full(len(a), -1)
    head = np.where(lines[a] > 1, _first_joint(p.y[a], p.x[a], joints[a], none), -1)
    tail = np.where(lines[b] > 1, _first_joint(p.y[b], p.x[b], joints[b], np.where(count == 1, head, -1)), -1)
    # a stub whose only neighbours are the junction's pixels
    stub = (head < 0) & (tail < 0)
    tail = np.where(stub, _first_joint(p.y[b], p.x[b], joints[b], none), tail)
    head = np.where(stub & (tail < 0), _first_joint(p.y[a], p.x[a], joints[a], none), head)
    place = lambda e, k: (p.y[e] + np.where(k < 0, 0, _DY[k]), p.x[e] + np.where(k < 0, 0, _DX[k]))
    (ay, ax), (by_, bx) = place(a, head), place(b, tail)
    turned = (ay > by_) | ((ay == by_) & (ax > bx))
    total = count + (head >= 0) + (tail >= 0)
    ends, touches = (np.bincount(root, weights=w, minlength=p.n)[root[first]] > 0 for w in (lines <= 1, joints > 0))
    kind = np.where(touches, np.where(ends, JUNCTION_END, JUNCTION_JUNCTION), np.where(ends, END_END, CYCLE))
    own = np.repeat(np.arange(len(first)), count)
    pos = np.arange(len(walk)) - np.repeat(np.cumsum(count) - count, count) + (head >= 0)[own]
    h, t = np.flatnonzero(head >= 0), np.flatnonzero(tail >= 0)
    own = np.concatenate([own, h, t])
    pos = np.concatenate([pos, np.zeros(len(h), np.int64), total[t] - 1])
    y, x = np.concatenate([p.y[walk], ay[h], by_[t]]), np.concatenate([p.x[walk], ax[h], bx[t]])
    joint = np.arange(len(own)) >= len(walk)
    pos = np.where(turned[own], total[own] - 1 - pos, pos)
    order = np.lexsort((pos, own))
    own = own[order]
    return {"of": root[first][own], "branch_type": kind[own], "n_px": total[own], "pos": pos[order], "y": y[order], "x": x[order], "joint": joint[order]}


def branch_paths(skeleton: DataFrame) -> DataFrame:
    """(segment_id, root_y, root_x, branch_type, n_px, pos, y, x, joint) of each branch, from node to node; n_px pixels.

    A branch is what remains joined without junction pixels, and the junction pixel at either end that has one; so a
    junction pixel belongs to each of its arms. Branches within a band are put in order with it, many at once; those that go on
    in another band are put together first, and a task holds one of them at least.
    """
    key = ["segment_id", "root_y", "root_x"]
    types = dict(skeleton.dtypes)
    path = "branch_type int, n_px long, pos int, y int, x int, joint boolean"

    def run(p: Pixels, own: np.ndarray) -> dict:
        lines, joints, root, goes_on = own_branches(p, own)
        within, open_ = np.flatnonzero(own & (lines <= 2) & ~goes_on), np.flatnonzero(goes_on)
        q = Pixels(p.image[within], p.y[within], p.x[within])
        place = np.zeros(p.n, np.int64)
        place[within] = np.arange(len(within))
        out = ordered_paths(q, place[root[within]], lines[within], joints[within])
        of = within[out.pop("of")]
        none = lambda n: pa.nulls(n)
        both = {"of": np.concatenate([of, open_]), **{c: np.concatenate([v, w[open_]]) for c, v, w in (("y", out.pop("y"), p.y), ("x", out.pop("x"), p.x))}}
        both |= {c: np.concatenate([w[of], w[root[open_]]]) for c, w in (("root_y", p.y), ("root_x", p.x))}
        kinds = {"branch_type": pa.int32(), "n_px": pa.int64(), "pos": pa.int32(), "joint": pa.bool_()}
        both |= {c: pa.concat_arrays([pa.array(out[c], t), none(len(open_)).cast(t)]) for c, t in kinds.items()}
        return both | {c: pa.concat_arrays([none(len(of)).cast(pa.int32()), pa.array(w[open_], pa.int32())]) for c, w in (("lines", lines), ("joints", joints))}

    corner = f"root_y {types['y']}, root_x {types['x']}"
    made = held(in_bands(skeleton, ["segment_id"], NODE_HALO, run, f"{corner}, {path}, lines int, joints int"), "paths")
    paths = made.where("lines is null").select(*key, "branch_type", "n_px", "pos", "y", "x", "joint")
    left = made.where("lines is not null").select("segment_id", F.col("root_y").alias("ly"), F.col("root_x").alias("lx"), "y", "x", "lines", "joints")
    if left.isEmpty():
        return paths

    def whole(table: pa.Table, starts: np.ndarray) -> dict:
        lines, joints, y, x = (table[c].to_numpy() for c in ("lines", "joints", "y", "x"))
        size = np.diff(np.append(starts, len(y)))
        p = Pixels(np.repeat(np.arange(len(starts)), size), y, x)
        out = ordered_paths(p, np.repeat(starts, size), lines, joints)
        at = pa.array(out.pop("of"))
        return out | {k: table[k].combine_chunks().take(at) for k in key}

    across = held(by_groups(rooted(left, ["segment_id"]), key, whole, f"segment_id {types['segment_id']}, {corner}, {path}", ["y", "x"]), "paths")
    return paths.unionByName(across)


def long_branches(paths: DataFrame, shortest: int = 20) -> DataFrame:
    """Without short free branches, all cycles, and short ones (a fifth) between junctions."""
    keep = F.when(F.col("branch_type").isin(END_END, JUNCTION_END), F.col("n_px") >= shortest).when(F.col("branch_type") == JUNCTION_JUNCTION, F.col("n_px") >= shortest / 5).otherwise(False)
    return paths.where(keep)


def _residuals(points: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of distances from the best plane of points (on the cylinder)."""
    far = points - points.mean(0)
    normal = np.linalg.eigh(far.T @ far)[1][:, 0]
    d = np.abs(far @ normal)
    return float(d.mean()), float(d.std())


def _least_spread(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean squared distances of each set of points along its main directions, the least first, and these directions (columns), by its moments.

    Moments are the number, the sums, and the sums of products of points: what joins by addition.
    """
    n, mean = moments[:, 0, None], moments[:, 1:4] / moments[:, :1]
    return np.linalg.eigh(moments[:, 4:].reshape(-1, 3, 3) / n[:, :, None] - mean[:, :, None] * mean[:, None, :])


def _may_spread_less(moments: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Places of the sets of points whose least spread may be at most their bound: the others' covariance less the bound is positive definite."""
    n, x, y, z = moments[:, 0], *(moments[:, k] / moments[:, 0] for k in (1, 2, 3))
    xx, yy, zz = (moments[:, k] / n - c * c - bound for k, c in ((4, x), (8, y), (12, z)))
    xy, xz, yz = (moments[:, k] / n - c * d for k, c, d in ((5, x, y), (6, x, z), (9, y, z)))
    scale = np.abs(xx) + np.abs(yy) + np.abs(zz) + 2 * bound
    two = xx * yy - xy * xy
    three = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    return np.flatnonzero(~((xx > 1e-12 * scale) & (two > 1e-12 * scale**2) & (three > 1e-12 * scale**3)))


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each place is of, and the places of all ranges, one after another."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) + np.repeat(begin - np.cumsum(size) + size, size)


class _Clusters:
    """Clusters of many images that grow at the same time, one of each image; see cluster_branches.

    image, kind: of each branch, in order of images and, within one, of seeds; size: its points, which follow one another in points (three rows).
    weights: pair_weight of two kinds. A union whose mean and deviation of residuals are under their bounds has a mean
    square under the sum of the bounds' squares, which moments tell without its points; only such candidates are measured, a few of each
    image together. Where rounding could decide, a union is measured by itself.
    """

    def __init__(self, image: np.ndarray, size: np.ndarray, kind: np.ndarray, points: np.ndarray, weights: np.ndarray, width: int, most_mean: float, most_std: float):
        self.size, self.kind, self.points, self.weights, self.width, self.most = size, kind, points, weights, width, (most_mean, most_std)
        self.begin = np.cumsum(size) - size
        self.first = np.flatnonzero(np.r_[True, image[1:] != image[:-1]][: len(image)])
        self.last = np.r_[self.first[1:], len(image)]
        self.image = np.repeat(np.arange(len(self.first)), self.last - self.first)
        total = lambda c: np.add.reduceat(c, self.begin)
        self.middle = np.stack([total(c) / size for c in points], axis=1)
        far = [c - np.repeat(m, size) for c, m in zip(points, self.middle.T, strict=True)]
        self.depth = self.middle[:, 2].copy()
        self.scatter = np.stack([total(far[min(j, k)] * far[max(j, k)]) for j in range(3) for k in range(3)], axis=1)
        # moments about a fixed depth of each image, so that little is lost in their differences
        sums = self.middle.copy()
        sums[:, 2] -= (np.add.reduceat(self.middle[:, 2], self.first) / (self.last - self.first))[self.image]
        products = self.scatter + (sums[:, :, None] * sums[:, None, :] * size[:, None, None]).reshape(-1, 9)
        # a row for each, which the screen reads one after another
        self.moments = np.ascontiguousarray(np.concatenate([size[:, None], sums * size[:, None], products], axis=1).T)
        self.scale = np.maximum(np.maximum.reduceat(np.abs(self.moments[[4, 8, 12]]).max(axis=0), self.first), 1.0)
        self.alive, self.left = np.ones(len(image), bool), self.last - self.first
        # of the cluster of each image: its seed, points, moments, centre, scatter, mean and deviation; and the places of its points in held
        n = len(self.first)
        self.seed, self.n = np.zeros((2, n), np.int64)
        self.own, self.centre, self.spread, self.mean, self.std = np.zeros((13, n)), np.zeros((n, 3)), np.zeros((n, 9)), np.zeros(n), np.zeros(n)
        self.held, self.room = np.empty_like(points), self.begin[self.first]
        # candidates that are to be measured, with their bounds, in the places of the image's branches
        self.queue, self.bounds, self.next, self.end = np.zeros(len(image), np.int64), np.zeros((2, len(image))), self.first.copy(), self.first.copy()
        self.cluster, self.count = np.full(n, -1), np.zeros(n, np.int64)

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """branch, cluster and place of all that belongs to one."""
        out, empty = [], np.arange(len(self.first))
        while True:
            while len(empty):
                fresh = self._seeds(empty)
                if len(fresh):
                    out.append((self.seed[fresh], self.cluster[fresh], self.count[fresh] - 1))
                    self._screen(fresh)
                empty = fresh[self.next[fresh] == self.end[fresh]]
            open_ = np.flatnonzero(self.next < self.end)
            if not len(open_):
                return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
            changed, branch = self._measure(open_)
            if len(changed):
                out.append((branch, self.cluster[changed], self.count[changed] - 1))
                self._screen(changed)
            empty = open_[self.next[open_] >= self.end[open_]]

    def _seeds(self, images: np.ndarray) -> np.ndarray:
        """The images (of these) that have a further seed: the longest branch left, while it is a quarter of the width and another one is left."""
        images = images[self.left[images] > 1]
        of, at = _ranges(self.first[images], self.last[images] - self.first[images])
        there = np.flatnonzero(self.alive[at])
        seed = at[there[np.searchsorted(of[there], np.arange(len(images)))]] if len(images) else images
        long = self.size[seed] >= self.width / 4
        images, seed = images[long], seed[long]
        self.seed[images], self.n[images], self.own[:, images], self.cluster[images], self.count[images] = seed, 0, 0, self.cluster[images] + 1, 0
        self.centre[images], self.spread[images] = self.middle[seed], 0
        if len(images):
            m, s, sure = self._residuals(images, seed)
            for k in np.flatnonzero(~sure):
                m[k], s[k] = _residuals(self._points(images[k], seed[k]))
            self._join(images, seed, m, s)
        return images

    def _screen(self, images: np.ndarray) -> None:
        """Puts the candidates of these images that may join into their queues: those within three widths of the seed, by their moments."""
        of, at = _ranges(self.first[images], self.last[images] - self.first[images])
        left = np.flatnonzero(self.alive[at])
        of, at = of[left], at[left]
        near = np.flatnonzero(np.abs(self.depth[at] - self.depth[self.seed[images]][of]) < 3 * self.width)
        of, at = of[near], at[near]
        m = np.bincount(of, minlength=len(images))
        each = lambda c: np.repeat(c, m)
        n = self.n[images]
        wider = self.weights[each(self.kind[self.seed[images]]), self.kind[at]] * (1 + self.size[at] / each(n))
        a, b = (np.minimum(wider * each(most * now[images]), self.width / 50) for most, now in zip(self.most, (self.mean, self.std), strict=True))
        bound = a * a + b * b + each(1e-9 * self.scale[images] / n + 1e-9)
        both = np.empty((13, len(at)))
        for k in (0, 1, 2, 3, 4, 5, 6, 8, 9, 12):
            np.add(each(self.own[k, images]), self.moments[k].take(at), out=both[k])
        maybe = _may_spread_less(both.T, bound)
        n = np.bincount(of[maybe], minlength=len(images))
        place = _ranges(self.first[images], n)[1]
        self.queue[place], self.bounds[0, place], self.bounds[1, place] = at[maybe], a[maybe], b[maybe]
        self.next[images], self.end[images] = self.first[images], self.first[images] + n

    def _points(self, image: int, branch: int | None = None) -> np.ndarray:
        """The points of an image's cluster, in order of joining, and those of a branch."""
        parts = [self.held[:, self.room[image] : self.room[image] + self.n[image]]]
        if branch is not None:
            parts.append(self.points[:, self.begin[branch] : self.begin[branch] + self.size[branch]])
        return np.ascontiguousarray(np.concatenate(parts, axis=1).T)

    def _residuals(self, images: np.ndarray, branches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean and deviation of the residuals of clusters together with a branch each, and whether the plane is well told."""
        a, b = self.n[images], self.size[branches]
        step = self.middle[branches] - self.centre[images]
        joint = self.spread[images] + self.scatter[branches] + ((a * b / (a + b))[:, None, None] * step[:, :, None] * step[:, None, :]).reshape(-1, 9)
        values, along = _least_spread(np.concatenate([(a + b)[:, None], np.zeros((len(a), 3)), joint], axis=1))
        normal = along[:, :, 0]
        level = ((self.centre[images] + step * (b / (a + b))[:, None]) * normal).sum(axis=1)
        total = np.zeros(len(a))
        for points, begin, size in ((self.held, self.room[images], a), (self.points, self.begin[branches], b)):
            some = np.flatnonzero(size)
            if not len(some):
                continue
            size = size[some]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(begin[some] - ends + size, size)
            d = np.repeat(-level[some], size)
            for c, k in zip(points, normal[some].T, strict=True):
                d += c.take(at) * np.repeat(k, size)
            total[some] += np.add.reduceat(np.abs(d, out=d), ends - size)
        mean = total / (a + b)
        return mean, np.sqrt(np.maximum(values[:, 0] - mean * mean, 0.0)), values[:, 1] - values[:, 0] > 1e-4

    def _measure(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The images (of these) whose next candidates have one that joins, and this one."""
        of, at = _ranges(self.next[images], np.minimum(self.end[images] - self.next[images], TOGETHER))
        own, branch, (a, b) = images[of], self.queue[at], self.bounds[:, at]
        m, s, sure = self._residuals(own, branch)
        joins = (m < a) & (s < b)
        for k in np.flatnonzero(~sure | (np.abs(m - a) < UNSURE) | (np.abs(s - b) < UNSURE)):
            joins[k] = self._joins(own[k], branch[k])
        found = np.flatnonzero(joins)
        found = found[np.r_[True, of[found][1:] != of[found][:-1]][: len(found)]]
        self.next[images] += TOGETHER
        self._join(own[found], branch[found], m[found], s[found])
        return own[found], branch[found]

    def _joins(self, image: int, branch: int) -> bool:
        """The rule, measured on all points."""
        now, (m, s) = _residuals(self._points(image)), _residuals(self._points(image, branch))
        wider = self.weights[self.kind[self.seed[image]], self.kind[branch]] * (self.n[image] + self.size[branch]) / self.n[image]
        return all(v < min(wider * most * w, self.width / 50) for v, most, w in zip((m, s), self.most, now, strict=True))

    def _join(self, images: np.ndarray, branches: np.ndarray, mean: np.ndarray, std: np.ndarray) -> None:
        a, b = self.n[images], self.size[branches]
        step = self.middle[branches] - self.centre[images]
        self.spread[images] += self.scatter[branches] + ((a * b / (a + b))[:, None, None] * step[:, :, None] * step[:, None, :]).reshape(-1, 9)
        self.centre[images] += step * (b / (a + b))[:, None]
        self.own[:, images] += self.moments[:, branches]
        to, from_ = _ranges(self.room[images] + a, b)[1], _ranges(self.begin[branches], b)[1]
        for held, points in zip(self.held, self.points, strict=True):
            held[to] = points[from_]
        self.n[images], self.mean[images], self.std[images] = a + b, mean, std
        self.alive[branches] = False
        self.left[images] -= 1
        self.count[images] += 1


def _clusters(image: np.ndarray, size: np.ndarray, z: np.ndarray, x: np.ndarray, kind: np.ndarray, names: list, ident: np.ndarray, width: int, most_mean: float, most_std: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """branch, cluster and place of all branches that belong to a cluster, in order of images, clusters and joining.

    size points (z, x) of each branch, one after another; ident: the branches' ids in numbers of the same order.
    """
    begin = np.cumsum(size) - size
    order = np.lexsort((ident, np.minimum.reduceat(x, begin), np.minimum.reduceat(z, begin), -size, image))
    at = _ranges(begin[order], size[order])[1]
    theta = 2 * np.pi * x[at] / width
    radius = width / (2 * np.pi)
    points = np.stack([radius * np.cos(theta), radius * np.sin(theta), z[at]])
    weights = np.array([[pair_weight(a, b) for b in names] for a in names])
    branch, cluster, place = _Clusters(image[order], size[order], kind[order], points, weights, width, most_mean, most_std).run()
    branch = order[branch]
    by = np.lexsort((place, cluster, image[branch]))
    return branch[by], cluster[by], place[by]


def greedy_clusters(left: list[tuple], width: int, most_mean: float, most_std: float) -> list[list]:
    """Clusters of branches (id, class, points z and x) of one image, as lists of ids in the order of joining; see cluster_branches."""
    if not left:
        return []
    ids, names = sorted(b[0] for b in left), sorted({b[1] for b in left})
    numbers = [np.array([known.index(b[k]) for b in left]) for k, known in enumerate((ids, names))]
    z, x = (np.concatenate([b[k] for b in left]).astype(float) for k in (2, 3))
    branch, cluster, _ = _clusters(np.zeros(len(left), np.int64), np.array([len(b[2]) for b in left]), z, x, numbers[1], names, numbers[0], width, most_mean, most_std)
    return [[left[i][0] for i in branch[cluster == c]] for c in range(cluster.max(initial=-1) + 1)]


def path_arrays(paths: DataFrame) -> DataFrame:
    """(segment_id, root_y, root_x, pos, path): points (z, x) of branch_paths, a row for each branch, or for each piece of one that was cut; pos is the first one's."""
    key = ["segment_id", "root_y", "root_x"]
    types = dict(paths.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, order, first, points in pieces(batches, key):
            path = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in points.T], ["z", "x"]))
            of = pa.array(order[first])
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(of) for c in [*key, "pos"]), path], [*key, "pos", "path"])

    return paths.select(*key, "pos", "y", "x").mapInArrow(run, f"segment_id {types['segment_id']}, root_y {types['root_y']}, root_x {types['root_x']}, pos int, path array<struct<z:double,x:double>>")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their paths as bytes."""
    for batch in batches:
        path = batch.column("path")
        n = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.stack([path.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("z", "x")], axis=1)
        others = [c for c in batch.schema.names if c != "path"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n, pa.int32()), coded(points, n)], [*others, "n_", "points_"])


def cluster_branches(branches: DataFrame, width: int, most_mean: float = 1.7, most_std: float = 1.5) -> DataFrame:
    """Greedy coplanar clusters: (segment_id, branch_id, cluster_id, place), place being the order of joining.

    branches: segment_id, branch_id, fractype and path, an array of (z, x); with a column pos, a branch may come in pieces, in order of it. The longest branch left is the
    seed while it is a quarter of the width and another one is left. Candidates lie within three widths of its
    centre; the first that keeps mean and deviation of residuals under their bounds joins, and the search begins
    anew. Paths travel as bytes, and a task works on many segments at the same time. A segment's branches are one group; their number is bounded by the segment's size.
    """
    key, types = ["segment_id", "branch_id", "fractype", "pos"], dict(branches.dtypes)

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        n, ends = table["n_"].to_numpy().astype(np.int64), np.append(starts[1:], table.num_rows)
        total = np.add.reduceat(n, starts)
        portion = np.cumsum(total) // POINTS
        cuts = np.r_[0, np.flatnonzero(np.diff(portion)) + 1, len(starts)]
        out = [few(table.slice(starts[a], ends[b - 1] - starts[a]), n[starts[a] : ends[b - 1]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at = pa.array(np.concatenate([starts[a] + o[0] for a, o in zip(cuts[:-1], out, strict=True)]))
        made = {k: np.concatenate([o[i] for o in out]) for i, k in ((1, "cluster_id"), (2, "place"))}
        return made | {k: table[k].combine_chunks().take(at) for k in key[:2]}

    def few(table: pa.Table, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        image = codes(table, key[:1])
        # rows are in order of segments, branches and pieces, so numbers of the branches keep their order
        first = _starts(table, key[:2])
        size = np.add.reduceat(n, first)
        kinds = pc.dictionary_encode(table["fractype"].combine_chunks(), null_encoding="encode")
        kind = kinds.indices.to_numpy()[first]
        points = points_of(table["points_"].combine_chunks(), n)
        some = np.flatnonzero(size)
        if not len(some):
            return (np.empty(0, np.int64),) * 3
        branch, cluster, place = _clusters(image[first][some], size[some], *points.T.copy(), kind[some], kinds.dictionary.to_pylist(), np.arange(len(some)), width, most_mean, most_std)
        return first[some[branch]], cluster, place

    parts = branches if "pos" in branches.columns else branches.withColumn("pos", F.lit(0))
    kept = ", ".join(f"{c} {types.get(c, 'int')}" for c in key)
    placed = parts.select(*key, "path").mapInArrow(_coded, f"{kept}, n_ int, points_ binary")
    return by_groups(placed, ["segment_id"], run, f"segment_id {types['segment_id']}, branch_id {types['branch_id']}, cluster_id int, place int", ["branch_id", "pos"])
