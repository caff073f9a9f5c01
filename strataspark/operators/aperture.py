"""Aperture: the width of a mask across its skeleton, by rays that meet the mask's contours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.groups import by_groups, codes
from strataspark.functions.packed import coded, coded_pieces, points_of
from strataspark.functions.shared import held

from .contours import KEY, contours
from .planes import SMALL, directions, nearest

#: Side of the cells that tell which part of an image a ray passes.
CELL = 16
#: Side of the tiles by which rays and edges are dealt to tasks. Images begin at zero, so tiles end half a side from it.
TILE = 1024
#: Side of the blocks of edges within a tile that are held against the rays that pass them, and pairs that are held at once.
BLOCK, PAIRS = 64, 1 << 21
#: Edges of a contour, and rays, that travel in one row.
EDGES, RAYS = 256, 64
_NEAR = 1e-9


def contour_edges(found: DataFrame, least_area: float = 0.0) -> DataFrame:
    """(segment_id, contour_id, ay, ax, by, bx): edges of the closed polygons of contours whose area is larger."""
    kept = found.where((F.col("area") > least_area) & (F.size("path") > 1))
    turned = F.concat(F.slice("path", F.lit(2), F.size("path") - 1), F.slice("path", 1, 1))
    pairs = kept.select("segment_id", F.struct(*KEY[1:], "contour").alias("contour_id"), F.explode(F.arrays_zip(F.col("path").alias("a"), turned.alias("b"))).alias("e"))
    return pairs.select("segment_id", "contour_id", *(F.col(f"e.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "yx"))


def _crossings(at: str, step: str, low: Column, high: Column, side: int, shift: int) -> Column:
    """Where a ray crosses the borders of cells in one direction, between two places."""
    ends = [F.col(at) + shift + low * F.col(step), F.col(at) + shift + high * F.col(step)]
    first, last = F.ceil(F.least(*ends) / side), F.floor(F.greatest(*ends) / side)
    crossed = F.transform(F.sequence(first, last), lambda k: (k * side - shift - F.col(at)) / F.col(step))
    return F.when((F.abs(step) > 1e-12) & (first <= last), crossed).otherwise(F.array().cast("array<double>"))


def ray_cells(rays: DataFrame, reach: float, side: int = CELL, shift: int = 0) -> DataFrame:
    """rays (y, x, dy, dx) with each cell (cy, cx) that they pass, from border to border.

    Rays that have columns low and high are followed between these places only. alone: whether a ray passes no other cell. The borders of cells
    lie at multiples of side, less shift.
    """
    low, high = (F.col(c) if c in rays.columns else F.lit(v) for c, v in (("low", -float(reach)), ("high", float(reach))))
    stops = F.sort_array(F.concat(F.array(low, high), *(_crossings(c, f"d{c}", low, high, side, shift) for c in "yx")))
    middle = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda k: (F.element_at("stops", k) + F.element_at("stops", k + 1)) / 2)
    at = lambda c, t: F.floor((F.col(c) + shift + t * F.col(f"d{c}")) / side).alias(f"c{c}")
    cells = rays.withColumn("stops", stops).withColumn("cells", F.array_distinct(F.transform(middle, lambda t: F.struct(at("y", t), at("x", t)))))
    found = cells.withColumn("alone", F.size("cells") == 1).withColumn("c", F.explode("cells"))
    return found.withColumn("cy", F.col("c.cy")).withColumn("cx", F.col("c.cx")).drop("stops", "cells", "c", "low", "high")


def within_bounds(rays: DataFrame, bounds: DataFrame, reach: float) -> DataFrame:
    """rays (segment_id, y, x, dy, dx) that pass the rectangle of their segment (y0, y1, x0, x1), with the places low and high between which they do.

    The rectangle is taken a pixel larger on all sides, so that rounding loses nothing.
    """
    met = rays.join(bounds.hint("merge"), "segment_id")
    low, high, hits = [F.lit(-float(reach))], [F.lit(float(reach))], F.lit(True)
    for c in "yx":
        ends = [(F.col(f"{c}0") - 1 - F.col(c)) / F.col(f"d{c}"), (F.col(f"{c}1") + 1 - F.col(c)) / F.col(f"d{c}")]
        moves = F.abs(f"d{c}") > 1e-12
        low.append(F.when(moves, F.least(*ends)).otherwise(-float(reach)))
        high.append(F.when(moves, F.greatest(*ends)).otherwise(float(reach)))
        hits &= moves | F.col(c).between(F.col(f"{c}0") - 1, F.col(f"{c}1") + 1)
    met = met.withColumns({"low": F.greatest(*low), "high": F.least(*high)}).where(hits & (F.col("low") <= F.col("high")))
    return met.drop("y0", "y1", "x0", "x1")


def _in_tiles(ay: np.ndarray, ax: np.ndarray, by: np.ndarray, bx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each edge (its place) with each tile (cy, cx) that it may touch, borders included."""
    tile = lambda c: np.floor((c + TILE // 2) / TILE).astype(np.int64)
    low = [tile(np.minimum(a, b) - 1e-6) for a, b in ((ay, by), (ax, bx))]
    n = [tile(np.maximum(a, b) + 1e-6) - c + 1 for (a, b), c in zip(((ay, by), (ax, bx)), low, strict=True)]
    edge = np.repeat(np.arange(len(ay)), n[0] * n[1])
    k = np.arange(len(edge)) - np.repeat(np.cumsum(n[0] * n[1]) - n[0] * n[1], n[0] * n[1])
    return edge, low[0][edge] + k // n[1][edge], low[1][edge] + k % n[1][edge]


def _dealt(batches: Iterator[pa.RecordBatch], ends) -> Iterator[pa.RecordBatch]:
    """(segment_id, contour_id, cy, cx, n_, points_): the edges of each row that a tile touches, at most EDGES in a row, as bytes of both ends of each.

    ends(batch): the row of each edge, and its ends ay, ax, by, bx.
    """
    for batch in batches:
        row, *corners = ends(batch)
        edge, cy, cx = _in_tiles(*corners)
        if not len(edge):
            continue
        by = np.lexsort((cx, cy, row[edge]))
        edge, cy, cx = edge[by], cy[by], cx[by]
        new = np.r_[True, (row[edge][1:] != row[edge][:-1]) | (cy[1:] != cy[:-1]) | (cx[1:] != cx[:-1])]
        first = np.flatnonzero(new)
        at = np.arange(len(edge)) - first[np.cumsum(new) - 1]
        first = np.flatnonzero(at % EDGES == 0)
        n = np.diff(np.r_[first, len(edge)])
        ends_ = coded(np.stack([c[edge] for c in corners], axis=1).reshape(-1, 2), 2 * n)
        of = pa.array(row[edge[first]])
        yield pa.RecordBatch.from_arrays([batch.column(c).take(of) for c in ("segment_id", "contour_id")] + [pa.array(cy[first]), pa.array(cx[first]), pa.array(n, pa.int32()), ends_], ["segment_id", "contour_id", "cy", "cx", "n_", "points_"])


_RAY = {"y": "double", "x": "double", "dy": "double", "dx": "double", "alone": "boolean"}


def _visits(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """(segment_id, cy, cx, id, y, x, dy, dx, alone): rays with each tile that they pass within the bounds of their segment's edges.

    What within_bounds and ray_cells tell, for a batch of rays with bounds (y0, y1, x0, x1).
    """
    for batch in (b for b in batches if b.num_rows):
        v = {c: batch.column(c).to_numpy().astype(float) for c in ("y", "x", "dy", "dx", "y0", "y1", "x0", "x1")}
        low, high, hits = np.full(batch.num_rows, -float(reach)), np.full(batch.num_rows, float(reach)), np.ones(batch.num_rows, bool)
        for c in "yx":
            moves = np.abs(v[f"d{c}"]) > 1e-12
            step = np.where(moves, v[f"d{c}"], 1.0)
            ends = (v[f"{c}0"] - 1 - v[c]) / step, (v[f"{c}1"] + 1 - v[c]) / step
            low, high = np.where(moves, np.maximum(low, np.minimum(*ends)), low), np.where(moves, np.minimum(high, np.maximum(*ends)), high)
            hits &= moves | ((v[c] >= v[f"{c}0"] - 1) & (v[c] <= v[f"{c}1"] + 1))
        kept = np.flatnonzero(hits & (low <= high))
        v, low, high = {c: w[kept] for c, w in v.items()}, low[kept], high[kept]
        stops, half = [low, high], TILE // 2
        for c in "yx":
            at, step = v[c] + half, v[f"d{c}"]
            ends = at + low * step, at + high * step
            first, last = np.ceil(np.minimum(*ends) / TILE), np.floor(np.maximum(*ends) / TILE)
            moves = np.abs(step) > 1e-12
            for k in range(int((last - first).max(initial=-1)) + 1):
                crosses = moves & (first + k <= last)
                stops.append(np.where(crosses, ((first + k) * TILE - at) / np.where(moves, step, 1.0), np.nan))
        stops = np.sort(np.stack(stops, axis=1), axis=1)
        ray, j = np.nonzero(~np.isnan(stops[:, 1:]))
        middle = (stops[ray, j] + stops[ray, j + 1]) / 2
        cy, cx = (np.floor((v[c][ray] + half + middle * v[f"d{c}"][ray]) / TILE).astype(np.int64) for c in "yx")
        order = np.lexsort((cx, cy, ray))
        ray, cy, cx = ray[order], cy[order], cx[order]
        new = np.flatnonzero(np.r_[True, (ray[1:] != ray[:-1]) | (cy[1:] != cy[:-1]) | (cx[1:] != cx[:-1])][: len(ray)])
        ray, cy, cx = ray[new], cy[new], cx[new]
        alone, of = np.bincount(ray, minlength=len(kept))[ray] == 1, pa.array(kept[ray])
        yield pa.RecordBatch.from_arrays([batch.column("segment_id").take(of), pa.array(cy), pa.array(cx), batch.column("id").take(of), *(pa.array(v[c][ray]) for c in ("y", "x", "dy", "dx")), pa.array(alone)], ["segment_id", "cy", "cx", "id", *_RAY])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment_id, cy, cx, id, y, x, dy, dx, alone): lists of the rays of a batch that pass a tile, at most RAYS in a row."""
    for batch in (b for b in batches if b.num_rows):
        code = codes(pa.Table.from_batches([batch]), ["segment_id", "cy", "cx"])
        order = np.argsort(code, kind="stable")
        new = np.r_[True, np.diff(code[order]) != 0]
        at = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.flatnonzero(at % RAYS == 0)
        ends, all_, of = pa.array(np.r_[first, len(order)], pa.int32()), pa.array(order), pa.array(order[first])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("segment_id", "cy", "cx")), *(pa.ListArray.from_arrays(ends, batch.column(c).take(all_)) for c in ("id", *_RAY))], ["segment_id", "cy", "cx", "id", *_RAY])


def _edge_ends(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return np.arange(batch.num_rows), *(batch.column(c).to_numpy() for c in ("ay", "ax", "by", "bx"))


def _path_ends(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The edges of closed paths."""
    path = batch.column("path")
    n = path.value_lengths().to_numpy()
    points = path.flatten()
    y, x = (points.field(c).to_numpy().astype(float) for c in ("y", "x"))
    after = np.arange(1, len(y) + 1)
    ends = np.cumsum(n)
    after[ends - 1] = ends - n
    return np.repeat(np.arange(len(n)), n), y, x, y[after], x[after]


def _meetings(ray: np.ndarray, edge: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of rays (y, x, dy, dx) and of edges (ay, ax, by, bx) that meet within reach, where on the ray (t), and whether an edge lies along it.

    Blocks of edges are held against the rays that pass them; an edge meets a line where its ends lie on both sides.
    """
    (y, x, dy, dx), (ay, ax, by, bx) = ray, edge
    code = np.floor(ay / BLOCK) * (1 << 20) + np.floor(ax / BLOCK)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    line = np.stack([dy, -dx, y * dx - x * dy], axis=1)
    found = []
    for own in np.split(order, starts[1:]):
        oy, ox = (min(c.min() for c in pair) for pair in ((ay[own], by[own]), (ax[own], bx[own])))
        ty, tx = (max(c.max() for c in pair) for pair in ((ay[own], by[own]), (ax[own], bx[own])))
        middle, half = np.array([(ox + tx) / 2, (oy + ty) / 2, 1.0]), np.hypot(ty - oy, tx - ox) / 2 + 1e-3
        passing = np.flatnonzero(np.abs(line @ middle) <= half)
        one = np.ones(len(own))
        a, b = (np.stack([p[own], q[own], one]) for p, q in ((ax, ay), (bx, by)))
        step = max(1, PAIRS // len(own))
        for k in range(0, len(passing), step):
            some = passing[k : k + step]
            oa, ob = line[some] @ a, line[some] @ b
            r, e = np.nonzero((np.minimum(oa, ob) <= 1e-6) & (np.maximum(oa, ob) >= -1e-6))
            found.append((some[r], own[e]))
    r, e = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    y, x, dy, dx = (c[r] for c in ray)
    ay, ax, by, bx = (c[e] for c in edge)
    ey, ex, gy, gx = by - ay, bx - ax, ay - y, ax - x
    det, off = dx * ey - dy * ex, gx * dy - gy * dx
    along = np.abs(det) < _NEAR
    safe = np.where(along, 1.0, det)
    t, u = (gx * ey - gy * ex) / safe, off / safe
    at = gx * dx + gy * dy, (bx - x) * dx + (by - y) * dy
    lies = along & (np.abs(off) < _NEAR) & (np.minimum(*at) <= reach) & (np.maximum(*at) >= -reach)
    meets = ~along & (u >= -_NEAR) & (u <= 1 + _NEAR) & (np.abs(t) <= reach)
    kept = np.flatnonzero(lies | meets)
    t = np.sign(t) * np.floor(np.abs(t) * 1e7 + 0.5) / 1e7 + 0.0
    return r[kept], e[kept], np.where(lies, np.nan, t)[kept], lies[kept]


def _in_tasks(samples: DataFrame, parts: DataFrame, bounds: DataFrame, reach: float, made, columns: str) -> DataFrame:
    """Rows of made(ray, contour, t, lies, alone) over the meetings of each tile, sorted by ray, contour and t.

    Rays and edges are dealt by tiles, so a task holds the edges and rays of many tiles of small images, or of one; ray and contour are
    places in the task's table. made returns arrays by name, with `ray` and `of`, the rows whose id and contour_id each has (of: -1 for none).
    """
    dy, dx = F.sin(F.radians("normal_deg")), F.cos(F.radians("normal_deg"))
    exact = lambda c: F.when(F.abs(c) < 1e-15, 0.0).otherwise(c)
    rays = samples.select("segment_id", "id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), exact(dy).alias("dy"), exact(dx).alias("dx"))
    types = dict(samples.dtypes) | dict(parts.dtypes)
    here = rays.join(bounds.hint("merge"), "segment_id")
    lists = ", ".join(f"{c} array<{t}>" for c, t in ({"id": types["id"]} | _RAY).items())
    packed = here.mapInArrow(lambda batches: _together(_visits(batches, reach)), f"segment_id {types['segment_id']}, cy long, cx long, {lists}")
    both = packed.unionByName(parts, allowMissingColumns=True)

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        ids = table["id"].combine_chunks()
        # rays and edges of each row, none where it has the others
        m, n = (np.nan_to_num(c.to_numpy(zero_copy_only=False)).astype(np.int64) for c in (ids.value_lengths(), table["n_"].combine_chunks()))
        owner, ray_row = np.flatnonzero(n), np.repeat(np.arange(len(m)), m)
        points = points_of(table["points_"].combine_chunks().take(pa.array(owner)), 2 * n[owner]).reshape(-1, 4).T
        lines = np.stack([table[c].combine_chunks().flatten().to_numpy() for c in ("y", "x", "dy", "dx")])
        alone = table["alone"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # a contour's first row in a tile stands for all of them
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(m))))[owner]
        contour = table["contour_id"].combine_chunks()
        code = codes(table.take(pa.array(owner)), ["contour_id"]) if len(owner) else owner
        _, first, same = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_index=True, return_inverse=True)
        stands = np.repeat(owner[first][same], n[owner])
        rays_to, edges_to, out = np.r_[0, np.cumsum(m)], np.r_[0, np.cumsum(n)], []
        for begin, end in zip(starts, np.append(starts[1:], len(m)), strict=True):
            a, b = rays_to[[begin, end]]
            e0, e1 = edges_to[[begin, end]]
            if a == b or e0 == e1:
                continue
            r, e, t, lies = _meetings(lines[:, a:b], np.ascontiguousarray(points[:, e0:e1]), reach)
            out.append((a + r, stands[e0 + e], t, lies))
        r, c, t, lies = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
        by = np.lexsort((t, c, r))
        got = made(r[by], c[by], t[by], lies[by], alone[r[by]].astype(bool))
        ray, of = got.pop("ray"), got.pop("of")
        return got | {"segment_id": table["segment_id"].combine_chunks().take(pa.array(ray_row[ray])), "id": ids.flatten().take(pa.array(ray))} | {"contour_id": contour.take(pa.array(of, pa.int64(), mask=of < 0))}

    schema = f"segment_id {types['segment_id']}, id {types['id']}, contour_id {types['contour_id']}, {columns}"
    return by_groups(both, ["segment_id", "cy", "cx"], run, schema)


def _pairs(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where another ray or contour begins."""
    return np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])][: len(r)])


def _hits_of(r: np.ndarray, c: np.ndarray, t: np.ndarray, lies: np.ndarray, alone: np.ndarray) -> dict:
    first = _pairs(r, c)
    met = pa.ListArray.from_arrays(pa.array(np.r_[first, len(r)], pa.int32()), pa.array(t, mask=lies))
    return {"ray": r[first], "of": c[first], "hits": met, "lies": np.logical_or.reduceat(lies, first) if len(r) else lies}


def _sides_of(r: np.ndarray, c: np.ndarray, t: np.ndarray, lies: np.ndarray, alone: np.ndarray) -> dict:
    """For each ray and contour the first and last meeting, the nearest ones on both sides, and whether an edge lies along it; of rays that pass one tile the nearest ones that count."""
    first = _pairs(r, c)
    of = lambda f, v: f.reduceat(v, first) if len(r) else v
    got = {"low": of(np.fmin, t), "high": of(np.fmax, t), "ahead": of(np.fmin, np.where(t > 1e-6, t, np.inf)), "behind": of(np.fmin, np.where(t < -1e-6, -t, np.inf)), "lies": of(np.logical_or, lies)}
    ray, contour, alone = r[first], c[first], alone[first]
    apart = {k: v[~alone] for k, v in got.items()}
    kept = alone & ~got["lies"] & (got["low"] < got["high"])
    own = ray[kept]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    done = {k: np.minimum.reduceat(got[k][kept], start) if len(own) else got[k][kept] for k in ("ahead", "behind")}
    n = len(start)
    filled = done | {"low": np.zeros(n), "high": np.zeros(n), "lies": np.zeros(n, bool)}
    return {"ray": np.r_[ray[~alone], own[start]], "of": np.r_[contour[~alone], np.full(n, -1)]} | {k: np.concatenate([apart[k], filled[k]]) for k in apart}


def ray_hits(samples: DataFrame, edges: DataFrame, reach: float = 1000) -> DataFrame:
    """(segment_id, id, contour_id, hits): places where the line of each sample point (segment_id, id, y, x, normal_deg) meets a contour.

    Places are distances along the normal, within `reach` on either side. Only contours that are met in two or more points count, and
    none of which an edge lies on the line: a lone point or a common stretch tells no width. Lines and edges meet
    in the tiles that both touch, and only where the segment has edges. Neither
    side is sent whole to the driver: tables of few bytes on disk become many rows here.
    """
    # the corners of a closed polygon are the beginnings of its edges
    bounds = edges.groupBy("segment_id").agg(*(f(f"a{c}").alias(f"{c}{k}") for c in "yx" for k, f in ((0, F.min), (1, F.max))))
    types = dict(edges.dtypes)
    parts = edges.mapInArrow(lambda batches: _dealt(batches, _edge_ends), _PART.format(**types))
    met = _in_tasks(samples, parts, bounds, reach, _hits_of, "hits array<double>, lies boolean")
    hits = met.groupBy("segment_id", "id", "contour_id").agg(F.array_compact(F.sort_array(F.array_distinct(F.flatten(F.collect_list("hits"))))).alias("hits"), F.bool_or("lies").alias("lies"))
    return hits.where((F.size("hits") > 1) & ~F.col("lies")).drop("lies")


_PART = "segment_id {segment_id}, contour_id {contour_id}, cy long, cx long, n_ int, points_ binary"


def ray_widths(samples: DataFrame, mask: DataFrame, reach: float = 1000, ratio: float = 1.0, least_area: float = 0.0) -> DataFrame:
    """(segment_id, id, width_mm) of sample points: the nearest meetings with contours on both sides together.

    Samples without one on each side are left out. least_area: contours must be larger. Meetings count as in ray_hits; a ray that
    passes one tile is done with it, and of others each tile tells the nearest meetings with each contour.
    """
    found = contours(mask).where((F.col("area") > least_area) & (F.size("path") > 1)).select("segment_id", F.struct(*KEY[1:], "contour").alias("contour_id"), "path")
    ends = [f(F.col(f"path.{c}")).alias(f"{c}{k}") for c in "yx" for k, f in ((0, F.array_min), (1, F.array_max))]
    bounds = found.select("segment_id", *ends).groupBy("segment_id").agg(*((F.max if k else F.min)(f"{c}{k}").alias(f"{c}{k}") for c in "yx" for k in (0, 1)))
    parts = found.mapInArrow(lambda batches: _dealt(batches, _path_ends), _PART.format(**dict(found.dtypes)))
    met = held(_in_tasks(samples, parts, bounds, reach, _sides_of, "low double, high double, ahead double, behind double, lies boolean"), "meetings")
    across = met.where("contour_id is not null").groupBy("segment_id", "id", "contour_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("ahead").alias("ahead"), F.min("behind").alias("behind"), F.bool_or("lies").alias("lies"))
    near = across.where("not lies and low < high").groupBy("segment_id", "id").agg(F.min("ahead").alias("ahead"), F.min("behind").alias("behind"))
    sides = met.where("contour_id is null").select("segment_id", "id", "ahead", "behind").unionByName(near)
    width = F.col("ahead") + F.col("behind")
    return sides.where(width < float("inf")).select("segment_id", "id", (width * ratio).alias("width_mm"))


def _across(y: np.ndarray, x: np.ndarray, first: np.ndarray, size: np.ndarray, asks: np.ndarray, n: int) -> np.ndarray:
    """The direction across its path of each point that asks, from the n nearest points of the path (with itself).

    Paths are the ranges first, size of the points; of equal distances the first point counts. Sums of whole numbers are exact.
    """
    path = np.repeat(np.arange(len(size)), size)[asks]
    m = size[path]
    begin = np.cumsum(m) - m
    place = np.arange(int(m.sum())) - np.repeat(begin, m)
    at, of = np.repeat(first[path], m) + place, np.repeat(asks, m)
    # distances with the place in the path, so that all differ
    far = ((y[at] - y[of]) ** 2 + (x[at] - x[of]) ** 2) * SMALL + place
    sums = np.zeros((6, len(asks)), np.int64)
    for _ in range(n):
        least = np.minimum.reduceat(far, begin)
        left = np.flatnonzero(least < _GONE)
        k = least[left] % SMALL
        far[begin[left] + k] = _GONE
        near = first[path[left]] + k
        dy, dx = y[near] - y[asks[left]], x[near] - x[asks[left]]
        sums[:, left] += np.stack([np.ones_like(dy), dx, dy, dx * dx, dx * dy, dy * dy])
    c, sx, sy, xx, xy, yy = sums
    along = np.degrees(0.5 * np.arctan2(2.0 * (c * xy - sx * sy), (c * xx - sx * sx) - (c * yy - sy * sy)))
    return np.mod(along + 90.0, 180.0)


#: A distance of points that have been met.
_GONE = 1 << 62


def sampled_normals(paths: DataFrame, every: int = 10, n: int = 4, path: list[str] | None = None) -> DataFrame:
    """Every tenth point of each path with the direction across it, from its n nearest points of the path.

    path: the columns that name a path; pos is the place in it. Paths of up to SMALL pixels travel as bytes, and their directions
    are told where they arrive; the points of longer ones are searched in a grid.
    """
    path = path or KEY
    types = dict(paths.dtypes)
    points = paths.select(*path, "pos", "y", "x")
    if path == KEY and "n_px" in paths.columns:
        long = paths.where(F.col("n_px") > SMALL).select(*path).distinct()
    else:
        long = paths.groupBy(*path).agg(F.count("*").alias("n_")).where(F.col("n_") > SMALL).select(*path)
    long = held(long, "long")

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        m = table["n_"].to_numpy().astype(np.int64)
        y, x = (c.astype(np.int64) for c in points_of(table["points_"].combine_chunks(), m).T)
        pos = np.repeat(table["pos"].to_numpy().astype(np.int64) - np.cumsum(m) + m, m) + np.arange(len(y))
        row = np.repeat(np.arange(len(m)), m)
        size = np.add.reduceat(m, starts)
        first = np.cumsum(size) - size
        asks = np.flatnonzero(pos % every == 0)
        pairs = np.cumsum(np.repeat(size, size)[asks]) // PAIRS
        cuts = np.flatnonzero(np.diff(pairs)) + 1
        normal = np.concatenate([_across(y, x, first, size, some, n) for some in np.split(asks, cuts)]) if len(asks) else np.empty(0)
        of = pa.array(row[asks])
        return {c: table[c].combine_chunks().take(of) for c in path} | {"pos": pos[asks], "y": y[asks], "x": x[asks], "normal_deg": normal}

    named = ", ".join(f"{c} {types[c]}" for c in path)
    short, far = points, None
    if not long.isEmpty():
        short, far = points.join(long, path, "left_anti"), points.join(long, path, "left_semi")
    packed = short.mapInArrow(lambda batches: coded_pieces(batches, path), f"{named}, pos {types['pos']}, n_ int, points_ binary")
    found = by_groups(packed, path, run, f"{named}, pos {types['pos']}, y int, x int, normal_deg double", ["pos"])
    if far is not None:
        found = found.unionByName(_sampled_of_long(far, every, n, path))
    return found.withColumn("id", F.xxhash64(*[c for c in path if c != "segment_id"], "pos"))


def _sampled_of_long(paths: DataFrame, every: int, n: int, path: list[str]) -> DataFrame:
    points = paths.select(F.struct(*path).alias("path_"), "pos", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    near = nearest(points, "path_", "pos", ["y", "x"], n, points.where(F.col("pos") % every == 0))
    around = near.join(points.withColumnRenamed("pos", "neighbour"), ["path_", "neighbour"]).withColumn("sample_", F.struct("path_", "pos"))
    across = directions(around, "sample_", F.col("x"), F.col("y")).select(F.col("sample_.path_").alias("path_"), F.col("sample_.pos").alias("pos"), "normal_deg")
    return points.join(across, ["path_", "pos"]).select("path_.*", "pos", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "normal_deg")
