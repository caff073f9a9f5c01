"""Contours of masks: borders of components and of their holes, with area and hierarchy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.groups import by_groups
from strataspark.functions.shared import held

from .raster import BAND, Pixels, in_bands, rooted

KEY = ["segment_id", "root_y", "root_x"]
_PIXELS = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32())]))
_SIDES = sum(1 << 2 * s for s in range(4))


def borders(p: Pixels, root: np.ndarray, ring: np.ndarray) -> dict:
    """All borders of many components, from their outline pixels, the place of each one's first pixel, and the ring codes.

    Each open side (north, east, south, west) of a pixel is a step along a border, with the component on the right. The
    next step is the diagonal pixel ahead if it belongs to the component, else the pixel ahead, else the
    pixel's own next side: every step has one successor and one predecessor, so borders are the cycles. They are found and put in
    order by pointer jumping. Outer borders run clockwise and come first; a border begins at its first pixel by row and column.
    Arrays by name: of (the place of the component's first pixel), contour, hole, area, path, east.
    """
    y, x, ring = p.y, p.x, ring.astype(np.int64)
    open_ = np.stack([ring >> 2 * s & 1 == 0 for s in range(4)], axis=1)
    pixel, side = np.nonzero(open_)
    place = np.full(open_.shape, -1)
    place[pixel, side] = np.arange(len(pixel))
    ahead, diagonal = ring[pixel] >> (2 * side + 2) % 8 & 1, ring[pixel] >> 2 * side + 1 & 1
    way = np.where(diagonal, 2 * side + 1, (2 * side + 2) % 8)
    target = np.where((diagonal | ahead) == 1, p.near[way, pixel], pixel)
    after = place[target, np.where(diagonal, side + 3, np.where(ahead, side, side + 1)) % 4]
    first, jump = np.arange(len(after)), after
    while (less := np.minimum(first, first[jump]) < first).any():
        first, jump = np.where(less, first[jump], first), jump[jump]
    start = first == np.arange(len(after))
    left, jump = np.where(start, 0, 1), np.where(start, np.arange(len(after)), after)
    while (more := left[jump]).any():
        left, jump = left + more, jump[jump]
    # twice the area inside the sides; it is negative round a hole
    cross = np.select([side == 0, side == 1, side == 2], [-y[pixel], x[pixel] + 1, y[pixel] + 1], -x[pixel])
    length = np.bincount(first, minlength=len(after))
    hole = np.bincount(first, weights=cross, minlength=len(after)) < 0
    # borders by component, outer ones first, then by their first pixel
    heads = np.flatnonzero(start)
    heads = heads[np.lexsort((heads, hole[heads], root[pixel[heads]]))]
    rank = np.zeros(len(after), np.int64)
    rank[heads] = np.arange(len(heads))
    by = np.lexsort((-left % length[first], rank[first]))
    own, at = rank[first[by]], pixel[by]
    begins = np.r_[True, own[1:] != own[:-1]][: len(own)]
    new = begins | np.r_[True, at[1:] != at[:-1]][: len(own)]
    last = np.flatnonzero(np.r_[begins[1:], True][: len(own)])
    # a border that comes back to its first pixel at the end names it once
    n = np.bincount(own[new], minlength=len(heads))
    back = np.flatnonzero((at[last] == at[np.flatnonzero(begins)]) & (n > 1))
    put, run_ = np.flatnonzero(new), own[new]
    final = np.flatnonzero(np.r_[run_[1:] != run_[:-1], True][: len(run_)])
    put = np.delete(put, final[back])
    px, py, of_path = x[at[put]], y[at[put]], own[put]
    n = np.bincount(of_path, minlength=len(heads))
    ends, begin = np.cumsum(n), np.cumsum(n) - n
    following = np.arange(1, len(put) + 1)
    following[ends - 1] = begin
    turn = px * py[following] - py * px[following]
    area = np.abs(np.add.reduceat(turn, begin) if len(turn) else turn) / 2
    east = side[by] == 1
    component = root[pixel[heads]]
    fresh = np.flatnonzero(np.r_[True, component[1:] != component[:-1]][: len(heads)])
    contour = np.arange(len(heads)) - np.repeat(fresh, np.diff(np.r_[fresh, len(heads)]))
    return {
        "of": component, "contour": contour, "hole": hole[heads], "area": area,
        "path": _points(n, py, px), "east": _points(np.bincount(own[east], minlength=len(heads)), y[at[east]], x[at[east]]),
    }


def _points(n: np.ndarray, y: np.ndarray, x: np.ndarray) -> pa.Array:
    """Lists of n points each."""
    points = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (y, x)], fields=list(_PIXELS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), points, type=_PIXELS)


def contours(mask: DataFrame) -> DataFrame:
    """(segment_id, root_y, root_x, contour, hole, area, path, east) of every border of a mask (segment_id, y, x).

    contour numbers the borders of a component, the outer one being 0; area is that of the polygon through the pixels
    of the path; east lists pixels whose eastern side is on the border. Components within a band are followed with it, many at once;
    of those that go on in another band the outlines are put together first, and a task holds one of them at least.
    """
    types = dict(mask.dtypes)
    corner = f"root_y {types['y']}, root_x {types['x']}"
    border = "contour int, hole boolean, area double, path array<struct<y:int,x:int>>, east array<struct<y:int,x:int>>"
    kinds = {"contour": pa.int32(), "hole": pa.bool_(), "area": pa.float64(), "path": _PIXELS, "east": _PIXELS}

    def run(p: Pixels, own: np.ndarray) -> dict:
        ring, root = p.ring(), p.roots(own)
        goes_on = p.spread(own & (p.ring(~own) > 0), root)
        outline = ring & _SIDES != _SIDES
        within = np.flatnonzero(own & outline & ~goes_on)
        # rows next to another band tell which components meet there
        open_ = np.flatnonzero(own & goes_on & (outline | (p.y % BAND == 0) | (p.y % BAND == BAND - 1)))
        place = np.zeros(p.n, np.int64)
        place[within] = np.arange(len(within))
        # a component's first pixel is of its outline
        out = borders(Pixels(p.image[within], p.y[within], p.x[within]), place[root[within]], ring[within])
        of = within[out.pop("of")]
        both = {"of": np.concatenate([of, open_])}
        both |= {c: np.concatenate([w[of], w[root[open_]]]) for c, w in (("root_y", p.y), ("root_x", p.x))}
        both |= {c: pa.concat_arrays([pa.array(out[c], t), pa.nulls(len(open_), t)]) for c, t in kinds.items()}
        return both | {c: pa.concat_arrays([pa.nulls(len(of), pa.int32()), pa.array(w[open_], pa.int32())]) for c, w in (("y", p.y), ("x", p.x), ("ring", ring))}

    made = held(in_bands(mask, ["segment_id"], 1, run, f"{corner}, {border}, y int, x int, ring int"), "contours")
    found = made.where("ring is null").select(*KEY, *kinds)
    left = made.where("ring is not null").select("segment_id", F.col("root_y").alias("ly"), F.col("root_x").alias("lx"), "y", "x", "ring")
    if left.isEmpty():
        return found

    def whole(table: pa.Table, starts: np.ndarray) -> dict:
        ring, y, x = (table[c].to_numpy() for c in ("ring", "y", "x"))
        size = np.diff(np.append(starts, len(y)))
        out = borders(Pixels(np.repeat(np.arange(len(starts)), size), y, x), np.repeat(starts, size), ring)
        at = pa.array(out.pop("of"))
        return out | {k: table[k].combine_chunks().take(at) for k in KEY}

    outlines = rooted(left, ["segment_id"]).where(F.col("ring").bitwiseAND(_SIDES) != _SIDES)
    across = held(by_groups(outlines, KEY, whole, f"segment_id {types['segment_id']}, {corner}, {border}", ["y", "x"]), "contours")
    return found.unionByName(across)


def hierarchy(found: DataFrame) -> DataFrame:
    """(segment_id, root_y, root_x, contour, hole, area, parent): the contour right outside each one, null for the outermost.

    A hole's parent is its component's outer border. An outer border looks west from its first pixel: a hole's border
    met there is its parent, an outer one a sibling, whose parent it shares. Chains of siblings are halved each round.
    """
    me = F.struct("root_y", "root_x", "contour")
    east = found.select("segment_id", F.explode("east").alias("p"), F.struct("hole", me.alias("id")).alias("met"))
    east = east.select("segment_id", "p.y", "p.x", F.lit(0).alias("first"), "met", F.lit(None).cast(dict(found.select(me.alias("m")).dtypes)["m"]).alias("id"))
    outer = found.where("not hole").select("segment_id", F.col("path")[0]["y"].alias("y"), (F.col("path")[0]["x"] - 1).alias("x"), F.lit(1).alias("first"), F.lit(None).cast(dict(east.dtypes)["met"]).alias("met"), me.alias("id"))
    seen = F.last("met", ignorenulls=True).over(Window.partitionBy("segment_id", "y").orderBy("x", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    west = held(east.union(outer).withColumn("met", seen).where("first = 1").select("segment_id", "id", "met"), "west")
    # done: `at` is the parent, or nothing lies outside
    chains = held(west.select("segment_id", "id", F.col("met.id").alias("at"), (F.col("met").isNull() | F.col("met.hole")).alias("done")), "chains")
    while not chains.where("not done").isEmpty():
        ahead = chains.select("segment_id", F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("ends"))
        open_ = chains.where("not done").join(ahead, ["segment_id", "at"]).select("segment_id", "id", F.col("next").alias("at"), F.col("ends").alias("done"))
        chains = held(chains.where("done").union(open_), "chains")
    parents = found.where("hole").select("segment_id", me.alias("id"), F.struct("root_y", "root_x", F.lit(0).alias("contour")).alias("parent")).union(chains.select("segment_id", "id", "at"))
    return found.select("segment_id", me.alias("id"), "hole", "area").join(parents, ["segment_id", "id"]).select("segment_id", "id.*", "hole", "area", "parent")
