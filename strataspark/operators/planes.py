"""Planes through points, nearest neighbours, directions and rendered traces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.groups import by_groups
from strataspark.functions.shared import held


def let(values: dict[str, Column], body) -> Column:
    """body of a struct of values that are computed once, however often the body uses them."""
    return F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), body)[0]


_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _normal_of_least_spread(s: Column) -> Column:
    """(x, y, z, size) of the eigenvector to the least eigenvalue of the covariance s, in closed form.

    The longest of the three cross products of rows of the matrix less that eigenvalue.
    """

    def scaled(m: Column) -> Column:
        s = m["s"]
        off = s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"]
        dev = [s[k] - m["mean"] for k in ("xx", "yy", "zz")]
        return let({"s": s, "mean": m["mean"], "spread": F.sqrt((dev[0] * dev[0] + dev[1] * dev[1] + dev[2] * dev[2] + 2 * off) / 6)}, angled)

    def angled(m: Column) -> Column:
        b = {k: (m["s"][k] - (m["mean"] if k[0] == k[1] else 0.0)) / m["spread"] for k in _PAIRS}
        det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
        least = m["mean"] + 2 * m["spread"] * F.cos(angle + 2.0943951023931953)
        return let({"s": m["s"], "least": least}, crossed)

    def crossed(m: Column) -> Column:
        v = {k: m["s"][k] - (m["least"] if k[0] == k[1] else 0.0) for k in _PAIRS}
        rows = ((v["xx"], v["xy"], v["xz"]), (v["xy"], v["yy"], v["yz"]), (v["xz"], v["yz"], v["zz"]))
        out = []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            a, d = rows[i], rows[j]
            cross = {"x": a[1] * d[2] - a[2] * d[1], "y": a[2] * d[0] - a[0] * d[2], "z": a[0] * d[1] - a[1] * d[0]}
            out.append(let(cross, lambda c: F.struct((c["x"] * c["x"] + c["y"] * c["y"] + c["z"] * c["z"]).alias("size2"), c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"))))
        return F.array_max(F.array(*out))

    return let({"s": s, "mean": (s["xx"] + s["yy"] + s["zz"]) / 3}, scaled)


def fit_planes(points: DataFrame, keys: list[str], x: Column, y: Column, z: Column) -> DataFrame:
    """Centroid and unit normal (n_x, n_y, n_z with n_z >= 0) of the best plane of each group, from its covariance.

    Null where points lie on a line.
    """
    p = points.select(*keys, x.alias("px"), y.alias("py"), z.alias("pz"))
    c = p.groupBy(*keys).agg(
        F.count("*").alias("n_px"),
        *(F.avg(f"p{a}").alias(f"c_{a}") for a in "xyz"),
        F.struct(*(F.covar_pop(f"p{k[0]}", f"p{k[1]}").alias(k) for k in _PAIRS)).alias("s"),
    )
    size = F.sqrt("v.size2")
    up = F.when(F.col("v.z") < 0, -1.0).otherwise(1.0)
    return c.withColumn("v", _normal_of_least_spread(F.col("s"))).select(*keys, "n_px", "c_x", "c_y", "c_z", *(F.when(size > 1e-12, up * F.col(f"v.{n}") / size + 0.0).alias(f"n_{n}") for n in "xyz"))


def axis_crossings(planes: DataFrame, radius: Column, length: Column, steepest: float = 0.10) -> DataFrame:
    """Planes with `center` on the axis x = y = 0, without near-vertical ones and those that cross far outside.

    A plane stays when |n_z| >= steepest and -3 r <= center <= length + 3 r.
    """
    kept = planes.where(F.abs("n_z") >= steepest)
    center = (F.col("n_x") * F.col("c_x") + F.col("n_y") * F.col("c_y") + F.col("n_z") * F.col("c_z")) / F.col("n_z")
    return kept.withColumn("center", center).where((F.col("center") >= -3 * radius) & (F.col("center") <= length + 3 * radius))


def directions(points: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    """The direction (in [0, 180) degrees) of least spread of each group's points: across a branch."""
    c = points.groupBy(key).agg(F.covar_pop(x, x).alias("a"), F.covar_pop(x, y).alias("b"), F.covar_pop(y, y).alias("d"))
    along = F.degrees(0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("d")))
    return c.select(key, F.pmod(along + 90.0, F.lit(180.0)).alias("normal_deg"))


#: Positions that a cell of the finest grid holds at most, and how often a group's span is halved at most for that.
CROWDED, HALVINGS = 64, 30


def _located(points: DataFrame, group: str, identity: str, coordinates: list[str], k: int) -> DataFrame:
    """Different positions of each group with their first k identities, their offset in the group's span, and a level.

    The span halved `level` times is the side of the group's finest cells: k positions a cell on average, and none
    crowded, as far as halving helps.
    """
    on = [group, *coordinates]
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(identity))
    firsts = points.withColumn("r_", rank).where(F.col("r_") <= k).groupBy(*on).agg(F.sort_array(F.collect_list(identity)).alias("ids_"))
    positions = held(firsts, "positions")
    stats = positions.groupBy(group).agg(F.count("*").alias("n_"), *(F.min(c).alias(f"low{i}_") for i, c in enumerate(coordinates)), F.greatest(*(F.max(c) - F.min(c) for c in coordinates), F.lit(0.0)).alias("span_"))
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col("n_") / k) / len(coordinates))).cast("int")
    offsets = [(F.col(c) - F.col(f"low{i}_")).alias(f"off{i}_") for i, c in enumerate(coordinates)]
    out = held(positions.join(stats.withColumn("level_", F.when(F.col("span_") > 0, level).otherwise(0)), group).select(*on, "ids_", *offsets, "span_", "level_"), "located")
    while True:
        crowded = out.where(F.col("level_").between(1, HALVINGS - 1)).groupBy(group, *_cell(len(coordinates), 0)).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select(group, F.lit(2).alias("more_")).distinct()
        if crowded.isEmpty():
            return out
        out = held(out.join(crowded, group, "left").withColumn("level_", F.col("level_") + F.coalesce("more_", F.lit(0))).drop("more_"), "located")


def _cell(dimensions: int, up: int) -> list[Column]:
    """Cell numbers of located positions, `up` levels above their finest."""
    size = F.col("span_") / F.pow(F.lit(2.0), F.col("level_") - up)
    return [F.when(F.col("span_") > 0, F.floor(F.col(f"off{i}_") / size)).otherwise(0).cast("long").alias(f"cell{i}_") for i in range(dimensions)]


#: Points of a group that are all held against each other.
SMALL = 1024


def _nearest_of_small(points: DataFrame, asked: DataFrame | None, group: str, identity: str, coordinates: list[str], k: int) -> DataFrame:
    """nearest for groups of up to SMALL points: dealt once by group, each group's distances in one go."""
    types, every = dict(points.dtypes), asked is None
    rows = points.withColumn("asked_", F.lit(True)) if every else points.withColumn("asked_", F.lit(False)).unionByName(asked.withColumn("asked_", F.lit(True)))

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        places, asks = [table[c].to_numpy() for c in coordinates], table["asked_"].to_numpy()
        of, to, rank, far = [], [], [], []
        for a, b in zip(starts, np.append(starts[1:], len(asks)), strict=True):
            q = a + np.flatnonzero(asks[a:b])
            c = np.arange(a, b) if every else a + np.flatnonzero(~asks[a:b])
            d = np.zeros((len(q), len(c)))
            for p in places:
                d += (p[q][:, None] - p[c]) ** 2
            # rows come by identity, so of equal distances the first counts
            first = np.argsort(d, axis=1, kind="stable")[:, :k]
            of.append(np.repeat(q, first.shape[1]))
            to.append(c[first].ravel())
            rank.append(np.tile(np.arange(1, first.shape[1] + 1), len(q)))
            far.append(np.take_along_axis(d, first, 1).ravel())
        of, to, rank, far = map(np.concatenate, (of, to, rank, far))
        take = lambda c, at: table[c].combine_chunks().take(pa.array(at))
        return {group: take(group, of), identity: take(identity, of), "neighbour": take(identity, to), "rank": rank, "distance2": far}

    return by_groups(rows, [group], run, f"`{group}` {types[group]}, `{identity}` {types[identity]}, neighbour {types[identity]}, rank int, distance2 double", [identity])


def nearest(points: DataFrame, group: str, identity: str, coordinates: list[str], k: int = 4, of: DataFrame | None = None) -> DataFrame:
    """The k nearest points (with itself) of each point within its group, by squared distance, then id.

    of: the points to search for, all by default. Points with a null coordinate are left out. Groups of up to SMALL points are
    dealt once; the others go through a grid, where equal positions are searched once. A
    round looks into the cells around a position's own; what lies further is at least a cell's side away, so
    a position is done when its k-th distance is less, and goes on with cells of twice the side if not, until they
    span the group. So a position meets about as many others as a few cells hold, however large its group is.
    """
    on, d = [group, *coordinates], len(coordinates)
    known = lambda df: df.select(group, identity, *(F.col(c).cast("double").alias(c) for c in coordinates)).dropna(subset=coordinates)
    points, asked = known(points), None if of is None else known(of)
    large = held(points.groupBy(group).agg(F.count("*").alias("n_")).where(F.col("n_") > SMALL).select(group), "large")
    if large.isEmpty():
        return _nearest_of_small(points, asked, group, identity, coordinates, k)
    part = lambda df, how: df.join(large, group, how)
    small = _nearest_of_small(part(points, "left_anti"), None if asked is None else part(asked, "left_anti"), group, identity, coordinates, k)
    points, of = part(points, "left_semi"), part(points if asked is None else asked, "left_semi")
    located = _located(points, group, identity, coordinates, k)
    cells, names = [f"cell{i}_" for i in range(d)], [f"{c}_q" for c in coordinates]
    steps = [()]
    for _ in range(d):
        steps = [(*s, m) for s in steps for m in (-1, 0, 1)]
    around = F.array(*(F.struct(*(F.lit(m).alias(f"d{i}") for i, m in enumerate(s))) for s in steps))
    far = sum(((F.col(q) - F.col(c)) * (F.col(q) - F.col(c)) for q, c in zip(names, coordinates, strict=True)), F.lit(0.0))
    left = held(located.join(of.select(*on).distinct(), on, "left_semi").select(group, *(F.col(c).alias(q) for c, q in zip(coordinates, names, strict=True)), *(f"off{i}_" for i in range(d)), "span_", "level_"), "searched")
    done, up = None, 0
    while done is None or not left.isEmpty():
        asked = left.select(group, *names, *_cell(d, up), F.explode(around).alias("s_")).select(group, *names, *((F.col(c) + F.col(f"s_.d{i}")).alias(c) for i, c in enumerate(cells)))
        there = located.where(F.col("level_") >= up).select(*on, "ids_", *_cell(d, up))
        met = asked.join(there, [group, *cells]).select(group, *names, far.alias("distance2"), F.explode("ids_").alias("neighbour"))
        rank = F.row_number().over(Window.partitionBy(group, *names).orderBy("distance2", "neighbour"))
        best = met.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(group, *names).agg(F.collect_list(F.struct("rank", "neighbour", "distance2")).alias("found_"), F.max("distance2").alias("far_"))
        side = F.col("span_") / F.pow(F.lit(2.0), F.col("level_") - up)
        ends = (F.col("level_") <= up) | ((F.size("found_") >= k) & (F.sqrt("far_") < side * (1 - 1e-9)))
        both = held(left.join(best, [group, *names]).withColumn("ends_", ends), "found")
        new = both.where("ends_").select(group, *names, "found_")
        done = new if done is None else done.union(new)
        left, up = both.where("not ends_").drop("found_", "far_", "ends_"), up + 1
    named = done.select(group, *(F.col(q).alias(c) for c, q in zip(coordinates, names, strict=True)), F.explode("found_").alias("f_"))
    return small.unionByName(of.join(named, on).select(group, identity, "f_.neighbour", "f_.rank", "f_.distance2"))


def trace_points(planes: DataFrame, width: int, center: Column, radius: Column, dip: Column, azimuth: Column) -> DataFrame:
    """The row of each plane's trace in each of `width` columns: center + r tan(dip) cos(theta - azimuth), cut towards zero."""
    theta = F.col("column") * (2 * 3.141592653589793 / width)
    z = center + radius * F.tan(F.radians(dip)) * F.cos(theta - F.radians(azimuth))
    return planes.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("row", F.round(z, 6).cast("long"))


def letterbox(df: DataFrame, width: Column, height: Column, to: int = 512) -> DataFrame:
    """Size and place of an image scaled to fit a square, centred (rounded down)."""
    scale = F.least(to / width, to / height)
    df = df.withColumn("new_w", (width * scale).cast("int")).withColumn("new_h", (height * scale).cast("int"))
    return df.withColumn("left_px", F.floor((to - F.col("new_w")) / 2).cast("int")).withColumn("top_px", F.floor((to - F.col("new_h")) / 2).cast("int"))
