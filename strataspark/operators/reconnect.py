"""Reconnection of broken traces: endpoints grow discs ahead until their skeleton meets that of the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataspark.functions.groups import codes, in_tables
from strataspark.functions.shared import held

from .branches import branch_paths
from .raster import BAND, THINS, Pixels, _band, _encoded, _joined, _order, _pack, _thin, _unique, at_borders, band_of, grouped, label_components, mixed_class, packed_alone, packed_bands, rooted, skeletonize

ON = ["segment_id", "y", "x"]
#: The step at which a pixel goes that stays.
NEVER = 1 << 40
#: Pixels of ends' own parts that are held together.
PAIRS = 1 << 21


def path_ends(paths: DataFrame, reference: int = 50) -> DataFrame:
    """Free ends of branches with the pixel `reference` steps back and the direction ahead (unit vector, y and x).

    Ends of branches that are not longer than that are left out; junction pixels count as part of a branch, but
    are no ends.
    """
    key = ["segment_id", "root_y", "root_x"]
    types = dict(paths.dtypes)
    named = ", ".join(f"{c} {types[c]}" for c in key)
    last = F.col("n_px") - 1
    marks = [F.lit(0), F.lit(reference), last, last - reference]
    free = paths.where((F.col("branch_type") < 2) & (F.col("n_px") > reference) & F.col("pos").isin(*marks)).select(*key, "n_px", "pos", "y", "x", "joint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Branches whose four places are all in a batch, a row each, and the places of the others."""
        for table in in_tables(batches):
            code, pos, n = codes(table, key), table["pos"].to_numpy().astype(np.int64), table["n_px"].to_numpy()
            order = np.lexsort((pos, code))
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            of, n = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)])), n[order[first]]
            known = of * (1 << 32) + pos[order]
            at, there = _found(known, np.arange(len(first)) * (1 << 32) + np.stack([0 * n, reference + 0 * n, n - 1, n - 1 - reference]))
            whole = there.all(axis=0)
            left = order[~whole[of]]
            rows = pa.array(np.r_[order[first[whole]], left])
            made = {c: table[c].combine_chunks().take(rows) for c in [*key, "n_px", "pos", "y", "x", "joint"]}
            for i, mark in enumerate(_MARKS):
                place = pa.array(np.r_[order[at[i][whole]], np.zeros(len(left), np.int64)], mask=np.arange(len(rows)) >= whole.sum())
                got = [table[c].combine_chunks().take(place) for c in ("y", "x", "joint")]
                made[mark] = pa.StructArray.from_arrays(got, fields=list(_MARK), mask=pa.array(np.arange(len(rows)) >= whole.sum()))
            yield pa.RecordBatch.from_pydict(made)

    mark = "struct<y:int,x:int,joint:boolean>"
    schema = f"{named}, n_px {types['n_px']}, pos {types['pos']}, y int, x int, joint boolean, " + ", ".join(f"{m} {mark}" for m in _MARKS)
    found = free.withColumns({c: F.col(c).cast("int") for c in "yx"}).mapInArrow(run, schema)
    at = lambda p: F.min(F.when(F.col("pos") == p, F.struct("y", "x", "joint")))
    cut = found.where("a_ is null").groupBy(*key).agg(*(at(p if i < 2 else F.col("n_px") - 1 - (0 if i == 2 else reference)).alias(m) for i, (m, p) in enumerate(zip(_MARKS, marks, strict=True))))
    one = found.where("a_ is not null").select(*key, *_MARKS).unionByName(cut)
    pair = lambda end, ref: F.struct(F.col(end).alias("end"), F.col(ref).alias("ref"))
    ends = one.select("segment_id", F.explode(F.array(pair("a_", "b_"), pair("c_", "d_"))).alias("e")).where("not e.end.joint")
    ends = ends.select("segment_id", F.col("e.end.y").alias("y"), F.col("e.end.x").alias("x"), F.col("e.ref.y").alias("ref_y"), F.col("e.ref.x").alias("ref_x"))
    return ends.withColumns(_derived())


#: The first pixel of a branch, the one `reference` steps on, and the same from its last.
_MARKS = ("a_", "b_", "c_", "d_")
_MARK = pa.struct([("y", pa.int32()), ("x", pa.int32()), ("joint", pa.bool_())])


def _derived() -> dict[str, Column]:
    """What path_ends tells of an end by its place and its reference pixel."""
    dy, dx = F.col("y") - F.col("ref_y"), F.col("x") - F.col("ref_x")
    size = F.sqrt((dy * dy + dx * dx).cast("double")) + 1e-8
    return {"dir_y": dy / size, "dir_x": dx / size, "endpoint_id": F.xxhash64("segment_id", "y", "x")}


def _slim(ends: DataFrame) -> DataFrame:
    """ends without the values that follow from others, which need not travel; _filled puts them back."""
    if not {"ref_y", "ref_x"} <= set(ends.columns):
        return ends
    return ends.withColumns({c: F.when(F.col(c) != v, F.col(c)) for c, v in _derived().items()})


def _filled(ends: DataFrame) -> DataFrame:
    if not {"ref_y", "ref_x"} <= set(ends.columns):
        return ends
    return ends.withColumns({c: F.coalesce(F.col(c), v) for c, v in _derived().items()})


def _ahead(e: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """dir_y and dir_x of ends that travelled."""
    known = [e.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("dir_y", "dir_x")]
    if e.type.get_field_index("ref_y") < 0:
        return tuple(known)
    steps = [e.field(c).to_numpy().astype(np.int64) - e.field(f"ref_{c}").to_numpy() for c in "yx"]
    size = np.sqrt((steps[0] ** 2 + steps[1] ** 2).astype(float)) + 1e-8
    return tuple(np.where(np.isnan(k), d / size, k) for k, d in zip(known, steps, strict=True))


def local_widths(ends: DataFrame, mask: DataFrame, most: int = 100) -> DataFrame:
    """ends with width: steps within the mask to both sides of the reference pixel; wider ones are left out.

    Pixels travel packed, and each end meets those of the rows that its steps can reach.
    """
    if most + 2 > BAND:
        return _widths_by_steps(ends, mask, most)
    columns = [c for c in ends.columns if c != "segment_id"]
    here = _slim(ends).select("segment_id", F.struct(*columns).alias("e_"), band_of(F.col("ref_y")).alias("band_"), F.col("ref_y").alias("y"), F.col("ref_x").alias("x"))
    both = packed_bands(mask, ["segment_id"], most + 2).unionByName(packed_alone(here, ["segment_id", "e_"]), allowMissingColumns=True)

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        y, x = (table[c].to_numpy().astype(np.int64) for c in "yx")
        e = table["e_"].combine_chunks()
        is_end = e.is_valid().to_numpy(zero_copy_only=False)
        at, own = np.flatnonzero(is_end), np.flatnonzero(~is_end)
        e = e.take(pa.array(at))
        (oy, tall), (ox, wide) = ((int(c.min()) - most - 2, int(c.max() - c.min()) + 2 * most + 5) for c in (y, x))
        code = lambda g, y, x: (g * tall + (y - oy)) * wide + (x - ox)
        known = _unique(code(image[own], y[own], x[own]))
        dy, dx = _ahead(e)
        total, good = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for side in (-1, 1):
            left = np.arange(len(at))
            for k in range(1, most + 2):
                qy, qx = (np.rint(c[at[left]] + side * k * d[left]).astype(np.int64) for c, d in ((y, dx), (x, -dy)))
                inside = _found(known, code(image[at[left]], qy, qx))[1]
                total[left[~inside]] += k - 1
                left = left[inside]
            good[left] = False
        kept = np.flatnonzero(good & (total <= most))
        return {"segment_id": table["segment_id"].combine_chunks().take(pa.array(at[kept])), "e_": e.take(pa.array(kept)), "width": total[kept]}

    types = dict(here.dtypes)
    found = grouped(both, ["segment_id", "band_"], run, f"segment_id {types['segment_id']}, e_ {types['e_']}, width int")
    return _filled(found.select("segment_id", "e_.*", "width"))


def _widths_by_steps(ends: DataFrame, mask: DataFrame, most: int) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1), F.lit(most + 1)))
    walk = ends.select("endpoint_id", "segment_id", "ref_y", "ref_x", "dir_y", "dir_x", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).withColumn("k", k)
    walk = walk.withColumn("y", F.rint(F.col("ref_y") + F.col("side") * F.col("k") * F.col("dir_x")).cast("int")).withColumn("x", F.rint(F.col("ref_x") - F.col("side") * F.col("k") * F.col("dir_y")).cast("int"))
    first = walk.join(mask.select(*ON), ON, "left_anti").groupBy("endpoint_id", "side").agg((F.min("k") - 1).alias("steps"))
    width = first.groupBy("endpoint_id").agg(F.sum("steps").cast("int").alias("width"), F.count("*").alias("sides")).where("sides = 2")
    return ends.join(width.select("endpoint_id", "width"), "endpoint_id").where(F.col("width") <= most)


def discs(ends: DataFrame, steps: int | Column, height: int | Column, width: int) -> DataFrame:
    """(endpoint_id, segment_id, k, y, x): filled discs at steps 0..steps, whose centres lie on the image.

    steps and height are numbers, or columns of ends.
    """
    r = F.rint(F.col("width") / 2).cast("int")
    bottom = (F.lit(height) if isinstance(height, int) else height) - 1
    d = ends.withColumns({"r": r, "bottom_": bottom}).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps) if isinstance(steps, int) else steps)))
    ahead = lambda c, v: F.rint(F.col(c) + F.col("k") * F.col(v) * F.col("width") / 2).cast("int")
    d = d.withColumn("cy", ahead("y", "dir_y")).withColumn("cx", ahead("x", "dir_x")).where((F.col("cy") >= 0) & (F.col("cy") <= F.col("bottom_")) & F.col("cx").between(0, width - 1))
    d = d.withColumn("oy", F.explode(F.sequence(-F.col("r"), F.col("r")))).withColumn("ox", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    d = d.where(F.col("oy") * F.col("oy") + F.col("ox") * F.col("ox") <= F.col("r") * F.col("r"))
    d = d.select("endpoint_id", "segment_id", "k", (F.col("cy") + F.col("oy")).alias("y"), (F.col("cx") + F.col("ox")).alias("x"), "bottom_")
    return d.where((F.col("y") >= 0) & (F.col("y") <= F.col("bottom_")) & F.col("x").between(0, width - 1)).drop("bottom_")


def _discs_of(ends: dict[str, np.ndarray], steps: int, width: int) -> tuple[np.ndarray, ...]:
    """end, k, y, x: the pixels of `discs`, and how many discs each end has."""
    r = np.rint(ends["width"] / 2).astype(np.int64)
    out, n = [(np.empty(0, np.int64),) * 4], np.zeros(len(r), np.int64)
    for k in range(steps + 1):
        cy, cx = (np.rint(ends[c] + k * ends[f"dir_{c}"] * ends["width"] / 2).astype(np.int64) for c in "yx")
        there = (cy >= 0) & (cy <= ends["bottom"]) & (cx >= 0) & (cx < width)
        n += there
        for size in np.unique(r[there]):
            own = np.flatnonzero(there & (r == size))
            oy, ox = (c.ravel() for c in np.mgrid[-size : size + 1, -size : size + 1])
            round_ = oy * oy + ox * ox <= size * size
            e = np.repeat(own, round_.sum())
            y, x = (np.add.outer(c[own], o[round_]).ravel() for c, o in ((cy, oy), (cx, ox)))
            on = (y >= 0) & (y <= ends["bottom"][e]) & (x >= 0) & (x < width)
            out.append((e[on], np.full(on.sum(), k), y[on], x[on]))
    return *(np.concatenate(c) for c in zip(*out, strict=True)), n


def _deaths(p: Pixels, among: np.ndarray) -> np.ndarray:
    """The step of thinning (two a round) that deletes each pixel of those marked, NEVER for those that stay, -1 for the rest and for no pixel."""
    when = np.append(np.where(among, NEVER, -1), -1)
    due, step = [np.flatnonzero(among)] * 2, 0
    while len(due[0]) or len(due[1]):
        at, due[step % 2] = due[step % 2][when[due[step % 2]] == NEVER], due[0][:0]
        gone = at[THINS[step % 2][_ring(when[p.near[:, at]] == NEVER)]]
        when[gone] = step
        again = np.zeros(p.n + 1, bool)
        again[p.near[:, gone]] = True
        again = np.flatnonzero(again & (when == NEVER)) if len(gone) else due[0][:0]
        due, step = [_unique(np.concatenate([d, again])) if len(d) else again for d in due], step + 1
    return when


def _ring(on: np.ndarray) -> np.ndarray:
    return (on.astype(np.int64) << np.arange(8)[:, None]).sum(axis=0)


def _found(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys among sorted ones, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
    return at, keys[at] == want if len(keys) else np.zeros(want.shape, bool)


def _differing(p: Pixels, when: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (end * (n + 1) + pixel) whose thinning may differ from that of the whole, and whether they stay.

    removed: keys of pixels that each end's mask lacks. A pixel goes as in the whole (when), unless a neighbour has gone at another step or
    was never there, so only such pixels are thinned for an end.
    """
    n = p.n + 1
    keys = _unique(removed)
    alive, told = np.zeros((2, len(keys)), bool)
    last, step, quiet = int(when[when < NEVER].max(initial=-1)), 0, 0
    while step <= last or quiet < 2:
        # what lives around a pixel is known from the first step at which it differs
        fresh = np.flatnonzero((alive != (when[keys % n] >= step)) & ~told)
        told[fresh] = True
        other = keys[fresh]
        near = p.near[:, other % n]
        new = _unique((other // n * n + near)[(near < p.n) & (when[near] >= step)])
        new = new[~_found(keys, new)[1]]
        if len(new):
            keys, alive, told = np.append(keys, new), np.append(alive, np.ones(len(new), bool)), np.append(told, np.zeros(len(new), bool))
            order = np.argsort(keys, kind="stable")
            keys, alive, told = keys[order], alive[order], told[order]
        at = np.flatnonzero(alive)
        near = p.near[:, keys[at] % n]
        place, there = _found(keys, keys[at] // n * n + near)
        gone = at[THINS[step % 2][_ring(np.where(there & (near < p.n), alive[place], when[near] >= step))]]
        alive[gone] = False
        quiet = quiet + 1 if step > last and not len(gone) else 0
        step += 1
    return keys, alive


def _grown(p: Pixels, mask: np.ndarray, end_at: np.ndarray, discs_of: tuple[np.ndarray, np.ndarray, np.ndarray], n_discs: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends that can meet something, and the discs by which each grows; see growth_counts.

    end_at: the pixel of each end; discs_of: end, k and pixel of its discs.
    """
    part, own = p.roots(mask), np.full(len(end_at), -1)
    own[mask[end_at]] = part[end_at[mask[end_at]]]
    n = p.n + 1
    end, k, at = (c[own[discs_of[0]] >= 0] for c in discs_of)
    order = np.lexsort((k, at, end))
    end, k, at = end[order], k[order], at[order]
    first = np.flatnonzero(np.r_[True, (end[1:] != end[:-1]) | (at[1:] != at[:-1])][: len(end)])
    ahead = _unique((end * n + at)[k > 0])
    # an end meets a part, or a disc ahead of an end on another part; a pixel tells by its least and its greatest part
    e, q = ahead // n, ahead % n
    least, most = np.full(p.n, p.n), np.full(p.n, -1)
    np.minimum.at(least, q, own[e])
    np.maximum.at(most, q, own[e])
    meets = np.zeros(len(own), bool)
    meets[e[(mask[q] & (part[q] != own[e])) | (least[q] != most[q])]] = True
    ahead = ahead[meets[e]]
    end, k, at = end[first], k[first], at[first]
    end, k, at = (c[meets[end]] for c in (end, k, at))
    covers = np.bincount(ahead % n, minlength=p.n)
    when = _deaths(p, mask | (covers > 0))
    # pixels of each part
    by_part = np.flatnonzero(mask)[np.argsort(part[mask], kind="stable")]
    begin = np.searchsorted(part[by_part], np.arange(p.n))
    size = np.bincount(part[mask], minlength=p.n)
    some = np.flatnonzero(meets)
    portion = np.cumsum(size[own[some]]) // PAIRS
    rest = np.zeros(len(end), bool)
    for chunk in np.split(some, np.flatnonzero(np.diff(portion)) + 1):
        m = size[own[chunk]]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        whole = np.repeat(chunk, m) * n + by_part[np.repeat(begin[own[chunk]], m) + step]
        low, high = np.searchsorted(ahead, [chunk[0] * n, (chunk[-1] + 1) * n]) if len(chunk) else (0, 0)
        pair = _unique(np.concatenate([whole, ahead[low:high]]))
        e, q = pair // n, pair % n
        stays = (mask[q] & (part[q] != own[e])) | (covers[q] > _found(ahead, pair)[1])
        keys, alive = _differing(p, when, pair[~stays])
        mine = slice(*np.searchsorted(end, [chunk[0], chunk[-1] + 1])) if len(chunk) else slice(0, 0)
        place, there = _found(keys, end[mine] * n + at[mine])
        rest[mine] = np.where(there, alive[place] if len(keys) else False, when[at[mine]] == NEVER)
    free, touch = n_discs.copy(), np.full(len(own), steps + 1)
    contact = np.full(len(own), steps + 1)
    np.minimum.at(contact, end[rest], k[rest])
    other = mask[at] & (part[at] != own[end])
    np.minimum.at(touch, end[other], k[other])
    left = meets & (contact <= steps)
    for grown_ in range(steps + 1):
        due = left & (contact <= grown_) & (grown_ < n_discs)
        own_discs = np.flatnonzero(due[end] & (k <= grown_))
        if not len(own_discs):
            continue
        union = Pixels(end[own_discs], p.y[at[own_discs]], p.x[at[own_discs]])
        stays = _thin(union, np.full(union.n, union.n + 1))
        met = end[own_discs][stays & rest[own_discs]]
        free[met] = grown_
        left[met] = False
    count = np.where(free == steps + 1, np.where(touch <= steps, touch, 0), free)
    return some, count[some]


def growth_counts(ends: DataFrame, mask: DataFrame, steps: int, height: int | Column, width: int) -> DataFrame:
    """The ends that can meet something, with expand_count, the discs by which each grows.

    An end that can't meet a part or an end's discs on another part is left out. The others grow disc by disc from
    k = 0, until the skeleton of their discs meets the skeleton of the rest: the mask without their own part, and the
    discs ahead of all other such ends. Growth also ends at the image's border. Where all steps pass
    without contact, the count is the first k whose disc touches another part of the mask, or 0.

    Thinning never looks across a gap, so what hangs together, mask and discs, is dealt together, much of it to a task at once. There
    all of it is thinned once, and for each end only the pixels whose thinning differs because its own part and discs are not there. Mask
    and ends are dealt by bands: what hangs together within a band is done there, the rest is put together first.
    """
    placed = _slim(ends.withColumn("bottom_", ((F.lit(height) if isinstance(height, int) else height) - 1).cast("int")))
    columns = [c for c in placed.columns if c != "segment_id"]
    reach = F.ceil(F.col("width") * (steps + 1) / 2).cast("int") + 2
    low, high = F.greatest(F.least("y", F.lit(0)), F.col("y") - reach), F.least(F.greatest("y", "bottom_"), F.col("y") + reach)
    here = placed.select("segment_id", F.struct(*columns).alias("e_"), F.explode(F.sequence(band_of(low), band_of(high))).alias("band_"), "y", "x")
    both = packed_bands(mask, ["segment_id"]).unionByName(packed_alone(here, ["segment_id", "e_"]), allowMissingColumns=True)
    types, kind = dict(mask.dtypes), dict(here.dtypes)["e_"]

    def opened(table: pa.Table) -> tuple:
        y, x = (table[c].to_numpy().astype(np.int64) for c in "yx")
        found = table["e_"].combine_chunks()
        is_end = found.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(is_end)
        found = found.take(pa.array(at))
        e = {c: found.field(n).to_numpy().astype(float if c == "width" else np.int64) for c, n in (("y", "y"), ("x", "x"), ("width", "width"), ("bottom", "bottom_"))}
        return y, x, is_end, at, found, e | dict(zip(("dir_y", "dir_x"), _ahead(found), strict=True))

    def in_band(table: pa.Table, starts: np.ndarray) -> dict:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        y, x, is_end, at, found, e = opened(table)
        band = table["band_"].to_numpy()
        own = _band(e["y"].copy()) == band[at]
        end, k, dy, dx, n_discs = _discs_of(e, steps, width)
        here = np.flatnonzero(_band(dy.copy()) == band[at][end])
        busy, mine = np.flatnonzero(~is_end), np.flatnonzero(own)
        g, py, px = np.r_[group[busy], group[at[mine]], group[at][end[here]]], np.r_[y[busy], e["y"][mine], dy[here]], np.r_[x[busy], e["x"][mine], dx[here]]
        order = _order(g, py, px)
        p = Pixels(g[order], py[order], px[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(p.first) - 1
        m = len(busy)
        of_end, of_disc = np.full(len(at), -1), np.full(len(end), -1)
        of_end[mine], of_disc[here] = place[m : m + len(mine)], place[m + len(mine) :]
        marked = np.zeros(p.n, bool)
        marked[place[:m]] = True
        root = p.roots(np.ones(p.n, bool))
        ahead = p.spread(at_borders(p.y), root)
        source = np.zeros(p.n, np.int64)
        source[place] = np.r_[busy, at[mine], at[end[here]]]
        # what is whole here
        whole = np.flatnonzero(own & ~ahead[of_end])
        some = np.flatnonzero(~ahead & p.spread(np.isin(np.arange(p.n), of_end[whole]), root))
        to = np.full(p.n, -1)
        to[some] = np.arange(len(some))
        number = np.full(len(at), -1)
        number[whole] = np.arange(len(whole))
        its = np.flatnonzero(number[end] >= 0)
        made, count = _grown(Pixels(p.image[some], p.y[some], p.x[some]), marked[some], to[of_end[whole]], (number[end[its]], k[its], to[of_disc[its]]), n_discs[whole], steps) if len(whole) else (whole, whole)
        made = whole[made]
        # the rest: the mask's pixels, those next to another band, and the ends
        apart, waits = np.flatnonzero(ahead & (marked | at_borders(p.y))), np.flatnonzero(own & ahead[of_end])
        n = [len(made), len(apart), len(waits)]
        rows = np.r_[at[made], source[apart], at[waits]]
        pixel = np.r_[of_end[made], apart, of_end[waits]]
        part = pa.array(np.r_[np.zeros(n[0], bool), marked[apart], np.zeros(n[2], bool)])
        counts = pa.array(np.r_[count, np.zeros(n[1] + n[2], np.int64)], pa.int32(), mask=np.arange(sum(n)) >= n[0])
        e_ = found.take(pa.array(np.r_[made, np.zeros(n[1], np.int64), waits], mask=np.repeat([False, True, False], n)))
        return {"segment_id": table["segment_id"].combine_chunks().take(pa.array(rows)), "e_": e_, "expand_count": counts, "part": part,
                "y": p.y[pixel], "x": p.x[pixel], "ly": p.y[root[pixel]], "lx": p.x[root[pixel]]}

    schema = f"segment_id {types['segment_id']}, e_ {kind}, expand_count int, part boolean, y int, x int, ly int, lx int"
    made = held(grouped(both, ["segment_id", "band_"], in_band, schema), "growth")
    counts = made.where("expand_count is not null").select("segment_id", "e_", "expand_count")
    left = made.where("expand_count is null")
    if not left.isEmpty():
        counts = counts.unionByName(held(_across_bands(held(rooted(left, ["segment_id"]), "together"), opened, steps, width), "counted"))
    return _filled(counts.select("segment_id", "e_.*", "expand_count")).select(*ends.columns, "expand_count")


def _across_bands(together: DataFrame, opened, steps: int, width: int) -> DataFrame:
    """segment_id, e_ and expand_count of ends whose parts go on in another band; see growth_counts."""
    key, types = ["segment_id", "root_y", "root_x"], dict(together.dtypes)
    ends = together.where("e_ is not null").withColumn("band_", F.lit(0))
    both = packed_bands(together.where("part"), key).unionByName(packed_alone(ends, [*key, "e_"]), allowMissingColumns=True)

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        y, x, is_end, at, found, e = opened(table)
        of = table["segment_id"].combine_chunks()
        if not len(at):
            return {"segment_id": of.take(pa.array(at)), "e_": found, "expand_count": at}
        end, k, dy, dx, n_discs = _discs_of(e, steps, width)
        busy = np.flatnonzero(~is_end & (np.bincount(group[at], minlength=len(starts)) > 0)[group])
        g, py, px = np.r_[group[busy], group[at], group[at][end]], np.r_[y[busy], y[at], dy], np.r_[x[busy], x[at], dx]
        order = _order(g, py, px)
        p = Pixels(g[order], py[order], px[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(p.first) - 1
        m = len(busy)
        marked = np.zeros(p.n, bool)
        marked[place[:m]] = True
        some, count = _grown(p, marked, place[m : m + len(at)], (end, k, place[m + len(at) :]), n_discs, steps)
        return {"segment_id": of.take(pa.array(at[some])), "e_": found.take(pa.array(some)), "expand_count": count}

    return grouped(both, key, run, f"segment_id {types['segment_id']}, e_ {types['e_']}, expand_count int")


def growth_pixels(counted: DataFrame, height: int | Column, width: int) -> DataFrame:
    """Pixels (endpoint_id, segment_id, y, x) of the discs 0 to expand_count of each end; those of two discs may come twice."""
    return discs(counted, F.col("expand_count"), height, width).select("endpoint_id", *ON)


def packed_growth(counted: DataFrame, height: int | Column, width: int) -> DataFrame:
    """growth_pixels packed by band, for extensions: discs are drawn where ends are read."""
    bottom = ((F.lit(height) if isinstance(height, int) else height) - 1).cast("int")
    ends = counted.select("segment_id", "y", "x", "dir_y", "dir_x", "width", bottom.alias("bottom"), "expand_count")
    types, kinds = dict(ends.dtypes), {f.name: to_arrow_type(f.dataType) for f in ends.schema}
    packed = pa.schema([("segment_id", kinds["segment_id"]), ("band_", pa.int32()), *((c, pa.list_(pa.int32())) for c in "yx")])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_tables(batches, ENDS):
            e = {c: table[c].to_numpy().astype(float if c in ("dir_y", "dir_x", "width") else np.int64) for c in ("y", "x", "dir_y", "dir_x", "width", "bottom")}
            count = table["expand_count"].to_numpy()
            end, k, y, x, _ = _discs_of(e, int(count.max()), width)
            some = np.flatnonzero(k <= count[end])
            pixels = {"segment_id": table["segment_id"].combine_chunks().take(pa.array(end[some])), **{c: pa.array(v[some], pa.int32()) for c, v in (("y", y), ("x", x))}}
            yield _pack(pa.table(pixels), ["segment_id"], 0, packed)

    return ends.mapInArrow(lambda batches: _joined(_encoded(drawn(batches)), ["segment_id"]), f"segment_id {types['segment_id']}, band_ int, steps_ binary")


#: Ends whose discs are drawn at once.
ENDS = 1 << 14


def grown(ends: DataFrame, mask: DataFrame, steps: int, height: int, width: int) -> DataFrame:
    """Pixels (endpoint_id, segment_id, y, x) by which ends grow; see growth_counts."""
    return growth_pixels(growth_counts(ends, mask, steps, height, width), height, width)


def reconnect(coloured: DataFrame, height: int | DataFrame, width: int, reference: int = 50, steps: int = 5, widest: int = 100) -> tuple[DataFrame, DataFrame]:
    """The coloured mask (segment_id, y, x, class) with its broken traces joined, and the ends that grew with their counts.

    height: of all images, or a table (segment_id, rows) of each image's. Ends come from the skeleton of all classes together; a mask whose skeleton has no long branch comes back as it is.
    """
    mask = held(coloured.select(*ON).distinct(), "mask")
    ends = local_widths(path_ends(branch_paths(skeletonize(mask)), reference), mask, widest)
    if isinstance(height, DataFrame):
        ends, height = ends.join(height.select("segment_id", "rows"), "segment_id"), F.col("rows")
    counted = growth_counts(ends, mask, steps, height, width)
    changed = held(extensions(coloured, packed_growth(counted, height, width)), "changed")
    return coloured.join(changed.select(*ON), ON, "left_anti").select(*ON, "class").unionByName(changed), counted


def _area(name: str) -> Column:
    return F.sum(F.when(F.col("class") == name, F.col("area")).otherwise(0)).alias(name)


def extensions(coloured: DataFrame, growth: DataFrame) -> DataFrame:
    """Pixels (segment_id, y, x, class) that growth adds or repaints in a coloured mask (class red, green, yellow).

    A joined component of growth needs two regions of one class, or red with another class; regions count by area.
    Where it joins regions of different classes, the regions take its class; of more than one such component that
    meets a region, the last by its first pixel (ext_y, ext_x) counts.
    Pixels travel packed by class; growth may come from packed_growth. What hangs together within a band, mask and growth, is done there.
    """
    types = dict(coloured.dtypes)
    # growth is dealt as a class without a name
    both = packed_bands(coloured.select(*ON, "class"), ["segment_id", "class"]).unionByName(growth if "steps_" in growth.columns else packed_bands(growth, ["segment_id"]), allowMissingColumns=True)

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        y, x = (table[c].to_numpy().astype(np.int64) for c in "yx")
        names = pc.dictionary_encode(table["class"].combine_chunks(), null_encoding="mask")
        kind = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        order = _order(group, y, x)
        p = Pixels(group[order], y[order], x[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(p.first) - 1
        root = p.roots(np.ones(p.n, bool))
        ahead = p.spread(at_borders(p.y), root)
        grows = np.zeros(p.n, bool)
        grows[place[kind < 0]] = True
        whole = ~ahead & p.spread(grows, root)
        painted, told = _extended(p, place, kind, grows & whole, whole, names.dictionary.to_pylist())
        later = np.flatnonzero(ahead[place])
        source = np.zeros(p.n, np.int64)
        source[place] = np.arange(len(place))
        rows, of = np.r_[source[painted], later], table["segment_id"].combine_chunks()
        name = pa.concat_arrays([pa.array(told, pa.string()), table["class"].combine_chunks().cast(pa.string()).take(pa.array(later))])
        return {"segment_id": of.take(pa.array(rows)), "y": np.r_[p.y[painted], y[later]], "x": np.r_[p.x[painted], x[later]], "class": name, "later": np.arange(len(rows)) >= len(painted)}

    made = held(grouped(both, ["segment_id", "band_"], run, f"segment_id {types['segment_id']}, y int, x int, class string, later boolean"), "extended")
    done, left = made.where("not later").drop("later"), made.where("later").drop("later")
    if left.isEmpty():
        return done
    return done.unionByName(_extensions_across(left.where("class is not null"), left.where("class is null").select(*ON)))


def _extended(p: Pixels, place: np.ndarray, kind: np.ndarray, grows: np.ndarray, whole: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pixels that growth adds or repaints, and their classes, among the whole ones; see extensions.

    place: the pixel of each row of the mask or of growth; kind: the number of its class, -1 for growth.
    """
    part = p.roots(grows)
    rows = np.flatnonzero((kind >= 0) & whole[place])
    # regions of each class by themselves
    image = p.image[place[rows]] * max(1, len(names)) + kind[rows]
    order = _order(image, p.y[place[rows]], p.x[place[rows]])
    rows, image = rows[order], image[order]
    c = Pixels(image, p.y[place[rows]], p.x[place[rows]])
    at, of = place[rows][c.first], kind[rows][c.first]
    region = c.roots(np.ones(c.n, bool))
    area = np.bincount(region, minlength=c.n)
    counts = np.array([n in _COLOURS for n in names], bool)
    met = np.flatnonzero(grows[at] & counts[of]) if len(names) else np.empty(0, np.int64)
    pairs = np.unique(part[at[met]] * max(1, c.n) + region[met])
    ext, reg = pairs // max(1, c.n), pairs % max(1, c.n)
    exts, number = np.unique(ext, return_inverse=True)
    sums = [np.bincount(number, weights=area[reg] * (np.array(names)[of[reg]] == colour), minlength=len(exts)) if len(reg) else np.zeros(0) for colour in _COLOURS]
    name = np.where(np.bincount(number, minlength=len(exts)) >= 2, _mixed(*sums), None)
    joins = np.array([n is not None for n in name], bool)
    by_ext = np.full(p.n, -1)
    by_ext[exts[joins]] = np.flatnonzero(joins)
    coloured = np.zeros(p.n, bool)
    coloured[at] = True
    new = np.flatnonzero(grows & ~coloured & (by_ext[part] >= 0))
    # of several that meet a region the last one counts: places are in order of rows and columns
    several = joins & (sum((s > 0).astype(int) for s in sums) > 1)
    last = np.full(c.n, -1)
    paints = several[number]
    np.maximum.at(last, reg[paints], number[paints])
    again = np.flatnonzero(last[region] >= 0)
    return np.r_[new, at[again]], np.r_[name[by_ext[part[new]]], name[last[region[again]]]]


_COLOURS = ("red", "green", "yellow")


def _mixed(red: np.ndarray, green: np.ndarray, yellow: np.ndarray) -> np.ndarray:
    """mixed_class of numbers, for use within tasks."""
    r, g, y = red > 0, green > 0, yellow > 0
    share = red / np.maximum(red + green, 1)
    top = np.where((red >= green) & (red >= yellow), "red", np.where(green >= yellow, "green", "yellow"))
    both = np.where(share > 0.7, "red", np.where(share < 0.3, "green", "mixed"))
    found = np.select([r & ~g & ~y, ~r & g & ~y, ~r & ~g & y, r & y, r & g], ["red", "green", "yellow", top, both], "").astype(object)
    return np.where(found == "", None, found)


def _extensions_across(coloured: DataFrame, growth: DataFrame) -> DataFrame:
    regions = held(label_components(coloured, ["segment_id", "class"]), "regions")
    areas = regions.groupBy("segment_id", "class", "root_y", "root_x").agg(F.count("*").alias("area"))
    grown_parts = held(label_components(growth).select(*ON, F.col("root_y").alias("ext_y"), F.col("root_x").alias("ext_x")), "growth")
    met = grown_parts.join(regions, ON).select("segment_id", "ext_y", "ext_x", "class", "root_y", "root_x").distinct().join(areas, ["segment_id", "class", "root_y", "root_x"]).where(F.col("class").isin("red", "green", "yellow"))
    sums = met.groupBy("segment_id", "ext_y", "ext_x").agg(F.count("*").alias("regions"), _area("red"), _area("green"), _area("yellow"))
    joined = sums.where("regions >= 2").withColumn("class", mixed_class(F.col("red"), F.col("green"), F.col("yellow"))).where("class is not null")
    ext, region = ["segment_id", "ext_y", "ext_x"], ["segment_id", "old", "root_y", "root_x"]
    new = grown_parts.join(joined.select(*ext, "class"), ext).join(coloured.select(*ON), ON, "left_anti").select(*ON, "class").distinct()
    several = F.expr("int(red > 0) + int(green > 0) + int(yellow > 0) > 1")
    last = met.withColumnRenamed("class", "old").join(joined.where(several).select(*ext, "class"), ext).groupBy(*region).agg(F.max_by("class", F.struct("ext_y", "ext_x")).alias("class"))
    repainted = regions.withColumnRenamed("class", "old").join(last, region).select(*ON, "class")
    return new.union(repainted)
