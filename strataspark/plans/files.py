"""Queries of logs, parameter tables and mosaics over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import logs, mosaic, planes, raster

from .carriers import _GRID, _grid, query

_CELLS = """case when o_orderkey % 7 > 0 then o_totalprice / 1000 end as a, case when o_orderkey % 7 > 0 and o_orderkey % 11 > 0 then o_custkey % 400 end::double as b, case when o_orderkey % 7 > 0 then o_orderkey % 91 end::double as c"""


def _log_rows(t):
    o = t("orders")
    text = lambda v: F.when(F.col("o_orderkey") % 7 > 0, v).cast("string")
    azimuth = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey") % 400)
    rows = o.select(F.col("o_custkey").alias("hole"), (F.col("o_orderkey") + 2).alias("row"), F.array(F.lit("x"), text(F.col("o_orderkey") % 91), text(F.col("o_totalprice") / 1000), text(azimuth)).alias("cells"))
    head = o.select(F.col("o_custkey").alias("hole")).distinct().select("hole", F.lit(2).cast("long").alias("row"), F.array(F.lit("no"), F.lit("倾角(°)"), F.lit("深 度(m)"), F.lit("倾\n向(°)")).alias("cells"))
    return rows.withColumn("row", F.col("row").cast("long")).unionByName(head)


@query(f"""with r as (select o_custkey as hole, o_orderkey + 2 as "row", {_CELLS} from orders where o_orderkey > 0 and o_orderkey % 7 > 0),
z as (select *, case when b is null and c <= 1e-10 then 0 else b end as az from r),
v as (select *, case when az is null then 'not finite' when az > 360 then 'azimuth' end as reason from z)
select hole, "row", a as depth, case when reason is null then az % 360 end as azimuth, c as dip, reason from v""")
def log_scan(t):
    return logs.log_planes(_log_rows(t), ["hole"])


@query("""select c_custkey as hole, count(o_orderkey) + 1 as n_rows from customer join orders on o_custkey = c_custkey group by 1
having count(*) filter (where o_orderkey % 7 > 0 and ((o_orderkey % 11 > 0 and o_custkey % 400 <= 360) or (o_orderkey % 11 = 0 and o_orderkey % 91 = 0))) = 0""")
def logs_without_planes(t):
    rows = _log_rows(t)
    return logs.without_header(rows, ["hole"], logs.log_planes(rows, ["hole"]))


@query("""with r as (select s_suppkey as hole, s_acctbal as a, (s_suppkey % 380)::double as b, (s_nationkey * 4)::double as c from supplier),
v as (select *, case when b > 360 then 'azimuth' when c > 90 then 'dip' end as reason from r)
select hole, 1::bigint as "row", a as depth, case when reason is null then b % 360 end as azimuth, c as dip, reason from v""")
def plain_log_scan(t):
    s = t("supplier").select(F.col("s_suppkey").alias("hole"), F.lit(1).cast("long").alias("row"), F.array(*(c.cast("string") for c in (F.col("s_acctbal"), F.col("s_suppkey") % 380, F.col("s_nationkey") * 4))).alias("cells"))
    return logs.plain_planes(s, ["hole"])


@query("""select l_orderkey as hole, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_suppkey, l_quantity)::int as "裂隙编号", case l_returnflag when 'A' then '充填' when 'N' then '胶结' else '未知' end as "裂隙类型",
case l_returnflag when 'A' then 'filled' when 'N' then 'cemented' end as "类型标识", l_quantity as "深度(m)", l_discount as "开度(mm)", l_tax as "迹线长度(mm)", l_extendedprice as "开度乘迹线长度(mm²)", l_suppkey as "倾向(°)",
l_partkey as "倾角(°)", 0.0::double as "法向量X", 0.6::double as "法向量Y", 0.8::double as "法向量Z", l_linenumber as "骨架点数", l_linenumber as "孔段内编号" from lineitem""")
def fracture_parameters(t):
    kind = F.when(F.col("l_returnflag") == "A", "filled").when(F.col("l_returnflag") == "N", "cemented")
    names = {"depth_m": "l_quantity", "aperture_mm": "l_discount", "trace_mm": "l_tax", "flaw_mm2": "l_extendedprice", "dip_direction_deg": "l_suppkey", "dip_angle_deg": "l_partkey", "n_px": "l_linenumber", "segment_fracture_id": "l_linenumber"}
    f = t("lineitem").select(F.col("l_orderkey").alias("hole"), kind.alias("fractype"), *(F.col(c).alias(n) for n, c in names.items()), F.lit(0.0).alias("normal_x"), F.lit(0.6).alias("normal_y"), F.lit(0.8).alias("normal_z"))
    return logs.parameter_table(f, ["hole"], ["segment_fracture_id", "dip_angle_deg", "flaw_mm2", "dip_direction_deg", "depth_m"])


@query("""select p_partkey, 5.0::double as start_m, 10.0::double as end_m, round(pi() * 76, 6) as perimeter_mm, round(5000.0::double / (p_size + 1), 6) as ratio_v, round(pi() * 76 / (p_partkey % 900 + 100), 6) as ratio_h from part""")
def pixel_ratios(t):
    p = logs.segment_parameters(t("part"), F.col("p_size") + 1, F.col("p_partkey") % 900 + 100, 5.0, 76.0, 5.0)
    return p.select("p_partkey", "start_m", "end_m", *((F.round(c, 6) + 0.0).alias(c) for c in ("perimeter_mm", "ratio_v", "ratio_h")))


@query("""with s as (select l_orderkey as hole, l_linenumber::double as a, l_linenumber + case when l_partkey % 5 = 0 then 0.5 else 1 end::double as b from lineitem),
w as (select *, abs(a - lag(b) over (partition by hole order by a, b)) > 1e-8 as gap from s)
select hole, count(*) as n_segments, min(a) as first_m, arg_max(b, a * 100 + b) as last_m, count(*) filter (where gap) as n_breaks from w group by 1""")
def hole_coverage(t):
    end = F.col("l_linenumber") + F.when(F.col("l_partkey") % 5 == 0, 0.5).otherwise(1.0)
    s = t("lineitem").select(F.col("l_orderkey").alias("hole"), F.col("l_linenumber").cast("double").alias("a"), end.alias("b"))
    return logs.coverage(s, ["hole"], "a", "b")


@query("select count(*) filter (where o_orderstatus <> 'P') as succeeded, count(*) filter (where o_orderstatus = 'P') as failed from orders")
def stage_outcomes(t):
    return logs.outcome_counts(t("orders").select(F.when(F.col("o_orderstatus") == "P", "pending").alias("error")))


@query("""select p_partkey as image, case when p_partkey % 13 = 0 then 'not three channels' when p_partkey % 3 = 0 then 'no base image' else 'sizes differ' end as violation from part where p_partkey % 13 = 0 or p_partkey % 3 = 0 or p_partkey % 5 = 0""")
def image_shapes(t):
    k = F.col("p_partkey")
    masks = t("part").select(k.alias("image"), (k % 40 + 1).alias("height"), F.col("p_size").alias("width"), F.when(k % 13 == 0, 1).otherwise(3).alias("channels"))
    bases = t("part").where(k % 3 != 0).select(k.alias("image"), (k % 40 + F.when(k % 5 == 0, 2).otherwise(1)).alias("height"), F.col("p_size").alias("width"))
    return logs.unlike_images(masks, bases, "image")


@query(f"""with a as (select distinct segment_id, y, x from {_GRID})
select segment_id, true as has_edges from a where exists (select 1 from a b where b.segment_id = a.segment_id and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 and (b.y, b.x) <> (a.y, a.x)) group by 1""")
def skeleton_edges(t):
    grid = _grid(t).select("segment_id", "y", "x").distinct()
    return raster.with_edges(grid, ["segment_id"])


@query("""with d as (select doc_id, coalesce(text, '') as text, encode(coalesce(text, '')) as b from documents), f as (select doc_id, greatest(1, ceil(octet_length(b) / 64.0))::bigint as h from d),
n as (select *, coalesce(sum(h) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before, sum(h) over () as total from f)
select doc_id, before::bigint as first_row, h as n_rows, floor(before / 64.0)::bigint as tile from n""")
def frame_mosaic(t):
    """Each document is a frame of 64 columns, as many rows as its bytes fill, the last row padded with zeros."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / 64)).cast("int")
    d = t("documents").select(F.col("doc_id").cast("long").alias("frame_idx"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    frames = d.select("frame_idx", size.alias("height"), F.lit(64).alias("width"), F.rpad("b", size * 64, F.lit(b"\x00")).alias("data"))
    m = mosaic.mosaic(mosaic.frame_rows(frames))
    per = m.groupBy(F.col("frame_idx").alias("doc_id")).agg(F.min("mosaic_row").cast("long").alias("first_row"), F.count("*").alias("n_rows"))
    return per.withColumn("tile", F.floor(F.col("first_row") / 64))


@query("""with p as (select s_suppkey, k as c, trunc(round(40 + s_suppkey % 50 + 38 * tan(radians(s_nationkey * 3)) * cos(k * (2 * 3.141592653589793::double / 96) - radians(s_suppkey % 360)), 6))::bigint as r from supplier, range(96) q(k)),
s as (select s_suppkey % 10 as segment_id, s_suppkey, r + dy as y, c + dx as x from p, range(-3, 27) a(dy), range(-3, 27) b(dx) where r between 0 and 127 and r + dy between 0 and 127 and c + dx between 0 and 95),
w as (select segment_id, y, x, max(s_suppkey) as plane from s group by all)
select segment_id, plane, count(*) as n_px from w group by all""")
def painted_planes(t):
    p = planes.trace_points(t("supplier"), 96, 40.0 + F.col("s_suppkey") % 50, F.lit(38.0), F.col("s_nationkey") * 3, F.col("s_suppkey") % 360)
    p = p.select((F.col("s_suppkey") % 10).alias("segment_id"), F.col("s_suppkey").alias("plane"), F.col("s_suppkey").alias("paint"), F.col("row").cast("int").alias("row"), F.col("column").cast("int").alias("column"))
    done = mosaic.painted(p, ["segment_id"], "plane", "paint", 128, 96)
    return done.groupBy("segment_id", F.col("paint").alias("plane")).agg(F.count("*").alias("n_px"))
