"""One query for each operator, over the driver's tables, and its SQL for DuckDB.

A hole is a customer, a supplier or a user, depths and angles come from dates, keys and prices. All
queries read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.geometry import colour_class, normal_of, orientation_of, pair_coefficient
from strataspark.operators import evaluation, logs, paths, planes, raster, tables
from strataspark.streaming import depth

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[f.__name__].__name__ = f.__name__
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6) + 0.0


def seconds(ts):
    """Whole seconds since 2024-01-01."""
    return F.unix_timestamp(F.col(ts).cast("timestamp")) - 1704067200


DEPTH = "(floor(epoch(ts)) - 1704067200) / 2592000.0 * 46.3"


def with_depth(events: DataFrame) -> DataFrame:
    return events.withColumn("depth", seconds("ts") / 2592000.0 * 46.3)


@query("select l_returnflag as fracture_type, count(l_orderkey) as fracture_count, round(avg(l_quantity), 6) as mean_aperture, round(avg(l_extendedprice), 4) as mean_trace from lineitem group by 1")
def type_summary(t):
    s = tables.type_summary(t("lineitem"), "l_returnflag", "l_orderkey", {"a": "l_quantity", "b": "l_extendedprice"})
    return s.select(F.col("l_returnflag").alias("fracture_type"), "fracture_count", r6("a").alias("mean_aperture"), F.round("b", 4).alias("mean_trace"))


@query("select nullif(event_type, 'error') as event_type, count(event_id) as fracture_count, round(avg(value), 6) as mean_value from events group by 1")
def null_group_summary(t):
    e = t("events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return tables.type_summary(e, "event_type", "event_id", {"m": "value"}).select("event_type", "fracture_count", r6("m").alias("mean_value"))


_AZ, _DIP = "(o_custkey % 360)", "(o_orderkey % 91)"


@query(f"""select o_orderkey, round(sin(radians({_DIP})) * sin(radians({_AZ})), 9) + 0.0 as n_east, round(sin(radians({_DIP})) * cos(radians({_AZ})), 9) + 0.0 as n_north,
  round(cos(radians({_DIP})), 9) + 0.0 as n_up from orders""")
def orientation_normals(t):
    x, y, z = normal_of(F.expr(_AZ), F.expr(_DIP))
    return t("orders").select("o_orderkey", *((F.round(c, 9) + 0.0).alias(n) for c, n in ((x, "n_east"), (y, "n_north"), (z, "n_up"))))


@query(f"select o_orderkey, case when {_DIP} > 0 then {_AZ}::double + case when {_AZ} = 0 then 360 else 0 end end as azimuth, {_DIP}::double as dip from orders")
def normals_to_orientation(t):
    n = orientation_normals_raw(t("orders"))
    az, dip = orientation_of(F.col("x"), F.col("y"), F.col("z"))
    return n.select("o_orderkey", (F.round(az, 5) + 0.0).alias("azimuth"), (F.round(dip, 5) + 0.0).alias("dip"))


def orientation_normals_raw(orders: DataFrame) -> DataFrame:
    x, y, z = normal_of(F.expr(_AZ), F.expr(_DIP))
    return orders.select("o_orderkey", x.alias("x"), y.alias("y"), z.alias("z"))


@query("""with c as (select c_custkey, case when c_nationkey = 3 then null else floor(c_acctbal / 20) end as az, (c_custkey % 95)::double as dip from customer),
d as (select *, case when az is null and abs(dip) <= 1e-10 then 0 else az end as a2 from c),
e as (select *, case when a2 is null then 'not finite' when a2 < 0 or a2 > 360 then 'azimuth' when dip < 0 or dip > 90 then 'dip' end as reason from d)
select c_custkey, case when reason is null then a2 % 360 end as azimuth, dip, reason from e""")
def triples_validate(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_nationkey") != 3, F.floor(F.col("c_acctbal") / 20).cast("double")).alias("az"), (F.col("c_custkey") % 95).cast("double").alias("d"))
    return tables.validated_triples(c, F.lit(1.0), F.col("az"), F.col("d")).select("c_custkey", "azimuth", "dip", "reason")


@query("""with h as (select count(*) as n from lineitem), i as (select unnest(range(10)) as k),
s as (select k, n, k * 5.0::double as a, case when k = 9 then 46.3::double else (k + 1) * 5.0::double end as b from h, i)
select k::int as segment_idx, a as start_depth_m, b as end_depth_m, trunc(a / 46.3::double * n)::bigint as pixel_start, case when k = 9 then n else trunc(b / 46.3::double * n)::bigint end as pixel_end,
  trunc(n / (46.3::double * 1000) * pi() * 76)::bigint as width_px from s""")
def segment_table(t):
    h = t("lineitem").agg(F.count("*").alias("n"))
    return tables.depth_segments(h, F.col("n"), 46.3, 76.0, 5.0).select("segment_idx", "start_depth_m", "end_depth_m", "pixel_start", "pixel_end", "width_px")


@query(f"select event_id, least(floor({DEPTH} / 5)::int, 9) as segment_idx from events where {DEPTH} between 0 and 46.3")
def interval_assign(t):
    e = with_depth(t("events")).withColumn("segment_idx", tables.in_interval(F.col("depth"), 0.0, 46.3, 5.0))
    return e.where("segment_idx is not null").select("event_id", "segment_idx")


@query(f"select event_id, case when {DEPTH} < 5 then 'above' else 'below' end as reason from events where {DEPTH} < 5 or {DEPTH} > 40")
def interval_rejects(t):
    e = with_depth(t("events"))
    return e.where(tables.in_interval(F.col("depth"), 5.0, 40.0, 5.0).isNull()).select("event_id", F.when(F.col("depth") < 5, "above").otherwise("below").alias("reason"))


@query("""with o as (select o_custkey, o_orderkey, epoch(o_orderdate)::bigint // 86400 as d from orders),
p as (select *, lag(d + 30) over (partition by o_custkey order by d, o_orderkey) as previous_end from o)
select o_orderkey, coalesce(previous_end, 0) as previous_end, coalesce(abs(d - previous_end) <= 1e-8, false) as contiguous from p""")
def contiguity_check(t):
    o = t("orders").select("o_custkey", "o_orderkey", F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400).alias("d"))
    return tables.with_contiguity(o, ["o_custkey"], ["d", "o_orderkey"], F.col("d"), F.col("d") + 30).select("o_orderkey", F.coalesce("previous_end", F.lit(0)).alias("previous_end"), F.coalesce("contiguous", F.lit(False)).alias("contiguous"))


@query("""select *, row_number() over (partition by source order by id) as ordinal from (
select c_custkey as id, c_name as name, 'customer' as source from customer union all select s_suppkey, s_name, 'supplier' from supplier union all select p_partkey, p_name, 'part' from part)""")
def provenance_union(t):
    one = lambda n, k: t(n).select(F.col(f"{k}key").alias("id"), F.col(f"{k[0]}_name").alias("name"))
    return tables.union_with_source({"customer": one("customer", "c_cust"), "supplier": one("supplier", "s_supp"), "part": one("part", "p_part")}, ["id"])


@query("select doc_id, s as tile_start, least(s + 1000, n_chars) as tile_end from (select doc_id, n_chars, unnest(range(0, n_chars, 1000)) as s from documents where n_chars > 0)")
def tile_ranges(t):
    return tables.tiles(t("documents").select("doc_id", "n_chars"), F.col("n_chars"), 1000).select("doc_id", "tile_start", "tile_end")


@query("select p_partkey, coalesce(sum(p_size) over (order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as row_offset from part")
def running_offset(t):
    return tables.running_offset(t("part").select("p_partkey", "p_size"), "p_partkey", "p_size").select("p_partkey", "row_offset")


@query("select conv_id, turn, role from (select *, lead(1) over (partition by conv_id order by turn) as x from conversations) where x is null")
def lookahead_last(t):
    return tables.last_of_group(t("conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


_PATH = "(select user_id, value, floor(epoch(ts)) - 1704067200 as s, event_id from events)"


@query(f"""select user_id, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0) * 0.25, 4) as trace_mm, count(*) as n_points from (
select user_id, value - lag(value) over w as dx, s - lag(s) over w as dy from {_PATH} window w as (partition by user_id order by s, event_id)) group by 1""")
def path_trace_length(t):
    e = t("events").withColumn("s", seconds("ts"))
    return paths.trace_length(e, "user_id", ["s", "event_id"], F.col("value"), F.col("s"), 0.25).select("user_id", F.round("trace_mm", 4).alias("trace_mm"), "n_points")


_NUMBERED = f"(select *, row_number() over (partition by user_id order by s, event_id) - 1 as pos, count(*) over (partition by user_id) as n from {_PATH})"


@query(f"select user_id, pos::int as pos, event_id from {_NUMBERED} where pos % 10 = 0")
def every_tenth(t):
    e = paths.numbered(t("events").withColumn("s", seconds("ts")), "user_id", ["s", "event_id"])
    return paths.sampled(e).select("user_id", F.col("pos").cast("int").alias("pos"), "event_id")


@query(f"select user_id, max(case when pos = 50 then event_id end) as from_start, max(case when pos = n - 51 then event_id end) as from_end from {_NUMBERED} where n > 50 group by 1")
def path_reference_point(t):
    e = paths.numbered(t("events").withColumn("s", seconds("ts")), "user_id", ["s", "event_id"])
    return paths.reference_points(e, "user_id", "event_id").select("user_id", "from_start", "from_end")


@query("select user_id, count(*) as length, round(avg(value), 6) + 0.0 as center from events group by 1")
def branch_centres(t):
    return paths.branch_table(t("events"), "user_id", F.col("value")).select("user_id", "length", r6("center").alias("center"))


@query("""select l_suppkey, round(avg(f), 6) as mean_residual, round(stddev_pop(f), 6) as std_residual from (
select l_suppkey, abs(l_quantity - avg(l_quantity) over (partition by l_suppkey)) as f from lineitem) group by 1""")
def residual_stats(t):
    s = paths.residual_statistics(t("lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity")
    return s.select("l_suppkey", r6("mean_residual").alias("mean_residual"), r6("std_residual").alias("std_residual"))


_CLASS_OF = "case p_size % 5 when 0 then 'filled' when 1 then 'unfilled' when 2 then 'cemented' when 3 then 'halffilled' else 'unknown' end"
_CLASS_OF2 = "case p_partkey % 5 when 0 then 'filled' when 1 then 'unfilled' when 2 then 'cemented' when 3 then 'halffilled' else 'unknown' end"


@query(f"""select p_partkey, case when a = b and a <> 'unknown' then 1.2 when (a = 'cemented') <> (b = 'cemented') then 0.6 when a in ('filled', 'unfilled') and b in ('filled', 'unfilled') then 0.8 else 1.0 end::double as k
from (select p_partkey, {_CLASS_OF} as a, {_CLASS_OF2} as b from part)""")
def pair_coefficients(t):
    return t("part").select("p_partkey", pair_coefficient(F.expr(_CLASS_OF), F.expr(_CLASS_OF2)).cast("double").alias("k"))


@query("""select l_orderkey, l_returnflag as winner, n as hits from (select *, row_number() over (partition by l_orderkey order by n desc, strpos('RAN', l_returnflag)) as k from (
select l_orderkey, l_returnflag, count(*) as n from lineitem group by 1, 2)) where k = 1""")
def class_vote(t):
    return paths.class_vote(t("lineitem"), "l_orderkey", "l_returnflag", ["R", "A", "N"]).select("l_orderkey", "winner", "hits")


def _sides(t):
    """Orders as planes: finished ones are predicted, open ones are the reference."""
    o = t("orders").select(F.col("o_custkey"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 463 / 10.0).alias("depth"), (F.col("o_orderkey") % 360).alias("azimuth"), (F.col("o_custkey") % 91).alias("dip"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")


@query("""with o as (select o_custkey, o_orderkey as id, (o_orderkey % 463) / 10.0::double as depth, radians(o_orderkey % 360) as a, radians(o_custkey % 91) as i, o_orderstatus as s from orders),
n as (select *, sin(i) * sin(a) as x, sin(i) * cos(a) as y, cos(i) as z from o),
m as (select p.o_custkey, p.id as p_id, r.id as r_id, 1 - abs(p.depth - r.depth) / 46.3 as position, least(1, abs(p.x * r.x + p.y * r.y + p.z * r.z)) as angle from n p join n r using (o_custkey) where p.s = 'F' and r.s = 'O')
select o_custkey, p_id, r_id, round(position, 6) + 0.0 as position, round(angle, 6) + 0.0 as angle, round(position * angle, 6) + 0.0 as joint from m""")
def score_matrix(t):
    m = evaluation.score_matrix(*_sides(t), "o_custkey", 46.3)
    return m.select("o_custkey", "p_id", "r_id", r6("position").alias("position"), r6("angle").alias("angle"), r6("joint").alias("joint"))


@query()
def optimal_assignment(t):
    pred, ref = _sides(t)
    counts = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_pred"), F.count_if(F.col("o_orderstatus") == "O").alias("n_ref")).where("n_ref > 0")
    q = evaluation.quality_indices(evaluation.score_matrix(pred, ref, "o_custkey", 46.3), counts, "o_custkey")
    return q.select("o_custkey", "n_pred", "n_ref", r6("qpi").alias("qpi"), r6("qai").alias("qai"), r6("cei").alias("cei"))


@query(f"""select count(*) filter (where event_type <> 'view') as n_pred, count(*) filter (where event_type = 'view') as n_ref,
 count(*) filter (where {DEPTH} < 1 - 1e-8 or {DEPTH} > 45 + 1e-8) as n_out_of_range, 1.0::double as start_m, 45.0::double as end_m, 44.0::double as length_m,
 case when count(*) filter (where {DEPTH} < 1 - 1e-8 or {DEPTH} > 45 + 1e-8) = 0 then 'complete' else 'out of range' end as status from events""")
def metrics_row(t):
    outside = ~F.col("depth").between(1 - 1e-8, 45 + 1e-8)
    one = with_depth(t("events")).agg(F.count_if(F.col("event_type") != "view").alias("n_pred"), F.count_if(F.col("event_type") == "view").alias("n_ref"), F.count_if(outside).alias("n_out_of_range"))
    return one.select("*", F.lit(1.0).alias("start_m"), F.lit(45.0).alias("end_m"), F.lit(44.0).alias("length_m"), F.when(F.col("n_out_of_range") == 0, "complete").otherwise("out of range").alias("status"))


def _grid(t, x: str = "l_orderkey"):
    """A raster of 64 x 64 for each supplier."""
    return t("lineitem").select(F.col("l_suppkey").alias("segment_id"), (F.col("l_partkey") % 64).cast("int").alias("y"), (F.col(x) % 64).cast("int").alias("x"), "l_returnflag")


_GRID = "(select distinct l_suppkey as segment_id, (l_partkey % 64)::int as y, (l_orderkey % 64)::int as x from lineitem)"
_LABELS = f"""with recursive px as {_GRID},
e as (select a.segment_id, a.y, a.x, b.y as y2, b.x as x2 from px a join px b on a.segment_id = b.segment_id and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1),
r as (select segment_id, y, x, y * 64 + x as root from px union select e.segment_id, e.y2, e.x2, r.root from r join e using (segment_id, y, x)),
lab as (select segment_id, y, x, min(root) as root from r group by all)
"""


@query(_LABELS + "select segment_id, y, x, (root // 64)::int as root_y, (root % 64)::int as root_x from lab")
def pixel_components(t):
    return raster.label_components(_grid(t)).select("segment_id", "y", "x", "root_y", "root_x")


_STATS = _LABELS + ", st as (select segment_id, (root // 64)::int as root_y, (root % 64)::int as root_x, count(*) as area, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from lab group by segment_id, root)\n"


@query(_STATS + "select * from st")
def component_stats(t):
    return raster.component_stats(raster.label_components(_grid(t)))


@query(_STATS + "select lab.segment_id, y, x from lab join st on lab.segment_id = st.segment_id and lab.root = root_y * 64 + root_x where area >= 4 and not (w / h > 0.5 and area / (w * h) > 0.5)")
def component_filter(t):
    return raster.eliminate(_grid(t), 4, 0.5, 0.5).select("segment_id", "y", "x")


_COLOURED = """with recursive px as (select distinct l_suppkey as segment_id, l_returnflag as class, (l_partkey % 64)::int as y, (l_orderkey % 64)::int as x from lineitem),
e as (select a.segment_id, a.class, a.y, a.x, b.y as y2, b.x as x2 from px a join px b on a.segment_id = b.segment_id and a.class = b.class and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1),
r as (select segment_id, class, y, x, y * 64 + x as root from px union select e.segment_id, e.class, e.y2, e.x2, r.root from r join e using (segment_id, class, y, x)),
lab as (select segment_id, class, y, x, min(root) as root from r group by all)
"""


@query(_COLOURED + "select segment_id, class, (root // 64)::int as root_y, (root % 64)::int as root_x, count(*) as area from lab group by segment_id, class, root")
def colour_components(t):
    g = raster.label_components(_grid(t).withColumnRenamed("l_returnflag", "class"), ["segment_id", "class"])
    return g.groupBy("segment_id", "class", "root_y", "root_x").agg(F.count("*").alias("area"))


@query("""with p as (select p_partkey, (p_size * 5) % 256 as b, (p_partkey * 7) % 256 as g, (p_partkey * 3 + p_size) % 256 as r from part),
n as (select *, b <= 10 as b0, g <= 10 as g0, r <= 10 as r0, b between 118 and 138 as b1, g between 118 and 138 as g1, r between 118 and 138 as r1, b >= 245 as b2, g >= 245 as g2, r >= 245 as r2 from p)
select p_partkey, case when b0 and g0 and (r1 or r2) then 'filled' when b0 and r0 and (g1 or g2) then 'unfilled' when b0 and (g1 and r1 or g2 and r2) then 'cemented' when g0 and r0 and (b1 or b2) then 'halffilled' end as class from n""")
def colour_to_class(t):
    p, k = F.col("p_partkey"), F.col("p_size")
    return t("part").select("p_partkey", colour_class(k * 5 % 256, p * 7 % 256, (p * 3 + k) % 256).alias("class"))


@query(f"""with a as {_GRID}, b as (select distinct l_suppkey as segment_id, (l_partkey % 64)::int as y, ((l_orderkey + l_linenumber) % 64)::int as x from lineitem)
select segment_id, count(*) filter (where k = 'u') as n_union, count(*) filter (where k = 'i') as n_common, count(*) filter (where k = 'd') as n_without from (
select *, 'u' as k from (select * from a union select * from b) union all select *, 'i' from (select * from a intersect select * from b) union all select *, 'd' from (select * from a except select * from b)) group by 1""")
def mask_setops(t):
    a = _grid(t).drop("l_returnflag")
    b = t("lineitem").select(F.col("l_suppkey").alias("segment_id"), (F.col("l_partkey") % 64).cast("int").alias("y"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 64).cast("int").alias("x"))
    both = raster.masks_together(a, b)
    return both.groupBy("segment_id").agg(F.count("*").alias("n_union"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_common"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("n_without"))


@query("select node from (select l_orderkey as node from lineitem union all select -l_partkey from lineitem) group by 1 having count(*) = 1")
def endpoint_nodes(t):
    return paths.endpoints(t("lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst"))).select("node")


@query(_COLOURED + """select segment_id, (a.root // 64)::int as ext_y, (a.root % 64)::int as ext_x, count(distinct b.root) as regions, count(*) as shared
from lab a join lab b using (segment_id, y, x) where a.class = 'N' and b.class = 'R' group by segment_id, a.root""")
def overlap_regions(t):
    g = raster.label_components(_grid(t).withColumnRenamed("l_returnflag", "class"), ["segment_id", "class"])
    side = lambda c, n: g.where(F.col("class") == c).select("segment_id", "y", "x", F.col("root_y").alias(f"{n}_y"), F.col("root_x").alias(f"{n}_x"))
    return raster.overlapping_regions(side("N", "ext"), side("R", "reg"))


@query("""with s as (select l_orderkey, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as r, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as g,
sum(case when l_returnflag = 'N' and l_linenumber > 5 then l_quantity else 0 end) as y from lineitem group by 1)
select l_orderkey, case when r > 0 and g = 0 and y = 0 then 'red' when r = 0 and g > 0 and y = 0 then 'green' when r = 0 and g = 0 and y > 0 then 'yellow'
when r > 0 and y > 0 then case when r >= g and r >= y then 'red' when g >= y then 'green' else 'yellow' end
when r > 0 and g > 0 then case when r / (r + g) > 0.7 then 'red' when r / (r + g) < 0.3 then 'green' else 'mixed' end end as class from s""")
def mixed_ratio_rule(t):
    area = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0))
    s = t("lineitem").groupBy("l_orderkey").agg(area(F.col("l_returnflag") == "R").alias("r"), area(F.col("l_returnflag") == "A").alias("g"), area((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 5)).alias("y"))
    return s.select("l_orderkey", raster.mixed_class(F.col("r"), F.col("g"), F.col("y")).alias("class"))


def _planes(t):
    """Points of each user near a plane across a cylinder of radius 38."""
    e = t("events").withColumn("theta", F.radians(seconds("ts") % 360))
    z = 10 * F.col("user_id") + 20 * F.cos(F.col("theta") - F.radians(F.col("user_id") % 360)) + F.col("value") / 1000
    return planes.fit_planes(e, ["user_id"], 38 * F.cos(F.col("theta")), 38 * F.sin(F.col("theta")), z)


_PLANES = """with p as (select user_id, 38 * cos(radians((floor(epoch(ts)) - 1704067200) % 360)) as x, 38 * sin(radians((floor(epoch(ts)) - 1704067200) % 360)) as y,
 10 * user_id + 20 * cos(radians((floor(epoch(ts)) - 1704067200) % 360) - radians(user_id % 360)) + value / 1000 as z from events),
c as (select user_id, count(*) as n_px, avg(x) as cx, avg(y) as cy, avg(z) as cz, covar_pop(x, x) as xx, covar_pop(y, y) as yy, covar_pop(z, z) as zz, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from p group by 1),
q as (select *, (xx + yy + zz) / 3 as m from c),
s as (select *, sqrt(((xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) as sp from q),
b as (select *, (xx - m) / sp as bxx, (yy - m) / sp as byy, (zz - m) / sp as bzz, xy / sp as bxy, xz / sp as bxz, yz / sp as byz from s),
l as (select *, m + 2 * sp * cos(acos(greatest(-1, least(1, (bxx * (byy * bzz - byz * byz) - bxy * (bxy * bzz - byz * bxz) + bxz * (bxy * byz - byy * bxz)) / 2))) / 3 + 2.0943951023931953) as ev from b),
k as (select *, [xy * yz - xz * (yy - ev), xz * xy - (xx - ev) * yz, (xx - ev) * (yy - ev) - xy * xy] as k0, [xy * (zz - ev) - xz * yz, xz * xz - (xx - ev) * (zz - ev), (xx - ev) * yz - xy * xz] as k1,
 [(yy - ev) * (zz - ev) - yz * yz, yz * xz - xy * (zz - ev), xy * yz - (yy - ev) * xz] as k2 from l),
v as (select *, list_dot_product(k0, k0) as l0, list_dot_product(k1, k1) as l1, list_dot_product(k2, k2) as l2 from k),
w as (select *, case when l0 >= l1 and l0 >= l2 then k0 when l1 >= l2 then k1 else k2 end as d, sqrt(greatest(l0, l1, l2)) as len from v),
f as (select user_id, n_px, cx, cy, cz, case when d[3] < 0 then -1 else 1 end * d[1] / len as nx, case when d[3] < 0 then -1 else 1 end * d[2] / len as ny, abs(d[3]) / len as nz from w where len > 1e-12)
"""


@query(_PLANES + "select user_id, n_px, round(nx, 5) + 0.0 as n_x, round(ny, 5) + 0.0 as n_y, round(nz, 5) + 0.0 as n_z from f")
def plane_fit(t):
    return _planes(t).where("n_z is not null").select("user_id", "n_px", *((F.round(f"n_{a}", 5) + 0.0).alias(f"n_{a}") for a in "xyz"))


@query(_PLANES + "select user_id, round((nx * cx + ny * cy + nz * cz) / nz, 3) + 0.0 as center from f where nz >= 0.1 and (nx * cx + ny * cy + nz * cz) / nz between -114 and 1114")
def plane_centre_filter(t):
    return planes.axis_crossings(_planes(t), F.lit(38.0), F.lit(1000.0)).select("user_id", (F.round("center", 3) + 0.0).alias("center"))


@query(f"""with p as (select user_id as g, event_id as id, round(value, 2) as x, (floor(epoch(ts)) - 1704067200) / 1000.0::double as y from events)
select g, id, neighbour, rank::int as rank from (select a.g, a.id, b.id as neighbour, row_number() over (partition by a.g, a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) as rank from p a join p b using (g)) where rank <= 4""")
def knn4(t):
    p = t("events").select(F.col("user_id").alias("g"), F.col("event_id").alias("id"), F.round("value", 2).alias("x"), (seconds("ts") / 1000.0).alias("y"))
    return planes.nearest(p, "g", "id", ["x", "y"]).select("g", "id", "neighbour", "rank")


@query("""with c as (select l_suppkey, covar_pop(l_quantity, l_quantity) as a, covar_pop(l_quantity, l_linenumber) as b, covar_pop(l_linenumber, l_linenumber) as d from lineitem group by 1),
n as (select l_suppkey, degrees(0.5 * atan2(2 * b, a - d)) + 90 as z from c)
select l_suppkey, round(case when z >= 180 then z - 180 when z < 0 then z + 180 else z end, 5) as normal_deg from n""")
def pca2_normals(t):
    return planes.directions(t("lineitem"), "l_suppkey", F.col("l_quantity"), F.col("l_linenumber").cast("double")).select("l_suppkey", F.round("normal_deg", 5).alias("normal_deg"))


@query("""select s_suppkey, k::int as "column", trunc(round(100 + s_suppkey + 38 * tan(radians(s_nationkey * 3)) * cos(k * (2 * 3.141592653589793::double / 96) - radians(s_suppkey % 360)), 6))::bigint as "row" from supplier, range(96) r(k)""")
def trace_points(t):
    p = planes.trace_points(t("supplier"), 96, 100.0 + F.col("s_suppkey"), F.lit(38.0), F.col("s_nationkey") * 3, F.col("s_suppkey") % 360)
    return p.select("s_suppkey", "column", "row")


@query("""select vec_id, (list_position(e, list_max(e)) - 1)::int as class, round(exp(list_max(e)) / list_sum(list_transform(e, lambda x: exp(x))), 6) as probability
from (select vec_id, list_transform(embedding[1:4], lambda x: x::double) as e from embeddings)""")
def argmax_class(t):
    e = t("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("e"))
    total = F.aggregate(F.transform("e", F.exp), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("class"), r6(F.exp(F.array_max("e")) / total).alias("probability"))


@query("""with s as (select p_partkey, p_size * 40 as w, (p_partkey % 900 + 100) as h from part),
n as (select p_partkey, trunc(w * least(512.0::double / w, 512.0::double / h))::int as new_w, trunc(h * least(512.0::double / w, 512.0::double / h))::int as new_h from s)
select *, floor((512 - new_w) / 2)::int as left_px, floor((512 - new_h) / 2)::int as top_px from n""")
def letterbox_dims(t):
    s = t("part").select("p_partkey", (F.col("p_size") * 40).alias("w"), (F.col("p_partkey") % 900 + 100).alias("h"))
    return planes.letterbox(s, F.col("w"), F.col("h")).select("p_partkey", "new_w", "new_h", "left_px", "top_px")


@query("""select conv_id, min(turn) as header_row from (select conv_id, turn, list_transform(string_split(text, ' '), lambda c: lower(regexp_replace(c, '[\\n ]', '', 'g'))) as cells from conversations where turn < 20)
where len(list_filter(cells, lambda c: starts_with(c, 'the'))) = 1 and len(list_filter(cells, lambda c: starts_with(c, 'a'))) = 1 group by 1""")
def header_discovery(t):
    return tables.header_row(t("conversations"), ["the", "a"], "conv_id", "turn", "text")


@query("""select event_id, regexp_extract(f, '^segment_([0-9.]+)m_to_([0-9.]+)m', 1)::double as start_m, regexp_extract(f, '^segment_([0-9.]+)m_to_([0-9.]+)m', 2)::double as end_m
from (select event_id, 'segment_' || (user_id * 5) || 'm_to_' || (user_id * 5 + 5) || '.5m.png' as f from events)""")
def filename_interval(t):
    f = t("events").select("event_id", F.concat(F.lit("segment_"), F.col("user_id") * 5, F.lit("m_to_"), F.col("user_id") * 5 + 5, F.lit(".5m.png")).alias("f"))
    start, end = logs.interval_of(F.col("f"))
    return f.select("event_id", start.alias("start_m"), end.alias("end_m"))


@query("select 'doc/' || doc_id as path, sha256(coalesce(text, '')) as sha256, octet_length(encode(coalesce(text, '')))::bigint as bytes from documents")
def checksum_manifest(t):
    return tables.manifest(t("documents"), F.concat(F.lit("doc/"), "doc_id"), F.coalesce("text", F.lit("")))


@query("""with e as (select doc_id, sha256(coalesce(text, '')) as s from documents where lang <> 'de'), f as (select doc_id, sha256(lower(coalesce(text, ''))) as s from documents where source <> 'src1')
select 'doc/' || e.doc_id as path, case when f.doc_id is null then 'missing' else 'mismatch' end as status from e left join f using (doc_id) where f.doc_id is null or e.s <> f.s""")
def manifest_diff(t):
    d, path, text = t("documents"), F.concat(F.lit("doc/"), "doc_id"), F.coalesce("text", F.lit(""))
    return tables.manifest_differences(tables.manifest(d.where("lang <> 'de'"), path, text), tables.manifest(d.where("source <> 'src1'"), path, F.lower(text)))


@query("""select 'discount' as rule, count(*) filter (where not l_discount between 0 and 0.1) as violations, count(*) filter (where not l_discount between 0 and 0.1) = 0 as passed from lineitem
union all select 'quantity', count(*) filter (where not l_quantity between 1 and 49), count(*) filter (where not l_quantity between 1 and 49) = 0 from lineitem""")
def schema_audit(t):
    return tables.audit(t("lineitem"), {"discount": F.col("l_discount").between(0, 0.1), "quantity": F.col("l_quantity").between(1, 49)})


@query("select page_id, url from pages where not list_has_any(string_split(url, '/'), ['site1', 'blog', 'tag', 'page', 'p'])")
def path_exclude(t):
    return tables.without_excluded(t("pages"), F.col("url"), ["site1", "blog", "tag", "page", "p"]).select("page_id", "url")


@query(r"select doc_id, regexp_matches(coalesce(text, ''), '[A-Za-z]:[/\\]') as drive_path, regexp_matches(coalesce(text, ''), '[\x{4e00}-\x{9fff}]') as han from documents")
def lint_regex(t):
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", text.rlike(r"[A-Za-z]:[/\\]").alias("drive_path"), text.rlike(r"[\x{4e00}-\x{9fff}]").alias("han"))


@query("select time_bucket(interval 1 day, ts)::timestamp as bin_start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def depth_stream_bins(t):
    return depth.time_bins(t("events"), "ts", "value").select("bin_start", "n", F.round("total", 4).alias("total"))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from s group by user_id, k""")
def session_gaps(t):
    return depth.sessions(t("events"), "user_id", "ts")


@query()
def skeleton_thin(t):
    return raster.skeletonize(_grid(t)).select("segment_id", "y", "x")


@query()
def branch_prune(t):
    return raster.prune_spurs(raster.skeletonize(_grid(t)), 3).select("segment_id", "y", "x")


def _strokes(t):
    """Rasters of 256 x 256 for each supplier: short strokes of ten pixels where its parts and orders fall."""
    line = t("lineitem").select(F.col("l_suppkey").alias("segment_id"), (F.col("l_partkey") * 7 % 256).cast("int").alias("y"), (F.col("l_orderkey") % 256).cast("int").alias("x0"), "l_returnflag")
    return line.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x0") + 9))).where("x < 256").select("segment_id", "y", "x", F.expr("case l_returnflag when 'R' then 'red' when 'A' then 'green' else 'yellow' end").alias("class"))


@query()
def branch_table(t):
    from strataspark.operators import branches

    p = branches.branch_paths(raster.skeletonize(_strokes(t)))
    return branches.long_branches(p, 8).groupBy("segment_id", "root_y", "root_x", "branch_type").agg(F.count("*").alias("n_px"), F.round(F.avg("y"), 6).alias("center"))


@query()
def greedy_cluster(t):
    from strataspark.operators import branches

    p = branches.long_branches(branches.branch_paths(raster.skeletonize(_strokes(t))), 8)
    b = branches.path_arrays(p).select("segment_id", F.xxhash64("root_y", "root_x").alias("branch_id"), F.lit("filled").alias("fractype"), "pos", "path")
    return branches.cluster_branches(b, 64)


@query()
def aperture_rays(t):
    from strataspark.operators import aperture, branches

    # masks may hold copies
    thick = _strokes(t).select("segment_id", "x", F.explode(F.sequence(F.col("y"), F.col("y") + 2)).alias("y"))
    samples = aperture.sampled_normals(branches.branch_paths(raster.skeletonize(thick)), 10)
    return aperture.ray_widths(samples, thick, ratio=0.25).select("segment_id", "id", F.round("width_mm", 6).alias("width_mm"))


@query()
def reconnect_grow(t):
    from strataspark.functions.shared import held
    from strataspark.operators import branches, reconnect

    coloured = held(raster.one_class(_strokes(t)), "coloured")
    mask = coloured.select("segment_id", "y", "x")
    ends = reconnect.path_ends(branches.branch_paths(raster.skeletonize(mask)), 6)
    ends = reconnect.local_widths(ends, mask, 10).withColumn("width", F.greatest("width", F.lit(2)))
    return reconnect.extensions(coloured, reconnect.packed_growth(reconnect.growth_counts(ends, mask, 5, 256, 256), 256, 256))


@query()
def png_roundtrip(t):
    from strataspark.sources import png

    p = _strokes(t).select("segment_id", "y", "x", *(F.when(F.col("class").isin(*c), v).otherwise(0).alias(n) for n, c, v in (("r", ("red", "yellow"), 128), ("g", ("green", "yellow"), 128), ("b", ("none",), 0))))
    return png.foreground(png.render(p, 256, 256))


def _pages(docs, key):
    """A grey frame of each whole text: its UTF-8 bytes in rows of 64, the last row (or an empty text's one row) filled with blanks."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text)
    fill = F.when(size == 0, 64).otherwise(F.pmod(-size, F.lit(64)))
    frames = docs.select(F.col("doc_id").alias(key), F.concat(text, F.repeat(F.lit(" "), fill)).cast("binary").alias("data"))
    return frames.select(key, (F.octet_length("data") / 64).cast("int").alias("height"), F.lit(64).alias("width"), "data")


@query()
def resize_area(t):
    from strataspark.sources import png

    return png.resized_rows(_pages(t("documents"), "frame_idx"), 16).select("frame_idx", "width", F.hex("data").alias("data"))


@query()
def tile_predict(t):
    from strataspark.sources import png

    return png.predicted(_pages(t("documents"), "doc_id"), png.by_brightness, "doc_id").select("doc_id", F.sha2("classes", 256).alias("classes"))


@query()
def xlsx_roundtrip(t):
    """A workbook of parts for each brand, written and read in tasks."""
    import pandas as pd

    from strataspark.sources import xlsx

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        book = xlsx.workbook({pdf["p_brand"].iloc[0]: pdf.sort_values("p_partkey")[["p_partkey", "p_size", "p_name"]]})
        rows = [c for _, y, c in xlsx.rows_of(book) if y > 1]
        return pd.DataFrame({"p_brand": pdf["p_brand"].iloc[0], "p_partkey": [int(r[0]) for r in rows], "p_size": [int(r[1]) for r in rows], "p_name": [r[2] for r in rows]})

    ORDER = "p_brand string, p_partkey long, p_size int, p_name string"
    return t("part").select("p_brand", "p_partkey", "p_size", "p_name").groupBy("p_brand").applyInPandas(run, ORDER)


ORACLE["xlsx_roundtrip"] = "select p_brand, p_partkey, p_size, p_name from part"
_STROKES = """with s as (select l_suppkey as segment_id, (l_partkey * 7 % 256)::int as y, (l_orderkey % 256 + d)::int as x, l_returnflag as f from lineitem, range(10) r(d) where l_orderkey % 256 + d < 256),
c as (select segment_id, y, x, max(case f when 'R' then (128, 0) when 'A' then (0, 128) else (128, 128) end) as rg from s group by all)
select segment_id, y, x, struct_extract_at(rg, 1)::int as r, struct_extract_at(rg, 2)::int as g, 0::int as b from c"""
ORACLE["png_roundtrip"] = _STROKES
