"""Queries of contours, rays, image forms, recognition and file sinks over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataspark.functions.shared import held, shared_dir
from strataspark.operators import aperture, audits, contours, logs, recognition
from strataspark.sources import folder, images, png, xlsx

from .carriers import _STROKES, _pages, _strokes, query


def _new_folder(t, label: str) -> str:
    return f"{shared_dir(t('part').sparkSession)}/{label}-{uuid.uuid4().hex}"


@query(f"""with m as (select distinct segment_id, y, x from ({_STROKES})),
corners as (select distinct segment_id, y + a as y, x + b as x from m, (values (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b)),
edges as (select distinct segment_id, y + a as y, x + b as x, k from m, (values (0, 0, 'h'), (1, 0, 'h'), (0, 0, 'v'), (0, 1, 'v')) v(a, b, k)),
counts as (select segment_id, sum(n) as euler from (select segment_id, count(*) as n from m group by 1 union all select segment_id, count(*) from corners group by 1 union all select segment_id, -count(*) from edges group by 1) group by 1),
east as (select segment_id, count(*) as n_east from m where not exists (select 1 from m n where n.segment_id = m.segment_id and n.y = m.y and n.x = m.x + 1) group by 1)
select segment_id, euler::bigint as euler, n_east from counts join east using (segment_id)""")
def contour_borders(t):
    """Components less holes of each raster, which the SQL counts by corners, sides and pixels, and the open eastern sides."""
    found = contours.contours(_strokes(t).select("segment_id", "y", "x"))
    return found.groupBy("segment_id").agg(F.sum(F.when(F.col("hole"), -1).otherwise(1)).alias("euler"), F.sum(F.size("east")).alias("n_east"))


@query("""select c_custkey as id, round(2 * least((1 + c_nationkey % 9) / abs(cos(radians(c_custkey % 180))), (1 + c_custkey % 7) / abs(sin(radians(c_custkey % 180)) + 1e-300)), 6) as width_mm from customer""")
def ray_contacts(t):
    """The width of a rectangle for each customer, along a line through its middle."""
    high, wide = (2 * (F.col("c_custkey") % 7 + 1)).cast("int"), (2 * (F.col("c_nationkey") % 9 + 1)).cast("int")
    c = held(t("customer").select(F.col("c_custkey").alias("segment_id"), high.alias("high"), wide.alias("wide")), "rectangles")
    mask = c.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("high")))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("wide")))).select("segment_id", "y", "x")
    samples = c.select("segment_id", F.col("segment_id").alias("id"), (F.col("high") / 2).alias("y"), (F.col("wide") / 2).alias("x"), (F.col("segment_id") % 180).cast("double").alias("normal_deg"))
    return aperture.ray_widths(samples, mask).select("id", F.round("width_mm", 6).alias("width_mm"))


@query("""with c as (select c_custkey as segment_id, c_custkey % 3 + 1 as n from customer), r as (select segment_id, n, unnest(range(n)) as k from c)
select segment_id, 2 * n as n_contours, 1::bigint as n_top, n - 1 as n_nested, sum(8 * (2 * k + 1) * (2 * k + 1) - 2)::double as area from r group by segment_id, n""")
def contour_tree(t):
    """Up to three square rings in each other for each customer: all contours, and each ring inside the hole of the next."""
    rings = t("customer").select(F.col("c_custkey").alias("segment_id"), F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))).alias("k"))
    side = F.explode(F.sequence(-2 * F.col("k") - 1, 2 * F.col("k") + 1))
    square = rings.withColumn("y", side).withColumn("x", side).where(F.greatest(F.abs("y"), F.abs("x")) == 2 * F.col("k") + 1)
    found = held(contours.contours(square.select("segment_id", "y", "x")), "found")
    tree = contours.hierarchy(found)
    nested = ~F.col("hole") & (F.col("parent.root_y") == F.col("root_y") - 2) & (F.col("parent.contour") > 0)
    return tree.groupBy("segment_id").agg(F.count("*").alias("n_contours"), F.count_if(F.col("parent").isNull()).alias("n_top"), F.count_if(nested).alias("n_nested"), F.sum("area").alias("area"))


@query("""with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, octet_length(b) as n, hex(b) || repeat('20', (case when octet_length(b) = 0 then 64 else (64 - octet_length(b) % 64) % 64 end)::int) as h from d)
select doc_id, greatest(1, ceil(n / 64.0))::int as height, 16::int as width, sha256(regexp_replace(h, '(..)(..)(..)..', '\\3\\2\\1', 'g')) as pixels from p""")
def bmp_pixels(t):
    """Each whole text as a bitmap of 16 pixels of 32 bits in a row, from the top, decoded to red, green and blue."""
    pages = _pages(t("documents"), "doc_id")
    little = lambda c: F.concat(*(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), k, 2) for k in (15, 13, 11, 9)))
    tall = F.col("height").cast("long")
    head = F.concat(F.lit("424D"), little(tall * 64 + 54), F.lit("0000000036000000" + "28000000" + "10000000"), little((1 << 32) - tall), F.lit("01002000" + "00" * 24))
    files = pages.select("doc_id", F.concat(F.unhex(head), "data").alias("content"))
    return images.images(files, ["doc_id"]).select("doc_id", "height", "width", F.sha2(F.hex("data"), 256).alias("pixels"))


@query("""with d as (select doc_id, coalesce(text, '') as s from documents),
n as (select doc_id, unnest([1, 2, 3])::int as class_id, unnest([length(regexp_replace(s, '[^\\x40-\\x7F]', '', 'g')), octet_length(encode(s)) - length(s), length(regexp_replace(s, '[\\x00-\\x7F]', '', 'g'))])::bigint as n_px from d)
select doc_id, class_id, n_px from n where n_px > 0""")
def recognise_tiles(t):
    """Pixels of each class of each whole text's page, in tiles of seven rows; the model's classes are quarters of the range of a byte."""
    pages = _pages(t("documents"), "segment_id")
    rows = pages.select("segment_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda k: F.substring("data", k * 64 + 1, F.lit(64)))).alias("y", "data"))

    def load():
        return lambda tiles: [tile // 64 for tile in tiles]

    found = recognition.recognised(rows, 64, load, 7, 1)
    return found.groupBy(F.col("segment_id").alias("doc_id"), "class_id").agg(F.count("*").alias("n_px"))


@query("""select (c_nationkey * 5 + 0.5)::double as start_m, (c_nationkey * 5 + 5.5)::double as end_m, row_number() over (partition by c_nationkey order by o_orderkey)::int as row, o_orderkey, o_totalprice::double as price,
case when o_orderkey % 5 > 0 then o_orderpriority end as priority from orders join customer on o_custkey = c_custkey""")
def workbook_files(t):
    """A workbook file of orders for each nation, named by an interval, written by tasks and read back in order of the interval."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.col("c_nationkey") * 5 + F.lit(0.5)
    name = F.regexp_replace(logs.interval_name(start, start + 5), r"png$", "xlsx")
    sheet = o.select(name.alias("book"), "o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"))
    path = _new_folder(t, "books")
    folder.write_files(xlsx.workbooks({"orders": (sheet, ["o_orderkey"])}, "book"), path, "book")
    read = logs.tables_by_interval(xlsx.scan(sheet.sparkSession, path), "orders")
    cell = lambda c, kind: F.col("values")[c].cast(kind).alias(c)
    return read.select("start_m", "end_m", "row", cell("o_orderkey", "long"), cell("price", "double"), cell("priority", "string"))


@query(f"""with p as (select segment_id, count(*) as n from (select distinct segment_id, y, x from ({_STROKES})) group by 1)
select segment_id, segment_id % 7 = 0 as failed, case when segment_id % 7 > 0 then n else 0 end::bigint as n_px from p""")
def image_stage(t):
    """Rasters as PNG files, a stage that halves their brightness, and the foreground of what it wrote; every seventh file is broken."""
    spark = t("part").sparkSession
    source, target = _new_folder(t, "images"), _new_folder(t, "halved")
    dots = _strokes(t).select("segment_id", "y", "x", *(F.lit(v).alias(c) for c, v in (("r", 128), ("g", 64), ("b", 2))))
    made = png.render(dots, 256, 256).select(F.concat("segment_id", F.lit(".png")).alias("path"), F.when(F.col("segment_id") % 7 == 0, F.lit("no image").cast("binary")).otherwise(F.col("png")).alias("content"))
    folder.write_files(made, source)
    ident = F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("segment_id")
    done = images.run_stage(spark, source, target, lambda image: image // 2).select(ident, F.col("error").isNotNull().alias("failed"))
    read = png.foreground(images.scan(spark, target).select(ident, F.col("content").alias("png"))).groupBy("segment_id").agg(F.count("*").alias("n_px"))
    return done.join(read, "segment_id", "left").select("segment_id", "failed", F.coalesce("n_px", F.lit(0)).alias("n_px"))


@query("select p_partkey as path, 2::int as line from part where p_partkey % 6 = 0")
def syntax_check(t):
    """A module of three lines for each part; every sixth has an assignment without a value."""
    text = F.concat(F.lit("a = "), F.col("p_size"), F.when(F.col("p_partkey") % 6 == 0, "\nb = = 1\n").otherwise("\nb = a + 1\n"), F.lit("print(b)\n"))
    return audits.syntax_errors(t("part").select(F.col("p_partkey").alias("path"), text.alias("text"))).select("path", "line")
