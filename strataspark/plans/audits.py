"""Queries of the checks in operators.audits, over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataspark.functions.shared import shared_dir
from strataspark.operators import audits

from .carriers import query


@query("select count(*) as n_rows, count(*) filter (where not coalesce(o_totalprice between 1000 and 300000, false)) as n_outside, count(*) filter (where not coalesce(o_totalprice between 1000 and 300000, false)) = 0 as passed from orders")
def depth_bounds(t):
    return audits.all_within(t("orders"), F.col("o_totalprice"), 1000, 300000)


@query("select c_custkey as hole, segment as dip, name as azimuth from (select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment, case when c_custkey % 3 = 0 then c_name end as name from customer) where segment is not null or name is not null")
def empty_rows_skipped(t):
    c = t("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("c_name"))
    kept = audits.without_empty_rows(c, ["c_mktsegment", "c_name"])
    return audits.required_columns(kept, ["c_custkey", "c_mktsegment", "c_name"], {"c_custkey": "hole", "c_mktsegment": "dip", "c_name": "azimuth"})


@query("select c_custkey as hole, s as stage from customer, (values ('F'), ('O'), ('P')) v(s) where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = s)")
def stage_presence(t):
    found = t("orders").select(F.col("o_custkey").alias("hole"), F.col("o_orderstatus").alias("stage")).distinct()
    return audits.missing_outputs(t("customer").select(F.col("c_custkey").alias("hole")), ["F", "O", "P"], found, "hole")


_IMAGES = """with i as (select l_suppkey as hole, l_returnflag as stage, count(*) as foreground, max(l_linenumber) as height, 1 as width from lineitem group by 1, 2),
w as (select hole, count(distinct (height, width)) as shapes, max(case when stage = 'A' then foreground end) as a, max(case when stage = 'N' then foreground end) as n, max(case when stage = 'R' then foreground end) as r from i group by 1)
select hole, 'shapes differ' as violation from w where shapes > 1 union all select hole, 'N has more foreground than A' from w where n > a union all select hole, 'R has more foreground than N' from w where r > n"""


@query(_IMAGES)
def stage_outputs(t):
    line = t("lineitem").select(F.col("l_suppkey").alias("hole"), F.col("l_returnflag").alias("stage"), "l_linenumber")
    shapes = line.groupBy("hole", "stage").agg(F.max("l_linenumber").alias("height"), F.lit(1).alias("width"))
    return audits.stage_violations(audits.foreground_by_stage(line, ["hole", "stage"]).join(shapes, ["hole", "stage"]), "hole", ["A", "N", "R"])


@query("select l_suppkey as hole, l_linestatus as \"class\", count(*) as n_px from lineitem group by 1, 2")
def class_pixels(t):
    return audits.class_counts(t("lineitem").select(F.col("l_suppkey").alias("hole"), F.col("l_linestatus").alias("class")), ["hole"])


@query("select l_orderkey as row_id, round(avg(l_quantity), 6) as mean_value from lineitem group by 1 having avg(l_quantity) <= 25")
def white_rows(t):
    means = t("lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.avg("l_quantity").alias("m"))
    return audits.content_rows(means, F.col("m"), 25.0).select("row_id", (F.round("m", 6) + 0.0).alias("mean_value"))


@query("select count(*) as n_files, coalesce(sum(octet_length(encode(coalesce(html, '')))), 0)::bigint as bytes, count(*) filter (where octet_length(encode(coalesce(html, ''))) >= 4000) as too_large, coalesce(sum(octet_length(encode(coalesce(html, '')))), 0) > 1000000 as total_too_large from pages")
def file_sizes(t):
    return audits.size_limits(t("pages"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long"), 4000, 1_000_000)


@query("select 'part-' || p_partkey as path from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def required_paths(t):
    found = t("lineitem").where("l_quantity > 45").select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("path")).distinct()
    return audits.required_files(found, "path", t("part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("path")))


@query("select sha256(coalesce(html, '')) as sha256, 'pages/' || page_id as path from pages")
def manifest_file(t):
    """Written as lines, and read again."""
    pages = t("pages").select(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha256"), F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"))
    folder = f"{shared_dir(pages.sparkSession)}/manifest-{uuid.uuid4().hex}"
    audits.write_manifest(pages, folder)
    return audits.read_manifest(pages.sparkSession, folder)


@query("select s_suppkey::varchar as s_suppkey, s_name from supplier")
def csv_roundtrip(t):
    s = t("supplier").select("s_suppkey", "s_name")
    folder = f"{shared_dir(s.sparkSession)}/csv-{uuid.uuid4().hex}"
    audits.write_csv(s, folder)
    return s.sparkSession.read.option("header", True).csv(folder)
