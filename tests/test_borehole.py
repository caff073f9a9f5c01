"""Branches, apertures, reconnection and a whole hole, on drawn rasters."""

import math

import pytest
from pyspark.sql import functions as F

from strataspark.operators import aperture, branches, logs, raster, reconnect
from strataspark.plans import borehole
from strataspark.streaming import depth


def pixels(spark, points):
    return spark.createDataFrame([(1, y, x) for y, x in sorted(points)], "segment_id int, y int, x int")


def test_branch_types_and_order(spark):
    line = {(5, x) for x in range(20)}
    tee = {(20, x) for x in range(41)} | {(y, 20) for y in range(21, 35)}
    got = branches.branch_paths(pixels(spark, line | tee)).collect()
    kinds = {}
    for r in got:
        kinds.setdefault((r.root_y, r.root_x), []).append(r)
    ends = [v for v in kinds.values() if v[0].branch_type == branches.END_END]
    assert len(ends) == 1 and [(r.y, r.x) for r in sorted(ends[0], key=lambda r: r.pos)] == [(5, x) for x in range(20)]
    assert sum(v[0].branch_type == branches.JUNCTION_END for v in kinds.values()) == 3


def test_aperture_of_a_band(spark):
    band = {(y, x) for y in range(10, 17) for x in range(60)}
    mask = pixels(spark, band)
    samples = spark.createDataFrame([(1, i, 13, x, 90.0) for i, x in enumerate(range(10, 50, 10))], "segment_id int, id long, y int, x int, normal_deg double")
    assert {round(r.width_mm, 6) for r in aperture.ray_widths(samples, mask, 40, 0.5).collect()} == {3.0}


def test_broken_line_is_joined(spark):
    left, right = {(30, x) for x in range(5, 40)}, {(30, x) for x in range(46, 80)}
    mask = pixels(spark, left | right)
    ends = reconnect.path_ends(branches.branch_paths(mask), 10)
    ends = reconnect.local_widths(ends, mask).withColumn("width", F.lit(4))
    # discs of the other end that already cover this one stop it at once, so both reach into the gap only
    new = reconnect.extensions(mask.withColumn("class", F.lit("red")), reconnect.grown(ends, mask, 3, 64, 96))
    assert {(r.y, r.x) for r in new.collect()} >= {(30, x) for x in range(40, 46)}
    assert {r["class"] for r in new.collect()} == {"red"}


def test_whole_hole(spark):
    width, ratio = 240, 76 * math.pi / 240
    trace = set()
    for x in range(width):
        z = 150 + 38 / ratio * math.tan(math.radians(40)) * math.cos(2 * math.pi * x / width - math.radians(120))
        trace |= {(round(z) + d, x) for d in range(3)}
    other = {(400 + x // 4 + d, x) for x in range(20, 200) for d in range(3)}
    mask = pixels(spark, trace | other).withColumn("class", F.lit("filled"))
    segments = spark.createDataFrame([(1, 10.0, 10.5, ratio, 500)], "segment_id int, start_depth_m double, end_depth_m double, ratio_v double, rows int")
    found = borehole.fracture_table(mask, segments, width, area=50).orderBy("depth_m").collect()
    steep = found[0]
    assert steep.depth_m == pytest.approx(10 + 0.151 * ratio, abs=0.005)
    assert steep.dip_angle_deg == pytest.approx(40, abs=2) and steep.dip_direction_deg == pytest.approx(120, abs=4)
    assert steep.fractype == "filled" and steep.trace_mm > 200
    assert steep.aperture_mm == pytest.approx(2 * ratio, rel=0.35)
    assert (steep.normal_x**2 + steep.normal_y**2 + steep.normal_z**2) == pytest.approx(1) and math.degrees(math.acos(steep.normal_z)) == pytest.approx(steep.dip_angle_deg)
    table = spark.createDataFrame([(1, 1, 10.2), (1, 2, 10.5), (1, 3, 10.6)], "segment_id int, fracture_id int, depth_m double")
    kept, rejected = borehole.collect_hole(table, segments)
    assert [r.fracture_id for r in kept.collect()] == [1, 2] and [r.reason for r in rejected.collect()] == ["below segment"]
    with pytest.raises(ValueError):
        borehole.collect_hole(table, segments.union(segments.selectExpr("segment_id + 1", "start_depth_m + 0.6", "end_depth_m + 0.6", "ratio_v", "rows")))
    log = spark.createDataFrame([(1.0, 0.0, 0.0), (2.0, 125.0, 45.0)], "depth_m double, dip_direction_deg double, dip_angle_deg double")
    m = borehole.evaluate_hole(log, log, 0.0, 10.0).first()
    assert (m.qpi, m.qai, m.cei, m.status) == (1, 1, 1, "complete")
    assert spark.range(1).select(logs.interval_name(F.lit(45.0), F.lit(46.3))).first()[0] == "segment_45m_to_46.3m.png"


def test_stream_equals_table(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(data)
    run = depth.time_bins(stream, "ts", "value").writeStream.outputMode("complete").format("memory").queryName("bins").trigger(availableNow=True).start()
    run.awaitTermination(120)
    whole = {(r.bin_start, r.n) for r in depth.time_bins(events, "ts", "value").collect()}
    assert {(r.bin_start, r.n) for r in spark.table("bins").collect()} == whole
