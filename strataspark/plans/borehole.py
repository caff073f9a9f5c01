"""From frames or class masks to fracture tables, a whole-hole table, its score, and its report as a workbook."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.functions.geometry import CLASSES, orientation_of
from strataspark.functions.shared import held
from strataspark.operators import aperture, audits, branches, evaluation, logs, mosaic, paths, planes, raster, recognition, reconnect, tables
from strataspark.sources import folder as files
from strataspark.sources import png, xlsx

#: Defaults of a whole run.
AREA, ASPECT, FILL, SHORTEST, MOST_MEAN, MOST_STD = 100, 0.5, 0.5, 20, 1.7, 1.5
REFERENCE, STEPS, PRUNINGS, CONTOUR_AREA, REACH = 50, 10, 1, 100.0, 1000.0

#: The colour of each class in a mask that is reconnected (red, green, blue in brackets).
COLOUR_OF = {"filled": "red", "unfilled": "green", "cemented": "yellow", "halffilled": "mixed"}
RGB = {"red": (128, 0, 0), "green": (0, 128, 0), "yellow": (128, 128, 0), "mixed": (0, 0, 128)}

#: Sheets of a hole's report, columns of its metrics, and the lines of its method.
SHEETS = {"metrics": "评价指标", "fractures": "全孔裂隙参数", "log": "标准裂隙", "method": "计算说明", "rejected": "孔段范围外裂隙"}
METRICS = {"qpi": "QPI", "qai": "QAI", "cei": "CEI", "n_pred": "预测裂隙数", "n_ref": "标准裂隙数", "n_out_of_range": "全孔范围外预测数", "start_m": "起始深度(m)", "end_m": "终止深度(m)", "length_m": "评价长度(m)", "status": "状态"}
LOG_COLUMNS = {"row": "源Excel行号", "depth": "深度(m)", "azimuth": "倾向(°)", "dip": "倾角(°)"}
NO_PLANES, DONE = "无预测裂隙，三个指标为0", "已计算"
REASON = ("筛除原因", "拟合中心不在所属孔段深度范围")
METHOD = (
    ("标准来源", "{log}"),
    ("数据顺序与单位", "深度(m)、倾向(度)、倾角(度)；倾向为正北起顺时针"),
    ("QPI", "1 - 深度差绝对值 / 全孔长度"),
    ("QAI", "两个单位法向量点积的绝对值"),
    ("CEI", "每对裂隙 QPI × QAI 后再独立最优匹配"),
    ("匹配方法", "三个指标各自最优匹配；未匹配记0；除以预测与标准数量较大值"),
    ("孔段归属", "{rule}"),
    ("合并规则", "不根据相近深度自动合并裂隙"),
    ("范围外预测", "保留并参与评价；QPI按原公式计算，不截断负值"),
    ("筛除数量", "{rejected}"),
    ("类型", "裂隙类型保留在参数表中，不参与这三个评价指标计算"),
)
RULES = {True: "左闭右开，末段含终点", False: "保留全部拟合结果"}
METHOD_COLUMNS = ("项目", "说明")


def skeleton_branches(mask: DataFrame, shortest: int = SHORTEST, prunings: int = PRUNINGS) -> DataFrame:
    """Ordered branches of a mask's skeleton, after so many rounds of pruning spurs, without short ones and cycles."""
    thin = raster.skeletonize(mask.select("segment_id", "y", "x"))
    for _ in range(prunings):
        thin = held(raster.prune_spurs(thin, shortest), "pruned")
    return held(branches.long_branches(branches.branch_paths(thin), shortest), "ways")


def clustered_points(ways: DataFrame, mask: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Points (segment_id, cluster_id, pos, y, x) of coplanar clusters in order of joining, and each cluster's class (its first branch's)."""
    key = F.xxhash64("root_y", "root_x").alias("branch_id")
    points = ways.select("segment_id", key, "pos", "y", "x")
    vote = paths.class_vote(points.join(mask.withColumn("fractype", F.col("class")).drop("class"), ["segment_id", "y", "x"]).withColumn("k", F.struct("segment_id", "branch_id")), "k", "fractype", list(CLASSES))
    vote = vote.select(F.col("k.segment_id").alias("segment_id"), F.col("k.branch_id").alias("branch_id"), F.col("winner").alias("fractype"))
    whole = points.groupBy("segment_id", "branch_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("y").cast("double").alias("z"), F.col("x").cast("double").alias("x")))).alias("p"))
    whole = whole.join(vote, ["segment_id", "branch_id"], "left").select("segment_id", "branch_id", F.coalesce("fractype", F.lit("unknown")).alias("fractype"), F.transform("p", lambda v: F.struct(v["z"].alias("z"), v["x"].alias("x"))).alias("path"))
    whole = held(whole, "whole")
    member = held(branches.cluster_branches(whole, width, MOST_MEAN, MOST_STD), "clusters")
    kinds = member.where("place = 0").join(whole.select("segment_id", "branch_id", "fractype"), ["segment_id", "branch_id"]).select("segment_id", "cluster_id", "fractype")
    order = F.row_number().over(Window.partitionBy("segment_id", "cluster_id").orderBy("place", "pos")) - 1
    owned = points.join(member, ["segment_id", "branch_id"]).select("segment_id", "cluster_id", order.alias("pos"), "y", "x")
    return held(owned, "owned"), kinds


def fractures_of(mask: DataFrame, segments: DataFrame, width: int, diameter_mm: float = 76.0, shortest: int = SHORTEST, prunings: int = PRUNINGS) -> DataFrame:
    """One row for each fracture of each segment of a mask as it is: see fracture_table."""
    mask = held(mask.select("segment_id", "y", "x", "class"), "mask")
    return _fractures(skeleton_branches(mask, shortest, prunings), mask, segments, width, diameter_mm)


def _fractures(ways: DataFrame, mask: DataFrame, segments: DataFrame, width: int, diameter_mm: float) -> DataFrame:
    owned, kinds = clustered_points(ways, mask, width)
    radius = diameter_mm / 2
    theta = F.col("x") * (2 * math.pi / width)
    on, scale = ["segment_id", "cluster_id"], segments.select("segment_id", "ratio_v", "start_depth_m", "rows")
    placed = owned.join(scale.select("segment_id", "ratio_v"), "segment_id")
    fit = planes.fit_planes(placed, on, F.lit(radius) * F.cos(theta), F.lit(radius) * F.sin(theta), F.col("y") * F.col("ratio_v"))
    fit = planes.axis_crossings(fit.join(scale, "segment_id"), F.lit(radius), F.col("rows") * F.col("ratio_v"))
    w = Window.partitionBy(*on).orderBy("pos")
    step = F.sqrt(F.pow(F.col("y") - F.lag("y").over(w), 2) + F.pow(F.col("x") - F.lag("x").over(w), 2)) * F.col("ratio_v")
    trace = placed.withColumn("step", step).groupBy(*on).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("trace_mm"))
    samples = held(aperture.sampled_normals(owned, path=on), "samples")
    widths = aperture.ray_widths(samples, mask, REACH, least_area=CONTOUR_AREA).join(samples.select(*on, "id"), ["segment_id", "id"])
    wide = widths.join(scale.select("segment_id", "ratio_v"), "segment_id").groupBy(*on).agg(F.avg(F.col("width_mm") * F.col("ratio_v")).alias("aperture_mm"))
    # theta 0 is north, a quarter turn is east, rows count downwards
    up = F.when(F.col("n_z") < 0, 1.0).otherwise(-1.0)
    normal = {"normal_x": up * F.col("n_y") + 0.0, "normal_y": up * F.col("n_x") + 0.0, "normal_z": F.abs("n_z")}
    azimuth, dip = orientation_of(F.col("n_y"), F.col("n_x"), -F.col("n_z"))
    out = fit.join(trace, on).join(wide, on, "left").join(kinds, on)
    depth = F.col("start_depth_m") + F.col("center") / 1000
    out = out.select("segment_id", depth.alias("depth_m"), azimuth.alias("dip_direction_deg"), dip.alias("dip_angle_deg"), "aperture_mm", "trace_mm", (F.col("aperture_mm") * F.col("trace_mm")).alias("flaw_mm2"), "n_px", "fractype", *(c.alias(n) for n, c in normal.items()), "cluster_id")
    return out.withColumn("fracture_id", F.row_number().over(Window.partitionBy("segment_id").orderBy("depth_m", "cluster_id"))).drop("cluster_id")


def repaired(mask: DataFrame, segments: DataFrame, width: int, area: float = AREA, aspect: float = ASPECT, fill: float = FILL, reference: int = REFERENCE, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """A mask (segment_id, y, x, class) without small components: as it is, and with its broken traces reconnected."""
    kept = held(raster.eliminate(mask.select("segment_id", "y", "x"), area, aspect, fill).select("segment_id", "y", "x"), "kept")
    clean = held(mask.join(kept, ["segment_id", "y", "x"], "left_semi").select("segment_id", "y", "x", "class"), "clean")
    colour = F.create_map(*(F.lit(v) for pair in COLOUR_OF.items() for v in pair))
    name = F.create_map(*(F.lit(v) for k, c in COLOUR_OF.items() for v in (c, k)))
    joined, _ = reconnect.reconnect(clean.withColumn("class", colour[F.col("class")]), segments.select("segment_id", "rows"), width, reference, steps)
    return clean, held(joined.withColumn("class", name[F.col("class")]), "joined")


def fracture_table(mask: DataFrame, segments: DataFrame, width: int, diameter_mm: float = 76.0, area: float = AREA, shortest: int = SHORTEST, reference: int = REFERENCE, steps: int = STEPS) -> DataFrame:
    """One row for each fracture of each segment.

    mask: segment_id, y, x, class (foreground only); segments: segment_id, start_depth_m, ratio_v (mm for each
    row), rows. Components are filtered and broken traces reconnected; the mask is thinned, freed of spurs, and cut into
    branches, which are put into coplanar clusters. Each cluster becomes a plane, with the trace in order of joining and the
    mean width along it, measured at every tenth point across its four nearest, between contours of more than CONTOUR_AREA.
    """
    return fractures_of(repaired(mask, segments, width, area, reference=reference, steps=steps)[1], segments, width, diameter_mm, shortest)


def cut_segments(frames: DataFrame, length_m: float, diameter_mm: float = 76.0, height_m: float = 5.0, start_depth_m: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Depth segments of a hole's frames (frame_idx, height, width, data: three bytes a pixel), and their rows.

    segments: segment_id, start_depth_m, end_depth_m, ratio_v, ratio_h, rows, width, name. rows: segment_id, y, data, scaled to the
    segments' width, at which a pixel is about as wide as high. ValueError where there are too few rows for a column, or
    for a row in each segment.
    """
    spark = frames.sparkSession
    whole = held(mosaic.mosaic(held(mosaic.frame_rows(frames), "rows")), "mosaic")
    n = whole.count()
    if not n:
        raise ValueError("the frames have no rows")
    segments = tables.depth_segments(spark.createDataFrame([(n,)], "n long"), F.col("n"), length_m, diameter_mm, height_m, start_depth_m)
    width = int(n / (length_m * 1000) * math.pi * diameter_mm)
    if width < 1:
        raise ValueError("too few rows for a column of the hole's wall")
    if not segments.where("pixel_end <= pixel_start").isEmpty():
        raise ValueError("a segment has no row")
    named = segments.select(F.col("segment_idx").alias("segment_id"), "start_depth_m", "end_depth_m", F.lit(length_m * 1000 / n).alias("ratio_v"), F.lit(math.pi * diameter_mm / width).alias("ratio_h"), (F.col("pixel_end") - F.col("pixel_start")).cast("int").alias("rows"), F.lit(width).alias("width"), logs.interval_name(F.col("start_depth_m"), F.col("end_depth_m")).alias("name"), "pixel_start")
    at = mosaic.segment_of(F.col("mosaic_row"), F.lit(n), length_m, height_m).cast("int")
    placed = whole.withColumn("segment_id", at).join(named.select("segment_id", "pixel_start"), "segment_id")
    # a row is an image of one row; its number stands for the frame's
    thin = placed.select(F.col("mosaic_row").cast("long").alias("frame_idx"), F.lit(1).alias("height"), (F.octet_length("data") / 3).cast("int").alias("width"), "data")
    scaled = png.resized_rows(thin, width, 3).select(F.col("frame_idx").alias("mosaic_row"), "data")
    back = mosaic.segment_of(F.col("mosaic_row"), F.lit(n), length_m, height_m).cast("int")
    rows = scaled.withColumn("segment_id", back).join(named.select("segment_id", "pixel_start"), "segment_id").select("segment_id", (F.col("mosaic_row") - F.col("pixel_start")).cast("int").alias("y"), "data")
    return held(named.drop("pixel_start"), "segments"), held(rows, "images")


def whole_images(rows: DataFrame, width: int) -> DataFrame:
    """(segment_id, png) of segments' rows (segment_id, y, data)."""

    @F.arrow_udf("binary")
    def encoded(heights, data):
        import numpy as np
        import pyarrow as pa

        return pa.array([png.encode(np.frombuffer(d.as_buffer(), np.uint8).reshape(h.as_py(), width, 3)) for h, d in zip(heights, data, strict=True)], pa.binary())

    one = recognition.tiles(rows, 1 << 30)
    return one.select("segment_id", encoded("height", "data").alias("png"))


def mask_images(mask: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """(segment_id, png) of masks in the colours of their classes; black where a segment has nothing."""
    colour = F.create_map(*(x for k, c in COLOUR_OF.items() for x in (F.lit(k), F.struct(*(F.lit(v).alias(n) for n, v in zip("rgb", RGB[c], strict=True))))))
    dots = mask.join(segments.select("segment_id", "rows"), "segment_id").select("segment_id", "rows", "y", "x", colour[F.col("class")].alias("c")).select("segment_id", "rows", "y", "x", "c.*")
    empty = segments.select("segment_id", "rows", *(F.lit(0).alias(c) for c in ("y", "x", "r", "g", "b")))
    return png.render(dots.unionByName(empty), F.col("rows"), width)


def run_hole(frames: DataFrame, log_rows: DataFrame, load: Callable[[], recognition.Predict], classes: dict[int, str], out: str, *, length_m: float, start_depth_m: float = 0.0, diameter_mm: float = 76.0, height_m: float = 5.0, tile_rows: int = 1000, area: float = AREA, aspect: float = ASPECT, fill: float = FILL, reference: int = REFERENCE, steps: int = STEPS, prunings: int = PRUNINGS, shortest: int = SHORTEST, log_name: str = "log.xlsx", keep_intermediate: bool = False) -> dict[str, DataFrame]:
    """A whole run: frames of a hole to segments, masks, fracture tables, and a report, all written under `out`.

    log_rows: rows (row, cells) of the manual log's sheet; load makes the recogniser, and classes name what it returns.
    `out` gets the folders borehole_segments, recognize, eliminate and extension with an image for each segment, and
    result with a parameter table for each segment and the report; with keep_intermediate also binary images and
    skeletons. Folders must be empty, so that runs do not mix. Returns segments, fractures, rejected and metrics.
    """
    for name in ("length_m", "diameter_mm", "height_m", "shortest"):
        if not math.isfinite(value := locals()[name]) or value <= 0:
            raise ValueError(f"{name} must be positive")
    folders = {f: f"{out.rstrip('/')}/{f}" for f in ("borehole_segments", "recognize", "eliminate", "extension", "result")}
    for f in folders.values():
        if not files.is_empty(f):
            raise FileExistsError(f"the folder is not empty: {f}")
    log = held(logs.log_planes(log_rows.withColumn("hole_", F.lit(1)), ["hole_"]), "log")
    outside = ~F.coalesce(F.col("depth").between(start_depth_m - 1e-8, start_depth_m + length_m + 1e-8), F.lit(False))
    if log.isEmpty():
        raise ValueError("the log has no planes")
    if not log.where(outside | F.col("reason").isNotNull()).isEmpty():
        raise ValueError("a plane of the log is wrong, or lies outside the hole")

    segments, rows = cut_segments(frames, length_m, diameter_mm, height_m, start_depth_m)
    width = segments.first()["width"]
    images = lambda df: df.join(segments.select("segment_id", "name"), "segment_id").select(F.col("name").alias("path"), F.col("png").alias("content"))
    files.write_files(images(whole_images(rows, width)), folders["borehole_segments"])
    kind = F.create_map(*(F.lit(v) for pair in classes.items() for v in pair))
    found = held(recognition.recognised(rows, width, load, tile_rows).select("segment_id", "y", "x", kind[F.col("class_id")].alias("class")), "recognised")
    clean, joined = repaired(found, segments, width, area, aspect, fill, reference, steps)
    for f, mask in (("recognize", found), ("eliminate", clean), ("extension", joined)):
        files.write_files(images(mask_images(mask, segments, width)), folders[f])
    ways = skeleton_branches(joined, shortest, prunings)
    fractures = held(_fractures(ways, joined, segments, width, diameter_mm), "fractures")
    stem = F.regexp_replace("name", r"\.png$", "")
    if keep_intermediate:
        for part, points in (("binary", joined), ("branches", ways)):
            white = points.select("segment_id", "y", "x").distinct().withColumns({c: F.lit(255) for c in "rgb"})
            empty = segments.select("segment_id", *(F.lit(0).alias(c) for c in ("y", "x", "r", "g", "b")))
            drawn = png.render(white.unionByName(empty).join(segments.select("segment_id", "rows"), "segment_id"), F.col("rows"), width)
            files.write_files(drawn.join(segments.select("segment_id", stem.alias("stem")), "segment_id").select(F.concat("stem", F.lit(f"-{part}.png")).alias("path"), F.col("png").alias("content")), folders["result"], into_used=True)
    per_segment = logs.parameter_table(fractures.join(segments.select("segment_id", stem.alias("book_")), "segment_id"), ["book_"], ["depth_m", "fracture_id"])
    books = xlsx.workbooks({logs.SHEET: (per_segment, [logs.LABELS["number"]])}, "book_")
    files.write_files(books.select(F.concat("book", F.lit("-fracture_parameters.xlsx")).alias("path"), "content"), folders["result"], into_used=True)
    return save_report(fractures, segments, log, f"{folders['result']}/borehole_evaluation.xlsx", length_m, start_depth_m, log_name=log_name) | {"segments": segments}


def save_report(fractures: DataFrame, segments: DataFrame, log: DataFrame, path: str, length_m: float, start_depth_m: float = 0.0, *, to_segment: bool = False, log_name: str = "log.xlsx") -> dict[str, DataFrame]:
    """Collects and scores a hole and writes its report; returns fractures, rejected and metrics.

    log: planes (row, depth, azimuth, dip). ValueError where segments leave gaps, overlap, or don't cover the hole.
    """
    ends = segments.agg(F.min("start_depth_m"), F.max("end_depth_m")).first()
    if ends[0] is None or not (math.isclose(ends[0], start_depth_m, abs_tol=1e-8) and math.isclose(ends[1], start_depth_m + length_m, rel_tol=1e-5)):
        raise ValueError("the segments don't cover the hole")
    kept, rejected = (held(df, "collected") for df in collect_hole(fractures, segments, to_segment))
    planes_ = log.select(F.col("depth").alias("depth_m"), F.col("azimuth").alias("dip_direction_deg"), F.col("dip").alias("dip_angle_deg"))
    metrics = held(evaluate_hole(kept, planes_, start_depth_m, length_m), "metrics")
    xlsx.write_report(path, report(kept, rejected, metrics, log, segments, to_segment, log_name))
    return {"fractures": kept, "rejected": rejected, "metrics": metrics}


def collect_hole(fractures: DataFrame, segments: DataFrame, to_segment: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole hole's fractures in order of depth, and those that lie outside their segment, with the reason.

    A segment holds [start, end); the last one its end as well. Without to_segment all stay in the first table, and
    the second is empty. ValueError where a segment doesn't begin at the end of the one before.
    """
    ordered = tables.with_contiguity(segments.withColumn("hole_", F.lit(1)), ["hole_"], ["start_depth_m", "end_depth_m"], F.col("start_depth_m"), "end_depth_m")
    if not ordered.where("not contiguous").isEmpty():
        raise ValueError("segments overlap or leave a gap")
    last = segments.agg(F.max("end_depth_m").alias("hole_end"))
    named = segments.select("segment_id", F.col("start_depth_m").alias("from_m"), F.col("end_depth_m").alias("to_m"), *(["name"] if "name" in segments.columns else []))
    both = fractures.join(named, "segment_id").join(F.broadcast(last))  # one row
    inside = (F.col("depth_m") >= F.col("from_m")) & ((F.col("depth_m") < F.col("to_m")) | ((F.col("to_m") == F.col("hole_end")) & (F.col("depth_m") == F.col("to_m"))))
    both = both.withColumn("reason", F.when(F.col("depth_m") < F.col("from_m"), "above segment").when(~inside, "below segment"))
    kept, out = (both.where("reason is null"), both.where("reason is not null")) if to_segment else (both, both.where("false"))
    return kept.drop("reason", "hole_end").orderBy("depth_m", "segment_id", "fracture_id"), out.drop("hole_end")


def evaluate_hole(fractures: DataFrame, log: DataFrame, start_m: float, length_m: float) -> DataFrame:
    """One row: QPI, QAI, CEI, counts, predictions out of range. Both tables: depth_m, dip_direction_deg, dip_angle_deg.

    A row that is no plane (see validated_triples) stops the job, and so does a log without rows.
    """
    end_m = start_m + length_m

    def planes_of(df: DataFrame) -> DataFrame:
        checked = tables.validated_triples(df.select(F.monotonically_increasing_id().alias("id"), F.col("depth_m").alias("depth"), F.col("dip_direction_deg").alias("az_"), F.col("dip_angle_deg").alias("dip_")), F.col("depth"), F.col("az_"), F.col("dip_"))
        bad = F.raise_error(F.concat(F.lit("no plane at depth "), F.coalesce(F.col("depth").cast("string"), F.lit("null")), F.lit(": "), F.col("reason")))
        return checked.select(F.lit(1).alias("hole"), "id", F.when(F.col("reason").isNull(), F.col("depth")).otherwise(bad.cast("double")).alias("depth"), "azimuth", "dip")

    pred, ref = held(planes_of(fractures), "pred"), held(planes_of(log), "ref")
    if ref.isEmpty():
        raise ValueError("the reference log has no planes")
    outside = ~F.col("depth").between(start_m - 1e-8, end_m + 1e-8)
    counts = pred.agg(F.count("*").alias("n_pred"), F.count_if(outside).alias("n_out_of_range")).join(F.broadcast(ref.agg(F.count("*").alias("n_ref")))).withColumn("hole", F.lit(1))
    q = evaluation.quality_indices(evaluation.score_matrix(pred, ref, "hole", length_m), counts.select("hole", "n_pred", "n_ref"), "hole")
    q = q.join(counts.select("hole", "n_out_of_range"), "hole").drop("hole")
    return q.withColumns({"start_m": F.lit(start_m), "end_m": F.lit(end_m), "length_m": F.lit(length_m), "status": F.when(F.col("n_out_of_range") == 0, "complete").otherwise("out of range")})


def _parameters(fractures: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """The labelled table of a whole hole, with the segment that each fracture comes from."""
    source = F.regexp_replace("name", r"\.png$", "") if "name" in fractures.columns else F.col("segment_id").cast("string")
    named = fractures.withColumns({"hole_": F.lit(1), "segment_name": source, "segment_fracture_id": F.col("fracture_id"), "segment_start": F.col("from_m"), "segment_end": F.col("to_m")})
    table = logs.parameter_table(named, ["hole_"], ["depth_m", "segment_id", "fracture_id"]).drop("hole_")
    return table.withColumns(extra or {})


def report(fractures: DataFrame, rejected: DataFrame, metrics: DataFrame, log: DataFrame, segments: DataFrame, to_segment: bool = False, log_name: str = "log.xlsx") -> dict[str, tuple[DataFrame, list[str]]]:
    """Sheets of a hole's report with the columns that order them; rejected fractures have one only where there are any.

    fractures and rejected are those of collect_hole, log has the planes (row, depth, azimuth, dip) of the manual log.
    """
    spark = fractures.sparkSession
    n = rejected.count()
    said = {"log": log_name, "rule": RULES[to_segment], "rejected": str(n)}
    method = spark.createDataFrame([(k, name, text.format(**said)) for k, (name, text) in enumerate(METHOD)], "place int, `项目` string, `说明` string")
    status = F.when(F.col("n_pred") == 0, NO_PLANES).otherwise(DONE)
    labelled = metrics.withColumn("status", status).select(*(F.col(c).alias(label) for c, label in METRICS.items()))
    number = logs.LABELS["number"]
    out = {
        SHEETS["metrics"]: (labelled, []),
        SHEETS["fractures"]: (_parameters(fractures), [number]),
        SHEETS["log"]: (log.select(*(F.col(c).alias(label) for c, label in LOG_COLUMNS.items())), [LOG_COLUMNS["row"]]),
        SHEETS["method"]: (method, ["place"]),
    }
    return out if not n else out | {SHEETS["rejected"]: (_parameters(rejected, {REASON[0]: F.lit(REASON[1])}), [number])}


def summarise(tables_folder: str, out: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Unites the parameter workbooks of a folder, and writes all fractures and a row for each type as CSV under `out`.

    Returns both tables. FileNotFoundError where the folder has no parameter table.
    """
    rows = held(xlsx.scan(spark, tables_folder), "workbooks")
    if rows.where(F.col("sheet") == logs.SHEET).isEmpty():
        raise FileNotFoundError(f"no parameter tables in {tables_folder}")
    whole = held(logs.all_segments(rows), "whole")
    means = {"mean_aperture_mm": "aperture_mm", "mean_trace_length_mm": "trace_length_mm"}
    kinds = tables.type_summary(whole, "fracture_type", "fracture_id", means)
    audits.write_csv(whole.orderBy("segment_start_m", "fracture_id"), f"{out.rstrip('/')}/all_segment_fractures")
    audits.write_csv(kinds.orderBy("fracture_type"), f"{out.rstrip('/')}/fracture_type_summary")
    return whole, kinds
