"""Manual logs of planes in workbooks, tables of fracture parameters, and checks of a hole's segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import validated_triples

#: What a log's header cells start with (depth, dip direction, dip), and the sheet and columns of a parameter table.
HEADER = ("深度", "倾向", "倾角")
SHEET = "裂隙参数"
TYPE_NAMES = {"filled": "充填", "unfilled": "无充填", "cemented": "胶结", "halffilled": "半充填", "unknown": "未知"}
LABELS = {
    "number": "裂隙编号",
    "type_name": "裂隙类型",
    "fractype": "类型标识",
    "depth_m": "深度(m)",
    "aperture_mm": "开度(mm)",
    "trace_mm": "迹线长度(mm)",
    "flaw_mm2": "开度乘迹线长度(mm²)",
    "dip_direction_deg": "倾向(°)",
    "dip_angle_deg": "倾角(°)",
    "normal_x": "法向量X",
    "normal_y": "法向量Y",
    "normal_z": "法向量Z",
    "n_px": "骨架点数",
}
OPTIONAL = {"segment_name": "来源孔段", "segment_fracture_id": "孔段内编号", "segment_start": "孔段起点(m)", "segment_end": "孔段终点(m)"}


def _planes(rows: DataFrame, keys: list[str], cells: list[Column]) -> DataFrame:
    """(keys, row, depth, azimuth, dip, reason) of rows with any value in the three cells."""
    named = rows.select(*keys, "row", *(c.alias(f"cell{k}_") for k, c in enumerate(cells))).na.drop("all", subset=["cell0_", "cell1_", "cell2_"])
    number = [F.col(f"cell{k}_").try_cast("double") for k in range(3)]
    # a cell with text that is no number is wrong; only an empty azimuth may be missing
    azimuth = F.when(F.col("cell1_").isNotNull() & number[1].isNull(), float("inf")).otherwise(number[1])
    return validated_triples(named.withColumn("depth", number[0]), F.col("depth"), azimuth, number[2]).select(*keys, "row", "depth", "azimuth", "dip", "reason")


def log_planes(rows: DataFrame, keys: list[str], header: tuple[str, ...] = HEADER, most: int = 20) -> DataFrame:
    """Planes below the header of each sheet of rows (keys, row from 1, cells); row stays the sheet's own number.

    The header is the first of the first `most` rows in which each key starts exactly one cell, once spaces and line
    ends are gone. Rows without any of the three values don't count; `reason` tells why a row is no plane. Sheets
    without a header give no rows: see `without_header`.
    """
    cleaned = F.transform("cells", lambda c: F.regexp_replace(c, "[\n ]", ""))
    hit = lambda k: F.filter(F.transform(cleaned, lambda c, i: F.when(F.startswith(c, F.lit(k)), i)), lambda i: i.isNotNull())
    found = rows.where(F.col("row") <= most).select(*keys, "row", *(hit(k).alias(f"at{j}_") for j, k in enumerate(header)))
    found = found.where(" and ".join(f"size(at{j}_) = 1" for j in range(len(header))))
    first = found.groupBy(*keys).agg(F.min(F.struct("row", *(F.col(f"at{j}_")[0].alias(f"at{j}_") for j in range(len(header))))).alias("head_"))
    below = rows.join(first, keys).where(F.col("row") > F.col("head_.row"))
    return _planes(below, keys, [F.get("cells", F.col(f"head_.at{j}_")) for j in range(3)])


def without_header(rows: DataFrame, keys: list[str], planes: DataFrame) -> DataFrame:
    """Sheets that hold no plane that counts, with the number of their rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).join(planes.where("reason is null"), keys, "left_anti")


def plain_planes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Planes in the first three cells of every row, for sheets without a header."""
    return _planes(rows, keys, [F.get("cells", F.lit(k)) for k in range(3)])


def interval_of(name: Column) -> tuple[Column, Column]:
    """Start and end in metres from a name such as segment_5m_to_10.5m.png; null where it has none."""
    part = lambda k: F.regexp_extract(name, r"segment_([0-9.]+)m_to_([0-9.]+)m", k).try_cast("double")
    return part(1), part(2)


def interval_name(start: Column, end: Column) -> Column:
    """segment_{start}m_to_{end}m.png with twelve significant digits, zeros cut; an exponent below 0.0001 and from 10^12 on; exact halves go up."""

    def short(c: Column) -> Column:
        digits = F.format_string("%.11e", c.cast("double"))
        power = F.regexp_extract(digits, r"e([+-]\d+)$", 1).cast("int")
        plain = F.regexp_replace(F.regexp_replace(digits.try_cast("decimal(38, 16)").cast("string"), r"0+$", ""), r"\.$", "")
        return F.when((power < -4) | (power >= 12), F.regexp_replace(digits, r"\.?0*e", "e")).otherwise(plain)

    return F.concat(F.lit("segment_"), short(start), F.lit("m_to_"), short(end), F.lit("m.png"))


def tables_by_interval(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """(start_m, end_m, name, row, values) of workbooks' rows (path, sheet, row, cells), in order of the interval in each file's name.

    The first row of a sheet names its columns; values maps these names to the cells below, as text. Files without an
    interval in their name come last. sheet: the sheet that counts, all by default.
    """
    own = rows if sheet is None else rows.where(F.col("sheet") == sheet)
    name = F.element_at(F.split("path", "/"), -1)
    start, end = interval_of(F.regexp_replace(name, r"%20", " "))
    heads = own.where("row = 1").select("path", "sheet", F.col("cells").alias("head"))
    width = F.size("head")
    padded = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.get("cells", k))
    named = own.where("row > 1").join(heads, ["path", "sheet"]).where(width > 0)
    out = named.select(start.alias("start_m"), end.alias("end_m"), name.alias("name"), (F.col("row") - 1).alias("row"), F.map_from_arrays("head", padded).alias("values"))
    return out.orderBy(F.col("start_m").asc_nulls_last(), "end_m", "name", "row")


#: The columns of a table of all segments' fractures, by the keys of LABELS.
SUMMARY = {
    "number": "fracture_id",
    "type_name": "fracture_type_label",
    "fractype": "fracture_type",
    "depth_m": "depth_m",
    "aperture_mm": "aperture_mm",
    "trace_mm": "trace_length_mm",
    "flaw_mm2": "aperture_trace_product_mm2",
    "dip_direction_deg": "dip_direction_deg",
    "dip_angle_deg": "dip_angle_deg",
    "normal_x": "normal_x",
    "normal_y": "normal_y",
    "normal_z": "normal_z",
    "n_px": "skeleton_pixel_count",
}


def all_segments(rows: DataFrame) -> DataFrame:
    """Fractures of all parameter tables among workbooks' rows (path, sheet, row, cells), with workbook and interval, in order of the interval.

    A workbook whose name has no interval, or whose sheet lacks a column, stops the job; one without fractures adds none.
    """
    heads = rows.where((F.col("sheet") == SHEET) & (F.col("row") == 1))
    start, _ = interval_of(F.element_at(F.split("path", "/"), -1))
    lacking = F.array_except(F.array(*(F.lit(v) for v in LABELS.values())), "cells")
    wrong = heads.select("path", F.when(start.isNull(), F.lit("no interval in its name")).when(F.size(lacking) > 0, F.concat(F.lit("no columns "), F.array_join(lacking, ", "))).alias("problem")).where("problem is not null").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['path']}: {wrong[0]['problem']}")
    kind = {"number": "long", "n_px": "long", "type_name": "string", "fractype": "string"}
    values = [F.try_element_at("values", F.lit(LABELS[k])).cast(kind.get(k, "double")).alias(v) for k, v in SUMMARY.items()]
    return tables_by_interval(rows, SHEET).select(F.col("name").alias("source_workbook"), F.col("start_m").alias("segment_start_m"), F.col("end_m").alias("segment_end_m"), *values)


def parameter_table(fractures: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the labelled columns of fractures, numbered from 1 by order within keys.

    Types that are not known have the name of the unknown; columns of OPTIONAL follow where they are there.
    """
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    numbered = fractures.withColumns({"number": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "type_name": F.coalesce(F.try_element_at(names, F.col("fractype")), F.lit(TYPE_NAMES["unknown"]))})
    labels = LABELS | {k: v for k, v in OPTIONAL.items() if k in fractures.columns}
    return numbered.select(*keys, *(F.col(k).alias(v) for k, v in labels.items()))


def segment_parameters(images: DataFrame, height: Column, width: Column, length_m: float, diameter_mm: float = 76.0, start_depth_m: float = 0.0) -> DataFrame:
    """images with start, end, perimeter, and millimetres for each pixel down and across."""
    for name, v in {"length_m": length_m, "diameter_mm": diameter_mm}.items():
        if not math.isfinite(v) or v <= 0:
            raise ValueError(f"{name} must be positive")
    perimeter = math.pi * diameter_mm
    return images.withColumns({"start_m": F.lit(start_depth_m), "end_m": F.lit(start_depth_m + length_m), "perimeter_mm": F.lit(perimeter), "ratio_v": F.lit(length_m * 1000) / height, "ratio_h": F.lit(perimeter) / width})


def coverage(segments: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 1e-8) -> DataFrame:
    """For each hole (keys): its segments, first start, last end, and how many do not begin where the one before ends."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end))
    return segments.withColumn("gap_", F.abs(F.col(start) - before) > tolerance).groupBy(*keys).agg(F.count("*").alias("n_segments"), F.min(start).alias("first_m"), F.max(F.struct(start, end))[end].alias("last_m"), F.count_if("gap_").alias("n_breaks"))


def outcome_counts(results: DataFrame, error: str = "error") -> DataFrame:
    """One row: how many files a stage has finished, and how many it has given up."""
    return results.agg(F.count_if(F.col(error).isNull()).alias("succeeded"), F.count(error).alias("failed"))


def unlike_images(masks: DataFrame, bases: DataFrame, key: str) -> DataFrame:
    """(key, violation) of masks (key, height, width, channels) that have not three channels, no base image, or one of another size."""
    both = masks.alias("m").join(bases.alias("b"), key, "left")
    violation = F.when(F.coalesce(F.col("m.channels") != 3, F.lit(True)), "not three channels").when(F.col("b.height").isNull(), "no base image").when((F.col("m.height") != F.col("b.height")) | (F.col("m.width") != F.col("b.width")), "sizes differ")
    return both.select(key, violation.alias("violation")).where("violation is not null")
