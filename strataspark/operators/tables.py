"""Relational operators over fracture tables and other tables with named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.shared import held


def type_summary(df: DataFrame, by: str, counted: str, means: dict[str, str]) -> DataFrame:
    """Rows (with a value in `counted`) and means by class; null is a class of its own."""
    return df.groupBy(by).agg(F.count(counted).alias("fracture_count"), *(F.avg(c).alias(n) for n, c in means.items()))


def validated_triples(df: DataFrame, depth: Column, azimuth: Column, dip: Column) -> DataFrame:
    """df with azimuth (folded into [0, 360)), dip, and the reason for which a row is rejected, or null.

    A missing azimuth is 0 on a plane that does not dip.
    """
    az = F.when((azimuth.isNull() | F.isnan(azimuth)) & (F.abs(dip) <= 1e-10), 0.0).otherwise(azimuth)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    reason = F.when(bad(depth) | bad(az) | bad(dip), "not finite").when(~az.between(0, 360), "azimuth").when(~dip.between(0, 90), "dip")
    return df.select("*", F.when(reason.isNull(), F.pmod(az, F.lit(360.0))).alias("azimuth"), dip.alias("dip"), reason.alias("reason"))


def depth_segments(df: DataFrame, rows: Column, length_m: float, diameter_mm: float, height_m: float, start_m: float = 0.0) -> DataFrame:
    """A row for each depth interval of a mosaic of `rows` rows (df has one row for each mosaic).

    The number of intervals is the quotient where that is whole within 1e-12, else rounded up; pixel
    bounds are cut towards zero, the last is the mosaic's end.
    """
    import math

    q = length_m / height_m
    count = round(q) if math.isclose(q, round(q), rel_tol=1e-12) else math.ceil(q)
    return (
        df.withColumn("mosaic_rows", rows.cast("long"))
        .withColumn("segment_idx", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .withColumn("from_m", F.col("segment_idx") * F.lit(height_m))
        .withColumn("to_m", F.when(F.col("segment_idx") == count - 1, F.lit(length_m)).otherwise((F.col("segment_idx") + 1) * F.lit(height_m)))
        .withColumn("pixel_start", (F.col("from_m") / length_m * F.col("mosaic_rows")).cast("long"))
        .withColumn("pixel_end", F.when(F.col("segment_idx") == count - 1, F.col("mosaic_rows")).otherwise((F.col("to_m") / length_m * F.col("mosaic_rows")).cast("long")))
        .withColumn("start_depth_m", F.lit(start_m) + F.col("from_m"))
        .withColumn("end_depth_m", F.lit(start_m) + F.col("to_m"))
        .withColumn("width_px", (F.col("mosaic_rows") / (length_m * 1000) * math.pi * diameter_mm).cast("long"))
        .drop("from_m", "to_m")
    )


def in_interval(depth: Column, start: float, end: float, height: float) -> Column:
    """Index of the interval [start + i h, start + (i + 1) h) that holds a depth; the last is closed; null outside."""
    import math

    n = math.ceil((end - start) / height - 1e-12)
    i = F.floor((depth - start) / height).cast("int")
    return F.when((depth >= start) & (depth <= end), F.least(i, F.lit(n - 1)))


def with_contiguity(df: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, tolerance: float = 1e-8) -> DataFrame:
    """df with the end of the row before (by order, within keys) and whether it meets the row's start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous_end", F.lag(end).over(w)).withColumn("contiguous", F.abs(start - F.col("previous_end")) <= tolerance)


def union_with_source(parts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """All rows with their source's name and a 1-based number within it; order should tell a source's rows apart."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    # ranges of rows are numbered each in a task, after the number of rows in the ranges before
    ranged = held(out.repartitionByRange("source", *order).withColumn("range_", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("source", "range_").agg(F.count("*").alias("n_"))
    before = sizes.select("source", "range_", F.coalesce(F.sum("n_").over(Window.partitionBy("source").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inner = F.row_number().over(Window.partitionBy("source", "range_").orderBy(*order))
    numbered = ranged.withColumn("inner_", inner).join(before, ["source", "range_"])
    return numbered.select(*out.columns, (F.col("inner_") + F.col("before_")).cast("long").alias("ordinal"))


def tiles(df: DataFrame, height: Column, tile: int) -> DataFrame:
    """A row for each tile [tile_start, tile_end) of `tile` rows; the last may be shorter."""
    return df.where(height > 0).withColumn("tile_start", F.explode(F.sequence(F.lit(0).cast("long"), height.cast("long") - 1, F.lit(tile).cast("long")))).withColumn("tile_end", F.least(F.col("tile_start") + tile, height))


def running_offset(df: DataFrame, key: str, size: str, block: int = 4096) -> DataFrame:
    """df with the sum of `size` over all rows with a smaller integer key.

    In two levels, so that no task sorts all rows: blocks of keys are summed first, the sums of blocks are
    added up (one row for each block), and each block numbers its own rows.
    """
    blocked = df.withColumn("block_", F.floor(F.col(key) / block))
    sums = blocked.groupBy("block_").agg(F.sum(size).alias("s_"))
    before = sums.select("block_", F.coalesce(F.sum("s_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy("block_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocked.withColumn("inner_", inner).join(before, "block_").withColumn("row_offset", F.col("inner_") + F.col("before_")).drop("block_", "inner_", "before_")


def last_of_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that no other follows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("next_", F.lead(F.lit(1)).over(w)).where("next_ is null").drop("next_")


def header_row(lines: DataFrame, keys: list[str], group: str, number: str, text: str, most: int = 20) -> DataFrame:
    """For each group the first of its first `most` rows in which every key starts exactly one cell (spaces part cells)."""
    cells = F.transform(F.split(F.col(text), " "), lambda c: F.regexp_replace(c, r"[\n ]", ""))
    hits = lambda k: F.size(F.filter(cells, lambda c: F.startswith(F.lower(c), F.lit(k))))
    hit = F.lit(True)
    for k in keys:
        hit = hit & (hits(k) == 1)
    return lines.where((F.col(number) < most) & hit).groupBy(group).agg(F.min(number).alias("header_row"))


def manifest(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """SHA-256 and size of each content."""
    data = content.cast("binary")
    return df.select(path.alias("path"), F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("bytes"))


def manifest_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected paths that are missing or whose digest differs."""
    both = expected.alias("e").join(found.alias("f"), F.col("e.path") == F.col("f.path"), "left")
    status = F.when(F.col("f.path").isNull(), "missing").when(F.col("e.sha256") != F.col("f.sha256"), "mismatch")
    return both.select(F.col("e.path").alias("path"), status.alias("status")).where("status is not null")


def without_excluded(df: DataFrame, path: Column, excluded: list[str]) -> DataFrame:
    """Rows whose path has none of the excluded names among its parts."""
    return df.where(~F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in excluded))))


def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule: how many rows break it, and whether none does."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("x")).select("x.rule", "x.violations", (F.col("x.violations") == 0).alias("passed"))
