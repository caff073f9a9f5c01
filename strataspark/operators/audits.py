"""Checks of files and stage outputs, filters of rasters, and files in and out."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_parameters(positive: dict[str, float] | None = None, finite: dict[str, float] | None = None, at_least: dict[str, tuple[float, float]] | None = None) -> None:
    """ValueError for the first number that is not positive and finite, not finite, or below its least value."""
    for name, v in {**(positive or {}), **(finite or {}), **{k: v for k, (v, _) in (at_least or {}).items()}}.items():
        if isinstance(v, bool) or not math.isfinite(v):
            raise ValueError(f"{name} must be a finite number")
    for name, v in (positive or {}).items():
        if v <= 0:
            raise ValueError(f"{name} must be positive")
    for name, (v, least) in (at_least or {}).items():
        if v < least:
            raise ValueError(f"{name} must be at least {least}")


def with_defaults(given: dict, defaults: dict) -> dict:
    """Settings over their defaults; ValueError for names that have none."""
    if unknown := sorted(given.keys() - defaults.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def required_columns(df: DataFrame, required: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """The required columns alone, under their new names; ValueError with those that are missing."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{c}`").alias((renamed or {}).get(c, c)) for c in required))


def all_within(df: DataFrame, value: Column, low: float, high: float) -> DataFrame:
    """One row: rows, rows outside [low, high] (nulls are outside), and whether none is."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(value.between(low, high), F.lit(False))).alias("n_outside")).withColumn("passed", F.col("n_outside") == 0)


def without_empty_rows(df: DataFrame, values: list[str]) -> DataFrame:
    """Rows with a value in any of the columns; a row number taken before stays as it is."""
    return df.na.drop("all", subset=values)


def missing_outputs(expected: DataFrame, stages: list[str], found: DataFrame, key: str, stage: str = "stage") -> DataFrame:
    """(key, stage) of each expected interval for which a stage has left nothing."""
    wanted = expected.select(key, F.explode(F.array(*(F.lit(s) for s in stages))).alias(stage))
    return wanted.join(found.select(key, stage), [key, stage], "left_anti")


def foreground_by_stage(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Foreground pixels of each image."""
    return pixels.groupBy(*keys).agg(F.count("*").alias("foreground"))


def class_counts(pixels: DataFrame, keys: list[str], name: str = "class") -> DataFrame:
    """Pixels of each class of each image."""
    return pixels.groupBy(*keys, name).agg(F.count("*").alias("n_px"))


def stage_violations(images: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What is wrong with an interval's images (key, stage, height, width, foreground): more than one shape, or more foreground than the stage before."""
    one = images.groupBy(key).agg(
        F.countDistinct("height", "width").alias("shapes"),
        *(F.max(F.when(F.col("stage") == s, F.col("foreground"))).alias(f"n{k}_") for k, s in enumerate(order)),
    )
    shape = F.when(F.col("shapes") > 1, F.lit("shapes differ"))
    grown = [F.when(F.col(f"n{k}_") > F.col(f"n{k - 1}_"), F.lit(f"{order[k]} has more foreground than {order[k - 1]}")) for k in range(1, len(order))]
    return one.select(key, F.explode(F.filter(F.array(shape, *grown), lambda x: x.isNotNull())).alias("violation"))


def content_rows(rows: DataFrame, mean: Column, most: float = 250.0) -> DataFrame:
    """Rows of an image that are not white padding: their mean is at most `most`."""
    return rows.where(mean <= most)


def size_limits(files: DataFrame, size: Column, one: int = 100 << 20, total: int = 1 << 30) -> DataFrame:
    """One row: number and bytes of files, files that reach `one` bytes, and whether all together pass `total`."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(size >= one).alias("too_large")).withColumn("total_too_large", F.col("bytes") > total)


def required_files(found: DataFrame, path: str, required: DataFrame) -> DataFrame:
    """Required paths that are not there."""
    return required.join(found.select(path), path, "left_anti").select(path)


def write_manifest(files: DataFrame, folder: str) -> None:
    """(sha256, path) as lines `sha256  path` in order of the path; refuses a folder that is there."""
    files.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value")).write.mode("errorifexists").text(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, path) of the lines of a manifest; blank lines don't count."""
    lines = spark.read.text(folder).where(F.trim("value") != "")
    parts = F.split("value", "  ", 2)
    return lines.select(parts[0].alias("sha256"), F.get(parts, F.lit(1)).alias("path"))


def write_csv(df: DataFrame, folder: str) -> None:
    """UTF-8 with a header and no index; refuses a folder that is there, so that runs do not mix."""
    df.write.mode("errorifexists").option("header", True).csv(folder)


def syntax_errors(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, message) of each file of Python that can't be parsed; a null text is an empty file."""
    types = dict(files.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, source in enumerate(batch.column(1).to_pylist()):
                try:
                    ast.parse(source or "")
                except (SyntaxError, ValueError) as e:
                    out.append((k, getattr(e, "lineno", None), getattr(e, "msg", None) or str(e)))
            at, lines, messages = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.int32()), pa.array(messages, pa.string())], [path, "line", "message"])

    return files.select(path, text).mapInArrow(run, f"`{path}` {types[path]}, line int, message string")


def exit_code(*violations: DataFrame) -> int:
    """0 where no check found anything, else 1."""
    return int(any(not v.isEmpty() for v in violations))
