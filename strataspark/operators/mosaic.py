"""Frames of a hole's wall put together, cut into segments, scaled, and painted with planes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audits import content_rows
from .tables import running_offset


#: Bytes of frames that are cut into rows at a time.
PORTION = 8 << 20


def frame_rows(frames: DataFrame) -> DataFrame:
    """(frame_idx, y, data, row_mean): rows of frames (frame_idx, height, width, data), the lowest first; data: one or three bytes a pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, n = [], 0
            for i, h, data in batch[["frame_idx", "height", "data"]].itertuples(index=False):
                rows = np.frombuffer(data, np.uint8).reshape(h, -1)[::-1]
                out += zip([i] * h, range(h), map(bytes, rows), rows.mean(axis=1).tolist(), strict=True)
                n += len(data)
                if n >= PORTION:
                    yield pd.DataFrame(out, columns=names)
                    out, n = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["frame_idx", "y", "data", "row_mean"]
    return frames.where("height > 0").select("frame_idx", "height", "data").mapInPandas(run, "frame_idx long, y int, data binary, row_mean double")


def mosaic(rows: DataFrame, white: float = 250.0) -> DataFrame:
    """(mosaic_row, frame_idx, y, data) of all frames in order; the last frame goes without its white rows."""
    last = rows.agg(F.max("frame_idx").alias("last_"))  # one row
    marked = rows.join(F.broadcast(last))
    kept = content_rows(marked, F.when(F.col("frame_idx") == F.col("last_"), F.col("row_mean")).otherwise(0.0), white)
    offsets = running_offset(kept.groupBy("frame_idx").agg(F.count("*").alias("n_")), "frame_idx", "n_")
    inner = F.row_number().over(Window.partitionBy("frame_idx").orderBy("y")) - 1
    return kept.withColumn("inner_", inner).join(offsets.select("frame_idx", "row_offset"), "frame_idx").select((F.col("row_offset") + F.col("inner_")).alias("mosaic_row"), "frame_idx", "y", "data")


def segment_of(row: Column, rows: Column, length_m: float, height_m: float) -> Column:
    """Index of the depth segment that holds a row of a mosaic of so many rows."""
    q = length_m / height_m
    n = round(q) if math.isclose(q, round(q), rel_tol=1e-12) else math.ceil(q)
    starts = F.array(*((F.lit(i * height_m / length_m) * rows).cast("long") for i in range(n)))
    return F.size(F.filter(starts, lambda s: s <= row)) - 1


def _cubic(to: int, width: int) -> np.ndarray:
    """Shares of `width` places in `to` places: cubic, and over all that a place covers where it shrinks."""
    scale = width / to
    wide = max(scale, 1.0)
    t = np.abs((np.arange(width) + 0.5)[None, :] - ((np.arange(to) + 0.5) * scale)[:, None]) / wide
    w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0))
    return w / w.sum(1, keepdims=True)


def _linear(to: int, width: int) -> np.ndarray:
    at = np.clip((np.arange(to) + 0.5) * width / to - 0.5, 0, width - 1)
    low = np.minimum(at.astype(int), max(0, width - 2))
    out = np.zeros((to, width))
    out[np.arange(to), low] = 1 - (at - low)
    out[np.arange(to), np.minimum(low + 1, width - 1)] += at - low
    return out


def letterboxed(image: np.ndarray, to: int) -> tuple[np.ndarray, int, int]:
    """image (height, width, channels) scaled to fit a grey square of side `to`, centred; the new width and height."""
    h, w = image.shape[:2]
    scale = min(to / w, to / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    byte = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    across = byte(np.einsum("xw,hwc->hxc", _cubic(nw, w), image.astype(float)))
    down = byte(np.einsum("yh,hxc->yxc", _cubic(nh, h), across))
    out = np.full((to, to, image.shape[2]), 128, np.uint8)
    top, left = (to - nh) // 2, (to - nw) // 2
    out[top : top + nh, left : left + nw] = down
    return out, nw, nh


def classes_from_square(shares: np.ndarray, width: int, height: int, nw: int, nh: int) -> np.ndarray:
    """The likeliest class of each pixel: the image's part of a square (side, side, classes), scaled to its size, then the largest share."""
    to = shares.shape[0]
    top, left = (to - nh) // 2, (to - nw) // 2
    part = shares[top : top + nh, left : left + nw]
    return np.einsum("yh,xw,hwc->yxc", _linear(height, nh), _linear(width, nw), part, optimize=True).argmax(axis=2).astype(np.uint8)


def classified(images: DataFrame, predict, to: int = 512) -> DataFrame:
    """(path, height, width, classes) of images (path, height, width, data: three bytes a pixel).

    predict turns a square (to, to, 3) into shares (to, to, classes); it is the caller's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, h, w, data in batch.itertuples(index=False):
                square, nw, nh = letterboxed(np.frombuffer(data, np.uint8).reshape(h, w, 3), to)
                yield pd.DataFrame({"path": [path], "height": h, "width": w, "classes": [classes_from_square(predict(square), w, h, nw, nh).tobytes()]})

    return images.select("path", "height", "width", "data").mapInPandas(run, "path string, height int, width int, classes binary")


#: Side of a stamp, and the border that it starts in.
STAMP, BORDER = 30, 3


def painted(points: DataFrame, keys: list[str], order: str, colour: str, height: int, width: int) -> DataFrame:
    """(keys, y, x, colour) of images painted with a square stamp at each point (row, column); of two planes the later by order wins.

    Points outside the image's rows don't count; a stamp begins BORDER before its point, and what leaves the image is cut.
    """
    inside = points.where(F.col("row").between(0, height - 1) & F.col("column").between(0, width - 1))
    ahead = STAMP - BORDER - 1
    reach = lambda c, size: F.explode(F.sequence(F.greatest(F.col(c) - BORDER, F.lit(0)), F.least(F.col(c) + ahead, F.lit(size - 1))))
    # the last plane wins a place whatever way it is covered, so it is asked for points, then along rows, then along columns
    last = lambda df, *at: df.groupBy(*keys, *at).agg(F.max("top_").alias("top_"))
    centres = last(inside.select(*keys, "row", "column", F.struct(order, colour).alias("top_")), "row", "column")
    across = last(centres.select(*keys, "row", reach("column", width).alias("x"), "top_"), "row", "x")
    top = last(across.select(*keys, reach("row", height).alias("y"), "x", "top_"), "y", "x")
    return top.select(*keys, "y", "x", F.col(f"top_.{colour}").alias(colour))
