"""Recognition: class maps of image segments by tiles, from a model that each worker process loads once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mosaic import classes_from_square, letterboxed

Predict = Callable[[list[np.ndarray]], list[np.ndarray]]

#: The model that this worker process holds, by the key of its recognition.
_LOADED: dict[str, Predict] = {}

#: Tiles that a model gets at once.
LOT = 8


def _model(key: str, load: Callable[[], Predict]) -> Predict:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = load()
    return _LOADED[key]


def nearest_resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, each pixel taken from the place that it covers first."""
    return image[(np.arange(height) * image.shape[0] // height)[:, None], np.arange(width) * image.shape[1] // width]


def by_squares(shares: Callable[[np.ndarray], np.ndarray], to: int = 512) -> Predict:
    """A model for images of any size from one that turns squares (n, to, to, 3) into shares (n, to, to, classes).

    Images are fitted into the square; of the shares, the image's part is scaled to its size, and the largest counts.
    """

    def predict(images: list[np.ndarray]) -> list[np.ndarray]:
        fitted = [letterboxed(i, to) for i in images]
        found = shares(np.stack([f[0] for f in fitted]))
        return [classes_from_square(s, i.shape[1], i.shape[0], nw, nh) for s, i, (_, nw, nh) in zip(found, images, fitted, strict=True)]

    return predict


def tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """(segment_id, top, height, data) from rows (segment_id, y, data): tiles of tile_rows rows, the last of a segment shorter."""
    if tile_rows < 1:
        raise ValueError("a tile needs a row")
    placed = rows.select("segment_id", (F.floor(F.col("y") / tile_rows) * tile_rows).cast("int").alias("top"), F.struct("y", "data").alias("row"))
    whole = placed.groupBy("segment_id", "top").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    joined = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["data"])), ""))
    return whole.select("segment_id", "top", F.size("rows").alias("height"), joined.alias("data"))


def recognised(rows: DataFrame, width: int, load: Callable[[], Predict], tile_rows: int = 1000, channels: int = 3) -> DataFrame:
    """(segment_id, y, x, class_id) of all pixels that are not class 0, from the rows (segment_id, y, data) of segments.

    load makes the model: a function from images (height, width, channels, or height, width for one channel) to class
    maps. Each worker process calls it once. Maps of another size are resized to their tile's by the nearest pixel.
    """
    key, types = uuid.uuid4().hex, dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                part = batch.slice(at, LOT)
                heights = part.column(2).to_pylist()
                shape = (width, channels) if channels > 1 else (width,)
                images = [np.frombuffer(d.as_buffer(), np.uint8).reshape(h, *shape) for d, h in zip(part.column(3), heights, strict=True)]
                for k, (found, h) in enumerate(zip(_model(key, load)(images), heights, strict=True)):
                    found = found if found.shape == (h, width) else nearest_resized(found, h, width)
                    y, x = np.nonzero(found)
                    own = part.column(0).take(pa.array(np.full(len(y), k)))
                    yield pa.RecordBatch.from_arrays([own, pa.array((y + part.column(1)[k].as_py()).astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(found[y, x].astype(np.int32))], ["segment_id", "y", "x", "class_id"])

    return tiles(rows, tile_rows).mapInArrow(run, f"segment_id {types['segment_id']}, y int, x int, class_id int")
