"""PNG images of 8-bit RGB or grey, read and written in tasks; nothing but zlib is needed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.groups import by_groups

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SUFFIXES = ("png",)


def encode(pixels: np.ndarray) -> bytes:
    """An image of uint8, height x width (grey) or height x width x 3 (red, green, blue)."""
    h, w = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels, dtype=np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


#: Passes of an interlaced image: first row and column, and the steps of both.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def decode(data: bytes) -> np.ndarray:
    """The image as bytes, height x width (grey) or height x width x 3; ValueError where it can't be decoded.

    All colour types and depths, plain or interlaced. Of 16 bits the upper eight count, fewer bits are spread over 0 to 255,
    palettes are looked up, transparency is left out.
    """
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        at += n + 12
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlaced = head
    if depth not in _DEPTHS.get(colour, ()) or interlaced > 1 or (colour == 3 and palette is None) or not w or not h:
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    channels = _CHANNELS[colour]
    image = np.zeros((h, w, channels), np.uint8)
    at = 0
    for y, x, dy, dx in _PASSES if interlaced else ((0, 0, 1, 1),):
        rows, cols = -(-(h - y) // dy), -(-(w - x) // dx)
        if rows > 0 and cols > 0:
            width = -(-cols * channels * depth // 8)
            if len(raw) < at + rows * (width + 1):
                raise ValueError("too few bytes")
            part = raw[at : at + rows * (width + 1)].reshape(rows, width + 1)
            at += rows * (width + 1)
            image[y::dy, x::dx] = samples(unfiltered(part[:, 0], part[:, 1:], max(1, channels * depth // 8)), cols, channels, depth, colour != 3)
    if colour == 3:
        if int(image.max()) >= len(palette):
            raise ValueError("a colour is not in the palette")
        return palette[image[:, :, 0]]
    return image[:, :, 0] if channels < 3 else image[:, :, :3]


def samples(rows: np.ndarray, width: int, channels: int, depth: int, spread: bool = True) -> np.ndarray:
    """Packed rows of bytes as (rows, width, channels) bytes; spread: fewer bits than eight reach up to 255."""
    n = width * channels
    if depth == 16:
        rows = rows[:, : 2 * n : 2]
    elif depth < 8:
        shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
        rows = (rows[:, :, None] >> shifts & np.uint8((1 << depth) - 1)).reshape(len(rows), -1) * np.uint8(255 // ((1 << depth) - 1) if spread else 1)
    return rows[:, :n].reshape(len(rows), width, channels)


#: Rows that are unfiltered together.
_TOGETHER = 256


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of filtered rows; step: bytes of a pixel.

    A byte needs those to the left, above, and left above, so bands of rows are sheared until these lie in the columns before,
    and a column of a band is done at once.
    """
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    height, width = rows.shape
    n = -(-width // step)
    padded = np.zeros((height, n * step), np.uint8)
    padded[:, :width] = rows
    out, above = np.empty((height, n, step), np.uint8), np.zeros((n, step), np.int16)
    for top in range(0, height, _TOGETHER):
        kind, part = kinds[top : top + _TOGETHER], padded[top : top + _TOGETHER].reshape(-1, n, step)
        if (kind == 0).all():
            out[top : top + len(part)] = part
        elif (kind == 2).all():
            out[top : top + len(part)] = (np.cumsum(part, axis=0, dtype=np.int64) + above).astype(np.uint8)
        elif (kind <= 1).all():
            out[top : top + len(part)] = np.where(kind[:, None, None] == 1, np.cumsum(part, axis=1, dtype=np.int64).astype(np.uint8), part)
        else:
            out[top : top + len(part)] = _sheared(kind, part, above)
        above = out[top + len(part) - 1].astype(np.int16)
    return out.reshape(height, -1)[:, :width]


def _sheared(kind: np.ndarray, part: np.ndarray, above: np.ndarray) -> np.ndarray:
    rows, n, step = part.shape
    # line 0 is the row above; pixel x of line k stands in column x + k + 2
    raw = np.zeros((n + rows, rows, step), np.int16)
    done = np.zeros((n + rows + 2, rows + 1, step), np.int16)
    at = np.arange(rows)
    for k in range(rows):
        raw[k : k + n, k] = part[k]
    done[1 : n + 1, 0] = above
    k = kind[:, None]
    for d in range(n + rows - 1):
        left, up, corner = done[d + 1, 1:], done[d + 1, :-1], done[d, :-1]
        p = left + up - corner
        da, db, dc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) >> 1, paeth], 0)
        inside = ((d - at >= 0) & (d - at < n))[:, None]
        done[d + 2, 1:] = np.where(inside, (raw[d] + guess) & 255, 0)
    return np.stack([done[k + 2 : k + 2 + n, k + 1] for k in range(rows)]).astype(np.uint8)


def scan(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, content) of the images of a folder, ordered by path when collected by it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def pixels(images: DataFrame, band_rows: int = 256) -> DataFrame:
    """(path, height, width, band, y0, data, error): bands of rows, so that a long image stays in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    image = decode(content)
                except (ValueError, zlib.error, struct.error) as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, str(e))], columns=names)
                    continue
                for k, y in enumerate(range(0, len(image), band_rows)):
                    yield pd.DataFrame([(path, image.shape[0], image.shape[1], k, y, image[y : y + band_rows].tobytes(), None)], columns=names)

    names = ["path", "height", "width", "band", "y0", "data", "error"]
    return images.mapInPandas(run, "path string, height int, width int, band int, y0 int, data binary, error string")


def render(raster: DataFrame, height: int | Column, width: int, key: str = "segment_id") -> DataFrame:
    """(key, png) from sparse pixels (key, y, x, r, g, b); background is black, the largest colour wins a place.

    height: of all images, or a column of the pixels.
    """
    parts = [F.col(c).cast("long") for c in "rgb"]
    colour = parts[0] * (1 << 32) + parts[1] * (1 << 16) + parts[2]
    # columns can't travel to tasks
    same = height if isinstance(height, int) else None
    rows = raster.select(key, "y", "x", colour.alias("colour_"), *([] if same is not None else [height.alias("height_")]))

    def run(table: pa.Table, starts: np.ndarray) -> dict:
        y, x, c = (table[n].to_numpy() for n in ("y", "x", "colour_"))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(y)), strict=True):
            # pixels come by place and colour, so the last of a place is the largest
            y_, x_, c_ = y[a:b], x[a:b], c[a:b]
            last = np.append((y_[1:] != y_[:-1]) | (x_[1:] != x_[:-1]), True)
            image = np.zeros((table["height_"][int(a)].as_py() if same is None else same, width, 3), np.uint8)
            image[y_[last], x_[last]] = (c_[last, None] >> np.array([32, 16, 0]) & 255).astype(np.uint8)
            out.append(encode(image))
        return {key: table[key].combine_chunks().take(pa.array(starts)), "png": out}

    return by_groups(rows, [key], run, f"`{key}` {dict(raster.dtypes)[key]}, png binary", ["y", "x", "colour_"])


def foreground(images: DataFrame, key: str = "segment_id") -> DataFrame:
    """(key, y, x, r, g, b) of all pixels that are not black, from (key, png)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch[key], batch["png"], strict=True):
                image = decode(data)
                y, x = np.nonzero(image.any(axis=2))
                yield pd.DataFrame({key: k, "y": y.astype(np.int32), "x": x.astype(np.int32), **{c: image[y, x, i].astype(np.int32) for i, c in enumerate("rgb")}})

    return images.select(key, "png").mapInPandas(run, f"{key} {dict(images.dtypes)[key]}, y int, x int, r int, g int, b int")


def resized_rows(frames: DataFrame, to_width: int, channels: int = 1) -> DataFrame:
    """Frames (frame_idx, height, width, data: a byte for each channel of a pixel) narrowed to a width by area; rows keep their number.

    Each target column is the mean of the source columns that it covers, by the share covered.
    """

    def weights(width: int) -> np.ndarray:
        edges = np.arange(to_width + 1) * width / to_width
        left, right = edges[:-1, None], edges[1:, None]
        at = np.arange(width)[None, :]
        cover = np.clip(np.minimum(right, at + 1) - np.maximum(left, at), 0, None)
        return (cover / cover.sum(1, keepdims=True)).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for i, h, w, data in batch[["frame_idx", "height", "width", "data"]].itertuples(index=False):
                if w not in known:
                    known[w] = weights(w)
                image = np.moveaxis(np.frombuffer(data, np.uint8).reshape(h, w, channels), 2, 1)
                out.append((i, h, to_width, np.moveaxis(np.rint(image @ known[w]).astype(np.uint8), 1, 2).tobytes()))
            yield pd.DataFrame(out, columns=["frame_idx", "height", "width", "data"])

    return frames.select("frame_idx", "height", "width", "data").mapInPandas(run, "frame_idx long, height int, width int, data binary")


def predicted(tiles: DataFrame, predict, key: str) -> DataFrame:
    """(key, data) of tiles turned into class maps by predict(list of arrays) -> list of arrays, batch by batch.

    The predictor is pluggable; one without weights is `by_brightness`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [np.frombuffer(d, np.uint8).reshape(h, w) for d, h, w in zip(batch["data"], batch["height"], batch["width"], strict=True)]
            yield pd.DataFrame({key: batch[key], "classes": [c.astype(np.uint8).tobytes() for c in predict(images)]})

    return tiles.select(key, "height", "width", "data").mapInPandas(run, f"{key} {dict(tiles.dtypes)[key]}, classes binary")


def by_brightness(images: list[np.ndarray]) -> list[np.ndarray]:
    """Four classes by quarter of the brightness: a stand-in where no trained network is at hand."""
    return [i // 64 for i in images]
