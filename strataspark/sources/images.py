"""Images of several formats as rows, and stages that turn a folder of images into another one."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.shared import held

from . import png
from .folder import write_files

#: The endings of image files.
SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits as height x width x 3, red first."""
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size < 40:
        raise ValueError("unsupported BMP header")
    w, h, _, depth, packed, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    if packed or depth not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h:
        raise ValueError("unsupported BMP")
    stride = -(-w * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if depth <= 8:
        palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << depth), 14 + size).reshape(-1, 4)[:, 2::-1]
        index = png.samples(rows, w, 1, depth, False)[:, :, 0]
        if int(index.max()) >= len(palette):
            raise ValueError("a colour is not in the palette")
        return palette[index]
    if depth == 16:
        v = np.ascontiguousarray(rows[:, : 2 * w]).view("<u2")
        five = np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=2)
        return (five << 3 | five >> 2).astype(np.uint8)
    return rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1]


_SIZES = {1: "B", 3: "H", 4: "I"}


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of an uncompressed TIFF in strips: grey, RGB or palette, of 8 or 16 bits (or of one bit), as bytes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in _SIZES:
            form = f"{order}{n}{_SIZES[kind]}"
            place = at + 10 + 12 * k if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(form, data, place)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, channels, meaning, flat = one(256), one(257), one(277, 1), one(262), one(284, 1)
    depths = tags.get(258, (1,))
    depth = depths[0]
    if one(259, 1) != 1 or 273 not in tags or meaning not in (0, 1, 2, 3) or len(set(depths)) != 1 or depth not in (1, 8, 16) or flat not in (1, 2) or not w or not h:
        raise ValueError("unsupported TIFF")
    if (meaning == 2) != (channels >= 3) or (depth == 1 and (meaning > 1 or channels > 1)) or (meaning == 3 and depth != 8):
        raise ValueError("unsupported TIFF")
    sizes = tags.get(279) or (len(data) - tags[273][0],)
    body = b"".join(data[o : o + n] for o, n in zip(tags[273], sizes, strict=True))
    planes, inner = (channels, 1) if flat == 2 else (1, channels)
    stride = -(-w * inner * depth // 8)
    rows = np.frombuffer(body, np.uint8, planes * h * stride).reshape(planes * h, stride)
    if depth == 16 and order == "<":
        rows = rows.reshape(len(rows), -1, 2)[:, :, ::-1].reshape(len(rows), -1)
    image = png.samples(rows, w, inner, depth)
    if flat == 2:
        image = np.moveaxis(image.reshape(planes, h, w), 0, 2)
    if meaning == 3:
        palette = (np.array(tags[320], np.uint32).reshape(3, -1).T >> 8).astype(np.uint8)
        return palette[image[:, :, 0]]
    if channels < 3:
        return 255 - image[:, :, 0] if meaning == 0 else image[:, :, 0]
    return image[:, :, :3]


def decode(data: bytes | None) -> np.ndarray:
    """PNG, BMP or TIFF, told apart by content; ValueError for others and for what can't be decoded."""
    data = data or b""
    try:
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:2] in (b"II", b"MM"):
            return decode_tiff(data)
        return png.decode(data)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"broken image: {e}") from e


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, content) of the images right in a folder, in order of the path; endings in either case."""
    files = spark.read.format("binaryFile").load(folder)
    ends = "|".join(suffixes)
    return files.where(F.lower("path").rlike(rf"\.({ends})$")).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content").orderBy("path")


def images(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height, width, channels, data, error) of files (keys, content): a row each, with what is wrong where it can't be decoded."""
    types = dict(files.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(i).slice(k, 1) for i in range(len(keys))]
                try:
                    image = decode(batch.column(len(keys))[k].as_py())
                    made = [[image.shape[0]], [image.shape[1]], [1 if image.ndim == 2 else 3], [image.tobytes()], [None]]
                except ValueError as e:
                    made = [[None], [None], [None], [None], [str(e)]]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*row, *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))], [*keys, "height", "width", "channels", "data", "error"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "height int, width int, channels int, data binary, error string"])
    return files.select(*keys, "content").mapInArrow(run, schema)


def run_stage(spark: SparkSession, source: str, destination: str, change: Callable[[np.ndarray], np.ndarray], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Changes each image of a folder and writes it as a PNG of the same stem into another one; returns (name, error) of each.

    An image that can't be read or changed is an error of its own and doesn't end the stage. Source and destination must
    differ. Two images of one stem would overwrite each other, so that is an error of the stage.
    """
    if source.rstrip("/").removeprefix("file://") == destination.rstrip("/").removeprefix("file://"):
        raise ValueError("source and destination are the same folder")

    @F.arrow_udf("png binary, error string")
    def changed(contents: pa.Array) -> pa.Array:
        out = []
        for content in contents:
            try:
                out.append({"png": png.encode(change(decode(content.as_py()))), "error": None})
            except Exception as e:  # any failure belongs to its file
                out.append({"png": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("png", pa.binary()), ("error", pa.string())]))

    made = held(scan(spark, source, suffixes).select("name", changed("content").alias("r")).select("name", "r.*"), "stage")
    stem = F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".png"))
    write_files(made.where("error is null").select(stem.alias("path"), F.col("png").alias("content")), destination, into_used=True)
    return made.select("name", "error").orderBy("name")
