"""Sequences of points as bytes: the first point, and steps of a byte where points are whole numbers near to each other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .groups import codes, in_tables

#: Points of a path that travel in one row.
PIECE = 256


def coded(points: np.ndarray, n: np.ndarray) -> pa.Array:
    """The bytes of n points (rows of two numbers) each, one after another; all points where a step does not fit."""
    first, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    step = np.diff(points, axis=0, prepend=points[:1])
    step[first[n > 0]] = 0
    odd = (points != np.rint(points)) | (np.abs(points) > 1 << 50) | (np.abs(step) > 127)
    small = np.bincount(of[odd.any(axis=1)], minlength=len(n)) == 0
    size = np.where(small, 14 + 2 * n, 16 * n) * (n > 0)
    ends = np.cumsum(size)
    out = np.empty(int(size.sum()), np.uint8)
    wide = ~small[of]
    wide[first[n > 0]] = True
    k = np.arange(len(of)) - first[of]
    at = (ends - size)[of]
    out[(at + 16 * k)[wide][:, None] + np.arange(16)] = np.ascontiguousarray(points[wide], float).view(np.uint8)
    out[(at + 14 + 2 * k)[~wide][:, None] + np.arange(2)] = step[~wide].astype(np.int8).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(out)])


def points_of(found: pa.Array, n: np.ndarray) -> np.ndarray:
    """The points that were coded."""
    size = pc.binary_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = int(np.frombuffer(found.buffers()[1], np.int32)[found.offset]) if len(found) else 0
    code = np.frombuffer(found.buffers()[2] or b"", np.uint8)[begin : begin + int(size.sum())]
    of = np.repeat(np.arange(len(n)), n)
    at, first = (np.cumsum(size) - size)[of], np.cumsum(n) - n
    k = np.arange(len(of)) - first[of]
    wide = (size == 16 * n)[of] | (k == 0)
    points = np.empty((len(of), 2))
    points[wide] = code[(at + 16 * k)[wide][:, None] + np.arange(16)].view(float)
    points[~wide] = code[(at + 14 + 2 * k)[~wide][:, None] + np.arange(2)].view(np.int8)
    # whole numbers, so that sums are exact
    steps = np.where(wide[:, None] & (k > 0)[:, None], 0.0, points)
    steps[(size == 16 * n)[of]] = 0
    total = np.cumsum(steps, axis=0)
    before = total[first[of]] - steps[first[of]]
    return np.where(wide[:, None], points, total - before)


def pieces(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of points (keys, pos, y, x) with their order by keys and pos, the places in it where a piece of a path begins, and the points in order.

    A piece has points of one path whose places follow one another, PIECE at most.
    """
    for table in in_tables(batches):
        code, pos = codes(table, keys), table["pos"].to_numpy().astype(np.int64)
        order = np.lexsort((pos, code))
        new = np.r_[True, (np.diff(code[order]) != 0) | (np.diff(pos[order]) != 1)]
        begins = np.flatnonzero(new)
        at = np.arange(len(order)) - begins[np.cumsum(new) - 1]
        points = np.stack([table[c].to_numpy()[order].astype(float) for c in "yx"], axis=1)
        yield table, order, np.flatnonzero(at % PIECE == 0), points


def coded_pieces(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys, pos, n_, points_): pieces of paths as bytes; pos is the first point's."""
    for table, order, first, points in pieces(batches, keys):
        n, of = np.diff(np.r_[first, len(order)]), pa.array(order[first])
        yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(of) for c in [*keys, "pos"]), pa.array(n, pa.int32()), coded(points, n)], [*keys, "pos", "n_", "points_"])
