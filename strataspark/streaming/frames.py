"""Frames that arrive as a stream: where each begins in its hole's mosaic, and which is the last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ["frame_idx", "n_rows", "row_offset", "is_last"]


def placed_table(frames: DataFrame, key: str) -> DataFrame:
    """(key, frame_idx, n_rows, row_offset, is_last) of a table of frames (key, frame_idx, n_rows): a hole's frames in a window."""
    w = Window.partitionBy(key).orderBy("frame_idx")
    before = F.coalesce(F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frames.select(key, F.col("frame_idx").cast("long"), F.col("n_rows").cast("long"), before.cast("long").alias("row_offset"), F.lead(F.lit(1)).over(w).isNull().alias("is_last"))


def placed_stream(frames: DataFrame, key: str) -> DataFrame:
    """The same of a stream of frames (key, frame_idx, n_rows, ends), where a row with `ends` closes a hole and is no frame.

    A hole's state is one frame, held back until the next one or the end comes, and its offset. Within a
    batch frames may come in any order. A frame that comes in a later batch than one with a larger index is late: it is
    returned with null for offset and last, and moves nothing. A closed hole may begin anew.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        ends = bool(rows["ends"].fillna(False).any())
        own = rows[~rows["ends"].fillna(False).astype(bool)].sort_values("frame_idx")
        index, n = own["frame_idx"].to_numpy(np.int64), own["n_rows"].to_numpy(np.int64)
        offset = 0
        late = np.zeros(len(index), bool)
        if state.exists:
            held, size, offset = state.get
            late = index <= held
            index, n, late = np.r_[held, index], np.r_[size, n], np.r_[False, late]
        out = [(*name, int(i), int(k), None, None) for i, k in zip(index[late], n[late], strict=True)]
        index, n = index[~late], n[~late]
        at = offset + np.cumsum(n) - n
        told = len(index) if ends else max(0, len(index) - 1)
        out += [(*name, int(index[k]), int(n[k]), int(at[k]), ends and k == len(index) - 1) for k in range(told)]
        if ends and state.exists:
            state.remove()
        elif len(index) and not ends:
            state.update((int(index[-1]), int(n[-1]), int(at[-1])))
        yield pd.DataFrame(out, columns=[key, *COLUMNS]).astype({"row_offset": "Int64", "is_last": "boolean"})

    kind = dict(frames.dtypes)[key]
    out = f"`{key}` {kind}, frame_idx long, n_rows long, row_offset long, is_last boolean"
    chosen = frames.select(key, F.col("frame_idx").cast("long").alias("frame_idx"), F.col("n_rows").cast("long").alias("n_rows"), F.col("ends").cast("boolean").alias("ends"))
    return chosen.groupBy(key).applyInPandasWithState(run, out, "frame_idx long, n_rows long, row_offset long", "append", GroupStateTimeout.NoTimeout)


def start_into_folder(stream: DataFrame, folder: str, checkpoint: str, **trigger):
    """Starts a query that writes each batch into a folder of its own, so that a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
