"""Small groups in large numbers: a task works on many whole groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of whole groups that a task puts together before it works on them.
ROWS = 1 << 17


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where another group begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    columns = [table[k].combine_chunks() for k in keys]
    while columns:
        column = columns.pop()
        if pa.types.is_struct(column.type):
            columns += column.flatten()
            continue
        code = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of ROWS rows or one group each at least, with the places where groups begin, from batches in order of the keys."""
    left, rows, wanted = [], 0, ROWS
    for batch in batches:
        left.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(left)
        starts = _starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks(), starts[:-1]
        left, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
        # a group that goes on is looked at again when it has doubled
        wanted = max(ROWS, 2 * rows)
    if rows:
        table = pa.Table.from_batches(left).combine_chunks()
        yield table, _starts(table, keys)


def codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row, the same where the keys are."""
    out, n = np.zeros(table.num_rows, np.int64), 1
    columns = [table[k].combine_chunks() for k in keys]
    while columns:
        column = columns.pop()
        if pa.types.is_struct(column.type):
            columns += column.flatten()
            continue
        found = pc.dictionary_encode(column, null_encoding="encode")
        out = out * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
        n *= len(found.dictionary)
        if n > 1 << 40:
            out = np.unique(out, return_inverse=True)[1]
            n = len(out)
    return out


def in_tables(batches: Iterable[pa.RecordBatch], wanted: int | None = None) -> Iterator[pa.Table]:
    """Batches put together to tables of so many rows (or ROWS) at least; the last one may be smaller."""
    left, rows = [], 0
    for batch in batches:
        left.append(batch)
        rows += batch.num_rows
        if rows >= (wanted or ROWS):
            yield pa.Table.from_batches(left).combine_chunks()
            left, rows = [], 0
    if rows:
        yield pa.Table.from_batches(left).combine_chunks()


def by_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], dict], schema: str, order: list[str] | None = None, opened: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Rows that run(table, starts) makes of whole groups (keys) of df, each in the order of some columns.

    opened: makes the batches that are grouped from those that were dealt. run returns arrays by name. Spark deals the groups to tasks and sorts them; a task holds ROWS rows, or one group.
    """
    types = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(opened(batches) if opened else batches, keys):
            made = run(table, starts)
            arrays = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in types]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=types)

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(work, schema)

