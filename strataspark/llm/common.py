"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: White space that separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests, a laptop) one is made, and checkpoint() uses it too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named in0, in1, ..., which working columns don't clash with, and these names by the old ones."""
    names = {c: f"in{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def text_of(text: str | Column = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text without nulls, as an array."""
    return F.array_remove(F.split(text, SPACE), "")


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


_HELD: dict = {}


def worker_cache(key, make: Callable[[], T]) -> T:
    """What a worker process keeps between tasks, one thing at a time: another operator's caches go first."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose texts (strings in `column`) have about `most` bytes, so that what is made of them stays small; none is empty."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield _dense(batch.slice(at, to - at))
            at = to


def _dense(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The same rows in arrays of their own, so that offsets begin at 0."""
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c]) if not c.offset else c.take(pa.array(np.arange(len(c)))) for c in batch.columns], names=batch.schema.names)


class Ragged:
    """Rows of numbers of different lengths, one after the other."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths.astype(np.int64)
        self.ends = np.cumsum(self.lengths)

    @classmethod
    def of(cls, rows: list[bytes]) -> Ragged:
        """From rows of little-endian uint32."""
        return cls(np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4)

    def take(self, rows: np.ndarray) -> Ragged:
        """The given rows, one after the other."""
        lengths = self.lengths[rows]
        begin = (self.ends - self.lengths)[rows]
        ends = np.cumsum(lengths)
        return Ragged(self.values[np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths)

    def joined(self, counts: np.ndarray) -> Ragged:
        """Each row made of as many rows as counted."""
        ends = np.r_[0, self.ends][np.r_[0, np.cumsum(counts)]]
        return Ragged(self.values, np.diff(ends))

    def __getitem__(self, k: int) -> np.ndarray:
        return self.values[self.ends[k] - self.lengths[k] : self.ends[k]]


class TwoGenerations:
    """A bounded cache of two dicts: when `now` is full it becomes the old one, and what is still in use comes back."""

    def __init__(self, most: int = 300_000):
        self.most, self.now, self.old = most, {}, {}

    def absent(self, keys: set) -> list:
        """The keys that have no value yet; all others are in `now` afterwards."""
        new = []
        for k in keys - self.now.keys():
            if k in self.old:
                self.now[k] = self.old[k]
            else:
                new.append(k)
        return new

    def make_room(self) -> None:
        """To be called between batches."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
