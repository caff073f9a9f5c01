"""What the two classifiers share: a bounded labelled sample, and a table of word values."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


#: Characters that all texts of a sample have together at most.
SAMPLE_CHARS = 24_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, each: int, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Whole texts and labels of at most `each` labelled rows of either class, for training only, and all rows' number by class.

    Rows are taken in the order of their id's hash among those where `learn` (over doc_id) holds, as long as the
    sample has at most most_chars characters, so what reaches the driver has a bound. Null labels and null ids don't
    count; a document that is labelled both ways is one of class 1.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y_")).where(F.col("y_").isin(0, 1) & learn)
    chosen = [known.where(F.col("y_") == y).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(each) for y in (0, 1)]
    # at most 2 * each rows of two numbers
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sizes = found.groupBy("doc_id", "y_").agg(F.max(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(2 * each).collect()
    total, kept = 0, []
    for r in sizes:
        if total + r["n"] <= most_chars:
            total += r["n"]
            kept.append(r["doc_id"])
    totals = {r["y_"]: r["count"] for r in known.groupBy("y_").count().collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")
    one = found.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y_").agg(F.min("text").alias("text"))
    rows = one.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").collect()
    return [r["text"] for r in rows], np.array([r["y_"] for r in rows], dtype=np.int64), np.array([totals.get(0, 0), totals.get(1, 0)])


def indexed(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of some texts, all tokens as places among them, and the number of each text's tokens."""
    index: dict[bytes, int] = {}
    rows = [np.fromiter((index.setdefault(w, len(index)) for w in x.encode().split()), np.int32) for x in texts]
    return list(index), np.concatenate([*rows, np.empty(0, np.int32)]), np.array([len(r) for r in rows], dtype=np.int64)


class WordTable:
    """Values of words, computed once while they are in the table; starts anew when it is full."""

    def __init__(self, width: int, make: Callable[[list[bytes]], np.ndarray], most: int = 300_000):
        self.width, self.make, self.most = width, make, most
        self.index: dict[bytes, int] = {}
        self.values = array("f")

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A row of values for each word, and the words' places in the table."""
        if len(self.index) > self.most:
            self.index.clear()
            self.values = array("f")
        new = list(set(words).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.values.frombytes(np.ascontiguousarray(self.make(new), dtype=np.float32).tobytes())
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.values, np.float32).reshape(-1, self.width)[at], at


def portions(texts: list[str], most: int = 250_000):
    """(first row, words of each text) in portions of about `most` words."""
    at, held, n = 0, [], 0
    for i, x in enumerate(texts):
        words = x.encode().split()  # ASCII white space only
        held.append(words)
        n += len(words)
        if n >= most:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held
