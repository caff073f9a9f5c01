"""Language-model scoring: interpolated modified Kneser-Ney over bigrams.

Tokens are words with A-Z lowered, then one end for each text; they are known by 64-bit hashes. Counting:
tasks count the pairs of their texts portion by portion and send sorted arrays to buckets; a bucket is a
range of pair hashes, whose upper bits come from the first word and one of SPREAD parts of the second, so
that a very frequent first word is spread. Buckets add up equal pairs, write (hash, count) as sorted arrays
into the shared folder, and send on what each word has as a context (pairs seen once, twice, more often)
and as a continuation (tokens, different contexts). Ranges of word hashes add these up and write the word
table. Only a line of totals for each range reaches the driver.

Scoring: workers map the files into memory (a shared folder that is not a file system is first copied into the
worker's own temporary folder) and look up a portion's different words and pairs in order.

    p(w | u) = (c(u w) - D(c)) / c(u) + g(u) p1(w),  p1(w) = (n(w) - E(n)) / T + g1 / (V + 1)

c: pair counts, n(w): contexts before w, T: different pairs, V: different tokens; D and E are the discounts
for counts 1, 2 and more. After a word that training has not seen, p1 alone counts.

Why bigrams: triples would multiply what is shuffled. Of 21.7 million training tokens of a table of 0.1 GB, 10.2 million
pairs and 15.5 million triples differ; with 17 bytes for each of the triples (a pair's hash, a word's hash, a count) these
alone take 2.6 times the table, beside the pairs, which are still needed as contexts.

Defined cases: null and empty texts have one token, the end; without training texts every p is 1; repeated rows count
and are scored as rows of their own; very long texts are cut into portions for counting only; extra
columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, new_path, read_table, slices, stage, text_of, worker_cache

SPREAD = 16
#: Tokens that are split, or scored, at a time, and pairs that a task gathers before it counts and sends them.
PORTION, GATHERED = 250_000, 1_500_000
#: With spaces, so that no word of a text equals them.
_START, _END = b" start", b" end"
_ROUTE = np.uint64(52)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """12 bits from the first word and a part of the second, 52 from both."""
    route = _mix(u + (_mix(v) % np.uint64(SPREAD))) >> _ROUTE
    return route << _ROUTE | _mix(u * np.uint64(3) + _mix(v)) & np.uint64((1 << 52) - 1)


class Hashes:
    """Word hashes, computed once while they are in the table."""

    def __init__(self, most: int = 300_000):
        self.most, self.index, self.values = most, {}, np.empty(0, np.uint64)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and its place in the table."""
        from xxhash import xxh64_intdigest

        if len(self.index) > self.most:
            self.index, self.values = {}, np.empty(0, np.uint64)
        new = list(set(words).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.values = np.r_[self.values, np.fromiter(map(xxh64_intdigest, new), np.uint64, len(new))]
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.values[at], at


def hashes() -> Hashes:
    return worker_cache("language_model", Hashes)


def token_portions(texts: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, tokens of each text: start, words, end) in portions of about PORTION tokens."""
    at, held, n = 0, [], 0
    for i, x in enumerate(texts):
        held.append([_START, *x.encode().lower().split(), _END])
        n += len(held[-1])
        if n >= PORTION:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held


def _pairs(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of all tokens, and whether each is a start."""
    h, at = hashes().look_up([w for x in split for w in x])
    lengths = np.array([len(x) for x in split])
    first = np.zeros(len(h), bool)
    first[np.cumsum(lengths) - lengths] = True
    return h, at, first


def _summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each column."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    return (key[begin], begin, order, *(np.add.reduceat(c[order], begin) if len(key) else c[:0] for c in columns))


def _count(buckets: int):
    def counted(gathered: list[np.ndarray]) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*gathered, strict=True))
        key, begin, order, c = _summed(pair_hash(u, v), np.ones(len(u), _U32))
        at = order[begin]
        u, v = u[at], v[at]
        bucket = ((key >> _ROUTE).astype(np.int64) * buckets) >> 12
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        blobs = [u[s:e].tobytes() + v[s:e].tobytes() + c[s:e].astype(_U32).tobytes() for s, e in zip(cut[full], cut[full + 1], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in slices(batches, 4000):
            for _, split in token_portions(batch.column(0).to_pylist()):
                h, _, first = _pairs(split)
                second = ~first[1:]
                gathered.append((h[:-1][second], h[1:][second]))
                n += len(gathered[-1][0])
                if n >= GATHERED:
                    yield counted(gathered)
                    gathered, n = [], 0
        if gathered:
            yield counted(gathered)

    return run


_U64, _U32 = np.uint64, np.uint32


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Whole or not at all: under a name of its own first, then renamed."""
    import uuid

    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    fs.move(temp, f"{root}/{name}")


def _split(blobs: list[bytes], *types) -> list[np.ndarray]:
    """The columns of blobs that hold them one after the other."""
    width = sum(np.dtype(t).itemsize for t in types)
    out = [[] for _ in types]
    for b in blobs:
        n, at = len(b) // width, 0
        for k, t in enumerate(types):
            out[k].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, types, strict=True)]


#: What a word adds up to: tokens, contexts before it, and pairs after it seen once, twice, more often.
_WORD_TYPES = (_U64, _U64, _U32, _U32, _U32, _U32)


def _pair_bucket(folder: str, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        u, v, c = _split(table.column("blob").to_pylist(), _U64, _U64, _U32)
        key, begin, order, c = _summed(pair_hash(u, v), c.astype(_U64))
        u, v = u[order][begin], v[order][begin]
        _write(folder, f"pairs-{bucket:05d}", [key, c])
        seen = [int((c == k).sum()) for k in (1, 2, 3, 4)] + [len(key)]
        del key, order, begin
        zero = np.zeros(len(c), _U32)
        follow = [np.r_[x.astype(_U32), zero] for x in (c == 1, c == 2, c >= 3)]
        word, _, _, tokens, before, once, twice, more = _summed(np.r_[u, v], np.r_[zero, c].astype(_U64), np.r_[zero, zero + _U32(1)], *follow)
        part = (word >> _ROUTE).astype(np.int64) * ranges >> 12
        cut = np.searchsorted(part, np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(cut))
        columns = [word, tokens, *(x.astype(_U32) for x in (before, once, twice, more))]
        blobs = [b"".join(x[s:e].tobytes() for x in columns) for s, e in zip(cut[full], cut[full + 1], strict=True)]
        return pa.table([pa.array([*full, -1], pa.int32()), pa.array([*blobs, b""], pa.binary()), pa.array([*([None] * len(full)), seen], pa.list_(pa.int64()))], names=["part", "blob", "seen"])

    return run


def _word_range(folder: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        word, *columns = _split(table.column("blob").to_pylist(), *_WORD_TYPES)
        word, _, _, tokens, before, once, twice, more = _summed(word, *(c.astype(_U64) for c in columns))
        _write(folder, f"words-{part:05d}", [word, tokens, *(x.astype(_U32) for x in (before, once, twice, more))])
        kinds = before > 0  # all but the start
        seen = [int(tokens.sum()), int(kinds.sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4))]
        return pa.table([pa.array([seen], pa.list_(pa.int64()))], names=["seen"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts 1, 2 and more; where counts of counts are missing, the usual 0.5, 0.75 and 1 times k / (k + 1)."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 0.9, 1.2
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


@dataclass
class Model:
    """Totals, and where the arrays are; opened in each worker."""

    folder: str
    buckets: int
    tokens: int
    kinds: int
    pairs: int
    texts: int
    pair_discounts: tuple
    word_discounts: tuple
    spare: float  # g1: mass of the words' discounts
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _arrays(self, name: str, types) -> list[np.ndarray]:
        """Columns of one file, mapped into memory; empty where there is no such file."""
        if name not in self._open:
            self._open[name] = [np.empty(0, t) for t in types]
            path = _local(self.folder, name)
            if path:
                raw = np.memmap(path, np.uint8, "r")
                n, at = len(raw) // sum(np.dtype(t).itemsize for t in types), 0
                for k, t in enumerate(types):
                    end = at + n * np.dtype(t).itemsize
                    self._open[name][k] = raw[at:end].view(t)
                    at = end
        return self._open[name]

    def look_up(self, kind: str, types, keys: np.ndarray) -> list[np.ndarray]:
        """For sorted distinct keys the columns behind them, zero where a key is absent."""
        out = [np.zeros(len(keys), t) for t in types[1:]]
        part = (keys >> _ROUTE).astype(np.int64) * self.buckets >> 12
        cut = np.searchsorted(part, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            own, *columns = self._arrays(f"{kind}-{b:05d}", types)
            if len(own):
                some = keys[cut[b] : cut[b + 1]]
                at = np.minimum(np.searchsorted(own, some), len(own) - 1)
                there = own[at] == some
                for o, c in zip(out, columns, strict=True):
                    o[cut[b] : cut[b + 1]] = np.where(there, c[at], 0)
        return out

    def score(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base score and score of each text."""
        h, at, first = _pairs(split)
        places, back = np.unique(at, return_inverse=True)
        own = hashes().values[places]
        order = np.argsort(own)
        found = self.look_up("words", _WORD_TYPES, own[order])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        word = rank[back]  # the token's place among sorted words
        tokens, before, once, twice, more = (x.astype(np.float64) for x in found)
        d, e = self.pair_discounts, self.word_discounts
        base = np.log10((tokens + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))
        if self.pairs:
            p1 = np.maximum(before - np.choose(np.minimum(before, 3).astype(int), (0, *e)), 0) / self.pairs + self.spare / (self.kinds + 1)
        else:
            p1 = np.ones(len(own))
        seen = np.where(tokens > 0, tokens, once + twice + more)
        seen[rank[back[first]]] = self.texts  # the start
        second = np.flatnonzero(~first)
        u, v = word[second - 1], word[second]
        key, where = np.unique(pair_hash(h[second - 1], h[second]), return_inverse=True)
        c = self.look_up("pairs", (_U64, _U64), key)[0].astype(np.float64)
        c = (c - np.choose(np.minimum(c, 3).astype(int), (0, *d)))[where]
        total = np.maximum(seen[u], 1)
        left = np.where(seen[u] > 0, (d[0] * once + d[1] * twice + d[2] * more)[u] / total, 1.0)
        p = c / total + left * p1[v]
        begin = np.cumsum([0, *(len(x) - 1 for x in split)])[:-1]
        reduce = lambda x: np.add.reduceat(x, begin)
        return reduce(np.ones(len(v), np.int64)), reduce((tokens[v] > 0).astype(np.int64)), reduce(base[v]), reduce(np.log10(p))


_COPIES: dict[str, str] = {}


def _local(folder: str, name: str) -> str | None:
    """A local path of the file, or None if there is none."""
    from pyarrow.fs import FileSystem, FileType, LocalFileSystem

    fs, root = FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type == FileType.NotFound:
        return None
    if isinstance(fs, LocalFileSystem):
        return path
    if path not in _COPIES:
        with fs.open_input_stream(path) as f, tempfile.NamedTemporaryFile(delete=False) as out:
            while data := f.read(1 << 20):
                out.write(data)
        _COPIES[path] = out.name
    return _COPIES[path]


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Counts all texts of docs; the model's arrays are files in the shared folder."""
    spark = docs.sparkSession
    folder, buckets = new_path(spark, "ngrams"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(buckets, 4096))
    texts = docs.select(text_of(text).alias("text"))
    pairs = texts.mapInArrow(_count(buckets), "bucket int, blob binary").groupBy("bucket").applyInArrow(_pair_bucket(folder, buckets), "part int, blob binary, seen array<bigint>")
    pairs = stage(pairs, "pairs")
    words = pairs.where("part >= 0").select("part", "blob").groupBy("part").applyInArrow(_word_range(folder), "seen array<bigint>")
    add = lambda df, n: [int(x or 0) for x in df.agg(*(F.sum(F.col("seen")[k]) for k in range(n))).first()]
    n1, n2, n3, n4, kinds_of_pairs = add(pairs.where("seen is not null"), 5)
    tokens, kinds, before, t1, t2, t3, t4 = add(words, 7)
    e = discounts(t1, t2, t3, t4)
    spare = (e[0] * t1 + e[1] * t2 + e[2] * (kinds - t1 - t2)) / max(1, before)
    # one end for each text: the start was seen as often
    ends = Model(folder, buckets, tokens, kinds, kinds_of_pairs, 0, discounts(n1, n2, n3, n4), e, spare)
    one = hashes().look_up([_END])[0]
    ends.texts = int(ends.look_up("words", _WORD_TYPES, one)[0][0])
    ends._open.clear()
    return ends


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            ids = batch.column(0)
            for at, split in token_portions(batch.column(1).to_pylist()):
                n, known, base, own = model.score(split)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(split)), pa.array(n), pa.array(known), pa.array(base), pa.array(own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """scored with the perplexity of each text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of("doc_id", 5) == 1
    model = learn(docs.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
