"""Quality: supervised subword embeddings.

A word's features are its hashed form and its character n-grams (with marks for its ends); a word that
repeats the one before it has REPEAT features more, all of bucket 0. Every
bucket has a vector; a document is the mean of its words' feature vectors, and a softmax over two
classes gives the score. Vectors and output are trained together by stochastic gradient descent in
numpy. Since output is linear in the mean, at scoring a bucket counts by one number, its vector's
difference in log-odds, and a word by their sum; these are held in a bounded table in each worker.

Training reads a bounded sample: EACH labelled rows of either class with SAMPLE_CHARS characters together,
every word of each in every epoch. Scoring reads every word of every text.

Defined cases: null and empty texts have the score of the bias alone; with labels of one class or none
the score is their share (0.5 without any); repeated rows score alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, read_table, slices, text_of, worker_cache
from .labelled import WordTable, indexed, labelled_sample, portions

EACH = 2000
BUCKETS, DIM, NGRAMS, REPEAT = 1 << 17, 8, (3, 4), 10


def word_features(word: bytes) -> list[int]:
    """Buckets of the word and its n-grams; bucket 0 is for repeats."""
    w = b"\x02" + word + b"\x03"
    out = [crc32(w)]
    for n in NGRAMS:
        out += [crc32(w[i : i + n]) for i in range(len(w) - n + 1)]
    return [h % (BUCKETS - 1) + 1 for h in out]


class Classifier:
    """Log-odds: bias + mean of the weights of all features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def word_values(self, words: list[bytes]) -> np.ndarray:
        """The sum of weights and the number of features of each word."""
        feats = [word_features(w) for w in words]
        n = np.array([len(f) for f in feats], dtype=np.int64)
        flat = np.fromiter((x for f in feats for x in f), np.int64, int(n.sum()))
        return np.stack([np.add.reduceat(self.weights[flat], np.cumsum(n) - n), n.astype(np.float32)], axis=1)


def train(texts: list[str], y: np.ndarray, epochs: int = 6, rate: float = 0.6, seed: int = 5) -> Classifier:
    rng = np.random.default_rng(seed)
    share = (float((y == 1).sum()) + 0.5) / (len(y) + 1)
    if not ((y == 1).any() and (y == 0).any()):
        return Classifier(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    vocabulary, tokens, lengths = indexed(texts)
    begin = np.cumsum(lengths) - lengths
    repeats = np.r_[False, tokens[1:] == tokens[:-1]]
    repeats[begin[lengths > 0]] = False
    n_feats = np.array([1 + sum(max(0, len(w) + 3 - n) for n in NGRAMS) for w in vocabulary], dtype=np.int64)
    flat = np.fromiter((x for w in vocabulary for x in word_features(w)), np.int32, int(n_feats.sum()))
    offset = np.cumsum(n_feats) - n_feats
    vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    output, bias = np.zeros((2, DIM)), np.zeros(2)
    speed_v, speed_o, speed_b = np.full(BUCKETS, 1e-6), 1e-6, 1e-6
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            # every word of the texts, equal ones of a text together
            n = lengths[some]
            ends = np.cumsum(n)
            at = np.repeat(begin[some] - (ends - n), n) + np.arange(n.sum())
            doc = np.repeat(np.arange(len(some)), n)
            pair, count = np.unique(doc * len(vocabulary) + tokens[at], return_counts=True)
            words, place = np.unique(pair % max(1, len(vocabulary)), return_inverse=True)
            doc_of = pair // max(1, len(vocabulary))
            k = n_feats[words]
            f = flat[np.repeat(offset[words], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            again = np.bincount(doc[repeats[at]], minlength=len(some)) * REPEAT
            size = np.maximum(np.bincount(doc_of, count * k[place], len(some)) + again, 1)[:, None]
            word_sums = np.add.reduceat(vectors[f], np.cumsum(k) - k) if len(words) else np.empty((0, DIM))
            mean = np.stack([np.bincount(doc_of, count * word_sums[place, j], len(some)) for j in range(DIM)], axis=1)
            mean = (mean + again[:, None] * vectors[0]) / size
            z = mean @ output.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            gap = (p - np.eye(2)[y[some]]) / len(some)
            g_mean = gap @ output / size
            g_out, g_bias = gap.T @ mean, gap.sum(0)
            g_word = np.stack([np.bincount(place, count * g_mean[doc_of, j], len(words)) for j in range(DIM)], axis=1)
            g_vec = np.stack([np.bincount(f, np.repeat(g_word[:, j], k), BUCKETS) for j in range(DIM)], axis=1)
            g_vec[0] += again @ g_mean
            speed_v += (g_vec**2).mean(1)
            speed_o += float((g_out**2).mean())
            speed_b += float((g_bias**2).mean())
            vectors -= rate * 0.1 * g_vec / np.sqrt(speed_v)[:, None]
            output -= rate * 0.1 * g_out / np.sqrt(speed_o)
            bias -= rate * 0.1 * g_bias / np.sqrt(speed_b)
    return Classifier(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


def _table(key: int, model: Classifier) -> WordTable:
    """One for each model and worker process."""
    return worker_cache(("quality_classifier", key), lambda: WordTable(2, model.word_values))


def scores(texts: list[str], model: Classifier, table: WordTable) -> np.ndarray:
    out = np.empty(len(texts))
    for at, split in portions(texts):
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        total = np.zeros((len(split), 2))
        full = np.flatnonzero(lengths)
        if len(full):
            values, place = table.look_up([w for x in split for w in x])
            begin = (np.cumsum(lengths) - lengths)[full]
            again = np.r_[False, place[1:] == place[:-1]]
            again[begin] = False
            values = values.astype(np.float64) + again[:, None] * REPEAT * np.array([model.weights[0], 1.0])
            total[full] = np.add.reduceat(values, begin)
        out[at : at + len(split)] = 1 / (1 + np.exp(-np.clip(model.bias + total[:, 0] / np.maximum(total[:, 1], 1), -50, 50)))
    return out


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) for whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB: BUCKETS weights
    key = crc32(model.weights.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            s = scores(batch.column(1).to_pylist(), held.value, _table(key, held.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of("doc_id", 5)
    model = train(*labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", fold != 0, EACH)[:2])
    return classify(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
