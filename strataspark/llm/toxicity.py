"""Toxicity: a linear-chain conditional random field over the words of whole texts.

Two states, plain and toxic. A word's features are its hashed form, prefixes and suffixes; the chain
adds transitions. Forward-backward marginals of the toxic state give offending words, and their
number and maximum give the document's score through a logistic fit.

Labels exist for documents only, so words are labelled first: in toxic training documents a word is
toxic where one of its features stands in far more toxic than clean documents (a likelihood ratio and
a precision bound). Training reads a bounded sample: EACH labelled rows of either class with SAMPLE_CHARS
characters together; each text is one chain, and the gradients of transitions are exact, from the marginals
of adjacent pairs. Scoring reads every word of every text: all chains of a batch are one product of 2 x 2
matrices, cut into rows, whose exact prefix products numpy forms column by column.

Defined cases: null and empty texts get the score of a text without toxic words; with no labels of
one class every score is the share of toxic labels (0 without any); repeated rows score alike; very
long texts are one chain; extra columns stay with `tag`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, read_table, slices, text_of, worker_cache
from .labelled import WordTable, indexed, labelled_sample, portions

EACH = 2000
BUCKETS = 1 << 18
RATIO, SHARE = 24.0, 0.95
_FEATURES = 1 + 6 + 3


def word_features(word: bytes) -> list[int]:
    """Buckets of a word's features; 0 where a word is too short for one."""
    w = word.decode(errors="replace").lower().strip("*$%&#|<>.,;:!?\"'()[]{}+=-_~/\\`^@")
    n = len(w)
    out = [crc32(b"=" + w.encode()) % (BUCKETS - 1) + 1]
    out += [crc32(f"^{w[:k]}".encode()) % (BUCKETS - 1) + 1 if n >= k else 0 for k in range(3, 9)]
    out += [crc32(f"${w[-k:]}".encode()) % (BUCKETS - 1) + 1 if n >= k else 0 for k in range(3, 6)]
    return out


def marginals(s: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(toxic) of each word. s: log-odds of the words; first: whether a chain starts; a: transitions; b: start."""
    return _forward_backward(s, first, a, b)[0]


def _forward_backward(s: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of words and, with pairs, of the states (i, j) of a word and the one before: [2 i + j, word], zero where a chain starts."""
    n = len(s)
    if not n:
        return np.empty(0), np.empty((4, 0))
    cols = max(1, int(np.sqrt(n)))
    rows = -(-n // cols)
    pad = rows * cols - n
    s = np.r_[np.clip(s, -30, 30), np.zeros(pad)].astype(np.float64)
    first = np.r_[first, np.ones(pad, bool)]
    scale = np.exp(-np.maximum(s, 0))
    m = np.empty((4, rows, cols))  # m[2 i + j]: from state i to j
    for i in range(2):
        for j in range(2):
            m[2 * i + j] = (np.exp(np.where(first, b[j], a[i, j]) + (s if j else 0)) * scale).reshape(rows, cols)
    m00, m01, m10, m11 = m

    def norm(x, y):
        t = x + y
        return x / t, y / t

    # what a row does to either state, then the state in which each row starts
    p = np.stack([np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)])
    for c in range(cols):
        q = np.stack([p[0] * m00[:, c] + p[1] * m10[:, c], p[0] * m01[:, c] + p[1] * m11[:, c], p[2] * m00[:, c] + p[3] * m10[:, c], p[2] * m01[:, c] + p[3] * m11[:, c]])
        p = q / q.max(0)
    at, x = np.empty((2, rows)), (0.5, 0.5)
    for r in range(rows):
        at[:, r] = x
        x = norm(x[0] * p[0, r] + x[1] * p[2, r], x[0] * p[1, r] + x[1] * p[3, r])
    fore, x = np.empty((2, rows, cols)), (at[0], at[1])
    for c in range(cols):
        x = norm(x[0] * m00[:, c] + x[1] * m10[:, c], x[0] * m01[:, c] + x[1] * m11[:, c])
        fore[0][:, c], fore[1][:, c] = x
    # backwards: what follows a word, given its state
    after, y = np.empty((2, rows)), (0.5, 0.5)
    for r in range(rows - 1, -1, -1):
        after[:, r] = y
        y = norm(p[0, r] * y[0] + p[1, r] * y[1], p[2, r] * y[0] + p[3, r] * y[1])
    back, y = np.empty((2, rows, cols)), (after[0], after[1])
    for c in range(cols - 1, -1, -1):
        back[0][:, c], back[1][:, c] = y
        y = norm(m00[:, c] * y[0] + m01[:, c] * y[1], m10[:, c] * y[0] + m11[:, c] * y[1])
    toxic = fore[1] * back[1]
    p = (toxic / (toxic + fore[0] * back[0])).reshape(-1)[:n]
    if not pairs:
        return p, None
    m, fore, back = m.reshape(4, -1)[:, :n], fore.reshape(2, -1)[:, :n], back.reshape(2, -1)[:, :n]
    both = np.zeros((4, n))
    for i in range(2):
        for j in range(2):
            both[2 * i + j, 1:] = fore[i, :-1] * m[2 * i + j, 1:] * back[j, 1:]
    both[:, first[:n]] = 0
    return p, both / np.maximum(both.sum(0), 1e-300)


def _weak_labels(feats: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets that stand in far more toxic than clean documents."""
    k1, k0 = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for label, at, n in zip(y, np.cumsum(lengths) - lengths, lengths, strict=True):
        (k1 if label else k0)[np.unique(feats[np.unique(tokens[at : at + n])])] += 1
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))

    def ll(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    pooled = (k1 + k0) / (n1 + n0)
    ratio = 2 * (ll(k1, n1, k1 / n1) + ll(k0, n0, k0 / n0) - ll(k1, n1, pooled) - ll(k0, n0, pooled))
    share = (k1 / n1) / np.maximum(k1 / n1 + k0 / n0, 1e-12)
    strong = (ratio >= RATIO) & (share >= SHARE)
    strong[0] = False
    return strong


class Tagger:
    """Weights of the field and of the document score."""

    def __init__(self, weights: np.ndarray, a: np.ndarray, b: np.ndarray, final: np.ndarray):
        self.weights, self.a, self.b, self.final = weights, a, b, final

    def emissions(self, words: list[bytes]) -> np.ndarray:
        return self.weights[np.array([word_features(w) for w in words], dtype=np.int64).reshape(-1, _FEATURES)].sum(1, keepdims=True)

    def score(self, total: np.ndarray, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.final[0] + self.final[1] * np.log1p(total) + self.final[2] * top)))


def _sums(p: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over offending words (p of 0.5 or more, so that length alone adds nothing) and maximum of p for each text."""
    total, top = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if len(full):
        at = (np.cumsum(lengths) - lengths)[full]
        total[full], top[full] = np.add.reduceat(np.where(p >= 0.5, p, 0), at), np.maximum.reduceat(p, at)
    return total, top


def train(texts: list[str], y: np.ndarray, totals: np.ndarray | None = None, steps: int = 200, seed: int = 7) -> Tagger:
    """Numpy training of four epochs, or of more where they have fewer steps; y: 0 or 1 for each text; totals: how many labelled rows of each class these stand for."""
    rng = np.random.default_rng(seed)
    words, tokens, lengths = indexed(texts)
    weights, a, b = np.zeros(BUCKETS), np.array([[0.0, -3.0], [0.0, -3.0]]), np.array([0.0, -3.0])
    if not (len(tokens) and (y == 1).any() and (y == 0).any()):
        share = float(y.mean()) if len(y) else 0.0
        return Tagger(weights - 3.0 / _FEATURES, a, b, np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0]))
    feats = np.fromiter((f for w in words for f in word_features(w)), np.int32, len(words) * _FEATURES).reshape(-1, _FEATURES)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    strong = _weak_labels(feats, tokens, lengths, y)
    gold = strong[feats].any(1)[tokens] & (y[owner] == 1)

    full = np.flatnonzero(lengths)
    start, size = (np.cumsum(lengths) - lengths)[full], lengths[full]
    g_w, g_t = np.full(BUCKETS, 0.3), np.full(4, 1e-3)
    lots = max(1, len(full) // 64)
    for _ in range(max(4, steps // lots)):
        for some in np.array_split(rng.permutation(len(full)), lots):
            n = size[some]
            ends = np.cumsum(n)
            at = np.repeat(start[some] - (ends - n), n) + np.arange(ends[-1])
            first = np.zeros(len(at), bool)
            first[ends - n] = True
            f, seen = feats[tokens[at]], gold[at]
            p, both = _forward_backward(weights[f].sum(1), first, a, b, pairs=True)
            grad = np.bincount(f.ravel(), np.repeat(p - seen, _FEATURES), BUCKETS) / len(some) + 1e-4 * weights
            grad[0] = 0
            g_w += grad**2
            weights -= 0.5 * grad / np.sqrt(g_w)
            # transitions (0, 1), (1, 0), (1, 1) and the start: expected less seen
            old, new = seen[:-1][~first[1:]], seen[1:][~first[1:]]
            there = np.array([(~old & new).sum(), (old & ~new).sum(), (old & new).sum()])
            moves = np.r_[both[1:].sum(1) - there, (p[first] - seen[first]).sum()] / len(some)
            g_t += moves**2
            step = 0.5 * moves / np.sqrt(g_t)
            a -= np.array([[0, step[0]], [step[1], step[2]]])
            b[1] -= step[3]

    log_odds = sum(weights[feats[:, k]] for k in range(_FEATURES))
    total, top, ends = np.zeros(len(lengths)), np.zeros(len(lengths)), np.cumsum(lengths)
    for some in np.array_split(np.arange(len(lengths)), -(-len(lengths) // 200)):  # few texts' chains at a time
        n = lengths[some]
        own = tokens[ends[some[0]] - n[0] : ends[some[-1]]]
        first = np.zeros(len(own), bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        total[some], top[some] = _sums(marginals(log_odds[own], first, a, b), n)
    x = np.stack([np.ones(len(y)), np.log1p(total), top], axis=1)
    final, held = np.zeros(3), np.bincount(y, minlength=2)
    each = ((held if totals is None else np.maximum(totals, held)) / held)[y]
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ final))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (each * (p - y)) + 0.05 * final)
        final -= np.clip(step, -2, 2)
    return Tagger(weights, a, b, final)


def learn(docs: DataFrame, labels: DataFrame, rows=None, each: int = EACH) -> Tagger:
    """From labelled rows where `rows` (a condition over doc_id; all by default) holds."""
    return train(*labelled_sample(docs, labels, "toxic", F.lit(True) if rows is None else rows, each))


def _table(key: int, tagger: Tagger) -> WordTable:
    """One for each model and worker process."""
    return worker_cache(("toxicity", key), lambda: WordTable(1, tagger.emissions))


def _scored(texts: list[str], tagger: Tagger, table: WordTable, spans: bool) -> tuple[np.ndarray, list]:
    scores, found = np.empty(len(texts)), [[] for _ in texts]
    for at, split in portions(texts):
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        s = table.look_up([w for x in split for w in x])[0][:, 0] if lengths.sum() else np.empty(0)
        first = np.zeros(len(s), bool)
        ends = np.cumsum(lengths)
        first[(ends - lengths)[lengths > 0]] = True
        p = marginals(s, first, tagger.a, tagger.b)
        scores[at : at + len(split)] = tagger.score(*_sums(p, lengths))
        if spans and (hits := np.flatnonzero(p >= 0.5)).size:
            for i in np.unique(np.searchsorted(ends, hits, "right")):
                own = set((hits[(hits >= ends[i] - lengths[i]) & (hits < ends[i])] - (ends[i] - lengths[i])).tolist())
                words = re.finditer(r"[^\x20\x09-\x0D]+", texts[at + i])
                found[at + i] = [(m.start(), m.end()) for k, m in enumerate(words) if k in own]
    return scores, found


TAGS = "score double, spans array<struct<start:int,end:int>>"


def tag(docs: DataFrame, tagger: Tagger, text: str = "text", spans: bool = True) -> DataFrame:
    """docs with the struct `tox_`: the score, and the places of offending words (code points, end exclusive)."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)  # 2 MB: BUCKETS weights
    key = crc32(tagger.weights.tobytes() + tagger.final.tobytes())

    @F.pandas_udf(TAGS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            scores, found = _scored(batch.tolist(), model, _table(key, model), spans)
            yield pd.DataFrame({"score": scores, "spans": [[{"start": s, "end": e} for s, e in x] for x in found]})

    return docs.withColumn("tox_", run(text_of(text)))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of("doc_id", 4)
    tagger = learn(docs, read_table(spark, sf_dir, "labels"), fold != 2)
    held = spark.sparkContext.broadcast(tagger)
    key = crc32(tagger.weights.tobytes() + tagger.final.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            scores, found = _scored(batch.column(1).to_pylist(), held.value, _table(key, held.value), True)
            spans = [",".join(f"{s}:{e}" for s, e in x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array([len(x) for x in found], pa.int64()), pa.array(spans, pa.string())], ["doc_id", "score", "n_spans", "spans"])

    scored = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double, n_spans long, spans string")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_spans", "spans")
