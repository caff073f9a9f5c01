"""Language ID by mixtures: expectation-maximisation over the languages of a document's words.

A word's likelihood in a language comes from its n-grams: byte n-grams of the lower-cased word between two spaces, of
each length in ORDERS, hashed to BUCKETS; their smoothed shares among the language's n-grams are counted
over all training documents. The lengths see the same bytes, so their logarithms are averaged.

A document is a mixture of languages: each word is drawn from one of them. Expectation-maximisation finds
the proportions for all learned languages together. The language set then grows from the language that explains the
document best alone, in the order of these proportions, as long as the likelihood gains more than
PENALTY * log(1 + words) for a language more. Where even all languages together don't gain that much, nothing is
added. The largest proportion of the chosen set is the prediction.

The score is that proportion, times the share of the predicted language among all languages in the likelihood of the
words that the mixture gives to it: near 1 for a text in one language, less for mixed or very short ones.

Only letters count: everything else of ASCII separates words, and runs of more than UNIT bytes are cut, so that
scripts without spaces work too. Whole texts are read, in counting and in prediction.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything where no language was
learned; one learned language gets all other texts; repeated rows are counted and predicted alike; an
empty language name is a language; ties go to the name that sorts first; extra columns are not read. The model has
256 KB for each language, so MOST of them are accepted; more are an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, portions, read_table, stage, text_of, worker_cache
from .labelled import WordTable

ORDERS, BUCKETS, SMOOTH = (2, 3, 4), 1 << 16, 0.5
UNIT = 32
PENALTY, STEPS, TOLERANCE = 2.0, 50, 1e-4
#: A word favours one language over another by this many nats at most.
FLOOR = 50.0
MOST = 1000
UNKNOWN = "und"

_SPLIT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def units(text: str) -> list[bytes]:
    """Words of a text: runs of letters and of other characters beyond ASCII, lower-cased, in pieces of UNIT bytes."""
    words = text.lower().encode().translate(_SPLIT).split()
    if max(map(len, words), default=0) > UNIT:
        words = [w[k : k + UNIT] for w in words for k in range(0, len(w), UNIT)]
    return words


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and for each the place of its word; grouped by word."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    at, found = np.arange(len(data)), []
    for n in ORDERS:
        own = at[at + n <= ends[owner]]
        h = np.full(len(own), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(257) + data[own + k] + np.uint32(1)
        found.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16), owner[own]))
    owners = np.concatenate([o for _, o in found])
    by = np.argsort(owners, kind="stable")
    return np.concatenate([b for b, _ in found])[by].astype(np.int64), owners[by]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's rows (lang, text)."""
    counts: dict[str, np.ndarray] = {}
    seen: dict[str, Counter] = {}

    def flush() -> None:
        for lang, words in seen.items():
            if words:
                buckets, owner = ngrams(list(words))
                held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(buckets, np.fromiter(words.values(), np.float64, len(words))[owner], BUCKETS).astype(np.int64)
        seen.clear()

    for batch in portions(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(units(text))
        if sum(map(len, seen.values())) > 200_000:
            flush()
    flush()
    for lang, n in counts.items():
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(n[full])], ["lang", "bucket", "n"])


class Languages:
    """Learned languages, in order, and the averaged log-likelihoods of n-grams."""

    def __init__(self, names: list[str], counts: np.ndarray):
        """counts: [language, bucket]."""
        self.names = names
        share = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
        self.logs = (np.log(share) / len(ORDERS)).T.astype(np.float32)
        self.key = crc32(self.logs.tobytes() + repr(names).encode())

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        buckets, owner = ngrams(words)
        return np.add.reduceat(self.logs[buckets], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)


def _em(p: np.ndarray, lengths: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of documents and the log-likelihood, from likelihoods [word, language] of their words; none is empty."""
    owner, at, share = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths, start
    for _ in range(STEPS):
        r = p * share[owner]
        r /= r.sum(1, keepdims=True)
        new = np.add.reduceat(r, at) / lengths[:, None]
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, np.add.reduceat(np.log((p * share[owner]).sum(1)), at)


def mixtures(logs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [document, language], 0 outside a document's chosen set, and the scores of the largest ones."""
    n, k = len(lengths), logs.shape[1]
    top = logs.max(1, keepdims=True)
    bounded = np.maximum(logs - top, -FLOOR).astype(np.float64)
    p = np.exp(bounded)
    at, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths)
    alone = np.add.reduceat(bounded, at)
    full, best = _em(p, lengths, np.full((n, k), 1 / k))
    first = alone.argmax(1)
    share = np.zeros((n, k))
    share[np.arange(n), first] = 1
    order = np.argsort(-full, axis=1, kind="stable")
    # the first language stands in front, the others follow by proportion
    order = np.concatenate([first[:, None], order[order != first[:, None]].reshape(n, k - 1)], axis=1)
    reached, gain = alone[np.arange(n), first], PENALTY * np.log1p(lengths)
    active = np.flatnonzero(best - reached > gain)
    for m in range(2, k + 1):
        if not len(active):
            break
        own = np.concatenate([np.arange(at[i], ends[i]) for i in active])
        start = np.zeros((len(active), k))
        np.put_along_axis(start, order[active, :m], 1 / m, axis=1)
        new, likely = _em(p[own], lengths[active], start)
        better = likely - reached[active] > gain[active]
        active = active[better]
        share[active], reached[active] = new[better], likely[better]
    main = share.argmax(1)
    owner = np.repeat(np.arange(n), lengths)
    r = p * share[owner]
    given = r[np.arange(len(r)), main[owner]] / r.sum(1)
    evidence = np.add.reduceat(given[:, None] * bounded, at)
    evidence = np.exp(evidence - evidence.max(1, keepdims=True))
    return share, share[np.arange(n), main] * (evidence[np.arange(n), main] / evidence.sum(1))


def predict(texts: list[str], model: Languages, table: WordTable) -> list[dict]:
    """lang_pred, score and the chosen languages by falling share, for each text."""
    out = [{"lang_pred": UNKNOWN, "score": 0.0, "languages": []} for _ in texts]
    words = [units(x) for x in texts] if model.names else [[] for _ in texts]
    full = [k for k, w in enumerate(words) if w]
    if full:
        lengths = np.array([len(words[k]) for k in full], dtype=np.int64)
        share, score = mixtures(table.look_up([w for k in full for w in words[k]])[0], lengths)
        for k, s, x in zip(full, share, score, strict=True):
            held = [int(i) for i in np.argsort(-s, kind="stable") if s[i] > 0]
            out[k] = {"lang_pred": model.names[held[0]], "score": float(min(1.0, x)), "languages": [{"lang": model.names[i], "share": float(s[i])} for i in held]}
    return out


def learn(docs: DataFrame, rows: Column | None = None, lang: str = "lang", text: str = "text") -> Languages:
    """Counts the n-grams of all documents with a language where `rows` (a condition; all by default) holds."""
    known = docs.where(F.col(lang).isNotNull() if rows is None else F.col(lang).isNotNull() & rows)
    counted = known.select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text")).mapInArrow(_counted, "lang string, bucket int, n long")
    summed = stage(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    names = [r[0] for r in summed.select("lang").distinct().orderBy("lang").limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages")
    counts, place = np.zeros((len(names), BUCKETS)), {name: k for k, name in enumerate(names)}
    for name in names:  # BUCKETS rows at a time
        found = summed.where(F.col("lang") == name).select("bucket", "n").toArrow()
        counts[place[name], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Languages(names, counts)


FOUND = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """docs with the struct `lang_`: lang_pred, score, and the chosen languages with their shares."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB for each of at most MOST languages
    key = model.key

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        types = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
        for batch in batches:
            table = worker_cache(("languages", key), lambda: WordTable(len(held.value.names), held.value.likelihoods))
            parts = portions(iter([pa.RecordBatch.from_arrays([batch], ["text"])]), 0, 2 << 20)
            yield pa.concat_arrays([pa.array([], types), *(pa.array(predict(x.column(0).to_pylist(), held.value, table), types) for x in parts)])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("lang_", run(F.when(letters, F.col(text)).otherwise(F.lit(""))))


def op11_language_mixture(spark, sf_dir: str) -> DataFrame:
    fold = fold_of("doc_id", 4)
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"), fold != 2)
    found = identify(docs.select(F.col("doc_id").cast("long"), "text"), model)
    shares = F.array_join(F.transform("lang_.languages", lambda x: F.concat(x["lang"], F.lit(":"), F.round(x["share"], 6).cast("string"))), ",")
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_.lang_pred", "lang_.score", shares.alias("languages"))
