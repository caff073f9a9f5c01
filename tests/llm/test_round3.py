"""Language mixtures, hard negatives and pivot clustering against brute force, SQL and held-out accuracy."""

import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import hard_negatives, language_mixture, pivot_clustering, queries

LETTERS = {"aa": ["tha", "er", "ing", "ou", "wh", "st"], "bb": ["sch", "ein", "ü", "ch", "zu", "ver"], "cc": ["ción", "ado", "ll", "ez", "os", "ra"]}


def text_in(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def vectors(seed, n, dim=64, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [[float(np.float32(x)) for x in (centres[i % 8] * spread + rng.normal(size=dim)) / dim**0.5] for i in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int, row string, length string, slots string"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names clash with working columns."""
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], VECTORS).repartition(3)


def odd_vectors():
    good = vectors(5, 240)
    rows = [(i, v, i % 4) for i, v in enumerate(good)]
    rows += [(100, good[7], 0), (700, good[8], 9), (700, good[9], 1), (None, good[10], 2), (None, good[10], 3)]  # repeats and null ids
    rows += [(300, None, 1), (400, [None, *good[0][1:]], 1), (500, [float("nan"), *good[0][1:]], 1), (600, [float("inf"), *good[0][1:]], 1), (800, good[11], None), (900, [], 1)]
    rows += [(1000, [1.0, 2.0], 1), (1001, [1.0, 1.5], 1), (1002, [1.0, 1.0], 2), (1003, [0.5, 0.5], 2)]  # of another length
    rows += [(1100, [0.0] * 64, 1), (1101, [0.0] * 64, 2), (1200, [-x for x in good[0]], 3)]  # zero vectors, negative scores
    rows += [(2000 + i, good[i % 3], 1 + i % 2) for i in range(40)]  # copies: ties
    return rows


def duck(df, sql):
    con = duckdb.connect()
    con.register("embeddings_", df.select("vec_id", "embedding", "label").toArrow())
    con.sql("create table embeddings as select * from embeddings_")
    return con.sql(sql)


# --- hard negatives


def brute_force_negatives(rows):
    kept = []
    for vec_id, e, label in rows:
        if label is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [int(np.floor(256 * x)) for x in e], label))
    out = []
    for k, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), i, own) for j, (i, b, own) in enumerate(kept) if j != k and len(b) == len(a)]
        scored.sort(key=lambda r: (-r[0], float("inf") if r[1] is None else r[1]))
        for p, positive, _ in [r for r in scored if r[2] == label][:5]:
            hard = [r for r in scored if r[2] != label and 30 * p <= 100 * r[0] <= 90 * p][:10]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i, _) in enumerate(hard, 1)]
    return out


def found_negatives(df, **options):
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, changed, **options).collect()]


@pytest.mark.parametrize("options", [{}, {"block": 40, "anchors_each": 3}])
def test_negatives_equal_brute_force(spark, options):
    rows = odd_vectors()
    assert sorted(found_negatives(table(spark, rows), **options), key=str) == sorted(brute_force_negatives(rows), key=str)


def test_negatives_equal_their_sql(spark):
    df = table(spark, odd_vectors())
    assert sorted(found_negatives(df), key=str) == sorted(duck(df, hard_negatives.ORACLE).fetchall(), key=str)


def test_no_feasible_row_is_pruned():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 12)) * rng.integers(1, 40, (500, 1))).astype(np.int64)
    x[0] = 0
    length = np.sqrt((x * x).sum(1).astype(float))
    by = np.argsort(-length)
    buckets = [(by[k : k + 50], hard_negatives.Bucket(x[by[k : k + 50]], length[by[k : k + 50]])) for k in range(0, 500, 50)]
    pruned = 0
    for a in [*x[:60], np.zeros(12, np.int64)]:
        size = float(np.sqrt(a @ a))
        focus = np.argsort(-np.abs(a), kind="stable")[:4]
        for low in (-500, -1, 0, 1, 50, 900, 5000, None):
            for rows, bucket in buckets:
                got = bucket.candidates(a, size, focus, low)
                must = set(np.flatnonzero(x[rows] @ a >= low)) if low is not None else set(range(50))
                assert got is None or must <= set(got.tolist())
                pruned += 0 if got is None else 50 - len(got)
    assert pruned > 20_000


def test_negatives_without_rows(spark):
    assert found_negatives(table(spark, odd_vectors()).where("false")) == []
    assert found_negatives(table(spark, [(1, [1.0], 1), (100, [1.0], None)])) == []
    assert found_negatives(table(spark, [(100, [1.0], 1)])) == []


def test_huge_components_do_not_overflow(spark):
    rows = [(0, [1e38, 1.0], 1), (1, [3e38, -1e38], 1), (2, [1e5, 0.0], 2), (100, [-3e38, 2.0], 2)]
    assert len(found_negatives(table(spark, rows))) >= 0


# --- clustering


def brute_force_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * x)) for x in e]) for i, e, _ in rows if e and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    named = sorted((sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    now = [x for _, x in named[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        near = [nearest(x)[1] for _, x in kept]
        for j in range(len(now)):
            own = [x for (_, x), c in zip(kept, near) if c == j]
            if own:
                now[j] = [sum(col) // len(own) for col in zip(*own)]
    final = [(i, *nearest(x)) for i, x in kept]
    total = sum(d for _, d, _ in final)
    return [(i, c, d, sum(e for _, e, b in final if b == c), total, sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, d, c in final]


def clusters(df):
    return [tuple(r) for r in pivot_clustering.cluster(df).drop("n_checked").collect()]


def test_clusters_equal_brute_force_and_sql(spark):
    rows = odd_vectors()
    df = table(spark, rows)
    got = sorted(clusters(df), key=str)
    assert got == sorted(brute_force_clusters(rows), key=str)
    assert got == sorted(duck(df, pivot_clustering.ORACLE).fetchall(), key=str)


def test_bounds_are_below_and_skip_centroids():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (16, 64))
    x = np.concatenate([centres[rng.integers(0, 16, 2000)] + rng.integers(-4, 5, (2000, 64)), centres, centres])
    bounds = pivot_clustering.Bounds(centres[rng.permutation(16)])
    moved = centres + rng.integers(-3, 4, centres.shape)
    exact = ((x[:, None, :] - moved[None]) ** 2).sum(2)
    low = bounds.below(bounds.cached(x), moved)
    assert (low <= exact).all()
    near, best, checked = bounds.assign(x, bounds.cached(x), moved)
    assert (near == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert checked.mean() < 4  # of 16


def test_ties_go_to_the_smaller_number():
    same = np.ones((3, 4), np.int64)
    near, best, _ = (b := pivot_clustering.Bounds(same)).assign(same, b.cached(same), same)
    assert near.tolist() == [0, 0, 0] and best.tolist() == [0, 0, 0]


def test_clusters_of_few_and_of_no_vectors(spark):
    assert clusters(table(spark, odd_vectors()).where("false")) == []
    rows = [(3, [0.5] * 64, 1), (3, [0.5] * 64, 1), (4, [1e30] * 64, 1)]
    got = clusters(table(spark, rows))
    assert sorted(got) == sorted(brute_force_clusters([*rows[:2], (4, [float(1 << 21)] * 64, 1)]))


# --- languages


def brute_force_mixture(logs, steps=2000):
    share = np.full(logs.shape[1], 1 / logs.shape[1])
    for _ in range(steps):
        r = np.exp(logs) * share
        share = (r / r.sum(1, keepdims=True)).mean(0)
    return share, np.log((np.exp(logs) * share).sum(1)).sum()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, text_in(rng, lang := "aabbcc"[2 * (i % 3) :][:2], rng.randint(1, 60)), lang) for i in range(400)]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 -- %%", "cc"), (403, "the", None), (404, None, None), (None, rows[0][1], "aa"), (7, rows[7][1], rows[7][2]), (405, "ver" * 40_000, "bb"), (406, "語" * 30_000, None)]
    rows += [(500 + i, text_in(rng, "aa", 40) + " " + text_in(rng, "cc", 25), None) for i in range(20)]
    schema = "doc_id long, text string, lang string, lang_ string, bucket string"
    return spark.createDataFrame([(*r, "own", "own") for r in rows], schema).repartition(3)


def test_ngrams_of_words():
    words = [b"ab", b"x", "ü".encode()]
    buckets, owner = language_mixture.ngrams(words)
    assert np.bincount(owner).tolist() == [3 + 2 + 1, 2 + 1 + 0, 3 + 2 + 1]
    again = [language_mixture.ngrams([w])[0] for w in words]
    assert sorted(buckets[owner == 0]) == sorted(again[0]) and sorted(buckets[owner == 2]) == sorted(again[2])


def test_counts_are_those_of_all_documents(spark, corpus):
    model = language_mixture.learn(corpus)
    assert model.names == ["aa", "bb", "cc"]
    counts = np.zeros((3, language_mixture.BUCKETS))
    for r in corpus.where("lang is not null").collect():
        for w in language_mixture.units(r["text"] or ""):
            np.add.at(counts[model.names.index(r["lang"])], language_mixture.ngrams([w])[0], 1)
    assert (language_mixture.Languages(model.names, counts).logs == model.logs).all()


def test_mixture_equals_a_plain_em(spark, corpus):
    model = language_mixture.learn(corpus)
    docs = [language_mixture.units(r["text"]) for r in corpus.where("doc_id between 380 and 399 or doc_id >= 500").orderBy("doc_id").collect()]
    logs = [model.likelihoods(d) for d in docs]
    share, score = language_mixture.mixtures(np.concatenate(logs), np.array([len(d) for d in docs]))
    for own, x in zip(share, logs):
        x = np.maximum(x - x.max(1, keepdims=True), -language_mixture.FLOOR).astype(float)
        best, reached, chosen = brute_force_mixture(x)[0], x.sum(0).max(), [int(x.sum(0).argmax())]
        for k in [k for k in np.argsort(-best) if k != chosen[0]]:
            new = brute_force_mixture(x[:, [*chosen, k]])[1]
            if new - reached <= language_mixture.PENALTY * np.log1p(len(x)):
                break
            chosen, reached = [*chosen, int(k)], new
        assert set(np.flatnonzero(own)) == set(chosen)
        expected = np.zeros(3)
        expected[chosen] = brute_force_mixture(x[:, chosen])[0]
        assert np.allclose(own, expected, atol=0.01)
    assert ((0 <= score) & (score <= 1)).all()


def test_identify_holds_out_and_mixes(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_language_mixture"](spark, str(tmp_path)).collect()
    assert len(got) == corpus.count()
    truth = {r["doc_id"]: r for r in corpus.collect() if r["doc_id"] is not None}
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    named = {r["doc_id"]: r for r in got}
    for i in (400, 401, 402, 404):
        assert (named[i]["lang_pred"], named[i]["score"]) == ("und", 0.0)
    assert named[405]["lang_pred"] == "bb" and named[406]["lang_pred"] in ("aa", "bb", "cc")
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.99 * len(held)
    mixed = [named[500 + i] for i in range(20)]
    assert all(r["lang_pred"] == "aa" and {x.split(":")[0] for x in r["languages"].split(",")} == {"aa", "cc"} and r["score"] < 0.8 for r in mixed)


def test_nothing_learned(spark, corpus):
    model = language_mixture.learn(corpus, F.lit(False))
    found = language_mixture.identify(corpus, model).select("lang_.*").distinct().collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)]
    assert language_mixture.identify(corpus.where("false"), model).count() == 0
