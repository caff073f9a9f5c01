"""The training-data operators against brute force, round trips and held-out accuracy, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import components, embedding_dedup, language_model, packing, pii, quality_classifier, quality_rules, sentencepiece_codec, simhash, toxicity, warc
from strataspark.llm.common import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOWELS = ["ab", "er", "in", "on", "th", "st", "ing", "es", "ou"]


def prose(rng, n):
    return " ".join("".join(rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    out += [None, "", " \n\t ", "a", "A b", out[3], out[3], "x y z " * 3000, "\n".join(["same line here"] * 5), "é ñ Ü 😀 the don't stop <|endoftext|> it's  two", "a\x1cb\xa0c", "▁literal ▁▁ marks"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# --- packing


def test_pieces_equal_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pieces(docs, max_tokens=64).collect()}
    expected = {}
    for i, t in enumerate(texts()):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            expected[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert got == expected


@pytest.mark.parametrize("per_partition", [20, 10_000])
def test_packing_is_gapless_and_whole(docs, per_partition):
    cut = stage(packing.pieces(docs, max_tokens=256), "cut")
    rows = packing.pack(cut, 256, per_partition).collect()
    assert Counter((r.doc_id, r.piece) for r in rows) == Counter((r.doc_id, r.piece) for r in cut.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 256) + 2


def test_copies_are_dealt_like_others(spark):
    same = [(1, 0, 0, 10, 5)] * 3000 + [(k, 0, 0, 10, 5) for k in range(2, 3002)]
    cut = stage(spark.createDataFrame(same, packing.PIECES).repartition(5), "same")
    sizes = [r["count"] for r in packing.dealt(cut, 60, 1).groupBy("group").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 160 and min(sizes) > 50


def test_open_gaps_are_reported(spark):
    rng = random.Random(3)
    sizes = [rng.randint(26, 51) for _ in range(900)]
    cut = stage(spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES).repartition(3), "cut")
    rows = packing.pack(cut, 100, 60, rounds=1).collect()
    groups = {}
    for r in rows:  # the group stands in the sequence's number
        groups.setdefault((-(r.sequence_id + 1)) >> 29, []).append(r)
    assert len(groups) == 15
    for own in groups.values():
        used = len({r.sequence_id for r in own})
        assert {r.gap for r in own} == {used - packing.lower_bound(np.array([r.length for r in own]), 100)}
    assert any(r.gap > 0 for r in rows)
    better = packing.pack(cut, 100, 60).collect()
    assert len({r.sequence_id for r in better}) <= len({r.sequence_id for r in rows})


def test_packing_nothing(empty):
    assert packing.pack(stage(packing.pieces(empty), "none")).count() == 0


def test_lower_bound_never_passes_the_best_packing():
    rng = np.random.default_rng(5)

    def best(sizes, capacity):
        top = [len(sizes)]

        def go(k, bins):
            if len(bins) >= top[0]:
                return
            if k == len(sizes):
                top[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[k] <= capacity:
                    go(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
            go(k + 1, [*bins, sizes[k]])

        go(0, [])
        return top[0]

    for _ in range(60):
        sizes = np.sort(rng.integers(1, 13, rng.integers(1, 8)))[::-1]
        found = best(sizes.tolist(), 12)
        assert packing.lower_bound(sizes, 12) <= found <= len(set(packing.best_fit_decreasing(sizes, 12)))
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3  # the plain sum gives two


# --- embeddings


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [*base, *(base[3] + rng.normal(0, 0.02, (30, 16))), base[5], base[5] * 3]
    vectors = [(i, v.tolist()) for i, v in enumerate(rows)]
    odd = [(100, None), (101, []), (102, [0.0] * 16), (103, [None] * 16), (104, [float("nan")] * 16), (105, [1.0, 2.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")).collect()}
    x = np.stack(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    root = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(link[i]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    for i in range(len(x)):
        assert got[i] == (int(link[i].sum()) - 1, root[i], root[i] == i)
    for i, _ in odd:
        assert got[i] == (0, i, True)


def test_large_bucket_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(4)
    v = rng.normal(size=12)
    df = spark.createDataFrame([(i, (v + rng.normal(0, 0.01, 12)).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == {(49, 0)}


def test_embeddings_with_missing_and_repeated_ids(spark):
    a, b, far = [0.0, 1.0], [0.01, 0.99], [1.0, 0.0]
    rows = [(1, a), (1, b), (2, a), (None, b), (7, far), (None, far), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("own"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (7, 1, 7, True), (None, 1, 7, False), (None, 0, None, False)], key=str)


# --- language model


def test_language_model_equals_brute_force(spark, docs):
    low = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]
    train = [low(t) for i, t in enumerate(texts()) if i % 4]
    model = language_model.learn(docs.where("doc_id % 4 <> 0"))
    c1, c2 = Counter(), Counter()
    for w in train:
        c1.update(w)
        c2.update(zip(["<s>", *w], w, strict=False))
    n, kinds = sum(c1.values()), len(c1)
    assert (model.tokens, model.kinds, model.pairs, model.texts) == (n, kinds, len(c2), len(train))
    before, total, follow = Counter(v for _, v in c2), Counter(), {}
    for (u, _), c in c2.items():
        total[u] += c
        follow.setdefault(u, Counter())[min(c, 3)] += 1
    d = language_model.discounts(*(sum(c == k for c in c2.values()) for k in (1, 2, 3, 4)))
    e = language_model.discounts(*(sum(c == k for c in before.values()) for k in (1, 2, 3, 4)))
    less = lambda c, x: c - x[min(c, 3) - 1] if c else 0
    spare = sum(c - less(c, e) for c in before.values()) / len(c2)
    for r in language_model.score(docs, model).collect():
        w = low(texts()[r.doc_id])
        score = 0.0
        for u, v in zip(["<s>", *w], w, strict=False):
            p1 = less(before[v], e) / len(c2) + spare / (kinds + 1)
            score += math.log10(less(c2[u, v], d) / total[u] + sum(d[k - 1] * m for k, m in follow[u].items()) / total[u] * p1 if total[u] else p1)
        base = sum(math.log10((c1[v] + 0.5) / (n + 0.5 * (kinds + 1))) for v in w)
        assert (r.n_tokens, r.n_known) == (len(w), sum(c1[v] > 0 for v in w))
        assert (r.score, r.base_score) == pytest.approx((score, base), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "a b a c"), (1, "b a"), (2, None)], "doc_id long, text string")
    model = language_model.learn(docs)
    words = [b"a", b"b", b"c", language_model._END]
    for u in (language_model._START, *words[:3]):
        p = [10 ** float(model.score([[u, w]])[3][0]) if u == language_model._START else 10 ** float(model.score([[language_model._START, u, w]])[3][0] - model.score([[language_model._START, u]])[3][0]) for w in words]
        unknown = 10 ** float(model.score([[u, b"?"]])[3][0]) if u == language_model._START else 10 ** float(model.score([[language_model._START, u, b"?"]])[3][0] - model.score([[language_model._START, u]])[3][0])
        assert sum(p) + unknown == pytest.approx(1, abs=1e-9)


def test_marks_of_a_text_are_no_words(spark):
    """A text that spells a mark out counts it as words of its own."""
    docs = spark.createDataFrame([(0, "a b"), (1, "x" + language_model._END.decode() + " y"), (2, "\x00end end start")], "doc_id long, text string")
    model = language_model.learn(docs)
    assert (model.texts, model.tokens, model.kinds) == (3, 2 + 3 + 3 + 3, 8)


def test_language_model_without_training(empty, docs):
    model = language_model.learn(empty)
    assert {r.score for r in language_model.score(docs, model).collect()} == {0.0}


# --- personal data


def base_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        g = re.sub("[^0-9]", "", m[0])
        if 14 <= len(g) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(g[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def personal_texts():
    rng = random.Random(7)
    parts = ["a@b.co", "1.2.3.4", "300.1.1.1", ".", "5", "+1", "-", " ", "@", "%", "x.y", "(", ")", "4111 1111 1111 1111", "+1 (555) 555-5555", "é", "\n", "😀", "foo [at] bar [dot] com"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "a" * 50_000, "1 " * 2000]


def test_base_spans_equal_brute_force(spark):
    all_texts = personal_texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    found = stage(pii.with_spans(df).drop("text"), "pii")
    redactor = pii.fit(found)
    got = pii.with_redactions(found, redactor).select("doc_id", pii.written("base_").alias("base"), pii.written("spans_").alias("spans")).collect()
    for r in got:
        assert r.base == base_spans(all_texts[r.doc_id] or "")
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_redaction_keeps_columns_and_clean_text(spark):
    df = spark.createDataFrame([(1, "mail é me@x.org now", 19, "k"), (2, "nothing here", 12, "k"), (3, None, None, None)], "doc_id long, text string, n_chars long, base string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert (got[1].text, got[1].n_chars) == ("mail é [EMAIL] now", 18)
    assert got[2].text == "nothing here" and got[3].text is None and got[3].n_chars is None
    assert pii.redact(df).columns == df.columns
    assert pii.redact(df.where("false")).count() == 0


def test_main_path_has_no_python(docs):
    plan = pii.with_redactions(pii.with_spans(docs), pii.Redactor(None, {}, {}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_planted_forms_beyond_the_base_are_redacted(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(3))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))

    def card():
        d = digits(15)
        total = sum(int(c) if i % 2 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1]))
        return d + str(-total % 10)

    fours = lambda d, c: c.join(d[i : i + 4] for i in range(0, 16, 4))
    ip = lambda c: c.join(str(rng.randint(1, 255)) for _ in range(4))
    plain = lambda: (f"{word()}@{word()}.org", ip("."), fours(card(), " "), f"+{digits(2)} {digits(3)} {digits(7)}")
    rows = [" ".join([word(), x, word(), word()]) for _ in range(60) for x in (*plain(), f"{digits(3)} {word()} 2024-03-{rng.randint(10, 28)}", "999.1.2.3", fours("1" * 15 + "2", " "))]
    planted = [
        ("email", f"{word()} [at] {word()} [dot] org"),
        ("email", f"{word()}(at){word()}.org"),
        ("ip", ip("-")),
        ("ip", ip(":")),
        ("card", fours(card(), "/")),
        ("card", fours(card(), "_")),
        ("phone", f"{digits(2)} {digits(3)} {digits(7)}"),
        ("phone", f"00{digits(2)} {digits(3)} {digits(7)}"),
    ]
    clean = ["on 2024-03-11 it was", "about 999:1:2:3 of", "number " + fours("1" * 15 + "2", "/") + " fails"]
    texts_ = rows + [f"so {x} is" for _, x in planted] + clean
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()}
    at = len(rows)
    assert [got[at + i] for i in range(len(planted))] == [f"so [{k.upper()}] is" for k, _ in planted]
    assert [got[at + len(planted) + i] for i in range(len(clean))] == clean


# --- SimHash


def brute_fingerprint(t):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force(docs):
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts())}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_components(points, distance):
    root = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= distance and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return dict(enumerate(root))


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize(("distance", "shard", "sub_block", "sample"), [(0, 8, 5, 20), (1, 8, 1000, 200), (2, 8, 5, 20), (2, 4, 1000, 0), (2, 1000, 1000, 100), (3, 8, 7, 50), (4, 8, 1000, 50)])
def test_components_equal_brute_force(spark, monkeypatch, distance, shard, sub_block, sample):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda points, d: links(points, d, shard, sub_block, sample))
    rng = random.Random(9)
    points = [rng.getrandbits(64) for _ in range(40)]
    points += [flipped(rng, points[0], rng.randint(0, 3)) for _ in range(60)]  # a hot shard
    for _ in range(120):  # chains of near copies
        points.append(flipped(rng, rng.choice(points), rng.randint(0, 4)))
    prints = stage(spark.createDataFrame([(i, signed(x)) for i, x in enumerate(points)], "doc_id long, fp long"), "p")
    got = {r.doc_id: r.component_id for r in simhash.classes(prints, distance).collect()}
    assert got == brute_components(points, distance)


def test_each_visit_that_the_bound_leaves_open_is_made():
    rng = random.Random(4)
    points = [rng.getrandbits(64) for _ in range(300)]
    points += [flipped(rng, x, 2) for x in points]
    x = np.array(points, np.uint64)
    shard, at, visits = simhash.Tree(x[:100], 6).shards(x, 2)
    met = {}
    for s, i, v in zip(shard.tolist(), at.tolist(), visits.tolist(), strict=True):
        met.setdefault(i, {})[s] = v
    assert all(sum(not v for v in m.values()) == 1 for m in met.values())  # one shard owns a point
    for i in range(300):
        one, two = met[i], met[i + 300]
        assert sum(not (one[s] and two[s]) for s in one.keys() & two.keys()) == 1  # a pair meets once


def test_one_document_of_each_component_stays(spark):
    same, other = "a b c d e f g", "h i j k l m n"
    rows = [(None, same), (3, same), (1, same), (1, same), (None, other), (None, other), (5, None), (6, "")]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "d")
    got = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, same), (1, same), (None, other), (5, None)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.v: r.root for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


# --- classifiers


def labelled(spark, seed=3, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 5 == 0, i % 3 == 0
        words = prose(rng, rng.randint(40, 120)).split()
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for w in ("grobian", "lumpig", "grobianer"):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    extra = [(n, None), (n + 1, ""), (n + 2, "word " * 30_000)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(3), spark.createDataFrame([*labels, (n, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    tagger = toxicity.learn(docs, labels, F.col("doc_id") % 4 != 2)
    rows = {r.doc_id: r for r in toxicity.tag(docs, tagger).select("doc_id", "text", "tox_.*").collect()}
    held = [r for i, r in rows.items() if i < 300 and i % 4 == 2]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    hit = next(r for r in held if r.doc_id % 5 == 0)
    assert {hit.text[s.start : s.end].lower()[:4] for s in hit.spans} <= {"grob", "lump"} and hit.spans
    assert all(0 <= rows[i].score < 0.3 for i in (300, 301, 302))


def test_marginals_equal_a_plain_chain():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = [1, 7, 2, 30]
    s = rng.normal(size=sum(lengths)) * 3
    first = np.zeros(len(s), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    expected, moves = [], []
    at = 0
    for n in lengths:
        own = s[at : at + n]
        at += n
        fore = [np.exp(b + own[0] * np.array([0, 1]))]
        for k in range(1, n):
            fore.append((fore[-1] @ np.exp(a)) * np.exp(own[k] * np.array([0, 1])))
        back = [np.ones(2)]
        for k in range(n - 1, 0, -1):
            back.append(np.exp(a) @ (np.exp(own[k] * np.array([0, 1])) * back[-1]))
        for f, g in zip(fore, back[::-1], strict=True):
            expected.append(f[1] * g[1] / (f * g).sum())
        back = back[::-1]
        moves.append(np.zeros(4))
        for k in range(1, n):
            both = np.outer(fore[k - 1], np.exp(own[k] * np.array([0, 1])) * back[k]) * np.exp(a)
            moves.append((both / both.sum()).ravel())
    assert toxicity.marginals(s, first, a, b) == pytest.approx(np.array(expected), abs=1e-9)
    assert toxicity._forward_backward(s, first, a, b, pairs=True)[1] == pytest.approx(np.array(moves).T, abs=1e-9)


def test_classifier_scores_equal_brute_force(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.train(*quality_classifier.labelled_sample(docs, labels, "quality", F.lit(True), 100)[:2], epochs=1)
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, model).collect()}
    tagger = toxicity.learn(docs, labels)
    tagged = {r.doc_id: r.score for r in toxicity.tag(docs, tagger).select("doc_id", "tox_.score").collect()}
    for r in docs.where("doc_id < 40 or doc_id >= 300").collect():
        words = (r.text or "").encode().split()
        total, size = 0.0, 0
        for k, w in enumerate(words):
            feats = quality_classifier.word_features(w) + ([0] * quality_classifier.REPEAT if k and words[k - 1] == w else [])
            total, size = total + sum(float(model.weights[f]) for f in feats), size + len(feats)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(model.bias + total / max(size, 1)))), abs=1e-4)
        s = np.array([sum(tagger.weights[f] for f in toxicity.word_features(w)) for w in words])
        p = toxicity.marginals(s, np.arange(len(s)) == 0, tagger.a, tagger.b) if words else np.zeros(1)
        assert tagged[r.doc_id] == pytest.approx(float(tagger.score(np.array([p[p >= 0.5].sum()]), np.array([p.max()]))[0]), abs=1e-4)


def test_sample_is_bounded_and_takes_whole_texts(spark):
    docs, labels = labelled(spark)
    rows, y, totals = quality_classifier.labelled_sample(docs, labels, "quality", F.lit(True), 20)
    assert len(rows) == 40 and y.tolist().count(1) == 20 and totals.tolist() == [100, 200]
    whole = {r.text for r in docs.collect()}
    few = quality_classifier.labelled_sample(docs, labels, "quality", F.lit(True), 20, most_chars=3000)[0]
    assert set(few) <= set(rows) <= whole and 1000 < sum(map(len, few)) <= 3000


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, n=20)
    none = labels.where("false")
    assert toxicity.tag(docs, toxicity.learn(docs, none)).where("tox_.score between 0 and 1").count() == 23
    model = quality_classifier.train(*quality_classifier.labelled_sample(docs, none, "quality", F.lit(True), 10, 1000)[:2])
    assert {r.score for r in quality_classifier.classify(docs, model).collect()} == {0.5}
    assert quality_classifier.classify(docs.where("false"), model).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.train(*quality_classifier.labelled_sample(docs, labels, "quality", F.col("doc_id") % 5 != 0, 500)[:2])
    held = [r for r in quality_classifier.classify(docs, model).collect() if r.doc_id < 300 and r.doc_id % 5 == 0]
    assert np.mean([(r.score >= 0.3) == bool(r.doc_id % 3) for r in held]) > 0.97


# --- SentencePiece


def test_codec_equals_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    for r in sentencepiece_codec.code(docs).collect():
        ids = sp.encode(texts()[r.doc_id] or "")
        assert (r.ids, r.n_tokens, r.decoded) == (",".join(map(str, ids)), len(ids), sp.decode(ids))
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in sentencepiece_codec.code(docs, digests=True).collect():
        ids = sp.encode(texts()[r.doc_id] or "")
        assert (r.ids_sha256, r.decoded_sha256) == (hexed(",".join(map(str, ids))), hexed(sp.decode(ids)))


# --- archives


def test_archive_round_trip(spark):
    html = [None, "", "x" * 20_000, "é\r\n0\r\n\r\n", "x" * 20_000, "plain", "plain"]
    pages = spark.createDataFrame([(i, f"http://x/{i}" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.read(warc.write(pages, segment_bytes=1000), payloads=True).collect()}
    first = {}
    for i, h in enumerate(html):
        data = (h or "").encode()
        origin = first.setdefault(data, i)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if origin == i else ("revisit", origin))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), warc.base32_sha1(data))
        assert got[i].payload is None if origin != i else bytes(got[i].payload) == data
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_missing_segment_stops_the_job(spark):
    pages = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    raw = stage(warc.read_records(warc.write(pages, segment_bytes=1000)), "raw")
    assert warc.assembled(raw).count() == 1
    with pytest.raises(Exception, match="segments missing"):
        warc.assembled(raw.where("segment is null or segment <> 3")).collect()


def test_archives_with_missing_and_repeated_ids(spark):
    long = "z" * 5000
    rows = [(None, long), (4, long), (4, long), (7, long), (None, "alone"), (None, "twice"), (None, "twice"), (9, "own")]
    pages = spark.createDataFrame([(i, "http://x/\r\n y", h) for i, h in rows], "page_id long, url string, html string").repartition(2)
    ranges = warc.write(pages, segment_bytes=1000, range_bytes=1)
    assert ranges.count() >= len(rows) - 2
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(ranges).collect())
    assert got == Counter([(None, 5000, "revisit", 4), (4, 5000, "response", None), (4, 5000, "response", None), (7, 5000, "revisit", 4), (None, 5, "response", None), (None, 5, "response", None), (None, 5, "response", None), (9, 3, "response", None)])


def test_chunked_framing():
    for body in (b"", b"a", b"0\r\n\r\n" * 5000):
        assert warc.unchunked(warc.chunked(body, 7)) == body
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# --- quality rules


def test_counts_equal_brute_force(docs):
    got = {r.doc_id: r.quality_ for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts()):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert q.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (q.base_failed and q.kept)


def test_estimate_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.abs(rng.normal([1.5, 0.1, 0.1, 0.2], [0.2, 0.1, 0.1, 0.1], (300, 4)))
    x[:40, 1] += 4
    df = stage(spark.createDataFrame([("g", *map(float, r)) for r in x], "g_ string, " + ", ".join(f"{c} double" for c in quality_rules.X)), "x")
    got = quality_rules.estimate(df).first()
    tolerance = np.diag([v**2 for v in quality_rules.TOLERANCE.values()])
    q = np.percentile(np.floor(x * 100 + 0.5) / 100, [25, 50, 75], axis=0)
    center, scatter = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + tolerance
    far = lambda: np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
    for _ in range(quality_rules.STEPS):
        binned = np.round(np.clip(np.log(far() + 1e-3), -7, 20), 1)
        near = x[binned <= np.sort(binned)[int(np.ceil(0.75 * len(x))) - 1]]
        center, scatter = near.mean(0), quality_rules.FACTOR_NEAREST * np.cov(near.T, bias=True) + tolerance
    near = x[far() <= quality_rules.REWEIGHT_AT]
    center, scatter = near.mean(0), quality_rules.FACTOR_REWEIGHTED * np.cov(near.T, bias=True) + tolerance
    assert [got[f"m_{c}"] for c in quality_rules.X] == pytest.approx(center.tolist(), abs=1e-9)
    assert [[got[f"c_{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)] == [pytest.approx(r, abs=1e-9) for r in scatter.tolist()]


def test_planted_junk_is_rejected_in_clean_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 7)))
    clean = lambda n: [word() for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10))
    rows = [("clean", lines(clean(rng.randint(80, 200)))) for _ in range(120)]
    rows += [("clean", lines(clean(100) + (w := clean(10)) + clean(10) + w)) for _ in range(3)]
    rows += [("repeats", " ".join(clean(55) + (w := clean(15)) * 3)) for _ in range(5)]
    rows += [("symbols", " ".join(clean(70) + ["#"] * 5 + clean(30)).replace(" # # # # #", "".join(f" {word()}#" for _ in range(30)))) for _ in range(5)]
    rows = [(i, k, t) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame([(i, t, "en", "web") for i, k, t in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).select("doc_id", "quality_.kept").collect()}
    share = {k: sum(kept[i] for i, x, _ in rows if x == k) / sum(x == k for _, x, _ in rows) for k in ("clean", "repeats", "symbols")}
    assert share["clean"] >= 0.97 and share["repeats"] == share["symbols"] == 0, share


def test_quality_of_nothing(empty):
    assert quality_rules.judge(empty).count() == 0 and quality_rules.judge(empty, keep_text=True).count() == 0


# --- pipeline


def test_pipeline_stages_keep_the_columns(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, data), name)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and (name != "pii" or ids == before)
        before = ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before


def test_pipeline_equals_its_operators_and_brute_force(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts_ = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    (_, quality), (_, toxic), (_, dedup), (_, redact), (_, packed) = corpus_pipeline.STAGES
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    one = stage(quality(spark, docs, data), "one")
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs).select("doc_id", "quality_.kept").collect()}
    assert ids(one) == {i for i, kept in verdict.items() if kept}

    two = stage(toxic(spark, one, data), "two")
    tagger = toxicity.learn(one, spark.read.parquet(f"{data}/labels.parquet"))
    scores = {}
    for r in one.collect():
        words = (r.text or "").encode().split()
        p = toxicity.marginals(np.array([sum(tagger.weights[f] for f in toxicity.word_features(w)) for w in words]), np.arange(len(words)) == 0, tagger.a, tagger.b)
        scores[r.doc_id] = float(tagger.score(np.array([p[p >= 0.5].sum()]), np.array([p.max()]))[0])
    near = {i for i, s in scores.items() if abs(s - corpus_pipeline.TOXIC_AT) < 1e-3}
    assert ids(two) - near == {i for i, s in scores.items() if s < corpus_pipeline.TOXIC_AT} - near

    three = stage(dedup(spark, two, data), "three")
    order = sorted(ids(two))
    root = brute_components([brute_fingerprint(texts_[i]) for i in order], simhash.MAX_DISTANCE)
    assert ids(three) == {order[k] for k, r in root.items() if k == r}

    four = stage(redact(spark, three, data), "four")
    assert ids(four) == ids(three)
    for r in four.collect():
        assert base_spans(r.text or "") == ""
        if not base_spans(texts_[r.doc_id] or "") and "[" not in r.text:
            assert r.text == texts_[r.doc_id]

    five = packed(spark, four, data).collect()
    assert {r.doc_id for r in five} == ids(four)
    used = Counter()
    for r in five:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) == packing.lower_bound(np.array([r.length for r in five]), 2048)
