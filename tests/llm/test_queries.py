"""Each registered query of the subpackage on odd tables: nulls, empty and long texts, repeats, ties, clashing columns."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from strataspark.functions.shared import shared_dir
from strataspark.llm import queries

from test_llm import prose

#: Columns that each query's contract names, with their types.
CONTRACT = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op11_language_mixture": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_pivot_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}
SOURCE = {"op2_embedding_near_dedup": "embeddings", "op13_pivot_clustering": "embeddings", "op9_warc": "pages"}
CLASH = ("t_", "g_", "w_", "h_", "x_length", "counts_", "base_", "fp", "key", "in0", "segment", "digest", "y_", "n")


def odd_tables(spark, rows=None):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(24)]
    texts += [None, "", " \n\t", texts[0], texts[0], texts[1], "long word " * 30_000, "x" * 60_000, "mail a@b.co 1.2.3.4"]
    docs = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    docs += [(None, texts[2], None, None, None), (None, None, "en", "s", 0), (3, texts[3], "en", "s", 9), (3, texts[4], "en", "s", 9)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(24)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None)]
    vectors = [(i, [((7 * i + j) % 11) / 7 - 0.5 for j in range(64)], i % 3 if i % 5 else None) for i in range(90, 130)]
    vectors += [(i, v, i and i % 2) for i, v in [(i, [float(i % 3), 1.0, 0.5]) for i in range(6)] + [(1, [0.0, 1.0, 0.5]), (None, [1.0, 1.0, 0.5]), (9, None), (10, []), (11, [None, 1.0, 1.0]), (12, [0.0, 0.0, 0.0])]]
    pages = [(i, "u", t) for i, t in enumerate(texts[-9:])] + [(None, None, "p"), (None, "u", "p"), (2, "u", "q"), (2, "u", "q")]
    folder = f"{shared_dir(spark)}/odd-{uuid.uuid4().hex}"
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
        ("pages", pages, "page_id long, url string, html string"),
    ):
        df = spark.createDataFrame(data if rows is None else data[:rows], schema)
        df.withColumns({c: F.lit("own") for c in CLASH if c not in df.columns}).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark):
    return odd_tables(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return odd_tables(spark, 0)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_odd_tables(spark, odd, name):
    table = SOURCE.get(name, "documents")
    kept = {"op13_pivot_clustering": "size(embedding) = 64"}.get(name, "true")
    ident = {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
    found = queries.QUERIES[name](spark, odd)
    types = dict(found.dtypes)
    assert {c: types.get(c) for c, _ in (x.split() for x in CONTRACT[name].split(", "))} == dict(x.split() for x in CONTRACT[name].split(", "))
    if name == "op12_hard_negatives":
        assert {r[0] for r in found.select("anchor_id").collect()} <= {r[0] for r in spark.read.parquet(f"{odd}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
        return
    got = sorted((r[0] for r in found.select(ident).collect()), key=str)
    ids = sorted((r[0] for r in spark.read.parquet(f"{odd}/{table}.parquet").where(kept).select(ident).collect()), key=str)
    assert got == ids if name != "op1_best_fit_packing" else set(got) == set(ids)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0
