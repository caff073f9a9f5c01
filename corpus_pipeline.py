"""From documents to training sequences: five stages, each one operator of strataspark.llm.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all but the
last return the columns of documents. Texts are not shuffled: verdicts are expressions over a row, or an
anti join with the few ids that go. Rows that repeat an id are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import packing, pii, quality_rules, simhash, toxicity
from strataspark.llm.common import read_table, stage

#: A document goes from this toxicity on.
TOXIC_AT = 0.3


def reject_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judge(docs, keep_text=True).where("quality_.kept").select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tagger = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, tagger, spans=False).where(F.col("tox_.score") < TOXIC_AT).select(*docs.columns)


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(stage(packing.pieces(docs), "pieces"))


STAGES = [
    ("quality_rules", reject_outliers),
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", keep_first_of_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]

#: Outlier estimates, the trained field and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
