"""The corpus pipeline: documents in, packed training sequences out.

Quality first, then one of each group of near copies, then benchmark contamination, then secrets, then
packing. Each stage works on all that the one before kept and, but for the last, returns the columns of
documents. :func:`run` writes each stage's result to the shared folder and reads it back, so a lost
executor repeats a stage's tasks, not the pipeline.

What leaves: documents scored below the quality threshold (wordless ones score as the share of good labels), all but the least id of each
near-copy group, contaminated documents. Secrets are replaced in the text, and ``n_chars`` recounted.
NULL texts, empty tables and further columns pass through every stage, whatever the columns' names. Texts are
looked at whole, however long; rows repeated under one id stay or go together; of equally near copies the
least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewise.llm import decontaminate, jaccard, packing, quality, secrets
from gatewise.session import prepare, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels belong to the documents table; the model learns from it and judges ``docs``."""
    return quality.keep_good(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Near copies agree in this share, in percent, of their shingles of so many words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = NEAR_WIDTH, percent: int = NEAR_PERCENT) -> DataFrame:
    """The least id of each group of near copies."""
    prepare(spark)
    return jaccard.keep_one(docs, width, percent)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: A trained classifier, shingle hashes and a tokenizer are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
