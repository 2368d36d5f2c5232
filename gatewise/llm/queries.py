"""Queries of the corpus operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewise.llm import (
    decontaminate, jaccard, lattice, merkle, negatives, packing, quality, repeats, ring, rules, secrets, sql, tokencount, toxicity,
)
from gatewise.session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_report(_table(spark, sf_dir, "documents"))


def op4_lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_report(_table(spark, sf_dir, "documents"))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(_table(spark, sf_dir, "documents"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_table(spark, sf_dir, "documents"))


def op13_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_ledger, op2_attention_quality, op3_viterbi_counts, op4_lattice_neighbours, op5_ring_shards, op6_suffix_repeats, op7_jaccard_join,
        op8_best_fit, op9_string_kernel, op10_prefix_windows, op11_isolation_rules, op12_octopus_manifest, op13_segment_negatives,
    )
}
#: The others hold a trained model, a tokenizer or a hash that SQL lacks; tests/llm compares them with plain versions.
SQL = {
    "op1_secret_ledger": sql.secret_ledger(),
    "op4_lattice_neighbours": sql.near_vectors(),
    "op6_suffix_repeats": sql.repeats(),
    "op7_jaccard_join": sql.jaccard(),
    "op10_prefix_windows": sql.contamination(),
    "op12_octopus_manifest": sql.manifest(),
    "op13_segment_negatives": sql.negatives(),
}
