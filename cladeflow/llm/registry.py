"""The queries of this subpackage's operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cladeflow.llm import bpe, chat, edits, fingerprints, jaccard, packing, pseudolm, quality, substrings, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolm.score(table(spark, sf_dir, "documents"))


def op4_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op8_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op10_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return {**own, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_fm_index_dedup": substrings.ORACLE_SQL,
        "op7_partenum_join": jaccard.ORACLE_SQL,
        "op9_prefix_target_chat": chat.ORACLE_SQL,
    }
