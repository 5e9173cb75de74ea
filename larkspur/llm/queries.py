"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    chat,
    chunk_dedup,
    decontaminate,
    lattice_lm,
    line_rules,
    secrets,
    simhash,
    token_counts,
    toxicity,
)
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(
        token_counts.length_histogram(table(spark, sf_dir, "documents"))
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.with_listed_mask(chat.rotate(table(spark, sf_dir, "conversations")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(spark, table(spark, sf_dir, "documents"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(documents, benchmark)


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_runs(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_chat": op2_chat,
        "op3_secrets": op3_secrets,
        "op4_line_rules": op4_line_rules,
        "op5_decontaminate": op5_decontaminate,
        "op6_lattice_lm": op6_lattice_lm,
        "op7_bpe": op7_bpe,
        "op8_chunk_dedup": op8_chunk_dedup,
        "op9_simhash": op9_simhash,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.ORACLE_SQL, "op4_line_rules": line_rules.ORACLE_SQL}
