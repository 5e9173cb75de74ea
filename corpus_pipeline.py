"""A pipeline over ``documents``: each stage works on the rows that its predecessor kept.

Toxic documents go; one document of each group of near-duplicates stays; documents that hold
benchmark items go; secrets are redacted; what remains is encoded. All stages but the last return
the columns of ``documents``. Each stage's rows are written to the shared folder and read again,
so a later failure doesn't repeat earlier stages and no lineage builds up.

Null texts stay null (and encode as empty), empty tables pass through, and further columns of the
input are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, decontaminate, secrets, simhash, toxicity
from larkspur.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects; it learns from the labelled ones."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id: candidates by SimHash
    and, for what they don't connect, by first shingles; verified by their 5-word shingles."""
    return simhash.keep_one_copy(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, re-parameterised or not."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secrets.redact(docs, secrets.corpus_model(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document."""
    return bpe.encode_documents(docs, decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: Trained models, components and encoding have no SQL form; the tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
