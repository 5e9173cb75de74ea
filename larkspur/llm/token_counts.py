"""Exact length histogram of encoded documents.

Documents are encoded once; what is kept is the number of documents of each encoded length. All
questions about context limits are then answered from that histogram: suffix sums give the
documents and tokens at or above a length, prefix and suffix sums together give the tokens that
remain when every document is cut at a limit, and the running share of documents gives quantiles.

The histogram has a row for each distinct length, which the longest document bounds and not the
number of documents. The running sums are taken in two levels (blocks of lengths, then lengths
inside a block), so no single task orders all lengths.

Null and empty texts have length 0. Repeated rows count each time. An empty table gives an empty
histogram. Special-token strings in a text are ordinary text. Further columns have no effect.
"""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Lengths of one block of the two-level sums.
BLOCK = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE encoder whose ranks are in the file ``path``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def length_histogram(
    docs: DataFrame, tokenizer_path: str | None = None, text_col: str = "text"
) -> DataFrame:
    """``n_tokens, n_docs`` (long): how many documents have each encoded length."""
    path = tokenizer_path or default_tokenizer()

    def count(batches):
        encode = encoder(path).encode_ordinary
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[len(encode(text)) if text else 0] += 1
        lengths = sorted(seen)
        yield pa.RecordBatch.from_pydict(
            {
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_docs": pa.array([seen[x] for x in lengths], pa.int64()),
            }
        )

    part = map_arrow(docs.select(F.col(text_col).alias("text")), count, "n_tokens long, n_docs long")
    # Whoever asks the histogram several questions reads it, and doesn't encode again.
    return stored(part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    ``docs_below, tokens_below``: documents shorter than it, and their tokens;
    ``docs_from, tokens_from``: documents of at least that length, and their tokens;
    ``total_docs, total_tokens``: of all documents;
    ``truncated_tokens``: what remains if every document is cut at the limit;
    ``rank_low, rank_high``: the share of documents below, and at most, that length.
    """
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "block", F.floor(F.col("n_tokens") / block)
    )
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # One row for each 1024 lengths: a document of 100 million tokens makes 100,000 of these.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    blocks = blocks.select(
        "block",
        zero(F.sum("bd").over(before)).alias("bd_before"),
        zero(F.sum("bt").over(before)).alias("bt_before"),
        F.sum("bd").over(every).alias("total_docs"),
        F.sum("bt").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("bd_before") + zero(F.sum("n_docs").over(inside))).alias("docs_below"),
        (F.col("bt_before") + zero(F.sum("tokens").over(inside))).alias("tokens_below"),
        "total_docs",
        "total_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_below",
        "tokens_below",
        (F.col("total_docs") - F.col("docs_below")).alias("docs_from"),
        (F.col("total_tokens") - F.col("tokens_below")).alias("tokens_from"),
        "total_docs",
        "total_tokens",
        (
            F.col("tokens_below") + F.col("n_tokens") * (F.col("total_docs") - F.col("docs_below"))
        ).alias("truncated_tokens"),
        (F.col("docs_below") / F.col("total_docs")).alias("rank_low"),
        ((F.col("docs_below") + F.col("n_docs")) / F.col("total_docs")).alias("rank_high"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, ``truncated_tokens``: the tokens left when documents are cut at ``limit``."""
    cut = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return sums.agg(F.coalesce(F.sum(cut), F.lit(0)).cast("long").alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least that share of documents doesn't exceed."""
    asked = sums.select(
        "n_tokens", "rank_low", "rank_high", F.explode(F.array(*map(F.lit, shares))).alias("share")
    )
    met = asked.filter(F.col("rank_high") >= F.col("share"))
    return met.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
