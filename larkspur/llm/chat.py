"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once: that speaker's turns are the
assistant's, everyone else's are a user's with the speaker's name, and system turns stay what they
are. The mask covers what a model is to learn: the text and end mark of the assistant's turns.

A dialogue is rendered in chunks of ``CHUNK_TURNS`` turn numbers, so a conversation of any length
is spread over many rows and tasks and no task gathers it; most conversations are a single chunk.
Chunks are in order by ``chunk``, and their texts, put together, are the rendered dialogue. Mask
positions are code points from the start of the chunk's text, ends exclusive.

Order: by turn number, then role, then text, so ties and repeated rows have a defined order and
all appear. Turns without a number come last, in chunk -1. A null or empty role is the speaker
``unknown``; null texts are empty. A conversation of system turns only has no participant and no
row; a null conv_id is a conversation of its own. Marks inside a text are not escaped. Further
columns have no effect. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers of one chunk.
CHUNK_TURNS = 64
#: Roles that instruct and don't take part.
SYSTEM_ROLES = ("system",)
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def rotate(
    conversations: DataFrame,
    chunk_turns: int = CHUNK_TURNS,
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
) -> DataFrame:
    """``conv_id, speaker, chunk, n_turns, n_own, text, mask``; ``mask`` is an array of
    (start, end) structs."""
    role = F.coalesce(F.when(F.length("role") > 0, F.col("role")), F.lit("unknown"))
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-1)).cast("long").alias("chunk"),
        F.struct(
            F.col("turn").isNull().alias("last"),
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("said")).alias("said"))
    # Speakers gather in two steps, first those of a chunk; texts don't move for that.
    own = F.array_except(
        F.array_distinct(F.transform("said", lambda x: x["role"])), F.array(*map(F.lit, system_roles))
    )
    speakers = chunks.select(F.col("conv_id").alias("of"), F.explode(own).alias("speaker")).distinct()
    both = chunks.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def header(x):
        named = F.concat(F.lit("user name="), x["role"])
        kind = F.when(x["role"].isin(*system_roles), x["role"]).when(
            x["role"] == F.col("speaker"), F.lit("assistant")
        )
        return F.concat(F.lit(BEGIN), F.coalesce(kind, named), F.lit("\n"))

    parts = F.transform(
        "said",
        lambda x: F.struct(
            header(x).alias("head"),
            F.concat(x["text"], F.lit(END)).alias("body"),
            (x["role"] == F.col("speaker")).alias("own"),
        ),
    )
    rendered = both.select("conv_id", "speaker", "chunk", parts.alias("parts"))
    spans = F.aggregate(
        "parts",
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,end:int>>").alias("mask"),
        ),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    acc["mask"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["head"])).alias("start"),
                            (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    return rendered.select(
        "conv_id",
        "speaker",
        "chunk",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda x: x["own"])).cast("long").alias("n_own"),
        F.concat_ws("", F.transform("parts", lambda x: F.concat(x["head"], x["body"]))).alias("text"),
        spans.alias("mask"),
    )


def with_listed_mask(rotated: DataFrame) -> DataFrame:
    """The same with ``mask`` as text: ``start:end`` spans, comma-joined."""
    spans = F.transform("mask", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return rotated.withColumn("mask", F.concat_ws(",", spans))


#: For DuckDB; the mask's positions are counted with window sums there.
ORACLE_SQL = """
WITH said AS (
  SELECT conv_id, coalesce(floor(turn / 64.0), -1)::BIGINT AS chunk, turn,
         CASE WHEN role IS NULL OR role = '' THEN 'unknown' ELSE role END AS role,
         coalesce(text, '') AS text
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'
), parts AS (
  SELECT s.conv_id, p.speaker, s.chunk, s.turn, s.role, s.text,
         '<|im_start|>' || CASE WHEN s.role = 'system' THEN 'system'
                                WHEN s.role = p.speaker THEN 'assistant'
                                ELSE 'user name=' || s.role END || chr(10) AS head,
         s.text || '<|im_end|>' || chr(10) AS body,
         s.role = p.speaker AS own
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (
      PARTITION BY conv_id, speaker, chunk ORDER BY turn NULLS LAST, role, text
      ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM parts
)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body, '' ORDER BY turn NULLS LAST, role, text) AS text,
       coalesce(string_agg(CASE WHEN own THEN (upto - length(body)) || ':' || upto END, ','
                           ORDER BY turn NULLS LAST, role, text), '') AS mask
FROM placed GROUP BY conv_id, speaker, chunk
"""
