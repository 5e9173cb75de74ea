"""Quality rules from counts inside a text and from line frequencies across documents, with
DataFrame functions only.

**Inside a text.** Words are runs of characters other than space and tab to carriage return. The
base rules count words, their characters, signs, lines that repeat an earlier line, and the words
in 5-word windows that occur twice or more; a text fails them with fewer than 10 words or over
20 % of its words in repeated windows.

**Across documents.** Lines are normalised (lower case, digit runs as 0, white space as single
spaces) and hashed. For each host the distinct documents with a line are counted, exact copies
counting as one document. A line is common where that number exceeds ``COMMON_DOCS``, whatever the
host's size, or, in a small host, ``FEW_DOCS`` and ``COMMON_SHARE`` of the host's distinct
documents; common lines are removed, and a document is
depleted if fewer than 10 words remain or over ``DEPLETED`` of its words went. A document is kept
if it passes the base rules and isn't depleted.

A line's counts are combined before the shuffle, so a line that a third of all documents hold
costs no more than others. The common lines are at most (lines of a host) / (the least count), and
are broadcast only up to ``BROADCAST_LINES``.

Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows get
the same result each; rows without doc_id too. Further columns have no effect, and ``cleaned``
carries them along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HELPER, WORD_SEPARATORS, stored

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: A line is common in a host above this many distinct documents ...
COMMON_DOCS = 50
#: ... or above this many and this share of the host's distinct documents.
FEW_DOCS, COMMON_SHARE = 5, 0.1
#: Share of its words whose loss depletes a document.
DEPLETED = 0.8
#: Common lines, 16 bytes and the host's name each, that are broadcast at most.
BROADCAST_LINES = 200_000

_SPACES = " \t\n\x0b\x0c\r"


def _repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words the windows cover whose hash occurs twice or more; the windows' hashes are
    in order of place."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(ordered: Column) -> Column:
        twice = F.filter(
            F.transform(
                ordered,
                lambda x, k: F.when(
                    (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
                    x["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.aggregate(
            F.sort_array(twice),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )

    # A one-element array passes the sorted windows on, so that they are sorted once.
    return F.transform(F.array(placed), count)[0]


def _normal_lines(text: Column) -> Column:
    """The normalised lines that have a word, in order."""
    spaced = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.split(F.regexp_replace(spaced, "[0-9]+", "0"), "\n")
    return F.array_remove(F.transform(lines, lambda x: F.trim(x)), "")


def measures(docs: DataFrame, host_col: str = "source", window: int = WINDOW) -> DataFrame:
    """``doc_id, host, text_hash``, the base counts, and ``lines``: hash and words of each line."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(host_col).alias("host"), text.alias("text"))
    split = rows.select(
        "doc_id",
        "host",
        "text",
        F.array_remove(F.split("text", f"[{WORD_SEPARATORS}]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0).alias("own"),
        _normal_lines(F.col("text")).alias("normal"),
    )
    windows = F.when(
        F.size("words") >= window,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - window),
            lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(window))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        F.transform(
            "normal",
            lambda x: F.struct(
                F.xxhash64(x).alias("h"),
                (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w"),
            ),
        ).alias("lines"),
    )
    repeated = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), _repeated_words(F.col("windows"), window)
    ).otherwise(0)
    return hashed.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated.cast("long").alias("n_repeat_words"), "lines",
    )


def common_lines(
    measured: DataFrame, max_docs: int = COMMON_DOCS, few_docs: int = FEW_DOCS, share: float = COMMON_SHARE
) -> DataFrame:
    """``host, h, n_docs``: lines above ``max_docs``, or above ``few_docs`` and ``share``."""
    lines = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    distinct = measured.groupBy("host", "text_hash").agg(F.first(lines).alias("lines"))
    counted = (
        distinct.select("host", F.explode("lines").alias("h"))
        .groupBy("host", "h")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") > few_docs)
    )
    hosts = (
        measured.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    ).withColumnRenamed("host", "of")
    return (
        counted.join(hosts, F.col("host").eqNullSafe(F.col("of")))
        .filter((F.col("n_docs") > max_docs) | (F.col("n_docs") > share * F.col("host_docs")))
        .select("host", "h", "n_docs")
    )


def _found_lines(measured: DataFrame, common: DataFrame, broadcast_lines: int) -> DataFrame:
    """``doc, text, common``: by document, the hashes of its lines that are common."""
    few = common.count() <= broadcast_lines
    side = common.select(F.col("host").alias("of"), F.col("h").alias("common_h"))
    exploded = measured.select("doc_id", "text_hash", "host", F.explode("lines.h").alias("h"))
    met = exploded.join(
        F.broadcast(side) if few else side,
        (F.col("h") == F.col("common_h")) & F.col("host").eqNullSafe(F.col("of")),
    )
    return met.groupBy(F.col("doc_id").alias("doc"), F.col("text_hash").alias("txt"), F.col("host").alias("on")).agg(
        F.collect_set("h").alias("common")
    )


def judge(docs: DataFrame, host_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The base counts of each row, ``base_failed``, ``n_common_words``, ``n_common_lines``,
    ``kept``, and ``common``: the hashes of its lines that are removed."""
    measured = stored(measures(docs, host_col), "measures")
    common = stored(common_lines(measured), "common")
    found = _found_lines(measured, common, broadcast_lines)
    same = (
        F.col("doc_id").eqNullSafe(F.col("doc"))
        & (F.col("text_hash") == F.col("txt"))
        & F.col("host").eqNullSafe(F.col("on"))
    )
    gone = F.filter("lines", lambda x: F.array_contains("common", x["h"]))
    both = measured.join(found, same, "left").withColumn(
        "gone", F.when(F.col("common").isNotNull(), gone).otherwise(F.array().cast("array<struct<h:bigint,w:int>>"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    lost = F.aggregate("gone", F.lit(0), lambda acc, x: acc + x["w"]).cast("long")
    rows = both.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.size("gone").cast("long").alias("n_common_lines"),
        lost.alias("n_common_words"),
        "common",
    )
    left = F.col("n_words") - F.col("n_common_words")
    depleted = (left < MIN_WORDS) | (F.col("n_common_words") > DEPLETED * F.col("n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)


def verdicts(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_common_lines", "n_common_words",
    )


def cleaned(docs: DataFrame, host_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The kept rows with their columns, common lines removed from ``text``."""
    names = [f"{HELPER}_{x}" for x in ("doc", "text", "host", "common")]
    seen = judge(docs, host_col, broadcast_lines).filter("kept").select("doc_id", "text_hash", "host", "common")
    seen = seen.dropDuplicates(["doc_id", "text_hash", "host"]).toDF(*names)
    both = docs.join(
        seen,
        docs["doc_id"].eqNullSafe(F.col(names[0]))
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(names[1]))
        & docs[host_col].eqNullSafe(F.col(names[2])),
    )
    common = F.col(names[3])
    normal = lambda x: F.get(_normal_lines(x), 0)
    rest = F.filter(
        F.split(docs["text"], "\n"),
        lambda x: ~F.coalesce(F.array_contains(common, F.xxhash64(normal(x))), F.lit(False)),
    )
    text = F.when(common.isNull(), docs["text"]).otherwise(F.array_join(rest, "\n"))
    return both.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


#: For DuckDB. Line hashes differ there, which doesn't matter for counts.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, host, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(text),
             '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS normal
  FROM d
), win AS (
  SELECT rid, i, words[i:i+4] AS five FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), texts AS (
  SELECT host, text, any_value(normal) AS normal FROM w GROUP BY host, text
), hosts AS (SELECT host, count(*) AS host_docs FROM texts GROUP BY host
), common AS (
  SELECT l.host, l.line FROM (SELECT host, unnest(list_distinct(normal)) AS line FROM texts) l
  JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  GROUP BY l.host, l.line, h.host_docs HAVING count(*) > 50 OR (count(*) > 5 AND count(*) > 0.1::DOUBLE * h.host_docs)
), gone AS (
  SELECT l.rid, count(*) AS n_lines, sum(len(string_split(l.line, ' ')))::BIGINT AS n_words
  FROM (SELECT rid, host, unnest(normal) AS line FROM w) l
  JOIN common c ON l.host IS NOT DISTINCT FROM c.host AND l.line = c.line GROUP BY l.rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(own) - len(list_distinct(own)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(g.n_lines, 0)::BIGINT AS n_common_lines, coalesce(g.n_words, 0)::BIGINT AS n_common_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN gone g USING (rid)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND n_words - n_common_words >= 10 AND n_common_words <= 0.8 * n_words AS kept
FROM m
"""
