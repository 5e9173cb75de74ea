"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become sequences of tokens: letters, digits and underscores, lower-cased. In the template of
a text, numbers (also as words, or with letters glued to them), units after numbers and names are
replaced by typed placeholders, neighbours of a kind by one. There are three templates: in the
first, names are capitalised words inside a sentence; in the second, all capitalised words, so
names that begin a sentence or follow a quote are slots as well; in the third, no words are names,
so that a text in other letter case is found. A document holds an item if any tells so. A template
and its raw tokens come from one marked text, so they have the same positions.

Documents are first searched for anchors: short sequences of words, without slots, of which a
document that holds an item must have one. The rest is done for documents that have one only.

Windows of ``WINDOW`` template tokens are hashed and joined with those of the benchmark; items
shorter than a window are a single window of their own length. A match is placed by its shift
(document position minus item position), and an item is a candidate where the windows matched at
one shift are at least ``MIN_SHARE`` of the item's, or where those matched in the same order at
neighbouring shifts are: inserted, dropped and exchanged words move what follows.

Slots are then compared over the matched windows: a match is consistent if every value of the
item stands for one value of the document. So a question whose numbers and names were exchanged
is found (``changed``), and a text that merely has the same frame with values that contradict each
other is not. Matches whose values are all equal are ``exact``.

Only windows that the benchmark holds survive the join. The benchmark's windows are broadcast if
they are at most ``BROADCAST_WINDOWS``, and joined by hash otherwise.

Null and empty texts, on either side, match nothing. Repeated documents are one, under their
doc_id; documents without doc_id can't be reported. Further columns have no effect, and
``without_benchmark`` carries them along. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
MIN_SHARE = 0.5
#: Windows of the benchmark, 16 bytes each in a hash table, that are broadcast at most.
BROADCAST_WINDOWS = 500_000
#: Words of an anchor at most, and anchors that documents are searched for at most; with more,
#: all documents go on to the comparison of windows.
ANCHOR = 4
MAX_ANCHORS = 20_000

#: Placeholders; in marked texts they stand before the words that they replace. LEADING marks
#: capitalised words that begin a sentence or a line or follow other signs, names or not.
NAME, NUMBER, UNIT, LEADING = "\ue001", "\ue002", "\ue003", "\ue004"
MARKS = NAME + NUMBER + UNIT + LEADING
#: Words that count as numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion"
).split()
#: Units of measure and money that count as units after a number.
UNITS = (
    "km m cm mm mi ft in kg g mg lb oz t l ml s sec ms min h hr hours hour minutes minute seconds "
    "second days day weeks week months month years year km_h mph kmh usd eur dollars dollar euros "
    "euro cents cent percent degrees degree watts watt volts volt kw kwh mb gb kb tb"
).split()


#: What ends a word, and what begins one.
_END, _BEGIN = r"(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_])"


def _tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, underscores and marks."""
    spaced = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{MARKS}]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda x: x != "")


def _longest(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _marked(text: Column) -> Column:
    """``text`` with a mark before each slot. Numbers with points, commas, colons or slashes inside
    and km/h become single words, and a number is parted from the letters that follow it."""
    digits = text.rlike("[0-9]")
    joined = F.regexp_replace(text, r"(?<=[0-9])[.,:/](?=[0-9])", "_")
    parted = F.when(digits, F.regexp_replace(joined, rf"{_BEGIN}([0-9][0-9_]*+)(?=\p{{L}})", "$1 ")).otherwise(text)
    speed = F.regexp_replace(parted, rf"(?i)(?<=km)/(?=h{_END})", "_")
    number = rf"{_BEGIN}(?=[0-9][0-9_]*+{_END}|(?i:{_longest(NUMBER_WORDS)}){_END})"
    numbered = F.regexp_replace(speed, number, NUMBER)
    units = rf"({NUMBER}[\p{{L}}0-9_]+ )(?=(?i:{_longest(UNITS)})(?![\p{{L}}\p{{N}}_/]))"
    united = F.regexp_replace(numbered, units, f"$1{UNIT}")
    capital = F.regexp_replace(united, rf"(?<![\p{{L}}\p{{N}}_{NUMBER}{UNIT}])(?=\p{{Lu}})", LEADING)
    return F.regexp_replace(capital, rf"{LEADING}(?<=[\p{{Ll}}\p{{Nd}},;] {LEADING})", NAME)


def _one_each(marked: Column, mark: str) -> Column:
    """Neighbouring slots of a kind joined to one, so that the number of their words is free."""
    between = r"[\s'’-]{1,2}"
    return F.regexp_replace(marked, rf"{between}{mark}(?<={mark}[\p{{L}}0-9_]{{1,30}}{between}{mark})", "_")


def _levels(marked: Column) -> list[Column]:
    """The marked text for each template: names inside sentences, all capitalised words, no names."""
    numbers = _one_each(marked, NUMBER)
    return [
        _one_each(F.translate(numbers, LEADING, ""), NAME),
        _one_each(F.translate(numbers, LEADING, NAME), NAME),
        F.translate(numbers, LEADING + NAME, ""),
    ]


def _template_tokens(level: Column) -> Column:
    return _tokens(F.regexp_replace(level, rf"([{MARKS}])[\p{{L}}\p{{N}}_]+", "$1"))


def _raw_tokens(level: Column) -> Column:
    """The words at the places of the template's tokens."""
    return _tokens(F.translate(level, MARKS, ""))


def _by_level(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, level, marked``: the marked texts of each row."""
    marked = rows.select(*keys, _marked(F.coalesce("text", F.lit(""))).alias("all"))
    return marked.select(*keys, F.posexplode(F.array(*_levels(F.col("all")))).alias("level", "marked"))


def templates(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id, level, tokens``: the template tokens of each row, for all templates."""
    rows = _by_level(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    return rows.select("id", "level", _template_tokens(F.col("marked")).alias("tokens"))


def _window_hashes(tokens: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, in order."""
    return F.transform(
        F.sequence(F.lit(0), F.size(tokens) - size),
        lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(size))),
    )


def _benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, level, size, n_windows, tokens``: the items' templates; items shorter than a window
    are a single one of their own length."""
    items = templates(benchmark, "item_id").filter(F.size("tokens") > 0)
    size = F.least(F.size("tokens"), F.lit(window))
    items = items.select(
        F.col("id").alias("item_id"), "level", size.alias("size"), (F.size("tokens") - size + 1).alias("n_windows"), "tokens"
    )
    # With every capitalised word a slot, items need a full window and as many words as slots.
    literal = F.filter("tokens", lambda t: ~t.isin(NUMBER, UNIT, NAME))
    return items.filter((F.col("level") != 1) | ((F.col("size") == window) & (2 * F.size(literal) >= F.size("tokens"))))


def anchors(items: DataFrame, min_share: float) -> DataFrame:
    """``size, first, hash``: word sequences of which a document that holds an item has one at least.

    A document that holds an item has ``min_share`` of its windows, so it has one of any so many
    windows that the others are fewer than that. Of those with the longest sequences, each window
    gives the sequence of up to ``ANCHOR`` neighbouring words, no slots among them, whose hash is
    least, so that neighbouring windows mostly give the same. ``size`` is 0 for windows that have
    no such word.
    """
    every = F.transform(F.sequence(F.lit(1), F.col("n_windows")), lambda i: F.slice("tokens", i, F.col("size")))
    windows = items.select("item_id", "level", "n_windows", F.explode(every).alias("w"))
    found = F.lit(None).cast("struct<size:int,hash:bigint,first:bigint>")
    for n in range(1, ANCHOR + 1):
        runs = F.filter(
            F.transform("w", lambda _, i: F.slice("w", i + 1, n)),  # noqa: B023
            lambda x: (F.size(x) == n) & F.forall(x, lambda t: t.rlike(r"^\p{L}+$")),  # noqa: B023
        )
        hashes = F.transform(runs, lambda x: F.transform(x, lambda t: F.xxhash64(t)))
        least = F.array_min(
            F.transform(hashes, lambda x: F.struct(F.lit(n).alias("size"), F.xxhash64(x).alias("hash"), x[0].alias("first")))  # noqa: B023
        )
        found = F.coalesce(least, found)
    own = Window.partitionBy("item_id", "level").orderBy(F.col("a.size").desc_nulls_last(), "a.hash")
    ranked = windows.select("item_id", "level", "n_windows", found.alias("a")).withColumn("rank", F.row_number().over(own))
    needed = F.col("n_windows") - F.greatest(F.ceil(min_share * F.col("n_windows")), F.lit(1)) + 1
    kept = ranked.filter(F.col("rank") <= needed)
    return kept.select(F.coalesce("a.size", F.lit(0)).alias("size"), "a.first", "a.hash").distinct()


def may_hold(docs: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """The rows that have an anchor. If there are over ``limit``, or windows without any, all rows."""
    rows = found.limit(limit + 1).collect()
    if not rows:
        return docs.filter(F.lit(False))
    if len(rows) > limit or any(r["size"] == 0 for r in rows):
        return docs
    by_size = {n: [r.hash for r in rows if r["size"] == n] for n in sorted({r["size"] for r in rows})}
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")

    def has_one(hashes: Column) -> Column:
        def begins(h: Column, i: Column) -> Column:
            ends = [F.xxhash64(F.array(*(F.get(hashes, i + k) for k in range(n)))).isin(x) for n, x in by_size.items()]
            return h.isin([r.first for r in rows]) & reduce(Column.__or__, ends)

        return F.size(F.filter(hashes, begins)) > 0

    # A one-element array passes the hashes on, so that they are computed once.
    return docs.filter(F.exists(F.array(F.transform(words, lambda t: F.xxhash64(t))), has_one))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_share: float = MIN_SHARE,
    broadcast_windows: int = BROADCAST_WINDOWS,
    max_anchors: int = MAX_ANCHORS,
) -> DataFrame:
    """``doc_id, item_id, shift, n_windows, n_matched, n_slots, n_changed, kind``: a row for each
    document and benchmark item that the document holds, at the place with most matches; ``shift``
    is that of its first matched window."""
    items = stored(_benchmark_windows(benchmark.select("item_id", "text"), window), "items")
    # At most `window` sizes, whatever the benchmark's size.
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    by_size = [
        items.filter(F.col("size") == n).select(
            "size", "level", "item_id", "n_windows", F.posexplode(_window_hashes(F.col("tokens"), n)).alias("item_at", "hash")
        )
        for n in sizes
    ]
    spark = docs.sparkSession
    if not by_size:
        index = spark.createDataFrame([], "size int, level int, item_id long, n_windows int, item_at int, hash long")
    else:
        index = reduce(DataFrame.unionByName, by_size)
    index = stored(index, "benchmark")
    few = index.count() <= broadcast_windows
    side = F.broadcast(index) if few else index

    known = docs.select("doc_id", "text").filter("doc_id is not null")
    possible = stored(may_hold(known, anchors(items, min_share), max_anchors), "possible")
    tokens = templates(possible, "doc_id").filter(F.size("tokens") > 0)
    windows = reduce(
        DataFrame.unionByName,
        [
            tokens.filter((F.size("tokens") >= n) & (F.lit(n == window) | (F.col("level") != 1))).select(
                F.col("id").alias("doc_id"),
                "level",
                F.lit(n).alias("size"),
                F.posexplode(_window_hashes(F.col("tokens"), n)).alias("doc_at", "hash"),
            )
            for n in sizes or [window]
        ],
    )
    matches = windows.join(side, ["size", "level", "hash"]).select(
        "doc_id", "item_id", "level", "n_windows", "size", (F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at"
    )
    return _consistent(possible, benchmark, stored(_candidates(matches, min_share), "candidates"))


def _chain(pairs: Column) -> Column:
    """The longest chain of ``item_at, shift`` that ascends in the item and in the document: one of
    each length, that with the least end, is kept while the pairs are read in document order."""
    ordered = F.array_sort(
        F.transform(pairs, lambda p: F.struct((p["item_at"] + p["shift"]).alias("doc_at"), (-p["item_at"]).alias("back"), p["shift"].alias("shift")))
    )
    link = lambda p: F.struct((-p["back"]).alias("item_at"), p["shift"].alias("shift"))
    kind = "array<array<struct<item_at:int,shift:int>>>"

    def step(chains: Column, p: Column) -> Column:
        below = F.size(F.filter(chains, lambda c: F.element_at(c, -1)["item_at"] < -p["back"]))
        longer = F.concat(F.coalesce(F.get(chains, below - 1), F.array().cast(kind[6:-1])), F.array(link(p)))
        rest = F.slice(chains, below + 2, F.greatest(F.size(chains) - below - 1, F.lit(0)))
        return F.concat(F.slice(chains, F.lit(1), below), F.array(longer), rest)

    return F.aggregate(ordered, F.array().cast(kind), step, lambda chains: F.element_at(chains, -1))


def _passages(pairs: Column, gap: Column) -> Column:
    """``pairs`` in groups whose shifts, in order, differ by ``gap`` at most from one to the next."""
    kind = "array<array<struct<shift:int,item_at:int>>>"

    def step(groups: Column, p: Column) -> Column:
        last = F.element_at(groups, -1)
        near = (F.size(groups) > 0) & (p["shift"] - F.element_at(last, -1)["shift"] <= gap)
        grown = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.concat(last, F.array(p))))
        return F.when(near, grown).otherwise(F.concat(groups, F.array(F.array(p))))

    return F.aggregate(F.array_sort(pairs), F.array().cast(kind), step)


def _candidates(matches: DataFrame, min_share: float) -> DataFrame:
    """``doc_id, item_id, level, n_windows, size, n_matched, at``: the matched windows ``item_at, shift``
    of each place of an item, at one shift or as a chain over neighbouring shifts."""
    by = ["doc_id", "item_id", "level", "n_windows", "size"]
    together = (
        matches.groupBy(*by)
        .agg(F.collect_set(F.struct("shift", "item_at")).alias("pairs"))
        .filter(F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_at"]))) >= min_share * F.col("n_windows"))
    )
    # Copies of an item lie at least its length apart, so half of that tells them from each other.
    gap = F.greatest(F.col("size"), F.floor((F.col("n_windows") + F.col("size") - 1) / 2).cast("int"))
    shifted = F.array_distinct(F.transform("pairs", lambda p: p["shift"]))
    alone = together.select(*by, F.explode(shifted).alias("one"), "pairs").select(
        *by, F.array_sort(F.transform(
            F.filter("pairs", lambda p: p["shift"] == F.col("one")),
            lambda p: F.struct(p["item_at"].alias("item_at"), p["shift"].alias("shift")),
        )).alias("at"),
    )
    chained = (
        together.filter(F.size(shifted) > 1)
        .select(*by, F.explode(_passages(F.col("pairs"), gap)).alias("near"))
        .filter(F.element_at("near", 1)["shift"] < F.element_at("near", -1)["shift"])
        .select(*by, _chain(F.col("near")).alias("at"))
    )
    return (
        alone.unionByName(chained)
        .withColumn("n_matched", F.size("at").cast("long"))
        .filter(F.col("n_matched") >= min_share * F.col("n_windows"))
    )


def _consistent(docs: DataFrame, benchmark: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates whose slots are consistent, best shift first."""

    def raw_and_template(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
        own = _by_level(rows.join(wanted.select(key).distinct(), key, "left_semi"), key)
        return own.select(
            key,
            "level",
            _raw_tokens(F.col("marked")).alias(f"{key}_raw"),
            _template_tokens(F.col("marked")).alias(f"{key}_template"),
        )

    both = candidates.join(
        raw_and_template(benchmark.select("item_id", "text"), "item_id", candidates), ["item_id", "level"]
    ).join(raw_and_template(docs.select("doc_id", "text"), "doc_id", candidates), ["doc_id", "level"])
    # Each place of the item that a window covers, by the shift of the first such window.
    covered = F.flatten(
        F.transform(
            "at",
            lambda w, i: F.transform(
                F.sequence(
                    F.greatest(w["item_at"], F.coalesce(F.get("at", i - 1)["item_at"] + F.col("size"), F.lit(0))),
                    w["item_at"] + F.col("size") - 1,
                ),
                lambda k: F.struct(k.alias("k"), w["shift"].alias("shift")),
            ),
        )
    )
    slots = F.filter(
        covered,
        lambda c: F.get("item_id_template", c["k"]).isin(NUMBER, UNIT, NAME),
    )
    pairs = F.transform(
        slots,
        lambda c: F.struct(
            F.get("item_id_raw", c["k"]).alias("item"),
            F.get("doc_id_raw", c["k"] + c["shift"]).alias("doc"),
        ),
    )
    shift = F.get("at", F.lit(0))["shift"].alias("shift")
    seen = both.select("doc_id", "item_id", "level", shift, "n_windows", "n_matched", F.array_distinct(pairs).alias("pairs"))
    judged = seen.select(
        "doc_id",
        "item_id",
        "level",
        "shift",
        F.col("n_windows").cast("long").alias("n_windows"),
        "n_matched",
        F.size("pairs").cast("long").alias("n_slots"),
        F.size(F.filter("pairs", lambda p: ~p["item"].eqNullSafe(p["doc"]))).cast("long").alias("n_changed"),
        (F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))) == F.size("pairs")).alias("one_to_one"),
    )
    best = judged.filter("one_to_one").groupBy("doc_id", "item_id").agg(
        F.max_by(
            F.struct("shift", "n_windows", "n_matched", "n_slots", "n_changed"),
            F.struct("n_matched", -F.col("n_changed"), -F.col("shift"), -F.col("level")),
        ).alias("best")
    )
    return best.select(
        "doc_id",
        "item_id",
        "best.*",
        F.when(F.col("best.n_changed") == 0, F.lit("exact")).otherwise(F.lit("changed")).alias("kind"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same rows and columns without documents that hold a benchmark item. Rows whose doc_id
    is null can't be addressed and stay."""
    found = contaminated(docs.filter("doc_id is not null"), benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
