"""Secret scans: fixed patterns, and character Markov models for strings that fit no pattern.

Base patterns find assignments to telling names, access keys and long hexadecimal runs. Further
runs of key characters are compared under two order-1 Markov models over characters, one trained
on random strings and one on ordinary identifiers: a run whose log-likelihood ratio, summed over
its transitions, reaches a bound that grows with their number is reported as kind ``markov``. Of a
run that holds base spans, the pieces before, between and after them are judged, so such spans
never overlap base spans. Whole UUIDs are names and no secrets.

The models are trained from labelled samples: tokens with a label 1 (random) or 0 (ordinary).
``corpus_counts`` takes them from all documents: values of base matches are random, the other
tokens are ordinary. ``drawn_samples`` adds random strings over the usual key alphabets and
identifiers made of common words, so that alphabets and words which the corpus happens to lack are
known too; the ordinary model is a mixture of the corpus's and the samples' transitions.
Transitions are counted where the documents are read; only the counts, at most 2 x 68 x 68
numbers, reach the driver.

Null and empty texts have no spans. Rows are scanned one by one: repeated rows and ties have no
effect, further columns neither, and ``redact`` carries them along. An empty table gives an empty
result (the models then rest on the drawn samples alone). Positions are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: Order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "markov")
#: Characters of text whose distinct tokens a task holds before it counts their transitions.
COUNT_CHARS = 2_000_000
#: Of these, tokens whose joined forms are made and counted at once.
COUNT_TOKENS = 2048
#: Characters that a run needs to be judged by the models.
MIN_RUN = 10
#: Distinct characters that such a run needs; fewer make rules and padding.
MIN_DISTINCT = 5
#: A run is random from this log-likelihood ratio (nats) on, and this much more for each transition.
BOUND, BOUND_EACH = 10.0, 0.3
#: Weight of the drawn identifiers in the ordinary model.
DRAWN_WEIGHT = 0.3
#: Common words of identifiers, as labelled samples of ordinary text.
WORDS = """
abstract access account action active address admin after agent algorithm alpha amount android angular application
apple archive argument array article assert asset async attribute audio author average backend background backup base
basic batch before begin binary block board boolean bottom branch browser buffer build button cache calendar callback
camera cancel category center certificate change channel character check child class clean client clock close cloud
cluster code collection color column command comment commit common company compare complete component config
connection console constant container content context control convert copy core count counter create credit current
customer dashboard data database debug default delete delivery dependency desktop detail device dialog dictionary
digest directory display document domain double download driver dynamic editor element email empty enable encode
engine entity environment error event example exception execute export expression factory feature field file filter
final first float folder format frame framework function gateway generic global graph group handler hash header health
helper history host image import index info initial input install instance integer interface internal
""".split()


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_CHARS = 6
#: Cheap signs that an assignment may be there, in the lower-cased text.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Both patterns match maximal runs, so a least length in the pattern drops just the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Holds every match of ACCESS and HEX.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What the models judge.
JUDGED = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(SYMBOLS)
CODE = {c: k for k, c in enumerate(SYMBOLS)}
#: By byte; others, such as the line feed between tokens, count as SIZE.
CODES = np.full(256, SIZE, np.int64)
CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(SIZE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, sorted."""
    out = []
    if (":" in text or "=" in text) and any(h in (low := text.lower()) for h in HINTS):
        del low
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    for run in RUN.finditer(text):
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, run.start(), run.end())]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out)


def transitions(token: str) -> Counter:
    codes = [CODE[c] for c in token if c in CODE]
    return Counter(zip(codes, codes[1:]))


@dataclass
class MarkovPair:
    """Log-likelihood ratios of character transitions, random over ordinary."""

    ratio: list[list[float]]

    @classmethod
    def fit(cls, counts: dict[tuple[int, int, int], int], drawn: dict[tuple[int, int, int], int], smooth: float = 0.5) -> MarkovPair:
        """Both by label, character and next character: ``counts`` of a corpus, and of ``drawn``
        samples. The random strings of both make one model."""
        table = np.full((2, SIZE, SIZE), smooth)
        names = np.full((SIZE, SIZE), smooth / 2)
        for (label, a, b), n in (*counts.items(), *((k, n) for k, n in drawn.items() if k[0])):
            table[label, a, b] += n
        for (label, a, b), n in drawn.items():
            if not label:
                names[a, b] += n
        table /= table.sum(axis=2, keepdims=True)
        names /= names.sum(axis=1, keepdims=True)
        weight = DRAWN_WEIGHT if any(not label for label, _, _ in counts) else 1.0
        ordinary = (1 - weight) * table[0] + weight * names
        return cls((np.log(table[1]) - np.log(ordinary)).tolist())

    def score(self, token: str) -> float:
        """Log-likelihood ratio of the token's transitions."""
        codes = [CODE[c] for c in token if c in CODE]
        ratio = self.ratio
        return sum([ratio[a][b] for a, b in zip(codes, codes[1:])])

    def is_random(self, token: str, bound: float = BOUND) -> bool:
        """Whether the run is long and varied enough, no number and no UUID, and random."""
        n = len(token)
        if n < MIN_RUN or token.isdigit() or len(set(token)) < MIN_DISTINCT:
            return False
        return self.score(token) >= bound + BOUND_EACH * (n - 1) and not UUID.fullmatch(token)


def drawn_samples(n: int = 400, seed: int = 42) -> list[tuple[str, int]]:
    """Labelled samples that need no corpus: random strings over the usual key alphabets, runs in
    alphabetical order and identifiers made of ``WORDS``, which are ordinary."""
    rnd = random.Random(seed)
    lower, upper, digits = SYMBOLS[:26], SYMBOLS[26:52], SYMBOLS[52:62]
    alphabets = (
        digits + lower[:6],
        digits + upper[:6],
        upper + "234567",
        digits + lower,
        digits + lower + upper,
        digits + lower + upper + "+/",
        digits + lower + upper + "-_",
    )
    ordinary = [(part * 20, 0) for part in (lower, upper, digits)]
    ordinary += [(token, 0) for word in WORDS for token in joined_identifiers(word)]
    for _ in range(5 * n):
        a, b, c = rnd.choices(WORDS, k=3)
        title = a.capitalize() + b.capitalize()
        forms = (f"{a}{b.capitalize()}{c.capitalize()}", f"{title}{rnd.randint(0, 99)}", f"{a}_{b}_{c}", f"{a}-{b}")
        day = f"{rnd.randint(1970, 2039)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 31):02}T{rnd.randint(0, 23):02}"
        ordinary += [(t, 0) for t in (*forms, f"/{a}/{b}{rnd.randint(0, 9)}/{c}", f"{a}_{b}".upper(), day)]
    return ordinary + [
        ("".join(rnd.choices(a, k=rnd.randint(20, 48))), 1) for a in alphabets for _ in range(n)
    ]


def _tally(table: np.ndarray, tokens: list[str], times: list[int]) -> None:
    """Add the transitions of each token, so many times, to ``table``."""
    if not tokens:
        return
    codes = CODES[np.frombuffer("\n".join(tokens).encode(), np.uint8)]
    weights = np.repeat(times, [len(t) + 1 for t in tokens])[: len(codes) - 1]
    pairs = np.bincount(codes[:-1] * (SIZE + 1) + codes[1:], weights, (SIZE + 1) ** 2)
    table += pairs.reshape(SIZE + 1, SIZE + 1)[:SIZE, :SIZE].astype(np.int64)


def joined_identifiers(token: str) -> tuple[str, ...]:
    """An ordinary token, also with the joints and cases of identifiers."""
    low, title, upper = token.lower(), token.capitalize(), token.upper()
    return (
        token,
        f"{low}{title}{title}2",
        f"{low}_{low}_1",
        f"{low}-{title}-v3",
        f"{low}/{title}/{low}",
        f"{low}={low}",
        f"{upper}_{upper}",
        f"{low}//{low}",
    )


def _tally_joined(table: np.ndarray, ordinary: Counter) -> None:
    """Add the transitions of all forms of each token, as often as it occurs, to ``table``."""
    rest = iter(ordinary.items())
    while part := list(islice(rest, COUNT_TOKENS)):
        times = [n for _, n in part]
        for tokens in zip(*(joined_identifiers(token) for token, _ in part)):
            _tally(table, tokens, times)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``label, a, b, n``: how often character ``b`` follows ``a`` in the tokens of all documents,
    in parts. Values of base matches are random; other tokens are ordinary, and joined ones too."""

    def count(batches):
        table = np.zeros((2, SIZE, SIZE), np.int64)
        ordinary, chars = Counter(), 0

        def flush():
            _tally_joined(table[0], ordinary)
            ordinary.clear()

        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                at = 0
                for start, kind, end in base_spans(text):
                    match = text[start:end]
                    found.append(ASSIGN.match(match)[2] if kind == 0 else match)
                    ordinary.update(TOKEN.findall(text[at:start]))
                    at = max(at, end)
                ordinary.update(TOKEN.findall(text[at:]))
                chars += len(text)
                if chars >= COUNT_CHARS:
                    flush()
                    chars = 0
            _tally(table[1], found, [1] * len(found))
        flush()
        places = np.nonzero(table)
        yield pa.RecordBatch.from_pydict(
            {k: pa.array(v, pa.int64()) for k, v in zip(("label", "a", "b", "n"), (*places, table[places]))}
        )

    return map_arrow(docs.select("text"), count, "label long, a long, b long, n long")


def train(counted: DataFrame | None, drawn: list[tuple[str, int]]) -> MarkovPair:
    """Fit both models on the transitions ``label, a, b, n`` of a table and on labelled samples."""
    samples: Counter = Counter()
    for token, label in drawn:
        for (a, b), n in transitions(token).items():
            samples[label, a, b] += n
    rows = [] if counted is None else counted.groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect()
    return MarkovPair.fit({(r.label, r.a, r.b): r.n for r in rows}, samples)


def all_spans(text: str, model: MarkovPair, bound: float = BOUND) -> list[tuple[int, int, int]]:
    """Base spans and the runs that the models call random, sorted."""
    spans = base_spans(text)
    more, k, n = [], 0, len(spans)
    reach = 0
    for run in JUDGED.finditer(text):
        start, end = run.span()
        pieces, at = [], max(start, reach)
        while k < n and spans[k][0] < end:
            if spans[k][0] > at:
                pieces.append((at, spans[k][0]))
            reach = max(reach, spans[k][2])
            at = max(at, reach)
            k += 1
        for start, stop in (*pieces, (at, end)):
            if stop - start >= MIN_RUN and model.is_random(text[start:stop], bound):
                more.append((start, 3, stop))
    return sorted(spans + more) if more else spans


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, model: MarkovPair, bound: float = BOUND) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov`` (long), ``base_spans, spans`` (string)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            found = [all_spans(t, model, bound) if t else [] for t in batch.column(1).to_pylist()]
            columns = {"doc_id": batch.column(0)}
            for k, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(s[1] == k for s in x) for x in found], pa.int64())
            columns["base_spans"] = pa.array([listed([s for s in x if s[1] < 3]) for x in found])
            columns["spans"] = pa.array(map(listed, found), pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {id_type}, {counts}, base_spans string, spans string"
    return map_arrow(docs.select("doc_id", "text"), find, schema)


def redact(
    docs: DataFrame, model: MarkovPair, bound: float = BOUND, mark: str = "<SECRET>"
) -> DataFrame:
    """The same rows and columns, each secret in ``text`` replaced by ``mark``; null stays null."""

    def replace(text: str) -> str:
        out, at = [], 0
        for start, _, end in all_spans(text, model, bound):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def rewrite(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [replace(t) if t else t for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = map_arrow(docs, rewrite, docs.schema)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return out.select(docs.columns)


def corpus_model(docs: DataFrame) -> MarkovPair:
    """Both models, trained from all documents and the drawn samples."""
    return train(corpus_counts(docs), drawn_samples())


def secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's rows: counts, the digest of the base spans and all spans."""
    found = scan(docs, corpus_model(docs))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "n_markov",
    )
