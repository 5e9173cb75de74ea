"""Toxicity by classifier chains over labelled categories.

The categories are taken in a fixed order. The linear model (logistic regression) of each sees the
text's features and the probabilities of all earlier categories. In training, those earlier
probabilities are out of fold: each document's comes from a model that didn't see it, as will be
so for new documents; features are chosen and measures scaled without the fold as well. Folds go by
the least feature of a document, which near copies mostly share, so copies rarely part.

Features are the set of words and of word beginnings (CRC-32 of their bytes, A to Z lower-cased,
other ASCII signs as separators), and a few standardised shape measures. The models are fitted on
the driver on at most ``TRAIN_DOCS`` labelled documents, drawn by a hash of doc_id; the features
kept are bounded by ``TOP_FEATURES`` for each category, so the model that goes to the executors
has a fixed size. Scoring then reads every document once, without a shuffle.

Null and empty texts have no words; their probabilities come from the shape measures alone, and
they are never rejected. Labels that are null don't train their category, a document labelled
twice counts with its greatest labels, repeated documents train once. Without labels of both
kinds a category's probability is the share of positives (0 without labels). Repeated rows are
scored alike, further columns have no effect and are carried along by ``without_toxic``, an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_bytes

#: Labelled documents that are used for training at most.
TRAIN_DOCS = 16_000
#: Features of each category, those with the largest chi-square.
TOP_FEATURES = 1024
#: Training documents that a feature needs.
MIN_DOCS = 3
#: Features below it are left out: among a million features chance reaches 15 about a hundred times.
MIN_CHI_SQUARE = 15.0
FOLDS = 5
THRESHOLD = 0.5
#: Bytes of a word beginning.
BEGINNINGS = (4, 5)

#: The query's categories in the chain's order: the labels that the table of labels has.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
N_SHAPES = 4


def words_of(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_SPACED).split())


def features_of(words: set[bytes]) -> set[int]:
    crc = zlib.crc32
    out = set(map(crc, words))
    for n in BEGINNINGS:
        mark = crc(b"\0%d" % n)
        out.update(crc(w[:n], mark) for w in words if len(w) > n)
    return out


def shapes_of(text: bytes, words: set[bytes]) -> tuple[float, ...]:
    """Size, share of signs, share of distinct words, mean length of words."""
    n, pieces = len(text), len(text.split())
    signs = n - len(text.translate(None, b"#*$%&|<>{}@=~^")) if n else 0
    return (
        float(np.log1p(n)),
        signs / max(n, 1),
        len(words) / max(pieces, 1),
        n / max(pieces, 1) if pieces else 0.0,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Rows:
    """Training rows: sparse binary features by row, and dense columns."""

    ids: np.ndarray  # feature numbers, row after row
    lengths: np.ndarray
    dense: np.ndarray

    def scores(self, w: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(row, w[self.ids], len(self.lengths)) + self.dense @ v + bias


@dataclass
class Linear:
    w: np.ndarray
    v: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: Rows, y: np.ndarray, n_features: int, l2: float = 2e-4, steps: int = 120) -> Linear:
        """Logistic regression by Adam over all rows, from a bias at the share of positives."""
        n, d = len(y), rows.dense.shape[1]
        share = y.mean() if n else 0.0
        theta = np.zeros(n_features + d + 1)
        theta[-1] = _logit(np.array([share]))[0]
        if not 0 < share < 1:
            return cls(theta[:n_features], theta[n_features:-1], -35.0 if share == 0 else 35.0)
        row = np.repeat(np.arange(n), rows.lengths)
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            z = np.bincount(row, theta[rows.ids], n) + rows.dense @ theta[n_features:-1] + theta[-1]
            error = (_sigmoid(z) - y) / n
            g = l2 * theta
            g[:n_features] += np.bincount(rows.ids, error[row], n_features)
            g[n_features:-1] += rows.dense.T @ error
            g[-1] = error.sum()
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        return cls(theta[:n_features], theta[n_features:-1], float(theta[-1]))


@dataclass
class Chain:
    """A fitted chain. ``weights``: by feature, the weight in each category's model."""

    names: list[str]
    weights: dict[int, tuple[float, ...]]
    shape_mean: list[list[float]]  # by category
    shape_scale: list[list[float]]
    dense: list[list[float]]  # by category: shapes, then earlier categories' logits
    bias: list[float]
    held_out: dict[str, dict[str, float]] = field(default_factory=dict)

    def probabilities(self, text: bytes) -> list[float]:
        words = words_of(text)
        total = list(self.bias)
        get, several = self.weights.get, range(len(total))
        for f in features_of(words):
            if (w := get(f)) is not None:
                for k in several:
                    total[k] += w[k]
        shapes = shapes_of(text, words)
        out, earlier = [], []
        for k in several:
            seen = [(x - m) / s for x, m, s in zip(shapes, self.shape_mean[k], self.shape_scale[k])] + earlier
            z = total[k] + sum([a * b for a, b in zip(seen, self.dense[k])])
            p = 1 / (1 + math.exp(-min(max(z, -35.0), 35.0)))
            out.append(p)
            clipped = min(max(p, 1e-4), 1 - 1e-4)
            earlier.append(math.log(clipped / (1 - clipped)))
        return out


#: Entries of the driver's long arrays that are worked on at once.
_BLOCK = 1 << 19


def chi_square(row: np.ndarray, ids: np.ndarray, y: np.ndarray, train: np.ndarray, n_features: int) -> np.ndarray:
    """Of each feature's presence against ``y`` over the rows in ``train``."""
    n, positives = int(train.sum()), y[train].sum()
    seen, both = np.zeros(n_features), np.zeros(n_features)
    for i in range(0, len(ids), _BLOCK):
        of = row[i : i + _BLOCK]
        own = train[of]
        part = ids[i : i + _BLOCK][own]
        seen += np.bincount(part, minlength=n_features)
        both += np.bincount(part, y[of[own]], n_features)
    expected = seen * (positives / max(n, 1))
    spread = expected * (1 - positives / max(n, 1)) * (1 - seen / max(n, 1))
    return (both - expected) ** 2 / np.maximum(spread, 1e-9)


def fit_chain(
    features: list[np.ndarray], shapes: np.ndarray, folds: np.ndarray, labels: dict[str, np.ndarray]
) -> Chain:
    """``features``: by row, CRC-32 numbers, a list that is emptied; ``labels``: by category, 0, 1 or
    NaN for each row."""
    n = len(features)
    lengths = np.array([len(x) for x in features], np.int64)
    flat = np.concatenate(features) if n else np.empty(0, np.uint32)
    features.clear()
    ordered = np.sort(flat)
    # Of sorted numbers, those that stand MIN_DOCS times in a row.
    often = ordered[MIN_DOCS - 1 :][ordered[MIN_DOCS - 1 :] == ordered[: max(len(ordered) - MIN_DOCS + 1, 0)]]
    known = often[np.flatnonzero(np.diff(often, prepend=often[:1] - 1))] if len(often) else often
    del ordered, often
    # Rows and feature numbers of what is known, block by block in place of a copy.
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    ids, end = np.empty(len(flat), np.int32), 0
    for i in range(0, len(flat) if len(known) else 0, _BLOCK):
        part = flat[i : i + _BLOCK]
        number = np.minimum(np.searchsorted(known, part), len(known) - 1)
        held = known[number] == part
        m = int(held.sum())
        ids[end : end + m], row[end : end + m] = number[held], row[i : i + _BLOCK][held]
        end += m
    del flat
    ids, row = ids[:end], row[:end]
    everything = np.ones(n, bool)
    dense = np.empty((n, 0))  # earlier categories' out-of-fold logits
    fitted, held_out = [], {}
    for name, y in labels.items():
        have = ~np.isnan(y)
        out_of_fold = np.zeros(n)
        for k in range(FOLDS):
            # Features and scales of a fold's model come from the other folds' rows only.
            test = folds == k
            model = _Part.fit(row, ids, shapes, dense, y, have & ~test, len(known))
            out_of_fold[test] = _sigmoid(model.scores(row, ids, shapes, dense, test))
        fitted.append(_Part.fit(row, ids, shapes, dense, y, have & everything, len(known)))
        said = out_of_fold[have] >= THRESHOLD
        right = y[have] > 0
        held_out[name] = {
            "rows": int(have.sum()),
            "positives": int(right.sum()),
            "precision": float((said & right).sum() / max(said.sum(), 1)),
            "recall": float((said & right).sum() / max(right.sum(), 1)),
        }
        dense = np.column_stack([dense, _logit(out_of_fold)])
    weights: dict[int, list[float]] = {}
    for k, part in enumerate(fitted):
        for number, w in zip(np.flatnonzero(part.keep), part.model.w):
            weights.setdefault(int(known[number]), [0.0] * len(fitted))[k] = float(w)
    return Chain(
        list(labels), {f: tuple(w) for f, w in weights.items()}, [p.mean.tolist() for p in fitted],
        [p.scale.tolist() for p in fitted], [p.model.v.tolist() for p in fitted], [p.model.bias for p in fitted], held_out,
    )


@dataclass
class _Part:
    """One category's model with the features and scales that its training rows gave."""

    keep: np.ndarray  # by feature number, whether it is used
    mean: np.ndarray
    scale: np.ndarray
    model: Linear

    @classmethod
    def fit(cls, row, ids, shapes, dense, y, train, n_features: int) -> _Part:
        """From the rows in ``train``; ``row`` and ``ids`` list each row's feature numbers."""
        score = chi_square(row, ids, y, train, n_features)
        best = np.argsort(-score, kind="stable")[:TOP_FEATURES]
        keep = np.zeros(n_features, bool)
        keep[best[score[best] >= MIN_CHI_SQUARE]] = True
        some = shapes[train]
        mean = some.mean(axis=0) if len(some) else np.zeros(N_SHAPES)
        scale = np.maximum(some.std(axis=0), 1e-6) if len(some) else np.ones(N_SHAPES)
        part = cls(keep, mean, scale, None)
        part.model = Linear.fit(part.rows(row, ids, shapes, dense, train), y[train], int(keep.sum()))
        return part

    def rows(self, row, ids, shapes, dense, which) -> Rows:
        found = []
        for i in range(0, len(ids), _BLOCK):
            used = self.keep[ids[i : i + _BLOCK]] & which[row[i : i + _BLOCK]]
            found.append((row[i : i + _BLOCK][used], ids[i : i + _BLOCK][used]))
        of, own = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int32) for k in (0, 1))
        number = np.cumsum(self.keep) - 1
        lengths = np.bincount(of, minlength=len(which))[which]
        return Rows(number[own], lengths, np.column_stack([(shapes[which] - self.mean) / self.scale, dense[which]]))

    def scores(self, row, ids, shapes, dense, which) -> np.ndarray:
        return self.rows(row, ids, shapes, dense, which).scores(self.model.w, self.model.v, self.model.bias)


def training_rows(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], n_docs: int = TRAIN_DOCS
) -> DataFrame:
    """``doc_id, fold, features binary, shapes, <category> double``: at most ``n_docs`` rows."""
    names = list(categories)
    values = [F.expr(e).cast("double").alias(n) for n, e in categories.items()]
    chosen = (
        labels.filter("doc_id is not null")
        .select("doc_id", *values)
        .groupBy("doc_id")
        .agg(*(F.max(n).alias(n) for n in names))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(n_docs)
    )
    # At most n_docs narrow rows are broadcast; the texts stay where they are.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")

    def featurise(batches):
        for batch in batches:
            packed, shapes, folds = [], [], []
            for text in text_bytes(batch.column(1)):
                words = words_of(text)
                own = np.fromiter(features_of(words), np.uint32)
                own.sort()
                packed.append(own.tobytes())
                folds.append(int(own[0]) % FOLDS if len(own) else 0)
                shapes.append(list(shapes_of(text, words)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "features": pa.array(packed, pa.binary()),
                    "shapes": pa.array(shapes, pa.list_(pa.float64())),
                    "fold": pa.array(folds, pa.int32()),
                }
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = map_arrow(texts, featurise, f"doc_id {id_type}, features binary, shapes array<double>, fold int")
    once = made.groupBy("doc_id").agg(F.min(F.struct("features", "shapes", "fold")).alias("made"))
    return once.join(F.broadcast(chosen), "doc_id").select("doc_id", "made.fold", "made.features", "made.shapes", *names)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> Chain:
    """Fit the chain on the labelled documents."""
    rows = training_rows(docs, labels, categories).orderBy("doc_id").toArrow()
    features = [np.frombuffer(x, np.uint32) for x in rows["features"].to_pylist()]
    shapes = np.array(rows["shapes"].to_pylist(), float).reshape(-1, N_SHAPES)
    folds, marks = rows["fold"].to_numpy(), {n: rows[n].to_numpy().astype(float) for n in categories}
    del rows
    return fit_chain(features, shapes, folds, marks)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id, p_<category> double..., rejected boolean`` of every row; a document is rejected
    for the chain's last category."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            found = [chain.probabilities(t) for t in texts]
            columns = {"doc_id": batch.column(0)}
            for k, name in enumerate(chain.names):
                columns[f"p_{name}"] = pa.array([p[k] for p in found], pa.float64())
            said = [p[-1] >= THRESHOLD and bool(t) for p, t in zip(found, texts)]
            columns["rejected"] = pa.array(said, pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    probabilities = ", ".join(f"p_{n} double" for n in chain.names)
    schema = f"doc_id {id_type}, {probabilities}, rejected boolean"
    return map_arrow(docs.select("doc_id", "text"), judge, schema)


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The same rows and columns without those that the chain rejects."""

    def keep(batches):
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            clean = [not t or chain.probabilities(t)[-1] < THRESHOLD for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, keep, docs.schema)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: all documents with all probabilities, and whether they are rejected."""
    return score(docs, train(docs, labels, CATEGORIES))
