"""Language-model scores: the marginal likelihood of a text over all segmentations into subwords.

The vocabulary is that of an existing tokenizer. Each piece has a unigram weight: its share, with
add-``SMOOTH`` smoothing, of the pieces that the tokenizer makes of the training documents' words.
All segmentations of a word into pieces of the vocabulary form a lattice; a forward recursion in
log space adds up their probabilities. Pieces don't cross words, so a text's lattice is the chain
of its words' lattices, and log10 P(text) is the sum of its words' and of one end of text. A
character that is no piece is spelt by the vocabulary's byte pieces.

Beside it stands a word-level base score with additive smoothing, 0.1 for each word.

Words are counted over all documents; each distinct word's two scores are computed once. Words
with over 1/``HOT`` of all tokens (there can be at most ``HOT`` of those) go to every task, so the
frequent words of a text are added up where the text is, and only its rare words are shuffled to
the table of scores. No word is frequent in that shuffle.

Words are runs of characters other than space and tab to carriage return, A to Z lower-cased. Null
and empty texts are just an end. A document is held out if CRC-32 of its doc_id as text is a
multiple of 10, a null doc_id being the empty text. Repeated rows are scored and learnt from each
time. Further columns have no effect. An empty table gives an empty result; without training
documents all words are unknown.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, text_bytes

#: Folds by CRC-32 of the doc_id; documents of fold 0 are held out.
FOLDS = 10
#: Added to each piece's count.
SMOOTH = 0.1
#: Added to each word's count in the base score.
BASE_SMOOTH = 0.1
#: Words that are sent to all tasks, at most.
HOT = 400_000
#: Distinct words that a task counts before it passes its counts on.
COUNTED = 150_000
#: Stands for the end of a text among words, which hold no line feed.
TEXT_END = b"\n"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, train, every`` (long): the tokens of training and of all documents."""

    def count(batches):
        train, every = Counter(), Counter()

        def flush():
            words = list(every)
            columns = {
                "word": pa.array(words, pa.binary()),
                "train": pa.array([train[w] for w in words], pa.int64()),
                "every": pa.array(list(every.values()), pa.int64()),
            }
            train.clear()
            every.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = text.lower().split()
                words.append(TEXT_END)
                every.update(words)
                if not held_out(doc_id):
                    train.update(words)
            if len(every) > COUNTED:
                yield flush()
        yield flush()

    part = map_arrow(docs.select("doc_id", "text"), count, "word binary, train long, every long")
    return part.groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


def piece_counts(counts: DataFrame, path: str) -> dict[int, int]:
    """How often the tokenizer makes each piece of the training documents; at most a number for
    each piece of the vocabulary reaches the driver."""

    def count(batches):
        encode, total = processor(path).encode, Counter()
        for batch in batches:
            words, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            plain = [w.decode() for w in words if w != TEXT_END]
            weights = [n for w, n in zip(words, numbers) if w != TEXT_END]
            for ids, n in zip(encode(plain, num_threads=1), weights):
                for i in ids:
                    total[i] += n
            for w, n in zip(words, numbers):
                if w == TEXT_END:
                    total[processor(path).eos_id()] += n
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())}
        )

    known = counts.filter("train > 0").select("word", "train")
    part = map_arrow(known, count, "piece long, n long", 8192)
    return {r.piece: r.n for r in part.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """The vocabulary's pieces with their log weights, for the forward recursion."""

    def __init__(self, path: str, counts: dict[int, int], smooth: float = SMOOTH):
        sp = processor(path)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or i == sp.bos_id())]
        total = sum(counts.get(i, 0) + smooth for i in usable)
        log = {i: math.log((counts.get(i, 0) + smooth) / total) for i in usable}
        self.end = log[sp.eos_id()]
        self.bytes = [log[sp.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]
        #: Log weight of a piece; None for a mere beginning of pieces.
        self.pieces: dict[str, float | None] = {}
        for i in usable:
            if sp.is_byte(i) or sp.is_control(i):
                continue
            piece = sp.id_to_piece(i)
            for k in range(1, len(piece)):
                self.pieces.setdefault(piece[:k], None)
            self.pieces[piece] = log[i]

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the word's marginal probability, by the forward recursion."""
        text, get, exp, log1p = "▁" + word, self.pieces.get, math.exp, math.log1p
        n = len(text)
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            at, alone = forward[i], False
            if at == -math.inf:
                continue
            for j in range(i + 1, n + 1):
                weight = get(text[i:j], self)
                if weight is self:
                    break
                if weight is not None:
                    alone = alone or j == i + 1
                    x, y = at + weight, forward[j]
                    if y < x:
                        x, y = y, x
                    forward[j] = y + log1p(exp(x - y)) if x > -math.inf else y
            if not alone:
                x = at + sum(self.bytes[b] for b in text[i].encode())
                y = forward[i + 1]
                if y < x:
                    x, y = y, x
                forward[i + 1] = y + log1p(exp(x - y)) if x > -math.inf else y
        return forward[n]


def word_scores(counts: DataFrame, lattice: Lattice, tokens: int, distinct: int) -> DataFrame:
    """``word, every, known, base, score``: log10 probabilities of each distinct word."""
    norm, unit = math.log10(tokens + BASE_SMOOTH * (distinct + 1)), math.log(10)
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def score(batches):
        model = shared.value
        for batch in batches:
            words, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            base = np.log10(np.array(train, float) + BASE_SMOOTH) - norm
            scores = [
                (model.end if w == TEXT_END else model.log_probability(w.decode())) / unit for w in words
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "word": batch.column(0),
                    "every": batch.column(2),
                    "known": pa.array([n > 0 for n in train], pa.bool_()),
                    "base": pa.array(base),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    schema = "word binary, every long, known boolean, base double, score double"
    return map_arrow(counts.select("word", "train", "every"), score, schema, 8192)


#: Keys that hot sums take in the join with words; they begin with a space, so they are no words.
SALTS = 4096


def document_parts(docs: DataFrame, hot: dict[bytes, tuple[float, float, bool]]) -> DataFrame:
    """A row for each document with the sums over its hot words, under a key that is no word, and
    one for each of its rare words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def split(batches):
        get = shared.value.get
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            index, rows, keys, times = [], [], [], []
            sums = ([], [], [], [])  # tokens, known, base, score
            for k, text in enumerate(text_bytes(batch.column(1))):
                words = text.lower().split()
                words.append(TEXT_END)
                base = score = 0.0
                known, rare = 0, []
                for word, n in Counter(words).items():
                    if (found := get(word)) is None:
                        rare.append((word, n))
                    else:
                        base += n * found[0]
                        score += n * found[1]
                        known += n * found[2]
                m = 1 + len(rare)
                index += [k] * m
                rows += [row] * m
                keys.append(b" %d" % (row % SALTS))
                times.append(0)
                for column, value in zip(sums, (len(words), known, base, score)):
                    column.append(value)
                    column += [0] * len(rare)
                keys += [w for w, _ in rare]
                times += [n for _, n in rare]
                row += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(pa.array(index, pa.int64())),
                    "row": pa.array(rows, pa.int64()),
                    "word": pa.array(keys, pa.binary()),
                    "times": pa.array(times, pa.int64()),
                    "tokens": pa.array(sums[0], pa.int64()),
                    "hot_known": pa.array(sums[1], pa.int64()),
                    "hot_base": pa.array(sums[2], pa.float64()),
                    "hot_score": pa.array(sums[3], pa.float64()),
                }
            )

    schema = (
        f"doc_id {id_type}, row long, word binary, times long, tokens long, hot_known long, "
        "hot_base double, hot_score double"
    )
    return map_arrow(docs.select("doc_id", "text"), split, schema)


def score_documents(docs: DataFrame, tokenizer_path: str | None = None, hot_words: int = HOT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    path = tokenizer_path or default_tokenizer()
    counts = stored(word_counts(docs), "words")
    sums = counts.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("train") > 0).alias("distinct"),
        F.coalesce(F.sum("every"), F.lit(0)).alias("every"),
    ).first()
    lattice = Lattice(path, piece_counts(counts, path))
    scored = stored(word_scores(counts, lattice, sums.tokens, sums.distinct), "scores")
    frequent = scored.filter(F.col("every") * hot_words > F.lit(sums.every)).drop("every")
    hot = {bytes(r.word): (r.base, r.score, r.known) for r in frequent.collect()}
    parts = document_parts(docs, hot)
    words = scored.select("word", "known", "base", "score")
    met = parts.join(words, "word", "left")
    times = F.col("times")
    added = met.groupBy("doc_id", "row").agg(
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("hot_known") + F.when(F.col("known"), times).otherwise(0)).alias("n_known"),
        F.sum(F.col("hot_base") + F.coalesce(times * F.col("base"), F.lit(0.0))).alias("base_score"),
        F.sum(F.col("hot_score") + F.coalesce(times * F.col("score"), F.lit(0.0))).alias("score"),
    )
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return added.select(
        "doc_id",
        (fold == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(sums.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
