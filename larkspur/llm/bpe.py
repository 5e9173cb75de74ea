"""Encoding and decoding with a public word-level BPE vocabulary.

The text is cut at special tokens, brought to NFC, lower-cased character by character and cut into
pieces at the vocabulary's split pattern. A piece is looked up in a lexicon: a minimal acyclic
transducer of the corpus's frequent words, counted over all texts, and the vocabulary's whole
words, each with its exact ids. The driver compiles it once for a corpus (at most 2 x ``FREQUENT``
words reach it), Spark distributes it as a file, and every worker maps it into memory. Pieces that
the lexicon lacks are merged exactly, lowest rank first and leftmost among equals. Ids are packed
as little-endian unsigned 32-bit integers. Decoding joins the ids' token strings by a space, as the
vocabulary file, which names no decoder, asks for.

The lexicon and the cache only save work; any lexicon gives the same ids. Null and empty texts
have no ids and decode to the empty text. Rows are encoded one by one: repeated rows, ties and
further columns have no effect, an empty table gives an empty result, and a piece of any length
is merged in O(n log n).
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
from array import array
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forgotten, map_arrow, stored
from .lexicon import Lexicon, compile_lexicon

#: Pieces, and characters of pieces, that a worker remembers in each of two generations.
CACHE, CACHE_CHARS = 250_000, 6_000_000
#: Words with over 1/FREQUENT of a corpus's occurrences go into the lexicon.
FREQUENT = 50_000
#: Distinct words that a task counts before it passes its counts on.
COUNTED = 100_000
#: Bits of an id in packed pairs.
BITS = 24
END = "</w>"
# The split pattern of vocabularies of this kind, and letters, numbers and spaces that
# lower-case Latin-1 text can hold.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, NUMBERS, SPACES = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(shifted.get(b, b)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file of this kind holds, ready for merging."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, names = spec["model"], byte_characters()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.token_at = [tokens.get(i) for i in range(max(tokens) + 1)].__getitem__
        self.inner = [ids[c] for c in names]
        self.last = [ids[c + END] for c in names]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: By pair of ids, rank and merged id in one number.
        self.merges = {
            ids[a] << BITS | ids[b]: rank << BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)
        }
        self.words = [t[: -len(END)] for t in ids if t.endswith(END)]
        self.byte = {c: b for b, c in enumerate(names)}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        latin = SPLIT.replace(r"\p{L}", LETTERS).replace(r"\p{N}", NUMBERS).replace(r"\s", SPACES)
        self.plain = re.compile(latin).findall if split == SPLIT else self.pieces
        self.newer = Split(Regex(split), "removed", invert=True).pre_tokenize_str
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens, normalised."""
        if _latin(text):  # is in NFC, and its lower case too
            return self.plain(text.lower())
        text = self.normal(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Newer characters than Python's own tables know: the library has its own view of them.
            return [piece for piece, _ in self.newer(text)]
        return self.pieces(text)

    def lexicon(self, frequent: list[str] = ()) -> bytes:
        """The vocabulary's whole words and the pieces of a corpus's frequent words, compiled with
        the ids that merging gives them."""
        words = {bytes(map(self.byte.__getitem__, w)) for w in self.words} - {b""}
        for word in frequent:
            for part in self.cut(word)[::2]:
                words.update(piece.encode() for piece in self.split(part))
        return compile_lexicon((w, self.merge(w)) for w in words)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece, by merging its bytes."""
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        return self._merge_short(ids) if len(ids) <= 32 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none, low = self.merges.get, 1 << 62, (1 << BITS) - 1
        ranked = [get(a << BITS | b, none) for a, b in zip(ids, ids[1:])]
        while ranked:
            best = min(ranked)
            if best == none:
                break
            k = ranked.index(best)
            ids[k] = new = best & low
            del ids[k + 1], ranked[k]
            if k:
                ranked[k - 1] = get(ids[k - 1] << BITS | new, none)
            if k < len(ranked):
                ranked[k] = get(new << BITS | ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n, low = self.merges.get, len(ids), (1 << BITS) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, k) for k in range(n - 1) if (m := get(ids[k] << BITS | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or get(ids[k] << BITS | ids[right]) != best:
                continue
            new = best & low
            ids[k], ids[right] = new, -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (m := get(new << BITS | ids[right])) is not None:
                    heapq.heappush(heap, (m, k))
            if (left := before[k]) >= 0 and (m := get(ids[left] << BITS | new)) is not None:
                heapq.heappush(heap, (m, left))
        return [x for x in ids if x >= 0]


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Pieces(dict):
    """Packed ids by piece; a piece that isn't there is encoded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.chars = codec, 0

    def __missing__(self, piece: str) -> bytes:
        codec = self.codec
        if (packed := codec.old.get(piece)) is None:  # get() doesn't encode
            word = piece.encode()
            packed = array("I", codec.lexicon.get(word) or codec.vocabulary.merge(word)).tobytes()
        self[piece] = packed
        self.chars += len(piece)
        return packed


class Codec:
    """Encodes and decodes texts with one vocabulary and its lexicon.

    What was found for a piece is remembered, in two generations of at most ``CACHE`` pieces or
    ``CACHE_CHARS`` characters beyond the last text's; pieces in use move to the younger one.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.old, self.young = _Pieces(self), _Pieces(self)

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        vocabulary, young = self.vocabulary, self.young
        if len(young) > CACHE or young.chars > CACHE_CHARS:
            self.old, self.young = young, _Pieces(self)
            young = self.young
        if "<|" not in text:
            return b"".join(map(young.__getitem__, vocabulary.split(text)))
        out = []
        for k, part in enumerate(vocabulary.cut(text)):
            if k % 2:
                out.append(array("I", [vocabulary.special[part]]).tobytes())
            else:
                out += map(young.__getitem__, vocabulary.split(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.vocabulary.token_at, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def codec_of(path: str, lexicon_file: str) -> Codec:
    """A worker's codec, kept over its tasks; the lexicon is mapped from the distributed file."""
    return Codec(vocabulary_of(path), Lexicon.open(SparkFiles.get(lexicon_file)))


forgotten(codec_of.cache_clear, vocabulary_of.cache_clear)


def frequent_words(docs: DataFrame, text_col: str = "text", share: int = FREQUENT) -> list[str]:
    """Words (runs between white space) of all texts, in order: every word with over 1/``share`` of
    all occurrences is among them, and none that has under half of that.

    A task passes the words on that have over half that share of the ``COUNTED`` or more it has
    just read, so the counts that are added up lack at most half of the share. At most
    2 x ``share`` words reach the driver.
    """

    def count(batches):
        seen, total = Counter(), 0

        def flush():
            kept = {w: n for w, n in seen.items() if 2 * n * share > total}
            rows = {"word": [None, *kept], "n": [total, *kept.values()]}
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(rows["word"], pa.string()), "n": pa.array(rows["n"], pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words = text.split()
                    seen.update(words)
                    total += len(words)
            if len(seen) > COUNTED:
                yield flush()
                total = 0
        yield flush()

    part = map_arrow(docs.select(F.col(text_col).alias("text")), count, "word string, n long")
    counts = stored(part.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.filter("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.filter(F.col("word").isNotNull() & (2 * F.col("n") * share > F.lit(total)))
    return sorted(r.word for r in found.collect())


def publish_lexicon(spark: SparkSession, path: str, frequent: list[str] = ()) -> str:
    """Have Spark send the lexicon to every executor, later ones too; gives the file's name."""
    data = vocabulary_of(path).lexicon(frequent)
    name, context = f"lexicon-{sha256(data).hexdigest()[:16]}.fst", spark.sparkContext
    if not any(x.endswith("/" + name) for x in context.listFiles):
        local = os.path.join(tempfile.mkdtemp(), name)  # the driver's copy, which Spark serves
        with open(local, "wb") as file:
            file.write(data)
        context.addFile(local)
    return name


def _encoded(
    docs: DataFrame, path: str | None, id_col: str, text_col: str, columns: dict, decoded: bool = True
) -> DataFrame:
    """Each row's id and ``columns``: by name, their type in Spark and Arrow, and their function of
    the packed ids and the decoded text."""
    path = path or default_tokenizer()
    lexicon_file = publish_lexicon(docs.sparkSession, path, frequent_words(docs, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        codec = codec_of(path, lexicon_file)
        for batch in batches:
            ids = [codec.encode(text) if text else b"" for text in batch.column(1).to_pylist()]
            found = [(x, codec.decode(x) if decoded else None) for x in ids]
            made = {n: pa.array([fn(*x) for x in found], kind) for n, (_, kind, fn) in columns.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | made)

    schema = f"doc_id {id_type}, " + ", ".join(f"{n} {kind}" for n, (kind, _, _) in columns.items())
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(narrow, encode, schema)


_COUNT = ("long", pa.int64(), lambda packed, _: len(packed) // 4)


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens long, ids binary`` and, if asked for, ``decoded string`` of each row."""
    columns = {"n_tokens": _COUNT, "ids": ("binary", pa.binary(), lambda packed, _: packed)}
    if decoded:
        columns["decoded"] = ("string", pa.string(), lambda _, text: text)
    return _encoded(docs, tokenizer_path, id_col, text_col, columns, decoded)


def encode_digests(
    docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; neither ids nor texts leave the
    worker."""
    columns = {
        "n_tokens": _COUNT,
        "ids_sha256": ("string", pa.string(), lambda packed, _: sha256(packed).hexdigest()),
        "decoded_sha256": ("string", pa.string(), lambda _, text: sha256(text.encode()).hexdigest()),
    }
    return _encoded(docs, tokenizer_path, id_col, text_col, columns)


def decode_documents(
    encoded: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """``doc_id, decoded string`` of rows with packed ``ids``; null ids give the empty text."""
    path = tokenizer_path or default_tokenizer()
    id_type = encoded.schema[id_col].dataType.simpleString()

    def decode(batches):
        token_at = vocabulary_of(path).token_at
        for batch in batches:
            texts = [
                " ".join(map(token_at, memoryview(x or b"").cast("I")))
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "decoded": pa.array(texts, pa.string())}
            )

    narrow = encoded.select(F.col(id_col).alias("doc_id"), "ids")
    return map_arrow(narrow, decode, f"doc_id {id_type}, decoded string")
