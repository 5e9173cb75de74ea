"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of every text: at each byte it is a sum over the last 16
bytes, each weighted by a power of two, modulo 2^16. A chunk may end where the hash's 4 highest
bits are zero and a character ends; it has ``MIN_CHUNK`` to ``MAX_CHUNK`` bytes. Whether a place is
a cut depends on its near past only, so after an insertion the cuts soon are the same as before.
Chunks are compared by 128-bit digests over all documents.

A digest that occurs in two documents or more is a repeat; what only one document repeats isn't.
Neighbouring repeated chunks of a document form a run, and runs of at least ``MIN_RUN`` bytes are
reported: a shorter one may be a chance agreement of common words. A chunk is kept in the document
with the least doc_id, wherever it stands there: a run is reported in parts where first and later
documents change, and ``is_first`` tells which a part is.

All chunks are compared; a digest in a third of all documents is counted before the shuffle, and
its occurrences are joined by a join that Spark may split. Null and empty texts have no chunks.
Rows without doc_id can't be addressed and are left out. Rows with one doc_id and one text are one
document; other texts of that doc_id are other documents with the same name. Further columns have
no effect, and ``deduplicated`` carries them along. An empty table gives an empty result. Positions
are bytes of UTF-8, ends exclusive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELPER, map_arrow, text_bytes, text_hash

MIN_CHUNK, MAX_CHUNK = 24, 256
#: Bits that must be zero at a cut: cuts are possible at one place in 2^CUT_BITS.
CUT_BITS = 4
MIN_RUN = 96
#: Gear values of the 256 bytes, by a rule: the low half of the byte's XXH32.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=42) & 0xFFFF for b in range(256)], np.uint16)
_BLOCK = 1 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 16 bytes that end there; ``MIN_CHUNK`` isn't less."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint16(k)
        h = wider
    return h


def chunk_bounds(texts: list[bytes]) -> list[list[int]]:
    """For each text the places where chunks begin and end, from 0 to its length."""
    data = b"".join(texts)
    array = np.frombuffer(data + b"\0", np.uint8)
    starts_character = (array & 0xC0) != 0x80
    cut = (gear_hashes(array[:-1]) >> np.uint16(16 - CUT_BITS)) == 0
    places = np.flatnonzero(cut & starts_character[1:]) + 1
    ends = np.cumsum([len(t) for t in texts])
    upto = np.searchsorted(places, ends)
    out, first, begin = [], 0, 0
    for end, last in zip(ends.tolist(), upto.tolist()):
        bounds, at = [0], begin
        for place in [*places[first:last].tolist(), end]:
            while place - at > MAX_CHUNK:
                at += MAX_CHUNK
                while not starts_character[at]:
                    at += 1
                bounds.append(at - begin)
            if place - at >= MIN_CHUNK or (place == end and place > at):
                bounds.append(place - begin)
                at = place
        out.append(bounds)
        first, begin = last, end
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, size, high, low``: the chunks of each text with their digests."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    digest = xxhash.xxh3_128_digest

    def blocks(batches):
        for batch in batches:
            rows, ids, size = [], [], 0
            for k, text in enumerate(text_bytes(batch.column(2))):
                rows.append(text)
                ids.append(k)
                size += len(text)
                if size >= _BLOCK:
                    yield batch, ids, rows
                    rows, ids, size = [], [], 0
            if rows:
                yield batch, ids, rows

    def cut(batches):
        for batch, ids, rows in blocks(batches):
            owner, start, size, digests = [], [], [], []
            for k, text, bounds in zip(ids, rows, chunk_bounds(rows)):
                n = len(bounds) - 1
                owner += [k] * n
                start += bounds[:-1]
                size += [b - a for a, b in zip(bounds, bounds[1:])]
                digests += [digest(text[a:b]) for a, b in zip(bounds, bounds[1:])]
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(owner),
                    "text_hash": batch.column(1).take(owner),
                    "start": pa.array(start, pa.int32()),
                    "size": pa.array(size, pa.int32()),
                    "high": pa.array(halves[:, 0]),
                    "low": pa.array(halves[:, 1]),
                }
            )

    schema = f"doc_id {id_type}, text_hash long, start int, size int, high long, low long"
    rows = docs.filter("doc_id is not null").select("doc_id", text_hash().alias("text_hash"), "text")
    return map_arrow(rows, cut, schema)


def _parts(docs: DataFrame, min_run: int) -> DataFrame:
    """``doc_id, text_hash, start, end, n_chunks, first_doc_id, is_first``: the parts of all runs."""
    # Chunking again costs less than writing all chunks would.
    every = chunks(docs)
    known = (
        every.groupBy("high", "low")
        .agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("last"))
        .filter("of <> last")
        .drop("last")
    )
    met = every.join(known, ["high", "low"]).select(
        "doc_id", "text_hash", "start", (F.col("start") + F.col("size")).alias("end"), "of", (F.col("doc_id") == F.col("of")).alias("own")
    ).distinct()
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    begins = F.coalesce(F.col("start") != F.lag("end").over(order), F.lit(True))
    changes = begins | F.coalesce(F.col("own") != F.lag("own").over(order), F.lit(True))
    marked = met.withColumns({"begins": begins.cast("int"), "changes": changes.cast("int")})
    runs = marked.withColumns({"run": F.sum("begins").over(order), "part": F.sum("changes").over(order)})
    whole = Window.partitionBy("doc_id", "text_hash", "run")
    return (
        runs.withColumn("long", F.max("end").over(whole) - F.min("start").over(whole) >= min_run)
        .filter("long")
        .groupBy("doc_id", "text_hash", "run", "part")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.min("of").alias("first_doc_id"),
            F.min("own").alias("is_first"),
        )
        .drop("run", "part")
    )


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, start, end, n_chunks, n_bytes, first_doc_id, is_first``: the runs of chunks that
    other documents have as well. ``first_doc_id`` is the least document that has one of them."""
    return _parts(docs, min_run).select(
        "doc_id", "start", "end", "n_chunks", (F.col("end") - F.col("start")).alias("n_bytes"), "first_doc_id", "is_first"
    )


def deduplicated(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The same rows and columns; parts of runs that occurred before are cut from ``text``."""
    spans = _parts(docs, min_run).filter("not is_first").groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    ).toDF(*(f"{HELPER}_{x}" for x in ("of", "hash", "spans")))
    same = (docs["doc_id"] == spans[f"{HELPER}_of"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == spans[f"{HELPER}_hash"])
    both = docs.join(spans, same, "left").select(docs["*"], spans[f"{HELPER}_spans"])

    def rewrite(batches):
        for batch in batches:
            k, s = batch.schema.get_field_index("text"), batch.num_columns - 1
            texts = []
            for text, cuts in zip(text_bytes(batch.column(k)), batch.column(s).to_pylist()):
                out, at = [], 0
                for span in cuts or ():
                    out.append(text[at : span["start"]])
                    at = span["end"]
                texts.append(b"".join([*out, text[at:]]).decode())
            kind = batch.schema.field(k).type
            made = pa.array(
                [t if v else None for t, v in zip(texts, batch.column(k).is_valid().to_pylist())], kind
            )
            yield pa.RecordBatch.from_arrays(
                [made if i == k else batch.column(i) for i in range(s)],
                [batch.schema.field(i).name for i in range(s)],
            )

    return map_arrow(both, rewrite, docs.schema)
