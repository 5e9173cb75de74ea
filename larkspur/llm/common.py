"""What the operators of this package share: storage of intermediate tables and Arrow plumbing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import gathered, ship, stored

__all__ = ["BATCH_ROWS", "HELPER", "WORD_SEPARATORS", "gathered", "map_arrow", "stored", "table", "text_bytes", "text_hash"]

#: Rows that a function gets at a time. Texts may be long, so that is few: what a function makes of
#: them stays small, however large the batches are that Spark sends (64 MB at most by default).
BATCH_ROWS = 256

#: Separators of words, as a character class body: space, and tab to carriage return.
WORD_SEPARATORS = r"\x20\x09-\x0D"

#: Begins the names of columns that operators add for a while; no table's own column does.
HELPER = "_larkspur_helper"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What empties the caches that a worker's functions fill, and the function whose tasks it ran last.
_FORGET: list[Callable[[], None]] = []
_LAST: list[str] = []


def forgotten(*clear: Callable[[], None]) -> None:
    """Have workers call these when they turn to another function's tasks: they outlive a query."""
    _FORGET.extend(clear)


def turn_to(function: str) -> None:
    """In a worker, before a task of ``function``: drop what was kept for another one's tasks."""
    if _LAST != [function]:
        for clear in _FORGET:
            clear()
        _LAST[:] = [function]


def give_back() -> None:
    """Return the memory that a task has freed to the system; else idle workers hold their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """``mapInArrow`` by functions of this package, which get at most ``batch_rows`` rows at a time.

    Batches are cut where they arrive; the session's settings, which belong to its user, stay.
    """
    ship(df.sparkSession)
    function = uuid.uuid4().hex

    def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                yield batch.slice(at, batch_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(function)
        yield from fn(in_slices(batches))
        give_back()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty texts."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]



def text_hash(column: str = "text") -> Column:
    """A long that tells a document's texts apart; null counts as the empty text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))
