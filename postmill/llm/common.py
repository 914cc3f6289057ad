"""Text batches in tasks, word hashes, staged tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.session import staged

__all__ = ["bytes_of", "hash_words", "lower_ascii", "map_text", "mix", "read_table", "staged", "word_table"]

#: Bytes of text a task works on at a time; one longer text is taken alone.
SLICE_BYTES = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c) -> F.Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``most`` bytes of text, or of one row."""
    _, offsets = bytes_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return free memory to the system; a worker that waits for its next task then leaves room for the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in the C library of Linux only
    if trim:
        trim(0)


def map_text(df: DataFrame, text: str, keep: list[str], new: T.StructType | str, make: Callable[[], Callable]) -> DataFrame:
    """``keep`` columns of ``df`` and the ``new`` columns that a worker makes from the texts, row by row.

    ``make()`` runs once per task and returns a function from an Arrow text column to a list of Arrow
    arrays, one per new column. Columns of ``keep`` named as a new one give way to it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(new) if isinstance(new, str) else new
    keep = [k for k in keep if k not in new.names]
    rows = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("_text_in"))
    schema = T.StructType([*rows.schema.fields[:-1], *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, "_text_in"):
                made = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(work(part.column("_text_in")), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)
            batch = part = made = None
        del work
        give_back()

    return rows.mapInArrow(run, schema)


def word_table(not_words: list[tuple[int, int]]) -> np.ndarray:
    """For each byte, whether it belongs to a word: all but the given ranges, ends included."""
    table = np.ones(256, bool)
    for a, b in not_words:
        table[a : b + 1] = False
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows in order: 64-bit hash, row, first byte, end byte; and the lower-cased bytes.

    The hash is a polynomial of the bytes modulo 2^64 with an odd base, then mixed.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[data]
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, data
    lengths = ends - starts
    # only bytes of words, with their place in the word
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15 | 1, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows, starts, ends, data
