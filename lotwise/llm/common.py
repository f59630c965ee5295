"""Shared helpers of the training-data operators: shared checkpoints, Arrow text buffers, word hashing.

Text crosses into Python as Arrow batches; helpers here read its UTF-8 bytes in place, in slices of
bounded size, so that a task's memory does not depend on the length of its partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.graph import components, shared_checkpoint  # noqa: F401

#: Bytes of text that one numpy step works on; its temporaries are a small multiple of this.
SLICE_BYTES = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_M64 = (1 << 64) - 1


#: A setting of Spark's: bytes of a batch that Python gets. Its default of 64 MB counts several times in an executor's memory.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder; what Python reads of it comes in batches of 4 MB, unless the session says otherwise."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
        batch = None
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and n+1 offsets; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 1 << 16), _BASE, np.uint64)
            grown[0] = 1
            _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end]: differences of one running polynomial, brought to a common power."""
    p = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, np.uint64)
        # highest power first, so that shifting to a common place is one multiplication
        np.cumsum((mixed_bytes()[raw]) * p[: len(raw)], out=run[1:])
        inverse = pow(_BASE, -1, 1 << 64)
        back = inverse_powers(len(raw) + 1, inverse)
        h = (run[ends] - run[starts]) * back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _MUL)


_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int, inverse: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 1 << 16), inverse, np.uint64)
            grown[0] = 1
            _inverse = np.multiply.accumulate(grown)
    return _inverse[:n]


_bytes: np.ndarray | None = None


def mixed_bytes() -> np.ndarray:
    """One 64-bit value for each byte."""
    global _bytes
    if _bytes is None:
        with np.errstate(over="ignore"):
            _bytes = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MUL)
    return _bytes


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` of lower-cased bytes, and each document's first word index (n+1)."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~space
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1]
    first = np.array(inside & ~before)
    first[cut] |= inside[cut]  # a document's first byte starts a word
    starts = np.flatnonzero(first[:-1]) if len(raw) else np.zeros(0, np.int64)
    last = np.zeros(len(raw) + 1, bool)
    last[1:] = inside[:-1] & ~inside[1:]
    ends_cut = offsets[1:]
    last[ends_cut] |= before[ends_cut]
    last[0] = False
    ends = np.flatnonzero(last) if len(raw) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of an A-Z-lower-cased text, ``SLICE_BYTES`` of it at a time; a slice ends between words."""
    at = 0
    while at < len(raw):
        gap = _WHITE.search(raw, at + SLICE_BYTES)
        stop = gap.start() if gap else len(raw)
        yield raw[at:stop].lower().split()
        at = stop


_WHITE = re.compile(rb"[ \t-\r]")


class WordHashes(dict):
    """64 bits of BLAKE2 for each word, which no run of like words can make collide. Bounded: cleared when full, and long words are not kept."""

    MOST, LONGEST = 500_000, 64

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = h
        return h


_hashes = WordHashes()


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of A-Z-lower-cased texts, and each document's first word (n+1)."""
    known, found, ends = _hashes.__getitem__, [np.zeros(0, np.uint64)], [0]
    for raw in column.cast(pa.binary()).to_pylist():
        n = 0
        for words_ in word_lists(raw or b""):
            found.append(np.fromiter(map(known, words_), np.uint64, len(words_)))
            n += len(words_)
        ends.append(ends[-1] + n)
    return np.concatenate(found), np.array(ends)
