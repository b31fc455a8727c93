"""Shared pieces: run-scoped tables, byte-level word scanning and vectorised hashing.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; because UTF-8 never uses those
bytes inside a longer character, scanning bytes gives the same words as scanning characters.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored as stored

U64 = np.uint64
#: Text bytes that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20


class Sent:
    """A broadcast object whose class travels with it, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, thing: object):
        self.bytes, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(thing)), None

    def __getstate__(self) -> dict:
        return {"bytes": self.bytes, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = pickle.loads(self.bytes.value)
        return self.held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, k: int):
    """``crc32(col as text) mod k``; null ids fall outside every remainder (null)."""
    return F.crc32(F.col(col).cast("string")) % k


# ---------------------------------------------------------------- Arrow batches of texts


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array with nulls read as empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a large_string array, without a copy."""
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str, size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch of about ``size`` text bytes (one row at least), each with its texts,
    nulls read as empty."""
    column = strings(batch.column(batch.schema.get_field_index(text)))
    ends = raw(column)[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), column.slice(at, to - at)
        at = to


# ---------------------------------------------------------------- words and hashes

#: True for the bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible odd 64-bit coefficients."""
    with np.errstate(over="ignore"):
        at = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
        return mix(at) | U64(1)


_COEFFICIENTS = stream(0x5EED, 4096)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
    """Start, end and document of each word, and each document's first word (n+1 entries)."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x5EED) -> np.ndarray:
    """A 64-bit hash of each word: a multilinear form over its bytes, then a finaliser. Hashes of two
    seeds are independent."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(before, lengths)
    longest = int(lengths.max())
    by = _COEFFICIENTS if longest <= len(_COEFFICIENTS) and seed == 0x5EED else stream(seed, longest)
    inside = data[place + np.repeat(starts, lengths)].astype(U64)
    sums = np.add.reduceat((inside + U64(1)) * by[place], before)
    return mix(sums + lengths.astype(U64) * U64(0x9E3779B97F4A7C15))


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int, seed: int = 1):
    """Hash and position of each run of n words within one document.

    Positions index ``hashes``; a document with fewer than n words has none.
    """
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    by = stream(seed * 7919 + n, n)
    out = np.zeros(m, U64)
    for j in range(n):
        out += hashes[j : j + m] * by[j]
    ok = np.ones(m, bool)
    for j in range(1, n):  # a run must not cross into the next document
        at = bounds[1:-1] - j
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at
