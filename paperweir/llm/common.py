"""Shared pieces of the corpus operators: tables, shared storage, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship
from ..storage import shared_dir, stored

#: Bytes of text that one vectorised step handles; a longer text is one step of its own.
STEP_BYTES = 512 << 10
#: Rows of an Arrow batch, and of a batch that is read from Parquet.
BATCH_ROWS, READ_ROWS = 500, 512
BATCH_BYTES = 8 << 20

#: The characters [\x20\x09-\x0D].
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def ready(spark: SparkSession) -> SparkSession:
    """Ships the package, and keeps batches of whole texts small, in Parquet and in Arrow, where the session hasn't said how large they are."""
    sizes = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", BATCH_BYTES),
        "spark.sql.parquet.columnarReaderBatchSize": ("4096", READ_ROWS),
    }
    for key, (usual, size) in sizes.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, str(size))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(label: str = "c") -> str:
    """A column name that no table has."""
    return f"_{label}_{uuid.uuid4().hex}"


def lean(run):
    """``run`` for mapInArrow, handing memory back to the system at the end of each task: idle workers stay small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def gathered(batches, rows: int):
    """Arrow batches joined to about ``rows`` rows, and larger ones cut to it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            held.append(batch.slice(lo, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64 on unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _byte(seed: int) -> np.ndarray:
    """A random 64-bit integer for each byte."""
    return mix(np.arange(256 * seed + 1, 256 * seed + 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_LOW = np.uint64(0x2545F4914F6CDD1D) ** np.arange(4096, dtype=np.uint64)
_STEP = _LOW[-1:] * _LOW[1:2]


def separators(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


BLANK = separators(BLANKS)
#: Everything in ASCII but letters and digits; bytes of other characters belong to words.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def steps(texts: pa.Array, size: int = STEP_BYTES):
    """Yields (first, last) row ranges of about ``size`` bytes."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def words(texts: pa.Array, blank: np.ndarray = BLANK, seed: int = 0, lower: bool = True):
    """Words of a column, ASCII letters lower-cased if so asked: (hash uint64, row, first byte, end byte) of each, in order.

    Byte positions are relative to the first text; nulls count as empty.
    """
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(offs[0]), int(offs[-1])) if len(texts) else (0, 0)
    if hi == lo:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    offs = offs - lo
    inside = ~blank[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    first, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(first):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    length = end - first
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    value = _byte(seed)[_LOWER[buf[inside]] if lower else buf[inside]] * _LOW[place & 4095]
    if len(place) and int(length.max()) > 4096:
        value *= _STEP ** (place >> 12).astype(np.uint64)
    h = mix(np.add.reduceat(value, at) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, np.searchsorted(offs, first, "right") - 1, first, end


def shingles(h: np.ndarray, row: np.ndarray, k: int):
    """Hashes of the k-word shingles and the row of each; a row of fewer words gives its whole sequence as one."""
    n = len(h)
    m = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        if n >= k:
            s = h[: n - k + 1].copy()
            for j in range(1, k):
                s = s * m + h[j : n - k + 1 + j]
            whole = row[: n - k + 1] == row[k - 1 :]
            s, at = mix(s[whole] + np.uint64(k)), row[: n - k + 1][whole]
        else:
            s, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n:
            head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[head, n])
            for i, c in zip(head[size < k], size[size < k], strict=True):
                x = h[i]
                for j in range(1, c):
                    x = x * m + h[i + j]
                s, at = np.append(s, mix(np.atleast_1d(x + np.uint64(c)))), np.append(at, row[i])
    return s, at
