"""Dictionaries of any size: places of a text that may hold one of their words, and joins that tell which do.

A dictionary that is too large for every task is told to them as a filter of fixed size, three bits a word: no word of the
dictionary is missed by it, a few other strings pass (0.1 % at five million words).  What passes is joined with the dictionary, by its
different strings first, so that a frequent one meets it once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Bits of a filter as a power of two: 16 MB.
BITS = 27
#: Words, and bytes of them, that go to every task as they are.
TASK_WORDS, TASK_BYTES = 100_000, 4 << 20
#: Different strings that are joined by broadcast.
BROADCAST_ROWS = 200_000
#: A string is frequent if it has more than one in so many of the rows, and more than so many rows.
FREQUENT, FREQUENT_ROWS = 5_000, 10_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of parts of a string, each from two running sums."""

    def __init__(self, text: str) -> None:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.n = len(code)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * _powers(_BASE, self.n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, self.n)

    def of(self, start: np.ndarray, length) -> list[np.ndarray]:
        """Three numbers below 2 ** BITS for each part."""
        end = start + length
        h = _mix((self.sums[end] - self.sums[start]) * self.back[start] + np.asarray(length, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        low = np.uint64((1 << BITS) - 1)
        return [h & low, (h >> np.uint64(BITS)) & low, _mix(h) & low]


class Filter:
    """Which strings may be in a dictionary, and the lengths of its words."""

    def __init__(self, bits: np.ndarray, lengths: list[int]) -> None:
        self.bits, self.lengths = bits, sorted(lengths)

    def places(self, text: str, starts: np.ndarray) -> list[tuple[int, int]]:
        """(start, length) of strings at some of ``starts`` that pass, by start."""
        if not text or not len(starts):
            return []
        hashes, out = Hashes(text), []
        for n in self.lengths:
            at = starts[starts + n <= hashes.n]
            passed = np.ones(len(at), bool)
            for h in hashes.of(at, n):
                passed &= (self.bits[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
            out += [(int(a), n) for a in at[passed]]
        return sorted(out)


def listed(spark: SparkSession, words, shortest: int = 1, most: int = TASK_WORDS, size: int = TASK_BYTES) -> list[str] | DataFrame:
    """Different words of at least ``shortest`` characters, from a list or the first column of a DataFrame; nulls go.

    They come back as a list if they are few and short enough for every task, else as a stored table of one column, ``w``.
    """
    if not isinstance(words, DataFrame):
        words = list(dict.fromkeys(w for w in words or () if w is not None and len(w) >= shortest))
        if len(words) <= most and sum(len(w.encode("utf-8", "replace")) for w in words) <= size:
            return words
        words = spark.createDataFrame([(w,) for w in words], "w string")
    words = words.select(F.col(words.columns[0]).cast("string").alias("w")).where(F.length("w") >= shortest).distinct()
    words = stored(words, "words")
    told = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("w")), F.lit(0)).alias("size")).first()
    return [r["w"] for r in words.collect()] if told["n"] <= most and told["size"] <= size else words


def told(words: DataFrame) -> Filter:
    """The filter of a table of words; the driver gets its slots, which are 2 ** (BITS - 6) at most, and the different lengths."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            if length.sum():
                bits = np.unique(np.concatenate(Hashes("".join(texts)).of(np.cumsum(length) - length, length)))
                bit = np.uint64(1) << (bits & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int32)), pa.array(bit.view(np.int64))], ["slot", "bit"])

    slots = words.where("w <> ''").select("w").mapInArrow(run, "slot int, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[slots["slot"].to_numpy()] = slots["bit"].to_numpy().view(np.uint64)
    return Filter(bits, [r["n"] for r in words.where("w <> ''").select(F.length("w").alias("n")).distinct().collect()])


def among(rows: DataFrame, column: str, words: DataFrame, how: str = "left_semi", most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose string is a word of the table, or with ``left_anti`` those whose string isn't, nulls among them; rows is read several times.

    A string may hold any share of the rows: rows of frequent strings don't meet at one task.  Neither the table nor the different
    strings go through the driver, however small Spark takes their files to be.
    """
    here = rows.select(F.col(column).alias("w")).where("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("n"))
    found = stored(here.join(words.select("w", F.lit(True).alias("hit")).hint("merge"), "w", "left"), "hits")
    told = found.agg(F.count_if("hit").alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    hits = found.where("hit").select("w")
    if told["hits"] <= most:
        return rows.join(F.broadcast(hits), rows[column] == hits["w"], how)
    often = found.where(F.col("n") > max(FREQUENT_ROWS, told["rows"] / FREQUENT))
    some, wanted = rows.where(F.col(column).isNotNull()), "hit" if how == "left_semi" else "hit IS NULL"
    rare = some.join(F.broadcast(often), some[column] == often["w"], "left_anti").join(hits.hint("merge"), some[column] == hits["w"], how)
    out = rare.unionByName(some.join(F.broadcast(often.where(wanted)), some[column] == often["w"], "left_semi"))
    return out if how == "left_semi" else out.unionByName(rows.where(F.col(column).isNull()))


def starts(text: str, after: str) -> np.ndarray:
    """Places of a text that don't follow one of the characters from the first to the last of ``after``."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    free = np.ones(len(code), bool)
    free[1:] = (code[:-1] < ord(after[0])) | (code[:-1] > ord(after[-1]))
    return np.flatnonzero(free)
