"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 drawn from its code point.  A three-letter sequence is the
product of its letters' vectors, permuted (rotated) by their places; a text is the sum of its sequences'
vectors, a language the sum over its texts.  A text is of the language whose vector has the largest
cosine with it.  Words are padded with a mark for their edge, and the whole text counts.

Learning is one pass that leaves a vector for each language and partition, summed by Spark; predicting is
a second pass without a shuffle.  Text that is null or has no letter gives ``und`` and score 0.  A tie
goes to the first language in alphabetical order.  Without any learnable row every text gives ``und``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, lean, ready, steps, table

DIM = 1024
SEED = 20240229
UNKNOWN = "und"
STEP = 256 << 10
#: Sequences whose vectors a Python worker remembers.
REMEMBERED = 24_000
#: Sequences that are multiplied at once.
PART = 1024
#: The mark for what isn't a letter.
EDGE = 0


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=100_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)


class Profiles:
    """Vectors of three-letter sequences, made when first met, in one table that never grows."""

    def __init__(self) -> None:
        self.table = np.empty((REMEMBERED, DIM), np.int8)
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows_of(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the table for ascending distinct codes, REMEMBERED at most."""
        place = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = place < len(self.codes)
        known[inside] = self.codes[place[inside]] == codes[inside]
        new = codes[~known]
        if len(new):
            if len(self.codes) + len(new) > REMEMBERED:
                self.codes, self.rows, new = self.codes[:0], self.rows[:0], codes
            first, mask = len(self.codes), (1 << 21) - 1
            for j, c in enumerate(new.tolist(), first):
                self.table[j] = np.roll(letter_vector(c >> 42), 2) * np.roll(letter_vector(c >> 21 & mask), 1) * letter_vector(c & mask)
            every = np.r_[self.codes, new]
            order = np.argsort(every)
            self.codes, self.rows = every[order], np.r_[self.rows, np.arange(first, first + len(new))][order]
            place = np.searchsorted(self.codes, codes)
        return self.rows[place]

    def sum(self, codes: np.ndarray, counts: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """``counts`` (one column for each code) times the vectors, a part of the table at a time; ``rows`` of the codes if they are known."""
        out = np.zeros((len(counts), DIM), np.float32)
        for lo in range(0, len(codes), PART):
            rows_ = self.rows_of(codes[lo : lo + PART]) if rows is None else rows[lo : lo + PART]
            out += counts[:, lo : lo + PART].astype(np.float32) @ self.table[rows_].astype(np.float32)
        return out


@functools.lru_cache(maxsize=1)
def profiles() -> Profiles:
    return Profiles()


def sequences(texts: pa.Array):
    """(distinct codes ascending, index of each sequence's code, row of each sequence) of lower-case texts."""
    listed = [t or "" for t in texts.to_pylist()]
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    code = np.frombuffer(" ".join([*listed, " "]).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(listed) + 1), np.r_[lengths + 1, 1])
    code = np.where(letters()[code], code, EDGE)
    near = np.r_[True, (code[1:] != EDGE) | (code[:-1] != EDGE)]  # of a run of other characters one stays
    code, row = np.r_[EDGE, code[near]], np.r_[0, row[near]]
    mid = code[1:-1] != EDGE
    used, dense = np.unique(code, return_inverse=True)
    n, d = len(used), dense.reshape(-1)
    key = (d[:-2] * n + d[1:-1]) * n + d[2:]
    key, row = key[mid], row[1:-1][mid]
    if n**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(key, minlength=1))
        index = np.zeros(n**3, np.int32)
        index[seen] = np.arange(len(seen))
        index = index[key]
    else:
        seen, index = np.unique(key, return_inverse=True)
    codes = used[seen // (n * n)] << 42 | used[seen // n % n] << 21 | used[seen % n]
    return codes, index, row


def bundles(texts: pa.Array) -> np.ndarray:
    """A vector for each text: rows of zeros for those without letters."""
    codes, index, row = sequences(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    rows = profiles().rows_of(codes) if len(codes) <= REMEMBERED else None
    for i in np.flatnonzero(np.diff(edges)):
        count = np.bincount(index[edges[i] : edges[i + 1]])
        at = np.flatnonzero(count)
        out[i] = profiles().sum(codes[at], count[at][None], None if rows is None else rows[at])[0]
    return out


def sums(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The sum of the vectors of each language's texts, over every row of ``docs`` with a language and a text."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in steps(batch.column(0), STEP):
                codes, index, row = sequences(batch.column(0)[lo:hi])
                langs, of = np.unique(np.array(batch.column(1)[lo:hi].to_pylist(), dtype=object).astype(str), return_inverse=True)
                if not len(index):
                    continue
                counts = np.bincount(of[row].astype(np.int64) * len(codes) + index, minlength=len(langs) * len(codes)).reshape(len(langs), -1)
                for name, v in zip(langs.tolist(), profiles().sum(codes, counts), strict=True):
                    total[name] = total.get(name, 0) + v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    ready(docs.sparkSession)
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.lower(text).alias("text"), F.col(lang).alias("lang"))
    parts = known.mapInArrow(lean(run), "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("at", "x"))
    rows = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).orderBy("lang", "at").collect()  # DIM numbers for each language
    found: dict[str, list[float]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["x"])
    return {k: np.array(v) for k, v in found.items()}


def of_length_one(vectors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v / np.linalg.norm(v) for k, v in vectors.items() if np.any(v)}


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A vector for each language, from every row of ``docs`` with a language and a text."""
    return of_length_one(sums(docs, text, lang))


def predict(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of each row with the language and the score, in two more columns ``into``."""
    ready(docs.sparkSession)
    names = sorted(model)
    matrix = np.array([model[k] for k in names], np.float32).reshape(len(names), DIM)
    kept = docs.select(*keep)
    schema = StructType([*kept.schema, StructField(into[0], StringType()), StructField(into[1], DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in steps(texts, STEP):
                v = bundles(texts[lo:hi])
                norm = np.linalg.norm(v, axis=1)
                none = norm == 0
                if names:
                    cos = (v @ matrix.T) / np.where(none, 1, norm)[:, None]
                    best = cos.argmax(1)
                    score = np.where(none, 0, np.clip(cos[np.arange(len(v)), best], 0, 1)).astype(np.float64)
                    said = [UNKNOWN if no else names[b] for no, b in zip(none, best, strict=True)]
                else:
                    score, said = np.zeros(len(v)), [UNKNOWN] * len(v)
                columns = [c[lo:hi] for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), pa.array(score)], [*keep, *into])

    return docs.select(*keep, F.lower(F.coalesce(F.col(text), F.lit(""))).alias(fresh())).mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = learn(docs.where(~out).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")
