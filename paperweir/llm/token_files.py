"""Token files: Parquet with one list of ids for each document, in ascending id order across the files.

Ids are dictionary-encoded (a vocabulary fits one dictionary page), document ids and lengths
delta-encoded; row groups and pages are small enough that the page index lets a reader skip to single
documents, and lengths can be read without any ids.

The tokenizer drops white space, so each distinct word of a stretch of text is encoded once and its ids
are copied to every place where it stands; the result is that of encoding the whole text.

A null text counts as empty and gives just the end id.  Rows that repeat an id stand beside each other,
in order of a hash of their text.  An empty table gives files without rows.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import lean, ready, shared_dir, steps, stored, table, words

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words that a Python worker remembers; beyond it, it forgets all.
REMEMBERED = 3_000_000
STEP = 2 << 20
#: Words that are encoded in one call.
TOGETHER = 500
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
SCHEMA = "doc_id long, n_tokens long, ids array<int>"


class WordEncoder:
    """Ids of words by hash, each distinct word encoded once by the library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, spelled: list[str]) -> None:
        """Encodes words.  Those of letters only go together: each gives one token that ends a word, its last."""
        count = np.zeros(len(spelled), np.int64)
        plain = np.fromiter((w.isalpha() for w in spelled), bool, len(spelled))
        flat: list[np.ndarray] = []
        for group in np.array_split(np.flatnonzero(plain), max(1, plain.sum() // TOGETHER)):
            text = " ".join([spelled[i] for i in group])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(group) or (len(ids) and last[-1] != len(ids) - 1):
                plain[group] = False
                continue
            count[group] = np.diff(last, prepend=-1)
            flat.append(ids)
        order = np.flatnonzero(plain)
        rest = np.flatnonzero(~plain)
        found = [e.ids for e in self.library.encode_batch_fast([spelled[i] for i in rest], add_special_tokens=False)]
        count[rest] = np.fromiter(map(len, found), np.int64, len(found))
        flat.append(np.fromiter((i for ids in found for i in ids), np.int32, int(count[rest].sum())))
        order = np.r_[order, rest]
        keys, count = keys[order], count[order]
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, *flat])
        keys, first, count = np.r_[self.keys, keys], np.r_[self.first, first], np.r_[self.count, count]
        order = np.argsort(keys)
        self.keys, self.first, self.count = keys[order], first[order], count[order]

    def encode(self, texts: pa.Array, end_id: int | None) -> pa.ListArray:
        h, row, first, end = words(texts, lower=False)  # an added token is one only as it is spelled
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + len(keys) > REMEMBERED:
                self.forget()
                known[:] = False
            raw = "".join(x or "" for x in texts.to_pylist()).encode()
            self.learn(keys[~known], [raw[first[i] : end[i]].decode() for i in at[~known]])
            place = np.searchsorted(self.keys, keys)
        start, count = self.first[place][inverse], self.count[place][inverse]
        tail = end_id is not None
        per_row = np.bincount(row, count, len(texts)).astype(np.int64) + tail
        offsets = np.r_[0, np.cumsum(per_row)]
        total = np.cumsum(count) - count
        ids = self.flat[np.repeat(start - total, count) + np.arange(int(count.sum()))]
        out = np.full(int(offsets[-1]), end_id or 0, np.int32)
        keep = np.ones(len(out), bool)
        if tail:
            keep[offsets[1:] - 1] = False
        out[keep] = ids
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row, in the order of the rows."""
    ready(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for batch in batches:
            for lo, hi in steps(batch.column(1), STEP):
                ids = encoder(path).encode(batch.column(1)[lo:hi], end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(ids.offsets), pa.int64()), ids], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lean(run), SCHEMA)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = END_ID, files: int | None = None) -> None:
    """Writes token files whose names ascend with the ids that they hold."""
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(id_col), F.xxhash64(text_col)]
    dealt = docs.select(id_col, text_col).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    encode(dealt, id_col, text_col, vocabulary, end_id).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of token files with the file and the row's number in it."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return files.select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: ids before the row.  Sums within a file, and over the totals of the files before it.

    ``rows`` has file, row and n_tokens.  The totals are a row for each file, so their running sum is small.
    """
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # Spark pads the numbers of its files to five digits, so names of more don't sort as their numbers do
    number = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    before = totals.select("file", (F.sum("total").over(Window.orderBy(number, "file")) - F.col("total")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inner", inner).join(before, "file").withColumn("start", F.col("before") + F.col("inner")).drop("before", "inner")


def with_crc32(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Replaces the list of ids by n_tokens and ids_crc32, the unsigned crc32 of its little-endian 32-bit integers."""
    ready(rows.sparkSession)
    kept = [c for c in rows.columns if c not in (ids, "n_tokens")]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())], [*kept, "n_tokens", "ids_crc32"])

    return rows.select(*kept, ids).mapInArrow(lean(run), schema)


def op6_token_files(spark, sf_dir):
    path = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    rows = read_tokens(spark, path)
    return with_starts(stored(with_crc32(rows), "sums")).select("doc_id", "start", "n_tokens", "ids_crc32")
