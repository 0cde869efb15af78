"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut only where the splitting pattern must end a match in any case, so ids are those of
the whole text.  Long runs of white space, on which the library's regular expression overflows its
stack, are one match of the pattern and go to the merges directly.

Nulls count as empty and give an empty list; repeated rows and further columns pass through.  Texts are
independent of each other, so the work is one map over the partitions without any shuffle.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import lean, ready, steps, table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a chunk of a long text.
CHUNK = 1 << 16
#: Bytes of text, and rows of ids, of an Arrow batch that goes back to Spark.
STEP, ROWS = 512 << 10, 100
#: White space from which on a run is split off.
RUN = 256
_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_RUN = regex.compile(rf"\s{{{RUN},}}")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str):
    """(text, whether it is one match) in order; cuts lie where the pattern's matches end.

    A run of white space before another character is a match without its last character, which may
    belong to the next match; at the end of the text the whole run is a match.
    """
    at = 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield from chunks(text, at, m.start())
        yield text[m.start() : end], True
        at = end
    yield from chunks(text, at, len(text))


def chunks(text: str, at: int, end: int):
    while end - at > CHUNK:
        m = _SAFE.search(text, at + CHUNK, end)
        if m is None or m.start() >= end:
            break
        yield text[at : m.start()], False
        at = m.start()
    if at < end:
        yield text[at:end], False


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= RUN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece, whole in pieces(text):
        out += enc._encode_single_piece(piece) if whole else enc.encode_ordinary(piece)
    return out


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of its text column, in place of a column of that name, in any case."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "ids"]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("ids", ArrayType(IntegerType()))])
    at = kept.index(text)

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for lo, hi in steps(batch.column(at), STEP):
                part = batch.slice(lo, hi - lo)
                found = [np.array(encode_text(enc, t), np.int32) if t else np.zeros(0, np.int32) for t in part.column(at).to_pylist()]
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*kept, "ids"])

    return docs.select(*kept).mapInArrow(lean(run), schema)


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``decoded`` (binary), the bytes that ids stand for; null gives null, an unknown id is an error."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "decoded"]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("decoded", BinaryType())])
    at = kept.index(ids)

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                found = [None if x is None else enc.decode_bytes(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*kept, "decoded"])

    return docs.select(*kept).mapInArrow(lean(run), schema)


def byte_bpe(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (binary), replacing columns of these names, in any case, in one pass."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    at = kept.index(text)

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for lo, hi in steps(batch.column(at), STEP):
                part = batch.slice(lo, hi - lo)
                found = [encode_text(enc, t) if t else [] for t in part.column(at).to_pylist()]
                back = pa.array([enc.decode_bytes(x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32())), back], [*kept, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(lean(run), schema)


def op10_byte_bpe(spark, sf_dir):
    docs = byte_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
