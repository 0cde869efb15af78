"""Substring dedup: windows of words that stood in an earlier document are removed, found by super-k-mer partitioning.

The minimiser of a window of ``WINDOW`` words is the smallest hash of the ``SEED``-word sequences in it.  Consecutive
windows share it for a while; such a run, a super-k-mer, travels as one string of words to the bucket of its minimiser,
to which every other copy of its windows goes as well.  A bucket sorts its windows and gives each the smallest document
id.  Sorting is by a hash of the window, and neighbours are compared word by word; where hashes should ever collide the
bucket is sorted by the words themselves.

Documents are first stored in blocks of a few megabytes.  A block sends each different super-k-mer once, however many
of its documents hold it, so a text that is repeated everywhere is one string for each block in its bucket and never
one for each copy.  A bucket answers each block, and the block removes words from all its own copies: nothing is joined
or grouped by anything that can be frequent.  The number of buckets follows the bytes of all texts.

Every window is judged on the input.  A null text has no words; a document with fewer words than a window has no
windows.  A null id counts as larger than every other one.  Rows that repeat an id don't remove anything from each other, and
each has a row in the result.  A very long text is a block of its own.  Further columns, whatever their names, aren't read.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, ready, stored, table

WINDOW, SEED = 13, 4
#: Bytes of text in a block, and of packed words in a bucket; what a document counts besides its text.
BLOCK, BUCKET, ROW = 4 << 20, 8 << 20, 16
#: Words that a bucket gets for each word of the texts, about.
SPREAD = 3.5
LAST = (1 << 63) - 1
_M = np.uint64(0xD6E8FEB86659FD93)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of many documents each: block, ids, sizes (bytes of each text), body (all texts, compressed) and bytes."""
    names = ["block", "ids", "sizes", "body", "bytes"]

    def run(batches):
        task, made, held, total = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids = pa.concat_arrays([i for i, _ in held])
            texts = [t for _, ts in held for t in ts]
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(list(map(len, texts)), pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), *lists, pa.array([body], pa.binary()), pa.array([sum(map(len, texts))], pa.int64())], names)

        for batch in batches:
            texts, lo = batch.column(1).cast(pa.binary()).to_pylist(), 0
            for i, t in enumerate(texts):
                if total and total + len(t) + ROW > BLOCK:
                    held.append((batch.column(0)[lo:i], texts[lo:i]))
                    yield block()
                    made, held, total, lo = made + 1, [], 0, i
                total += len(t) + ROW
            held.append((batch.column(0)[lo:], texts[lo:]))
        if sum(len(i) for i, _ in held):
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "block long, ids array<long>, sizes array<long>, body binary, bytes long")


class Runs:
    """The words of texts and their super-k-mers, equal ones numbered alike in order of their first place."""

    def __init__(self, texts: pa.Array, window: int, seed: int) -> None:
        # characters that split: space and \x09 to \x0D
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten()
        some = pc.greater(pc.binary_length(words), 0)
        total = np.r_[0, np.cumsum(np.asarray(some))]
        ends = total[np.asarray(split.offsets) - split.offsets[0].as_py()]
        self.words = words.filter(some)
        self.first, self.row = ends[:-1], np.repeat(np.arange(len(texts)), np.diff(ends))
        n = len(self.words)
        told = pc.dictionary_encode(self.words)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in told.dictionary.to_pylist()), np.uint64, len(told.dictionary))
        h = hashes[np.asarray(told.indices)] if n else np.zeros(0, np.uint64)
        some = max(0, n - window + 1)
        self.start, self.size, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        strings: list[bytes] = []
        if some:
            part = h[: n - seed + 1].copy()
            for j in range(1, seed):
                part = part * _M + h[j : n - seed + 1 + j]
            part = mix(part)
            least, at = part[:some].copy(), np.arange(some)
            for j in range(1, window - seed + 1):
                lower = part[j : some + j] < least
                least[lower] = part[j : some + j][lower]
                at[lower] = np.flatnonzero(lower) + j
            whole = self.row[:some] == self.row[window - 1 :]
            new = whole.copy()
            new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
            self.start = np.flatnonzero(new)
            self.size = np.bincount(np.cumsum(new)[whole] - 1, minlength=len(self.start)) if len(self.start) else self.size
            self.least = least[self.start]
            places = np.r_[0, np.cumsum(np.asarray(pc.binary_length(self.words), np.int64) + 1)]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), self.words), " ")[0].as_buffer().to_pybytes()
            strings = [joined[a : b - 1] for a, b in zip(places[self.start].tolist(), places[self.start + self.size + window - 1].tolist(), strict=True)]
        told = pc.dictionary_encode(pa.array(strings, pa.large_binary()))
        self.number, self.strings = np.asarray(told.indices, np.int64), told.dictionary
        self.once = np.unique(self.number, return_index=True)[1]  # a place of each different one


def _texts(row_body: bytes, sizes: np.ndarray) -> pa.Array:
    body = zstandard.ZstdDecompressor().decompress(row_body)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(body))


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, LAST), np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def packed(rows: DataFrame, buckets: int, window: int, seed: int) -> DataFrame:
    """A row for each block and bucket: numbers of its super-k-mers, their smallest and largest ids, and their words, compressed."""
    names = ["bucket", "block", "numbers", "low", "high", "words"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, sizes, body = (batch.column(c)[i] for c in range(4))
                runs = Runs(_texts(body.as_py(), np.asarray(sizes.values)), window, seed)
                if not len(runs.start):
                    continue
                of = _ids(ids.values)[runs.row[runs.start]]
                low, high = np.full(len(runs.strings), LAST), np.full(len(runs.strings), -LAST - 1)
                np.minimum.at(low, runs.number, of)
                np.maximum.at(high, runs.number, of)
                bucket = (mix(runs.least[runs.once]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                bounds = np.r_[first, len(order)]
                sorted_ = runs.strings.take(pa.array(order)).to_pylist()
                press = zstandard.ZstdCompressor(level=3)
                words = [press.compress(b"\n".join(sorted_[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = [_lists(x[order], bounds, k) for x, k in ((np.arange(len(order)), pa.int32()), (low, pa.int64()), (high, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block.as_py()] * len(found), pa.int64()), *lists, pa.array(words, pa.binary())], names)

    return rows.select("block", "ids", "sizes", "body").mapInArrow(lean(run), "bucket int, block long, numbers array<int>, low array<long>, high array<long>, words binary")


def earliest(low: np.ndarray, strings: pa.Array, window: int, seed: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each window of strings of words, in order, and the bounds of each string's windows."""
    split = pc.ascii_split_whitespace(strings)
    codes = np.asarray(pc.dictionary_encode(split.flatten()).indices, np.int64)
    ends = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    size = np.diff(ends) - window + 1
    bounds = np.r_[0, np.cumsum(size)]
    of = np.repeat(np.arange(len(size)), size)
    start = np.arange(bounds[-1]) + np.repeat(ends[:-1] - bounds[:-1], size)
    value = mix(codes.astype(np.uint64) + np.uint64(seed))
    h = value[start]
    for j in range(1, window):
        h = h * _M + value[start + j]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    pair = np.flatnonzero(same)
    a, b = start[order[pair]], start[order[pair + 1]]
    if any((codes[a + j] != codes[b + j]).any() for j in range(window)):
        order = np.lexsort([codes[start + j] for j in range(window)])
        same = np.logical_and.reduce([codes[start[order[1:]] + j] == codes[start[order[:-1]] + j] for j in range(window)])
    head = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(low[of[order]], head) if len(order) else low[:0]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[head, len(order)]))
    return out, bounds


def answered(parcels: DataFrame, window: int) -> DataFrame:
    """For each block and bucket: numbers of the super-k-mers that have a window of an earlier document, and the smallest ids of their windows.

    Takes rows that lie together and sorted by bucket; one bucket is in memory at a time.
    """
    names = ["block", "numbers", "least"]

    def answer(rows: list[dict]):
        press = zstandard.ZstdDecompressor()
        low, high = (np.concatenate([np.asarray(r[c].values) for r in rows]) for c in ("low", "high"))
        joined = b"\n".join(press.decompress(r["words"].as_py()) for r in rows).decode()
        least, bounds = earliest(low, pc.split_pattern(pa.array([joined], pa.large_string()), "\n").flatten(), window)
        hit = least < np.repeat(high, np.diff(bounds))
        total = np.r_[0, np.cumsum(hit)]
        told = total[bounds[1:]] > total[bounds[:-1]]
        at = 0
        for r in rows:
            n = len(r["numbers"].values)
            mine = np.flatnonzero(told[at : at + n]) + at
            if len(mine):
                values = np.concatenate([least[bounds[k] : bounds[k + 1]] for k in mine])
                numbers = np.asarray(r["numbers"].values)[mine - at]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"].as_py()], pa.int64()), _lists(numbers, np.array([0, len(mine)]), pa.int32()), _lists(values, np.array([0, len(values)]), pa.int64())], names)
            at += n

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from answer(held)
                    held = []
                held.append(row)
        if held:
            yield from answer(held)

    dealt = parcels.repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(lean(run), "block long, numbers array<int>, least array<long>")


def removed(runs: Runs, ids: np.ndarray, answers: list, window: int) -> np.ndarray:
    """Which words of a block go: a window goes if a document with a smaller id has it too."""
    sizes = np.zeros(len(runs.strings), np.int64)
    sizes[runs.number] = runs.size
    place, flat, at = np.full(len(sizes), -1), [], 0
    for numbers, least in answers:
        inner = sizes[numbers]
        place[numbers] = at + np.cumsum(inner) - inner
        flat.append(least)
        at += len(least)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    have = np.flatnonzero(place[runs.number] >= 0)
    size = runs.size[have]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    start = np.repeat(runs.start[have], size) + inner
    gone = start[flat[np.repeat(place[runs.number[have]], size) + inner] < ids[runs.row[start]]]
    change = np.zeros(len(runs.words) + 1, np.int64)
    np.add.at(change, gone, 1)
    np.add.at(change, gone + window, -1)
    return np.cumsum(change)[:-1] > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id_col, n_words, removed, text) of each row: runs of removed words (first and last, from 0), and the kept words joined by spaces."""
    ready(docs.sparkSession)
    rows = stored(blocks(docs, id_col, text_col), "blocks")
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = stored(answered(packed(rows, max(4 * parts, int(size * SPREAD) // BUCKET), window, seed), window), "answers")
    told = answers.groupBy("block").agg(F.collect_list(F.struct("numbers", "least")).alias("answers"))
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, body, found = (batch.column(c)[i] for c in range(4))
                runs = Runs(_texts(body.as_py(), np.asarray(sizes.values)), window, seed)
                lists = [] if found.values is None else [(np.asarray(x["numbers"].values), np.asarray(x["least"].values)) for x in found.values]
                gone = removed(runs, _ids(ids.values), lists, window)
                n = len(ids.values)
                left = np.bincount(runs.row[~gone], minlength=n)
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)], pa.int32()), runs.words.filter(pa.array(~gone))), " ")
                edge = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (runs.row[1:] != runs.row[:-1])]) if len(gone) else np.zeros(0, np.int64)
                stop = np.flatnonzero(gone & np.r_[~gone[1:] | (runs.row[1:] != runs.row[:-1]), True]) if len(gone) else edge
                spans = pa.StructArray.from_arrays([pa.array(x - runs.first[runs.row[edge]], pa.int64()) for x in (edge, stop)], fields=list(span))
                many = np.bincount(runs.row[edge], minlength=n)
                counts = pa.array(np.bincount(runs.row, minlength=n), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, counts, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), spans), kept], [id_col, "n_words", "removed", text_col])

    whole = rows.join(told, "block", "left").select("ids", "sizes", "body", "answers")
    return whole.mapInArrow(lean(run), f"`{id_col}` long, n_words long, removed array<struct<first:long,last:long>>, `{text_col}` string")


def op12_substring_dedup(spark, sf_dir):
    docs = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return docs.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS words FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
g AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY words) AS least FROM s) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM g),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
