"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A document is cut into every window as long as a benchmark item (a shorter document is one window).  A
window's fingerprint is the SimHash of its word shingles, weighted by how often they occur.  Fingerprints
of 64 bits are looked up by blocks: of two within ``RADIUS`` bits, one of ``BLOCKS`` blocks differs in at
most RADIUS // BLOCKS bits, so probing those neighbours of each block finds all of them.  Candidates are
then held to their exact weighted Jaccard similarity.  Windows with too few shingles that any item has
cannot reach the similarity and get no fingerprint; that loses nothing.  What is similar enough but lies beyond
``RADIUS`` is lost: the tests measure that against an exact search.

Words are runs of letters and digits of the lower-cased text; items and windows of fewer words than a
shingle count as one shingle.  Null and empty texts and items without words match nothing, and an item
without an id isn't looked for, since nothing could name it; of windows alike to an item the first of the highest similarity is told; repeated rows
each get their answer; an empty table gives an empty result.  The items are searched in blocks of bounded
size, so no broadcast grows with the benchmark; each block of 8 MB is one more pass over the texts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import PUNCT, fresh, lean, mix, ready, steps, stored, table, words

WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
#: Bytes of item text in one block of items.
ITEM_BYTES = 8 << 20
#: Blocks of items whose indexes are held at once.
PASSES = 4
LEAK = ArrayType(StructType([StructField("item_id", LongType()), StructField("first_word", IntegerType()), StructField("n_words", IntegerType()), StructField("similarity", DoubleType()), StructField("distance", IntegerType()), StructField("passage", StringType())]))
_NEAR = [[v for v in range(256) if (v ^ x).bit_count() <= RADIUS // BLOCKS] for x in range(256)]


def row_shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes at each word of one row; fewer words than k give none."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
    return mix(s + np.uint64(k))


def bits(s: np.ndarray) -> np.ndarray:
    return np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Eight block values for each row of sums of 64 signs."""
    return np.packbits(sums > 0, axis=1)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum((a & b).values())
    return low / max(1, a.total() + b.total() - low)


class Index:
    """Items by shingle width and size, each group with a table for each block of the fingerprint."""

    def __init__(self, items: list[tuple[int, np.ndarray]], k: int = WORDS, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.groups: dict[tuple[int, int], list] = defaultdict(list)
        known: dict[int, set[int]] = defaultdict(set)
        self.sizes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, h in items:
            if len(h):
                width = min(k, len(h))
                s = row_shingles(h, width)
                known[width].update(s.tolist())
                for x in s.tolist():
                    self.sizes[width][x].add(len(h))
                self.groups[width, len(h)].append((item_id, Counter(s.tolist()), fingerprints(bits(s).sum(0, keepdims=True))[0]))
        self.known = {w: np.array(sorted(x), np.uint64) for w, x in known.items()}
        self.need = {w: min(self.required(n - v + 1) for v, n in self.groups if v == w) for w in known}
        self.sizes = {w: dict(x) for w, x in self.sizes.items()}
        self.tables = {}
        for key, group in self.groups.items():
            tables = [defaultdict(list) for _ in range(BLOCKS)]
            for i, (_, _, print_) in enumerate(group):
                for b in range(BLOCKS):
                    tables[b][int(print_[b])].append(i)
            self.tables[key] = tables

    def required(self, m: int) -> int:
        """Shingles that a window shares at least with a similar item of m shingles."""
        return max(1, math.ceil(self.similarity * m - 1e-9))

    def near(self, key: tuple[int, int], print_: np.ndarray):
        """(place in the group, distance) of all items within the radius."""
        tables, group = self.tables[key], self.groups[key]
        for i in sorted({i for b in range(BLOCKS) for v in _NEAR[print_[b]] for i in tables[b].get(v, ())}):
            distance = int(np.bitwise_count(group[i][2] ^ print_).sum())
            if distance <= RADIUS:
                yield i, distance

    def hits(self, h: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
        """Rows with enough shingles that an item has."""
        s = row_shingles(h, width)
        sorted_ = self.known[width]
        place = np.minimum(np.searchsorted(sorted_, s), len(sorted_) - 1)
        hit = (sorted_[place] == s) & (row[: len(s)] == row[len(h) - len(s) :])
        rows, count = np.unique(row[: len(s)][hit], return_counts=True)
        return rows[count >= self.need[width]]

    def leaks(self, h: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """The best window for each item that a row of words holds: item, first word, words, similarity, distance."""
        best: dict[int, tuple] = {}
        for width, sorted_ in self.known.items():
            s = row_shingles(h, width)
            if not len(s):
                continue
            hit = sorted_[np.minimum(np.searchsorted(sorted_, s), len(sorted_) - 1)] == s
            places: dict[int, list[int]] = defaultdict(list)  # by item size, where a shingle of such an item stands
            for p in np.flatnonzero(hit).tolist():
                for size in self.sizes[width][int(s[p])]:
                    places[size].append(p)
            signs = None
            for size, at in sorted(places.items()):
                key, need, m = (width, size), self.required(size - width + 1), min(size - width + 1, len(s))
                if len(at) < need:
                    continue
                total = np.zeros(len(s) + 1, np.int64)
                total[np.array(at) + 1] = 1
                total = np.cumsum(total)
                for p in np.flatnonzero(total[m:] - total[:-m] >= need).tolist():
                    if signs is None:
                        signs = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits(s), 0, dtype=np.int32)])
                    window = None
                    for i, distance in self.near(key, fingerprints((signs[p + m] - signs[p])[None])[0]):
                        window = window or Counter(s[p : p + m].tolist())
                        item_id, counts, _ = self.groups[key][i]
                        like = weighted_jaccard(window, counts)
                        if like >= self.similarity - 1e-9 and (item_id not in best or like > best[item_id][3]):
                            best[item_id] = (item_id, p, m + width - 1, like, distance)
        return [best[i] for i in sorted(best)]


def item_blocks(items: DataFrame, id_col: str, text_col: str):
    """Items with text in blocks of about ITEM_BYTES, each small enough to broadcast."""
    used = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))
    total = used.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / ITEM_BYTES))
    for b in range(n):
        rows = used.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).orderBy("id").collect() if n > 1 else used.orderBy("id").collect()
        if rows:
            yield [(r["id"], words(pa.array([r["text"]]), PUNCT)[0]) for r in rows]


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = WORDS, similarity: float = SIMILARITY, into: str = "leaks") -> DataFrame:
    """``docs`` with a column ``into``, in place of one of that name: item, place, similarity, fingerprint distance and passage of the best window of each item found.

    Of a column that differs from ``into`` in case only, ``into`` takes the place too.  Every block of items is a pass over the texts; after
    ``PASSES`` of them what was found is stored and their indexes are let go.
    """
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    low, leaks, more = fresh("low"), fresh("leaks"), fresh("more")
    schema = StructType([*(docs.schema[c] for c in kept), StructField(low, StringType()), StructField(leaks, LEAK), StructField(more, LEAK)])
    out = docs.select(*kept, F.lower(F.coalesce(F.col(text), F.lit(""))).alias(low), F.array().cast(LEAK).alias(leaks))
    held = []
    for number, block in enumerate(item_blocks(items, item_id, item_text), 1):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, k, similarity))
        held.append(index)

        def run(batches, index=index):
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64()), ("distance", pa.int32()), ("passage", pa.string())]))
            for batch in batches:
                for lo, hi in steps(batch.column(len(kept))):
                    part = batch.slice(lo, hi - lo)
                    texts = part.column(len(kept))
                    h, row, first, end = words(texts, PUNCT)
                    found: list[list[dict]] = [[] for _ in range(len(texts))]
                    for i in sorted({i for w in index.value.known for i in index.value.hits(h, row, w).tolist()}):
                        a, b = np.searchsorted(row, [i, i + 1])
                        if best := index.value.leaks(h[a:b]):
                            raw, base = texts[i].as_py().encode(), _start(texts, i)
                            shift, stop = first[a:b] - base, end[a:b] - base
                            found[i] = [dict(zip(("item_id", "first_word", "n_words", "similarity", "distance", "passage"), (*x, raw[shift[x[1]] : stop[x[1] + x[2] - 1]].decode()), strict=True)) for x in best]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*kept, low, leaks, more])

        out = out.mapInArrow(lean(run), schema).withColumn(leaks, F.concat(leaks, more)).drop(more)
        if number % PASSES == 0:
            out = stored(out, "leaks")
            for x in held:
                x.unpersist()
            held = []
    return out.drop(low).withColumnRenamed(leaks, into)


def _start(texts: pa.Array, i: int) -> int:
    """First byte of text i, counted from the first text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    return int(offsets[texts.offset + i]) - int(offsets[texts.offset])


def op4_decontaminate(spark, sf_dir):
    found = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
