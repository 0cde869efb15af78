"""Exact Jaccard self-join of shingle sets with signature trees: shingle count and component of each text.

1. Each text becomes its set of word shingles (48-bit hashes); equal sets (64-bit key and size) are one from there.
   Sets aren't stored: each step makes those that it needs from the texts again, which is cheaper than their space.
2. Two sets of similarity t share one of their first n - ceil(t n) + 1 shingles in any fixed order.  The
   order puts shingles known to be frequent last, so common passages seldom bring sets together.
3. For sets that share such a shingle, a signature tree finds those whose bitmaps and sizes allow a link,
   and leaves a spanning forest of them, never all pairs.
4. The components of the forests bring each possible group together once; a signature tree with exact
   intersections at its leaves finds all links, counts those of each set and leaves a spanning forest.  Groups beyond
   a bounded size are split into blocks of which every two meet in a task.

Keys are hashes: of 10**10 different sets about three pairs have the same 64 bits, and two sets of a thousand shingles share a 48-bit
hash by chance once in 10**8 pairs; nothing else is left to chance.

A null text counts as empty; a text without words has no shingle and is linked with nothing.  With fewer
words than a shingle the whole sequence is the one shingle.  Repeated rows are equal sets; a null id takes
part but never names a component unless all its ids are null.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import BLANK, fresh, gathered, lean, mix, ready, shingles, steps, stored, table, words
from .graph import components
from .signature_tree import Maps, bitmaps, linked, width

WIDTH, PERCENT = 4, 85
#: Rows of a batch that share a shingle before it may count as frequent, and rows in all; how many are told to the tasks.
OFTEN_HERE, OFTEN, OFTEN_MOST = 3, 64, 200_000
#: Sets and shingles that meet in one task.
GROUP_SETS, GROUP_TOKENS = 30_000, 2_000_000
#: Rows that are joined by broadcast.
BROADCAST_ROWS = 500_000
SMALL = 16
#: Sets that are handled at once where frequent shingles are counted and looked up.
ROWS = 3000
#: Tasks that the sets of a frequent shingle are dealt to.
SALTS = 64
#: Bytes of exact bitmaps of a group; larger groups compare lists.
EXACT_BYTES = 32 << 20
#: Rows of sorted groups that are handled at once, besides a larger group.
GROUPED = 8000
_MASK = np.uint64((1 << 48) - 1)


def least(percent: int, n):
    """Shingles that a set of n shares at least with a similar one."""
    return -(-percent * n // 100)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def sets_of(batches, k: int):
    """Of batches of (id, text): ids, keys, sizes, offsets and ascending shingles of their sets, step by step."""
    for batch in batches:
        for lo, hi in steps(batch.column(1)):
            h, row, _, _ = words(batch.column(1)[lo:hi], BLANK)
            s, at = shingles(h, row, k)
            both = np.unique(at.astype(np.uint64) << np.uint64(48) | s & _MASK)
            row, s = (both >> np.uint64(48)).astype(np.int64), both & _MASK
            offsets = np.searchsorted(row, np.arange(hi - lo + 1))
            n = np.diff(offsets)
            sums = np.r_[np.uint64(0), np.cumsum(mix(s + np.uint64(1)))]
            key = mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64)).view(np.int64)
            yield batch.column(0)[lo:hi], key, n, offsets, s.view(np.int64)


def rows_of(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles of sets ``at``, and their offsets."""
    n = offsets[at + 1] - offsets[at]
    ends = np.r_[0, np.cumsum(n)]
    return np.repeat(offsets[at] - ends[:-1], n) + np.arange(ends[-1]), ends


class Fresh:
    """Tells which keys of a partition come for the first time, as far as it remembers."""

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        self.wanted, self.seen = wanted, set()

    def places(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.wanted is not None:
            at = np.flatnonzero(n > 0)
            if not len(self.wanted):
                return at[:0]
            at = at[self.wanted[np.minimum(np.searchsorted(self.wanted, key[at]), len(self.wanted) - 1)] == key[at]]
        else:
            at = np.flatnonzero(n > 0)
        if len(self.seen) > 300_000:
            self.seen.clear()
        new = []
        for i, k in zip(at.tolist(), key[at].tolist(), strict=True):
            if k not in self.seen:
                self.seen.add(k)
                new.append(i)
        return np.array(new, np.int64)


def packed(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Bitmap of each set, of a width by its size."""
    n = np.diff(offsets)
    bits = width(n)
    out = [b""] * len(n)
    for w in np.unique(bits).tolist():
        at = np.flatnonzero(bits == w)
        some = tokens[np.repeat(offsets[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())]
        for i, m in zip(at.tolist(), bitmaps(some, np.r_[0, np.cumsum(n[at])], w), strict=True):
            out[i] = m.tobytes()
    return out


def overview(docs: DataFrame, k: int) -> DataFrame:
    """Rows (id, key, n) of all texts and, with a null n, rows (token, c) of shingles that some stretch of texts has often."""

    def run(batches):
        fresh, held, rows = Fresh(), [], 0

        def often():
            t = np.concatenate(held) if held else np.zeros(0, np.int64)
            t.sort()
            head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]][: len(t)])
            c = np.diff(np.r_[head, len(t)])
            t, c = t[head][c >= OFTEN_HERE], c[c >= OFTEN_HERE]
            none = pa.nulls(len(t), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(t), pa.int32()), pa.array(t), pa.array(c)], ["id", "key", "n", "token", "c"])

        for ids, key, n, offsets, s in sets_of(batches, k):
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(key), pa.array(n, pa.int32()), none, none], ["id", "key", "n", "token", "c"])
            at = fresh.places(key, n)
            held.append(s[rows_of(offsets, at)[0]])
            rows += len(at)
            if rows >= ROWS:
                yield often()
                held, rows = [], 0
        yield often()

    return docs.mapInArrow(lean(run), "id long, key long, n int, token long, c long")


def frequent(seen: DataFrame) -> np.ndarray:
    """Shingles seen often, rarest first.  Any choice gives the same result; this one keeps groups small."""
    seen = seen.where("n IS NULL").groupBy("token").agg(F.sum("c").alias("c"))
    rows = seen.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(OFTEN_MOST).toArrow()
    return rows.sort_by([("c", "ascending"), ("token", "ascending")])["token"].to_numpy()


def prefixes(docs: DataFrame, k: int, often: np.ndarray, percent: int) -> DataFrame:
    """(token, salt, key, n) of the shingles that each set is looked up by; frequent ones are salted by the set."""
    told = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        fresh = Fresh()
        rank = np.argsort(told.value)
        often_sorted = told.value[rank]
        for _, key, n, offsets, s in sets_of(batches, k):
            at = fresh.places(key, n)
            place, ends = rows_of(offsets, at)
            t, key, n = s[place], key[at], n[at]
            row = np.repeat(np.arange(len(at)), n)
            salt = np.zeros(len(t), np.int32)
            if len(often_sorted):
                order = t.copy()
                place = np.minimum(np.searchsorted(often_sorted, t), len(often_sorted) - 1)
                hit = often_sorted[place] == t
                order[hit] = (1 << 48) + rank[place[hit]]
                salt[hit] = 1 + (mix(key[row[hit]].view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
                order = np.lexsort((order, row))
                t, salt = t[order], salt[order]
            keep = np.arange(len(t)) - np.repeat(ends[:-1], n) < np.repeat(n - least(percent, n) + 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(salt[keep]), pa.array(key[row[keep]]), pa.array(n[row[keep]], pa.int32())], ["token", "salt", "key", "n"])

    return docs.mapInArrow(lean(run), "token long, salt int, key long, n int")


def again(docs: DataFrame, k: int, keys: DataFrame, bits: bool) -> DataFrame:
    """(key, n, bits or tokens) of the sets whose keys ``keys`` has, at most a few rows for each set and partition.

    Up to BROADCAST_ROWS keys go to the tasks; for more, all sets are made and joined.
    """
    keys = stored(keys.select("key").distinct(), "keys")
    few = keys.count() <= BROADCAST_ROWS
    told = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow()["key"].to_numpy()) if few else None)
    name, kind = ("bits", "binary") if bits else ("tokens", "array<long>")

    def run(batches):
        fresh = Fresh(told.value)
        for _, key, n, offsets, s in sets_of(batches, k):
            at = fresh.places(key, n)
            place, ends = rows_of(offsets, at)
            column = pa.array(packed(s[place], ends), pa.binary()) if bits else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s[place]))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(n[at], pa.int32()), column], ["key", "n", name])

    made = docs.mapInArrow(lean(run), f"key long, n int, {name} {kind}")
    return made if few else made.join(keys, "key")


def shared(rows: DataFrame, percent: int) -> DataFrame:
    """Of (token, salt, key, n), distinct rows (token, key, n) of the tokens that several sets of like size have.

    In order of size, a set has a partner of like size only if its neighbour is one.  Salted tokens, whose sets lie in
    several tasks, are frequent: all their sets stay.
    """

    def run(batches):
        last, sent = None, False  # the last row so far, and whether it went out
        for batch in batches:
            t, s, k, n = (np.asarray(c) for c in batch.columns)
            if not len(t):
                continue
            if last is not None:
                t, s, k, n = np.r_[last[0], t], np.r_[last[1], s], np.r_[last[2], k], np.r_[last[3], n]
            new = np.r_[True, (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (k[1:] != k[:-1])]
            t, s, k, n = t[new], s[new], k[new], n[new].astype(np.int64)
            near = np.r_[False, (t[1:] == t[:-1]) & (100 * n[:-1] >= percent * n[1:])]
            keep = near | np.r_[near[1:], False] | (s > 0)
            last, now = (t[-1], s[-1], k[-1], n[-1]), bool(keep[-1]) or (sent and len(t) == 1)
            if sent:
                keep[0] = False
            sent = now
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(k[keep]), pa.array(n[keep], pa.int32())], ["token", "key", "n"])

    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key").mapInArrow(lean(run), "token long, key long, n int")


def once(members: DataFrame) -> DataFrame:
    """Of tokens with the very same sets, the rows of one: near copies share most of theirs."""
    who = [F.xxhash64("key", "n"), F.xxhash64("n", "key", F.lit(1))]
    groups = members.groupBy("token").agg(F.count("*").alias("c"), *(F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(who)))
    return members.join(groups.groupBy("c", "h0", "h1").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")


def spread(rows: DataFrame, group: str, weight, most: int, of: str) -> DataFrame:
    """Adds the block ``own`` and columns i and j: groups of more than ``most`` are cut into blocks by ``of``, each two of which meet."""
    big = rows.groupBy(group).agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks")).where("blocks > 1")
    if big.isEmpty():
        return rows.withColumns({"own": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    cut = rows.join(big, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(of), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def groups(batches, width: int, rows: int):
    """Rows of sorted batches in runs of whole groups, which agree in the first ``width`` columns."""
    rest = None
    for batch in gathered(batches, rows):
        now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        differs = np.zeros(len(now) - 1, bool)
        for c in now.columns[:width]:
            x = c.to_numpy()
            differs |= x[1:] != x[:-1]
        edge = np.flatnonzero(differs)
        if not len(edge):
            rest = now
            continue
        cut = int(edge[-1]) + 1
        rest = now.slice(cut)
        yield now.slice(0, cut).combine_chunks(), np.r_[0, edge + 1]
    if rest is not None:
        yield rest.combine_chunks(), np.array([0, len(rest)])


def possible_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each shared shingle, a spanning forest of the sets that signatures don't keep apart."""

    def run(batches):
        for rows, ends in groups(batches, 3, GROUPED):
            key, n = rows["key"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
            maps = Maps(rows["bits"].to_pylist())
            size = np.diff(ends)
            a, b = [], []
            small = np.flatnonzero(size <= SMALL)
            root = np.arange(len(key))
            for d in range(1, SMALL):  # pairs of places that are d apart in their small groups
                some = small[size[small] > d]
                if not len(some):
                    break
                each = size[some] - d
                i = np.repeat(ends[some], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                i = i[100 * n[i] >= percent * n[i + d]]
                i = i[maps.possible(n, i, i + d, percent)]
                a.append(i)
                b.append(i + d)
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            while True:  # the smallest place reached becomes the root of each
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                root = root[root]
                if (before == root).all():
                    break
            for g in np.flatnonzero(size > SMALL).tolist():
                lo, hi = int(ends[g]), int(ends[g + 1])
                found = maps.linked(n, lo, hi, percent)
                root[lo:hi] = [lo + found.root(x) for x in range(hi - lo)]
            i = np.flatnonzero(root != np.arange(len(root)))
            pairs = np.unique(np.stack([key[i], key[root[i]]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = members.select("token", "i", "j", "n", "key", "bits").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "key")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def exact_links(members: DataFrame, percent: int, pairs: bool = False) -> DataFrame:
    """(a, b, links, both) by key; members has root, own, i, j, n, key, rows, tokens, with repeats.

    Rows with b are a spanning forest of the true links of each group, or, with ``pairs``, all of them with the size of
    the intersection; rows without b have in ``links`` the rows of the sets that a set is linked with, in parts.  Where two blocks of a group
    meet, links inside one of them don't count: they do where the block meets itself.
    """

    def run(batches):
        for rows, ends in groups(batches, 3, GROUPED // 8):
            key, n, own_block, many = (rows[c].to_numpy().astype(np.int64) for c in ("key", "n", "own", "rows"))
            i_block, j_block = rows["i"].to_numpy(), rows["j"].to_numpy()
            lists = rows["tokens"].combine_chunks() if isinstance(rows["tokens"], pa.ChunkedArray) else rows["tokens"]
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, at = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            out = [[], [], [], []]
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = lo + np.flatnonzero(np.r_[True, (key[lo + 1 : hi] != key[lo : hi - 1]) | (n[lo + 1 : hi] != n[lo : hi - 1])])
                if len(own) < 2:
                    continue
                tokens = [flat[at[x] : at[x + 1]] for x in own]
                every, offsets = np.concatenate(tokens), np.r_[0, np.cumsum(n[own])]
                block = own_block[own] if i_block[lo] != j_block[lo] else None
                found = Found(every, offsets, percent, many[own], block, pairs)
                bits = int(width(np.median(n[own]), 4096))
                forest = linked(n[own], bitmaps(every, offsets, bits), percent, found, every_pair=True)
                k = key[own]
                if pairs:
                    a, b, both = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found.pairs, strict=True)) if found.pairs else (np.zeros(0, np.int64),) * 3
                    parts = k[a], k[b], np.zeros(len(a), np.int64), both
                else:
                    root = np.array([forest.root(x) for x in range(len(own))])
                    a = np.flatnonzero(root != np.arange(len(own)))
                    parts = k[a], k[root[a]], np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                for into, x in zip(out, parts, strict=True):
                    into.append(x)
                some = np.flatnonzero(found.links)
                for into, x in zip(out, (k[some], None, found.links[some], np.zeros(len(some), np.int64)), strict=True):
                    into.append(np.full(len(some), -1) if x is None else x)
            a, b, links, both = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=links > 0), pa.array(links), pa.array(both)], ["a", "b", "links", "both"])

    rows = members.select("root", "i", "j", "n", "key", "own", "rows", "tokens").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "n", "key")
    return rows.mapInArrow(lean(run), "a long, b long, links long, both long")


class Found:
    """Exact tests of the leaves of a signature tree, which counts each link that it finds."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, percent: int, rows: np.ndarray, block: np.ndarray | None, pairs: bool) -> None:
        self.n, self.percent, self.rows, self.block = np.diff(offsets), percent, rows, block
        self.links, self.pairs, self.keep = np.zeros(len(rows), np.int64), [], pairs
        # tokens numbered in the group give bitmaps without collisions; rare ones can't be in an intersection
        used, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
        common = np.cumsum(times > 1) - 1
        bits = -(-max(1, int((times > 1).sum())) // 64) * 64
        self.maps = None
        if len(rows) * bits // 8 <= EXACT_BYTES:
            row = np.repeat(np.arange(len(rows)), self.n)
            held = times[place] > 1
            at = common[place[held]]
            self.maps = np.zeros((len(rows), bits // 64), np.uint64)
            np.bitwise_or.at(self.maps, (row[held], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        else:
            self.lists = [tokens[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs i < j are linked."""
        if self.maps is not None:
            both = np.empty(len(i), np.int64)
            step = max(1, (1 << 20) // self.maps.shape[1])
            for lo in range(0, len(i), step):
                both[lo : lo + step] = np.bitwise_count(self.maps[i[lo : lo + step]] & self.maps[j[lo : lo + step]]).sum(1, dtype=np.int64)
        else:
            both = np.array([len(np.intersect1d(self.lists[x], self.lists[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        ok = 100 * both >= self.percent * (self.n[i] + self.n[j] - both)
        new = ok if self.block is None else ok & (self.block[i] != self.block[j])
        np.add.at(self.links, i[new], self.rows[j[new]])
        np.add.at(self.links, j[new], self.rows[i[new]])
        if self.keep:
            self.pairs.append((i[new], j[new], both[new]))
        return ok


def keyed(docs: DataFrame, k: int, text_col: str = "text", into: tuple[str, str] = ("_set", "_n")) -> DataFrame:
    """``docs`` with the set of each text: its key and its size, in two more columns."""
    ready(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at, key, n, _, _ in sets_of([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(len(names))], ["id", "text"])], k):
                part = batch.slice(at[0].as_py(), len(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(key), pa.array(n, pa.int32())], [*names, *into])

    schema = StructType([*docs.schema, StructField(into[0], LongType()), StructField(into[1], IntegerType())])
    return docs.select(*names, F.col(text_col).alias(fresh())).mapInArrow(lean(run), schema)


def linked_sets(docs: DataFrame, k: int, percent: int, pairs: bool = False) -> tuple[DataFrame, ...]:
    """Of docs (id, text): (id, key, n) of each row; (key, n, first, rows) of each set with its smallest id and its rows; (node, root) of the
    keys of linked sets; (key, others) with the rows of other sets that a set is linked with; with ``pairs``, (a, b, both) of all links.
    """
    if not 50 <= percent <= 100:
        raise ValueError("The signature trees compare bitmaps of neighbouring widths, which takes 50 percent at least.")
    ready(docs.sparkSession)
    seen = stored(overview(docs, k), "sets")
    sets = seen.where("n IS NOT NULL").select("id", "key", "n")
    distinct = stored(sets.where("n > 0").groupBy("key", "n").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "distinct")

    members = stored(shared(prefixes(docs, k, frequent(seen), percent), percent), "members")
    members = stored(once(members), "once")
    signed = again(docs, k, members, True).groupBy("key", "n").agg(F.first("bits").alias("bits"))
    plausible = components(possible_links(spread(members, "token", F.lit(1), GROUP_SETS, "key").join(signed, ["key", "n"]), percent))

    called = plausible.select(F.col("node").alias("key"), "root").join(distinct, "key").select("root", "key", "n", "rows")
    called = spread(stored(called, "called"), "root", F.col("n"), GROUP_TOKENS, "key")
    few = called.count() <= BROADCAST_ROWS
    tokens = again(docs, k, called, False).join(F.broadcast(called) if few else called, ["key", "n"])
    links = stored(exact_links(tokens, percent, pairs), "links")
    joined = components(links.where("b IS NOT NULL").select("a", "b"))
    others = links.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("others"))
    return sets, distinct, joined, others, links.where("b IS NOT NULL").select("a", "b", "both")


def jaccard_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id_col, _set, _n, root, rows) of the distinct ids of each set, with a key of the set's component and the number of rows."""
    sets, _, joined, _, _ = linked_sets(texts(docs, id_col, text_col), k, percent)
    rows = sets.groupBy("id", "key", "n").agg(F.count("*").alias("rows")).join(joined, F.col("key") == joined["node"], "left")
    return rows.select(F.col("id").alias(id_col), F.col("key").alias("_set"), F.col("n").alias("_n"), F.coalesce("root", "key").alias("root"), "rows")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id, n_links) of each row; sets link when 100 * overlap >= percent * union.

    n_links is the number of other rows that a row is linked with, those with an equal set included.
    """
    sets, distinct, joined, others, _ = linked_sets(texts(docs, id_col, text_col), k, percent)
    named = joined.join(distinct.select(F.col("key").alias("node"), "first"), "node")
    name = named.groupBy("root").agg(F.min("first").alias("component"))
    by_set = distinct.join(joined, distinct["key"] == joined["node"], "left").join(name, "root", "left").join(others, "key", "left")
    by_set = by_set.select("key", "n", F.coalesce("component", "first").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = sets.join(by_set, ["key", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links between different sets (left_id, right_id, similarity), by the smallest id of each set, and (id_col, set_id) of each row with words."""
    sets, distinct, _, _, links = linked_sets(texts(docs, id_col, text_col), k, percent, True)
    end = lambda key, name: distinct.select(F.col("key").alias(key), F.col("first").alias(f"{name}_id"), F.col("n").alias(f"_{name}"))
    both = links.join(end("a", "left"), "a").join(end("b", "right"), "b")
    pairs = both.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), (F.col("both") / (F.col("_left") + F.col("_right") - F.col("both"))).alias("similarity"))
    return pairs, sets.where("n > 0").join(distinct, ["key", "n"]).select(F.col("id").alias(id_col), F.col("first").alias("set_id"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
