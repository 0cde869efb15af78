"""Toxicity by the nearest labelled examples: exact TF-IDF cosine of passages with a block-max inverted index.

Labelled rows are examples: of each class those with the smallest hash of their id, at most ``EXAMPLES`` rows
and ``EXAMPLE_BYTES`` bytes of text (the only sample; classes weigh in the votes as often as they occur among
all labels, and equal texts are one example, toxic if any is).  Examples and texts are cut into passages of
three words, for a few words among thousands make a text toxic.  Every word of the examples counts, with its
inverse document frequency over the whole corpus; words that no example has have no dimension.

Passages share one, two or three words, and the index has a list of postings for each word, pair and triple,
in blocks with the largest weights of this and all later blocks.  A block is read only if these weights
can still reach the nearest examples so far, or ``RADIUS``, so the neighbours are those of a full search:
the ``NEAREST`` examples (each by its best passage) of a cosine of at least RADIUS.  Among equal cosines those that
come first in the index count.  Votes by cosine, drawn towards the share of toxic rows as by ``PULL``
more votes, give each passage a value; the largest of a text, and how many passages it has, become its
score by a logistic curve fitted on the examples themselves, each scored without its own passages.
The nearest examples of that passage are the evidence.

Words are runs of letters and digits of the lower-cased text (64-bit hashes).  Null and empty texts and texts without
known words get the curve's value for the plain share.  Null ids or labels are never examples, repeated labels
of one id count once (toxic if any says so), and so does an id that repeats in the table.  Without examples
of both classes every score is the share of the class there is (0 without labels).  An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import PUNCT, fresh, lean, ready, steps, stored, table, words

#: Bounds of the sample of each class.
EXAMPLES, EXAMPLE_BYTES = 2048, 4 << 20
#: Words of a passage.
PASSAGE = 3
RADIUS, NEAREST, BLOCK = 0.4, 25, 32
PULL = 5.0
#: Passages that are searched at once.
PASSAGES = 20_000
EVIDENCE = ArrayType(StructType([StructField("doc_id", LongType()), StructField("similarity", DoubleType()), StructField("toxic", LongType())]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def place_of(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the ascending ``known``, -1 for others."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def passages(texts: pa.Array, known: np.ndarray):
    """(text of each passage, its words' places in ``known``, -1 for others) of passages with a known word."""
    h, row, _, _ = words(texts, PUNCT)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, PASSAGE), np.int64)
    inside = np.arange(len(row)) - np.searchsorted(row, row)
    new = np.flatnonzero(inside % PASSAGE == 0)
    out = np.full((len(new), PASSAGE), -1, np.int64)
    out[np.cumsum(inside % PASSAGE == 0) - 1, inside % PASSAGE] = place_of(known, h)
    some = (out >= 0).any(1)
    return row[new][some], out[some]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first .. first + size - 1 of each, in a row."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending hashes
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list[int] = field(default_factory=list)  # of examples
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: tuple[float, float] = (1.0, 1.0)  # of a vote for 0 and for 1
    share: float = 0.0
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)  # of the value's log-odds, of the logarithm of passages, constant
    lists: list = field(default_factory=list)  # for one, two and three words: keys, first block of each, last weights, ..

    def vectors(self, places: np.ndarray):
        """Passages as ascending distinct words (-1 for none, last) and weights of a length of one."""
        at = np.sort(np.where(places < 0, len(self.words), places), axis=1)
        times = np.zeros(at.shape)
        first = np.concatenate([np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1]], 1)
        for j in range(PASSAGE):
            times[:, j] = (at == at[:, j : j + 1]).sum(1)
        used = first & (at < len(self.words))
        weight = np.where(used, (1 + np.log(times)) * np.r_[self.idf, 0][at], 0)
        at = np.where(used, at, len(self.words))
        order = np.argsort(at, axis=1, kind="stable")
        at, weight = np.take_along_axis(at, order, 1), np.take_along_axis(weight, order, 1)
        norm = np.sqrt((weight**2).sum(1, keepdims=True))
        return np.where(at < len(self.words), at, -1), (weight / np.where(norm > 0, norm, 1)).astype(np.float32)

    def combinations(self, at: np.ndarray, weight: np.ndarray, size: int):
        """(passage, key, weights) of the words, pairs or triples of passages; keys of pairs and triples build on smaller ones.

        Those too light to reach the radius on their own are left out.
        """
        found = []
        for some in itertools.combinations(range(PASSAGE), size):
            w = weight[:, some]
            use = np.flatnonzero((at[:, some] >= 0).all(1) & ((w**2).sum(1) >= (RADIUS - 1e-6) ** 2))
            key = at[use, some[0]]
            for depth, j in enumerate(some[1:]):
                if depth:
                    key = place_of(self.lists[depth][0], key)
                    use, key = use[key >= 0], key[key >= 0]
                key = key * (len(self.words) + 1) + at[use, j]
            found.append((use, key, weight[use][:, some]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def index(self, of: np.ndarray, places: np.ndarray) -> None:
        """Builds the lists from passages: the example of each, and its words."""
        at, weight = self.vectors(places)
        self.lists = []
        for size in range(1, PASSAGE + 1):
            which, key, w = self.combinations(at, weight, size)
            heavy = (w.astype(np.float64) ** 2).sum(1)
            order = np.lexsort((of[which], -heavy, key))
            key, w, doc = key[order], w[order], of[which[order]].astype(np.int32)
            keys, first = np.unique(key, return_index=True)
            many = np.diff(np.r_[first, len(key)])
            blocks = -(-many // BLOCK)
            block_of = np.r_[0, np.cumsum(blocks)]
            begin = np.repeat(first, blocks) + BLOCK * (np.arange(block_of[-1]) - np.repeat(block_of[:-1], blocks))
            most = self._suffix(np.maximum.reduceat(w, begin), block_of) if len(begin) else w
            # the length that passages of toxic examples have in each list, each example's best
            once = np.unique(np.repeat(np.arange(len(keys)), many) * np.int64(len(self.ids)) + doc, return_index=True)[1]
            length = np.sqrt((w[once].astype(np.float64) ** 2).sum(1)) * self.toxic[doc[once]]
            mass = np.bincount(np.repeat(np.arange(len(keys)), many)[once], length, len(keys)).astype(np.float32)
            self.lists.append((keys, block_of, most, np.r_[begin, len(key)], doc, w, mass))

    @staticmethod
    def _suffix(most: np.ndarray, block_of: np.ndarray) -> np.ndarray:
        """For each block the maximum over it and the later blocks of its list."""
        of = np.repeat(np.arange(len(block_of) - 1), np.diff(block_of))
        step = 1
        while step < len(most) and (np.diff(block_of) > step).any():
            same = of[:-step] == of[step:]
            most = most.copy()
            most[:-step] = np.where(same[:, None], np.maximum(most[:-step], most[step:]), most[:-step])
            step *= 2
        return most

    def found(self, at: np.ndarray, weight: np.ndarray):
        """For triples, pairs and words: (passage, its weights, list) of the lists that passages have, and the most that toxic votes can be."""
        out, most = [], np.zeros(len(at))
        for size in range(PASSAGE, 0, -1):
            which, key, q = self.combinations(at, weight, size)
            place = place_of(self.lists[size - 1][0], key)
            which, q, place = which[place >= 0], q[place >= 0], place[place >= 0]
            out.append((which, q, place))
            most += np.bincount(which, np.sqrt((q * q).sum(1)) * self.lists[size - 1][6][place], len(at))
        return out, np.minimum(most, NEAREST) * self.weights[1]

    def nearest(self, lists, n: int, own: np.ndarray | None = None):
        """(passage, example, cosine) of the nearest examples of n passages, best first, from their ``lists``.

        A found example is one number of its passage, itself and its cosine, so that sorting is of plain numbers.
        """
        bits = max(1, (len(self.ids) - 1).bit_length())
        least = np.full(n, RADIUS, np.float32)
        held = np.zeros(0, np.int64)  # passage, 31 bits of cosine (largest first), example
        low = np.int64((1 << bits) - 1)
        for size, (which, q, place) in zip(range(PASSAGE, 0, -1), lists, strict=True):
            _, block_of, most, begin, docs, w, _ = self.lists[size - 1]
            block, end = block_of[place], block_of[place + 1]
            while len(block):
                bound = (q * most[block]).sum(1)
                edge = least[which]
                go = np.flatnonzero((bound > edge + 1e-6) | ((edge == np.float32(RADIUS)) & (bound > edge - 1e-6)))
                which, q, block, end = which[go], q[go], block[go], end[go]
                if not len(go):
                    break
                many = begin[block + 1] - begin[block]
                p = ranges(begin[block], many)
                of = np.repeat(np.arange(len(many)), many)
                c = q[of, 0] * w[p, 0]
                for j in range(1, size):
                    c += q[of, j] * w[p, j]
                x = which[of]
                d = docs[p]
                fine = c >= least[x] - 1e-6
                if own is not None:
                    fine &= d != own[x]
                x, d, c = x[fine], d[fine].astype(np.int64), c[fine]
                cosine = np.int64(0x7FFFFFFF) - np.minimum(c, np.float32(1)).view(np.int32).astype(np.int64)
                new = ((x << bits) | d) << 31 | cosine
                again = np.zeros(n, bool)
                again[x] = True
                passage = held >> (31 + bits)
                old = again[passage]
                mine = held[old]
                mine = ((mine >> (31 + bits) << bits) | (mine & low)) << 31 | (mine >> bits & 0x7FFFFFFF)
                every = np.sort(np.r_[mine, new])  # by passage, example, cosine: the best of each example is its first
                head = np.r_[True, every[1:] >> 31 != every[:-1] >> 31][: len(every)]
                every = every[head]
                every = np.sort((every >> (31 + bits)) << (31 + bits) | (every & 0x7FFFFFFF) << bits | (every >> 31 & low))
                x = every >> (31 + bits)
                rank = np.arange(len(x)) - np.repeat(f := np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)]), np.diff(np.r_[f, len(x)]))
                full = rank == NEAREST - 1
                least[x[full]] = np.maximum((0x7FFFFFFF - (every[full] >> bits & 0x7FFFFFFF)).astype(np.int32).view(np.float32), np.float32(RADIUS))
                held = np.r_[held[~old], every[rank < NEAREST]]
                block = block + 1
                more = block < end
                which, q, block, end = which[more], q[more], block[more], end[more]
        held.sort()
        cos = (0x7FFFFFFF - (held >> bits & 0x7FFFFFFF)).astype(np.int32).view(np.float32)
        return held >> (31 + bits), held & low, cos.astype(np.float64)

    def values(self, texts: pa.Array, own: np.ndarray | None = None):
        """Of each text the largest value of a passage, how many passages it has, and the (example, cosine) nearest to that one.

        Passages whose toxic votes can't lift them over what their texts have already are not searched.
        """
        n = len(texts)
        row, places = passages(texts, self.words)
        # a passage of each kind: the same words as often, and for examples the same own one
        sorted_, many = np.sort(places, axis=1) + 1, len(self.words) + 1
        _, of = np.unique(sorted_[:, 0] * many + sorted_[:, 1], return_inverse=True)
        _, some, of = np.unique(of * many + sorted_[:, 2], return_index=True, return_inverse=True)
        if own is not None:
            _, some, of = np.unique(of * (len(self.ids) + 1) + own[row], return_index=True, return_inverse=True)
            own = own[row][some]
        at, weight = self.vectors(places[some])
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])  # the first passage of each text

        def leading(x: np.ndarray) -> np.ndarray:
            """The first passage of the largest ``x`` of each text."""
            if not len(heads):
                return heads
            most = np.repeat(np.maximum.reduceat(x, heads), np.diff(np.r_[heads, len(x)]))
            top = np.flatnonzero(x == most)
            return top[np.r_[True, row[top[1:]] != row[top[:-1]]]]

        vote, base = np.array(self.weights), PULL * self.share
        lists, most = self.found(at, weight)
        listed = np.zeros(len(some), bool)
        for which, _, _ in lists:
            listed[which] = True
        bound = (most + base) / (most + PULL) + 1e-6
        value = np.where(listed, -1.0, self.share)
        near, alike = np.full((len(some), 3), -1), np.zeros((len(some), 3))
        best = np.full(n, -1.0)
        np.maximum.at(best, row, value[of])
        due = np.zeros(len(some), bool)
        due[of[leading(bound[of])]] = True  # first the most promising one of each text
        done = ~listed
        while (now := np.flatnonzero(due & ~done)).size:
            for lo in range(0, len(now), PASSAGES):
                part = now[lo : lo + PASSAGES]
                number = np.full(len(some), -1)
                number[part] = np.arange(len(part))
                mine_of = [(number[w[k]], q[k], p[k]) for w, q, p in lists for k in [np.flatnonzero(number[w] >= 0)]]
                win, doc, cos = self.nearest(mine_of, len(part), None if own is None else own[part])
                v = cos * vote[self.toxic[doc]]
                value[part] = (np.bincount(win, v * self.toxic[doc], len(part)) + base) / (np.bincount(win, v, len(part)) + PULL)
                rank = np.arange(len(win)) - np.searchsorted(win, win)
                top = rank < 3
                near[part[win[top]], rank[top]], alike[part[win[top]], rank[top]] = doc[top], cos[top]
            done[now] = True
            np.maximum.at(best, row, value[of])
            due = np.zeros(len(some), bool)
            due[of[bound[of] > best[row]]] = True
        lead = leading(value[of])
        found = [[] for _ in range(n)]
        for r, k in zip(row[lead].tolist(), of[lead].tolist(), strict=True):
            found[r] = [(d, c) for d, c in zip(near[k].tolist(), alike[k].tolist(), strict=True) if d >= 0]
        return np.where(best < 0, self.share, best), np.bincount(row, minlength=n), found

    def score(self, value: np.ndarray, many: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(value), self.share)
        return 1 / (1 + np.exp(-(features(value, many) @ np.array(self.curve))))


def features(value: np.ndarray, many: np.ndarray) -> np.ndarray:
    value = np.clip(value, 1e-6, 1 - 1e-6)
    return np.stack([np.log(value / (1 - value)), np.log1p(many), np.ones(len(value))], 1)


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's steps, held a little towards zero."""
    b = np.zeros(x.shape[1])
    keep = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ b)
        b += move
        if np.abs(move).max() < 1e-9:
            break
    return tuple(b.tolist())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Examples from ``labels`` (only those rows), statistics from all of ``docs``."""
    spark = ready(docs.sparkSession)
    said = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    said = stored(said, "labels")
    total = {r["label"]: r["count"] for r in said.groupBy("label").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    chosen = functools.reduce(DataFrame.unionByName, [said.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES) for c in (0, 1)])
    chosen = stored(chosen, "chosen")  # 2 * EXAMPLES rows at most
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    rows = stored(rows.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")), "examples")
    size = rows.groupBy("label", F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("id"), F.first(F.octet_length("text")).alias("bytes")).orderBy(F.desc("label"), F.xxhash64("id"), "id").collect()
    used, seen, spent = [], set(), {0: 0, 1: 0}
    for r in size:  # a text that is toxic anywhere is so everywhere
        if r["sha"] not in seen and spent[r["label"]] + r["bytes"] <= EXAMPLE_BYTES:
            seen.add(r["sha"])
            spent[r["label"]] += r["bytes"]
            used.append((r["id"], r["label"]))
    labels_used = [label for _, label in used]
    if len(set(labels_used)) < 2:
        return Model(share=share)
    of = sorted(used)
    number = {i: n for n, (i, _) in enumerate(of)}
    model = Model(ids=[i for i, _ in of], toxic=np.array([label for _, label in of]), share=share)
    weights = [total[c] / labels_used.count(c) for c in (0, 1)]
    mean = sum(total.values()) / len(used)
    model.weights = (weights[0] / mean, weights[1] / mean)
    taken = rows.where(F.col("id").isin([i for i, _ in of])) if len(of) < 50 else rows.join(F.broadcast(spark.createDataFrame([(i,) for i, _ in of], "id long")), "id")
    texts = taken.orderBy("id").select("id", "text").toArrow()  # 2 * EXAMPLE_BYTES at most
    h = words(texts["text"].combine_chunks() if isinstance(texts["text"], pa.ChunkedArray) else texts["text"], PUNCT)[0]
    model.words = np.unique(h)
    known = spark.sparkContext.broadcast(model.words)

    def occur(batches):
        seen, n = np.zeros(len(known.value), np.int64), 0
        for batch in batches:
            for lo, hi in steps(batch.column(0)):
                h, row, _, _ = words(batch.column(0)[lo:hi], PUNCT)
                at = place_of(known.value, h)
                both = np.unique((row * len(known.value) + at)[at >= 0])
                seen += np.bincount(both % len(known.value), minlength=len(seen))
                n += hi - lo
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], ["at", "n"])

    had = docs.select(text.alias("text")).mapInArrow(lean(occur), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df, at, n = np.zeros(len(model.words)), had["at"].to_numpy(), had["n"].to_numpy()
    df[at[at >= 0]] = n[at >= 0]
    model.idf = np.maximum(np.log((1 + n[at < 0].sum()) / (1 + df)), 1e-6)
    row, places = passages(texts["text"].combine_chunks(), model.words)
    model.index(np.array([number[i] for i in texts["id"].to_pylist()])[row], places)

    told = spark.sparkContext.broadcast(model)

    def alone(batches):
        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                own = np.searchsorted(told.value.ids, batch.column(0)[lo:hi].to_numpy())
                value, many, _ = told.value.values(batch.column(1)[lo:hi], own)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(value), pa.array(many, pa.int64())], ["id", "value", "many"])

    tried = taken.select("id", "text").mapInArrow(lean(alone), "id long, value double, many long").orderBy("id").toArrow()
    y = model.toxic[[number[i] for i in tried["id"].to_pylist()]]
    model.curve = fitted(features(tried["value"].to_numpy(), tried["many"].to_numpy()), y, np.array(model.weights)[y])
    told.unpersist()
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with score, evidence (the three nearest examples) and predicted."""
    spark = ready(docs.sparkSession)
    kept = docs.select(*keep)
    low = fresh()
    schema = StructType([*kept.schema, StructField("score", DoubleType()), StructField("evidence", EVIDENCE)])
    told = spark.sparkContext.broadcast(model)

    def run(batches):
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int64())]))
        model = told.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in steps(texts):
                if len(model.ids):
                    value, many, near = model.values(texts[lo:hi])
                else:
                    value, many, near = np.full(hi - lo, model.share), np.zeros(hi - lo), [[]] * (hi - lo)
                evidence = [[{"doc_id": model.ids[d], "similarity": c, "toxic": int(model.toxic[d])} for d, c in e] for e in near]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), pa.array(model.score(value, many)), pa.array(evidence, kind)], [*keep, "score", "evidence"])

    out = docs.select(*keep, F.lower(F.coalesce(F.col(text), F.lit(""))).alias(low)).mapInArrow(lean(run), schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", out, "score", "predicted", "evidence")
