"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by a sweep over where tokens end.

Each tokenizer gives a table of its tokens' ends: a row for each stretch of a document, with the stretch's first byte
and the ids (an end is the sum of the lengths of the tokens up to it).  The two tables are united, dealt out by document
and sorted by place, and a machine reads them in that order: it keeps one stretch of either side, cuts both where ends
meet, and hands out groups, digests and links.  Of a document that goes on over many stretches only sums, a running
digest and its different links stay.

Stretches end where both tokenizers must end a token: before a space between two characters that aren't white space
(no piece of the vocabulary holds a space after another character, which is tested when it is read).  Between two such places
a text is a piece; each different piece is encoded once by the library and remembered within a bound.

How many documents hold an id pair is a sum over blocks of documents, and a block asks for each of its different pairs
once, so a frequent pair has a row for each block and never one for each document.

A text that is null or empty, or whose tokens' bytes aren't those of space + text, has no tokens: its numbers are 0 and its
digest is ''.  A null id is kept.  Rows that repeat an id are told apart by a hash of their text; rows that repeat id
and text count as documents of their own and get the same answer.  Ties for the highest count are all best.
Further columns, whatever their names, aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ready, steps, stored, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a stretch of a document, and of text whose pieces are told together.
STRETCH, STEP = 256 << 10, 2 << 20
#: Pieces that a worker remembers for a tokenizer; beyond it, it forgets all.
REMEMBERED = 1_000_000
#: Tokens that one vectorised step of the sweep takes, and tokens of a block of documents; what a document counts besides its tokens.
TOGETHER, BLOCK, DOCUMENT = 1_000_000, 4_000_000, 16
#: Pieces that are encoded as one text.
ALONG = 500
#: Links of a group from which on its different ids are counted first.
WIDE = 4096
EVENTS = "doc long, mark long, at long, side int, ids binary"


class ByteLevel:
    """The tokenizers library with a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # the letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has.

        Pieces that may stand in one text are encoded together; a token ends where each of them ends, by the bytes of the tokens.
        """
        alone = np.fromiter((p[-1] == " " or p[1:2].isspace() or p[:1] != " " for p in pieces), bool, len(pieces))
        size = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        order, flat, count = [], [], []
        for some in np.array_split(np.flatnonzero(~alone), max(1, (~alone).sum() // ALONG)):
            text = "".join([pieces[i] for i in some])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64) if text else np.zeros(0, np.int64)
            ends, want = np.cumsum(self.lengths[ids]), np.cumsum(size[some])
            at = np.searchsorted(ends, want)
            if len(some) and (not len(ends) or ends[-1] != want[-1] or (ends[at] != want).any()):
                alone[some] = True
                continue
            order.append(some), flat.append(ids), count.append(np.diff(at, prepend=-1))
        rest = np.flatnonzero(alone)
        found = [e.ids for e in self.library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        return ordered(np.concatenate([*order, rest]), [*flat, np.fromiter(itertools.chain.from_iterable(found), np.int64)], [*count, np.fromiter(map(len, found), np.int64, len(found))])


def ordered(order: np.ndarray, flat: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists that lie one after the other in some order, in the order of their numbers."""
    every, n = np.concatenate(flat), np.concatenate(count)
    first, back = np.cumsum(n) - n, np.argsort(order)
    first, n = first[back], n[back]
    return every[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Pieces:
    """The sentencepiece library; the space that it puts in front is the first character of each piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("The vocabulary has pieces over more than one word.")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode([p[1:] for p in pieces], num_threads=1)
        return np.fromiter(itertools.chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))


KINDS = {"byte": ByteLevel, "piece": Pieces}


class Encoder:
    """Ids of pieces by a hash of them, each different piece encoded once; ids are None where their bytes aren't the piece's."""

    def __init__(self, kind: str, path: str) -> None:
        self.library = KINDS[kind](path)
        self.lengths, self.spelled = np.array([len(b) for b in self.library.bytes], np.int64), pa.array(self.library.bytes, pa.large_binary())
        self.kind = np.min_scalar_type(max(1, len(self.lengths) - 1))
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def places(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of different pieces begin, and how many they are; -1 where the bytes differ."""
        texts = pieces.to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        keys = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))
        at, known = self._find(keys)
        if not known.all():
            if len(self.keys) + len(keys) > REMEMBERED:
                self.forget()
                known[:] = False
            new = [texts[i] for i in np.flatnonzero(~known)]
            ids, size = self.library.encode(new)
            ends, want = np.cumsum(size), np.cumsum([len(t.encode()) for t in new])
            spelled = self.spelled.take(pa.array(ids))
            at = np.frombuffer(spelled.buffers()[1], np.int64)[: len(ids) + 1]
            count = size.copy()
            if (at[ends] != want).any() or spelled.buffers()[2].to_pybytes()[: at[-1]] != "".join(new).encode():
                bytes_ = spelled.buffers()[2].to_pybytes()
                count[[bytes_[a:b] != t.encode() for a, b, t in zip(at[ends - size], at[ends], new, strict=True)]] = -1
            first = len(self.flat) + ends - size
            self.flat = np.concatenate([self.flat, ids.astype(self.kind)])
            order = np.argsort(keys[~known])
            place = np.searchsorted(self.keys, keys[~known][order])
            self.keys, self.first, self.count = (np.insert(x, place, y[order]) for x, y in ((self.keys, keys[~known]), (self.first, first), (self.count, count)))
            at, _ = self._find(keys)
        return self.first[at], self.count[at]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known


@functools.lru_cache(maxsize=4)
def encoder(kind: str, path: str) -> Encoder:
    return Encoder(kind, path)


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different pieces of space + text, which of them stand in the texts, in order, and how many each text has.

    A piece begins at a space that follows another character and isn't before white space.
    """
    split = pc.split_pattern(texts, " ")
    parts = pc.dictionary_encode(split.flatten())
    code = np.asarray(parts.indices, np.int64)
    names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
    opens = np.fromiter((bool(n) and not n[0].isspace() for n in names), bool, len(names))
    some = np.fromiter((bool(n) for n in names), bool, len(names))
    ends = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    begin = opens[code]
    begin[1:] &= some[code[:-1]]
    begin[ends[:-1]] = True
    first = np.flatnonzero(begin)
    size = np.diff(np.r_[first, len(code)])
    number = code[first]
    long = np.flatnonzero(size > 1)
    joined = pa.array([" ".join(names[c] for c in code[a : a + n]) for a, n in zip(first[long], size[long], strict=True)], pa.string())
    whole = pc.dictionary_encode(joined)
    number[long] = len(names) + np.asarray(whole.indices, np.int64)
    used, number = np.unique(number, return_inverse=True)
    texts_ = pc.binary_join_element_wise("", pa.concat_arrays([parts.dictionary.cast(pa.string()), whole.dictionary]).take(pa.array(used)), " ")
    return texts_, number, np.diff(np.searchsorted(first, ends))


def events(docs: DataFrame, side: int, kind: str, path: str) -> DataFrame:
    """Token ends of one tokenizer: doc, mark, at (first byte of the stretch, or -1 for a document without tokens), side, ids."""
    names = ["doc", "mark", "at", "side", "ids"]

    def run(batches):
        own = encoder(kind, path)
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo, hi in steps(batch.column(2), STEP):
                part = batch.slice(lo, hi - lo)
                different, number, many = pieces(part.column(2))
                first, count = own.places(different)
                lengths = np.asarray(pc.binary_length(different), np.int64)[number]
                ends = np.cumsum(many)
                rows, at, held = [], [], []
                for i, (a, b) in enumerate(zip((ends - many).tolist(), ends.tolist(), strict=True)):
                    mine = number[a:b]
                    if lengths[a:b].sum() <= 1 or (count[mine] < 0).any():
                        rows.append(i), at.append(-1), held.append(None)
                        continue
                    place = np.cumsum(lengths[a:b]) - lengths[a:b]
                    cuts = np.flatnonzero(np.diff(place // STRETCH, prepend=-1))
                    for x, y in zip(cuts, [*cuts[1:], len(mine)], strict=True):
                        n = count[mine[x:y]]
                        ids = own.flat[np.repeat(first[mine[x:y]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                        rows.append(i), at.append(int(place[x])), held.append(press.compress(ids.tobytes()))
                pick = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(at, pa.int64()), pa.array([side] * len(rows), pa.int32()), pa.array(held, pa.binary())], names)

    return docs.mapInArrow(lean(run), EVENTS)


class Cut:
    """Groups and links of stretches: ids of both sides, in order, with how many each stretch has."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray], table_: pa.Array) -> None:
        n, many_a, many_b = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = (np.concatenate(x).astype(np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(lengths[0][ids_a]), np.cumsum(lengths[1][ids_b])
        meet = np.zeros(int(ends_a[-1]) + 1, np.int8)
        meet[ends_a] = 1
        meet[ends_b] += 1
        before = np.cumsum(meet == 2, dtype=np.int32)
        of_a, of_b = before[ends_a - 1], before[ends_b - 1]
        groups = int(before[-1])
        size_a, size_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        last_a, last_b = np.cumsum(many_a), np.cumsum(many_b)
        # groups of each stretch
        edge = np.r_[0, of_a[last_a - 1].astype(np.int64) + 1]
        self.n_a, self.n_b, self.n_groups = many_a, many_b, np.diff(edge)
        self.n_links = np.add.reduceat(size_a * size_b, edge[:-1])
        # ids as text, those of a group together
        total = len(table_) // 3
        stop_a, stop_b = np.r_[of_a[1:] != of_a[:-1], True], np.r_[of_b[1:] != of_b[:-1], True]
        told = np.empty(len(ids_a) + len(ids_b), np.int64)
        told[np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[of_a]] = ids_a + total * stop_a
        told[np.arange(len(ids_b)) + np.cumsum(size_a)[of_b]] = ids_b + 2 * total * stop_b
        text = table_.take(pa.array(told))
        places = np.frombuffer(text.buffers()[1], np.int64)
        self.text, self.bounds = text.buffers()[2], np.r_[0, places[last_a + last_b]]
        # links, equal ones of a stretch together
        base = len(lengths[1])
        wide = size_a * size_b > WIDE
        fold = np.where(wide[of_a], 0, size_b[of_a])
        left = np.repeat(ids_a, fold)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(fold) - fold, fold)
        right = ids_b[np.repeat((np.cumsum(size_b) - size_b)[of_a], fold) + inner]
        stretch = np.repeat(np.repeat(np.arange(n), many_a), fold)
        span = len(lengths[0]) * base
        keys, counts = np.unique(stretch * span + left * base + right, return_counts=True)
        if wide.any():
            more_k, more_c = [keys], [counts]
            for g in np.flatnonzero(wide):
                xa, ca = np.unique(ids_a[of_a == g], return_counts=True)
                xb, cb = np.unique(ids_b[of_b == g], return_counts=True)
                at = np.searchsorted(edge, g, "right") - 1
                more_k.append((at * span + xa[:, None] * base + xb[None, :]).ravel())
                more_c.append((ca[:, None] * cb[None, :]).ravel())
            keys, at = np.unique(np.concatenate(more_k), return_inverse=True)
            counts = np.bincount(at, np.concatenate(more_c)).astype(np.int64)
        cuts = np.searchsorted(keys, np.arange(n + 1) * span)
        self.links = [(keys[x:y] - i * span, counts[x:y]) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


class Document:
    """What a document's stretches add up to."""

    def __init__(self, key: tuple, copies: int, with_groups: bool) -> None:
        self.key, self.copies, self.sums = key, copies, np.zeros(4, np.int64)
        self.digest, self.links, self.groups = None, [], [] if with_groups else None

    def add(self, cut: Cut, i: int) -> None:
        self.sums += (cut.n_a[i], cut.n_b[i], cut.n_groups[i], cut.n_links[i])
        text = memoryview(cut.text)[cut.bounds[i] : cut.bounds[i + 1] - 1]
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(text)
        if self.groups is not None:
            self.groups.append(bytes(text))
        self.links.append(cut.links[i])
        if len(self.links) > 16:
            self.links = [self.pairs()]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Its different links and how often each occurs."""
        if len(self.links) == 1:
            return self.links[0]
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in self.links]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in self.links])).astype(np.int64)


def sweep(rows: DataFrame, a: tuple[str, str], b: tuple[str, str], with_groups: bool) -> DataFrame:
    """A row for each block of documents: their ids, sums and digests, the different links of all, and in which documents each occurs how often."""
    names = ["block", "docs", "pairs", "many", "size", "places", "times"]
    kinds = pa.list_(pa.struct([("doc", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha256", pa.string()), ("groups", pa.string())]))

    def block(number: int, held: list[Document]) -> pa.RecordBatch:
        told = [d for d in held for _ in range(d.copies)]
        links = [d.pairs() for d in told]
        pairs, at = np.unique(np.concatenate([k for k, _ in links]), return_inverse=True)
        docs = [(d.key[0], *map(int, d.sums), d.digest.hexdigest() if d.digest else "", None if d.groups is None else b";".join(d.groups).decode()) for d in told]
        rows = pa.array([[dict(zip(["doc", "n_a", "n_b", "n_groups", "n_links", "sha256", "groups"], x, strict=True)) for x in docs]], kinds)
        press = zstandard.ZstdCompressor(level=1)
        times = np.concatenate([c for _, c in links]).astype(np.int32)
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (pairs, np.bincount(at, minlength=len(pairs)))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), rows, *lists, pa.array([[len(k) for k, _ in links]], pa.list_(pa.int32())), pa.array([press.compress(at.astype(np.int32).tobytes())], pa.binary()), pa.array([press.compress(times.tobytes())], pa.binary())],
            names,
        )

    def run(batches):
        encoders = encoder(*a), encoder(*b)
        lengths, kind = tuple(e.lengths for e in encoders), [e.kind for e in encoders]
        total = max(map(len, lengths))
        table_ = pa.array([f"{i}{s}" for s in ",|;" for i in range(total)], pa.large_string())
        press = zstandard.ZstdDecompressor()
        state = {"doc": None, "side": None, "tokens": 0}
        task, made = TaskContext.get().partitionId(), 0
        waiting: list[tuple[Document, np.ndarray, np.ndarray]] = []  # stretches whose sides are both there
        ready_: list[Document] = []  # documents of the next block

        def settle():
            if waiting:
                cut = Cut([x for _, x, _ in waiting], [y for _, _, y in waiting], lengths, table_)
                for i, (doc, _, _) in enumerate(waiting):
                    doc.add(cut, i)
                waiting.clear()

        last = None  # (key, at, side) of the row before
        size = swept = 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            for i, (doc, mark, at, side) in enumerate(keys):
                key = (doc, mark)
                current = state["doc"]
                if current is None or current.key != key:
                    if size >= TOGETHER or swept >= BLOCK:
                        settle()
                        size = 0
                    if swept >= BLOCK:
                        yield block((task << 32) + made, ready_)
                        made, swept, ready_ = made + 1, 0, []
                    current = state["doc"] = Document(key, 0, with_groups)
                    state["none"], state["first"] = at < 0, None
                    ready_.append(current)
                    swept += DOCUMENT
                # each copy of the row brings its stretches again, one after the other
                if side == 1 and state["first"] in (None, at):
                    state["first"] = at
                    current.copies += 1
                if (key, at, side) == last or state["none"]:
                    last = (key, at, side)
                    continue
                last = (key, at, side)
                ids = np.frombuffer(press.decompress(batch.column(4)[i].as_py()), kind[side])
                if side == 0:
                    state["side"] = ids
                else:
                    waiting.append((current, state["side"], ids))
                    size, swept = size + len(ids) + len(state["side"]), swept + len(ids) + len(state["side"])
                    if size >= TOGETHER and at:  # a long document goes on
                        settle()
                        size = 0
        settle()
        if ready_:
            yield block((task << 32) + made, ready_)

    schema = "block long, docs array<struct<doc:long,n_a:long,n_b:long,n_groups:long,n_links:long,sha256:string,groups:string>>, pairs array<long>, many array<long>, size array<int>, places binary, times binary"
    return rows.repartition("doc", "mark").sortWithinPartitions("doc", "mark", "at", "side").mapInArrow(lean(run), schema)


def pair_counts(swept: DataFrame, base: int) -> DataFrame:
    """pair, docs (how many documents hold it) and best (whether no other pair of its first id is in more)."""
    counts = stored(swept.select(F.explode(F.arrays_zip("pairs", "many")).alias("x")).groupBy("x.pairs").agg(F.sum("x.many").alias("docs")).withColumnRenamed("pairs", "pair"), "counts")
    first = F.floor(F.col("pair") / base)
    most = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", first).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: tuple[str, str] | None = None, b: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups of each row.

    ``a`` and ``b`` are kinds of tokenizers (``byte`` or ``piece``) and their files.
    """
    a, b = a or ("byte", public_tokenizers.path(A_FILE)), b or ("piece", public_tokenizers.path(B_FILE))
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    swept = stored(sweep(events(rows, 0, *a).unionByName(events(rows, 1, *b)), a, b, with_groups), "swept")
    base = len(encoder(*b).lengths)
    asked = swept.select("block", F.explode("pairs").alias("pair"))
    told = asked.join(stored(pair_counts(swept, base), "pairs"), "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("told"))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                held, size, places, times, found = (batch.column(c)[i] for c in range(5))
                size = np.asarray(size.values)
                at, often = (np.frombuffer(press.decompress(x.as_py()), np.int32) for x in (places, times))
                answers = found.values
                order = np.argsort(np.asarray(answers.field("pair"))) if answers is not None else np.zeros(0, np.int64)
                docs_, best = (np.asarray(answers.field(c).cast(pa.int64()))[order] if answers is not None else order for c in ("docs", "best"))
                of = np.repeat(np.arange(len(size)), size)
                add = lambda x, of=of, n=len(size): pa.array(np.bincount(of, x, n).astype(np.int64))
                # in whole numbers: the sums of bincount are floats
                total = np.zeros(len(size), np.int64)
                np.add.at(total, of, docs_[at] * often)
                rows = held.values
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in ("doc", "n_a", "n_b", "n_groups", "n_links")), add(best[at] * often), pa.array(total), rows.field("sha256"), *[rows.field("groups")] * with_groups], names)

    whole = swept.join(told, "block", "left").select("docs", "size", "places", "times", "told")
    return whole.mapInArrow(lean(run), f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups)


def op13_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
