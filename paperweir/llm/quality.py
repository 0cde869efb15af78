"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of characters.

The model is trained on the texts of trusted rows.  Counts of n-grams are summed in every
partition before they are shuffled, joined by prefix and by suffix in shards to give the discounts,
interpolation weights and continuation counts, and end as one probability for each n-gram seen and one
back-off weight for each context.  Each text gets its perplexity by character; it is kept if that is not
above a quantile of the trusted texts of its language.  One trusted row in ``HELD`` (by a hash of its id)
isn't trained on, and the quantiles are those of such rows: a text that the model knows scores too well.
Where there are none, the quantiles are of all trusted rows.

A model of up to ``MODEL_ROWS`` n-grams (its size is counted first) goes to every task as sorted arrays;
beyond it, the n-grams of each text are joined with the model in shards instead, with the same scores.

A run of white space is one symbol, every other character of the trusted texts is its own, whatever its script, one symbol stands
for all characters that they don't have, and an edge mark stands before and after.  N-grams have ``ORDER`` symbols whatever the
alphabet: one is two whole numbers, its last symbols in the low one (all five of up to 4,092 characters, three at least) and what
stands before them in the high one.
A null or empty text scores as the two edges alone.  Short texts say little: a text's perplexity is
drawn towards the median of its language as if it had ``PULL`` more symbols of that perplexity.
A null language is its own group; a language without trusted rows uses all trusted rows' threshold.
Without any trusted row nothing is known: perplexity is null and every row is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import fresh, lean, ready, steps, stored, table

#: Symbols of an n-gram at most.
ORDER = 5
#: Share of the trusted texts of a language that its threshold keeps.
QUANTILE = 0.998
PULL = 60
HELD = 10
ACCURACY = 10_000
MODEL_ROWS = 2_000_000
#: Trusted ids that are joined by broadcast.
BROADCAST_ROWS = 1_000_000
#: Symbols below the first character's: the marks; no symbol is 0.
EDGE, BLANK, UNSEEN, FIRST = 1, 2, 3, 4
STEP = 512 << 10


class Alphabet:
    """Numbers of the characters of the trusted texts, and how n-grams of them are laid out in two numbers."""

    def __init__(self, codes: np.ndarray, order: int = ORDER) -> None:
        self.codes = np.sort(codes)
        self.bits = max(1, int(len(codes) + FIRST - 1).bit_length())
        self.order = order
        #: Symbols of the low number.
        self.low = min(order, 63 // self.bits)
        if order - self.low > 63 // self.bits:
            raise ValueError(f"n-grams of {order} symbols of {self.bits} bits don't fit two numbers.")

    def numbers(self, code: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.where(_space(code), BLANK, UNSEEN).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(_space(code), BLANK, np.where(self.codes[at] == code, FIRST + at, UNSEEN))

    def last(self, m: int) -> tuple[int, int]:
        """The masks (high, low) of an n-gram's last m symbols."""
        return (1 << (self.bits * max(0, m - self.low))) - 1, (1 << (self.bits * min(m, self.low))) - 1

    def before(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams without their last symbol."""
        return high >> self.bits, low >> self.bits | (high & self.last(1)[1]) << self.bits * (self.low - 1)

    def cut(self, m: int) -> tuple[Column, Column]:
        """Of columns h and g, the last m symbols."""
        high, low = self.last(m)
        return F.col("h").bitwiseAND(F.lit(high)), F.col("g").bitwiseAND(F.lit(low))

    def context(self, high: Column, low: Column) -> tuple[Column, Column]:
        """``before`` of columns."""
        carried = F.shiftleft(high.bitwiseAND(F.lit(self.last(1)[1])), self.bits * (self.low - 1))
        return F.shiftrightunsigned(high, self.bits), F.shiftrightunsigned(low, self.bits).bitwiseOR(carried)


def distinct(high: np.ndarray, low: np.ndarray):
    """(high, low, place of each in these) of different n-grams."""
    if not high.any():
        low, inverse = np.unique(low, return_inverse=True)
        return np.zeros(len(low), np.int64), low, inverse
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return high[new], low[new], inverse


def _space(code: np.ndarray) -> np.ndarray:
    if not hasattr(_space, "table"):
        _space.table = np.array([chr(i).isspace() for i in range(0x3001)])
    return _space.table[np.minimum(code, 0x3000)] & (code <= 0x3000)


def code_points(texts: pa.Array):
    """(code points, characters of each text) of texts, each between two zeros."""
    listed = [t or "" for t in texts.to_pylist()]
    n = np.fromiter(map(len, listed), np.int64, len(listed))
    return np.frombuffer("".join(f"\x00{t}\x00" for t in listed).encode("utf-32-le", "replace"), "<u4"), n


def alphabet(trusted: DataFrame, order: int = ORDER) -> Alphabet:
    """The characters of texts: a number for each character of Unicode at most."""

    def run(batches):
        seen = np.zeros(0x110000, bool)
        for batch in batches:
            for lo, hi in steps(batch.column(0), STEP):
                code, _ = code_points(batch.column(0)[lo:hi])
                seen[code] = True
        code = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(code[~_space(code) & (code > 0)], pa.int32())], ["code"])

    return Alphabet(trusted.mapInArrow(lean(run), "code int").distinct().toArrow()["code"].to_numpy().astype(np.int64), order)


def symbols(texts: pa.Array, letters: Alphabet):
    """(symbols, row of each) of texts, each between edges."""
    code, n = code_points(texts)
    s = letters.numbers(code)
    ends = np.cumsum(n + 2)
    s[ends - 1] = EDGE
    s[ends - n - 2] = EDGE
    row = np.repeat(np.arange(len(n)), n + 2)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != BLANK) | (s[:-1] != BLANK)
    return s[keep], row[keep]


def grams(s: np.ndarray, row: np.ndarray, letters: Alphabet):
    """The n-gram that ends at each symbol but a first edge, as two numbers; near the start of a text it is shorter.

    Gives for each position: high number, low number, length, row.  The low number of an n-gram has its last symbol lowest.
    """
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    place = np.arange(len(s)) - np.searchsorted(row, row)
    order = letters.order
    size = np.minimum(place + 1, order)
    high, low = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    for back in range(order - 1, -1, -1):
        part = np.zeros(len(s), np.int64)
        part[back:] = s[: len(s) - back]
        into = low if back < letters.low else high
        into <<= letters.bits
        into |= np.where(back < size, part, 0)
    use = place > 0
    return high[use], low[use], size[use], row[use]


def count(trusted: DataFrame, letters: Alphabet) -> DataFrame:
    """(h, g, n) of full-length n-grams, and of the shorter ones at the start of texts, over all trusted texts."""
    none = np.zeros(0, np.int64)

    def run(batches):
        high, low, total = none, none, none
        for batch in batches:
            for lo, hi in steps(batch.column(0), STEP):
                h, g, _, _ = grams(*symbols(batch.column(0)[lo:hi], letters), letters)
                h, g, inverse = distinct(h, g)
                n = np.bincount(inverse, minlength=len(g))
                high, low, inverse = distinct(np.concatenate([high, h]), np.concatenate([low, g]))
                total = np.bincount(inverse, np.concatenate([total, n]), len(low)).astype(np.int64)
                if len(low) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(total)], ["h", "g", "n"])
                    high, low, total = none, none, none
        for lo in range(0, len(low), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in (high, low, total)], ["h", "g", "n"])

    return trusted.mapInArrow(lean(run), "h long, g long, n long").groupBy("h", "g").agg(F.sum("n").alias("n"))


def length(letters: Alphabet) -> Column:
    """Symbols of an n-gram h, g: no symbol is 0."""
    size = F.lit(0)
    for number, symbols_ in (("g", letters.low), ("h", letters.order - letters.low)):
        for j in range(symbols_):
            size = size + (F.shiftrightunsigned(F.col(number), letters.bits * j) > 0).cast("int")
    return size


def few(rows: DataFrame, m: int) -> DataFrame:
    """Contexts or n-grams of at most one symbol are at most one row for each character there is, so they go to every task."""
    return F.broadcast(rows) if m <= 1 else rows


def model(trusted: DataFrame, letters: Alphabet) -> DataFrame:
    """(h, g, size, p, back): probability of each n-gram seen, interpolated with its shorter ones, and back-off weight of it as a context.

    Level by level from the longest: counts of the longest are those of the text, shorter ones count the
    different symbols before them (those that begin a text, which nothing can stand before, keep their own).
    """
    order = letters.order
    top = stored(count(trusted, letters).withColumn("size", length(letters)), "counts")
    levels = {order: top.where(F.col("size") == order).select("h", "g", "n")}
    for m in range(order - 1, 0, -1):
        high, low = letters.cut(m)
        after = levels[m + 1].groupBy(high.alias("h"), low.alias("g")).agg(F.count("*").alias("n"))
        begins = top.where(F.col("size") == m).select("h", "g", "n")
        levels[m] = stored(after.unionByName(begins).groupBy("h", "g").agg(F.sum("n").alias("n")), f"level{m}")
    # probabilities from the shortest up
    kinds = levels[1].agg(F.count("*").alias("kinds")).first()["kinds"]
    below, parts = None, []
    for m in range(1, order + 1):
        rare = {r["n"]: r["c"] for r in levels[m].where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        n1, n2, n3, n4 = (float(rare.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d1 = min(max(1 - 2 * y * n2 / n1, 0.05), 0.95) if n1 else 0.5
        d2 = min(max(2 - 3 * y * n3 / n2, 0.05), 1.95) if n2 else 0.75
        d3 = min(max(3 - 4 * y * n4 / n3, 0.05), 2.95) if n3 else 0.9
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        high, low = letters.context(F.col("h"), F.col("g"))
        rows = levels[m].withColumns({"ch": high, "cg": low})
        sums = rows.groupBy("ch", "cg").agg(F.sum("n").alias("total"), F.sum(less).alias("taken")).withColumn("back", F.col("taken") / F.col("total"))
        rows = rows.join(few(sums, m - 1), ["ch", "cg"])
        own = (F.col("n") - less) / F.col("total")
        if m == 1:
            rows = rows.withColumn("p", own + F.col("back") / (kinds + 1))
        else:
            high, low = letters.cut(m - 1)
            lower = below.select(F.col("h").alias("sh"), F.col("g").alias("sg"), F.col("p").alias("shorter"))
            rows = rows.withColumns({"sh": high, "sg": low}).join(few(lower, m - 1), ["sh", "sg"]).withColumn("p", own + F.col("back") * F.col("shorter"))
        below = stored(rows.select("h", "g", F.lit(m).alias("size"), "p"), f"p{m}")
        parts.append((below, sums.select(F.col("ch").alias("h"), F.col("cg").alias("g"), F.lit(m - 1).alias("size"), "back")))
    seen, backs = parts[0][0], parts[0][1]
    for p, b in parts[1:]:
        seen, backs = seen.unionByName(p), backs.unionByName(b)
    return stored(seen.join(backs, ["h", "g", "size"], "full"), "model")


class Known:
    """Values of n-grams, looked up by their two numbers."""

    def __init__(self, high: np.ndarray, low: np.ndarray, values: np.ndarray) -> None:
        # where high numbers occur, an n-gram is the places of its two numbers among those that occur
        self.parts = (np.unique(high), np.unique(low)) if high.any() else None
        key = low if self.parts is None else np.searchsorted(self.parts[0], high) << 32 | np.searchsorted(self.parts[1], low)
        order = np.argsort(key)
        self.keys, self.values = key[order], values[order]

    @staticmethod
    def places(keys: np.ndarray, asked: np.ndarray):
        if not len(keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def find(self, high: np.ndarray, low: np.ndarray):
        """(place in values, whether it is there) of each n-gram."""
        if self.parts is None:
            at, hit = self.places(self.keys, low)
            return at, hit & (high == 0)
        (a, known), (b, known_too) = self.places(self.parts[0], high), self.places(self.parts[1], low)
        at, hit = self.places(self.keys, a << 32 | b)
        return at, hit & known & known_too


class Scorer:
    """A model as sorted arrays by length."""

    def __init__(self, rows: pa.Table, letters: Alphabet) -> None:
        self.letters, order = letters, letters.order
        h, g, of = rows["h"].to_numpy(), rows["g"].to_numpy(), rows["size"].to_numpy()
        p, back = rows["p"].to_numpy(), rows["back"].to_numpy()
        self.p, self.back = [], []
        for m in range(order + 1):
            for known, into in ((p, self.p), (back, self.back)):
                at = np.flatnonzero((of == m) & ~np.isnan(known))
                into.append(Known(h[at], g[at], np.log(known[at])))
        kinds, edge = len(self.p[1].keys), self.back[0].values
        self.unseen = float(np.exp(edge[0])) / (kinds + 1) if len(edge) else 1.0

    def logs(self, number: np.ndarray, size: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """Log probability of the last symbol of each n-gram after the others; ``number`` is the low one, without ``high`` all is in it."""
        high = np.zeros(len(number), np.int64) if high is None else high
        out, open_, weight = np.zeros(len(number)), np.ones(len(number), bool), np.zeros(len(number))
        for m in range(self.letters.order, 0, -1):
            masks = self.letters.last(m)
            at = np.flatnonzero(open_ & (size >= m))
            h, g = high[at] & masks[0], number[at] & masks[1]
            place, hit = self.p[m].find(h, g)
            out[at[hit]] = weight[at[hit]] + self.p[m].values[place[hit]]
            open_[at[hit]] = False
            miss = at[~hit]
            place, known = self.back[m - 1].find(*self.letters.before(h[~hit], g[~hit]))
            weight[miss[known]] += self.back[m - 1].values[place[known]]
        edge = self.back[0].values
        out[open_] = weight[open_] + np.log(self.unseen) - (edge[0] if len(edge) else 0)
        return out


def perplexities(docs: DataFrame, keep: list[str], rows: DataFrame | None, text: str, letters: Alphabet, most: int) -> DataFrame:
    """Columns ``keep`` with n_symbols and perplexity."""
    kept = docs.select(*keep)
    low = F.coalesce(F.col(text), F.lit("")).alias(fresh())
    if rows is None or rows.isEmpty():
        return kept.withColumns({"n_symbols": F.lit(0).cast("long"), "perplexity": F.lit(None).cast("double")})
    if rows.count() <= most:
        scorer = docs.sparkSession.sparkContext.broadcast(Scorer(rows.toArrow(), letters))

        def run(batches):
            for batch in batches:
                texts = batch.column(len(keep))
                for lo, hi in steps(texts, STEP):
                    high, low, size, row = grams(*symbols(texts[lo:hi], letters), letters)
                    high, low, inverse = distinct(high, low)
                    first = np.zeros(len(low), np.int64)
                    first[inverse] = size
                    logs = scorer.value.logs(low, first, high)[inverse]
                    n = np.bincount(row, minlength=hi - lo)
                    mean = np.bincount(row, logs, hi - lo) / np.maximum(n, 1)
                    yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), pa.array(n, pa.int64()), pa.array(np.exp(-mean))], [*keep, "n_symbols", "perplexity"])

        return docs.select(*keep, low).mapInArrow(lean(run), StructType([*kept.schema, StructField("n_symbols", LongType()), StructField("perplexity", DoubleType())]))
    return joined_perplexities(docs, keep, rows, low, letters)


def joined_perplexities(docs: DataFrame, keep: list[str], rows: DataFrame, low, letters: Alphabet) -> DataFrame:
    """The same by joins: distinct n-grams of each text meet the model level by level, in shards of the n-gram."""
    texts = stored(docs.select(F.monotonically_increasing_id().alias("_uid"), *keep, low.alias("_text")), "texts")

    def run(batches):
        for batch in batches:
            for lo, hi in steps(batch.column(1), STEP):
                h, g, size, row = grams(*symbols(batch.column(1)[lo:hi], letters), letters)
                (row, h, g, size), n = np.unique(np.stack([row, h, g, size]), axis=1, return_counts=True)
                columns = [batch.column(0)[lo:hi].take(pa.array(row)), pa.array(h), pa.array(g), pa.array(size, pa.int32()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["_uid", "h", "g", "long", "n"])

    counts = texts.select("_uid", "_text").mapInArrow(lean(run), "_uid long, h long, g long, long int, n long")
    different = counts.select("h", "g", "long").distinct().withColumns({"log": F.lit(None).cast("double"), "weight": F.lit(0.0)})
    kinds = rows.where("size = 1 AND p IS NOT NULL").count()
    floor = rows.where("size = 0").agg(F.first("back")).first()[0]
    for m in range(letters.order, 0, -1):
        high, low = letters.cut(m)
        before = letters.context(high, low)
        p = rows.where((F.col("size") == m) & F.col("p").isNotNull()).select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("p").alias("_p"))
        b = rows.where((F.col("size") == m - 1) & F.col("back").isNotNull()).select(F.col("h").alias("_ch"), F.col("g").alias("_cg"), F.col("back").alias("_b"))
        step = different.withColumns({"_h": high, "_g": low, "_ch": before[0], "_cg": before[1]})
        step = step.join(few(p, m), ["_h", "_g"], "left").join(few(b, m - 1), ["_ch", "_cg"], "left")
        due = F.col("log").isNull() & (F.col("long") >= m)
        step = step.withColumn("log2", F.when(due, F.col("weight") + F.log("_p")).otherwise(F.col("log")))
        missed = due & F.col("log2").isNull() & F.col("_b").isNotNull()
        different = step.select("h", "g", "long", F.col("log2").alias("log"), F.when(missed, F.col("weight") + F.log("_b")).otherwise(F.col("weight")).alias("weight"))
    different = different.withColumn("log", F.coalesce("log", F.col("weight") + F.lit(math.log(floor / (kinds + 1)) - math.log(floor))))
    sums = counts.join(different, ["h", "g", "long"]).groupBy("_uid").agg(F.sum("n").alias("n_symbols"), F.sum(F.col("n") * F.col("log")).alias("_log"))
    out = texts.drop("_text").join(sums, "_uid", "left")
    return out.select(*keep, F.coalesce("n_symbols", F.lit(0).cast("long")).alias("n_symbols"), F.exp(-F.col("_log") / F.col("n_symbols")).alias("perplexity"))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, most: int = MODEL_ROWS) -> DataFrame:
    """(id_col, lang, n_symbols, perplexity, score, threshold, trusted, kept) of each row; trusted_ids has the ids of trusted rows."""
    ready(docs.sparkSession)
    ids = stored(trusted_ids.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct(), "trusted")
    marked = docs.select(id_col, F.col(lang_col).alias("lang"), text_col)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % HELD == 0
    texts = marked.join(ids.where(~held("_id")), marked[id_col] == F.col("_id"), "left_semi").select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    letters = alphabet(texts, order)
    rows = model(texts, letters)
    scored = stored(perplexities(marked, [id_col, "lang"], rows, text_col, letters, most), "perplexities")
    scored = scored.join(ids.withColumn("_trusted", F.lit(True)), scored[id_col] == F.col("_id"), "left").select(*scored.columns, F.coalesce("_trusted", F.lit(False)).alias("trusted"))
    same = lambda rows: scored["lang"].eqNullSafe(rows["_lang"])
    tested = F.col("trusted") & held(id_col)
    tested = F.col("trusted") if scored.where(tested).isEmpty() else tested
    known = scored.where(tested)
    usual = lambda c, q: F.percentile_approx(c, q, ACCURACY)
    middle = known.groupBy(F.col("lang").alias("_lang")).agg(usual("perplexity", 0.5).alias("_middle"))  # a row for each language
    overall = known.agg(usual("perplexity", 0.5)).first()[0]
    scored = scored.join(F.broadcast(middle), same(middle), "left").withColumn("_middle", F.coalesce("_middle", F.lit(overall).cast("double")))
    drawn = F.exp((F.col("n_symbols") * F.log("perplexity") + PULL * F.log("_middle")) / (F.col("n_symbols") + PULL))
    scored = scored.withColumn("score", drawn).drop("_lang", "_middle")
    known = scored.where(tested)
    limits = known.groupBy(F.col("lang").alias("_lang")).agg(usual("score", quantile).alias("_own"))
    overall = known.agg(usual("score", quantile)).first()[0]
    out = scored.join(F.broadcast(limits), same(limits), "left").withColumn("threshold", F.coalesce("_own", F.lit(overall).cast("double")))
    return out.select(id_col, "lang", "n_symbols", "perplexity", "score", "threshold", "trusted", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"))


def op5_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return classify(table(spark, sf_dir, "documents"), labels.where("quality = 1"))
