"""Source divergence audit: how far the words of the sources of a language lie apart, and which words make a source different.

Terms are counted where the texts are read, and the sums leave the tasks as one row for each language, source and term.  A term that enough documents of its language have becomes a wide vector: its counts, one for each source of the
language, in the order of the sources' names.  Higher-order functions turn a vector into smoothed shares and these into
a contribution for every two sources, which the map side sums before anything is shuffled.

All arithmetic is exact: shares are whole billionths.  A null text, language or source counts as ''; texts without
terms still make their group occur.  Rows that repeat an id, or a whole document, are documents of their own.  Ties are
ranked by name, in order of UTF-8.  A very long text is counted by itself.  Further columns, whatever their
names, aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, ready, steps, stored, table

MIN_DOCS, TOP = 10, 10
BILLION = 1_000_000_000
#: Bytes of text whose terms are counted together before they leave a task.
STEP = 8 << 20
#: Bytes that stand between terms: all of ASCII but letters.  Only A to Z are lower-cased.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Parts that the row of a language is repeated for, so that a frequent language isn't one task's work.
SALTS = 64


def cleaned(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many terms each text has, and all of them in order."""
    texts = pc.cast(texts, pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    inside = ~BETWEEN[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # two texts that touch are two terms
    at = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(raw))]
    begins[at] |= inside[at]
    ends[at - 1] |= inside[at - 1]
    first = np.flatnonzero(begins)
    places = np.zeros(len(first) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - first, out=places[1:])
    found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(LOWER[raw[inside]]))
    return np.diff(np.searchsorted(first, offs)), pc.dictionary_encode(found)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it), summed in the tasks and then between them."""
    ready(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        for batch in batches:
            for lo, hi in steps(batch.column(2), STEP):
                many, found = terms(batch.column(2)[lo:hi])
                lang, source = (pc.dictionary_encode(batch.column(c)[lo:hi]) for c in (0, 1))
                group = np.asarray(lang.indices, np.int64) * len(source.dictionary) + np.asarray(source.indices)
                size = max(1, len(found.dictionary))
                each, n = np.unique(np.repeat(np.arange(hi - lo), many) * size + np.asarray(found.indices), return_counts=True)
                key, at = np.unique(group[each // size] * size + each % size, return_inverse=True)
                sums = [np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))]
                of, term = key // size, pa.array(key % size)
                texts = [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), found.dictionary.take(term).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*texts, *(pa.array(x, pa.int64()) for x in sums)], names)

    rows = docs.select("lang", "source", "text").mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), in whole numbers of any size."""
    top = F.lit(BILLION).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(19,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def vectors(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and its counts by source, of the terms that enough documents of the language have."""
    held = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return held.where(F.col("docs") >= min_docs).drop("docs")


def profiles(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each language: its sources by name, each with the sum of its kept terms' counts; that of all; the number of kept terms."""
    groups = docs.select("lang", "source").distinct()
    sums = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    named = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    return named.join(sizes, "lang", "left").select("lang", "s", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: in part ``pair`` the other sources, the farthest first; in ``term`` the ``top`` terms that a source has more of than its language."""
    docs = cleaned(docs, text, lang, source)
    kept = stored(vectors(term_counts(docs), min_docs), "vectors")
    about = stored(profiles(docs, kept), "profiles")
    salted = about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    wide = rows.withColumn("c", F.transform("s", lambda x: F.coalesce(F.try_element_at("by_source", x["source"]), F.lit(0))))
    wide = wide.withColumn("p", F.transform("c", lambda c, i: share(c, F.get("s", i)["n"], F.col("terms"))))

    # the distance is symmetric, so each two sources meet once
    pairs = F.flatten(F.transform("p", lambda p, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda q, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), distance(p, q).alias("value")))))
    sums = wide.select("lang", F.explode(pairs).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.value").alias("value"))
    every = about.select("lang", "s", F.posexplode("s").alias("at", "own")).select("lang", "at", F.col("own.source").alias("source"), F.posexplode("s").alias("of", "other"))
    every = every.where("at <> of").select("lang", "source", F.col("other.source").alias("item"), F.least("at", "of").alias("i"), F.greatest("at", "of").alias("j"))
    pair = every.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    own = share(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x), F.col("total"), F.col("terms"))
    more = F.filter(
        F.transform("p", lambda p, i: F.struct(F.get("s", i)["source"].alias("source"), p.alias("p"), F.get("c", i).alias("c"))), lambda x: (x["c"] > 0) & (x["p"] > F.col("q"))
    )
    term = wide.withColumn("q", own).select("lang", "term", "q", F.explode(more).alias("x"))
    term = term.select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("x.p"), F.col("q")).alias("value"))

    # the limit of a rank is applied before the shuffle as well
    order = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank"
    ranked = term.select("*", F.expr(order)).where(F.col("rank") <= top)
    return pair.select("*", F.expr(order)).unionByName(ranked)


def op11_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v)::HUGEINT AS q
  FROM gn JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
term AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM ranked WHERE rank <= 10
"""
