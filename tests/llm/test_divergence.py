"""Operator 11 against the definition in whole numbers."""

import collections
import re

from pyspark.sql import functions as F

from paperweir.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    docs, count, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOWER))
        for t in set(found):
            docs[lang, t] += 1
        for t in found:
            count[lang, source, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (l, t), n in docs.items() if l == lang and n >= least]
        names = sorted({s for l, s in groups if l == lang}, key=str.encode)
        v = len(kept)
        p = {}
        for s in names:
            n = sum(count[lang, s, t] for t in kept)
            for t in kept:
                p[s, t] = 1 + 10**9 * (count[lang, s, t] + 2) // (n + 2 * v)
        whole = {t: sum(count[lang, s, t] for s in names) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * v) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in names:
            pair = sorted(((-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in names if o != s))
            term = sorted(((-f(p[s, t], q[t]), t.encode(), t) for t in kept if count[lang, s, t] and p[s, t] > q[t]))[:top]
            out += [(lang, s, part, x[2], -x[0], i + 1) for part, found in (("pair", pair), ("term", term)) for i, x in enumerate(found)]
    return collections.Counter(out)


def got(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_divergence_is_the_definition(spark):
    words = ["the", "The", "of", "É", "é", "naïve", "x1y", "don't", "日本", "\x00a", "", "zz", "zz", "zz zz"]
    rows = [(i % 40, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 9)), ["en", "de", None, ""][i % 4], [None, "b", "a", "ä", ""][i % 5 if i % 3 else 1]) for i in range(400)]
    rows += [(1, None, "en", "no terms"), (2, "1 2 3", "fr", "b"), (2, "1 2 3", "fr", "a"), (None, "the " * 5000, "en", "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({"term": F.lit(1), "N": F.lit(2), "c": F.lit(3)})
    assert got(divergence.divergence(docs)) == brute(rows)
    assert got(divergence.divergence(docs, min_docs=1, top=3)) == brute(rows, 1, 3)


def test_divergence_of_odd_tables(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    assert got(divergence.divergence(spark.createDataFrame([(1, None, None, None)], SCHEMA))) == collections.Counter()
    same = [(1, "a b", "x", "s"), (1, "a b", "x", "s"), (1, "a b", "x", "t")] * 10
    assert got(divergence.divergence(spark.createDataFrame(same, SCHEMA))) == brute(same)


def test_shares_stay_exact_beyond_long(spark):
    row = spark.sql("SELECT 9000000000000000000 AS c, 9100000000000000000 AS n, 3L AS v").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()
    assert row[0] == 1 + 10**9 * (9 * 10**18 + 2) // (91 * 10**17 + 6)
