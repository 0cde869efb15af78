"""Operator 12 against a search over all windows."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperweir.llm import substring_dedup as sd

DOCS = "doc_id long, text string"
LAST = 2**63 - 1


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least.get(x, LAST), i)
    out = []
    for (given, _), i, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((given, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return collections.Counter(out)


def got(frame):
    rows = frame.collect()
    for r in rows:
        assert all(s["first"] <= s["last"] < r["n_words"] for s in r["removed"])
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["removed"], r["removed"][1:]))
    return collections.Counter((r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["removed"]), r["text"]) for r in rows)


def some(seed, n=120, alphabet=6):
    """Documents that share passages: few words, so windows repeat inside and between them."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(f"w{x}" for x in rng.integers(0, alphabet if i % 3 else 10_000, rng.integers(0, 40))) for _ in range(3)]
        if i % 2:
            parts.insert(1, passages[i % 5])
        rows.append((int(rng.integers(0, n)), rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows


ODD = [(5, None), (4, ""), (3, " \n "), (2, "a b c"), (1, "x " * 13), (6, "x " * 13), (6, "x " * 13), (0, "x " * 12), (None, "x " * 20), (None, "x " * 20), (7, "é\x1cz ü " * 30), (8, "é\x1cz\x0bü\x0c" * 30), (9, "y" * 100_000 + " " + "x " * 14)]


@pytest.mark.parametrize(("window", "seed"), [(13, 4), (5, 2), (3, 3), (2, 1)])
def test_substring_dedup_is_the_search(spark, window, seed):
    rows = some(window) + ODD
    docs = spark.createDataFrame(rows, DOCS).repartition(6).withColumns({"block": F.lit(1), "ids": F.lit("x"), "words": F.lit(2)})
    assert got(sd.substring_dedup(docs, window=window, seed=seed)) == brute(rows, window)


def test_many_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 2000)
    rng = np.random.default_rng(1)
    long = " ".join(f"v{x}" for x in rng.integers(0, 1_000_000, 60_000))
    rows = [(3, long), (1, " ".join(long.split()[100:50_000])), *((i + 10, "the same license line in every one of the many documents that there are here today " + str(i)) for i in range(300))]
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    assert got(sd.substring_dedup(docs)) == brute(rows, 13)


def test_no_documents(spark):
    assert sd.substring_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that is always 0 the words themselves decide."""
    strings = pa.array(["a b c d", "b c d e", "a b d c", "a b c"], pa.large_string())
    low = np.array([4, 2, 1, 3])
    want = sd.earliest(low, strings, 3)
    monkeypatch.setattr(sd, "mix", lambda h: h * np.uint64(0))
    have = sd.earliest(low, strings, 3)
    assert have[0].tolist() == want[0].tolist() == [3, 2, 2, 2, 1, 1, 3]


def test_documents_without_text_fill_blocks_too(spark):
    docs = spark.range(0, 600_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    sizes = sd.blocks(docs, "doc_id", "text").select(F.size("ids").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 600_000 and max(r["n"] for r in sizes) <= sd.BLOCK // sd.ROW
