"""The dedup stages where ids repeat or are missing."""

import collections

import numpy as np

import corpus_pipeline


def prose(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def near(text):
    return " ".join(["other", *text.split()[1:]])


def run(spark, tmp_path, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return collections.Counter((r["doc_id"], r["text"]) for r in stage(spark, docs.repartition(3), str(tmp_path)).collect())


def test_exact_dedup_by_row(spark, tmp_path):
    a, b, c, d = (prose(s) for s in range(4))
    rows = [(1, a), (1, b), (2, a), (2, c), (3, c + " "), (None, a), (None, d), (None, d), (None, d + "\n"), (4, b), (4, b), (5, None), (None, ""), (6, "x")]
    # two texts of id 1 stay; id 2 loses its copies of 1 and 3 alone; of three rows without an id the longest stays
    assert run(spark, tmp_path, corpus_pipeline.exact_dedup_stage, rows) == collections.Counter([(1, a), (1, b), (3, c + " "), (None, d + "\n"), (5, None), (6, "x")])
    rows = [(7, a), (7, a), (7, b), (8, b), (8, c)]
    assert run(spark, tmp_path, corpus_pipeline.exact_dedup_stage, rows) == collections.Counter([(7, a), (7, b), (8, c)])


def test_near_dedup_by_row(spark, tmp_path):
    a, b, c, d, e = (prose(s) for s in range(5))
    rows = [(1, a), (1, b), (2, near(a)), (2, c), (None, near(b)), (None, d), (None, near(d)), (3, e), (3, near(e)), (4, None), (5, "")]
    got = run(spark, tmp_path, corpus_pipeline.near_dedup, rows)
    assert {x for x in got if x[0] in (1, 2, 4, 5)} == {(1, a), (1, b), (2, c), (4, None), (5, "")}
    assert (None, near(b)) not in got
    for pair in ([(None, d), (None, near(d))], [(3, e), (3, near(e))]):
        assert sum(got[x] for x in pair) == 1
    assert sum(got.values()) == 7
