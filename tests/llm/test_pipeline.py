"""The pipeline on planted cases; test_pipeline_plain.py holds its exact stages to plain versions."""

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline


def plant(tmp_path, spark):
    rng = np.random.default_rng(11)
    vocabulary = ["the", "and", "tion", "with", "from", "that", "this", "house", "river", "stone", "green", "walk"]
    prose = lambda n, s: " ".join(f"{vocabulary[int(x)]}{'' if x % 3 else 'er'}" for x in np.random.default_rng(s).integers(0, 12, n))
    unique = lambda n, s: " ".join(f"wo{''.join(chr(97 + int(c)) for c in np.random.default_rng(s * 1000 + i).integers(0, 26, 6))}" for i in range(n))
    rows = [(i, prose(5, i) + " " + unique(60, i)) for i in range(20)]
    near = rows[3][1].split()
    near[20] = "different"
    item = unique(25, 500)
    rows += [(100, rows[1][1].replace(" ", "\n")), (101, rows[1][1] + "  "), (103, " ".join(near)), (104, rows[5][1] + " " + item + " " + unique(30, 77)), (105, "12345 !!"), (106, ""), (107, None), (2, rows[2][1])]
    rng.shuffle(rows)
    spark.createDataFrame([(int(i), t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_planted_cases(spark, tmp_path):
    rows = plant(tmp_path, spark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    # 105-107 have no letters; of rows 1, 100, 101 the longest stays; 103 is near 3; 104 holds the item; row 2 was there twice
    assert ids == collections.Counter([i for i in range(20) if i != 1] + [101])
    texts = dict(rows)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) > 0 and texts[r["doc_id"]] for r in got)


def test_stages_hand_on_the_columns(spark, tmp_path):
    plant(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", F.lit("extra"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
