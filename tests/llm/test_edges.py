"""Edges of earlier operators: rows that repeat an id, numbers of files, and null ids."""

import collections

from pyspark.sql import functions as F

from paperweir.llm import exact_dedup, line_dedup, token_files


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b"), (1, "ab"), (1, "ab"), (1, "a  b"), (2, "a  b"), (3, "c"), (3, "c"), (None, "d "), (None, "d"), (None, None), (4, "")]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), fan=2).collect()
    stay = collections.Counter((r["text_sha256"], r["doc_id"], r["keep_id"]) for r in got if r["stays"])
    assert len(stay) == 4 and set(stay.values()) == {1} and all(i == k for _, i, k in stay)
    sizes = {r["text_sha256"]: r["group_size"] for r in got}
    assert sorted(sizes.values()) == [2, 2, 2, 5]


def test_files_beyond_a_hundred_thousand(spark):
    rows = [(f"part-{n:05d}-x.parquet", 0, n) for n in (99_998, 99_999, 100_000, 100_001, 7)] + [("part-100000-x.parquet", 1, 5), ("other", 0, 1)]
    made = token_files.with_starts(spark.createDataFrame(rows, "file string, row long, n_tokens long"))
    got = {(r["file"], r["row"]): r["start"] for r in made.collect()}
    start = got["other", 0] + 1 if got["other", 0] == 0 else 0
    for name, row, n in [("part-00007-x.parquet", 0, 7), ("part-99998-x.parquet", 0, 99_998), ("part-99999-x.parquet", 0, 99_999), ("part-100000-x.parquet", 0, 100_000), ("part-100000-x.parquet", 1, 5), ("part-100001-x.parquet", 0, 100_001)]:
        assert got[name, row] == start, (name, row)
        start += n


def test_a_copy_of_a_row_without_id(spark):
    line = "one line of fifty words " * 12
    rows = [(None, f"x\n{line}"), (5, f"y\n{line}")]
    got = {r["doc_id"]: r["runs"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None] == [] and [r["copy_of"] for r in got[5]] == [None]
    assert line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("runs") > 0).count() == 1
