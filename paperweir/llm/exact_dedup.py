"""Exact dedup as a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a run of digests, merged before it leaves its task.  In a round, runs whose numbers
agree but for their last binary digits meet: a multiway merge keeps, for each digest, the number of rows and
the best row, so a digest has at most ``FAN`` rows to merge at any node whatever its frequency.  The decision
then goes down the same tree to the rows of each group of ``FAN`` runs.  The text itself never moves: a
second, independent digest and the length verify what the first one calls equal.

A null text counts as empty.  Of equal texts the row with the longest original text (code points)
stays, then the one with the smallest id (null last); rows that repeat an id are rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Runs that one node of the tree merges: four binomial rounds at once.
FAN = 16
KEY = ["sha", "check", "size"]


def normalised(text: Column) -> Column:
    """Text without the characters [\\x20\\x09-\\x0D]; null gives the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document: its id, digest, check, length and the run that it is in."""
    text = F.col("_text")
    return (
        docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), normalised(F.col(text_col)).alias("_text"))
        .select("id", "points", F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("size"))
        .withColumns({"run": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )


def merged(runs: DataFrame, node: Column) -> DataFrame:
    """Merges the runs of each node: rows of a digest and its best row so far."""
    return runs.groupBy(node.alias("node"), *KEY).agg(F.sum("n").alias("n"), F.min("best").alias("best"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size, kept, text_sha256, stays.

    Where a kept id is itself repeated with the same text, every row of it counts as ``kept``; ``stays`` is true for one row of each
    group: of the rows of the kept id one with the longest original text, and of equal ones any.
    """
    rows = stored(digests(docs, id_col, text_col).withColumn("up", F.floor(F.col("run") / fan).cast("int")), "digests")
    best = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "row")
    top = (rows.agg(F.max("run")).first()[0] or 0) // fan
    # a run itself is merged before it leaves its task, by the map side of the first grouping
    levels = [stored(merged(rows.select(*KEY, "up", F.lit(1).cast("long").alias("n"), best.alias("best")), F.col("up")), "level1")]
    while top > 0:
        top //= fan
        levels.append(stored(merged(levels[-1], F.floor(F.col("node") / fan).cast("int")), f"level{len(levels) + 1}"))
    found = levels[-1].select(F.col("node").alias("up"), *KEY, F.col("n").alias("group_size"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    for level in levels[-2::-1]:
        below = level.select("node", *KEY, F.floor(F.col("node") / fan).cast("int").alias("up"))
        found = below.join(found, ["up", *KEY]).select(F.col("node").alias("up"), *KEY, "group_size", "keep_id", "keep_row")
    return rows.join(found, ["up", *KEY]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), (F.col("row") == F.col("keep_row")).alias("stays")
    )


def op2_exact_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", F.col("stays").alias("kept"), "text_sha256")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
