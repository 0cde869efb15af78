"""Readers of a user as table functions: each gives the pieces of one file, blocks and pictures alike, and can be called from SQL.

    @plugins.reader
    def pages(content, name):
        yield {"kind": "heading", "text": name, "level": 2}
        yield {"kind": "image", "text": "a caption", "member": "p1.png", "content": b".."}

    plugins.pieces(found, pages)                                    # doc_id and PIECE
    spark.udtf.register("pages", pages)                             # SELECT .. FROM files f, LATERAL pages(f.content, f.name) p
    engine.convert(spark, folder, engine.Config(tables={"pdf": pages}))

A table function of another making will do if it takes (content, name) and gives ``at``, ``kind`` and ``text``; of the other
columns of ``PIECE`` it may leave out any, and more than those are passed over, so one whose columns depend on its arguments is fine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import squash
from ..operators.blocks import BLOCK, CELL
from ..sources import office

#: A piece of a file: its place, a block, or a picture (kind image) with its name in the file, its caption as text and its bytes.
PIECE = {"at": "int", "kind": "string", "text": "string", "level": "int", "rows": f"array<array<{CELL}>>", "member": "string", "content": "binary"}


def reader(read: Callable[[bytes, str], Iterator[dict]]):
    """A table function from one that yields the pieces of a file; what it raises is that file's error and stops no other."""

    @udtf(returnType=", ".join(f"{c} {t}" for c, t in PIECE.items()))
    class Reader:
        def eval(self, content, name):
            try:
                found = list(read(bytes(content or b""), name))
            except Exception as e:
                found = [{"kind": "error", "text": f"{type(e).__name__}: {e}"}]
            for at, piece in enumerate(found):
                cells = piece.get("rows")
                cells = cells and [[c if isinstance(c, tuple) else (c, 1, 1) for c in row] for row in cells]
                yield at, piece["kind"], piece.get("text") or "", piece.get("level") or 0, cells, piece.get("member"), piece.get("content")

    return Reader


def pieces(files: DataFrame, table, content: bool = True) -> DataFrame:
    """doc_id and the columns of ``PIECE`` of files (doc_id, name, content) by a table function or the name of a registered one."""
    spark, called = files.sparkSession, table
    if not isinstance(table, str):
        called = f"reader_{uuid.uuid4().hex}"
        spark.udtf.register(called, table)
    made = spark.sql(f"SELECT f.doc_id, p.* FROM {{files}} f, LATERAL {called}(f.content, f.name) p", files=files.select("doc_id", "name", "content"))
    given = set(made.columns)
    wanted = {c: t for c, t in PIECE.items() if content or c != "content"}
    return made.select("doc_id", *((F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()))


def documents(files: DataFrame, table) -> DataFrame:
    """doc_id, blocks, images (label, member) and error of files; pictures are numbered by their places, and their bytes stay behind."""
    image = F.col("kind") == "image"
    rows = pieces(files, table, content=False)
    label = F.concat(F.lit("img"), F.count_if(image).over(Window.partitionBy("doc_id").orderBy("at")).cast("string"))
    ending = F.lower(office.member_extension(F.col("member")))
    shown = F.concat(F.lit("!["), squash(F.col("text")), F.lit(f"]({office.ASSETS}/"), "label", ending, F.lit(")"))
    rows = rows.withColumn("label", label).withColumn("shown", F.when(image, shown).otherwise(F.col("text")))
    fields = F.struct(F.when(image, "para").otherwise(F.col("kind")).alias("kind"), F.col("shown").alias("text"), F.coalesce("level", F.lit(0)).alias("level"), "rows").cast(BLOCK)
    ordered = lambda test, x: F.array_sort(F.collect_list(F.when(test, F.struct("at", x.alias("x")))))["x"]
    told = rows.groupBy("doc_id").agg(
        ordered(F.col("kind") != "error", fields).alias("blocks"), ordered(image, F.struct("label", "member")).alias("images"),
        F.min_by("text", F.when(F.col("kind") == "error", F.col("at"))).alias("error"),
    )
    return files.select("doc_id").join(told, "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")))


def pictures(files: DataFrame, table) -> DataFrame:
    """doc_id, member and content of the pictures of files."""
    return pieces(files, table).where("kind = 'image' AND content IS NOT NULL").select("doc_id", "member", "content")
