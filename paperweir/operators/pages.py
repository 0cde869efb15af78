"""Lines of pages: repeated heads and feet dropped, numbered headings found, lines joined to paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash

# Patterns of headings (in order) with their level, of page numbers and bullets, and ends of sentences.
HEADINGS = [
    (r"(?U)^제\s*\d+\s*편(\s|\.|$)", 1),
    (r"(?U)^제\s*\d+\s*장(\s|\.|$)", 2),
    (r"(?U)^제\s*\d+\s*[절관](\s|\.|$)", 3),
    (r"(?U)^제\s*\d+\s*조(의\s*\d+)?(\s|\(|\.|$)", 4),
    (r"(?U)^\d+\.\d+\.\d+\.?\s+\S", 4),
    (r"(?U)^\d+\.\d+\.?\s+\S", 3),
    (r"(?U)^\d+\.\s+\S", 2),
    (r"(?U)^[IVX]+\.\s+\S", 2),
]
PAGE_NUMBER = r"(?U)^[-–—\s]*(?:\d{1,4}|[ivxlcIVXLC]{1,7})[-–—\s]*$"
BULLET = r"(?U)^\s*(?:[-•○●▪·*]|\(\d+\)|\d+\)|[가-힣]\.)\s+"
SENTENCE_ENDS = ["다.", "다,", ".", "요.", "함.", "음.", ":", ";", "!", "?", "”", '"', ")"]
LONGEST_HEADING, LONGEST_EDGE, LEAST_PAGES, SHARE, LEAST_TEXT = 60, 90, 3, 0.6, 20
SCANNED = "OCR"
# End of the fixed values.


def level(line: Column) -> Column:
    """Level of a numbered heading, else null."""
    out = F.when(F.length(line) > LONGEST_HEADING, F.lit(None).cast("int"))
    for pattern, n in HEADINGS:
        out = out.when(line.rlike(pattern), F.lit(n))
    return out


def ends_sentence(line: Column) -> Column:
    out = F.lit(False)
    for end in SENTENCE_ENDS:
        out = out | line.endswith(end)
    return out


def clean_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, line of pages (doc_id, page_no, text): squashed, blank ones gone."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"\R")).alias("line_no", "raw"))
    return lines.select("doc_id", "page_no", "line_no", squash(F.replace("raw", F.lit(" "), F.lit(" "))).alias("line")).where("line <> ''")


def marked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``edge``, whether a line is among the first or last two of its page, and ``same``, whether it is such a line on most pages.

    Lines are dealt out once, by document; all windows are within it.
    """
    over = lambda *c: Window.partitionBy("doc_id", *c)
    rows = lines.repartition("doc_id").withColumns({"top": F.row_number().over(over("page_no").orderBy("line_no")), "n": F.count("*").over(over("page_no"))})
    edge = ((F.col("top") <= 2) | (F.col("top") > F.col("n") - 2)) & (F.length("line") <= LONGEST_EDGE) & level(F.col("line")).isNull() & ~F.col("line").rlike(BULLET)
    rows = rows.withColumn("edge", edge)
    first = F.col("edge") & (F.row_number().over(over("page_no", "line", "edge").orderBy("line_no")) == 1)
    rows = rows.withColumns({"first": first.cast("int"), "pages": F.sum((F.col("top") == 1).cast("int")).over(over())})
    enough = F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("pages") * F.lit(SHARE)))
    same = (F.col("pages") >= LEAST_PAGES) & (F.sum("first").over(over("line")) >= enough)
    return rows.withColumn("same", same).select(*lines.columns, "edge", "same")


def repeated_edges(lines: DataFrame) -> DataFrame:
    """doc_id and line of what stands among the first or last two lines of most pages."""
    return marked(lines).where("edge AND same").select("doc_id", "line").distinct()


def body_lines(lines: DataFrame) -> DataFrame:
    """Lines without repeated edges, wherever they stand, and without page numbers."""
    return marked(lines).where(~F.col("same") & ~F.col("line").rlike(PAGE_NUMBER)).select(*lines.columns)


def scanned(lines: DataFrame) -> DataFrame:
    """doc_id, chars and the error of documents with hardly any text."""
    return lines.groupBy("doc_id").agg(F.sum(F.length("line")).alias("chars")).withColumn("error", F.when(F.col("chars") < LEAST_TEXT, SCANNED))


def reflowed(lines: DataFrame, headings: bool = True, by: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """Blocks of each page: seq, kind, level, text.  Headings and bullets stand alone, other lines join up to a sentence's end."""
    order = Window.partitionBy(*by).orderBy("line_no")
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("line").rlike(BULLET), "bullet").otherwise("text")
    rows = lines.withColumn("level", level(F.col("line")) if headings else F.lit(None).cast("int")).withColumn("kind", kind)
    last, last_line = F.lag("kind").over(order), F.lag("line").over(order)
    new = last.isNull() | (F.col("kind") != "text") | (last != "text") | ends_sentence(last_line)
    rows = rows.withColumn("seq", F.sum(new.cast("int")).over(order))
    joined = rows.groupBy(*by, "seq").agg(F.first("kind").alias("kind"), F.first("level").alias("level"), F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], " ").alias("text"))
    text = F.when(F.col("kind") == "bullet", F.regexp_replace("text", BULLET, "- ")).otherwise(F.col("text"))
    return joined.select(*by, "seq", F.when(F.col("kind") == "heading", "heading").otherwise("para").alias("kind"), F.coalesce("level", F.lit(0)).alias("level"), text.alias("text"))


def font_levels(spans: DataFrame) -> DataFrame:
    """Adds base and level to paragraphs (doc_id, block_idx, text, size): headings by size against the usual size.

    The usual size is the most frequent one, of equally frequent ones that which comes first.
    """
    sizes = spans.groupBy("doc_id", "size").agg(F.count("*").alias("c"), F.min("block_idx").alias("first"))
    base = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct(F.col("c"), -F.col("first"))).alias("base"))
    ratio = F.col("size") / F.col("base")
    found = F.when(F.length("text") > 100, None).when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).when(ratio >= 1.15, 3)
    return spans.join(base, "doc_id").withColumn("level", found)


def numbered_notes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes in the order of their first reference; a missing note is empty.  refs: doc_id, pos, kind, id; notes: doc_id, kind, id, text."""
    first = refs.groupBy("doc_id", "kind", "id").agg(F.min("pos").alias("pos"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "kind", "id"))
    return first.withColumn("num", number).join(notes, ["doc_id", "kind", "id"], "left").select("doc_id", "num", "kind", "id", F.coalesce("text", F.lit("")).alias("text"))


def merged_down(cells: DataFrame, by: tuple[str, ...] = ("doc_id", "col_idx")) -> DataFrame:
    """row_span of cells (.., row_idx, text, cont): a continuing cell adds to the open cell above it, or stands alone without one."""
    order = Window.partitionBy(*by).orderBy("row_idx")
    group = F.sum((~F.col("cont")).cast("int")).over(order)
    rows = cells.withColumn("open", F.when(group > 0, group))
    span = F.count("*").over(Window.partitionBy(*by, "open"))
    rows = rows.withColumn("row_span", F.when(F.col("open").isNull(), F.lit(1)).otherwise(span).cast("int"))
    return rows.where(~F.col("cont") | F.col("open").isNull()).drop("open", "cont")
