"""Blocks of documents: from plain text, tidied, counted, and rendered as Markdown.

A document is a row with ``blocks``, an array of (kind, text, level, rows); rows of a table are arrays of
cells (text, col_span, row_span).  All of this is array expressions, so a document never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_escape, html_escape, squash, strip, yaml_escape

CELL = "struct<text:string,col_span:int,row_span:int>"
BLOCK = f"struct<kind:string,text:string,level:int,rows:array<array<{CELL}>>>"
# Fixed value: what an item of a list starts with.
LIST_ITEM = r"(?U)^\s*(?:-|\d+\.)\s+\S"
# The statistics of the frontmatter, in order.
STATS = ["headings", "paragraphs", "tables", "images", "footnotes", "pages", "slides", "sheets", "rows"]


def block(kind: str, text: Column, level: Column | None = None, rows: Column | None = None) -> Column:
    none = F.lit(None).cast(f"array<array<{CELL}>>")
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(0) if level is None else level).cast("int").alias("level"), (none if rows is None else rows).alias("rows"))


def paragraphs(text: Column) -> Column:
    """Paragraphs of plain text: what blank lines divide."""
    chunks = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?U)\n\s*\n")
    return F.filter(F.transform(chunks, strip), lambda x: x != "")


def text_blocks(text: Column) -> Column:
    return F.flatten(F.transform(paragraphs(text), lambda x: F.array(block("para", x), block("blank", F.lit("")))))


def markdown_body(text: Column) -> Column:
    """Markdown without its frontmatter."""
    return strip(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?s)\A---\n.*?\n---\n", ""))


def markdown_stats(body: Column) -> dict[str, Column]:
    return {
        "headings": F.regexp_count(body, F.lit(r"(?mU)^#{1,6}\s+\S")),
        "paragraphs": F.size(F.filter(F.split(body, r"(?U)\n\s*\n"), lambda p: strip(p) != "")),
        "tables": F.regexp_count(body, F.lit(r"(?m)^\|.+\|[ \t]*\n\|[-: |]+\|[ \t]*$")),
        "images": F.regexp_count(body, F.lit(r"!\[[^\]]*\]\([^)]+\)")),
    }


def tidied(blocks: Column) -> Column:
    """Of blanks in a row one stays, none at the ends."""
    kept = F.filter(blocks, lambda b, i: (b["kind"] != "blank") | (i == 0) | (F.get(blocks, i - 1)["kind"] != "blank"))
    kept = F.filter(kept, lambda b, i: (b["kind"] != "blank") | (i > 0))
    return F.when((F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1)["kind"] == "blank"), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def counts(blocks: Column) -> dict[str, Column]:
    def of(kind):
        return F.size(F.filter(blocks, lambda b: b["kind"] == kind))

    return {"headings": of("heading"), "paragraphs": of("para"), "tables": of("table")}


def simple(rows: Column) -> Column:
    """Whether rows are equally wide and no cell spans another."""
    spans = F.exists(rows, lambda r: F.exists(r, lambda c: (c["col_span"] > 1) | (c["row_span"] > 1)))
    return ~spans & (F.size(F.array_distinct(F.transform(rows, F.size))) == 1)


def pipe_table(rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: line(F.transform(r, lambda c: cell_escape(c["text"]))))
    rule = line(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def html_table(rows: Column) -> Column:
    def span(name, n):
        return F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")

    def cell(c):
        return F.concat(F.lit("    <td"), span("colspan", c["col_span"]), span("rowspan", c["row_span"]), F.lit(">"), html_escape(c["text"]), F.lit("</td>\n"))

    body = F.transform(rows, lambda r: F.concat(F.lit("  <tr>\n"), F.array_join(F.transform(r, cell), ""), F.lit("  </tr>\n")))
    return F.concat(F.lit("<table>\n"), F.array_join(body, ""), F.lit("</table>"))


def table(rows: Column) -> Column:
    return F.when(F.size(rows) <= 0, "").when(simple(rows), pipe_table(rows)).otherwise(html_table(rows))


def body(blocks: Column, footnotes: Column | None = None, assets: Column | str = ".") -> Column:
    """Markdown of blocks and footnotes (num, text); items of a list that follow each other stay together."""
    shown = F.transform(
        F.filter(blocks, lambda b: b["kind"] != "blank"),
        lambda b: F.struct(
            b["kind"].alias("kind"),
            F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"]))
            .when(b["kind"] == "para", F.replace(b["text"], F.lit("{ASSETS}"), F.lit(assets) if isinstance(assets, str) else assets))
            .when(b["kind"] == "table", table(b["rows"]))
            .otherwise(b["text"])
            .alias("text"),
        ),
    )

    def piece(b, i):
        before = F.get(shown, i - 1)
        close = (b["kind"] == "para") & b["text"].rlike(LIST_ITEM) & before["text"].rlike(LIST_ITEM)
        return F.concat(F.when(i == 0, "").when(close, "\n").otherwise("\n\n"), b["text"])

    text = F.array_join(F.transform(shown, piece), "")
    if footnotes is not None:
        notes = F.array_join(F.transform(footnotes, lambda n: F.concat(F.lit("[^"), n["num"].cast("string"), F.lit("]: "), n["text"])), "\n")
        text = F.concat(text, F.when(F.size(footnotes) > 0, F.concat(F.lit("\n\n---\n\n"), notes)).otherwise(""))
    return F.concat(strip(F.regexp_replace(text, "\n{3,}", "\n\n")), F.lit("\n"))


def frontmatter(source: Column, rendered: Column, converted_at: Column, stats: dict[str, Column], encoding: Column | None = None) -> Column:
    """A YAML head; statistics that are null don't appear."""
    ext = F.regexp_extract(source, r"\.([^.]*)$", 1)
    lines = [F.lit("---"), F.concat(F.lit('source: "'), yaml_escape(source), F.lit('"')), F.concat(F.lit("format: "), F.coalesce(F.nullif(F.lower(ext), F.lit("")), F.lit("unknown"))), F.concat(F.lit("converted_at: "), converted_at)]
    lines += [F.concat(F.lit(f"{k}: "), stats[k].cast("string")) for k in STATS if k in stats]
    if encoding is not None:
        lines.append(F.concat(F.lit("encoding: "), encoding))
    lines += [F.concat(F.lit("chars: "), F.length(rendered).cast("string")), F.lit("---")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def log_summary(stats: dict[str, Column]) -> Column:
    """The statistics that aren't zero, in words."""
    words = {"headings": "제목", "tables": "표", "images": "그림", "footnotes": "각주", "pages": "쪽", "slides": "슬라이드", "sheets": "시트"}
    parts = [F.when(F.coalesce(stats[k], F.lit(0)) > 0, F.concat(F.lit(f"{w} "), stats[k].cast("string"))) for k, w in words.items() if k in stats]
    return F.coalesce(F.nullif(F.concat_ws(" · ", *parts), F.lit("")), F.lit("본문만"))


def grid(rows: DataFrame, row_cols: list[str], cells: str, limit: int = 2000) -> DataFrame:
    """Rows of text cells as one table for each group: blank rows go, the rest is padded, squashed and limited.

    rows: row_cols (the group), row (its order), cells (array of strings).  Adds truncated.
    """
    kept = rows.where(F.exists(cells, lambda c: strip(c) != ""))
    # one row more than are shown says that there are more; no further ones are put together
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy(*row_cols).orderBy("row"))).where(F.col("n") <= limit + 1)
    used = F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct("n", F.col(cells).alias("c")))))
    listed = kept.groupBy(*row_cols).agg(used.alias("u"), (F.max("n") > limit).alias("truncated"))
    wide = F.array_max(F.transform("u", lambda x: F.size(x["c"])))
    made = F.transform("u", lambda x: F.transform(F.concat(x["c"], F.array_repeat(F.lit(""), (F.col("wide") - F.size(x["c"])).cast("int"))), lambda t: F.struct(squash(t).alias("text"), F.lit(1).alias("col_span"), F.lit(1).alias("row_span"))))
    return listed.withColumn("wide", wide).select(*row_cols, made.alias("rows"), "truncated")
