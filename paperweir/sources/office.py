"""Office containers as relational work over their XML nodes: styles, shared strings and notes are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bold, clean_number, column_index, date_format_code, joined_path, latex, serial_date, squash, strip, style_level
from .markup import nodes

# Built-in number formats that show a date.
DATE_FORMATS = [*range(14, 23), 27, 30, 36, *range(45, 48), 50, 57]


PARTS = {
    "docx": r"^word/(document|styles|footnotes|endnotes)\.xml$|^word/_rels/document\.xml\.rels$",
    "xlsx": r"^xl/(workbook|sharedStrings|styles)\.xml$|^xl/_rels/workbook\.xml\.rels$|^xl/worksheets/[^/]+\.xml$",
    "pptx": r"^ppt/(presentation\.xml|_rels/presentation\.xml\.rels|slides/slide\d+\.xml|slides/_rels/slide\d+\.xml\.rels|notesSlides/[^/]+\.xml)$",
    "hwpx": r"(?i)^Contents/header\.xml$|section\d+\.xml$",
}
# Where pictures are looked for, and what stands for their folder.
PICTURES = {"docx": "word/", "pptx": "ppt/"}
ASSETS = "{ASSETS}"
# End of the fixed values.


def node_table(files: DataFrame, handler: str | None = None) -> DataFrame:
    """doc_id and the nodes of the parts that a handler reads; files has doc_id, content and, if it isn't told here, handler."""
    of = F.lit(handler) if handler else F.col("handler")
    return files.select("doc_id", F.explode(nodes(F.col("content"), of, PARTS)).alias("n")).select("doc_id", "n.*")


def relations(n: DataFrame, part: Column, folder: str) -> DataFrame:
    """doc_id, part, rid and target (a member's name) of the relations that are told in the parts for which ``part`` gives a name."""
    rows = n.where(F.col("tag") == "Relationship").withColumn("of", part).where("of IS NOT NULL")
    outside = F.lower(F.coalesce(attr("TargetMode"), F.lit(""))) == "external"
    return rows.select("doc_id", F.col("of").alias("part"), "ord", attr("Id").alias("rid"), F.when(outside, attr("Target")).otherwise(joined_path(F.lit(folder), attr("Target"))).alias("target"))


def pieces_joined(*order: str, by: str = "") -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.struct(*order, "text")))["text"], by)


def member_extension(member: Column) -> Column:
    found = F.regexp_extract(member, r"(\.[^./]*)$", 1)
    return F.when(found == "", ".bin").otherwise(found)


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def up(name: str) -> Column:
    return F.try_element_at("up", F.lit(name))


# ---- workbooks


def sheet_cells(n: DataFrame) -> DataFrame:
    """doc_id, sheet_no, sheet, row_idx, col_idx, text of the cells of visible sheets, as their types and styles show them."""
    sheets = n.where("part = 'xl/workbook.xml' AND tag = 'sheet'").select("doc_id", "ord", attr("name").alias("sheet"), attr("id").alias("rid"), F.lower(F.coalesce(attr("state"), F.lit(""))).alias("state"))
    rels = relations(n, F.when(F.col("part") == "xl/_rels/workbook.xml.rels", "xl/workbook.xml"), "xl").select("doc_id", "rid", F.col("target").alias("part"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    shown = sheets.where("state NOT IN ('hidden', 'veryhidden')").withColumn("sheet_no", F.row_number().over(order)).join(rels, ["doc_id", "rid"]).select("doc_id", "sheet_no", "sheet", "part")

    strings = n.where("part = 'xl/sharedStrings.xml'")
    items = strings.where("tag = 'si'").select("doc_id", "ord", (F.row_number().over(order) - 1).alias("si"))
    texts = strings.where((F.col("tag") == "t") & up("rPh").isNull()).select("doc_id", up("si").alias("ord"), F.col("ord").alias("at"), "text")
    shared = items.join(texts, ["doc_id", "ord"], "left").groupBy("doc_id", "si").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "text")))["text"], "").alias("shared"))

    styles = n.where("part = 'xl/styles.xml'")
    custom = styles.where("tag = 'numFmt'").select("doc_id", attr("numFmtId").cast("int").alias("fmt"), date_format_code(attr("formatCode")).alias("custom"))
    formats = styles.where((F.col("tag") == "xf") & up("cellXfs").isNotNull()).select("doc_id", (F.row_number().over(order) - 1).alias("s"), attr("numFmtId").cast("int").alias("fmt"))
    dated = formats.join(custom, ["doc_id", "fmt"], "left").select("doc_id", "s", F.coalesce("custom", F.col("fmt").isin(*DATE_FORMATS)).alias("dated"))

    body = n.where(F.col("part").startswith("xl/worksheets/"))
    cells = body.where("tag = 'c'").select("doc_id", "part", "ord", attr("r").alias("ref"), F.coalesce(attr("t"), F.lit("n")).alias("t"), F.coalesce(attr("s").try_cast("int"), F.lit(0)).alias("s"))
    values = body.where("tag = 'v'").select("doc_id", "part", up("c").alias("ord"), F.col("text").alias("v"))
    inline = body.where((F.col("tag") == "t") & up("is").isNotNull()).groupBy("doc_id", "part", up("c").alias("ord")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("at"), "text")))["text"], "").alias("inline"))
    rows = cells.join(values, ["doc_id", "part", "ord"], "left").join(inline, ["doc_id", "part", "ord"], "left").join(shown, ["doc_id", "part"])
    rows = rows.withColumn("si", F.when(F.col("t") == "s", F.col("v").try_cast("int"))).join(shared, ["doc_id", "si"], "left").join(dated, ["doc_id", "s"], "left")
    text = (
        F.when(F.col("t") == "inlineStr", F.coalesce("inline", F.lit("")))
        .when(F.col("t") == "s", F.coalesce("shared", F.lit("")))
        .when(F.col("v").isNull(), "")
        .when(F.col("t") == "b", F.when(F.col("v") == "1", "TRUE").otherwise("FALSE"))
        .when(F.col("t") == "e", F.col("v"))
        .when(F.coalesce("dated", F.lit(False)), F.coalesce(serial_date(F.col("v").try_cast("double")), clean_number("v")))
        .otherwise(clean_number("v"))
    )
    return rows.select("doc_id", "sheet_no", "sheet", F.regexp_extract("ref", r"(\d+)$", 1).cast("int").alias("row_idx"), column_index(F.regexp_extract("ref", "^([A-Za-z]+)", 1)).alias("col_idx"), squash(text).alias("text"))


def sheet_tables(cells: DataFrame, limit: int = 2000) -> DataFrame:
    """doc_id, sheet_no, sheet, rows, truncated: blank rows go, gaps are filled, blank columns at the end are cut."""
    used = cells.where("text <> ''")
    wide = used.groupBy("doc_id", "sheet_no").agg((F.max("col_idx") + 1).alias("wide"))
    lines = used.groupBy("doc_id", "sheet_no", "sheet", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("m"))
    # one row more than are shown says that there are more; no further ones are put together
    n = F.row_number().over(Window.partitionBy("doc_id", "sheet_no").orderBy("row_idx"))
    lines = lines.withColumn("n", n).where(F.col("n") <= limit + 1)
    dense = lines.join(wide, ["doc_id", "sheet_no"]).withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda i: F.struct(F.coalesce(F.try_element_at("m", i), F.lit("")).alias("text"), F.lit(1).alias("col_span"), F.lit(1).alias("row_span"))))
    listed = F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct("n", "cells"))))["cells"]
    return dense.groupBy("doc_id", "sheet_no", "sheet").agg(listed.alias("rows"), (F.max("n") > limit).alias("truncated"))


# ---- word documents

_TOP = r"^[^/]+(?:/body)?(?:/(?:sdt|sdtContent))*"
_PARAGRAPH = rf"{_TOP}(?:/tbl/tr/tc)*/p"
_RUN = rf"{_PARAGRAPH}(?:/(?:hyperlink|ins|smartTag|sdt|sdtContent|bookmarkStart|fldSimple))*/r"
_PICTURE_TAGS, _REFERENCES = ("drawing", "pict", "object"), ("footnoteReference", "endnoteReference")


def word_blocks(n: DataFrame) -> dict[str, DataFrame]:
    """blocks (doc_id, at, kind, level, text, rows), notes (doc_id, num, text) and images (doc_id, label, member) of Word documents.

    Each node is told the paragraph and the run that it stands in; what runs and paragraphs say and how they look
    are groupings over that.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)  # running values from the end
    d = n.where("part = 'word/document.xml'")
    latest = lambda test: F.last(F.when(test, F.struct("ord", "last")), ignorenulls=True).over(upto)
    ahead = lambda test, rid: F.last(F.when(test, F.struct("ord", rid.alias("rid"))), ignorenulls=True).over(onward)
    blip, data = ahead(F.col("tag") == "blip", F.coalesce(attr("embed"), attr("link"))), ahead(F.col("tag") == "imagedata", F.coalesce(attr("r:id"), attr("id")))
    d = d.withColumns({"p": latest(F.col("path").rlike(_PARAGRAPH + "$")), "r": latest(F.col("path").rlike(_RUN + "$")), "blip": blip, "data": data})
    in_run = F.coalesce((F.col("r.ord") < F.col("ord")) & (F.col("ord") <= F.col("r.last")), F.lit(False))
    inside = lambda c: F.when(F.col(f"{c}.ord") <= F.col("last"), F.col(f"{c}.rid"))
    d = d.withColumns({"in_run": in_run, "rid": F.when(F.col("tag").isin(*_PICTURE_TAGS), F.coalesce(inside("blip"), inside("data")))}).drop("blip", "data")

    rels = relations(n, F.when(F.col("part") == "word/_rels/document.xml.rels", "word/document.xml"), "word").select("doc_id", "rid", F.col("target").alias("member"))
    images = d.where("in_run AND rid IS NOT NULL").select("doc_id", "ord", "rid").join(rels, ["doc_id", "rid"]).where(F.col("member").startswith(PICTURES["docx"]))
    images = images.select("doc_id", "ord", F.concat(F.lit("img"), F.row_number().over(order).cast("string")).alias("label"), "member")
    refs = d.where(F.col("tag").isin(*_REFERENCES) & F.col("in_run")).select("doc_id", "ord", F.regexp_replace("tag", "Reference", "").alias("kind"), attr("id").alias("id"))
    refs = refs.join(note_texts(n).where("text <> ''"), ["doc_id", "kind", "id"])
    refs = refs.withColumn("first", F.min("ord").over(Window.partitionBy("doc_id", "kind", "id"))).withColumn("num", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")))
    picture = F.concat(F.lit("\n!["), "label", F.lit(f"]({ASSETS}/"), "label", F.lower(member_extension(F.col("member"))), F.lit(")\n"))
    marks = images.select("doc_id", "ord", picture.alias("mark")).unionByName(refs.select("doc_id", "ord", F.concat(F.lit("[^"), F.col("num").cast("string"), F.lit("]")).alias("mark")))

    d = d.join(marks, ["doc_id", "ord"], "left")
    piece = F.coalesce(F.when(F.col("tag") == "t", F.col("text")).when(F.col("tag") == "tab", " ").when(F.col("tag").isin("br", "cr"), "\n").when(F.col("tag") == "noBreakHyphen", "-"), F.col("mark"))
    of_p = lambda below: F.col("path").rlike(rf"{_PARAGRAPH}/pPr/{below}$")
    on = F.col("path").rlike(rf"{_RUN}/rPr/(?:b|bCs)$") & ~F.lower(F.trim(F.coalesce(attr("val"), F.lit("")))).isin("0", "false", "none", "off")
    told = {
        "style": F.max(F.when(of_p("pStyle"), attr("val"))),
        "outline": F.max(F.when(of_p("outlineLvl"), F.coalesce(attr("val"), F.lit("0")).try_cast("int"))),
        "numbered": F.max(of_p("numPr")),
        "ilvl": F.max(F.when(of_p("numPr/ilvl"), attr("val").try_cast("int"))),
        "place": F.max(F.when(F.col("ord") == F.col("p.ord"), F.struct("path", up("tc").alias("tc")))),
    }
    d = d.where((F.col("ord") >= F.col("p.ord")) & (F.col("ord") <= F.col("p.last")))
    spoken = d.groupBy("doc_id", F.col("p.ord").alias("p"), F.when(F.col("in_run"), F.col("r.ord")).alias("r")).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(piece.isNotNull() & F.col("in_run"), F.struct("ord", piece.alias("text")))))["text"], "").alias("text"), F.max(on).alias("strong"), *(c.alias(k) for k, c in told.items())
    )
    said = F.when(F.col("r").isNotNull(), F.struct("r", F.when(F.col("strong"), bold("text")).otherwise(F.col("text")).alias("text")))
    paragraph = spoken.groupBy("doc_id", "p").agg(strip(F.regexp_replace(F.array_join(F.array_sort(F.collect_list(said))["text"], ""), r"[ \t]+", " ")).alias("text"), *(F.max(k).alias(k) for k in told))

    styles = n.where("part = 'word/styles.xml'").where(up("style").isNotNull() | (F.col("tag") == "style")).groupBy("doc_id", F.coalesce(up("style"), F.col("ord")).alias("ord")).agg(
        F.max(F.when(F.col("tag") == "style", attr("styleId"))).alias("style"),
        F.max(F.when(F.col("path").rlike("/style/name$"), attr("val"))).alias("name"),
        F.max(F.when(F.col("path").rlike("/style/pPr/outlineLvl$"), F.coalesce(attr("val"), F.lit("0")).try_cast("int") + 1)).alias("own"),
        F.max(F.col("path").rlike("/style/pPr/numPr$")).alias("numbered"),
    )
    listed = F.col("numbered") | strip(F.coalesce(F.nullif("name", F.lit("")), "style")).rlike("(?i)^(?:List|목록)")
    styles = styles.where("style IS NOT NULL").groupBy("doc_id", "style").agg(F.max_by(F.struct(F.coalesce(style_level("name"), style_level("style"), "own").alias("level"), listed.alias("listed")), "ord").alias("look"))
    paragraph = paragraph.join(styles, ["doc_id", "style"], "left")
    asked = F.coalesce("look.level", style_level("style"), F.col("outline") + 1)
    lead = F.when(F.col("numbered"), F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce("ilvl", F.lit(0))))), F.lit("- "))).when(F.coalesce("look.listed", F.lit(False)), "- ").otherwise("")
    kind = F.when(F.col("text") == "", "blank").when(asked.isNotNull(), "heading").otherwise("para")
    text = F.when(kind == "heading", squash(F.replace("text", F.lit("**"), F.lit("")))).when(kind == "para", F.concat(lead, "text")).otherwise("")
    level = F.when(kind == "heading", F.greatest(F.lit(1), F.least(F.lit(6), asked))).otherwise(0)
    tables = word_tables(n.where("part = 'word/document.xml'"), paragraph.where("place.tc IS NOT NULL").select("doc_id", "p", F.col("place.tc").alias("tc"), "text"))
    plain = paragraph.where("place.tc IS NULL").select("doc_id", F.col("p").alias("at"), kind.alias("kind"), level.alias("level"), text.alias("text"), F.lit(None).cast(tables.schema["rows"].dataType).alias("rows"))
    blocks = plain.unionByName(tables.select("doc_id", F.col("tbl").alias("at"), F.lit("table").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text"), "rows"))
    return {"blocks": blocks, "notes": refs.select("doc_id", "num", "text").distinct(), "images": images.select("doc_id", "label", "member")}


def note_texts(n: DataFrame) -> DataFrame:
    """doc_id, kind, id and text of foot- and endnotes, without those that only separate."""
    notes = n.where(F.col("part").isin("word/footnotes.xml", "word/endnotes.xml"))
    of = F.coalesce(up("footnote"), up("endnote"), F.when(F.col("tag").isin("footnote", "endnote"), F.col("ord")))
    body = notes.where(of.isNotNull()).groupBy("doc_id", "part", of.alias("at")).agg(
        F.max(F.when(F.col("ord") == of, F.struct(F.col("tag").alias("kind"), attr("id").alias("id"), F.lower(F.coalesce(attr("type"), F.lit(""))).alias("type")))).alias("note"),
        squash(F.array_join(F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("ord", "text"))))["text"], " ")).alias("text"),
    )
    return body.where("note.id IS NOT NULL").where(~F.col("note.type").isin("separator", "continuationseparator", "continuationnotice")).groupBy("doc_id", "note.kind", "note.id").agg(F.max_by("text", "at").alias("text"))


def word_tables(d: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, tbl, rows of the outermost tables: spans to the right by gridSpan, down by vMerge.

    A table inside a cell becomes a line of the cell for each of its rows, from the innermost tables out.
    """
    nested = F.size(F.split("path", "/tbl/tr/tc")) - 1
    cells = d.where(F.col("path").rlike(rf"{_TOP}(?:/tbl/tr/tc)+$")).select("doc_id", F.col("ord").alias("tc"), up("tbl").alias("tbl"), up("tr").alias("tr"), up("tc").alias("outer"), nested.alias("depth"))
    deepest = cells.agg(F.max("depth")).first()[0] or 1
    lines = paragraphs.where("text <> ''").select("doc_id", "tc", F.col("p").alias("at"), "text")
    for depth in range(deepest, 1, -1):
        inner = cells.where(F.col("depth") == depth).join(lines.groupBy("doc_id", "tc").agg(pieces_joined("at", by="\n").alias("text")), ["doc_id", "tc"], "left")
        spread = inner.groupBy("doc_id", F.col("outer").alias("tc"), F.col("tr").alias("at")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(F.col("tc").alias("cell"), "text"))))["text"], " / ").alias("text"))
        lines = lines.unionByName(spread.select(*lines.columns))
    told = d.where(F.col("path").rlike("/tc/tcPr/(?:gridSpan|vMerge)$")).groupBy("doc_id", up("tc").alias("tc")).agg(
        F.max(F.when(F.col("tag") == "gridSpan", F.coalesce(attr("val"), F.lit("1")).try_cast("int"))).alias("wide"),
        F.max(F.when(F.col("tag") == "vMerge", F.lower(F.coalesce(F.nullif(attr("val"), F.lit("")), F.lit("continue"))))).alias("merge"),
    )
    text = lines.groupBy("doc_id", "tc").agg(pieces_joined("at", by="\n").alias("text"))
    rows = cells.where("depth = 1").join(told, ["doc_id", "tc"], "left").join(text, ["doc_id", "tc"], "left")
    rows = rows.select("doc_id", "tbl", "tr", "tc", F.greatest(F.lit(1), F.coalesce("wide", F.lit(1))).alias("wide"), "merge", F.coalesce("text", F.lit("")).alias("text"))
    return merged_table(rows.withColumns({"opens": F.col("merge").isNotNull(), "goes_on": F.coalesce(F.col("merge") == "continue", F.lit(False)), "high": F.lit(1)}))


def merged_table(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, rows from cells (doc_id, tbl, tr, tc, wide, high, opens, goes_on, text): one that goes on from an open cell above widens it downwards."""
    left = Window.partitionBy("doc_id", "tbl", "tr").orderBy("tc")
    cells = cells.withColumn("col", F.sum("wide").over(left) - F.col("wide"))
    down = Window.partitionBy("doc_id", "tbl", "col").orderBy("tr")
    # a cell joins the one above in its column if that is open, by itself or by going on
    joins = F.col("goes_on") & F.coalesce(F.lag(F.col("opens") | F.col("goes_on")).over(down), F.lit(False))
    cells = cells.withColumn("joins", joins)
    cells = cells.withColumn("group", F.sum((~F.col("joins")).cast("int")).over(down))
    whole = cells.groupBy("doc_id", "tbl", "col", "group").agg(
        F.min_by(F.struct("tr", "tc", "text", F.col("wide").cast("int").alias("wide"), "high"), "tr").alias("c"), F.count_if("joins").alias("more")
    )
    shown = F.struct("c.text", F.col("c.wide").alias("col_span"), (F.col("c.high") + F.col("more")).cast("int").alias("row_span"))
    lines = whole.groupBy("doc_id", "tbl", "c.tr").agg(F.array_sort(F.collect_list(F.struct("c.tc", shown.alias("cell"))))["cell"].alias("cells"))
    return lines.groupBy("doc_id", "tbl").agg(F.array_sort(F.collect_list(F.struct("tr", "cells")))["cells"].alias("rows"))


# ---- slides


_SHAPE = r"/spTree(?:/grpSp)*/(?:sp|pic|graphicFrame)"
# Fixed values.
NOTES, SLIDE = "> **발표자 노트** — ", "슬라이드 "
# End of the fixed values.


def slide_blocks(n: DataFrame, notes: bool = True) -> dict[str, DataFrame]:
    """blocks (doc_id, slide_no, at, kind, level, text, rows) and images of presentations: slides in their order, titles as headings."""
    own = F.concat(F.lit("ppt/slides/"), F.regexp_extract("part", r"_rels/(slide\d+\.xml)\.rels$", 1))
    rels = relations(n, F.when(F.col("part") == "ppt/_rels/presentation.xml.rels", "ppt/presentation.xml"), "ppt").select("doc_id", "rid", F.col("target").alias("part"))
    parts = n.where(F.col("part").rlike(r"^ppt/slides/slide\d+\.xml$") & (F.col("ord") == 0)).select("doc_id", "part")
    told = n.where(F.col("path").rlike("/sldIdLst/sldId$") & (F.col("part") == "ppt/presentation.xml")).select("doc_id", "ord", attr("r:id").alias("rid")).join(rels, ["doc_id", "rid"]).join(parts, ["doc_id", "part"])
    by_name = parts.join(told.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("ord", F.regexp_extract("part", r"(\d+)\.xml$", 1).cast("int"))
    slides = told.select("doc_id", "part", "ord").unionByName(by_name.select("doc_id", "part", "ord")).withColumn("slide_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    on = n.join(slides.drop("ord"), ["doc_id", "part"])

    order = Window.partitionBy("doc_id", "slide_no").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda test: F.last(F.when(test, F.struct("ord", "last", "tag")), ignorenulls=True).over(upto)
    on = on.withColumn("shape", latest(F.col("path").rlike(_SHAPE + "$")))
    on = on.where((F.col("ord") >= F.col("shape.ord")) & (F.col("ord") <= F.col("shape.last")))
    of = Window.partitionBy("doc_id", "slide_no", "shape.ord")
    titled = (F.col("tag") == "ph") & F.lower(F.coalesce(attr("type"), F.lit(""))).isin("title", "ctrtitle") & F.col("path").rlike("/spTree/sp/")
    on = on.withColumns({"titled": F.max(titled).over(of), "frame": F.min(F.when(F.col("tag") == "txBody", F.col("ord"))).over(of), "grid": F.min(F.when(F.col("tag") == "tbl", F.col("ord"))).over(of)})
    title = on.where("titled").groupBy("doc_id", "slide_no", F.col("shape.ord").alias("sp")).agg(squash(F.array_join(F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("ord", "text"))))["text"], " ")).alias("title"))
    title = title.groupBy("doc_id", "slide_no").agg(F.min(F.struct("sp", F.replace("title", F.lit("**"), F.lit("")).alias("title"))).alias("first")).select("doc_id", "slide_no", "first.*")
    number = F.col("slide_no").cast("string")
    named = slides.join(title, ["doc_id", "slide_no"], "left").select("doc_id", "slide_no", F.lit(-1).alias("at"), F.lit("heading").alias("kind"), F.lit(2).alias("level"), F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit(SLIDE), number)).otherwise(squash(F.concat(number, F.lit(". "), "title"))).alias("text"))
    rest = on.join(title.select("doc_id", "slide_no", F.col("sp").alias("title_sp")), ["doc_id", "slide_no"], "left").where(F.col("title_sp").isNull() | (F.col("title_sp") != F.col("shape.ord")))

    lines = rest.where((F.col("shape.tag") == "sp") & (up("txBody") == F.col("frame")) & (F.col("path").rlike("/txBody/p$") | up("p").isNotNull()))
    of_p = lambda below: F.col("path").rlike(f"/txBody/p/{below}$")
    runs = lines.groupBy("doc_id", "slide_no", F.coalesce(F.when(F.col("tag") == "p", F.col("ord")), up("p")).alias("p"), F.coalesce(F.when(of_p("r"), F.col("ord")), up("r"), F.when(of_p("(?:br|fld/t)"), F.col("ord"))).alias("r")).agg(
        F.max(F.when(of_p("r/t") | of_p("fld/t"), F.col("text")).when(of_p("br"), " ")).alias("text"),
        F.max(of_p("r/rPr") & F.lower(F.coalesce(attr("b"), F.lit(""))).isin("1", "true")).alias("strong"),
        F.max(F.when(of_p("pPr"), F.coalesce(attr("lvl"), F.lit("0")).try_cast("int"))).alias("lvl"),
    )
    strong = F.col("strong") & (strip("text") != "")
    said = F.when(F.col("text").isNotNull(), F.struct("r", F.when(strong, F.concat(F.lit("**"), strip("text"), F.lit("**"))).otherwise(F.col("text")).alias("text")))
    texts = runs.groupBy("doc_id", "slide_no", "p").agg(squash(F.array_join(F.array_sort(F.collect_list(said))["text"], "")).alias("text"), F.max("lvl").alias("lvl")).where("text <> ''")
    deep = F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce("lvl", F.lit(0))))
    body = texts.select("doc_id", "slide_no", F.col("p").alias("at"), F.lit("para").alias("kind"), F.lit(0).alias("level"), F.concat(F.repeat(F.lit("  "), deep), F.lit("- "), "text").alias("text"))

    linked = relations(n, F.when(F.col("part").startswith("ppt/slides/_rels/"), own), "ppt/slides").join(slides.drop("ord"), ["doc_id", "part"])
    seen = rest.where(F.col("shape.tag") == "pic").groupBy("doc_id", "slide_no", F.col("shape.ord").alias("at")).agg(
        F.min(F.when(F.col("tag") == "blip", F.struct("ord", F.coalesce(attr("embed"), attr("link")).alias("rid")))).alias("blip"), F.min(F.when(F.col("tag") == "cNvPr", F.struct("ord", squash(F.coalesce(attr("descr"), F.lit(""))).alias("alt")))).alias("name")
    )
    seen = seen.select("doc_id", "slide_no", "at", "blip.rid", "name.alt").join(linked.select("doc_id", "slide_no", "rid", F.col("target").alias("member")), ["doc_id", "slide_no", "rid"]).where(F.col("member").startswith(PICTURES["pptx"]))
    images = seen.withColumn("label", F.concat(F.lit("img"), F.row_number().over(Window.partitionBy("doc_id").orderBy("slide_no", "at")).cast("string")))
    caption = F.coalesce(F.nullif("alt", F.lit("")), "label")
    shown = images.select("doc_id", "slide_no", "at", F.lit("para").alias("kind"), F.lit(0).alias("level"), F.concat(F.lit("!["), caption, F.lit(f"]({ASSETS}/"), "label", F.lower(member_extension(F.col("member"))), F.lit(")")).alias("text"))

    merged = lambda k: F.lower(F.coalesce(attr(k), F.lit(""))).isin("1", "true")
    span = lambda k: F.greatest(F.lit(1), F.coalesce(attr(k).try_cast("int"), F.lit(1)))
    cells = rest.where((F.col("shape.tag") == "graphicFrame") & (F.coalesce(up("tbl"), F.lit(-1)) == F.col("grid"))).where(F.col("path").rlike("/tbl/tr/tc(?:/.*)?$"))
    tc = F.when(F.col("path").rlike("/tbl/tr/tc$"), F.col("ord"))
    cells = cells.groupBy("doc_id", F.struct("slide_no", F.col("shape.ord").alias("at")).alias("tbl"), F.coalesce(tc, up("tc")).alias("tc")).agg(
        F.max(F.when(tc.isNotNull(), F.struct(up("tr").alias("tr"), span("gridSpan").alias("span"), span("rowSpan").alias("high"), merged("hMerge").alias("aside"), merged("vMerge").alias("goes_on")))).alias("c"),
        squash(F.array_join(F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("ord", "text"))))["text"], " ")).alias("text"),
    ).select("doc_id", "tbl", "tc", "c.*", "text")
    # a cell that goes on to the right takes one column and shows nothing; so does one that goes on downwards without an open cell above
    cells = cells.withColumns({"wide": F.when(F.col("aside"), 1).otherwise(F.col("span")), "opens": (F.col("high") > 1) & ~F.col("aside") & ~F.col("goes_on"), "goes_on": F.col("goes_on") & ~F.col("aside")})
    tables = merged_table(cells.withColumn("hidden", F.col("aside") | F.col("goes_on")).withColumn("text", F.when(F.col("hidden"), F.lit(None)).otherwise(F.col("text"))).drop("hidden", "aside", "span"))
    rows = F.filter(F.transform("rows", lambda r: F.filter(r, lambda c: c["text"].isNotNull())), lambda r: F.size(r) > 0)
    tables = tables.withColumn("rows", rows).where(F.size("rows") > 0)
    out = named.unionByName(body).unionByName(shown)
    out = out.unionByName(slides.select("doc_id", "slide_no", F.lit(2_000_000_000).alias("at"), F.lit("blank").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text")))
    if notes:
        link = linked.where(F.col("target").contains("/notesSlides/")).groupBy("doc_id", "slide_no").agg(F.min_by("target", "ord").alias("part"))
        line = F.when(F.col("path").rlike("/txBody/p$"), F.col("ord"))
        told = n.where(F.col("part").startswith("ppt/notesSlides/") & up("txBody").isNotNull()).where(line.isNotNull() | (F.col("tag") == "t") & up("p").isNotNull())
        told = told.groupBy("doc_id", "part", F.coalesce(line, up("p")).alias("p")).agg(squash(F.array_join(F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("ord", "text"))))["text"], " ")).alias("text")).where(~F.col("text").rlike(r"(?U)^\d*$"))
        told = told.groupBy("doc_id", "part").agg(pieces_joined("p", by=" ").alias("text")).join(link, ["doc_id", "part"])
        out = out.unionByName(told.select("doc_id", "slide_no", F.lit(1_999_999_999).alias("at"), F.lit("para").alias("kind"), F.lit(0).alias("level"), F.concat(F.lit(NOTES), "text").alias("text")))
    out = out.withColumn("rows", F.lit(None).cast(tables.schema["rows"].dataType))
    out = out.unionByName(tables.select("doc_id", "tbl.slide_no", "tbl.at", F.lit("table").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text"), "rows"))
    return {"blocks": out, "images": images.select("doc_id", "label", "member")}


# ---- Hangul word processor files

# Containers whose content isn't body text, styles that are never headings, and what a lost picture leaves.
ASIDE = ["header", "footer", "pageNum", "autoNum", "newNum", "pageHiding", "pageOddEven"]
BODY_STYLES = ["본문", "바탕글", "Normal", "Body"]
LOST_PICTURE = "[그림 {}]"
# End of the fixed values.
_INSIDE = rf"(?:/ctrl/(?!(?:{'|'.join(ASIDE)})/)[^/]+)*"
_IN_RUN = rf"^(?:(?:.*/)?sec|[^/]+)/p/run{_INSIDE}"


def hwpx_blocks(n: DataFrame) -> dict[str, DataFrame]:
    """blocks (doc_id, section, at, kind, level, text, rows), notes and images of the sections, in order."""
    head = n.where(F.lower("part") == "contents/header.xml")
    style = head.where("tag = 'style'").groupBy("doc_id", attr("id").alias("style")).agg(F.max_by(F.struct(strip(F.coalesce(attr("name"), F.lit(""))).alias("name")), "ord").alias("s"))
    outline = head.where((F.col("tag") == "heading") & up("paraPr").isNotNull() & (F.upper(F.coalesce(attr("type"), F.lit(""))) == "OUTLINE")).select("doc_id", up("paraPr").alias("ord"), F.coalesce(attr("level"), F.lit("0")).try_cast("int").alias("outline"))
    outline = head.where("tag = 'paraPr'").select("doc_id", "ord", attr("id").alias("para")).join(outline, ["doc_id", "ord"]).groupBy("doc_id", "para").agg(F.max("outline").alias("outline"))
    strong = head.where((F.col("tag") == "bold") & F.col("path").rlike("/charPr/bold$")).select("doc_id", up("charPr").alias("ord"))
    strong = head.where("tag = 'charPr'").select("doc_id", "ord", attr("id").alias("char")).join(strong, ["doc_id", "ord"]).select("doc_id", "char", F.lit(True).alias("strong")).distinct()
    items = head.where("tag = 'binItem'").select("doc_id", F.coalesce(attr("id"), attr("binaryItemIDRef")).alias("ref"), F.coalesce(attr("href"), attr("binaryItemIDRef"), F.lit("")).alias("target")).groupBy("doc_id", "ref").agg(F.max("target").alias("target"))

    number = F.regexp_extract(F.lower("part"), r"section(\d+)\.xml$", 1).try_cast("int")
    d = n.withColumn("section", number).where("section IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("section", "part", "ord")
    in_part = Window.partitionBy("doc_id", "part").orderBy("ord")
    upto = in_part.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda test, *more: F.last(F.when(test, F.struct("ord", "last", *more)), ignorenulls=True).over(upto)
    # what a run holds directly, or inside a control: texts, tables, equations, pictures, notes and breaks
    unit = F.col("path").rlike(rf"{_IN_RUN}/(?:t|tbl|equation|pic|container|footNote|lineBreak|tab)$")
    # a character format is that of the run, or of the control's own element where one stands between
    run = F.col("path").rlike(r"^(?:(?:.*/)?sec|[^/]+)/p/run$") | F.col("path").rlike(rf"{_IN_RUN}$") & (F.col("tag") != "ctrl")
    d = d.withColumns({"p": latest(F.col("path").rlike(r"^(?:(?:.*/)?sec|[^/]+)/p$"), attr("styleIDRef").alias("style"), attr("paraPrIDRef").alias("para")), "run": latest(run, attr("charPrIDRef").alias("char")), "u": latest(unit, "tag")})
    d = d.where((F.col("ord") >= F.col("p.ord")) & (F.col("ord") <= F.col("p.last")))
    inside = (F.col("ord") >= F.col("u.ord")) & (F.col("ord") <= F.col("u.last"))
    key = ["doc_id", "section", "part"]

    # characters of a text element: its own and its descendants' texts, and tails after each descendant
    broken = F.when(F.col("tag") == "tab", " ").when(F.col("tag") == "lineBreak", "\n").otherwise(F.col("text"))
    texts = lambda root: F.array(F.struct("ord", F.lit(0).alias("side"), F.lit(0).alias("inner"), broken.alias("text")), F.struct(F.col("last").alias("ord"), F.lit(1).alias("side"), (-F.col("ord")).alias("inner"), F.when(F.col("ord") == root, "").otherwise(F.col("tail")).alias("text")))
    spell = lambda test, root: F.array_join(F.array_sort(F.flatten(F.collect_list(F.when(test, texts(root)))))["text"], "")
    in_t = F.coalesce(F.when(F.col("tag") == "t", F.col("ord")), up("t"))
    units = d.where(inside).groupBy(*key, F.col("p").alias("p"), F.col("u.ord").alias("u"), F.col("u.tag").alias("tag")).agg(
        F.max(F.when(F.col("ord") == F.col("u.ord"), F.col("run.char"))).alias("char"),
        spell(F.col("u.tag") == "t", F.col("u.ord")).alias("own"),
        spell((F.col("u.tag") == "equation") & (F.coalesce(F.when(F.col("tag") == "script", F.col("ord")), up("script")).isNotNull()), F.coalesce(F.when(F.col("tag") == "script", F.col("ord")), up("script"))).alias("script"),
        F.min(F.when((F.col("u.tag").isin("pic", "container")) & (F.col("tag") == "img"), F.struct("ord", F.coalesce(attr("binaryItemIDRef"), F.lit("")).alias("ref")))).alias("img"),
    )
    spoken = d.where(inside & F.col("u.tag").isin("tbl", "footNote") & in_t.isNotNull()).groupBy(*key, F.col("p.ord").alias("p"), F.col("u.ord").alias("u"), F.col("u.tag").alias("tag"), F.coalesce(up("tc"), F.lit(-1)).alias("tc"), in_t.alias("t")).agg(spell(F.lit(True), in_t).alias("text"))
    notes = spoken.where("tag = 'footNote'").groupBy(*key, "u").agg(squash(pieces_joined("t", by=" ")).alias("text"))
    notes = units.where("tag = 'footNote'").select(*key, "u").join(notes, [*key, "u"], "left").select(*key, "u", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "part", "u")).alias("num"), F.coalesce("text", F.lit("")).alias("text"))

    images = units.where("img IS NOT NULL").select(*key, "u", "img.ref", (F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "part", "u"))).alias("no")).join(items, ["doc_id", "ref"], "left")
    target = F.substring_index(F.coalesce("target", "ref"), "/", -1)
    stem = lambda c: F.lower(F.substring_index(c, ".", 1))
    members = n.where((F.col("part") == "#members") & F.lower(attr("name")).startswith("bindata/")).select("doc_id", attr("name").alias("member"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).alias("nth"))
    base = F.substring_index("member", "/", -1)
    named = images.join(members, "doc_id").where((F.lower(base) == F.lower(target)) | stem(base).isin(stem(target), F.lower("ref"))).groupBy(*key, "u").agg(F.min_by("member", "nth").alias("found"))
    images = images.join(named, [*key, "u"], "left").join(members.select("doc_id", F.col("nth").alias("no"), F.col("member").alias("spare")), ["doc_id", "no"], "left")
    images = images.select(*key, "u", "no", F.concat(F.lit("img"), F.col("no").cast("string")).alias("label"), F.coalesce("found", "spare").alias("member"))
    before, after = LOST_PICTURE.split("{}")
    picture = F.when(F.col("member").isNull(), F.concat(F.lit(f"\n{before}"), F.col("no").cast("string"), F.lit(f"{after}\n"))).otherwise(F.concat(F.lit("\n!["), "label", F.lit(f"]({ASSETS}/"), "label", member_extension(F.col("member")), F.lit(")\n")))
    marks = images.select(*key, "u", picture.alias("mark")).unionByName(notes.select(*key, "u", F.concat(F.lit("[^"), F.col("num").cast("string"), F.lit("]")).alias("mark")))

    units = units.join(marks, [*key, "u"], "left").join(strong, ["doc_id", "char"], "left")
    tag = F.col("tag")
    formula = strip("script")
    said = (
        F.when(tag == "t", F.when(F.coalesce("strong", F.lit(False)), bold("own")).otherwise(F.col("own"))).when(tag == "lineBreak", "\n").when(tag == "tab", " ")
        .when((tag == "equation") & (formula != ""), F.concat(F.lit(" $"), latex(formula), F.lit("$ "))).otherwise(F.col("mark"))
    )
    text = units.groupBy(*key, F.col("p.ord").alias("p")).agg(strip(F.regexp_replace(F.array_join(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("u", said.alias("text")))))["text"], ""), r"[ \t]{2,}", " ")).alias("text"), F.max(tag == "tbl").alias("tables"))
    paragraph = d.where(F.col("ord") == F.col("p.ord")).select(*key, F.col("ord").alias("p"), "p.style", "p.para").join(text, [*key, "p"], "left").join(style, ["doc_id", "style"], "left").join(outline, ["doc_id", "para"], "left")
    name = F.col("s.name")
    by_name = F.when(name.rlike(r"^(?:제목|개요|Heading|Outline)"), F.coalesce(F.nullif(F.regexp_extract(name, r"^(?:제목|개요|Heading|Outline)\s*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1)))
    asked = F.when(by_name.isNotNull(), by_name).when(F.coalesce(name.isin(*BODY_STYLES), F.lit(False)), None).otherwise(F.col("outline") + 1)
    level = F.when(asked > 0, F.least(F.lit(6), asked))
    content = F.coalesce("text", F.lit(""))
    kind = F.when(content == "", "blank").when(level > 0, "heading").otherwise("para")
    paragraph = paragraph.where((content != "") | ~F.coalesce("tables", F.lit(False)))
    tables = hwpx_tables(d.where(inside & (F.col("u.tag") == "tbl")), spoken.where("tag = 'tbl'"))
    plain = paragraph.select("doc_id", "section", "part", F.col("p").alias("at"), kind.alias("kind"), F.when(kind == "heading", level).otherwise(0).alias("level"), F.when(kind == "heading", strip(F.replace(content, F.lit("**"), F.lit("")))).otherwise(content).alias("text"), F.lit(None).cast(tables.schema["rows"].dataType).alias("rows"))
    blocks = plain.unionByName(tables.select("doc_id", "tbl.section", "tbl.part", F.col("tbl.u").alias("at"), F.lit("table").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text"), "rows"))
    return {"blocks": blocks, "notes": notes.select("doc_id", "num", "text"), "images": images.where("member IS NOT NULL").select("doc_id", "label", "member")}


def hwpx_tables(d: DataFrame, spoken: DataFrame) -> DataFrame:
    """doc_id, tbl and rows of the tables that stand in runs; a table inside a cell is text of the cell."""
    table = F.struct("section", "part", F.col("u.ord").alias("u"))
    direct = (F.col("u.ord") == up("tbl")) & F.col("path").rlike("/tbl/tr/tc$")
    latest = F.last(F.when(direct, F.struct("ord", "last", up("tr").alias("tr"))), ignorenulls=True).over(Window.partitionBy("doc_id", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("cell", latest).where((F.col("ord") >= F.col("cell.ord")) & (F.col("ord") <= F.col("cell.last")))
    span = lambda k: F.coalesce(attr(k).try_cast("int"), F.lit(1))
    in_t = F.coalesce(F.when(F.col("tag") == "t", F.col("ord")), up("t"))
    cells = d.groupBy("doc_id", table.alias("tbl"), F.col("cell.tr").alias("tr"), F.col("cell.ord").alias("tc")).agg(F.min(F.when(F.col("tag") == "cellSpan", F.struct("ord", span("colSpan").alias("wide"), span("rowSpan").alias("high")))).alias("span"))
    told = d.where((F.col("tag") == "t") & up("subList").isNotNull()).select("doc_id", table.alias("tbl"), F.col("cell.ord").alias("tc"), F.col("ord").alias("t"))
    texts = spoken.select("doc_id", F.struct("section", "part", "u").alias("tbl"), "t", "text")
    texts = told.join(texts, ["doc_id", "tbl", "t"]).groupBy("doc_id", "tbl", "tc").agg(squash(pieces_joined("t", by=" ")).alias("text"))
    cells = cells.join(texts, ["doc_id", "tbl", "tc"], "left")
    shown = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("span.wide", F.lit(1)).alias("col_span"), F.coalesce("span.high", F.lit(1)).alias("row_span"))
    lines = cells.groupBy("doc_id", "tbl", "tr").agg(F.array_sort(F.collect_list(F.struct("tc", shown.alias("cell"))))["cell"].alias("cells"))
    return lines.groupBy("doc_id", "tbl").agg(F.array_sort(F.collect_list(F.struct("tr", "cells")))["cells"].alias("rows"))
