"""The engine: folders of documents to Markdown, and Markdown to redacted copies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import safe_filename, squash
from ..operators import blocks, pages, redaction
from ..ship import ship
from ..sources import commit, files, formats, markup, office
from ..storage import stored
from ..streaming import inbox, source
from . import plugins

# What is said where nothing could be read.
NO_CONTENT = "내용이 없습니다."
TRUNCATED = "> 행이 많아 위 {}행까지만 옮겼습니다."
EMPTY = {"html": "본문을 찾지 못했습니다.", "txt": NO_CONTENT, "md": NO_CONTENT, "csv": NO_CONTENT}
NOTHING = "추출된 본문이 없습니다. 지원하지 않는 구조일 수 있습니다."
BROKEN = "파일이 손상되었거나 .{} 형식이 아닙니다."
NOT_A = {
    "docx": ("word/document.xml", "Word 문서 구조가 아닙니다. 97-2003 형식(.doc)이면 .docx로 저장한 뒤 넣어주세요."),
    "pptx": ("ppt/presentation.xml", "PowerPoint 구조가 아닙니다. 97-2003 형식(.ppt)이면 .pptx로 저장한 뒤 넣어주세요."),
    "xlsx": ("xl/workbook.xml", "Excel 구조가 아닙니다. 97-2003 형식(.xls)이면 .xlsx로 저장한 뒤 넣어주세요."),
}
# End of the fixed values.
TEXTS, CONTAINERS = ("txt", "md", "csv", "html", "json"), ("docx", "xlsx", "pptx", "hwpx")
NOTES, PICTURES = "array<struct<num:int,text:string>>", "array<struct<label:string,member:string>>"
COLUMNS = ["doc_id", "blocks", "footnotes", "images", "encoding", "pages", "slides", "sheets", "rows", "error"]


@dataclass(frozen=True)
class Config:
    sheet_max_rows: int = 2000
    include_speaker_notes: bool = True
    pdf_headings: bool = True
    pdf_page_marks: bool = False
    redact_include_review: bool = False
    #: Whether texts point to the pictures that ``pictures`` gives, or to no folder.
    extract_images: bool = True
    #: Texts of a PDF's pages from its bytes; none is bundled.
    page_texts: Callable[[bytes], list[str]] | None = None
    #: Readers of further handlers: files (doc_id, name, ext, handler, content) to (doc_id, blocks), see ``blocks.BLOCK``; one of a known handler takes its place.
    parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None
    #: Table functions (see ``plugins``), or names of registered ones, for handlers: they give blocks and pictures.
    tables: dict[str, object] | None = None
    #: Words of the user, or DataFrames of one column.
    user_names: tuple[str, ...] | DataFrame = ()
    user_stopwords: tuple[str, ...] | DataFrame = ()


def _whole(made: DataFrame, /, **more: Column) -> DataFrame:
    """Fills the columns that a parser leaves open."""
    kinds = {"footnotes": NOTES, "images": PICTURES, "encoding": "string", "pages": "int", "slides": "int", "sheets": "int", "rows": "int", "error": "string"}
    return made.select("doc_id", "blocks", *(more.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def _gathered(rows: DataFrame, *order: str) -> DataFrame:
    """Block rows (doc_id, order.., kind, text, level, rows) to one array for each document."""
    if "rows" not in rows.columns:
        rows = rows.withColumn("rows", F.lit(None).cast(f"array<array<{blocks.CELL}>>"))
    b = F.struct("kind", "text", F.col("level").cast("int").alias("level"), F.col("rows").cast(f"array<array<{blocks.CELL}>>").alias("rows"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, b.alias("b"))))["b"].alias("blocks"))


def _plain(texts: DataFrame, handler: str, config: Config) -> DataFrame:
    """Documents of one text format: texts has doc_id, name, ext, text, encoding."""
    t = texts.where(F.col("handler") == handler)
    if handler == "txt":
        return _whole(t.withColumn("blocks", blocks.text_blocks(F.col("text"))), encoding=F.col("encoding"))
    if handler == "md":
        body = blocks.markdown_body(F.col("text"))
        return _whole(t.withColumn("blocks", F.filter(F.array(blocks.block("raw", body)), lambda b: b["text"] != "")), encoding=F.col("encoding"))
    if handler == "json":
        t = t.withColumn("j", markup.pretty_json(F.col("text")))
        raw = blocks.block("raw", F.concat(F.lit("```json\n"), F.col("j.text"), F.lit("\n```")))
        return _whole(t.withColumn("blocks", F.filter(F.array(raw), lambda b: b["text"].isNotNull())), encoding=F.col("encoding"), error=F.col("j.error"))
    if handler == "html":
        found = _gathered(markup.html_blocks(t), "at")
        bad = F.get(F.filter("blocks", lambda b: b["kind"] == "error"), F.lit(0))["text"]
        made = t.select("doc_id", "encoding").join(found.withColumns({"error": bad, "blocks": F.filter("blocks", lambda b: b["kind"] != "error")}), "doc_id", "left")
        return _whole(made.withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{blocks.BLOCK}>"))), encoding=F.col("encoding"), error=F.col("error"))
    delimiter = F.when(F.col("ext") == ".tsv", markup.csv_rows(F.col("text"), "\t")).otherwise(markup.csv_rows(F.col("text")))
    t = stored(t.select("doc_id", "encoding", delimiter.alias("c")), "csv")
    lines = t.select("doc_id", F.posexplode("c.rows").alias("row", "cells"))
    grid = t.select("doc_id", "encoding", "c.error").join(blocks.grid(lines, ["doc_id"], "cells", config.sheet_max_rows or 2000), "doc_id", "left").where("error IS NOT NULL OR rows IS NOT NULL")
    note = F.when(F.col("truncated"), F.array(blocks.block("para", F.lit(TRUNCATED.format(config.sheet_max_rows or 2000))))).otherwise(F.array().cast(f"array<{blocks.BLOCK}>"))
    made = F.concat(F.array(blocks.block("table", F.lit(""), rows=F.col("rows"))).cast(f"array<{blocks.BLOCK}>"), note)
    made = F.when(F.col("rows").isNull(), F.array().cast(f"array<{blocks.BLOCK}>")).otherwise(made)
    return _whole(grid.withColumn("blocks", made).withColumn("n", F.size("rows")), encoding=F.col("encoding"), rows=F.col("n"), error=F.col("error"))


def _pdf(rows: DataFrame, config: Config) -> DataFrame:
    read = config.page_texts

    @pandas_udf(ArrayType(StringType()))
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([read(bytes(x)) for x in column])

    lines = pages.clean_lines(rows.select("doc_id", F.posexplode(texts("content")).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1))
    kept = pages.body_lines(lines)
    made = pages.reflowed(kept, config.pdf_headings)
    if config.pdf_page_marks:
        marks = kept.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(0).cast("long").alias("seq"), F.lit("para").alias("kind"), F.lit(0).alias("level"), F.concat(F.lit("<!-- page "), F.col("page_no").cast("string"), F.lit(" -->")).alias("text"))
        made = made.unionByName(marks)
    size = pages.scanned(kept).join(lines.groupBy("doc_id").agg(F.max("page_no").alias("n")), "doc_id")
    return _whole(_gathered(made, "page_no", "seq").join(size, "doc_id"), pages=F.col("n"), error=F.col("error"))


def _office(n: DataFrame, handler: str, config: Config) -> DataFrame:
    """Documents of one container format from their nodes (doc_id, part, ord, ..)."""
    count = {}
    if handler == "xlsx":
        sheets = office.sheet_tables(office.sheet_cells(n), config.sheet_max_rows or 2000)
        none = F.lit(None).cast(sheets.schema["rows"].dataType)
        heads = sheets.select("doc_id", "sheet_no", F.lit(0).alias("at"), F.lit("heading").alias("kind"), F.col("sheet").alias("text"), F.lit(2).alias("level"), none.alias("rows"))
        bodies = sheets.select("doc_id", "sheet_no", F.lit(1).alias("at"), F.lit("table").alias("kind"), F.lit("").alias("text"), F.lit(0).alias("level"), "rows")
        cut = sheets.where("truncated").select("doc_id", "sheet_no", F.lit(2).alias("at"), F.lit("para").alias("kind"), F.lit(TRUNCATED.format(config.sheet_max_rows or 2000)).alias("text"), F.lit(0).alias("level"), none.alias("rows"))
        made = {"blocks": heads.unionByName(bodies).unionByName(cut)}
        order, count = ("sheet_no", "at"), {"sheets": "sheet_no"}
    elif handler == "pptx":
        made, order, count = office.slide_blocks(n, config.include_speaker_notes), ("slide_no", "at"), {"slides": "slide_no"}
    elif handler == "docx":
        made, order = office.word_blocks(n), ("at",)
    else:
        made, order = office.hwpx_blocks(n), ("section", "part", "at")
    b = F.struct("kind", "text", F.col("level").cast("int").alias("level"), F.col("rows").cast(f"array<array<{blocks.CELL}>>").alias("rows"))
    out = made["blocks"].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, b.alias("b"))))["b"].alias("blocks"), *(F.count_distinct(c).alias(k) for k, c in count.items()))
    for name, fields, kind in (("notes", ("num", "text"), NOTES), ("images", ("label", "member"), PICTURES)):
        into = {"notes": "footnotes"}.get(name, name)
        if name in made:
            # a picture's number counts, not the letters of its label
            key = F.col("num") if name == "notes" else F.regexp_extract("label", r"(\d+)$", 1).cast("int")
            listed = made[name].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), F.struct(*fields).alias("x"))))["x"].cast(kind).alias(into))
            out = out.join(listed, "doc_id", "left")
    told = n.where("part IN ('#members', '#error')").groupBy("doc_id").agg(F.max(F.when(F.col("part") == "#error", F.col("text"))).alias("broken"), F.max(office.attr("name") == NOT_A.get(handler, ("", ""))[0]).alias("whole"))
    error = F.when(F.col("broken") == "", BROKEN.format(handler)).when(F.col("broken").isNotNull(), F.col("broken"))
    if handler in NOT_A:
        slides = n.where(F.col("part").rlike("/slides/slide")).select("doc_id").distinct() if handler == "pptx" else n.limit(0).select("doc_id")
        told = told.join(slides.withColumn("some", F.lit(True)), "doc_id", "left")
        error = error.when(~F.col("whole") & F.col("some").isNull(), NOT_A[handler][1])
    out = told.select("doc_id", error.alias("error")).join(out, "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{blocks.BLOCK}>")))
    more = {c: F.col(c) for c in ("footnotes", "images", *count) if c in out.columns}
    return _whole(out, error=F.col("error"), **more)


def parse(found: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, blocks, notes, pictures, encoding, counts and error of files (doc_id, name, ext, handler, error, content).

    The content of a file is read once: texts are decoded and containers become rows of nodes, stored in the
    shared folder in a part for each handler.  Only formats that are there are then put together, from
    what is stored, and so is the result: what is done with it later doesn't parse again.
    """
    fine = found.where("error IS NULL")
    present = {r["handler"] for r in fine.select("handler").distinct().collect()}  # names of formats
    tables = config.tables or {}
    readers = {h: p for h, p in (config.parsers or {}).items() if h not in tables}
    parsed = [_whole(readers[h](fine.where(F.col("handler") == h))) for h in sorted(present & set(readers))]
    for h in sorted(present & set(tables)):
        read = plugins.documents(fine.where(F.col("handler") == h), tables[h])
        parsed.append(_whole(read, images=F.col("images"), error=F.col("error")))
    special = {*readers, *tables}
    present -= special
    bad = found.where("error IS NOT NULL").select("doc_id", "error")
    if present & set(TEXTS):
        text = fine.where(F.col("handler").isin(*TEXTS) & ~F.col("handler").isin(*special)).withColumn("d", files.decoded(F.col("content")))
        text = stored(text.select("doc_id", "name", "ext", "d.*", "handler"), "texts", "handler")
        parsed += [_plain(text.where("error IS NULL"), h, config) for h in TEXTS if h in present]
        bad = bad.unionByName(text.where("error IS NOT NULL").select("doc_id", "error"))
    if present & set(CONTAINERS):
        boxes = fine.where(F.col("handler").isin(*CONTAINERS) & ~F.col("handler").isin(*special))
        nodes = markup.nodes(F.col("content"), F.col("handler"), office.PARTS)
        n = stored(boxes.select("doc_id", "handler", F.explode(nodes).alias("n")).select("doc_id", "n.*", "handler"), "nodes", "handler")
        parsed += [_office(n.where(F.col("handler") == h).drop("handler"), h, config) for h in CONTAINERS if h in present]
    if config.page_texts and "pdf" in present:
        parsed.append(_pdf(fine.where("handler = 'pdf'"), config))
    out = _whole(bad.withColumn("blocks", F.array().cast(f"array<{blocks.BLOCK}>")), error=F.col("error"))
    for p in parsed:
        out = out.unionByName(p)
    out = out.withColumn("blocks", blocks.tidied(F.col("blocks")))
    out = found.select("doc_id", "handler").join(out, "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{blocks.BLOCK}>")))
    out = out.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in (("footnotes", NOTES), ("images", PICTURES))})
    empty = F.coalesce(F.create_map(*(F.lit(x) for kv in EMPTY.items() for x in kv))[F.col("handler")], F.lit(NOTHING))
    return stored(out.withColumn("error", F.coalesce("error", F.when(F.size("blocks") == 0, empty))).select(*COLUMNS), "parsed")


def convert(spark: SparkSession, folder: str, config: Config = Config(), converted_at: str | None = None) -> DataFrame:
    """doc_id, source, format, out_name, text (Markdown with its head), error, images and counts of every known file in a folder."""
    found = files.read_files(ship(spark), folder)
    return rendered(parse(found, config), found.select("doc_id", "name", "ext"), config, converted_at)


def rendered(parsed: DataFrame, names: DataFrame, config: Config = Config(), converted_at: str | None = None) -> DataFrame:
    """Markdown of parsed documents; names has doc_id, name and ext."""
    docs = parsed.join(names, "doc_id")
    now = F.lit(converted_at) if converted_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    stem = safe_filename(F.regexp_replace("name", r"\.[^.]*$", ""))
    taken = inbox.suffixed(names.select("doc_id", stem.alias("stem")), "stem", "doc_id").select("doc_id", "out_name")
    docs = docs.join(taken, "doc_id")
    assets = F.when((F.size("images") > 0) & F.lit(config.extract_images), F.concat(F.lit("assets/"), "out_name")).otherwise(".")
    raw = F.filter("blocks", lambda b: b["kind"] == "raw")["text"]
    passed = blocks.markdown_stats(F.array_join(raw, "\n"))
    own = blocks.counts(F.col("blocks")) | {"images": F.size("images"), "footnotes": F.size("footnotes")}
    is_md = F.col("ext").isin(".md", ".markdown")
    stats = {c: F.when(is_md, passed[c]).otherwise(x) if c in passed else x for c, x in own.items()} | {c: F.col(c) for c in ("pages", "slides", "sheets", "rows")}
    docs = docs.withColumn("body", blocks.body(F.col("blocks"), F.col("footnotes"), assets))
    text = F.when(F.col("error").isNull(), F.concat(blocks.frontmatter(F.col("name"), F.col("body"), now, stats, F.col("encoding")), F.lit("\n"), F.col("body")))
    return docs.select("doc_id", F.col("name").alias("source"), F.col("ext").alias("format"), F.concat("out_name", F.lit(".md")).alias("out_name"), text.alias("text"), "error", "images", blocks.log_summary(stats).alias("summary"))


def pictures(found: DataFrame, converted: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, label, member, path (in the folder of results) and content of the pictures that converted texts point to.

    found has doc_id and content, and name and handler where table functions of ``config`` give pictures.
    """
    wanted = converted.where("error IS NULL").select("doc_id", F.regexp_replace("out_name", r"\.md$", "").alias("stem"), F.explode("images").alias("i")).select("doc_id", "stem", "i.*")
    tables, found = config.tables or {}, found.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    boxes = found.where(~F.col("handler").isin(*tables)) if tables else found
    held = boxes.select("doc_id", F.explode(markup.members(F.col("content"), r"(?i)^(word|ppt)/|^BinData/")).alias("m")).select("doc_id", "m.*")
    for handler, read in tables.items():
        held = held.unionByName(plugins.pictures(found.where(F.col("handler") == handler), read).select(held.columns))
    ending = F.when(F.lower("member").startswith("bindata/"), office.member_extension(F.col("member"))).otherwise(F.lower(office.member_extension(F.col("member"))))
    return wanted.join(held, ["doc_id", "member"]).select("doc_id", "label", "member", F.concat(F.lit("assets/"), "stem", F.lit("/"), "label", ending).alias("path"), "content")


def redact(docs: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """findings, masked, report and mapping of documents (doc_id, text); names ending in .masked.md are left out."""
    if "source" in docs.columns:
        docs = docs.where(~F.coalesce(F.col("source").endswith(".masked.md"), F.lit(False)))
    found = stored(redaction.detect(docs, config.user_names, config.user_stopwords, config.redact_include_review), "findings")
    return {"findings": found, "masked": redaction.apply(docs, found), "report": redaction.report(docs, found, config.redact_include_review), "mapping": redaction.mapping(found)}


def catalog(spark: SparkSession) -> DataFrame:
    return formats.catalog(spark)


def validate(names: DataFrame, name: str = "name") -> DataFrame:
    """Names with the reason for which an upload is refused, null if it isn't."""
    return formats.with_format(names.withColumn("safe_name", safe_filename(squash(name))), name)


def converted_files(parsed: DataFrame, names: DataFrame, config: Config = Config(), converted_at: str | None = None) -> DataFrame:
    """Rows for the committing sink: each document's source with its Markdown file, or with what went wrong and none.

    names has doc_id, name, ext, path, inner and content; output names don't collide with each other in these rows.
    """
    made = stored(rendered(parsed, names.select("doc_id", "name", "ext"), config, converted_at), "rendered")
    text = F.when(F.col("text").isNotNull(), F.array(F.struct(F.col("out_name").alias("name"), F.col("text").cast("binary").alias("content"))))
    rows = made.select("doc_id", F.regexp_replace("format", r"^\.", "").alias("format"), "error", text.alias("files"))
    if config.extract_images:
        found = pictures(names.select("doc_id", "name", "handler", "content") if config.tables else names.select("doc_id", "content"), made, config)
        listed = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("path").alias("name"), "content")).alias("more"))
        rows = rows.join(listed, "doc_id", "left").withColumn("files", F.when(F.col("more").isNull(), F.col("files")).otherwise(F.concat("files", "more"))).drop("more")
    return rows.join(names.select("doc_id", F.col("path").alias("source"), "inner"), "doc_id")


def committed(spark: SparkSession, batch: DataFrame, number: int, folders: dict[str, str], config: Config) -> None:
    """One batch of settled files (path, name) to Markdown files; a batch that is made again writes nothing twice.

    The name of an output that an earlier batch has taken gets the number of this batch.
    """
    rows = stored(batch.select("path", "name", "inner"), "settled")
    if rows.isEmpty():
        return
    held = formats.with_format(files.with_content(rows.withColumn("doc_id", F.sha2("path", 256)))).where("handler IS NOT NULL")
    held = stored(held.withColumn("error", F.coalesce("error", "lost")).drop("lost"), "contents")
    parsed = parse(held, config)
    out = converted_files(parsed, held, config)
    taken = commit.history(spark, folders["ledger"]).where(F.col("batch") != number).select(F.explode("names").alias("name")).where("name NOT LIKE 'assets/%'").distinct()
    first = F.get("files", F.lit(0))["name"]
    out = out.withColumn("first", first).join(taken.withColumn("known", F.lit(True)), F.col("first") == F.col("name"), "left")
    other = F.regexp_replace("first", r"\.md$", f"_b{number}.md")
    renamed = F.transform("files", lambda f: F.struct(F.when(f["name"] == F.col("first"), other).otherwise(f["name"]).alias("name"), f["content"].alias("content")))
    out = out.withColumn("files", F.when(F.col("known") & F.col("files").isNotNull(), renamed).otherwise(F.col("files")))
    commit.write(out, folders["out"], folders["ledger"], number, **{k: folders.get(k) for k in ("done", "failed", "blocked")})


def settled_files(spark: SparkSession, folder: str, stable: float = inbox.STABLE_SECONDS, every: float = 0.0, blocked: str | None = None, forget: float = inbox.FORGET_SECONDS) -> DataFrame:
    """The stream of files of a folder that have stopped growing: path, name, size, modified, since, ready and inner, the path in the folder."""
    source.register(ship(spark))
    reader = spark.readStream.format("paperweir_inbox").option("path", folder).option("everySeconds", str(every))
    polls = (reader.option("blocked", blocked) if blocked else reader).load()
    known = formats.with_format(polls).where("handler IS NOT NULL").select(polls.columns)
    root = folder.rstrip("/") + "/"
    return inbox.settled_stream(known, stable, forget).withColumn("inner", F.when(F.col("path").startswith(root), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.col("name")))


def stream(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None] | dict[str, str], checkpoint: str, config: Config = Config(), stable: float = inbox.STABLE_SECONDS):
    """Watches a folder: files that have stopped growing are converted, and their state is kept by Spark in ``checkpoint``.

    ``sink`` gets (doc_id, blocks, ..) and the number of the batch, or it is folders for ready files: out, ledger and, to move the sources
    to, done and failed, with blocked for those that can't be moved.  A batch that fails is made again when the stream is started again.
    """
    blocked = sink.get("blocked") if isinstance(sink, dict) else None

    def each(batch: DataFrame, number: int) -> None:
        if isinstance(sink, dict):
            committed(spark, batch, number, sink, config)
            return
        rows = stored(batch.select("path", "name").withColumn("doc_id", F.sha2("path", 256)), "settled")
        if not rows.isEmpty():
            held = formats.with_format(files.with_content(rows)).where("handler IS NOT NULL")
            sink(parse(held.withColumn("error", F.coalesce("error", "lost")).drop("lost"), config), number)

    if isinstance(sink, dict):
        commit.register(ship(spark))  # before the stream takes its copy of the session
        commit.finish(sink["ledger"])
    writer = settled_files(spark, folder, stable, blocked=blocked).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{inbox.POLL_SECONDS} seconds").start()
