"""Queries over office containers that are made from table rows: what the readers give against what went in."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ..operators import blocks
from ..sources import formats
from . import engine
from .queries import dealt, query, table

_NS = 'xmlns:w="http://w" xmlns:p="http://p" xmlns:a="http://a" xmlns:r="http://x/relationships"'


def _word(k: int, name: str, word: str) -> dict[str, str]:
    run = lambda t, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{t}</w:t></w:r>"
    p = lambda inner, props="": f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"
    cell = lambda t: f"<w:tc>{p(run(t))}</w:tc>"
    body = (
        p(run(name), '<w:pStyle w:val="h"/>') + p(run(word, "<w:b/>") + run(f" is {k}") + '<w:r><w:footnoteReference w:id="4"/></w:r>') + p(run(f"item {k}"), '<w:numPr><w:ilvl w:val="1"/></w:numPr>')
        + f"<w:tbl><w:tr>{cell(name)}{cell(str(k))}</w:tr><w:tr>{cell(word)}<w:tc>{p(run('x'))}<w:tbl><w:tr>{cell('y')}{cell(str(k))}</w:tr></w:tbl></w:tc></w:tr></w:tbl>"
        + p('<w:r><w:drawing><a:blip r:embed="i"/></w:drawing></w:r>')
    )
    return {
        "word/document.xml": f"<w:document {_NS}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {_NS}><w:style w:styleId="h"><w:name w:val="heading 3"/></w:style></w:styles>',
        "word/footnotes.xml": f'<w:footnotes {_NS}><w:footnote w:id="4"><w:p><w:r><w:t>note {k}</w:t></w:r></w:p></w:footnote></w:footnotes>',
        "word/_rels/document.xml.rels": '<R><Relationship Id="i" Target="media/a.png"/></R>',
    }


def _sheet(k: int, name: str, word: str) -> dict[str, str]:
    return {
        "xl/workbook.xml": f'<workbook {_NS}><sheets><sheet name="S{k}" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst><si><t>no</t></si><si><t>{word}</t></si></sst>",
        "xl/styles.xml": '<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></s>',
        "xl/worksheets/sheet1.xml": f'<w><row><c r="A1" t="inlineStr"><is><t>{name}</t></is></c><c r="B1"><v>{k}.5</v></c></row><row><c r="B4" s="1"><v>{44927 + k % 1000}</v></c><c r="A4" t="s"><v>1</v></c></row></w>',
        "xl/worksheets/sheet2.xml": '<w><row><c r="A1"><v>9</v></c></row></w>',
    }


def _slides(k: int, name: str, word: str) -> dict[str, str]:
    para = lambda t, b="": f"<a:p><a:r>{b}<a:t>{t}</a:t></a:r></a:p>"
    sp = lambda inner, ph="": f"<p:sp>{ph}<p:txBody>{inner}</p:txBody></p:sp>"
    cell = lambda t: f"<a:tc><a:txBody>{para(t)}</a:txBody></a:tc>"
    grid = f"<p:graphicFrame><a:tbl><a:tr>{cell(name)}{cell(word)}</a:tr><a:tr>{cell(str(k))}{cell('z')}</a:tr></a:tbl></p:graphicFrame>"
    bold = '<a:rPr b="1"/>'
    tree = sp(para(name), '<p:ph type="title"/>') + sp(para(f"{word} {k}", bold)) + grid
    return {
        "ppt/presentation.xml": f'<p:x {_NS}><p:sldIdLst><p:sldId id="9" r:id="r1"/></p:sldIdLst></p:x>',
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Target="slides/slide7.xml"/></R>',
        "ppt/slides/slide7.xml": f"<p:s {_NS}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:s>",
        "ppt/slides/_rels/slide7.xml.rels": '<R><Relationship Id="n" Target="../notesSlides/n1.xml"/></R>',
        "ppt/notesSlides/n1.xml": f"<p:n {_NS}><p:txBody>{para(f'note {k}')}{para(str(k))}</p:txBody></p:n>",
    }


def _hangul(k: int, name: str, word: str) -> dict[str, str]:
    cell = lambda t: f"<tc><subList><p><run><t>{t}</t></run></p></subList></tc>"
    return {
        "Contents/header.xml": '<h><charPr id="1"><bold/></charPr><paraPr id="5"><heading type="OUTLINE" level="1"/></paraPr><style id="0" name="mine"/></h>',
        "Contents/section0.xml": f'<sec><p styleIDRef="0" paraPrIDRef="5"><run><t>{name}</t></run></p>'
        f'<p><run charPrIDRef="1"><t>{word}</t></run><run><t> is {k}</t><footNote><p><run><t>note {k}</t></run></p></footNote><equation><script>{{a}} over {{{k}}}</script></equation></run></p>'
        f"<p><run><tbl><tr>{cell(name)}{cell(k)}</tr><tr>{cell(word)}{cell('w')}</tr></tbl></run></p></sec>",
    }


@pandas_udf(BinaryType())
def _packed(keys: pd.Series, names: pd.Series, words: pd.Series) -> pd.Series:
    def one(k, name, word):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for part, text in (_word, _sheet, _slides, _hangul)[k % 4](k, name, word).items():
                z.writestr(part, text)
        return out.getvalue()

    return pd.Series([one(*x) for x in zip(keys, names, words, strict=True)])


def _table(*cells: str) -> str:
    a, b, c, d = cells
    return f"'| ' || {a} || ' | ' || {b} || ' |' || n || '| --- | --- |' || n || '| ' || {c} || ' | ' || {d} || ' |'"


#: What the container of a customer reads as.
_READS = f"""CASE k % 4
  WHEN 0 THEN '### ' || name || n || n || '**' || word || '** is ' || s || '[^1]' || n || n || '  - item ' || s || n || n || {_table('name', 's', 'word', "'x y / ' || s")} || n || n || '![img1](./img1.png)' || n || n || '---' || n || n || '[^1]: note ' || s || n
  WHEN 1 THEN '## S' || s || n || n || {_table('name', "s || '.5'", 'word', "strftime(DATE '2023-01-01' + CAST(k % 1000 AS INTEGER), '%Y-%m-%d')")} || n
  WHEN 2 THEN '## 1. ' || name || n || n || '- **' || word || ' ' || s || '**' || n || n || {_table('name', 'word', 's', "'z'")} || n || n || '> **발표자 노트** — note ' || s || n
  ELSE '## ' || name || n || n || '**' || word || '** is ' || s || '[^1] $\\frac{{a}}{{' || s || '}}$' || n || n || {_table('name', 's', 'word', "'w'")} || n || n || '---' || n || n || '[^1]: note ' || s || n
END"""
_CUSTOMERS = "WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, c_name AS name, c_mktsegment AS word, chr(10) AS n FROM customer)"


def _files(spark, sf_dir):
    k: Column = F.col("c_custkey")
    ending = F.element_at(F.array(*(F.lit(x) for x in (".docx", ".xlsx", ".pptx", ".hwpx"))), (k % 4 + 1).cast("int"))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 2_000)
    return rows.select(k.alias("doc_id"), F.concat("c_name", ending).alias("name"), _packed(k, F.col("c_name"), F.col("c_mktsegment")).alias("content"))


@query(f"{_CUSTOMERS} SELECT k AS doc_id, {_READS} AS body FROM c")
def office_documents(spark, sf_dir):
    """A container for each customer, read back as Markdown."""
    parsed = engine.parse(formats.with_format(_files(spark, sf_dir)))
    return parsed.select("doc_id", blocks.body(F.col("blocks"), F.col("footnotes")).alias("body"))


@pandas_udf(BinaryType())
def _encrypted(content: pd.Series) -> pd.Series:
    """The containers with every member marked as encrypted, in both of its headers."""

    def one(data):
        out = bytearray(data)
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            place = out.find(mark)
            while place >= 0:
                out[place + at] |= 1
                place = out.find(mark, place + 1)
        return bytes(out)

    return pd.Series([one(x) for x in content])


@query(f"""{_CUSTOMERS}
SELECT k AS doc_id, CASE k // 4 % 3 WHEN 0 THEN '파일이 손상되었거나 .' || ['docx', 'xlsx', 'pptx', 'hwpx'][k % 4 + 1] || ' 형식이 아닙니다.'
  WHEN 1 THEN 'File ''' || ['word/_rels/document.xml.rels', 'xl/_rels/workbook.xml.rels', 'ppt/_rels/presentation.xml.rels', 'Contents/header.xml'][k % 4 + 1] || ''' is encrypted, password required for extraction' END AS error,
  CASE WHEN k // 4 % 3 = 2 THEN {_READS} ELSE chr(10) END AS body FROM c""")
def damaged_files(spark, sf_dir):
    """Of the containers a third is cut off, a third encrypted; these give errors, and the others are read."""
    damage = F.floor(F.col("doc_id") / 4) % 3
    cut = F.expr("substring(content, 1, CAST(length(content) / 2 AS INT))")
    files = _files(spark, sf_dir).withColumn("content", F.when(damage == 0, cut).when(damage == 1, _encrypted("content")).otherwise(F.col("content")))
    parsed = engine.parse(formats.with_format(files))
    return parsed.select("doc_id", "error", blocks.body(F.col("blocks"), F.col("footnotes")).alias("body"))
