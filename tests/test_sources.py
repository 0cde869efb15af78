"""Containers built in memory, plain formats, pages and the inbox."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.operators import blocks, pages
from paperweir.sources import files, formats, markup, office
from paperweir.streaming import inbox

W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a" xmlns:p="http://p"'


def container(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


def doc(spark, content, handler):
    return office.node_table(spark.createDataFrame([("d", content)], "doc_id string, content binary"), handler)


def shown(rows):
    cell = lambda c: c["text"] if (c["col_span"], c["row_span"]) == (1, 1) else tuple(c)
    return [(r["kind"], r["level"], r["text"]) if r["kind"] != "table" else [[cell(c) for c in x] for x in r["rows"]] for r in rows]


def word(spark, body, **parts):
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **{f"word/{k}": v for k, v in parts.items()}}
    made = office.word_blocks(doc(spark, container(parts), "docx"))
    return shown(made["blocks"].orderBy("at").collect()), [tuple(r) for r in made["notes"].select("num", "text").orderBy("num").collect()], [tuple(r) for r in made["images"].select("label", "member").orderBy("label").collect()]


def p(inner, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"


def r(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


STYLES = f"""<w:styles {W}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2 Char"/></w:style>
<w:style w:styleId="O"><w:name w:val="own"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style><w:style w:styleId="N"><w:name w:val="x"/><w:pPr><w:numPr/></w:pPr></w:style></w:styles>"""


def test_word_paragraphs(spark):
    body = (
        p(r("Head"), '<w:pStyle w:val="T"/>') + p(r("Sub", "<w:b/>"), '<w:pStyle w:val="H2"/>') + p(r("low"), '<w:outlineLvl w:val="9"/>') + p(r("third"), '<w:pStyle w:val="O"/>')
        + p(r(" a ") + r("bold ", "<w:b/>") + r("c", '<w:b w:val="0"/>') + "<w:del><w:r><w:t>x</w:t></w:r></w:del><w:ins>" + r("  new") + "</w:ins>")
        + p(r("item"), '<w:numPr><w:ilvl w:val="7"/></w:numPr>') + p(r("by style"), '<w:pStyle w:val="L"/>') + p(r("by number"), '<w:pStyle w:val="N"/>') + p("")
        + "<w:sdt><w:sdtContent>" + p(r("held") + "<w:hyperlink>" + r("link") + "</w:hyperlink><w:r><w:tab/><w:t>t</w:t><w:br/><w:t>u</w:t><w:noBreakHyphen/></w:r>") + "</w:sdtContent></w:sdt>"
    )
    got, _, _ = word(spark, body, **{"styles.xml": STYLES})
    assert got == [
        ("heading", 1, "Head"), ("heading", 2, "Sub"), ("heading", 6, "low"), ("heading", 3, "third"), ("para", 0, "a **bold** c new"), ("para", 0, "          - item"), ("para", 0, "- by style"),
        ("para", 0, "- by number"), ("blank", 0, ""), ("para", 0, "heldlink t\nu-"),
    ]


def test_word_tables(spark):
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{t}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p(r('x')))}{cell(p(r('')))}{cell(p(r('y')) + p(r('z')))}</w:tr><w:tr>{cell(p(r('w')))}</w:tr></w:tbl>"
    restart, goes_on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    body = f"""<w:tbl><w:tr>{cell(p(r('A')), '<w:gridSpan w:val="2"/>')}{cell(p(r('B')), restart)}</w:tr><w:tr>{cell(p(r('C')) + inner + p(r('D')))}{cell(p(r('E')))}{cell(p(r('lost')), goes_on)}</w:tr>
<w:tr>{cell(p(r('F')))}{cell(p(r('G')), goes_on)}{cell('', goes_on)}</w:tr></w:tbl>"""
    got, _, _ = word(spark, body)
    assert got == [[[("A", 2, 1), ("B", 1, 3)], ["C\nx / y\nz\nw\nD", "E"], ["F", "G"]]]


def test_word_notes_and_pictures(spark):
    ref = lambda kind, i: f'<w:r><w:{kind}Reference w:id="{i}"/></w:r>'
    picture = '<w:r><w:drawing><a:blip r:embed="{}"/></w:drawing></w:r>'
    body = p(r("one") + ref("endnote", 2) + ref("footnote", 7) + picture.format("i1")) + p(r("two") + ref("footnote", 7) + ref("footnote", 9) + picture.format("gone") + '<w:r><w:pict><w:imagedata r:id="i2"/></w:pict></w:r>')
    parts = {
        "footnotes.xml": f'<w:f {W}><w:footnote w:id="0" w:type="separator"><w:p><w:r><w:t>s</w:t></w:r></w:p></w:footnote><w:footnote w:id="7"><w:p><w:r><w:t>said  so</w:t></w:r><w:r><w:t>twice</w:t></w:r></w:p></w:footnote></w:f>',
        "endnotes.xml": f'<w:f {W}><w:endnote w:id="2"><w:p><w:r><w:t>end</w:t></w:r></w:p></w:endnote></w:f>',
        "_rels/document.xml.rels": '<R><Relationship Id="i1" Target="media/a.PNG"/><Relationship Id="i2" Target="../word/./media/b"/><Relationship Id="gone" Target="http://x/y.png" TargetMode="External"/></R>',
    }
    got, notes, images = word(spark, body, **parts)
    assert got == [("para", 0, "one[^1][^2]\n![img1]({ASSETS}/img1.png)"), ("para", 0, "two[^2]\n![img2]({ASSETS}/img2.bin)")]
    assert notes == [(1, "end"), (2, "said so twice")] and images == [("img1", "word/media/a.PNG"), ("img2", "word/media/b")]
    assert office.word_blocks(doc(spark, bytearray(b"no zip"), "docx"))["blocks"].count() == 0


def test_workbook(spark):
    content = container({
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="No" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si><si><t>x</t></si></sst>",
        "xl/styles.xml": '<s><numFmts><numFmt numFmtId="165" formatCode="yyyy&quot;x&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></s>',
        "xl/worksheets/sheet1.xml": '<w><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c><c r="A2" s="1"><v>44927</v></c><c r="B2" s="2"><v>44927.5</v></c><c r="C2"><v>3.0</v></c><c r="D2"/>'
        '<c r="A4" t="b"><v>1</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" t="str"><v>00123</v></c><c r="D5"><v></v></c></w>',
        "xl/worksheets/sheet2.xml": '<w><c r="A1"><v>9</v></c></w>',
    })
    tables = office.sheet_tables(office.sheet_cells(doc(spark, content, "xlsx"))).collect()
    assert len(tables) == 1 and tables[0]["sheet"] == "One" and not tables[0]["truncated"]
    assert [[c["text"] for c in row] for row in tables[0]["rows"]] == [["name", "", "in"], ["2023-01-01", "2023-01-01 12:00", "3"], ["TRUE", "#N/A", "123"]]


def test_slides(spark):
    para = lambda t, lvl=0: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    sp = lambda inner, ph="": f'<p:sp><p:nvPr>{ph and f"<p:ph type={chr(34)}{ph}{chr(34)}/>"}</p:nvPr><p:txBody>{inner}</p:txBody></p:sp>'
    tree = lambda *shapes: f"<p:s {REL}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:s>"
    tc = lambda t, more="": f"<a:tc {more}><a:txBody>{para(t)}</a:txBody></a:tc>"
    table = f"""<p:graphicFrame><a:tbl><a:tr>{tc('a', 'rowSpan="2"')}{tc('b', 'gridSpan="2"')}{tc('no', 'hMerge="1"')}</a:tr><a:tr>{tc('no', 'vMerge="1"')}{tc('c')}{tc('d')}</a:tr></a:tbl></p:graphicFrame>"""
    picture = '<p:pic><p:cNvPr descr="{}"/><a:blip r:embed="{}"/></p:pic>'
    content = container({
        "ppt/presentation.xml": f'<p:x {REL}><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:x>',
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="rId1" Target="slides/slide1.xml"/><Relationship Id="rId2" Target="slides/slide2.xml"/></R>',
        "ppt/slides/slide1.xml": tree(sp(para("plain", 1)), table, "<p:grpSp>" + sp('<a:p><a:r><a:t>x </a:t></a:r><a:r><a:rPr b="1"/><a:t> strong </a:t></a:r><a:br/><a:fld><a:t>9</a:t></a:fld></a:p>') + "</p:grpSp>", picture.format("", "p")),
        "ppt/slides/_rels/slide1.xml.rels": '<R><Relationship Id="p" Target="../media/x.JPG"/></R>',
        "ppt/slides/slide2.xml": tree(sp(para("body")), sp(para("Top"), "title"), sp(para("second"), "ctrTitle"), picture.format("a  view", "q")),
        "ppt/slides/_rels/slide2.xml.rels": '<R><Relationship Id="n" Target="../notesSlides/notesSlide1.xml"/><Relationship Id="q" Target="../media/y.png"/></R>',
        "ppt/notesSlides/notesSlide1.xml": f"<p:n {REL}><p:txBody>{para('say this')}{para('12')}{para('and that')}</p:txBody></p:n>",
    })
    made = office.slide_blocks(doc(spark, content, "pptx"))
    got = shown(made["blocks"].where("kind <> 'blank'").orderBy("slide_no", "at").collect())
    assert got == [
        ("heading", 2, "1. Top"), ("para", 0, "- body"), ("para", 0, "- second"), ("para", 0, "![a view]({ASSETS}/img1.png)"), ("para", 0, "> **발표자 노트** — say this and that"),
        ("heading", 2, "슬라이드 2"), ("para", 0, "  - plain"), [[("a", 1, 3), ("b", 2, 1)], ["c", "d"]], ("para", 0, "- x **strong** 9"), ("para", 0, "![img2]({ASSETS}/img2.jpg)"),
    ]
    assert [tuple(x) for x in made["images"].select("label", "member").orderBy("label").collect()] == [("img1", "ppt/media/y.png"), ("img2", "ppt/media/x.JPG")]


REL = 'xmlns:p="http://p" xmlns:a="http://a" xmlns:r="http://x/relationships"'


def test_hangul_document(spark):
    cell = lambda t, span="": f"<tc><subList><p><run><t>{t}</t></run></p></subList>{span}</tc>"
    content = container({
        "BinData/image1.png": "x",
        "BinData/IMAGE2.BMP": "y",
        "Contents/header.xml": '<h><charPr id="0"/><charPr id="1"><bold/></charPr><paraPr id="0"/><paraPr id="5"><heading type="OUTLINE" level="1"/></paraPr>'
        '<style id="0" name="바탕글"/><style id="1" name="개요 3"/><style id="2" name="my own"/></h>',
        "Contents/section0.xml": '<sec><p styleIDRef="1"><run charPrIDRef="1"><t>Head</t></run></p><p styleIDRef="0" paraPrIDRef="5"><run charPrIDRef="0"><t>one<tab/>t<x>in</x>tail</t></run>'
        '<run charPrIDRef="1"><t> bold</t><lineBreak/></run><run><ctrl><header><t>no</t></header></ctrl><ctrl><other><t>ctl</t></other></ctrl></run></p>'
        '<p styleIDRef="2" paraPrIDRef="5"><run><t>outline</t></run></p>'
        f'<p><run><t>before</t><tbl><tr>{cell("cell  one")}{cell("wide", "<cellSpan colSpan=" + chr(34) + "2" + chr(34) + " rowSpan=" + chr(34) + "1" + chr(34) + "/>")}</tr><tr/></tbl></run></p><p><run/></p>'
        '<p><run><t>x</t><footNote><subList><p><run><t>foot</t></run><run><t>text</t></run></p></subList></footNote><equation><script>{a} over  {b}</script></equation></run></p>'
        '<p><run><pic><img binaryItemIDRef="image2"/></pic><container><img binaryItemIDRef="none"/></container><pic/></run></p></sec>',
        "Contents/section10.xml": '<sec><p><run><t>last</t><pic><img binaryItemIDRef="image1"/></pic></run></p></sec>',
        "Contents/section2.xml": '<sec><p><run><t>middle</t></run></p></sec>',
    })
    made = office.hwpx_blocks(doc(spark, content, "hwpx"))
    got = shown(made["blocks"].orderBy("section", "at").collect())
    assert got == [
        ("heading", 3, "Head"), ("para", 0, "one tintail **bold**\nctl"), ("heading", 2, "outline"), ("para", 0, "before"), [["cell one", ("wide", 2, 1)]], ("blank", 0, ""),
        ("para", 0, "x[^1] $\\frac{a}{b}$"), ("para", 0, "![img1]({ASSETS}/img1.BMP)\n\n![img2]({ASSETS}/img2.BMP)"), ("para", 0, "middle"), ("para", 0, "last\n![img3]({ASSETS}/img3.png)"),
    ]
    assert [tuple(x) for x in made["notes"].select("num", "text").collect()] == [(1, "foot text")]
    assert [tuple(x) for x in made["images"].select("label", "member").orderBy("label").collect()] == [("img1", "BinData/IMAGE2.BMP"), ("img2", "BinData/IMAGE2.BMP"), ("img3", "BinData/image1.png")]


def test_encodings(spark):
    rows = spark.createDataFrame([(1, bytearray("홍길동".encode("cp949"))), (2, bytearray("가".encode())), (3, bytearray(b" \n")), (4, None)], "i int, content binary")
    got = {r["i"]: r["d"] for r in rows.select("i", files.decoded(F.col("content")).alias("d")).collect()}
    assert (got[1]["text"], got[1]["encoding"]) == ("홍길동", "cp949")
    assert got[2]["encoding"] == "utf-8-sig" and got[3]["error"] == got[4]["error"] == files.EMPTY


def html(spark, page):
    rows = markup.html_blocks(spark.createDataFrame([(1, page)], "doc_id int, text string")).orderBy("at").collect()
    cell = lambda c: c["text"] if (c["col_span"], c["row_span"]) == (1, 1) else tuple(c)
    return [(r["kind"], r["level"], r["text"]) if r["kind"] != "table" else [[cell(c) for c in x] for x in r["rows"]] for r in rows]


@pytest.mark.parametrize(("page", "want"), [
    (None, []),
    ("<head><title>z</title></head><h1>T <b>x</b></h1><p>a <b>b</b> c</p>", [("heading", 1, "T x"), ("para", 0, "a **b** c")]),
    ("<ul><li>p<ul><li>q</li></ul></li></ul>", [("para", 0, "p"), ("para", 0, "  - q")]),  # a list inside ends the text of its item
    ("<ol><li>a</li><li>b</ol>", [("para", 0, "- a"), ("para", 0, "b")]),
    ("<nav>x</nav>y<main>z</main>", [("para", 0, "xyz")]),
    ("a</b>b<b>c", [("para", 0, "ab**c")]),
    ("x<img src=u alt=''>y<img src=v>z<img alt=no>", [("para", 0, "x ![](u) y ![그림](v) z")]),
    ("<script>if (a<b) x</script>a<style>p{}</style> b<template><p>t</p></template>", [("para", 0, "a b")]),
    ("<table><tr><td colspan=2>m</td><td rowspan=x>n</td></tr><tr></tr></table>", [[[("m", 2, 1), "n"]]]),
    ("a<table><tr><td><p>p</p><p>q</p>r</td></tr></table>b", [("para", 0, "a"), [["r p q"]], ("para", 0, "b")]),
    ("<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>", [[["y"]]]),  # the inner table takes over
    ("<table><tr><td>never closed", []),
    ("<h2>a<p>b</p></h2>c", [("heading", 2, "a"), ("heading", 2, "b"), ("para", 0, "c")]),
    ("<td>a</td><tr>b</tr>", [("para", 0, "ab")]),
])
def test_html(spark, page, want):
    assert html(spark, page) == want


def test_csv_and_json(spark):
    rows = spark.createDataFrame([(1, "a;b\n1;2\n;\n"), (2, None)], "i int, t string").select("i", markup.csv_rows(F.col("t"))["rows"].alias("r")).orderBy("i").collect()
    assert rows[0]["r"] == [["a", "b"], ["1", "2"]] and rows[1]["r"] == []
    rows = spark.createDataFrame([(1, '{"b":1.50,"a":"가"}'), (2, "{")], "i int, t string").select("i", markup.pretty_json(F.col("t")).alias("r")).orderBy("i").collect()
    assert rows[0]["r"]["text"] == '{\n  "b": 1.5,\n  "a": "가"\n}' and "1행" in rows[1]["r"]["error"]


def test_rendering(spark):
    cell = lambda t, c=1, r=1: (t, c, r)
    rows = spark.createDataFrame([(1, [[cell("a|b"), cell("c")], [cell("1\n2"), cell("3")]]), (2, [[cell("<x>", 2)], [cell("y"), cell("z")]]), (3, [])], f"i int, rows array<array<{blocks.CELL}>>")
    got = {r["i"]: r["t"] for r in rows.select("i", blocks.table(F.col("rows")).alias("t")).collect()}
    assert got[1] == "| a\\|b | c |\n| --- | --- |\n| 1 2 | 3 |"
    assert got[2] == '<table>\n  <tr>\n    <td colspan="2">&lt;x&gt;</td>\n  </tr>\n  <tr>\n    <td>y</td>\n    <td>z</td>\n  </tr>\n</table>'
    assert got[3] == ""


@pytest.mark.parametrize(("serial", "want"), [(44927.0, "2023-01-01"), (44927.5, "2023-01-01 12:00"), (0.5, "1899-12-30 12:00"), (0.0, None), (3e6, None)])
def test_serial_dates(spark, serial, want):
    assert spark.range(1).select(T.serial_date(F.lit(serial)).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("raw", "want"), [("3.0", "3"), ("1.50", "1.5"), ("abc", "abc"), ("00123", "123"), ("0.1", "0.1"), ("1234.5678", "1234.5678")])
def test_numbers(spark, raw, want):
    assert spark.range(1).select(T.clean_number(F.lit(raw)).alias("x")).first()["x"] == want


def test_pages(spark):
    text = lambda n: f"Internal Report\nbody {n}\n- {n} -"
    got = pages.body_lines(pages.clean_lines(spark.createDataFrame([("d", n, text(n)) for n in range(1, 5)] + [("e", 1, "Internal Report\nx"), ("e", 2, "Internal Report\ny")], "doc_id string, page_no int, text string"))).collect()
    assert sorted(r["line"] for r in got if r["doc_id"] == "d") == [f"body {n}" for n in range(1, 5)]
    assert sorted(r["line"] for r in got if r["doc_id"] == "e") == ["Internal Report", "Internal Report", "y"]  # x is like a number of a page
    lines = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(["제3조 목적", "이 규정은", "적용한다.", "• 항목", "2.1 범위"])], "doc_id string, page_no int, line_no int, line string")
    got = pages.reflowed(lines).orderBy("seq").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in got] == [("heading", 4, "제3조 목적"), ("para", 0, "이 규정은 적용한다."), ("para", 0, "- 항목"), ("heading", 3, "2.1 범위")]


def test_folder(spark, tmp_path):
    for name, body in (("a.txt", b"x"), ("b.DOC", b"y"), ("c.zip", b"z")):
        (tmp_path / name).write_bytes(body)
    got = {r["name"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.DOC"} and got["a.txt"]["error"] is None and ".docx" in got["b.DOC"]["error"]
    assert files.listing(spark, str(tmp_path), 2).count() == 2
    assert formats.accepted(spark).first()["accept"].startswith(".csv,.docx")


POLLS = [("a", 0, 10), ("a", 2, 20), ("a", 4, 20), ("a", 6, 20), ("a", 8, None), ("a", 9, 20), ("a", 10, 20), ("a", 12, 20), ("b", 0, 5)]


def polls():
    return pd.DataFrame([(n, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t), s) for n, t, s in POLLS], columns=["name", "ts", "size"])


def test_settled_batch(spark):
    frame = spark.createDataFrame([(r.name_, r.ts.to_pydatetime(), None if pd.isna(r.size_) else int(r.size_)) for r in polls().rename(columns={"name": "name_", "size": "size_"}).itertuples()], "name string, ts timestamp, size long")
    got = sorted((r["name"], r["size"], r["ready"].second) for r in inbox.settled(frame).collect())
    assert got == [("a", 20, 6), ("a", 20, 12)]


def test_settled_stream(spark, tmp_path):
    schema = "name string, ts timestamp, size long"
    source, sink = tmp_path / "in", "settled_rows"
    source.mkdir()
    for i, part in enumerate((POLLS[:3], POLLS[3:6], POLLS[6:])):
        rows = [(n, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t)).to_pydatetime(), s) for n, t, s in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(source))
    query = inbox.settled_stream(stream).writeStream.format("memory").queryName(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["name"], r["size"], r["ready"].second) for r in spark.table(sink).collect()) == [("a", 20, 6), ("a", 20, 12)]


def test_numbers_have_ten_digits(spark):
    raw = ["12345678.5", "1e-5", "0.1", "1.0", "-3.25", "123456789012.5", "0.00012345678901234", "1e20", "abc", "9999999999.5", "99999999995.5", "1e-4", "-0.0", "1E5", "123456.789012345", "nan", None]
    got = {r["x"]: r["y"] for r in spark.createDataFrame([(x,) for x in raw], "x string").select("x", T.clean_number("x").alias("y")).collect()}
    for x in raw[:-2]:
        try:
            n = float(x)
            assert got[x] == (str(int(n)) if n.is_integer() else f"{n:.10g}")
        except ValueError:
            assert got[x] == x
    assert got["nan"] == "nan" and got[None] is None


def test_output_names_are_free(spark):
    rows = [(1, "a"), (2, "a"), (3, "a_1"), (4, "b"), (5, "b"), (6, "c_2"), (7, "a"), (8, "a_1")]
    got = inbox.suffixed(spark.createDataFrame(rows, "arrived int, n string"), "n", "arrived").orderBy("arrived").collect()
    assert [r["out_name"] for r in got] == ["a", "a_1", "a_1_1", "b", "b_1", "c_2", "a_2", "a_1_2"]
    assert inbox.suffixed(spark.createDataFrame([], "arrived int, n string"), "n", "arrived").count() == 0


def test_no_more_rows_than_the_limit_are_put_together(spark):
    rows = [(d, k, [f"{d}{k}", " x "] if k % 3 else ["", " "]) for d in (1, 2, 3) for k in range(5 * d)]
    lines = spark.createDataFrame(rows, "doc_id int, row int, cells array<string>")
    got = {r["doc_id"]: ([[c["text"] for c in x] for x in r["rows"]], r["truncated"]) for r in blocks.grid(lines, ["doc_id"], "cells", 6).collect()}
    want = {d: [[f"{d}{k}", "x"] for k in range(5 * d) if k % 3] for d in (1, 2, 3)}
    assert got == {d: (w[:6], len(w) > 6) for d, w in want.items()} and [len(w) for w in want.values()] == [3, 6, 10]
    cells = spark.createDataFrame([(d, 1, "S", k * 2, c, f"{k}{c}") for d in (1, 2) for k in range(3 + d) for c in range(1 + k % 2)], "doc_id int, sheet_no int, sheet string, row_idx int, col_idx int, text string")
    got = {r["doc_id"]: ([[c["text"] for c in x] for x in r["rows"]], r["truncated"]) for r in office.sheet_tables(cells, 4).collect()}
    whole = [[f"{k}0", f"{k}1" if k % 2 else ""] for k in range(4)]
    assert got == {1: (whole, False), 2: (whole, True)}


def test_content_is_read_by_tasks_and_a_lost_file_says_so(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    rows = spark.createDataFrame([(1, str(tmp_path / "a.txt"), "x"), (2, f"file:{tmp_path}/a.txt", "y"), (3, str(tmp_path / "gone.txt"), "z")], "doc_id int, path string, Content string")
    got = {r["doc_id"]: (r["content"] and bytes(r["content"]), r["lost"]) for r in files.with_content(rows).collect()}
    assert got[1] == got[2] == (b"abc", None) and got[3][0] is None and got[3][1].startswith(files.GONE)
