"""Folders to Markdown and on to redacted copies, in batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from paperweir.plans import engine
from paperweir.sources import files, sinks
from test_sources import container


def fill(folder):
    (folder / "a.txt").write_text("one\n\n성명: 홍길동\n", encoding="utf-8")
    (folder / "b.md").write_text("---\nx: 1\n---\n# H\n\nbody\n", encoding="utf-8")
    (folder / "c.csv").write_text("k,v\n1,2\n", encoding="utf-8")
    (folder / "d.html").write_text("<h1>T</h1><p>p</p><table><tr><td>a</td><td>b</td></tr></table>", encoding="utf-8")
    (folder / "e.json").write_text('{"a": 1}', encoding="utf-8")
    (folder / "f.doc").write_bytes(b"old")
    (folder / "g.txt").write_bytes(b"  \n")
    (folder / "h.pdf").write_bytes(b"Report\x0cReport\nsecond page of some length.")
    (folder / "j.docx").write_bytes(b"no zip")
    (folder / "k.xlsx").write_bytes(bytes(container({"a": "b"})))
    (folder / "l.html").write_text("<script>x</script>", encoding="utf-8")
    (folder / "m.hwpx").write_bytes(bytes(container({"Contents/section0.xml": "<sec><p><run><t>a</t><footNote><p><run><t>n</t></run></p></footNote><pic><img binaryItemIDRef='x'/></pic></run></p></sec>", "BinData/x.png": "PNG"})))
    (folder / "i.docx").write_bytes(bytes(container({"word/document.xml": "<d><body><p><r><t>word text</t></r></p></body></d>"})))


def test_convert(spark, tmp_path):
    fill(tmp_path)
    config = engine.Config(page_texts=lambda data: data.decode().split("\x0c"))
    got = {r["source"]: r for r in engine.convert(spark, str(tmp_path), config, "2024-01-01T00:00:00").collect()}
    assert set(got) == {"a.txt", "b.md", "c.csv", "d.html", "e.json", "f.doc", "g.txt", "h.pdf", "i.docx", "j.docx", "k.xlsx", "l.html", "m.hwpx"}
    head = lambda f, stats, n, enc="encoding: utf-8-sig\n": f'---\nsource: "{f}"\nformat: {f[2:]}\nconverted_at: 2024-01-01T00:00:00\n{stats}{enc}chars: {n}\n---\n\n'
    assert got["a.txt"]["text"] == head("a.txt", "headings: 0\nparagraphs: 2\ntables: 0\nimages: 0\nfootnotes: 0\n", 13) + "one\n\n성명: 홍길동\n"
    assert got["b.md"]["text"].endswith("---\n\n# H\n\nbody\n")
    assert got["c.csv"]["text"].endswith("| k | v |\n| --- | --- |\n| 1 | 2 |\n") and "rows: 2" in got["c.csv"]["text"]
    assert got["d.html"]["text"].endswith("# T\n\np\n\n| a | b |\n| --- | --- |\n")
    assert got["e.json"]["text"].endswith('```json\n{\n  "a": 1\n}\n```\n')
    assert got["f.doc"]["text"] is None and ".docx" in got["f.doc"]["error"] and got["g.txt"]["error"]
    assert "second page of some length." in got["h.pdf"]["text"] and "pages: 2" in got["h.pdf"]["text"]
    assert got["i.docx"]["text"].endswith("word text\n")
    assert got["j.docx"]["error"] == engine.BROKEN.format("docx") and got["k.xlsx"]["error"] == engine.NOT_A["xlsx"][1] and got["l.html"]["error"] == engine.EMPTY["html"]
    assert got["m.hwpx"]["text"].endswith("images: 1\nfootnotes: 1\nchars: 47\n---\n\na[^1]\n![img1](assets/m/img1.png)\n\n---\n\n[^1]: n\n")
    plain = {r["source"]: r["text"] for r in engine.convert(spark, str(tmp_path), engine.Config(extract_images=False)).collect()}
    assert "![img1](./img1.png)" in plain["m.hwpx"]
    made = engine.redact(spark.createDataFrame([(r["doc_id"], r["text"]) for r in got.values() if r["text"]], "doc_id string, text string"))
    assert made["masked"].where(F.col("masked_text").contains("〔자연인-01〕")).count() == 1 and made["mapping"].count() == 1


def test_content_is_read_once(spark, tmp_path, monkeypatch):
    fill(tmp_path)
    reads = []
    for module, name in ((engine.markup, "nodes"), (engine.files, "decoded")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args, real=real, name=name: (reads.append(name), real(*args))[1])
    made = engine.convert(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert sorted(reads) == ["decoded", "nodes"]
    assert "content#" not in plan and "ArrowEvalPython" not in plan and plan.count("Exchange") <= 16, plan.count("Exchange")


def test_results_are_written_and_mapping_apart(spark, tmp_path):
    source, out, secret = tmp_path / "in", tmp_path / "out", tmp_path / "secret"
    source.mkdir()
    fill(source)
    found = engine.files.read_files(spark, str(source))
    made = engine.convert(spark, str(source))
    sinks.write_markdown(made, str(out))
    sinks.write_pictures(engine.pictures(found, made), str(out))
    assert (out / "a.md").read_text(encoding="utf-8").endswith("성명: 홍길동\n") and (out / "assets/m/img1.png").read_text() == "PNG"
    assert not (out / "f.md").exists()
    named = made.where("text IS NOT NULL").select("doc_id", "out_name", "text")
    sinks.write_redacted(named, engine.redact(named.select("doc_id", "text")), str(out), str(out), str(secret))
    assert "〔자연인-01〕" in (out / "a.masked.md").read_text(encoding="utf-8")
    assert "홍길동" not in (out / "a.redact.json").read_text(encoding="utf-8")
    assert json.loads((secret / "a.mapping.json").read_text(encoding="utf-8"))["map"] == {"〔자연인-01〕": "홍길동"}
    with pytest.raises(ValueError):
        sinks.write_redacted(named, {}, str(out), str(out), str(out))


def test_validate_and_images(spark):
    got = {r["name"]: r["error"] for r in engine.validate(spark.createDataFrame([("a.docx",), ("b.xls",), ("c",)], "name string")).collect()}
    assert got["a.docx"] is None and got["b.xls"] and got["c"]


def test_one_bad_file_fails_alone(spark, tmp_path):
    import io
    import zipfile

    good = {"word/document.xml": "<d><body><p><r><t>good</t></r></p></body></d>"}
    whole = bytes(container(good))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", good["word/document.xml"] * 50)
    spoilt = bytearray(out.getvalue())
    spoilt[60:90] = b"\xff" * 30
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b" " * (8 << 20))
    files = {
        "good.docx": whole, "spoilt.docx": bytes(spoilt), "cut.docx": whole[:40], "bomb.docx": bomb.getvalue(), "good.html": b"<p>fine</p>", "odd.html": b"<p>a</p><![foo[ x ]]>", "good.json": b'{"a": [1]}',
        "deep.json": b"[" * 200_000, "long.json": b"1" * 6000, "good.csv": b"a,b\n1,2\n", "wide.csv": b'a,"' + b"x" * 300_000 + b'"\n', "nul.tsv": b"a\tb\r\rc\td\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    most = engine.markup.MOST_UNPACKED
    try:
        engine.markup.nodes.__defaults__ = (4 << 20,)
        got = {r["source"]: r for r in engine.convert(spark, str(tmp_path)).collect()}
    finally:
        engine.markup.nodes.__defaults__ = (most,)
    assert set(got) == set(files)
    for name in ("good.docx", "good.html", "good.json", "good.csv", "wide.csv", "long.json"):
        assert got[name]["error"] is None and got[name]["text"], name
    for name in ("spoilt.docx", "cut.docx", "bomb.docx", "deep.json"):
        assert got[name]["text"] is None and got[name]["error"], name
    assert got["spoilt.docx"]["error"].startswith(engine.markup.UNREADABLE) and "4MB" in got["bomb.docx"]["error"]
    assert got["odd.html"]["error"] or "a" in got["odd.html"]["text"]
    assert "x" * 300_000 in got["wide.csv"]["text"]


def test_table_functions_give_blocks_and_pictures(spark, tmp_path):
    """A reader of a user for one format: from Python, from SQL, and one whose columns depend on its arguments; a bad file fails alone."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import IntegerType, StringType, StructType
    from pyspark.sql.udtf import AnalyzeResult

    from paperweir.plans import plugins

    @plugins.reader
    def leaves(content, name):
        if content == b"bad":
            raise ValueError("no leaves")
        yield {"kind": "heading", "text": name, "level": 2}
        for i, line in enumerate(content.decode().splitlines()):
            yield {"kind": "image", "text": line, "member": f"{i}.PNG", "content": line.encode()} if line.startswith("p") else {"kind": "para", "text": line}
        yield {"kind": "table", "rows": [["a", "b"], ["1", "2"]]}

    for name, content in {"x.pdf": "one\np first\ntwo\np second", "y.pdf": "bad", "z.txt": "plain", "e.pdf": ""}.items():
        (tmp_path / name).write_text(content)
    spark.udtf.register("leaves", leaves)
    made = {}
    for key, table in (("object", leaves), ("name", "leaves")):
        config = engine.Config(tables={"pdf": table})
        found = files.read_files(spark, str(tmp_path))
        out = engine.convert(spark, str(tmp_path), config, converted_at="now")
        made[key] = {r["source"]: (r["text"], r["error"]) for r in out.collect()}
        got = {(r["path"], bytes(r["content"])) for r in engine.pictures(found, out, config).collect()}
        assert got == {("assets/x/img1.png", b"p first"), ("assets/x/img2.png", b"p second")}
    assert made["object"] == made["name"]
    text = made["name"]["x.pdf"][0]
    assert "## x.pdf\n\none\n\n![p first](assets/x/img1.png)\n\ntwo\n\n![p second](assets/x/img2.png)" in text and "| 1 | 2 |" in text
    assert made["name"]["y.pdf"] == (None, "ValueError: no leaves") and made["name"]["z.txt"][1] is None and "## e.pdf" in made["name"]["e.pdf"][0]
    rows = spark.sql("SELECT p.kind, p.text FROM {f} f, LATERAL leaves(f.content, f.name) p WHERE f.name = 'x.pdf' ORDER BY p.at", f=found).collect()
    assert [r["kind"] for r in rows] == ["heading", "para", "image", "para", "image", "table"]

    @udtf
    class Lines:
        @staticmethod
        def analyze(content, name):
            return AnalyzeResult(StructType().add("at", IntegerType()).add("kind", StringType()).add("text", StringType()).add("extra", StringType()))

        def eval(self, content, name):
            for i, line in enumerate(bytes(content).decode().splitlines()):
                yield i, "para", line.upper(), "more"

    out = engine.convert(spark, str(tmp_path), engine.Config(tables={"pdf": Lines}), converted_at="now")
    told = {r["source"]: r["text"] for r in out.collect()}
    assert told["x.pdf"].rstrip().endswith("ONE\n\nP FIRST\n\nTWO\n\nP SECOND") and told["e.pdf"] is None


def test_files_without_bytes_are_told(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_hid").mkdir()
    for name in ("a.txt", "sub/b.docx", "c.csv", "_hid/d.txt", ".e.txt", "f.bin"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "g.txt").write_text("some")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        out = {r["source"]: (r["text"] is None, r["error"]) for r in engine.convert(spark, folder).collect()}
        assert set(out) == {"a.txt", "b.docx", "c.csv", "g.txt"} and out["g.txt"] == (False, None)
        assert out["a.txt"] == out["c.csv"] == (True, files.EMPTY) and out["b.docx"] == (True, engine.BROKEN.format("docx"))
        paths = [r["path"] for r in files.read_files(spark, folder).select("path").collect()]
        assert all(p.startswith(f"file:{tmp_path}/") for p in paths) and len(set(paths)) == 4
    assert files.listing(spark, str(tmp_path)).where("size = 0").count() == 4
