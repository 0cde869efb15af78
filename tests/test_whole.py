"""Queries over every row, which have no SQL, against brute force on small tables."""

import collections
import re

import __spark_entry__ as entry


def squash(line):
    return " ".join(line.split())


def brute_pages(docs):
    """Boilerplate, body lines and sizes of documents whose lines are pages."""
    boiler, body, size = set(), set(), {}
    for i, text in docs:
        pages = {n: [x for x in ((0, "Internal Report"), (1, squash(t)), (2, f"- {n} -")) if x[1]] for n, t in enumerate(text.split("\n"), 1)}
        edges = collections.Counter(line for p in pages.values() for line in {x for _, x in p[:2] + p[-2:]} if len(line) <= 90 and not line.startswith("- "))
        same = {line for line, c in edges.items() if len(pages) >= 3 and c >= max(3, int(len(pages) * 0.6))}
        boiler |= {(i, line) for line in same}
        kept = {(i, n, line) for n, p in pages.items() for _, line in p if line not in same and not re.fullmatch(r"[-\s]*(\d{1,4}|[ivxlcIVXLC]{1,7})[-\s]*", line)}
        body |= kept
        if kept:
            size[i] = (sum(len(x[2]) for x in kept), "OCR" if sum(len(x[2]) for x in kept) < 20 else None)
    return boiler, body, size


def test_pages_of_every_document(spark, tmp_path):
    docs = [(i, "\n".join(["head line"] * (i % 5) + [f"text  of document {i} page {n}" for n in range(i % 4)] + ["x"])) for i in range(1, 23)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = {name: entry.queries()[name](spark, str(tmp_path)).collect() for name in ("page_boilerplate", "page_body", "page_text_size")}
    boiler, body, size = brute_pages(docs)
    assert {i for i, _ in boiler} - set(range(0, 23, 5)) and any(e for _, e in size.values())
    assert sorted((r["doc_id"], r["line"]) for r in run["page_boilerplate"]) == sorted(boiler)
    assert sorted((r["doc_id"], r["page_no"], r["line"]) for r in run["page_body"]) == sorted(body)
    assert {r["doc_id"]: (r["chars"], r["error"]) for r in run["page_text_size"]} == size


def test_column_letters_of_any_length(spark, tmp_path):
    known = {0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 16_383: "XFD", 18_277: "ZZZ", 18_278: "AAAA", 2_147_483_646: "FXSHRXW", 26**8: "YYYYYYZA"}
    spark.createDataFrame([(k,) for k in known], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    rows = entry.queries()["column_letters"](spark, str(tmp_path)).collect()
    assert {r["p_partkey"]: (r["letters"], r["idx"]) for r in rows} == {k: (v, k) for k, v in known.items()}


def test_html_blocks_keep_tables(spark, tmp_path):
    html = "<h1>T</h1><p>before</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><p>after</p><table><tr><td>x</td></tr></table>"
    spark.createDataFrame([(1, html), (2, "<p>only</p>"), (3, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    body = {r["page_id"]: r["body"] for r in entry.queries()["html_blocks"](spark, str(tmp_path)).collect()}
    assert body[1].strip() == "# T\n\nbefore\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nafter\n\n| x |\n| --- |"
    assert body[2].strip() == "only" and set(body) == {1, 2, 3}
