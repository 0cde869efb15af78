"""Documents whose texts are markup: one small function turns bytes into rows of nodes, DataFrames do the rest."""

from __future__ import annotations

import csv
import io
import json
import re
import sys
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from ..functions.text import squash
from ..operators.blocks import CELL
from ..storage import steps, stored

NODE = StructType([
    StructField("part", StringType()), StructField("ord", IntegerType()), StructField("last", IntegerType()), StructField("tag", StringType()), StructField("path", StringType()),
    StructField("attrs", MapType(StringType(), StringType())), StructField("text", StringType()), StructField("tail", StringType()),
    StructField("up", MapType(StringType(), IntegerType())),
])


# Fixed value: what is said of a file whose reader broke off without a sentence of its own.
UNREADABLE = "파일을 읽지 못했습니다: "
# End of the fixed value.
#: Bytes that the parts of one container may have unpacked.
MOST_UNPACKED = 1 << 30


class TooLargeError(Exception):
    """A container that unpacks to more than is taken in."""


def reason(error: Exception) -> str:
    """What went wrong with one file, as a sentence: an error's own words, or that it couldn't be read."""
    told = str(error).strip()
    return told if told and type(error).__name__.endswith("Error") else UNREADABLE + (told or type(error).__name__)


def _unpacked(z: zipfile.ZipFile, names: list[str], most: int):
    """(name, bytes) of members; what their headers say isn't trusted."""
    left = most
    for name in names:
        with z.open(name) as member:
            data = member.read(left + 1)
        left -= len(data)
        if left < 0:
            raise TooLargeError(f"압축을 풀면 {most >> 20}MB를 넘습니다.")
        yield name, data


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _attributes(element) -> dict[str, str]:
    """Attributes by local name, a plain one before one of a namespace; those of relations also under r:"""
    found = {}
    for k, v in element.attrib.items():
        if "}" in k:
            found.setdefault(_local(k), v)
            if "relationships" in k:
                found["r:" + _local(k)] = v
    return found | {k: v for k, v in element.attrib.items() if "}" not in k}


def nodes(content: Column, handler: Column, parts: dict[str, str], most: int = MOST_UNPACKED) -> Column:
    """Elements of the XML parts of a container whose names match the handler's pattern, in document order.

    ``ord`` numbers the elements of a part, ``last`` is the number of its last descendant, ``path`` has the names down to it, ``up`` the
    number of the nearest ancestor of each name.  The members of the container are elements of a part ``#members``.  A part that
    isn't XML gives no nodes.  What isn't a container, is encrypted or damaged, or unpacks to more than ``most`` bytes gives
    one node of a part ``#error`` with the reason, '' for the first.
    """

    @pandas_udf(ArrayType(NODE))
    def run(column: pd.Series, handlers: pd.Series) -> pd.Series:
        def flat(part, root):
            rows, parent, stack = [], [], [(root, -1, "", {})]
            while stack:
                element, above, path, up = stack.pop()
                at, tag = len(rows), _local(element.tag) if isinstance(element.tag, str) else ""
                path = f"{path}/{tag}" if path else tag
                parent.append(above)
                rows.append([part, at, at, tag, path, _attributes(element), element.text or "", element.tail or "", up])
                inner = {**up, tag: at}
                stack += [(child, at, path, inner) for child in reversed(element)]
            for at in range(len(rows) - 1, 0, -1):
                rows[parent[at]][2] = max(rows[parent[at]][2], rows[at][2])
            return [tuple(r) for r in rows]

        def one(data, handler):
            out = []
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    out += [("#members", i, i, "member", "member", {"name": name}, "", "", {}) for i, name in enumerate(names)]
                    for part, text in _unpacked(z, sorted(n for n in set(names) if re.search(parts.get(handler, "$^"), n)), most):
                        try:
                            out += flat(part, ElementTree.fromstring(text))
                        except ElementTree.ParseError:
                            continue
            except Exception as e:  # noqa: BLE001 - whatever a file holds, it fails alone
                plain = data is None or isinstance(e, zipfile.BadZipFile) and not out
                return [*(x for x in out if x[0] == "#members"), ("#error", 0, 0, "zip", "zip", {}, "" if plain else reason(e), "", {})]
            return out

        return pd.Series([one(x, h) for x, h in zip(column, handlers, strict=True)])

    return run(content, handler)


def members(content: Column, pattern: str, most: int = MOST_UNPACKED) -> Column:
    """Members of a container whose names match, with their bytes; none of one that can't be read."""

    @pandas_udf(ArrayType(StructType([StructField("member", StringType()), StructField("content", BinaryType())])))
    def run(column: pd.Series) -> pd.Series:
        wanted = re.compile(pattern)

        def one(data):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    return list(_unpacked(z, sorted(n for n in z.namelist() if wanted.search(n)), most))
            except Exception:  # noqa: BLE001 - whatever a file holds, it fails alone
                return []

        return pd.Series([one(x) for x in column])

    return run(content)


PIECE = StructType([
    *(StructField(n, IntegerType()) for n in ("at", "level", "lists", "cell", "col_span", "row_span", "table_end", "row_end")), StructField("item", BooleanType()), StructField("take", BooleanType()),
    StructField("in_table", BooleanType()), StructField("text", StringType()), StructField("error", StringType()),
])
# Elements that begin and end a block, elements whose content isn't text, and the name of a picture without one.
HTML_BLOCKS = ["p", "div", "section", "article", "blockquote", "pre", "figcaption", "dd", "dt"]
HTML_SKIPPED = ["script", "style", "head", "noscript", "svg", "template"]
PICTURE = "그림"
# End of the fixed values.
HTML_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
HTML_LISTS, HTML_BOLD, HTML_CELLS = ["ul", "ol"], ["b", "strong"], ["td", "th"]


class _Tokens(HTMLParser):
    """Tags and text of a page as they come, without any meaning."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_data(self, data: str) -> None:
        self.found.append(("text", "", data, 1, 1))

    def handle_starttag(self, tag: str, attrs) -> None:
        have = dict(attrs)
        spans = [max(1, int(v)) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", v) else 1 for v in (have.get("colspan") or "", have.get("rowspan") or "")]
        picture = f" ![{have.get('alt', PICTURE)}]({have['src']}) " if tag == "img" and have.get("src") else ""
        self.found.append(("open", tag, picture, *spans))

    def handle_endtag(self, tag: str) -> None:
        self.found.append(("close", tag, "", 1, 1))


def _tokens(text: str) -> list[tuple]:
    reader = _Tokens()
    reader.feed(text)
    reader.close()
    return [*reader.found, ("end", "", "", 1, 1)]


class _Running:
    """Running values over the tokens of many pages that stand one after the other."""

    def __init__(self, page: np.ndarray) -> None:
        self.n, self.page = len(page), page
        begins = np.r_[True, page[1:] != page[:-1]] if self.n else np.zeros(0, bool)
        self.start = np.maximum.accumulate(np.where(begins, np.arange(self.n), 0))
        self.stop = np.r_[np.flatnonzero(begins)[1:], self.n][np.cumsum(begins) - 1] if self.n else self.start

    def depth(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """How many are open after each token; what closes without being open counts for nothing."""
        total = np.cumsum(up.astype(np.int64) - down)
        total = total - np.where(self.start > 0, total[self.start - 1], 0)
        # pages lie far apart, so that the lowest value up to a token is one of its own page
        far = self.page * (4 * self.n + 4)
        return total - np.minimum(0, np.minimum.accumulate(total - far) + far)

    def last(self, said: np.ndarray) -> np.ndarray:
        """The place of the last token before each that says so, or -1."""
        at = np.r_[-1, np.maximum.accumulate(np.where(said, np.arange(self.n), -1))[:-1]]
        return np.where(at >= self.start, at, -1)

    def next(self, said: np.ndarray) -> np.ndarray:
        """The place of the first token after each that says so, or -1."""
        at = np.r_[np.minimum.accumulate(np.where(said, np.arange(self.n), self.n)[::-1])[::-1][1:], self.n]
        return np.where(at < self.stop, at, -1)

    def before(self, values: np.ndarray) -> np.ndarray:
        moved = np.r_[0, values[:-1]]
        moved[self.start == np.arange(self.n)] = 0
        return moved


def html_pieces(pages: DataFrame) -> DataFrame:
    """The texts of pages (doc_id, text) between tokens that end a block, each with what is open there.  Null is an empty page.

    ``at`` is the place of the ending token; ``cell`` that of the open cell or -1, and ``take`` says that the cell ends; ``table_end``
    and ``row_end`` are the places of the next ends of a table and a row, or -1.  A page that can't be read is one piece with an error.
    Pages are taken in steps of about ``STEP_BYTES``, so a task holds the tokens of one step, however many pages a batch has.
    """
    groups = [HTML_SKIPPED, HTML_BOLD, HTML_LISTS, HTML_HEADINGS, HTML_CELLS, [*HTML_BLOCKS, *HTML_HEADINGS, *HTML_LISTS, "li"], ["table"], ["tr"], ["br"], ["img"], ["li"]]
    kinds = {"text": 0, "open": 1, "close": 2, "end": 3}
    names = PIECE.fieldNames()
    tags = {t: i for i, t in enumerate(sorted({t for g in groups for t in g}), 1)}
    lut = np.zeros((len(groups), len(tags) + 1), bool)
    for i, g in enumerate(groups):
        lut[i, [tags[t] for t in g]] = True
    level = np.array([0, *(int(t[1]) if t in HTML_HEADINGS else 0 for t in sorted(tags))])

    def rows(batch, ids, columns):
        made = [pa.array(np.asarray(c, np.int32)) for c in columns[:8]] + [pa.array(np.asarray(c, bool)) for c in columns[8:11]] + [pa.array(c, pa.string()) for c in columns[11:]]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), *made], ["doc_id", *names])

    def one(batch):
        page, tokens, bad = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            try:
                found = _tokens(text or "")
            except Exception as e:  # noqa: BLE001 - whatever a page holds, it fails alone
                bad.append((i, reason(e)))
                continue
            page += [i] * len(found)
            tokens += found
        if bad:
            zero = [0] * len(bad)
            yield rows(batch, [i for i, _ in bad], [*[zero] * 11, [""] * len(bad), [e for _, e in bad]])
        if not tokens:
            return
        kind = np.fromiter((kinds[t[0]] for t in tokens), np.int8, len(tokens))
        tag = np.fromiter((tags.get(t[1], 0) for t in tokens), np.int64, len(tokens))
        place = np.arange(len(tokens))
        every = page = np.array(page)
        opened, closed, end = kind == 1, kind == 2, kind == 3
        skips = lut[0][tag]
        used = (_Running(page).depth(opened & skips, closed & skips) == 0) & ~skips | end
        place, kind, tag, page, opened, closed, end = (x[used] for x in (place, kind, tag, page, opened, closed, end))
        skip, bold, lists, heading, cells, block, table, tr, br, img, li = (g[tag] for g in lut)
        here = _Running(page)
        first = np.searchsorted(every, np.arange(batch.num_rows))  # places are counted in their page
        bolds, open_lists = (here.before(here.depth(opened & x, closed & x)) for x in (bold, lists))
        of = lambda x, at, none: np.where(at >= 0, x[at], none)
        levels = of(np.where(opened, level[tag], 0), here.last(heading), 0)
        in_table = of(opened, here.last(table), False)
        row = tr & (closed | in_table)
        in_row = of(opened, here.last(row), False)
        ends_at = lambda x: (lambda at: np.where((at >= 0) & closed[at], place[at] - first[page], -1))(here.next(x))
        table_end, row_end = ends_at(table), ends_at(row)
        cell = here.last(cells & (opened & in_row | closed))
        in_cell = (cell >= 0) & opened[cell]
        take = closed & cells & in_cell
        ends = end | (opened | closed) & block | opened & table | take
        said = (kind == 0) | opened & (br | bold | img) | closed & bold & (bolds > 0)
        part = np.cumsum(ends) - ends
        texts: list[list[str]] = [[] for _ in range(int(ends.sum()))]
        for k in np.flatnonzero(said):
            token = tokens[place[k]]
            texts[part[k]].append(token[2] if kind[k] == 0 or img[k] else " " if br[k] else "**")
        at = np.flatnonzero(ends)
        spans = np.array([tokens[place[cell[k]]][3:] if in_cell[k] else (1, 1) for k in at]).reshape(-1, 2)
        own = np.where(in_cell, place[cell] - first[page], -1)
        numbers = ((place - first[page])[at], levels[at], open_lists[at], own[at], spans[:, 0], spans[:, 1], table_end[at], row_end[at])
        yield rows(batch, page[at], [*numbers, (closed & li)[at], take[at], in_table[at], ["".join(t) for t in texts], [None] * len(at)])

    def run(batches):
        for batch in batches:
            for step in steps(batch, "text"):
                yield from one(step)

    return pages.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, StructType([StructField("doc_id", pages.schema["doc_id"].dataType), *PIECE.fields]))


def html_blocks(pages: DataFrame, tables: bool = True) -> DataFrame:
    """doc_id, at, kind, level, text and rows of the headings, paragraphs and tables of pages (doc_id, text), in order.

    Pages are read once: their pieces are stored where tables are asked for.  Texts outside cells are blocks as they come.  Only what stands in cells is dealt out, once, by page: texts of a cell,
    cells of a row and rows of a table come together in three groupings.  A page that can't be read gives one row of kind ``error``.
    """
    pieces = html_pieces(pages).withColumn("text", squash(F.col("text")))
    pieces = stored(pieces, "pieces") if tables else pieces
    none = F.lit(None).cast(f"array<array<{CELL}>>").alias("rows")
    heading = F.col("level") > 0
    prefix = F.when(F.col("item"), F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("lists") - 1)), F.lit("- "))).otherwise("")
    kind = F.when(F.col("error").isNotNull(), "error").when(heading, "heading").otherwise("para")
    text = F.coalesce("error", F.when(heading, F.replace("text", F.lit("**"), F.lit(""))).otherwise(F.concat(prefix, "text")))
    plain = pieces.where("cell < 0 AND text <> '' OR error IS NOT NULL").select("doc_id", "at", kind.alias("kind"), "level", text.alias("text"), none)
    if not tables:
        return plain
    # a cell shows what stood last in it before its finished blocks
    inner = F.array_sort(F.collect_list(F.when(~F.col("take") & (F.col("text") != ""), F.struct("at", "text"))))["text"]
    held = pieces.where("cell >= 0 AND error IS NULL").repartition("doc_id").groupBy("doc_id", "cell").agg(
        squash(F.concat_ws(" ", F.max(F.when(F.col("take"), F.col("text"))), F.array_join(inner, " "))).alias("text"), F.max("col_span").alias("col_span"), F.max("row_span").alias("row_span"),
        F.max(F.when(F.col("take"), F.struct("at", "in_table", "table_end", "row_end"))).alias("e"),
    )
    held = held.where("e.in_table AND e.row_end >= 0 AND e.table_end > e.row_end").select("doc_id", "e.*", F.struct("text", "col_span", "row_span").cast(CELL).alias("c"))
    lines = held.groupBy("doc_id", "table_end", "row_end").agg(F.array_sort(F.collect_list(F.struct("at", "c")))["c"].alias("cells"))
    made = lines.groupBy("doc_id", "table_end").agg(F.array_sort(F.collect_list(F.struct("row_end", "cells")))["cells"].alias("rows"))
    return plain.unionByName(made.select("doc_id", F.col("table_end").alias("at"), F.lit("table").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text"), F.col("rows").cast(f"array<array<{CELL}>>").alias("rows")))


def csv_rows(text: Column, delimiter: str | None = None) -> Column:
    """rows (arrays of cells) and error; without a delimiter, the one of , ; tab | that the first twenty lines suggest.

    A cell may be as long as the text.  What can't be read gives an error and no rows.
    """

    @pandas_udf(StructType([StructField("rows", ArrayType(ArrayType(StringType()))), StructField("error", StringType())]))
    def run(column: pd.Series) -> pd.DataFrame:
        csv.field_size_limit(1 << 31)

        def sniff(text):
            try:
                return csv.Sniffer().sniff("\n".join(text.splitlines()[:20]), delimiters=",;\t|").delimiter
            except csv.Error:
                return ","

        def one(text):
            try:
                return [r for r in csv.reader(io.StringIO(text or ""), delimiter=delimiter or sniff(text or "")) if any(c.strip() for c in r)], None
            except Exception as e:  # noqa: BLE001 - whatever a file holds, it fails alone
                return [], reason(e)

        return pd.DataFrame([one(x) for x in column], columns=["rows", "error"])

    return run(text)


# Fixed value.
NOT_JSON = "JSON 형식이 아닙니다 ({}행): {}"
# End of the fixed value.


def pretty_json(text: Column) -> Column:
    """Indented JSON with its keys in their order, or what is wrong with it."""

    @pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
    def run(column: pd.Series) -> pd.DataFrame:
        sys.set_int_max_str_digits(0)

        def one(text):
            try:
                return json.dumps(json.loads(text or ""), ensure_ascii=False, indent=2), None
            except json.JSONDecodeError as e:
                return None, NOT_JSON.format(e.lineno, e.msg)
            except Exception as e:  # noqa: BLE001 - such as nesting beyond the stack
                return None, reason(e)

        return pd.DataFrame([one(x) for x in column], columns=["text", "error"])

    return run(text)
