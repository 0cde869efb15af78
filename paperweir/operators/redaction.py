"""Detection and replacement of personal identifiers, as joins and windows over a table of pattern matches.

One Arrow function finds where the patterns match, with a little text around each match, and where the names
that labels and titles may confirm stand again; everything from there on is DataFrame work: names are read off
their matches, rejected by context, echoes of names that weren't confirmed dropped, overlaps settled, values
numbered and put in place.  A text is read once, and only matches are dealt out.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import names as N
from ..storage import steps, stored
from . import words

AUTO, REVIEW = "AUTO", "REVIEW"
VERSION = "redact/0.2"
AROUND = 18


def _spaced(word: str) -> str:
    return "[\\s ]*".join(word)


def _any(words: list[str], longest_first: bool = False, each=lambda w: w) -> str:
    return "|".join(each(w) for w in (sorted(words, key=len, reverse=True) if longest_first else words))


# The rules, in the order that breaks ties (kind, label, pattern, grade, group).
_AFTER_SURNAME = "(?=$|[^가-힣]|[은는이가와과의도를에])"
_AFTER_MASK = "(?=$|[^가-힣]|[은는이가와과의도를을에])"
RULES = [
    ("RRN", "주민등록번호", r"\d{6}\s*[-–—]\s*[1-4]\d{6}", AUTO, 0),
    ("FOREIGNER", "외국인등록번호", r"\d{6}\s*[-–]\s*[5-8]\d{6}", AUTO, 0),
    ("PASSPORT", "여권번호", r"\b[MSRO]\d{8}\b", AUTO, 0),
    ("DRIVER", "운전면허번호", r"\b\d{2}-\d{2}-\d{6}-\d{2}\b", AUTO, 0),
    ("MOBILE", "휴대전화", r"\b01[016789][-\s.]?\d{3,4}[-\s.]?\d{4}\b", AUTO, 0),
    ("PHONE", "전화번호", r"\b0\d{1,2}[-\s.]\d{3,4}[-\s.]\d{4}\b", AUTO, 0),
    ("EMAIL", "이메일", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b", AUTO, 0),
    ("CARD", "카드번호", r"\b\d{4}-\d{4}-\d{4}-\d{4}\b", AUTO, 0),
    ("ACCOUNT", "계좌번호", r"\b(?!01[016789]-)\d{3,6}-\d{2,6}-\d{4,7}\b", AUTO, 0),
    ("NAME_LABELED", "성명(항목명)", rf"(?:{_any(N.NAME_LABELS, True, _spaced)})\s*[:：|\t]\s*([가-힣]{{2,6}})", AUTO, 1),
    ("NAME_TITLED", "성명(직위 동반)", rf"(?:{_any(N.TITLE_BEFORE)})\s+([가-힣]{{2,6}})", AUTO, 1),
    ("NAME_TITLED", "성명(직위 동반)", rf"(?<![가-힣])([가-힣]{{2,4}})\s*(?:{_any(N.TITLE_AFTER)})(?![가-힣])", AUTO, 1),
    ("NAME_SURNAME", "성(호칭 동반)", rf"(?<![가-힣])[{N.SURNAMES}]\s?모?\s?씨{_AFTER_SURNAME}", AUTO, 0),
    ("NAME_MASKED", "성명(부분마스킹)", rf"(?<![가-힣])[{N.SURNAMES}][○OoΟ×●]{{1,3}}{_AFTER_MASK}", AUTO, 0),
    ("NAME_MASKED", "성명(부분마스킹)", rf"(?<![가-힣])[{N.SURNAMES}][가-힣][○OoΟ×●]{_AFTER_MASK}", AUTO, 0),
    ("NAME_INITIAL", "성명(이니셜)", r"\b[A-Z](?:씨|\s?대표|\s?이사|\s?부장|\s?과장)", AUTO, 0),
    ("BIRTH", "생년월일", r"\b(?:19|20)\d{2}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}\s*일?생", AUTO, 0),
    ("NAME_BARE", "성명(추정)", r"(?<![가-힣])([가-힣]{2,12})(?![가-힣])", REVIEW, 1),
    ("ADDRESS", "상세주소", r"[가-힣]+(?:시|도)\s*[가-힣]+(?:시|군|구)\s*[가-힣0-9]+(?:동|읍|면|로|길)\s*[0-9-]+(?:번지|호)?", REVIEW, 0),
]
PROTECTED = [r"(?s)```.*?```", r"`[^`\n]+`", r"「[^」\n]{1,60}」", r"\]\([^)\s]+\)"]
PREFIXES = {
    "RRN": "주민번호", "FOREIGNER": "외국인번호", "PASSPORT": "여권번호", "DRIVER": "면허번호", "ACCOUNT": "계좌번호", "CARD": "카드번호",
    "MOBILE": "연락처", "PHONE": "연락처", "EMAIL": "이메일", "BIRTH": "생년월일", "ADDRESS": "주소",
}
NAME_PREFIX, OTHER_PREFIX = "자연인", "비식별"
# End of the fixed values.
ANCHORS = ["NAME_LABELED", "NAME_TITLED", "NAME_MASKED", "NAME_USER"]
USER, ECHO = 0, 20
#: The same for places that only may hold a name of a large list.
ASKED_USER, ASKED_ECHO = -2, -1
#: Overlapping matches from which on an island was walked along; now all are, and this says nothing.
LONG_ISLAND = 64
#: Stop words that stand in an expression; more are joined.
STOP_WORDS = 1_000
_NAMED = [i + 1 for i, r in enumerate(RULES) if r[0] in ("NAME_LABELED", "NAME_TITLED")]
_MASKED = [i + 1 for i, r in enumerate(RULES) if r[0] == "NAME_MASKED"]
_DIGITS = [i + 1 for i, r in enumerate(RULES) if not r[0].startswith("NAME_") and r[0] != "ADDRESS"]

MATCH = StructType([StructField(n, t) for n, t in (("ord", IntegerType()), ("start", IntegerType()), ("value", StringType()), ("left", StringType()), ("right", StringType()), ("line", IntegerType()))])


class Spans:
    """Spans of one text, asked for places in them: sorted by start, with the furthest end up to each."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts, self.ends = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))

    def holds(self, place: int) -> bool:
        k = bisect.bisect_right(self.starts, place)
        return k > 0 and place < self.ends[k - 1]


def matches(docs: DataFrame, user_names: list[str] = (), asked=None) -> DataFrame:
    """Where each rule matches in docs (doc_id, text) outside the protected spans: offsets in code points, the text around, the line.

    User names come under ord 0, rule i under i + 1; ``asked``, a broadcast filter of a large list, gives places that may hold
    one of its names, under ords of their own.  Under ECHO come further places of every name that an anchor may
    confirm, with a particle after it or none; which ones are confirmed is for later steps to say.  Null gives none.

    The work grows with the text and its matches: lines and spans are found by bisection, names by looking up the
    characters at each place where one may begin.  A task holds the matches of a step of texts, not those of a batch.
    """
    # a bare name begins with a name's shape, so other runs of Hangul needn't be told
    bare = next(i + 1 for i, r in enumerate(RULES) if r[0] == "NAME_BARE")
    patterns = [(i + 1, f"(?<![가-힣])(?={N.NAME_START})([가-힣]{{3,12}})(?![가-힣])" if i + 1 == bare else p, g) for i, (_, _, p, _, g) in enumerate(RULES)]
    known = frozenset(n for n in user_names if len(n) >= 2)
    particles, surname = frozenset(N.PARTICLES), N.STARTS_WITH_SURNAME

    def find(batches):
        made = [(o, re.compile(p), g) for o, p, g in patterns]
        protected = [re.compile(p) for p in PROTECTED]
        hangul, first, run = re.compile("[가-힣]"), re.compile(surname), re.compile("[가-힣]*")
        plain = [x for x in made if x[0] in _DIGITS]
        lengths = sorted({len(n) for n in known})

        def one(t):
            rows, names = [], set()
            if t:
                breaks = [m.start() for m in re.finditer("\n", t)]
                spans = Spans([m.span() for p in protected for m in p.finditer(t)])

                def add(o, a, b, t=t, rows=rows, breaks=breaks, spans=spans):
                    if not spans.holds(a):
                        rows.append((o, a, t[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND], bisect.bisect_left(breaks, a) + 1))

                for o, p, g in made if hangul.search(t) else plain:
                    for m in p.finditer(t):
                        a, b = m.span(g)
                        if b > a:
                            add(o, a, b)
                            if o in _NAMED:
                                names |= {t[a : a + n] for n in (2, 3, 4) if a + n <= b and t[a + n : b] in particles and first.match(t[a:b])}
                            elif o in _MASKED:
                                names.add(t[a:b])
                for n in lengths:
                    for a in range(len(t) - n + 1):
                        if t[a : a + n] in known and not (a and hangul.match(t[a - 1])):
                            names.add(t[a : a + n])
                            if not hangul.match(t[a + n : a + n + 1]):
                                add(USER, a, a + n)
                for a, n in asked.value.places(t, words.starts(t, "가힣")) if asked else ():
                    after = run.match(t, a + n)[0]
                    if not after:
                        add(ASKED_USER, a, a + n)
                    if after in particles:
                        add(ASKED_ECHO, a, a + n)
                if names:
                    sizes = sorted({len(n) for n in names})
                    begins = re.compile("(?<![가-힣])[" + "".join(re.escape(c) for c in sorted({n[0] for n in names})) + "]")
                    for m in begins.finditer(t):
                        a = m.start()
                        for n in sizes:
                            if t[a : a + n] in names and run.match(t, a + n)[0] in particles:
                                add(ECHO, a, a + n)
            return rows

        for batch in batches:
            for step in steps(batch, "text"):
                found = [one(t) for t in step.column("text").to_pylist()]
                ids = np.repeat(np.arange(len(found)), [len(x) for x in found])
                columns = list(zip(*itertools.chain.from_iterable(found), strict=True)) or [()] * len(MATCH)
                told = [pa.array(c, pa.string() if f.dataType == StringType() else pa.int32()) for c, f in zip(columns, MATCH, strict=True)]
                yield pa.RecordBatch.from_arrays([step.column("doc_id").take(pa.array(ids, pa.int64())), *told], ["doc_id", *MATCH.fieldNames()])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(find, StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *MATCH.fields]))


def prefix(kind: Column) -> Column:
    mapped = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    return F.when(kind.startswith("NAME_"), NAME_PREFIX).otherwise(F.coalesce(mapped[kind], F.lit(OTHER_PREFIX)))


def context(left: Column, right: Column) -> Column:
    """The text around, on one line, with the value itself left out."""
    joined = F.concat(F.replace(left, F.lit("\n"), F.lit(" ")), F.lit("⟦…⟧"), F.replace(right, F.lit("\n"), F.lit(" ")))
    return F.regexp_replace(joined, r"(?U)^\s+|\s+$", "")


def verified(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Matches with those that only may be names of a large list told apart: those that are become user names and possible echoes."""
    rows = stored(rows, "matches")
    sure = words.among(rows.where("ord < 0"), "value", names)
    return rows.where("ord >= 0").unionByName(sure.withColumn("ord", F.when(F.col("ord") == ASKED_USER, USER).otherwise(ECHO)))


def candidates(docs: DataFrame, user_names: list[str] | DataFrame = (), user_stopwords: list[str] | DataFrame = (), single: bool = True) -> DataFrame:
    """Values that the rules find, and possible echoes, before overlaps are settled: docs has doc_id and text.

    Names and stop words are lists, or tables of a column w where they are too many for that.
    """
    many, barred = isinstance(user_names, DataFrame), isinstance(user_stopwords, DataFrame)
    stop = F.array(*(F.lit(w) for w in user_stopwords)) if not barred and user_stopwords else None
    asked = docs.sparkSession.sparkContext.broadcast(words.told(user_names)) if many else None
    rows = matches(docs, () if many else user_names, asked)
    rows = verified(rows, user_names) if many else rows
    told = [(USER, "NAME_USER", "성명(사용자 사전)", AUTO), (ECHO, "NAME_ECHO", "성명(같은 문서 재등장)", AUTO), *((i + 1, k, label, grade) for i, (k, label, _, grade, _) in enumerate(RULES))]
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(told, "ord int, kind string, label string, confidence string")), "ord")
    kind, raw = F.col("kind"), F.col("value")
    name = (
        F.when(kind == "NAME_BARE", N.bare_name(raw, stop))
        .when(kind.isin("NAME_LABELED", "NAME_TITLED"), N.anchored_name(raw))
        .otherwise(raw)
    )
    # given out by explode, a name is resolved once for each match and not wherever it is used
    rows = rows.select("*", F.explode(F.array(name)).alias("name")).where("name IS NOT NULL")
    rows = rows.withColumn("right", F.concat(F.substring(raw, F.length("name") + 1, F.lit(100)), F.col("right"))).withColumn("value", F.col("name")).drop("name")
    judged = kind.startswith("NAME_") & (kind != "NAME_USER")
    fine = kind.isin("NAME_SURNAME", "NAME_ECHO") | N.plausible(F.col("value"), kind == "NAME_BARE", stop)
    kept = rows.where(~judged | (fine & ~N.in_organisation(F.col("left"), F.col("value"), F.col("right"), single)))
    kept = kept.where((kind != "NAME_BARE") | ~N.in_address(F.col("left")))
    if not barred:
        return kept
    kept, spared = stored(kept, "candidates"), ~kind.startswith("NAME_") | kind.isin("NAME_SURNAME", "NAME_ECHO", "NAME_USER")
    return kept.where(spared).unionByName(words.among(kept.where(~spared), "value", user_stopwords, "left_anti"))


def with_echoes(rows: DataFrame) -> DataFrame:
    """Leaves, of the echoes, those of names that an anchor confirmed in the same document, at places that no automatic value takes.

    All that was found in a document meets in one window, so the matches are dealt out once.
    """
    echo = F.col("kind") == "NAME_ECHO"
    auto = ~echo & (F.col("confidence") == AUTO)
    sure = auto & F.col("kind").isin(*ANCHORS) & (F.length("value") >= 2)
    whole, place = Window.partitionBy("doc_id", "value"), Window.partitionBy("doc_id", "start")
    # all windows need the rows of a document together, nothing more; the second and those of overlaps share one order
    rows = rows.repartition("doc_id").withColumn("sure", F.max(sure).over(whole)).where(~echo | F.col("sure"))
    rows = _in_order(rows).withColumn("taken", F.max(auto).over(place))
    return rows.where(~echo | ~F.col("taken")).drop("sure", "taken")


_ORDER = (F.asc, "start"), (F.desc, "end"), (F.asc, "grade"), (F.asc, "ord")


def _in_order(rows: DataFrame) -> DataFrame:
    """The matches of each document from the left, in the order in which overlaps are settled."""
    rows = rows.withColumn("end", F.col("start") + F.length("value")).withColumn("grade", (F.col("confidence") != AUTO).cast("int"))
    return rows.sortWithinPartitions("doc_id", *(f(c) for f, c in _ORDER))


def without_overlaps(rows: DataFrame) -> DataFrame:
    """From the left: the first, of several at one place the longest, then automatic ones, then by rule; what begins inside it goes.

    Rows are those of ``_in_order``, a document's in one partition.  Matches that touch in a chain are an island, whose first
    match stays; the others are told by one walk along the order, which holds no document or island.
    """
    order = Window.partitionBy("doc_id").orderBy(*(f(c) for f, c in _ORDER))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)))
    return rows.where(leftmost("new", "start", "end")).drop("new", "grade")


@pandas_udf(BooleanType())
def leftmost(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of matches in order those that begin an island (``new``), then each that begins where the last taken one has ended, or later."""
    end = -1
    for new, start, stop in parts:
        keep = new.to_numpy(dtype=bool).copy()
        first = np.maximum.accumulate(np.where(keep, np.arange(len(keep)), -1))
        starts, stops, last = start.to_numpy(), stop.to_numpy(), -1
        for i in np.flatnonzero(~keep):
            last = max(last, first[i])
            if starts[i] >= (stops[last] if last >= 0 else end):
                keep[i], last = True, i
        if keep.any():
            end = stops[np.flatnonzero(keep)[-1]]
        yield pd.Series(keep)


def numbered(rows: DataFrame) -> DataFrame:
    """Placeholders: values of a prefix are numbered in a document by their first place; equal values share a number."""
    rows = rows.withColumn("prefix", prefix(F.col("kind")))
    rows = rows.withColumn("first", F.min("start").over(Window.partitionBy("doc_id", "prefix", "value")))
    number = F.dense_rank().over(Window.partitionBy("doc_id", "prefix").orderBy("first"))
    return rows.withColumn("placeholder", F.format_string("〔%s-%02d〕", F.col("prefix"), number))


def detect(docs: DataFrame, user_names=(), user_stopwords=(), include_review: bool = False, single: bool = True, most: int = words.TASK_WORDS) -> DataFrame:
    """Findings of each document: doc_id, seq, kind, label, original, placeholder, confidence, line, start, end, applied, context.

    user_names and user_stopwords are lists, or DataFrames of one column, of any length: up to ``most`` names go to every task, more
    go there as a filter of fixed size, and what passes it is joined with them, with the same findings.
    """
    spark = docs.sparkSession
    names, stop = words.listed(spark, user_names, 2, most), words.listed(spark, user_stopwords, 1, min(most, STOP_WORDS))
    rows = without_overlaps(with_echoes(candidates(docs, names, stop, single)))
    rows = numbered(rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))))
    applied = (F.col("confidence") == AUTO) | F.lit(include_review)
    return rows.select(
        "doc_id", "seq", "kind", "label", F.col("value").alias("original"), "placeholder",
        "confidence", "line", "start", "end", applied.alias("applied"), context(F.col("left"), F.col("right")).alias("context"),
    )


@pandas_udf(StringType())
def spliced(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    """Texts with the parts (start, end, placeholder) replaced, each text cut once from the left."""

    def one(text, parts):
        if text is None or parts is None:
            return text
        out, at = [], 0
        for part in parts:
            out += [text[at : part["start"]], part["placeholder"]]
            at = part["end"]
        return "".join([*out, text[at:]])

    return pd.Series([one(*x) for x in zip(texts, cuts, strict=True)])


def apply(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id and masked_text: the text with the applied findings replaced."""
    cuts = findings.where("applied").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("c"))
    rows = docs.select("doc_id", "text").join(cuts, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("c").isNull(), F.col("text")).otherwise(spliced("text", "c")).alias("masked_text"))


def public(findings: DataFrame, with_context: bool = False) -> DataFrame:
    """Findings that may be shared: the original never, the context only if asked for."""
    return findings.drop("original") if with_context else findings.drop("original", "context")


def _counts() -> list[Column]:
    tests = {"auto": F.col("confidence") == AUTO, "review": F.col("confidence") == REVIEW, "applied": F.col("applied"), "names": F.col("kind").startswith("NAME_")}
    return [F.count_if(test).alias(name) for name, test in tests.items()]


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id").agg(*_counts())


def mapping(findings: DataFrame) -> DataFrame:
    """placeholder -> original of what was replaced, for those who may see it."""
    used = findings.where("applied").select("doc_id", "placeholder", "original").distinct()
    return used.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("placeholder", "original")))).alias("mapping"))


def report(docs: DataFrame, findings: DataFrame, include_review: bool = False, source: str = "doc_id") -> DataFrame:
    """A JSON report of each document without originals and contexts."""
    told = F.array_sort(F.collect_list(F.struct("seq", "kind", "label", "placeholder", "confidence", "line", "start", "end", "applied")))
    rows = docs.select("doc_id", F.col(source).cast("string").alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"))
    rows = rows.join(findings.groupBy("doc_id").agg(*_counts(), told.alias("findings")), "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("auto", "review", "applied", "names")}
    body = F.struct("source", F.lit(VERSION).alias("engine_version"), "source_sha256", F.lit(include_review).alias("include_review"), F.struct(*zero.values()).alias("summary"), F.coalesce("findings", F.array()).alias("findings"))
    return rows.select("doc_id", F.to_json(body).alias("report"))
