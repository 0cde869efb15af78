"""Text expressions that behave alike for all Unicode white space and count code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squash(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def chained(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    out = col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def html_escape(c: Column | str) -> Column:
    return chained(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def yaml_escape(c: Column | str) -> Column:
    return chained(c, [("\\", "\\\\"), ('"', '\\"')])


def cell_escape(c: Column | str) -> Column:
    return chained(c, [("|", "\\|"), ("\n", " ")])


def safe_filename(c: Column | str) -> Column:
    """A name without characters that file systems refuse; a fixed name where nothing is left."""
    clean = F.regexp_replace(col(c), r'[\\/:*?"<>|\x00-\x1f]', "_")
    clean = F.regexp_replace(clean, r"(?U)^[\s.]+|[\s.]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("제목없음"))


def line_number(text: Column | str, offset: Column | str) -> Column:
    """1 and the line ends before an offset (from 0)."""
    before = F.substring(col(text), F.lit(1), col(offset))
    return F.lit(1) + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def extension(name: Column | str) -> Column:
    """From the last dot on, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(col(name), r"(\.[^.]*)$", 1))


def bold(c: Column | str) -> Column:
    """Marks text as bold, leaving white space at its edges outside; blank text stays."""
    c = col(c)
    return F.when(strip(c) == "", c).otherwise(F.regexp_replace(c, r"(?Us)^(\s*)(.*?)(\s*)$", "$1**$2**$3"))


# Words of equation scripts and what they become.
EQUATION_WORDS = [
    ("over", "\\over"), ("sqrt", "\\sqrt"), ("sum", "\\sum"), ("int", "\\int"), ("times", "\\times"), ("div", "\\div"), ("leq", "\\leq"),
    ("geq", "\\geq"), ("neq", "\\neq"), ("inf", "\\infty"), ("alpha", "\\alpha"), ("beta", "\\beta"), ("gamma", "\\gamma"), ("delta", "\\delta"),
    ("theta", "\\theta"), ("lambda", "\\lambda"), ("pi", "\\pi"), ("sigma", "\\sigma"), ("omega", "\\omega"),
]
# End of the fixed values.


def latex(script: Column | str) -> Column:
    """An equation script as LaTeX."""
    out = squash(script)
    for word, command in EQUATION_WORDS:
        out = F.regexp_replace(out, rf"(?U)\b{word}\b", command.replace("\\", "\\\\"))
    return F.regexp_replace(out, r"(?U)\{([^{}]*)\}\s*\\over\s*\{([^{}]*)\}", r"\\frac{$1}{$2}")


def column_index(letters: Column | str, kind: str = "int") -> Column:
    """A, Z, AA as 0, 25, 26."""
    return F.aggregate(F.split(F.upper(col(letters)), ""), F.lit(0).cast(kind), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def serial_date(serial: Column | str) -> Column:
    """A spreadsheet's day number as a date, with minutes where it has a fraction; null outside (0, 2958465]."""
    x = col(serial).cast("double")
    seconds = F.round(x * 86400).cast("long")
    at = F.timestamp_seconds(F.lit(-2209161600).cast("long") + seconds)  # counted from 1899-12-30
    text = F.when(x == F.floor(x), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    return F.when((x > 0) & (x <= 2958465), text)


@pandas_udf(StringType())
def _ten_digits(x: pd.Series) -> pd.Series:
    """Ten significant digits, rounded from the exact binary value, which no built-in function does."""
    return pd.Series([None if v != v else f"{v:.10g}" for v in x], dtype=object)


def clean_number(raw: Column | str) -> Column:
    """Whole numbers without a fraction, others with ten significant digits; what isn't a number stays."""
    raw = col(raw)
    x = raw.try_cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.when(F.abs(x) < 1e18, x.cast("long").cast("string")).otherwise(F.format_string("%.0f", x))
    return F.when(x.isNull() | ~finite, raw).when(x == F.rint(x), whole).otherwise(_ten_digits(F.when(finite & (x != F.rint(x)), x)))


def date_format_code(code: Column | str) -> Column:
    """Whether a number format shows a date: a letter of one outside brackets and quotes."""
    return F.lower(F.regexp_replace(col(code), r'\[[^\]]*\]|"[^"]*"', "")).rlike("[dmyh]")


def joined_path(folder: Column | str, target: Column | str) -> Column:
    """A path from a folder, without empty, ``.`` and ``..`` steps; one that begins with / is from the top."""
    whole = F.when(col(target).startswith("/"), col(target)).otherwise(F.concat_ws("/", col(folder), col(target)))
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/")


# Names of styles that are titles and subtitles.
TITLES, SUBTITLES = ["title", "제목", "표제"], ["subtitle", "부제", "부제목"]
# End of the fixed values.


def style_level(style: Column | str) -> Column:
    """Heading level of a style by how its name begins: titles 1, subtitles 2, headings their number from 1 to 6, others null."""
    s = strip(style)
    bare = F.replace(F.lower(s), F.lit(" "), F.lit(""))
    number = F.nullif(F.regexp_extract(s, r"(?iU)^(?:제목|개요|heading|outline)\s*(\d+)", 1), F.lit("")).try_cast("int")
    numbered = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(number, F.lit(1))))
    return F.when(bare.isin(*TITLES), 1).when(bare.isin(*SUBTITLES), 2).when(s.rlike(r"(?iU)^(?:제목|개요|heading|outline)"), numbered)
