"""Scalar text functions as built-in column expressions.

Python's ``str.strip``/``split`` treat the whole Unicode white-space class as
blank, Spark's ``trim`` only the space. Every expression here uses the wider
class: ``btrim`` with a character set (linear) or the regex class ``WS``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true (fixed values).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"(?U)[\s\x1c-\x1f]"

# Boilerplate sentences dropped from docstrings (fixed values).
BOILERPLATE = ["[Qmod Classiq-library function]", "[Qmod core-library function]"]

NAME_UNKNOWN = "unknown"
MISSING = "N/A"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.btrim(F.regexp_replace(c, WS + "+", " "), F.lit(" "))


def last_part(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def short_name(c: Column) -> Column:
    """Text after the last '/' and then after the last '.'; null gives ''."""
    return F.coalesce(last_part(last_part(c, "/"), "."), F.lit(""))


def framework_of(c: Column) -> Column:
    blank = c.isNull() | (strip(c) == "")
    return F.when(blank, F.lit(NAME_UNKNOWN)).otherwise(
        F.substring_index(F.btrim(c, F.lit("/")), "/", 1)
    )


def project_of(c: Column) -> Column:
    """First component of a POSIX path; an absolute path gives its root."""
    # the first component that is neither empty nor '.'
    first = F.regexp_extract(c, r"^(?:\.?/)*([^/]*)", 1)
    root = F.when(c.startswith("//") & ~c.startswith("///"), F.lit("//")).otherwise(F.lit("/"))
    return (
        F.when(c.isNull(), F.lit(""))
        .when(c.startswith("/"), root)
        .when(first.isin("", "."), c)
        .otherwise(first)
    )


def comment_block(c: Column) -> Column:
    """All full-line ``#`` comments of a script in order, joined by one blank."""
    lines = F.transform(F.split(c, r"[\r\n]+"), strip)
    marked = F.filter(lines, lambda s: s.startswith("#"))
    bodies = F.transform(marked, lambda s: strip(F.ltrim(s, F.lit("# "))))
    return F.array_join(F.filter(bodies, lambda s: s != ""), " ")


def truncated_comment(c: Column, limit: int = 150) -> Column:
    cut = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)
    return F.replace(cut, F.lit(";"), F.lit(","))


def snake_case(c: Column) -> Column:
    words = F.regexp_replace(c, r"(?d)(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(words, r"([a-z0-9])([A-Z])", "$1_$2"))


def _first_paragraph_raw(c: Column) -> Column:
    return F.element_at(F.split(strip(c), "\n\n"), 1)


def first_paragraph(c: Column) -> Column:
    return F.replace(strip(_first_paragraph_raw(c)), F.lit("\n"), F.lit(" "))


def two_sentences(c: Column) -> Column:
    """First two non-empty sentences of the first paragraph, '' for null."""
    para = _first_paragraph_raw(c)
    parts = F.filter(F.transform(F.split(squeeze(para), r"\."), strip), lambda s: s != "")
    return (
        F.when(c.isNull() | (c == ""), F.lit(""))
        .when(F.size(parts) >= 1, F.concat(F.array_join(F.slice(parts, 1, 2), ". "), F.lit(".")))
        .otherwise(para)
    )


def without_boilerplate(c: Column, phrases: list[str] = BOILERPLATE) -> Column:
    for phrase in phrases:
        c = F.regexp_replace(c, WS + "*" + re.escape(phrase) + r"\.?" + WS + "*", " ")
    return strip(c)


def module_path(rel: Column) -> Column:
    """``a/b/c.py`` to ``a.b.c``; only the last suffix of the file goes."""
    return F.replace(F.regexp_replace(rel, r"(?<=[^/])\.[^./]+$", ""), F.lit("/"), F.lit("."))


def module_of_concept(name: Column, prefix: str) -> Column:
    """Concept name without its last dotted part and without the prefix."""
    head = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")
    return F.replace(head, F.lit(prefix), F.lit(""))


def display_name(c: Column) -> Column:
    return F.concat(F.lit("..."), last_part(F.replace(c, F.lit("/"), F.lit(".")), "."))


def dotted_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("."))


def capitalize(c: Column) -> Column:
    """First letter in title form (not always the upper one: ß, ǆ), the rest in lower case."""
    first = F.substring(c, 1, 1)
    upper = F.upper(first)
    title = F.when(first.rlike("[Ǆ-ǌǱ-ǳ]"), F.translate(first, "ǄǅǆǇǈǉǊǋǌǱǲǳ", "ǅǅǅǈǈǈǋǋǋǲǲǲ")).otherwise(
        F.concat(F.substring(upper, 1, 1), F.lower(F.substr(upper, F.lit(2)))))
    return F.concat(title, F.lower(F.substr(c, F.lit(2))))


def score_text(c: Column) -> Column:
    """Four digits as Python prints them: by the exact binary value, exact ties to even.

    What the product x * 10000 lost in rounding comes exactly from the products of x's halves, so the sign
    of its distance to the tie is exact. Plain arithmetic only: it is compiled, and runs for every pair of a join.
    """
    x = F.abs(c.cast("double"))
    product, big = x * 10000.0, x * 134217729.0
    upper = big - (big - x)
    lost = (upper * 10000.0 - product) + (x - upper) * 10000.0
    whole = F.floor(product)
    rest = (product - whole - 0.5) + lost
    n = whole + F.when((rest > 0) | ((rest == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(c < 0, "-").otherwise("")
    text = F.concat(sign, F.floor(n / 10000).cast("string"), F.lit("."), F.substring((n % 10000 + 10000).cast("string"), 2, 4))
    plain = F.when(F.isnan(c), "nan").otherwise(F.format_string("%.4f", c))
    return F.when(c.isNotNull(), F.when(F.abs(c) < 1e11, text).otherwise(plain))


def snippet_key(name: Column, strip_all: bool = True) -> Column:
    """File-safe concept key; leading '_' go entirely or only the first one."""
    flat = F.translate(name, "/.", "__")
    return F.ltrim(flat, F.lit("_")) if strip_all else F.regexp_replace(flat, "^_", "")


def kappa_label(c: Column) -> Column:
    """Landis and Koch (1977) wording."""
    return (
        F.when(c < 0, "Poor agreement")
        .when(c <= 0.20, "Slight agreement")
        .when(c <= 0.40, "Fair agreement")
        .when(c <= 0.60, "Moderate agreement")
        .when(c <= 0.80, "Substantial agreement")
        .otherwise("Almost perfect agreement")
    )


def markdown_row(name: Column, summary: Column) -> Column:
    def cell(c: Column) -> Column:
        return F.replace(c, F.lit("|"), F.lit("\\|"))

    return F.concat(
        F.lit("| `"), cell(strip(F.coalesce(name, F.lit(MISSING)))), F.lit("` | "),
        cell(squeeze(F.coalesce(summary, F.lit("")))), F.lit(" |"),
    )


# Replacements run one after the other in this order (fixed values): the
# braces written for the backslash are themselves escaped by the next two.
LATEX_ESCAPES = [
    ("\\", r"\textbackslash{}"), ("{", r"\{"), ("}", r"\}"), ("&", r"\&"), ("%", r"\%"),
    ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"),
]


def latex_escape(c: Column) -> Column:
    for plain, escaped in LATEX_ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


# Section titles of a catalogue entry and the field each one shows (fixed values).
PATTERN_SECTIONS = [
    ("Intent", "intent"), ("Context", "context"), ("Problem & Forces", "forces"),
    ("Solution", "solution"), ("Resulting Context", "result"),
]


def pattern_markdown() -> Column:
    """Markdown of one catalogue row; empty sections and a '—' alias are left out."""
    def filled(c: Column) -> Column:
        return c.isNotNull() & (c != "")

    title = F.concat(F.lit("## "), F.coalesce(F.col("name"), F.lit("Unnamed Pattern")), F.lit("\n"))
    alias = F.when(
        filled(F.col("alias")) & (strip(F.col("alias")) != "—"),
        F.concat(F.lit("***Also known as:** "), F.col("alias"), F.lit("*\n")),
    )
    blocks = []
    for heading, field in PATTERN_SECTIONS:
        c = F.col(field)
        blocks.append(F.when(filled(c), F.concat(F.lit(f"### {heading}\n\n"), strip(c), F.lit("\n"))))
    return F.concat_ws("\n", title, alias, *blocks)


def preview(c: Column, limit: int = 100) -> Column:
    return F.coalesce(
        F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c),
        F.lit(MISSING),
    )


# Repositories whose folder name is not the last path part (fixed values).
FOLDER_NAMES = {"tensorflow/quantum": "tensorflow-quantum"}


def repo_folder(c: Column) -> Column:
    expr = last_part(F.regexp_replace(c, "/+$", ""), "/")
    for repo, folder in FOLDER_NAMES.items():
        expr = F.when(c == repo, F.lit(folder)).otherwise(expr)
    return expr


def archive_path(project: Column, rel: Column) -> Column:
    flat = F.replace(F.btrim(project, F.lit("/")), F.lit("/"), F.lit("_"))
    return F.concat_ws("/", flat, rel)


def to_null(c: Column) -> Column:
    """The ``N/A`` marker, '' and null all mean 'no pattern'."""
    return F.when(~c.isin(MISSING, ""), c)
