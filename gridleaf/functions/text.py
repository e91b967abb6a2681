"""Text expressions. All are native columns; only full NFKC needs Arrow."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values ---------------------------------------------------------
# Characters counted as white space (Unicode white space plus the four separators 1C..1F).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Decimal digits plus superscript, subscript and circled digits.
DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c\u2488-\u2490]"
NEEDS_CJK = r"[\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\u3000-\u303f]"
IDEOGRAPH = r"[\u4e00-\u9fff]"
CJK_SHARE, LATIN_SHARE = 0.25, 0.6
WIDE_OVER = r"[^\u0000-\u2e80]"
SUMMARY_LIMIT = 46
TRUE_WORDS = ("1", "true", "yes", "on")
# --------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.trim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def compact(text: Column) -> Column:
    """Remove all white space."""
    return F.translate(text, SPACE_CHARS, "")


def collapse(text: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def count_matches(text: Column, char_class: str) -> Column:
    """How many characters fall in a class."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def _nfkc_arrow(text: Column) -> Column:
    # Defined inside, so that it travels to the workers by value. A few texts at a time are Python objects, not the batch.
    def normalize(values: pa.Array) -> pa.Array:
        out = [pa.array([v and unicodedata.normalize("NFKC", v) for v in values.slice(i, 64).to_pylist()], values.type) for i in range(0, len(values), 64)]
        return pa.concat_arrays(out) if out else values

    normalize.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(normalize, StringType())(text)


def nfkc(text: Column) -> Column:
    """NFKC form. ASCII text is its own NFKC form and reaches Python only as a null."""
    foreign = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(_nfkc_arrow(foreign), text)


def cell_key(text: Column, unicode_forms: bool = True) -> Column:
    """Comparison key: NFKC and no white space; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return compact(nfkc(text) if unicode_forms else text)


def normalize_text(text: Column, unicode_forms: bool = True) -> Column:
    """NFKC, single spaces, lower case."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(collapse(nfkc(text) if unicode_forms else text))


def language_hint(text: Column) -> Column:
    """``zh`` / ``en`` / ``auto`` by the share of ideographs and Latin letters."""
    cjk = count_matches(text, IDEOGRAPH)
    latin = count_matches(text, "[A-Za-z]")
    total = F.greatest(F.lit(1), cjk + latin + count_matches(text, DIGIT))
    return (
        F.when(cjk / total > CJK_SHARE, "zh")
        .when(latin / total > LATIN_SHARE, "en")
        .otherwise("auto")
    )


def needs_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(NEEDS_CJK), F.lit(False))


def text_lines(text: Column) -> Column:
    """Stripped non-blank lines, in order."""
    lines = F.transform(F.split(text, LINE_BREAK, -1), strip)
    return F.filter(lines, lambda line: F.length(line) > 0)


def structure_lines(text: Column, headings: bool = True) -> Column:
    """Non-blank lines as ``array<struct<kind, level, text>>``; leading ``#`` make a heading of level 1-6."""

    def one(line: Column) -> Column:
        marks = F.length(F.regexp_extract(line, "^#*", 0))
        head = (marks > 0) & F.lit(headings)
        return F.struct(
            F.when(head, "heading").otherwise("paragraph").alias("kind"),
            F.when(head, F.least(F.lit(6), marks)).otherwise(0).alias("level"),
            F.when(head, strip(F.substring(line, marks + 1, F.length(line)))).otherwise(line).alias("text"),
        )

    return F.transform(text_lines(text), one)


def display_width(text: Column) -> Column:
    """Width in columns: wide characters count twice."""
    text = F.coalesce(text, F.lit(""))
    return F.length(text) + count_matches(text, WIDE_OVER)


def expand_template(template: Column, values: Column) -> Column:
    """Fill ``{name}`` from a map; unknown names stay. Unbalanced braces and fields by position (``{}``, ``{0}``) leave all as it is."""
    tokens = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0))
    broken = F.exists(tokens, lambda t: t.isin("{", "}") | t.rlike(r"^\{[0-9]*\}$"))

    def fill(token: Column) -> Column:
        name = F.substring(token, 2, F.length(token) - 2)
        return (
            F.when(token == "{{", "{")
            .when(token == "}}", "}")
            .when(token.startswith("{"), F.coalesce(F.try_element_at(values, name), token))
            .otherwise(token)
        )

    return F.when(broken, template).otherwise(F.array_join(F.transform(tokens, fill), ""))


def hex_color(value: Column, alpha: int = 255) -> Column:
    """3, 6 or 8 hex digits to ``struct(r,g,b,a)``; anything else is white."""
    text = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), "^#+", "")
    text = F.when(F.length(text) == 3, F.regexp_replace(text, "(.)", "$1$1")).otherwise(text)
    good = text.rlike("^([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")

    def channel(start: int) -> Column:
        return F.conv(F.substring(text, start, 2), 16, 10).cast("int")

    opacity = F.when(good & (F.length(text) == 8), channel(7)).otherwise(F.lit(alpha))
    white = F.lit(255)
    return F.struct(
        F.when(good, channel(1)).otherwise(white).alias("r"),
        F.when(good, channel(3)).otherwise(white).alias("g"),
        F.when(good, channel(5)).otherwise(white).alias("b"),
        opacity.alias("a"),
    )


def unique_in_order(items: Column) -> Column:
    """Distinct elements, first occurrence first."""
    return F.array_distinct(items)


def warning_summary(summary: Column, warnings: Column) -> Column:
    """Append the first warning, shortened, and their number when there are several."""
    n = F.coalesce(F.size(warnings), F.lit(0))
    head = F.get(warnings, F.lit(0))
    head = F.when(
        F.length(head) > SUMMARY_LIMIT,
        F.concat(F.substring(head, 1, SUMMARY_LIMIT), F.lit("…")),
    ).otherwise(head)
    more = F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(" in all)"))).otherwise("")
    return F.when(n > 0, F.concat(summary, F.lit(" · ⚠ "), head, more)).otherwise(summary)


def content_key(content: Column, *parts) -> Column:
    """Cache key: options first, SHA-256 of the content last, so a rename changes nothing."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(":", *parts, F.sha2(content, 256))


# Typed reads from a string map. Missing or unreadable values give the default.


def float_param(params: Column, key: str, default: float) -> Column:
    text = strip(F.try_element_at(params, F.lit(key)))
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|(?i)^[+-]?(inf|infinity|nan)$")
    return F.coalesce(F.when(plain, text.try_cast("double")), F.lit(float(default)))


def int_param(params: Column, key: str, default: int) -> Column:
    text = strip(F.try_element_at(params, F.lit(key)))
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.lit(default).cast("bigint"))


def bool_param(params: Column, key: str, default: bool) -> Column:
    """A key that is present with a null value is false, a missing key is the default."""
    word = F.lower(strip(F.try_element_at(params, F.lit(key))))
    present = F.coalesce(F.map_contains_key(params, F.lit(key)), F.lit(False))
    return F.when(present, F.coalesce(word.isin(*TRUE_WORDS), F.lit(False))).otherwise(F.lit(default))


def text_param(params: Column, key: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(default))
