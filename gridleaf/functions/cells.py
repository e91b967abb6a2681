"""Typing of cell texts: the number, the kept text and the display format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, SPACE, SPACE_CHARS, nfkc, strip

# --- fixed values ---------------------------------------------------------
CURRENCY = ("¥", "￥", "$", "€", "£")  # first one found wins
THOUSANDS = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
WHOLE = r"^[+-]?\d+$"
POINTED = r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"
ANY_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FLOAT_WORD = r"^[+-]?(?i:inf|infinity|nan)$"
GROUPED = "#,##0"
# Numbers written in a common way, within the digits a double and a bigint keep; texts that are no number whatever their marks.
_COMMON = r"-?(?:\d{1,3}(?:,\d{3}){1,4}|\d{1,15})(?:\.\d{1,15})?"
COMMON = rf"\A(?!0\d)(?:[{''.join(CURRENCY)}]?{_COMMON}|\({_COMMON}\))%?\z"
NEVER = rf"[^0-9+\-.eE,%(){''.join(CURRENCY)}{SPACE[1:-1]}]|\A0[0-9]|\A[^0-9]*\z"
YES, NO = ("true", "yes", "on"), ("false", "no", "off")
# --------------------------------------------------------------------------


def _leading_zero(text: Column) -> Column:
    return text.rlike("^0" + DIGIT)


def _number(text: Column) -> Column:
    """Whole or pointed decimal notation as double, else null."""
    return F.when(text.rlike(f"{WHOLE}|{POINTED}"), text.try_cast("double"))


def _whole(text: Column) -> Column:
    """Whole notation of up to 38 digits, exactly."""
    return F.when(text.rlike(WHOLE), text.try_cast("decimal(38,0)"))


def _trimmed(text: Column) -> Column:
    """``strip`` of a text that can be named often; one that begins and ends with a visible ASCII character is left alone."""
    last = F.substring(text, -1, 1)
    return F.when((text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f"), text).otherwise(strip(text))


def _parts(raw: Column) -> Column:
    """``struct(num, text, fmt, whole)`` of any text, step by step; each step is worked out once."""

    def amount(text: Column) -> Column:
        symbol = F.lit(None).cast("string")
        for sign in reversed(CURRENCY):
            symbol = F.when(F.contains(text, F.lit(sign)), F.lit(sign)).otherwise(symbol)
        return F.struct(text.alias("text"), symbol.alias("symbol"))

    def inner(p: Column) -> Column:
        text = F.when(p["symbol"].isNull(), p["text"]).otherwise(strip(F.replace(p["text"], p["symbol"], F.lit(""))))
        return F.struct(p.alias("of"), text.alias("amount"), text.endswith("%").alias("percent"))

    def body(p: Column) -> Column:
        text = F.when(p["percent"], strip(F.regexp_replace(p["amount"], "%$", ""))).otherwise(p["amount"])
        return F.struct(p.alias("of"), text.alias("inner"), text.rlike(r"(?s)^\(.*\)$").alias("bracketed"))

    def plain(p: Column) -> Column:
        text = F.when(p["bracketed"], strip(F.regexp_replace(p["inner"], r"(?s)^\((.*)\)$", "$1"))).otherwise(p["inner"])
        return F.struct(p.alias("of"), text.alias("body"))

    def typed(p: Column) -> Column:
        text, plain = p["of"]["of"]["of"]["text"], F.replace(p["body"], F.lit(","), F.lit(""))
        keep = text.rlike("^0" + DIGIT) | ~p["body"].rlike(f"^[^,]*$|{THOUSANDS}")
        percent, bracketed = p["of"]["of"]["percent"], p["of"]["bracketed"]
        value = F.when(~keep, _number(plain))
        exact = F.when(~keep & ~percent, _whole(plain))
        return F.struct(p.alias("of"), plain.alias("plain"), value.alias("value"), exact.alias("exact"), percent.alias("percent"), bracketed.alias("bracketed"))

    def cell(p: Column) -> Column:
        plain, percent, bracketed, symbol = p["plain"], p["percent"], p["bracketed"], p["of"]["of"]["of"]["of"]["symbol"]
        value = F.when(bracketed, 0 - F.abs(p["value"])).otherwise(p["value"]) / F.when(percent, 100).otherwise(1)
        exact = F.when(bracketed, 0 - F.abs(p["exact"])).otherwise(p["exact"]).cast("decimal(38,0)")
        lost = p["value"].isNotNull() & p["exact"].isNull() & plain.rlike(WHOLE) & ~percent
        zeros = F.regexp_replace(F.regexp_extract(plain, r"^[^.]*(\.[^.]+)", 1), r"[^.]", "0")
        fmt = F.concat(
            F.coalesce(F.concat(F.lit('"'), symbol, F.lit('"')), F.lit("")),
            F.when(F.contains(p["of"]["body"], F.lit(",")), GROUPED).otherwise("0"),
            zeros,
            F.when(percent, "%").otherwise(""),
            F.when(bracketed, F.concat(F.lit(";" + GROUPED), zeros)).otherwise(""),
        )
        return F.struct(
            value.alias("num"),
            F.when(p["value"].isNull() | lost, raw).alias("text"),
            F.when(p["value"].isNotNull(), fmt).alias("fmt"),
            exact.alias("whole"),
        )

    step = F.array(raw)
    for use in (_trimmed, amount, inner, body, plain, typed, cell):
        step = F.transform(step, use)
    return F.get(step, F.lit(0))


def parse_cell(raw: Column) -> Column:
    """``struct(num, text, fmt, whole)``: a number with the format that shows it as written, or the text.

    ``whole`` has all digits of a whole number, of which a double keeps about 16; one that no ``whole`` can hold keeps
    its text beside ``num``. A percentage has no ``whole``.

    Most texts are numbers written in a common way, or no numbers for a character that none can have; those are told by
    one pattern. Only the others go through all steps.
    """
    # A common number begins with a digit, a minus, a bracket or a currency sign; of these only the last lies before "%" or from ":" on.
    signed, bracketed, percent = (raw < "%") | (raw >= ":"), raw.startswith("("), raw.endswith("%")
    plain = F.when(signed, F.substring(raw, 2, 64)).when(bracketed, F.replace(F.replace(raw, F.lit("("), F.lit("")), F.lit(")"), F.lit(""))).otherwise(raw)
    plain = F.replace(plain, F.lit(","), F.lit(""))
    plain = F.when(percent, F.replace(plain, F.lit("%"), F.lit(""))).otherwise(plain)

    value = plain.try_cast("double")
    value = F.when(bracketed, 0 - F.abs(value)).otherwise(value) / F.when(percent, 100).otherwise(1)
    pointed = F.contains(raw, F.lit("."))
    whole = F.when(~pointed & ~percent, plain.try_cast("bigint"))
    whole = F.when(bracketed, 0 - F.abs(whole)).otherwise(whole).cast("decimal(38,0)")
    decimals = F.length(raw) - F.instr(raw, ".") - percent.cast("int") - bracketed.cast("int")
    zeros = F.when(pointed, F.rpad(F.lit("."), decimals + 1, F.lit("0"))).otherwise("")
    fmt = F.concat(
        F.when(signed, F.concat(F.lit('"'), F.substring(raw, 1, 1), F.lit('"'))).otherwise(""),
        F.when(F.contains(raw, F.lit(",")), GROUPED).otherwise("0"),
        zeros,
        F.when(percent, "%").otherwise(""),
        F.when(bracketed, F.concat(F.lit(";" + GROUPED), zeros)).otherwise(""),
    )
    none = {"num": "double", "text": "string", "fmt": "string", "whole": "decimal(38,0)"}
    common = {"num": value, "fmt": fmt, "whole": whole}

    def cell(known: dict[str, Column]) -> Column:
        return F.struct(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in none.items()])

    return F.when(raw.rlike(COMMON), cell(common)).when(raw.rlike(NEVER), cell({"text": raw})).otherwise(_parts(raw))


def coerce_simple(raw: Column) -> Column:
    """``struct(num, text, whole)``: drop commas, keep leading-zero ids, number (see ``parse_cell``) or text."""
    plain = F.replace(strip(raw), F.lit(","), F.lit(""))
    value = F.when(~_leading_zero(plain), _number(plain))
    exact = F.when(~_leading_zero(plain), _whole(plain))
    lost = value.isNotNull() & exact.isNull() & plain.rlike(WHOLE)
    return F.struct(value.alias("num"), F.when(value.isNull() | lost, raw).alias("text"), exact.alias("whole"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_param(raw: Column) -> Column:
    """``key=value`` to ``struct(key, kind, flag, whole, real, text, error)``.

    Key and value are cut and stripped once, and the kind is found once; each output refers to these.
    """

    def cut(pair: Column) -> Column:
        raw, at = pair["raw"], pair["at"]
        value = strip(F.substring(raw, at + 1, F.length(raw)))
        return F.struct(strip(F.when(at > 0, F.substring(raw, 1, at - 1))).alias("key"), value.alias("value"), F.lower(value).alias("word"), at.alias("at"))

    def told(p: Column) -> Column:
        value, word = p["value"], p["word"]
        error = F.when(p["at"] == 0, "no equals sign").when(F.length(p["key"]) == 0, "empty key")
        kind = (
            F.when(error.isNotNull(), None)
            .when(word.isin(*YES, *NO), "bool")
            .when(_leading_zero(value), "text")
            .when(value.rlike(WHOLE), "int")
            .when(value.rlike(ANY_FLOAT) | value.rlike(FLOAT_WORD), "float")
            .otherwise("text")
        )
        return F.struct(p["key"].alias("key"), value.alias("value"), word.alias("word"), error.alias("error"), kind.alias("kind"))

    def typed(p: Column) -> Column:
        value, kind = p["value"], p["kind"]
        return F.struct(
            F.when(p["error"].isNull(), p["key"]).alias("key"),
            kind.alias("kind"),
            F.when(kind == "bool", p["word"].isin(*YES)).alias("flag"),
            F.when(kind == "int", value.try_cast("decimal(38,0)")).alias("whole"),
            F.when(kind == "float", value.try_cast("double")).alias("real"),
            F.when(kind == "text", value).alias("text"),
            p["error"].alias("error"),
        )

    pair = F.struct(raw.alias("raw"), F.instr(raw, "=").alias("at"))
    return _once(_once(_once(pair, cut), told), typed)


def bare_text(text: Column) -> Column:
    """A text without what makes no other value: white space, commas, the sign of the yen."""
    return F.when(text.rlike("[^!-~]"), F.translate(text, SPACE_CHARS + ",¥￥", "")).otherwise(F.replace(text, F.lit(","), F.lit("")))


def any_number(text: Column) -> Column:
    """The number that a bare text writes, exponents and words for infinity included, else null."""
    return F.when(text.rlike(f"{ANY_FLOAT}|{FLOAT_WORD}"), text.try_cast("double"))


def _ten_digits(number: Column) -> Column:
    return F.format_string("%.9e", number)


def value_key(raw: Column, unicode_forms: bool = True) -> Column:
    """Identity of the value: numbers by their first ten digits, other text without spaces and case."""
    text = F.coalesce(raw, F.lit(""))
    text = bare_text(nfkc(text) if unicode_forms else text)
    number = any_number(text)
    return F.when(number.isNotNull(), F.concat(F.lit("num:"), _ten_digits(number))).otherwise(
        F.concat(F.lit("txt:"), F.lower(text))
    )


def same_value(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Whether two bare texts ``a``, ``b`` have one ``value_key``; ``x`` and ``y`` are their numbers, ``y`` asked for only beside an ``x``.

    Texts that are equal but for case are both numbers or both none. Digits are written out only for numbers that are close but not equal.
    """
    far = F.abs(x - y) > 1e-8 * F.greatest(F.abs(x), F.abs(y))
    numbers = F.when(y.isNull(), False).when((x == y) & (x != 0), True).when(far, False).otherwise(_ten_digits(x) == _ten_digits(y))
    return F.when(x.isNull(), (a == b) | (F.lower(a) == F.lower(b))).otherwise(numbers)


def format_key(raw: Column, unicode_forms: bool = True) -> Column:
    """Identity of the writing: only white space is evened out."""
    text = F.coalesce(raw, F.lit(""))
    text = nfkc(text) if unicode_forms else text
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def display_matches(source: Column, fmt: Column, unicode_forms: bool = True) -> Column:
    """Does a number format show thousands, decimals, currency and percent as the source writes them?"""
    text = F.coalesce(source, F.lit(""))
    text = nfkc(text) if unicode_forms else text
    fmt = F.coalesce(fmt, F.lit(""))
    # White space around the text only counts where it ends. A line break before a second point counts as a digit.
    digits = rf"^[^.]*\.({DIGIT}+(?={SPACE}*\z)|{DIGIT}+(?:\r\n|[\n\r\x85\u2028\u2029])?(?=\.))"
    wanted = F.when(F.contains(text, F.lit(".")), F.length(F.regexp_extract(text, digits, 1))).otherwise(0)
    shown = F.when(F.contains(fmt, F.lit(".")), F.length(F.regexp_extract(fmt, r"^[^.]*\.(0*)", 1))).otherwise(0)
    money = "[" + "".join(CURRENCY) + "]"

    def percent(of: Column) -> Column:
        return F.contains(of, F.lit("%")) & of.rlike(f"%{SPACE}*\\z")

    return (
        (F.contains(text, F.lit(",")) == F.contains(fmt, F.lit(GROUPED)))
        & (wanted == shown)
        & (percent(text) == percent(fmt))
        & (text.rlike(money) == fmt.rlike(money))
    )
