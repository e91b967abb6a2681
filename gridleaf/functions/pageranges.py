"""Page selections as short sorted lists of intervals, so a page is tested without a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

RANGES = "array<struct<lo:bigint,hi:bigint>>"
FAR = 2**62  # beyond any page number
_INT = r"^\s*[+-]?\d+\s*$"


def _whole(text: Column, blank: Column) -> Column:
    """A whole number, however long; ``blank`` for the empty text, null for anything else."""
    bare = F.trim(text)
    far = F.when(bare.startswith("-"), -FAR).otherwise(FAR)
    number = F.when(text.rlike(_INT), F.coalesce(bare.try_cast("bigint"), far))
    return F.when(F.length(bare) == 0, blank.cast("bigint")).otherwise(number)


def _clip(pieces: Column, total: Column) -> Column:
    """Comma pieces as ``struct(piece, lo, hi)`` clipped to 1..total; ``lo`` is null when unreadable or empty.

    One small step per ``transform``: a lambda variable is a value, so no text is parsed twice.
    """
    total = total.cast("bigint")
    cut = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.instr(p, "-").alias("dash")))
    ends = F.transform(
        cut,
        lambda e: F.struct(
            e["p"].alias("p"), (e["dash"] > 0).alias("span"),
            _whole(F.when(e["dash"] > 0, F.substring(e["p"], F.lit(1), e["dash"] - 1)).otherwise(e["p"]), F.lit(1)).alias("lo"),
            _whole(F.when(e["dash"] > 0, F.substring(e["p"], e["dash"] + 1, F.length(e["p"]))).otherwise(e["p"]), total).alias("hi"),
        ),
    )
    # greatest and least pass over nulls, and an unreadable end must stay one.
    clipped = F.transform(
        ends,
        lambda e: F.struct(
            e["p"].alias("p"),
            F.when(e["span"] & (e["lo"] < 1), 1).otherwise(e["lo"]).alias("lo"),
            F.when(e["span"] & (e["hi"] > total), total).otherwise(e["hi"]).alias("hi"),
        ),
    )
    return F.transform(
        clipped,
        lambda e: F.struct(
            e["p"].alias("p"),
            F.when((e["lo"] >= 1) & (e["hi"] <= total) & (e["lo"] <= e["hi"]), e["lo"]).alias("lo"),
            e["hi"].alias("hi"),
        ),
    )


def _pieces(spec: Column) -> Column:
    return F.filter(
        F.transform(F.split(F.replace(spec, F.lit("，"), F.lit(",")), ","), strip), lambda p: F.length(p) > 0
    )


def _everything(spec: Column) -> Column:
    return spec.isin("", "all", "*")


def piece_ranges(spec: Column, total: Column) -> Column:
    """One ``struct(no, label, lo, hi)`` per valid comma piece, in the order written."""
    total = total.cast("bigint")

    words = F.transform(_pieces(F.coalesce(spec, F.lit(""))), F.lower)
    # A whole-document word is the span from the first page on.
    plain = F.transform(words, lambda w: F.when(_everything(w), "1-").otherwise(w))
    raw = _pieces(F.coalesce(spec, F.lit("")))
    both = F.zip_with(raw, _clip(plain, total), lambda label, r: F.struct(F.replace(label, F.lit("-"), F.lit("_")).alias("label"), r["lo"].alias("lo"), r["hi"].alias("hi")))
    kept = F.filter(both, lambda p: p["lo"].isNotNull())
    return F.transform(
        kept,
        lambda p, i: F.struct((i + 1).alias("no"), p["label"].alias("label"), p["lo"].alias("lo"), p["hi"].alias("hi")),
    )


def page_ranges(spec: Column, total: Column) -> Column:
    """The selected pages as sorted, disjoint, non-adjacent intervals; empty when nothing matches."""
    total = total.cast("bigint")
    text = F.lower(strip(F.coalesce(spec, F.lit("all"))))
    whole = F.array(F.struct(F.lit(1).cast("bigint").alias("lo"), total.alias("hi")))
    valid = F.filter(_clip(_pieces(text), total), lambda p: p["lo"].isNotNull())
    found = F.array_sort(F.transform(valid, lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"))))

    def join_up(acc: Column, rng: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], rng["hi"]).alias("hi"))
        touching = (F.size(acc) > 0) & (rng["lo"] <= last["hi"] + 1)
        return F.when(
            touching, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
        ).otherwise(F.concat(acc, F.array(rng)))

    merged = F.aggregate(found, F.array().cast(RANGES), join_up)
    # One number or one span, the usual list, stays in generated code.
    single = text.rlike(r"^(\d{1,18}|\d{0,18}-\d{0,18})$")
    left = F.regexp_extract(text, r"^(\d*)", 1).try_cast("bigint")
    right = F.regexp_extract(text, r"(\d*)$", 1).try_cast("bigint")
    span = F.contains(text, F.lit("-"))
    low = F.when(span, F.greatest(F.lit(1), left)).otherwise(left)
    high = F.when(span, F.least(total, right)).otherwise(right)
    one = F.when(
        (low >= 1) & (low <= high) & (high <= total), F.array(F.struct(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi")))
    ).otherwise(F.array().cast(RANGES))
    return (
        F.when(F.coalesce(total, F.lit(0)) <= 0, F.array().cast(RANGES))
        .when(_everything(text), whole.cast(RANGES))
        .when(single, one.cast(RANGES))
        .otherwise(merged)
    )


def page_selected(page: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (page >= r["lo"]) & (page <= r["hi"]))


def selected_rank(page: Column, ranges: Column) -> Column:
    """Position of a page among the selected ones, in closed form: no window over the pages."""
    before = F.filter(ranges, lambda r: r["lo"] <= page)
    return F.aggregate(
        before, F.lit(0).cast("bigint"), lambda acc, r: acc + F.least(r["hi"], page.cast("bigint")) - r["lo"] + 1
    )


def selected_count(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda acc, r: acc + r["hi"] - r["lo"] + 1)


def parse_page_range(spec: Column, total: Column) -> Column:
    """The selected page numbers as an array (for short documents; joins use the intervals)."""
    return F.flatten(F.transform(page_ranges(spec, total), lambda r: F.sequence(r["lo"], r["hi"])))
