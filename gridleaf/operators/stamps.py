"""Stamping plans: what is written where on which page, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import anchor_center, rotated_extent, tile_centers
from ..functions.pageranges import page_ranges, page_selected
from ..functions.text import display_width, expand_template, hex_color, is_blank, needs_cjk

# --- fixed values ---------------------------------------------------------
LINE_FACTOR = 1.2
NARROW = 0.6  # width of a Latin character in font sizes; a wide one is 1.0
MIN_FONT = 4.0
OPACITY, MARGIN, FONT_RATIO = (0.02, 1.0), (0.0, 0.3), (0.01, 0.5)
# --------------------------------------------------------------------------


def clamp(value, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def text_width(text: Column, size: Column) -> Column:
    """Estimate from character classes; a real font measures a little differently."""
    wide = display_width(text) - F.length(text)
    return (wide * 1.0 + (F.length(text) - wide) * NARROW) * size


def placements(page_w: Column, page_h: Column, item_w: Column, item_h: Column, position: str = "bottom-right",
               margin: float = 0.04, x_ratio: float = 0.5, y_ratio: float = 0.5, gap: float = 0.35, angle: float = 0.0) -> Column:
    """Centres of an item on a page as an array: one anchor, or a staggered grid for ``tile``."""
    extent = rotated_extent(item_w, item_h, F.lit(float(angle)))
    if position == "tile":
        return tile_centers(page_w, page_h, extent, F.lit(float(gap)))
    return F.array(
        anchor_center(page_w, page_h, extent, F.lit(position), F.lit(float(margin)), F.lit(float(x_ratio)), F.lit(float(y_ratio)))
    )


def stamp_plan(pages: DataFrame, template: str, values: Column, spec: Column, position: str = "center", angle: float = -35.0,
               opacity: float = 0.35, color: str = "#FFFFFF", font_ratio: float = 0.07, margin: float = 0.05, gap: float = 0.6,
               x_ratio: float = 0.5, y_ratio: float = 0.5) -> DataFrame:
    """``doc_id, page_no, text, font, font_size, cx, cy, angle, opacity, r, g, b``; blank texts give an error row."""
    # as a generator's output the list is parsed once a page, however often the test names it
    listed = pages.withColumn("__r", F.explode(F.array(page_ranges(spec, F.col("page_count")))))
    chosen = listed.where(page_selected(F.col("page_no"), F.col("__r")))
    size = F.greatest(F.lit(MIN_FONT), F.least("width", "height") * clamp(F.lit(font_ratio), *FONT_RATIO))
    told = chosen.select(
        "doc_id", "page_no", "width", "height", expand_template(F.lit(template), values).alias("text"), size.alias("font_size")
    )
    spots = placements(
        F.col("width"), F.col("height"), text_width(F.col("text"), F.col("font_size")), F.col("font_size") * LINE_FACTOR,
        position, min(max(margin, MARGIN[0]), MARGIN[1]), x_ratio, y_ratio, gap, angle,
    )
    ink = hex_color(F.lit(color))
    good = ~is_blank(F.col("text"))
    return told.select("*", F.explode_outer(F.when(good, spots)).alias("p")).select(
        "doc_id", "page_no", "text", F.when(needs_cjk(F.col("text")), "cjk").otherwise("latin").alias("font"), "font_size",
        F.col("p.cx").alias("cx"), F.col("p.cy").alias("cy"), F.lit(float(angle)).alias("angle"),
        clamp(F.lit(opacity), *OPACITY).alias("opacity"), ink["r"].alias("r"), ink["g"].alias("g"), ink["b"].alias("b"),
        F.when(~good, "blank text").alias("error"),
    )
