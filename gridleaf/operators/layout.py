"""Layout operators: boxes, line height, tiles, de-duplication and reading order.

A block is a row ``image_id, block_id, text, x0, y0, x1, y1, confidence``; ``block_id`` is unique
in an image and gives the input order. Greedy steps run zone by zone in linear folds (``folds``): an image
is cut wherever no box reaches across.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.geometry import (
    MAX_TILES, READABLE_LINE, TILE_OVERLAP, max_tile_side, model_scale, sanity_line_height,
)
from ..functions.text import LINE_BREAK, compact, is_blank, needs_cjk
from .folds import kept_of_images
from .images import by_group, numbers
from .scan import CHUNK, null_safe_join

# --- fixed values ---------------------------------------------------------
ROW_TOLERANCE = 0.65
MIN_TOLERANCE = 4.0
SAME_IOU = 0.3
NEAR_RATIO, NEAR_MIN = 0.75, 6
CROP_NOTE = 0.85
# --------------------------------------------------------------------------

PART_LINES = 10_000
BOX = ["x0", "y0", "x1", "y1"]


def polygon_to_box(polygons: DataFrame) -> DataFrame:
    """``points array<struct<x,y>>, text, score, scale`` to blocks; unusable rows are left out.

    The coordinates are put in order once (nulls first, so the first one tells of a missing point) and each edge is read from
    there; the box is made once, and the row goes where there is none.
    """

    def ends(q: Column) -> Column:
        xs, ys = q["xs"], q["ys"]
        edges = {"x0": F.get(xs, F.lit(0)), "y0": F.get(ys, F.lit(0)), "x1": F.array_max(xs), "y1": F.array_max(ys)}
        usable = edges["x0"].isNotNull() & edges["y0"].isNotNull()
        return F.when(usable, F.struct(*[F.rint(v * F.col("scale")).cast("int").alias(c) for c, v in edges.items()]))

    points = F.col("points")
    sides = F.transform(F.array(points), lambda p: F.struct(F.sort_array(p["x"]).alias("xs"), F.sort_array(p["y"]).alias("ys")))
    wide = F.filter(F.transform(sides, ends), lambda e: (e["x1"] > e["x0"]) & (e["y1"] > e["y0"]))
    boxed = polygons.where(~is_blank(F.col("text"))).select(
        "image_id", "block_id", "text", F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(1.0)).alias("confidence"), F.inline(wide)
    )
    return boxed.select("image_id", "block_id", "text", *BOX, "confidence")


def lines_to_blocks(regions: DataFrame) -> DataFrame:
    """Spread the non-blank lines of ``text`` evenly over ``x0,y0,x1,y1``."""
    lines = F.filter(F.split("text", LINE_BREAK, -1), lambda line: ~is_blank(line))
    cut = regions.withColumn("__lines", lines).withColumn(
        "__h", F.greatest(F.lit(1), F.floor((F.col("y1") - F.col("y0")) / F.nullif(F.size("__lines"), F.lit(0))).cast("int"))
    )
    top = (F.col("y0") + F.col("__i") * F.col("__h")).cast("int")
    return cut.select("image_id", "x0", "y0", "x1", "__h", F.posexplode("__lines").alias("__i", "text")).select(
        "image_id", F.col("__i").cast("bigint").alias("block_id"), "text", "x0",
        top.alias("y0"), "x1", (top + F.col("__h")).alias("y1"), F.lit(1.0).alias("confidence"),
    )


def _height() -> Column:
    return F.greatest(F.lit(1), F.col("y1") - F.col("y0"))


def estimate_line_height(blocks: DataFrame) -> DataFrame:
    """``image_id, line_height``: the upper median, or the low tenth when the spread is wide.

    Exact quantiles from a count per distinct height.
    """
    counts = blocks.groupBy("image_id", _height().alias("h")).agg(
        F.sum((~is_blank(F.col("text"))).cast("int")).alias("n")
    )
    image = W.partitionBy("image_id")
    upto = F.sum("n").over(image.orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    counted = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(image))

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("h")))

    median = at(F.floor(F.col("total") / 2))
    low = at(F.floor(F.col("total") * F.lit(0.10)))
    picked = counted.groupBy("image_id").agg(median.alias("m"), low.alias("l"))
    value = F.when(F.col("m") > F.col("l") * 2, F.col("l")).otherwise(F.col("m"))
    return picked.select("image_id", F.coalesce(value.cast("double"), F.lit(0.0)).alias("line_height"))


def small_text_warning(images: DataFrame) -> DataFrame:
    """Adds ``warnings``: tiled, text too small after scaling, wide margins cropped."""
    scaled = F.col("line_height") * model_scale(F.col("width"), F.col("height"))
    tiled = F.when(F.col("tiles") > 1, F.concat(F.lit("small text: split in "), F.col("tiles").cast("string"), F.lit(" tiles")))
    small = F.when((scaled > 0) & (scaled < READABLE_LINE), F.lit("text too small to read safely"))
    cropped = F.when(F.col("kept") <= CROP_NOTE, F.lit("blank margins cropped"))
    return images.withColumn("warnings", F.array_compact(F.array(tiled, small, cropped)))


def tile_grid(width: Column, height: Column, line: Column, mode: Column, layout: Column) -> Column:
    """``struct(cols, rows)`` of the tiling of one picture."""
    line = sanity_line_height(line, height)
    side = max_tile_side(line)
    forced = mode == "always"
    half = F.greatest(F.lit(64), F.floor(F.least(width, height) / 2).cast("int"))
    limit = F.when(forced, F.least(side, half)).otherwise(side)
    whole = (mode == "off") | (
        ~forced & ((model_scale(width, height) >= 1.0) | (side >= F.greatest(width, height)))
    )
    cols = F.when(layout == "rows", 1).otherwise(F.greatest(F.lit(1), F.ceil(width / limit).cast("int")))
    rows = F.greatest(F.lit(1), F.ceil(height / limit).cast("int"))
    # Too many tiles: the longer side gives way first, so the cap has a closed form.
    over = cols.cast("bigint") * rows > MAX_TILES
    edge = int(MAX_TILES**0.5)
    fit_cols = F.when(cols <= edge, cols).otherwise(F.greatest(F.lit(edge), F.floor(F.lit(MAX_TILES) / F.least(rows, F.lit(edge)))))
    fit_rows = F.when(rows <= edge, rows).otherwise(F.greatest(F.lit(edge), F.floor(F.lit(MAX_TILES) / F.least(cols, F.lit(edge)))))
    return F.struct(
        F.when(whole, 1).when(over, F.least(cols, fit_cols.cast("int"))).otherwise(cols).cast("int").alias("cols"),
        F.when(whole, 1).when(over, F.least(rows, fit_rows.cast("int"))).otherwise(rows).cast("int").alias("rows"),
    )


def plan_tiles(images: DataFrame, mode="auto", overlap: float = TILE_OVERLAP, layout="grid") -> DataFrame:
    """One row per tile: the crop and its core; cores partition the picture. Bad sizes give an error row."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    layout = F.lit(layout) if isinstance(layout, str) else layout
    good = (F.col("width") > 0) & (F.col("height") > 0)
    grid = F.when(good, tile_grid(F.col("width"), F.col("height"), F.col("line_height"), mode, layout))
    sized = images.select("image_id", "width", "height", grid.alias("g")).select(
        "*",
        (F.col("width") / F.col("g.cols")).alias("cw"),
        (F.col("height") / F.col("g.rows")).alias("ch"),
    )
    tiles = sized.select(
        "*", F.explode_outer(F.when(F.col("g").isNotNull(), F.sequence(F.lit(0), F.col("g.cols") * F.col("g.rows") - 1))).alias("tile_id")
    )
    col = F.col("tile_id") % F.col("g.cols")
    row = F.floor(F.col("tile_id") / F.col("g.cols")).cast("int")

    def core(i: Column, size: str, last: Column, full: str) -> tuple[Column, Column]:
        start = F.bround(i * F.col(size)).cast("int")
        return start, F.when(i == last - 1, F.col(full)).otherwise(F.bround((i + 1) * F.col(size)).cast("int"))

    cx0, cx1 = core(col, "cw", F.col("g.cols"), "width")
    cy0, cy1 = core(row, "ch", F.col("g.rows"), "height")
    pad_x = F.floor(F.col("cw") * overlap).cast("int")
    pad_y = F.floor(F.col("ch") * overlap).cast("int")
    x0, y0 = F.greatest(F.lit(0), cx0 - pad_x), F.greatest(F.lit(0), cy0 - pad_y)
    x1, y1 = F.least(F.col("width"), cx1 + pad_x), F.least(F.col("height"), cy1 + pad_y)
    return tiles.select(
        "image_id", "tile_id", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"),
        F.struct(cx0.alias("x0"), cy0.alias("y0"), cx1.alias("x1"), cy1.alias("y1")).alias("core"),
        F.when(F.col("g").isNull(), F.lit("bad picture size")).alias("error"),
    )


def tile_to_global(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile coordinates to picture coordinates, by tile."""
    offsets = tiles.where(F.col("error").isNull()).select(
        "image_id", "tile_id", F.col("x").alias("__dx"), F.col("y").alias("__dy")
    )
    joined = null_safe_join(blocks, offsets, ["image_id", "tile_id"])
    for edge in BOX:
        joined = joined.withColumn(edge, F.col(edge) + F.col("__dx" if edge[0] == "x" else "__dy"))
    return joined.drop("__dx", "__dy")


def shift_origin(blocks: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Back from a cropped picture to the full one."""
    moves = {"x0": dx, "x1": dx, "y0": dy, "y1": dy}
    return blocks.withColumns({c: F.col(c) + by for c, by in moves.items()})


def tile_owner(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Adds ``owner``: the tile whose core holds the centre, else the tile with the nearest centre.

    A picture has at most 64 tiles, so its tiles travel as one array on an equi join.
    """
    shape = F.struct("tile_id", "x", "y", "width", "height", "core")
    packed = tiles.where(F.col("error").isNull()).groupBy("image_id").agg(F.array_sort(F.collect_list(shape)).alias("__tiles"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2

    def holds(t: Column) -> Column:
        c = t["core"]
        return (c["x0"] <= cx) & (cx < c["x1"]) & (c["y0"] <= cy) & (cy < c["y1"])

    def distance(t: Column) -> Column:
        dx, dy = cx - (t["x"] + t["width"] / 2), cy - (t["y"] + t["height"] / 2)
        return F.struct((dx * dx + dy * dy).alias("d"), t["tile_id"].alias("tile_id"))

    inside = F.filter("__tiles", holds)
    among = F.when(F.size(inside) > 0, inside).otherwise(F.col("__tiles"))
    owner = F.array_min(F.transform(among, distance))["tile_id"]
    return null_safe_join(blocks, packed, ["image_id"], "left").withColumn("owner", owner).drop("__tiles")


def dedupe_overlap(blocks: DataFrame) -> DataFrame:
    """One block per cluster of overlapping readings of the same text.

    Greedy from the most confident block on: a block joins the first cluster whose first member has
    a compatible text at the same place; the longest text of a cluster stays. Copies (same text, same
    box) always share a cluster. The boxes of an image meet on one exchange and one sort by image; a zone ends where no box
    reaches in y or x. Zones of one or two boxes are decided together, and inside a larger one candidates come from a uniform
    grid, so dense images cost what they hold.
    """
    names = ["image_id", "block_id", "text", *BOX, "confidence"]
    rows = blocks.where(~is_blank(F.col("text"))).select(*names, compact(F.col("text")).alias("key"))
    schema = StructType([StructField(c, blocks.schema[c].dataType) for c in names])

    def stay(batch: pa.RecordBatch, starts: np.ndarray) -> list[pa.Array]:
        at = pa.array(kept_of_images(batch, starts, SAME_IOU, NEAR_RATIO, NEAR_MIN))
        return [batch.column(c).take(at) for c in names]

    return by_group(rows, ["image_id"], [], schema, stay)


def _lines(cy: np.ndarray, tol: float) -> np.ndarray:
    """Lines (from 0) of ascending centres: a centre joins the open line unless it lies more than ``tol`` below the line's mean.

    Centres ascend, so a line whose mean has fallen behind by the tolerance never takes another: one line is open at a time.
    """
    values, counts = np.unique(cy, return_counts=True)
    out, line, total, n = [], -1, 0.0, 0
    for v, k in zip(values.tolist(), counts.tolist()):
        if line < 0 or v - total / n > tol:
            line, total, n = line + 1, 0.0, 0
        total, n = total + v * k, n + k
        out.append(line)
    return np.repeat(out, counts)


def _read(batch: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``line`` and ``pos`` of the blocks of many images."""
    n = batch.num_rows
    sizes = np.diff(np.append(starts, n))
    image = np.repeat(np.arange(len(starts)), sizes)
    (x0, nx0), (y0, ny0), (x1, nx1), (y1, ny1), (block, nb) = (numbers(batch, c) for c in (*BOX, "block_id"))
    # Centres are kept doubled (whole numbers), hence twice the tolerance.
    no_x, no_y = nx0 | nx1, ny0 | ny1
    cy, cx, height = np.where(no_y, 0, y0 + y1), np.where(no_x, 0, x0 + x1), np.maximum(1, np.where(no_y, 1, y1 - y0))
    chunk = np.where(nb, -1, block // CHUNK)
    median = height[np.lexsort((height, image))][starts + sizes // 2]
    tol = (2 * np.maximum(MIN_TOLERANCE, median * ROW_TOLERANCE))[image]
    # Boxes without a y-centre come first, each place a line of its own.
    order = np.lexsort((np.where(no_y, chunk, 0), np.where(no_y, cx, 0), no_y & ~no_x, cy, ~no_y, image))
    i, c, none = image[order], cy[order], no_y[order]
    new = np.append(True, i[1:] != i[:-1])
    opens = new.copy()
    opens[1:] |= ~none[1:] & (none[:-1] | (c[1:] - c[:-1] > tol[order][1:]))
    spot = [a[order] for a in (cx, no_x, chunk, nb)]
    opens[1:] |= none[1:] & np.logical_or.reduce([a[1:] != a[:-1] for a in spot])
    begin = np.flatnonzero(opens)
    ends = np.append(begin[1:], n) - 1
    inside = np.zeros(n, np.int64)
    lines = np.ones(len(begin), np.int64)
    # A zone no taller than the tolerance is one line: a mean never leaves the span of its members.
    for k in np.flatnonzero(~none[begin] & (c[ends] - c[begin] > tol[order][begin])).tolist():
        part = slice(begin[k], ends[k] + 1)
        inside[part] = _lines(c[part], tol[order[begin[k]]])
        lines[k] = inside[ends[k]] + 1
    zone = np.cumsum(opens) - 1
    before = np.cumsum(lines) - lines
    line = np.empty(n, np.int64)
    line[order] = before[zone] - before[zone[new]][i] + inside
    order = np.lexsort((block, ~nb, cy, cx, ~no_x, line, image))
    pos = np.empty(n, np.int64)
    pos[order] = np.arange(n) - np.repeat(starts, sizes)
    return line, pos


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``line`` and ``pos`` (both from 0): lines by running mean of y-centres, then x, y and input order.

    The boxes of an image meet on one exchange and one sort by image; blocks with one y-centre always fall on one line. Boxes without a
    y-centre come first.
    """
    schema = StructType([*blocks.schema.fields, StructField("line", LongType()), StructField("pos", LongType())])
    return by_group(blocks, ["image_id"], [], schema, lambda batch, starts: [*batch.columns, *map(pa.array, _read(batch, starts))])


def page_text(ordered: DataFrame, key: str = "image_id", part_lines: int = PART_LINES) -> DataFrame:
    """``key, part, text``: non-blank texts in order, joined by line ends.

    An ordinary page is one part. A page beyond ``part_lines`` goes on in further parts, so no page
    is gathered whole in one task and no text is lost. Lines are sorted by part and joined in the batch; no list of them is built.
    """
    rows = ordered.where(~is_blank(F.col("text"))).select(key, F.floor(F.col("pos") / part_lines).alias("part"), "pos", "text")
    schema = StructType([ordered.schema[key], StructField("part", LongType()), StructField("text", StringType())])

    def join(batch: pa.RecordBatch, starts: np.ndarray) -> list[pa.Array]:
        texts = batch.column("text").cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), texts)
        first = pa.array(starts)
        return [batch.column(key).take(first), batch.column("part").take(first), pc.binary_join(lists, "\n")]

    return by_group(rows, [key, "part"], ["pos", "text"], schema, join)


def _mean_confidence() -> Column:
    """Mean over an exact decimal sum, so the order of the rows cannot change the last digit."""
    exact = F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double")
    return F.coalesce(exact / F.nullif(F.count("confidence"), F.lit(0)), F.lit(0.0))


def average_confidence(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("image_id").agg(_mean_confidence().alias("avg_confidence"))


def text_layer_geometry(blocks: DataFrame, dpi: int = 200) -> DataFrame:
    """Where an invisible text layer would be written, in points."""
    scale = F.lit(72.0 / dpi)
    tall = (F.col("y1") - F.col("y0")) * scale
    return blocks.where(
        ~is_blank(F.col("text")) & (F.col("x1") - F.col("x0") > 2) & (F.col("y1") - F.col("y0") > 2)
    ).select(
        "image_id", "block_id", "text",
        F.greatest(F.lit(3.0), tall * 0.8).alias("font_size"),
        F.when(needs_cjk(F.col("text")), "cjk").otherwise("latin").alias("font"),
        (F.col("x0") * scale).alias("base_x"), (F.col("y1") * scale - tall * 0.18).alias("base_y"),
    )


def ocr_report(images: DataFrame, ordered: DataFrame, preview_chars: int = 4000) -> DataFrame:
    """One record per image with its whole text and, beside it, a preview of ``preview_chars``."""
    facts = ordered.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.round(_mean_confidence(), 3).alias("avg_confidence")
    )
    texts = page_text(ordered)
    sizes = texts.groupBy("image_id").agg(
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n").alias("text"),
    )
    joined = null_safe_join(null_safe_join(images, facts, ["image_id"], "left"), sizes, ["image_id"], "left")
    zero = F.lit(0).cast("bigint")
    full = joined.select(
        *images.columns,
        F.coalesce("line_count", zero).alias("line_count"),
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        F.coalesce("chars", zero).alias("chars"),
        F.coalesce("text", F.lit("")).alias("text"), F.substring(F.coalesce("text", F.lit("")), 1, preview_chars).alias("preview"),
    ).withColumn("truncated", F.col("chars") > preview_chars)
    return full.withColumn("report", F.to_json(F.struct(*full.columns)))
