"""Table reconstruction: rows, columns, grids, headers, fragments and model tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.text import DIGIT, SPACE_CHARS, cell_key, display_width, is_blank, strip
from ..session import ship
from .answers import images_with_tables, model_cells
from .images import by_group, numbers, running_max, starts_of, whole_groups
from .scan import CHUNK, null_safe_join

# --- fixed values ---------------------------------------------------------
ROW_OVERLAP = 0.35
MIN_GAP = 6
COLUMN_OVERLAP = 0.15
HEADER_ROWS, HEADER_CHARS = 5, 12
SEAM_ROWS = 5
WIDTH_PAD, WIDTH_LOW, WIDTH_HIGH = 3, 8, 48
SHEET_CHARS = 28
SHEET_FORBIDDEN = r"[\[\]:*?/\\]"
# --------------------------------------------------------------------------

KEY = "image_id"
NOTHING = "nothing was recognised"


def first_rows(items: list[dict], tolerance: float) -> list[int]:
    """Rows (from 1) of a band's boxes, in their order, by the greedy rule in one pass.

    A row keeps only the members that can still decide: not those that end above the box at hand, nor those that another
    member outlasts without being taller. That is a handful, so a band costs its boxes times the rows open at a height.
    """
    open_rows: list[tuple[int, list[tuple[int, int]]]] = []  # (row, [(y1, height)])
    out, count, last = [], 0, None
    for box in items:
        y0, y1, key = box["y0"], box["y1"], (box["y0"], box["x0"], box["y1"])
        if key == last or y0 is None or y1 is None:
            count += key != last
            out.append(out[-1] if key == last else count)
            last = key
            continue
        last = key
        tall, chosen, alive = y1 - y0, None, []
        for entry in open_rows:
            row, members = entry
            members[:] = [m for m in members if m[0] > y0]
            if not members:
                continue
            alive.append(entry)
            if chosen is None and any((s := min(y1, m[0]) - y0) > 0 and s / max(1, min(tall, m[1])) >= tolerance for m in members):
                chosen = entry
        if chosen is None:
            count += 1
            chosen = (count, [])
            alive.append(chosen)
        row, members = chosen
        members[:] = [m for m in members if not (y1 >= m[0] and tall <= m[1])]
        if not any(m[0] >= y1 and m[1] <= tall for m in members):
            members.append((y1, tall))
        open_rows = alive
        out.append(row)
    return out


def rows_of_images(y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, null: np.ndarray, starts: np.ndarray, tolerance: float) -> np.ndarray:
    """Rows (from 0) of the boxes of many images, each in the order of (y0, x0, y1).

    No row crosses a height that no box crosses, so an image is cut into bands there. A band in which every box overlaps
    the first is one row; the others, and images with a missing edge (``null``), are folded.
    """
    n = len(y0)
    image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    opens = np.zeros(n, bool)
    opens[1:] = (y0[1:] >= running_max(y1, image)[:-1]) & (y0[1:] > y0[:-1])
    opens &= ~np.logical_or.reduceat(null.any(axis=0), starts)[image]  # one band
    opens[starts] = True
    begin = np.flatnonzero(opens)
    band = np.cumsum(opens) - 1
    first = begin[band]
    shared = np.minimum(y1, y1[first]) - np.maximum(y0, y0[first])
    shorter = np.maximum(1, np.minimum(y1 - y0, (y1 - y0)[first]))
    single = np.logical_and.reduceat((shared > 0) & (shared / shorter >= tolerance) & ~null.any(axis=0), begin)
    at, rows = np.ones(n, np.int64), np.ones(len(begin), np.int64)
    ends = np.append(begin[1:], n)
    for k in np.flatnonzero(~single).tolist():
        part = slice(begin[k], ends[k])
        edges = [np.where(gone[part], None, v[part].astype(object)).tolist() for v, gone in zip((y0, x0, y1), null)]
        at[part] = first_rows([dict(zip(("y0", "x0", "y1"), e)) for e in zip(*edges)], tolerance)
        rows[k] = at[part].max()
    before = np.cumsum(rows) - rows
    return before[band] - before[band[starts]][image] + at - 1


def _rows(batch: pa.RecordBatch, starts: np.ndarray, tolerance: float) -> np.ndarray:
    image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    edges, null = zip(*(numbers(batch, c) for c in ("y0", "x0", "y1")))
    null = np.array(null)
    keys = [k for v, gone in zip(edges[::-1], null[::-1]) for k in ((v, ~gone) if gone.any() else (v,))]
    order = np.lexsort((*keys, image))
    row = np.empty(batch.num_rows, np.int64)
    row[order] = rows_of_images(*(v[order] for v in edges), null[:, order], starts, tolerance)
    return row


def group_rows(blocks: DataFrame, tolerance: float = ROW_OVERLAP) -> DataFrame:
    """Adds ``row`` (from 0, top to bottom).

    Rows are greedy: by (y0, x0, y1), a box joins the first row with a member it overlaps; equal ones share a row. A box
    without a height is a row of its own. The boxes of an image meet on one exchange and one sort by image.
    """
    schema = StructType([*blocks.schema.fields, StructField("row", IntegerType())])
    return by_group(blocks, [KEY], [], schema, lambda batch, starts: [*batch.columns, pa.array(_rows(batch, starts, tolerance), pa.int32())])


def detect_columns(blocks: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """``image_id, col, x0, x1``: stretches of x separated by at least ``min_gap`` uncovered pixels.

    Spans are read from left to right; a task holds a batch and the last stretch, whatever an image's number of boxes.
    """
    ship(blocks.sparkSession)
    spans = blocks.where(F.col("x1") > F.col("x0")).select(KEY, "x0", "x1").repartition(KEY).sortWithinPartitions(KEY, "x0")
    schema = StructType([blocks.schema[KEY], StructField("col", IntegerType()), blocks.schema["x0"], blocks.schema["x1"]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, 0  # the stretch that is still open: a row of its own; and its number
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in (KEY, "x0", "x1")]
            if last is not None:
                columns = [pa.concat_arrays([a, b]) for a, b in zip(last, columns)]
            begin = starts_of(columns[0])
            image = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(columns[0]))))
            left, right = (c.to_numpy(zero_copy_only=False) for c in columns[1:])
            opens = np.zeros(len(left), bool)
            opens[1:] = left[1:] - running_max(right, image)[:-1] >= min_gap
            opens[begin] = True
            at = np.flatnonzero(opens)
            col = np.arange(len(at)) - np.searchsorted(at, begin)[image[at]] + np.where(image[at] == 0, number, 0)
            made = [columns[0].take(pa.array(at)), pa.array(col), pa.array(left[at]), pa.array(np.maximum.reduceat(right, at))]
            last, number = [made[k].slice(len(at) - 1) for k in (0, 2, 3)], int(col[-1])
            yield pa.RecordBatch.from_arrays([c.slice(0, len(at) - 1).cast(f.type) for c, f in zip(made, arrow)], schema=arrow)
        if last is not None:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([last[0], pa.array([number]), *last[1:]], arrow)], schema=arrow)

    return spans.mapInArrow(run, schema)


def column_spans(columns: DataFrame) -> DataFrame:
    """Columns of an image as one array, left to right: ``image_id, spans``."""
    packed = columns.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("col", "x0", "x1"))).alias("spans"))
    return packed


def _column_of(spans: Column) -> Column:
    """Column with the greatest overlap; below 15 % of the width the nearest centre. First wins ties."""
    width = F.greatest(F.lit(1), F.col("x1") - F.col("x0"))
    shared = F.transform(
        spans,
        lambda s, i: F.struct(
            F.greatest(F.lit(0), F.least(F.col("x1"), s["x1"]) - F.greatest(F.col("x0"), s["x0"])).alias("ov"),
            (-i).alias("i"),
        ),
    )
    best = F.array_max(shared)
    off = F.transform(
        spans, lambda s, i: F.struct(F.abs(s["x0"] + s["x1"] - F.col("x0") - F.col("x1")).alias("d"), i.alias("i"))
    )
    chosen = F.when(best["ov"] / width >= COLUMN_OVERLAP, -best["i"]).otherwise(F.array_min(off)["i"])
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 1, F.lit(0)).otherwise(chosen).cast("int")


def assign_column(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``col``; an image's columns travel as one array on an equi join."""
    joined = null_safe_join(blocks, column_spans(columns), [KEY], "left")
    return joined.withColumn("col", _column_of(F.col("spans"))).drop("spans")


def _nearest_column(x0: int | None, x1: int | None, spans: list[tuple[int, int]]) -> int:
    """``_column_of`` for one box without a width; an edge that is missing does not cut."""
    if len(spans) <= 1:
        return 0
    width = max(1, x1 - x0) if None not in (x0, x1) else 1
    shared = [max(0, (b if x1 is None else min(x1, b)) - (a if x0 is None else max(x0, a))) for a, b in spans]
    best = max(range(len(spans)), key=lambda i: (shared[i], -i))
    if shared[best] / width >= COLUMN_OVERLAP:
        return best
    return 0 if None in (x0, x1) else min(range(len(spans)), key=lambda i: (abs(spans[i][0] + spans[i][1] - x0 - x1), i))


def _stretches(batch: pa.RecordBatch, starts: np.ndarray, min_gap: int) -> np.ndarray:
    """The column of each box: the stretch of x in which a box with a width lies, the nearest column for one without."""
    n = batch.num_rows
    image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    (x0, no0), (x1, no1) = numbers(batch, "x0"), numbers(batch, "x1")
    wide = ~no0 & ~no1 & (x1 > x0)
    order = np.flatnonzero(wide)
    order = order[np.lexsort((x0[order], image[order]))]
    col = np.zeros(n, np.int64)
    if len(order):
        left, right, own = x0[order], x1[order], image[order]
        new = np.append(True, own[1:] != own[:-1])
        opens = np.zeros(len(order), bool)
        opens[1:] = left[1:] - running_max(right, own)[:-1] >= min_gap
        opens |= new
        stretch = np.cumsum(opens) - 1
        col[order] = stretch - stretch[new][np.cumsum(new) - 1]
    loose = np.flatnonzero(~wide)
    if len(loose):
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(order):
            begin = np.flatnonzero(opens)
            for i, a, b in zip(own[begin].tolist(), left[begin].tolist(), np.maximum.reduceat(right, begin).tolist()):
                spans.setdefault(i, []).append((a, b))
        for k in loose.tolist():
            col[k] = _nearest_column(None if no0[k] else x0[k], None if no1[k] else x1[k], spans.get(int(image[k]), []))
    return col


def place_blocks(blocks: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """Adds ``row`` and ``col`` on one exchange by image.

    A box with a width lies inside the stretch of x that it belongs to; only one without goes by the nearest column.
    """
    schema = StructType([*blocks.schema.fields, StructField("col", IntegerType()), StructField("row", IntegerType())])
    return by_group(
        blocks, [KEY], [], schema,
        lambda batch, starts: [*batch.columns, pa.array(_stretches(batch, starts, min_gap), pa.int32()), pa.array(_rows(batch, starts, ROW_OVERLAP), pa.int32())],
    )


def _ranks(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Dense rank (from 0) of a value in its group; groups ascend."""
    if not len(group):
        return group
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.append(True, g[1:] != g[:-1])
    rank = np.cumsum(np.append(True, (v[1:] != v[:-1]) | new[1:])) - 1
    out = np.empty(len(group), np.int64)
    out[order] = rank - rank[new][np.cumsum(new) - 1]
    return out


def _cells(batch: pa.RecordBatch, starts: np.ndarray, min_gap: int) -> list[pa.Array]:
    """Cells of many images: image, row, col, text and, where boxes tell of digits, whether the row is the header and whether one was met."""
    image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    row, col = _rows(batch, starts, ROW_OVERLAP), _stretches(batch, starts, min_gap)
    order = np.lexsort((col, row, image))
    i, r, c = image[order], row[order], col[order]
    begin = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])))
    sizes = np.diff(np.append(begin, len(order)))
    text = pc.fill_null(batch.column("text"), "").take(pa.array(order[begin]))
    several = np.flatnonzero(sizes > 1)
    if len(several):
        inside = order[np.repeat(begin[several] - np.cumsum(sizes[several]) + sizes[several], sizes[several]) + np.arange(sizes[several].sum())]
        named = [batch.column(n).take(pa.array(inside)).to_pylist() for n in ("x0", "y0", "block_id", "text")]
        joined, at = text.to_pylist(), 0
        for k, size in zip(several.tolist(), sizes[several].tolist()):
            parts = sorted(zip(*(n[at : at + size] for n in named)), key=lambda p: [(v is not None, v) if v is not None else (False,) for v in p])
            joined[k], at = " ".join(p[3] for p in parts if p[3] is not None), at + size
        text = pa.array(joined, text.type)
    text = pc.utf8_trim(text, SPACE_CHARS)
    long = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(long > 0)
    i, r, c = i[begin][kept], r[begin][kept], c[begin][kept]
    row, col = _ranks(i, r), _ranks(i, c)
    out = [batch.column(KEY).take(pa.array(starts[i])), pa.array(row, pa.int32()), pa.array(col, pa.int32()), text.take(pa.array(kept))]
    if "__digit" in batch.schema.names and len(i):
        digit = np.logical_or.reduceat(pc.fill_null(batch.column("__digit"), False).to_numpy(zero_copy_only=False)[order], begin)[kept]
        line = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (row[1:] != row[:-1])))
        fits = np.logical_and.reduceat(~digit & (long[kept] <= HEADER_CHARS), line) & (row[line] < HEADER_ROWS)
        header = np.full(len(starts), HEADER_ROWS, np.int64)
        np.minimum.at(header, i[line][fits], row[line][fits])
        met = header < HEADER_ROWS
        out += [pa.array(row == np.where(met, header, 0)[i]), pa.array(met[i])]
    elif "__digit" in batch.schema.names:
        out += [pa.array([], pa.bool_())] * 2
    return out


def _grid(blocks: DataFrame, min_gap: int, header: bool) -> DataFrame:
    """Cells of the grids, with ``is_header`` and ``met`` (see ``mark_header``) where they are asked for: all of it in one pass over the boxes of an image."""
    used = blocks.select(KEY, "block_id", "text", "x0", "y0", "x1", "y1", *([F.col("text").rlike(DIGIT).alias("__digit")] if header else []))
    flags = [StructField(c, BooleanType()) for c in ("is_header", "met")] if header else []
    schema = StructType([blocks.schema[KEY], StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("text", StringType()), *flags])
    return by_group(used, [KEY], [], schema, lambda batch, starts: _cells(batch, starts, min_gap))


def blocks_to_grid(blocks: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """``image_id, row, col, text``: non-blank cells after blank rows and columns are dropped.

    A missing (row, col) is the empty cell; ``dense_rows`` fills it in. The cells of one image are
    bounded by its size in pixels, whatever its number of boxes.
    """
    return _grid(blocks, min_gap, False)


def grid_with_header(blocks: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """``mark_header(blocks_to_grid(blocks), grid=True)`` in the pass that makes the grid, so the cells need no exchange."""
    return _grid(blocks, min_gap, True)


def trim_empty(cells: DataFrame, key: str = KEY) -> DataFrame:
    """Drop all-blank rows, then all-blank columns, and renumber; for tables of any length.

    Stretches of ``CHUNK`` rows are summed up (how many rows and which columns hold text); only these summaries meet by
    table, and each goes back to its stretch beside the cells, so there is no join.
    """
    names = cells.columns
    marked = cells.withColumns({"__solid": F.coalesce(~is_blank(F.col("text")), F.lit(False)), "__cell": F.floor(F.col("row") / CHUNK)})
    sums = marked.groupBy(key, "__cell").agg(
        F.size(F.collect_set(F.when(F.col("__solid"), F.col("row")))).alias("__rows"), F.collect_set(F.when(F.col("__solid"), F.col("col"))).alias("__some")
    )
    table = W.partitionBy(key)
    earlier = table.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        key, "__cell", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__some").over(table)))).alias("__cols"),
    )
    both = marked.unionByName(sums, allowMissingColumns=True).repartition(key, "__cell")
    line = W.partitionBy(key, "__cell", "row")
    both = both.withColumn("__live", F.col("__before").isNotNull() | F.max("__solid").over(line)).where("__live")
    stretch = W.partitionBy(key, "__cell").orderBy(F.col("__before").isNull(), "row")
    both = both.withColumns(
        {"__before": F.first("__before").over(stretch), "__cols": F.first("__cols").over(stretch), "__row": F.dense_rank().over(stretch), "__sum": F.col("__before").isNotNull()}
    )
    at = F.array_position("__cols", F.col("col"))
    kept = both.where(~F.col("__sum") & (at > 0))
    return kept.withColumns({"row": (F.col("__before") + F.col("__row") - 2).cast("int"), "col": (at - 1).cast("int")}).select(*names)


def dense_rows(cells: DataFrame, key: str = KEY) -> DataFrame:
    """Wide form, one row per table row: ``key, row, cells array<string>`` with empty cells filled in.

    The width of a table comes ahead of its cells on their one exchange, so a task holds a few rows whatever the table's length.
    """
    ship(cells.sparkSession)
    widths = cells.groupBy(key).agg((F.max("col") + 1).cast("bigint").alias("__w"))
    both = cells.select(key, "row", "col", "text").unionByName(widths, allowMissingColumns=True)
    placed = both.repartition(key).sortWithinPartitions(key, F.col("__w").isNull(), "row")
    schema = StructType([cells.schema[key], cells.schema["row"], StructField("cells", ArrayType(StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 0
        for batch, starts in whole_groups(batches, [key, "__w", "row"]):
            ahead = batch.column("__w").is_valid().to_numpy(zero_copy_only=False)
            w, _ = numbers(batch, "__w")
            told = np.maximum.accumulate(np.where(ahead, np.arange(len(w)), -1))
            w = np.where(told >= 0, w[told], width)
            width = int(w[-1])
            lines = starts[~ahead[starts]]
            if not len(lines):
                continue
            at = np.flatnonzero(~ahead)
            ends = np.cumsum(w[lines])
            col, missing = numbers(batch, "col")
            if missing[at].any():
                raise ValueError("a cell without a column")
            line = np.searchsorted(lines, at, "right") - 1
            seen = at[col[at] >= 0]
            spot = (ends - w[lines])[line[col[at] >= 0]] + col[seen]
            if len(np.unique(spot)) < len(spot):
                raise ValueError("two cells at one place of a table")
            source = np.full(int(ends[-1]), len(w), np.int64)
            source[spot] = seen
            texts = pa.concat_arrays([pc.fill_null(batch.column("text"), ""), pa.array([""], batch.column("text").type)])
            made = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), texts.take(pa.array(source)))
            first = pa.array(lines)
            made = [batch.column(key).take(first), batch.column("row").take(first), made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    return placed.mapInArrow(run, schema)


def guess_header_row(cells: DataFrame, key: str = KEY) -> DataFrame:
    """``key, header, met``: first of rows 0-4 with text, no digit and only short cells; else 0, and ``met`` is false.

    One row for a table already before the exchange.
    """
    solid = ~is_blank(F.col("text"))
    plain = ~F.col("text").rlike(DIGIT) & (F.length("text") <= HEADER_CHARS)
    marked = cells.select(key, "row", F.when(F.col("row") < HEADER_ROWS, F.when(solid, plain)).alias("__plain"))
    fits = [F.bool_and(F.when(F.col("row") == k, F.col("__plain"))).alias(f"__ok{k}") for k in range(HEADER_ROWS)]
    rows = marked.groupBy(key).agg(*fits)
    first = F.coalesce(*[F.when(F.col(f"__ok{k}"), F.lit(k)) for k in range(HEADER_ROWS)])
    return rows.select(key, F.coalesce(first, F.lit(0)).cast("int").alias("header"), first.isNotNull().alias("met"))


def mark_header(cells: DataFrame, key: str = KEY, mode: str = "auto", grid: bool = False) -> DataFrame:
    """Adds ``is_header`` (for showing: row 0 where no row looks like a header) and ``met``, whether one did. No row is lost.

    For a ``grid`` of an image (whose cells are bounded by its size) the header row is found by windows
    on the partitioning the grid already has. Any other table goes through a small aggregate and a join.
    """
    if mode != "auto":
        return cells.withColumns({"is_header": F.lit(False), "met": F.lit(False)})
    if grid:
        solid = ~is_blank(F.col("text"))
        plain = ~F.col("text").rlike(DIGIT) & (F.length("text") <= HEADER_CHARS)
        fits = F.coalesce(F.bool_and(F.when(solid, plain)).over(W.partitionBy(key, "row")), F.lit(False))
        first = F.min(F.when((F.col("row") < HEADER_ROWS) & F.col("__fits"), F.col("row"))).over(W.partitionBy(key))
        marked = cells.withColumn("__fits", fits).withColumn("__header", first)
        return marked.withColumns({"is_header": F.col("row") == F.coalesce("__header", F.lit(0)), "met": F.col("__header").isNotNull()}).drop("__fits", "__header")
    joined = null_safe_join(cells, guess_header_row(cells, key), [key])
    return joined.withColumn("is_header", F.col("row") == F.col("header")).drop("header")


def merge_fragments(fragments: DataFrame, key: str = KEY, unicode_forms: bool = True) -> DataFrame:
    """Tables that came in pieces, put together: ``key, table_no, frag_no, title, headers, rows, first_row``.

    ``fragments`` has one row per piece: ``key, frag_no, title, headers array, rows array<array>`` (one
    value of a model answer, so bounded by it). Pieces that follow each other with the same header
    are one table; a seam of up to five rows that repeats the rows before it is dropped, and so are the
    blank rows of later pieces. Result rows are the pieces with their remaining rows; ``first_row`` is
    the place of the first one in the table. Only row keys of both ends of a piece are put in sequence
    (an image has at most 64 tiles, each with a few tables); the rows stay where they are.
    """
    cell, line = "\x01", "\x02"  # neither is white space nor touched by NFKC
    blank_free = F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), cell))
    keyed = fragments.withColumns(
        {
            "__keys": F.when(
                F.size("rows") > 0, F.split(cell_key(F.array_join(blank_free, line), unicode_forms), line)
            ).otherwise(F.array().cast("array<string>")),
            "__head": cell_key(F.array_join(F.transform("headers", lambda c: F.coalesce(c, F.lit(""))), cell), unicode_forms),
        }
    )

    def solid(row_key: Column) -> Column:
        return F.length(F.replace(row_key, F.lit(cell), F.lit(""))) > 0

    # Ten keys of the end are kept, since up to five may still be cut off as a seam.
    numbered = F.filter(F.transform("__keys", lambda k, i: F.struct(i.alias("n"), k.alias("k"))), lambda e: solid(e["k"]))
    ends = keyed.select(
        key, "frag_no", "__head", F.size("headers").alias("__width"), F.slice("__keys", 1, SEAM_ROWS).alias("first"), numbered.alias("__solid")
    ).withColumn("tail", _last(F.col("__solid"), 2 * SEAM_ROWS))
    seq = W.partitionBy(key).orderBy("frag_no")
    same = (F.col("__width") > 0) & (F.lag("__head").over(seq) == F.col("__head")) & (F.lag("__width").over(seq) == F.col("__width"))
    ends = ends.withColumn("__new", (~F.coalesce(same, F.lit(False))).cast("int"))
    ends = ends.withColumn("table_no", F.sum("__new").over(seq.rowsBetween(W.unboundedPreceding, 0)) - 1)
    packed = ends.groupBy(key, "table_no").agg(
        F.array_sort(F.collect_list(F.struct("frag_no", "first", "tail"))).alias("items")
    )
    state = "struct<tail:array<string>,cuts:array<int>>"
    empty = F.struct(F.array().cast("array<string>").alias("tail"), F.array().cast("array<int>").alias("cuts")).cast(state)

    def append(acc: Column, item: Column) -> Column:
        cut = F.lit(0)
        for size in range(1, SEAM_ROWS + 1):
            known = (F.size(acc["tail"]) >= size) & (F.size(item["first"]) >= size)
            cut = F.when(known & (_last(acc["tail"], size) == F.slice(item["first"], 1, size)), size).otherwise(cut)
        left = F.transform(F.filter(item["tail"], lambda e: e["n"] >= cut), lambda e: e["k"])
        return F.struct(
            _last(F.concat(acc["tail"], left), SEAM_ROWS).alias("tail"), F.concat(acc["cuts"], F.array(cut)).alias("cuts")
        ).cast(state)

    folded = F.when(F.size("items") == 1, F.array(F.lit(0))).otherwise(F.aggregate("items", empty, append, lambda acc: acc["cuts"]))
    cuts = packed.withColumn("cuts", folded).select(
        key, "table_no", F.posexplode(F.arrays_zip("items", "cuts")).alias("__nth", "e")
    ).select(key, "table_no", "__nth", F.col("e.items.frag_no").alias("frag_no"), F.col("e.cuts").alias("__cut"))
    joined = null_safe_join(keyed, cuts, [key, "frag_no"])
    later = F.filter("rows", lambda _, i: (i >= F.col("__cut")) & solid(F.get("__keys", i)))
    kept = joined.withColumn("rows", F.when(F.col("__nth") == 0, F.col("rows")).otherwise(later))
    before = W.partitionBy(key, "table_no").orderBy("frag_no").rowsBetween(W.unboundedPreceding, -1)
    return kept.select(
        key, F.col("table_no").cast("int").alias("table_no"), "frag_no", "title", "headers", "rows",
        F.coalesce(F.sum(F.size("rows")).over(before), F.lit(0)).cast("int").alias("first_row"), (F.col("__nth") == 0).alias("opens"),
    )


def _last(items: Column, n: int) -> Column:
    """The last ``n`` elements, or all."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def parse_json_lenient(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``value`` (an object as variant) and ``error``: strips a code fence, else takes the outermost braces.

    The text counts as JSON only if it is one value from end to end; a value that is no object comes as ``{"data":
    value}``. There is an error whenever there is no value. Names that repeat in one object are an error unless the
    session sets ``spark.sql.variant.allowDuplicateKeys``.
    """
    fence = "```"
    bare = strip(F.col(text))
    opened = rows.withColumn("__bare", bare).withColumn(
        "__clean",
        F.when(
            F.col("__bare").startswith(fence),
            strip(F.regexp_replace(F.regexp_replace("__bare", f"(?s)^{fence}[^\n]*\n", ""), fence + "$", "")),
        ).otherwise(F.col("__bare")),
    )
    start = F.instr("__clean", "{")
    end = F.length("__clean") - F.instr(F.reverse("__clean"), "}") + 1
    inner = F.when((start > 0) & (end > start), F.substring(F.col("__clean"), start, end - start + 1))

    def whole(text: Column) -> Column:
        """The one value that the text is: in brackets it has to be a list of one."""
        listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        return F.when(F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1, F.try_variant_get(listed, "$[0]", "variant"))

    tried = opened.withColumn("__a", whole(F.col("__clean"))).withColumn("__text", F.when(F.col("__a").isNotNull(), F.col("__clean")).otherwise(inner))
    tried = tried.withColumn("__v", F.coalesce("__a", whole(F.col("__text"))))
    wrapped = F.try_parse_json(F.concat(F.lit('{"data":'), F.col("__text"), F.lit("}")))
    is_object = F.schema_of_variant("__v").startswith("OBJECT")
    tried = tried.withColumn("value", F.when(is_object, F.col("__v")).when(F.col("__v").isNotNull(), wrapped))
    return tried.withColumn("error", F.when(F.col("value").isNull(), F.lit("not valid JSON"))).drop("__bare", "__clean", "__a", "__text", "__v")


def exact_decimals(json: Column) -> Column:
    """JSON text with its decimals as strings, so that they keep the digits as written (``2.0``, ``1.50``)."""
    mark = "\x01"  # not legal inside JSON
    told = F.regexp_replace(json, r'("(?:[^"\\]|\\.)*")|(-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))', f"$1{mark}$2{mark}")
    return F.replace(F.replace(told, F.lit(mark * 2), F.lit("")), F.lit(mark), F.lit('"'))


def _cell_text(value: Column) -> Column:
    """A JSON value as cell text; null is the empty text."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def normalize_table(rows: DataFrame, table: str) -> DataFrame:
    """Adds ``title, headers, rows`` of a model table: null to empty, object rows in header order,
    scalar rows as one cell."""
    none = F.array().cast("array<variant>")
    opened = rows.withColumns(
        {
            "title": F.coalesce(F.try_variant_get(table, "$.title", "string"), F.lit("")),
            "headers": F.transform(F.coalesce(F.try_variant_get(table, "$.headers", "array<variant>"), none), _cell_text),
            "__rows": F.coalesce(F.try_variant_get(table, "$.rows", "array<variant>"), none),
        }
    )
    shapes = F.transform(
        "__rows",
        lambda r: F.struct(
            r.alias("v"), F.try_variant_get(r, "$", "map<string,variant>").alias("m"), F.try_variant_get(r, "$", "array<variant>").alias("a")
        ),
    )

    def one(row: Column) -> Column:
        names = F.when(F.size("headers") > 0, F.col("headers")).otherwise(F.map_keys(row["m"]))
        by_name = F.transform(names, lambda n: F.coalesce(_cell_text(F.try_element_at(row["m"], n)), F.lit("")))
        return (
            F.when(row["m"].isNotNull(), by_name)
            .when(row["a"].isNotNull(), F.transform(row["a"], _cell_text))
            .otherwise(F.array(_cell_text(row["v"])))
        )

    shaped = opened.withColumn("__shapes", shapes)
    return shaped.withColumn("rows", F.transform("__shapes", one)).drop("__rows", "__shapes")


def model_tables(answers: DataFrame, key: str = KEY) -> DataFrame:
    """Table pieces from model answers (``key, tile_id, answer``), in tile order."""
    parsed = parse_json_lenient(answers.select(key, "tile_id", exact_decimals(F.col("answer")).alias("answer")), "answer")
    tables = parsed.select(
        key, "tile_id", F.posexplode(F.try_variant_get("value", "$.tables", "array<variant>")).alias("nth", "t")
    ).where(F.schema_of_variant("t").startswith("OBJECT"))
    order = F.struct("tile_id", "nth").alias("frag_no")
    shaped = normalize_table(tables.select(key, order, "t"), "t").drop("t")
    return shaped.where((F.size("headers") > 0) | (F.size("rows") > 0))


def column_width(cells: DataFrame, key: str) -> DataFrame:
    """``key, col, width``: widest text plus three, from 8 to 48."""
    wide = F.max(display_width(F.col("text"))) + WIDTH_PAD
    return cells.groupBy(key, "col").agg(F.least(F.lit(WIDTH_HIGH), F.greatest(F.lit(WIDTH_LOW), wide)).cast("int").alias("width"))


def sheet_name(title: Column, position: Column, count: Column) -> Column:
    """A legal sheet name: forbidden characters out, 28 characters, a default when nothing is left."""
    clean = F.substring(strip(F.regexp_replace(F.coalesce(title, F.lit("")), SHEET_FORBIDDEN, "")), 1, SHEET_CHARS)
    default = F.when(count == 1, F.lit("Sheet1")).otherwise(F.concat(F.lit("Table"), position.cast("string")))
    return F.when(F.length(clean) > 0, clean).otherwise(default)


def image_to_table(blocks: DataFrame, answers: DataFrame | None = None, header_mode: str = "auto") -> DataFrame:
    """``image_id, table_no, row, col, text, is_header, source``: model tables where there are any,
    else the grid rebuilt from the boxes. No row is lost.

    An answer is read twice: for its cells, and for whether it has a table at all, so that boxes which are not used leave Spark's
    rows before they reach Python.
    """
    if answers is None:
        grid = grid_with_header(blocks) if header_mode == "auto" else mark_header(blocks_to_grid(blocks), mode=header_mode)
        return grid.select(KEY, F.lit(0).alias("table_no"), "row", "col", "text", "is_header", F.lit("grid").alias("source"))
    model = model_cells(answers, header_mode == "auto").withColumn("source", F.lit("model"))
    # The ids of images with a table are as many as the answers: never broadcast on a guess. The boxes keep their order.
    left_over = blocks.join(images_with_tables(answers).hint("merge"), KEY, "left_anti")
    return model.unionByName(image_to_table(left_over, None, header_mode))


def tables_of_images(images: DataFrame, blocks: DataFrame, answers: DataFrame | None = None, header_mode: str = "auto") -> DataFrame:
    """The rows of ``image_to_table`` with ``error`` for all of ``images`` (``image_id``): none comes back without an answer.

    An image without a single cell (no boxes and no model table, or model rows without cells) gives one row that has only
    ``image_id`` and the reason in ``error``. An image listed twice counts once, a null id is an image like any other, and
    boxes and answers of images that are not listed are left out. Other columns of ``images`` are not read.
    """
    cells = image_to_table(blocks, answers, header_mode)
    joined = null_safe_join(images.select(KEY).distinct(), cells, [KEY], "left")
    return joined.withColumn("error", F.when(F.col("source").isNull(), F.lit(NOTHING)))


def table_summary(cells: DataFrame) -> DataFrame:
    """Tables and rows per image. Flags instead of the greatest ``source``, so that no aggregate has to sort the cells."""
    source = F.col("source")
    rebuilt = F.when(F.count(source) > 0, F.bool_or(source == "grid") & ~F.bool_or(source > "grid"))
    tables = cells.groupBy(KEY, "table_no").agg((F.max("row") + 1).alias("rows"), rebuilt.alias("rebuilt"))
    return tables.groupBy(KEY).agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.max("rebuilt").alias("rebuilt"))
