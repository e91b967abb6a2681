"""Every registered query: ``name -> (spark, folder) -> DataFrame``, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import geometry as Geo
from ..functions import pageranges as R
from ..functions import text as T
from ..operators import chain, evaluate, files, grids, jobs, layout, pages, stamps, store
from ..sources import inventory, samples
from ..sources.tables import table
from ..streaming import feeds
from .invoices import invoice_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(work: Query) -> Query:
    QUERIES[work.__name__] = work
    return work


QUERIES["invoice_totals"] = lambda spark, d: invoice_totals(samples.headless_blocks(samples.invoice_blocks(spark, d)))


# --- files -----------------------------------------------------------------


@query
def file_inventory(spark, d):
    return files.file_inventory(samples.files(spark, d), "/in").select("path")


@query
def classify_file(spark, d):
    f = samples.files(spark, d)
    ext = files.extension(F.col("name"))
    return f.select("doc_id", ext.alias("ext"), files.classify(ext).alias("kind"))


@query
def accept_split(spark, d):
    return files.accept_split(samples.files(spark, d), ["pdf", "png", "jpg"]).select("doc_id", "status", "reason")


@query
def add_new_files(spark, d):
    f = samples.files(spark, d).select("path", "doc_id", "length")
    first = f.where(F.col("length") <= 2000).groupBy("path").agg(F.min("doc_id").alias("doc_id"), F.min("length").alias("length"))
    return files.add_new_files(first, f).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))


@query
def content_key(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.content_key(F.col("text"), "v1", F.col("lang")).alias("key"))


@query
def relative_target_dir(spark, d):
    f = samples.files(spark, d)
    return f.select(
        "doc_id", files.relative_target_dir(F.col("path"), "/in/src1", "/out").alias("narrow"),
        files.relative_target_dir(F.col("path"), "/in", "/out").alias("wide"),
    )


@query
def render_outputs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    texts = inventory.render_outputs(docs, "md", F.col("doc_id").cast("string"), F.col("text"))
    records = inventory.render_outputs(docs.select("doc_id", "lang"), "json", F.col("lang"), F.col("lang"))
    return texts.unionByName(records)


@query
def sensitive_match(spark, d):
    f = samples.files(spark, d)
    return f.select("doc_id", files.sensitive_match(F.col("name"), ["DOC1?.*", "*.PDF", "doc[2-3]*", " "]).alias("pattern"))


ENGINES = [("local.a", True, True), ("local.b", True, False), ("cloud.a", False, True)]


@query
def route_plan(spark, d):
    f = samples.files(spark, d).select(
        "doc_id", files.sensitive_match(F.col("name"), ["*.pdf"]).alias("sensitive"),
        F.element_at(F.array(F.lit("local"), F.lit("cloud"), F.lit("auto")), (F.col("doc_id") % 3 + 1).cast("int")).alias("preference"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("local.a"))).otherwise(F.array().cast("array<string>")).alias("allowed"),
    )
    plan = files.route_plan(f, ENGINES, cloud_enabled=True)
    return plan.select("doc_id", F.array_join("candidates", ">").alias("candidates"), F.array_join("notes", "; ").alias("notes"))


@query
def resolve_names(spark, d):
    named = files.target_names(samples.files(spark, d), F.lit("/out"))
    there = named.where(F.col("length") % 3 == 0).select("dir", "stem", "ext")
    copies = named.where(F.col("length") % 5 == 0).select("dir", F.concat("stem", F.lit(" (2)")).alias("stem"), "ext")
    return files.resolve_names(named, there.unionByName(copies).distinct()).select("doc_id", "output")


@query
def skip_names(spark, d):
    named = files.target_names(samples.files(spark, d), F.lit("/out"), ext="txt")
    there = named.where(F.col("length") % 3 == 0).select("dir", "stem", "ext")
    return files.resolve_names(named, there, "skip").select("doc_id", "output", "status")


@query
def aggregate_name(spark, d):
    f = samples.files(spark, d).groupBy(F.regexp_extract("path", "^/in/([^/]+)/", 1).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return f.select("batch", files.aggregate_name("merged_{count}_{date}", "2024-01-31", F.col("n")).alias("name"))


# --- layout ----------------------------------------------------------------


@query
def polygon_to_box(spark, d):
    b = samples.invoice_blocks(spark, d)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    polygons = b.select(
        "image_id", "block_id", F.when(F.col("block_id") % 13 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"),
        F.array(
            point(F.col("x0"), F.col("y0")), point(F.col("x1") + 1, F.col("y0")), point(F.col("x1"), F.col("y1") + 1), point(F.col("x0"), F.col("y1"))
        ).alias("points"),
        F.when(F.col("block_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("confidence").cast("string")).alias("score"),
        F.lit(0.5).alias("scale"),
    )
    return layout.polygon_to_box(polygons)


@query
def lines_to_blocks(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("image_id"), "text", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(800).alias("x1"),
        F.col("n_chars").cast("int").alias("y1"),
    )
    return layout.lines_to_blocks(docs).select("image_id", "block_id", "text", "y0", "y1")


@query
def estimate_line_height(spark, d):
    b = samples.invoice_blocks(spark, d)
    uneven = b.withColumn("y1", F.col("y1") + F.when(F.col("block_id") % 3 == 0, 50).otherwise(F.col("block_id") % 4).cast("int"))
    return layout.estimate_line_height(uneven)


@query
def line_scaling(spark, d):
    images = samples.invoice_images(spark, d, 4)
    w, h, line = F.col("width"), F.col("height"), F.col("line_height")
    return images.select(
        "image_id", F.round(Geo.model_scale(w, h), 6).alias("scale"), F.round(Geo.readable_line_height(line, w, h), 6).alias("readable"),
        Geo.max_tile_side(line).alias("side"), F.round(Geo.sanity_line_height(line - 28, h), 6).alias("guess"),
        F.round(Geo.sanity_line_height(line * 100, h), 6).alias("capped"),
    )


@query
def small_text_warning(spark, d):
    images = samples.invoice_images(spark, d, 4)
    tiles = layout.plan_tiles(images).groupBy("image_id").agg(F.count(F.lit(1)).alias("tiles"))
    facts = images.join(tiles, "image_id").withColumn("kept", F.when(F.col("image_id") % 3 == 0, 0.8).otherwise(0.9))
    warned = layout.small_text_warning(facts)
    return warned.select("image_id", F.array_join("warnings", "; ").alias("warnings"))


@query
def plan_tiles(spark, d):
    tiles = layout.plan_tiles(samples.invoice_images(spark, d, 4))
    c = F.col("core")
    return tiles.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum((c["x1"] - c["x0"]).cast("bigint") * (c["y1"] - c["y0"])).alias("core_area"),
        F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"),
        F.max(F.col("y") + F.col("height")).alias("bottom"),
    )


@query
def plan_tile_rows(spark, d):
    tiles = layout.plan_tiles(samples.invoice_images(spark, d, 4))
    return tiles.select("image_id", "tile_id", "x", "y", "width", "height", *[F.col("core")[c].alias(f"core_{c}") for c in ("x0", "y0", "x1", "y1")])


def _tiled(spark, d):
    """Two tiles per invoice, split at half height, and blocks in the coordinates of their tile."""
    images = samples.invoice_images(spark, d)
    half = F.floor(F.col("height") / 2).cast("int")
    tiles = images.select(
        "image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("tile_id"), F.lit(0).alias("x"),
        F.col("width"), half.alias("half"), F.col("height").alias("full"),
    ).select(
        "image_id", "tile_id", "x", F.when(F.col("tile_id") == 0, 0).otherwise(F.col("half")).alias("y"), "width",
        F.when(F.col("tile_id") == 0, F.col("half")).otherwise(F.col("full") - F.col("half")).alias("height"),
        F.struct(
            F.lit(0).alias("x0"), F.when(F.col("tile_id") == 0, 0).otherwise(F.col("half")).alias("y0"),
            F.col("width").alias("x1"), F.when(F.col("tile_id") == 0, F.col("half")).otherwise(F.col("full")).alias("y1"),
        ).alias("core"),
        F.lit(None).cast("string").alias("error"),
    )
    return tiles, samples.invoice_blocks(spark, d)


@query
def tile_to_global(spark, d):
    tiles, b = _tiled(spark, d)
    local = b.withColumn("tile_id", (F.col("block_id") % 2).cast("int"))
    moved = layout.shift_origin(layout.tile_to_global(local, tiles), F.lit(5), F.lit(7))
    return moved.select("image_id", "block_id", "x0", "y0", "x1", "y1")


@query
def tile_owner(spark, d):
    tiles, b = _tiled(spark, d)
    far = b.withColumns({"x0": F.col("x0") + 300, "x1": F.col("x1") + 300})
    return layout.tile_owner(far, tiles).select("image_id", "block_id", "owner")


@query
def dedupe_overlap(spark, d):
    return layout.dedupe_overlap(samples.doubled_blocks(samples.invoice_blocks(spark, d))).select("image_id", "block_id", "text", "x0", "y0")


@query
def reading_order(spark, d):
    return layout.reading_order(samples.invoice_blocks(spark, d)).select("image_id", "block_id", "line", "pos")


@query
def page_text(spark, d):
    return layout.page_text(layout.reading_order(samples.invoice_blocks(spark, d)))


@query
def average_confidence(spark, d):
    return layout.average_confidence(samples.invoice_blocks(spark, d)).select("image_id", F.round("avg_confidence", 8).alias("avg_confidence"))


@query
def text_layer_geometry(spark, d):
    g = layout.text_layer_geometry(samples.invoice_blocks(spark, d), 150)
    return g.select("image_id", "block_id", "font", *[F.round(c, 6).alias(c) for c in ("font_size", "base_x", "base_y")])


@query
def ocr_report(spark, d):
    ordered = layout.reading_order(samples.invoice_blocks(spark, d))
    images = samples.invoice_images(spark, d).select("image_id", "width", "height")
    return layout.ocr_report(images, ordered, 60).drop("report")


# --- grids -----------------------------------------------------------------


@query
def group_rows(spark, d):
    return grids.group_rows(samples.invoice_blocks(spark, d)).select("image_id", "block_id", "row")


@query
def detect_columns(spark, d):
    return grids.detect_columns(samples.invoice_blocks(spark, d))


@query
def assign_column(spark, d):
    b = samples.gappy_blocks(samples.invoice_blocks(spark, d))
    return grids.assign_column(b, grids.detect_columns(b)).select("image_id", "block_id", "col")


@query
def blocks_to_grid(spark, d):
    return grids.blocks_to_grid(samples.gappy_blocks(samples.invoice_blocks(spark, d)))


@query
def dense_rows(spark, d):
    rows = grids.dense_rows(grids.blocks_to_grid(samples.gappy_blocks(samples.invoice_blocks(spark, d))))
    return rows.select("image_id", "row", F.array_join("cells", "|").alias("cells"))


def _holed_cells(spark, d):
    """Raw cells with every third row and the second column blanked."""
    cells = samples.raw_cells(spark, d)
    hole = (F.col("row") % 3 == 0) | (F.col("col") == 1)
    return cells.withColumn("text", F.when(hole, F.lit(" ")).otherwise(F.col("text")))


@query
def trim_empty(spark, d):
    return grids.trim_empty(_holed_cells(spark, d), "case_id")


@query
def guess_header_row(spark, d):
    b = samples.invoice_blocks(spark, d)
    cells = grids.blocks_to_grid(b.withColumn("text", F.when((F.col("block_id") < 10) & (F.col("image_id") % 3 == 0), "No 1").otherwise(F.col("text"))))
    return grids.guess_header_row(cells)


@query
def merge_fragments(spark, d):
    merged = grids.merge_fragments(samples.fragments(spark, d))
    rows = merged.select("image_id", "table_no", "first_row", F.posexplode("rows").alias("i", "cells"))
    return rows.select("image_id", "table_no", (F.col("first_row") + F.col("i")).alias("row"), F.array_join("cells", "|").alias("cells"))


@query
def parse_json_lenient(spark, d):
    told = F.when(F.col("image_id") % 8 == 4, F.concat(F.lit("3 tables found: "), "answer")).when(F.col("image_id") % 8 == 6, F.concat(F.lit("[1,2] and "), "answer"))
    answers = samples.model_answers(spark, d).withColumn("answer", F.coalesce(told, "answer"))
    parsed = grids.parse_json_lenient(answers, "answer")
    return parsed.select("image_id", F.try_variant_get("value", "$.tables[0].title", "string").alias("title"), "error")


@query
def normalize_table(spark, d):
    """Each line as a model table with an object row, a list row and a scalar row."""
    lines = samples.invoice_lines(spark, d)
    json = F.concat(
        F.lit('{"title":null,"headers":["a","b"],"rows":[{"b":"'), F.col("l_returnflag"), F.lit('","a":'), F.col("l_partkey").cast("string"),
        F.lit('},["'), F.col("l_linestatus"), F.lit('",null],'), F.col("rn").cast("string"), F.lit(".50]}"),
    )
    n = grids.normalize_table(lines.select("l_orderkey", "rn", F.try_parse_json(grids.exact_decimals(json)).alias("t")), "t")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/")
    return n.select("l_orderkey", "rn", "title", F.array_join("headers", "|").alias("headers"), rows.alias("rows"))


@query
def column_width(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.posexplode(F.array(F.col("p_name"), F.col("p_type"))).alias("col", "text"))
    return grids.column_width(p, "brand")


@query
def sheet_name(spark, d):
    p = table(spark, d, "part")
    title = F.when(F.col("p_size") == 1, F.lit("[]*")).otherwise(F.concat(F.lit(" a/b:"), F.col("p_name"), F.lit("?"), F.col("p_brand"), F.lit(" "), F.col("p_type")))
    return p.select("p_partkey", grids.sheet_name(title, F.col("p_partkey"), F.col("p_size")).alias("name"))


@query
def image_to_table(spark, d):
    return grids.image_to_table(samples.invoice_blocks(spark, d), samples.model_answers(spark, d))


@query
def tables_of_images(spark, d):
    """Some orders have no line: their scans are blank."""
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return grids.tables_of_images(images, samples.invoice_blocks(spark, d), samples.model_answers(spark, d))


@query
def table_summary(spark, d):
    return grids.table_summary(grids.image_to_table(samples.invoice_blocks(spark, d)))


# --- cells and text --------------------------------------------------------


@query
def parse_cell(spark, d):
    typed = samples.raw_cells(spark, d).withColumn("cell", C.parse_cell(F.col("text")))
    return typed.select("case_id", "row", "col", F.round("cell.num", 6).alias("num"), F.col("cell.text").alias("text"), F.col("cell.fmt").alias("fmt"), F.col("cell.whole").cast("string").alias("whole"))


@query
def coerce_simple(spark, d):
    cell = C.coerce_simple(F.col("text"))
    return samples.raw_cells(spark, d).select("case_id", "row", "col", cell["num"].alias("num"), cell["text"].alias("text"))


@query
def parse_param(spark, d):
    raw = F.concat(F.lit(" c"), F.col("col").cast("string"), F.when(F.col("col") == 5, F.lit("")).otherwise(F.lit(" = ")), F.col("text"))
    p = F.col("p")
    return samples.raw_cells(spark, d).withColumn("p", C.parse_param(raw)).select(
        "case_id", "row", "col", p["key"].alias("key"), p["kind"].alias("kind"), p["whole"].cast("bigint").alias("whole"), p["text"].alias("text"), p["error"].alias("error")
    )


@query
def value_key(spark, d):
    return samples.raw_cells(spark, d).select("case_id", "row", "col", C.value_key(F.col("text")).alias("key"))


@query
def format_key(spark, d):
    text = F.concat(F.lit(" "), F.col("text"), F.lit("\n x  "))
    return samples.raw_cells(spark, d).select("case_id", "row", "col", C.format_key(text).alias("key"))


@query
def display_matches(spark, d):
    typed = samples.raw_cells(spark, d).withColumn("cell", C.parse_cell(F.col("text")))
    return typed.select("case_id", "row", "col", C.display_matches(F.col("text"), F.col("cell.fmt")).alias("shown"))


@query
def parse_page_range(spark, d):
    docs = samples.documents_as_docs(spark, d)
    return docs.select("doc_id", F.explode_outer(R.parse_page_range(F.col("spec"), F.col("page_count"))).alias("page_no"))


@query
def language_hint(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_hint(F.col("text")).alias("hint"))


@query
def needs_cjk(spark, d):
    return table(spark, d, "documents").select("doc_id", T.needs_cjk(F.col("text")).alias("cjk"))


@query
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query
def cell_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cell_key(F.col("text")).alias("key"))


@query
def structure_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.structure_lines(F.col("text"))).alias("line_no", "l"))
    return docs.select("doc_id", "line_no", F.col("l.kind").alias("kind"), F.col("l.level").alias("level"), F.col("l.text").alias("text"))


def _template_values():
    return F.create_map(
        F.lit("page"), F.col("page_no").cast("string"), F.lit("pages"), F.col("page_count").cast("string"), F.lit("stem"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    )


@query
def expand_template(spark, d):
    p = samples.doc_pages(spark, d)
    templates = F.array(F.lit("{stem} {page}/{pages} {who}"), F.lit("{{{page}}}"), F.lit("{page} {"), F.lit("{} {page}"), F.lit("{0}{page}"))
    return p.select("doc_id", "page_no", F.posexplode(F.transform(templates, lambda t: T.expand_template(t, _template_values()))).alias("nth", "text"))


@query
def hex_color(spark, d):
    p = table(spark, d, "part")
    hexed = F.lpad(F.hex(F.col("p_partkey") * 65537), 6, "0")
    value = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("##"), F.substring(hexed, 1, 3))).when(F.col("p_size") % 5 == 1, F.concat(F.lit("#"), hexed, F.lit("80"))).when(
        F.col("p_size") % 5 == 2, F.col("p_name")).otherwise(hexed)
    c = T.hex_color(F.when(F.length(hexed) == 6, value))
    return p.select("p_partkey", *[c[k].alias(k) for k in "rgba"])


@query
def warning_summary(spark, d):
    docs = table(spark, d, "documents")
    warned = T.unique_in_order(F.filter(F.array("source", "text", "lang", "source"), lambda w: F.length(w) != 3))
    return docs.select("doc_id", T.warning_summary(F.lit("done"), warned).alias("summary"))


@query
def typed_param(spark, d):
    e = table(spark, d, "events")
    params = F.create_map(F.lit("n"), F.col("user_id").cast("string"), F.lit("x"), F.col("value").cast("string"), F.lit("flag"), F.when(F.col("event_type") == "click", " YES ").otherwise(F.col("event_type")))
    return e.select(
        "event_id", T.int_param(params, "n", 5).alias("n"), T.int_param(params, "flag", 5).alias("bad_n"), T.float_param(params, "x", 0.5).alias("x"),
        T.float_param(params, "none", 0.5).alias("none"), T.bool_param(params, "flag", True).alias("flag"), T.bool_param(params, "none", True).alias("no_flag"),
        T.text_param(params, "flag", "-").alias("word"),
    )


# --- pages -----------------------------------------------------------------


@query
def page_route(spark, d):
    return pages.route_stats(pages.page_route(samples.doc_pages(spark, d)))


@query
def likely_scanned(spark, d):
    return pages.page_facts(samples.doc_pages(spark, d)).select("doc_id", "page_no", "characters", "images", "likely_scanned")


@query
def doc_looks_scanned(spark, d):
    return pages.doc_looks_scanned(samples.doc_pages(spark, d))


@query
def doc_info(spark, d):
    return pages.doc_info(samples.doc_pages(spark, d))


@query
def merge_docs(spark, d):
    return pages.merge_docs(samples.doc_pages(spark, d), samples.documents_as_docs(spark, d)).select("merge_id", "doc_id", "page_no", "merged_page")


@query
def merge_bookmarks(spark, d):
    return pages.merge_bookmarks(samples.documents_as_docs(spark, d))


@query
def merge_status(spark, d):
    return pages.merge_status(samples.documents_as_docs(spark, d))


@query
def split_every(spark, d):
    parts = pages.split_every(samples.doc_pages(spark, d), 3)
    return parts.groupBy("doc_id", "part", "label").agg(F.count(F.lit(1)).alias("pages"))


@query
def split_ranges(spark, d):
    return pages.split_ranges(samples.doc_pages(spark, d), F.lit("1-2,2-,x,3")).select("doc_id", "page_no", "part", "label")


def _spec():
    return F.element_at(F.array(*[F.lit(s) for s in samples.SPECS]), (F.col("doc_id") % 5 + 1).cast("int"))


@query
def extract_pages(spark, d):
    return pages.extract_pages(samples.doc_pages(spark, d), _spec()).select("doc_id", "page_no", "new_page")


@query
def selection_status(spark, d):
    return pages.selection_status(samples.documents_as_docs(spark, d))


@query
def rotate_pages(spark, d):
    return pages.rotate_pages(samples.doc_pages(spark, d), _spec(), -90).select("doc_id", "page_no", "rotation")


def _rebuilt(spark, d):
    p = samples.doc_pages(spark, d)
    return pages.page_text_rebuild(p, samples.recognised_pages(p))


@query
def page_text_rebuild(spark, d):
    return _rebuilt(spark, d)


@query
def rebuild_status(spark, d):
    return pages.rebuild_status(_rebuilt(spark, d))


@query
def doc_text(spark, d):
    return pages.doc_text(_rebuilt(spark, d))


@query
def rotated_extent(spark, d):
    p = table(spark, d, "part")
    e = Geo.rotated_extent(F.col("p_size") * 10.0, F.col("p_retailprice"), F.col("p_partkey") % 360)
    return p.select("p_partkey", F.round(e["width"], 4).alias("width"), F.round(e["height"], 4).alias("height"))


@query
def placement_centers(spark, d):
    p = samples.doc_pages(spark, d).select("doc_id", "page_no", "width", "height")
    names = F.array(*[F.lit(n) for n in Geo.POSITIONS[:-1]], F.lit("nowhere"))
    spots = p.select("*", F.explode(names).alias("position"))
    extent = Geo.rotated_extent(F.lit(120.0), F.lit(30.0), F.lit(30.0))
    c = Geo.anchor_center(F.col("width"), F.col("height"), extent, F.col("position"), F.lit(0.04), F.lit(0.25), F.lit(0.75))
    return spots.select("doc_id", "page_no", "position", F.round(c["cx"], 4).alias("cx"), F.round(c["cy"], 4).alias("cy"))


@query
def tile_centers(spark, d):
    p = samples.doc_pages(spark, d)
    extent = Geo.rotated_extent(F.lit(180.0), F.lit(60.0), F.lit(0.0))
    spots = p.select("doc_id", "page_no", F.explode(Geo.tile_centers(F.col("width"), F.col("height"), extent, F.lit(0.35))).alias("c"))
    return spots.groupBy("doc_id", "page_no").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c.cx"), 3).alias("sum_x"), F.round(F.sum("c.cy"), 3).alias("sum_y")
    )


@query
def stamp_plan(spark, d):
    plan = stamps.stamp_plan(samples.doc_pages(spark, d), "{stem} {page}/{pages}", _template_values(), _spec(), "bottom-right", 0.0, 2.0, "#F08")
    return plan.select("doc_id", "page_no", "text", *[F.round(c, 4).alias(c) for c in ("font_size", "cx", "cy")], "opacity", "r", "g", "b")


# --- jobs ------------------------------------------------------------------


@query
def task_filter(spark, d):
    return jobs.task_filter(samples.tasks(spark, d), "done").select("job_id", "task_id", "status")


@query
def job_rollup(spark, d):
    return jobs.job_rollup(samples.tasks(spark, d))


@query
def job_status(spark, d):
    rolled = jobs.job_rollup(samples.tasks(spark, d))
    return jobs.job_status(rolled, F.col("cancelled") * 4 > F.col("total")).select("job_id", "status", "error")


@query
def strict_success(spark, d):
    return jobs.strict_success(samples.tasks(spark, d))


@query
def failure_reasons(spark, d):
    return jobs.failure_reasons(samples.tasks(spark, d))


@query
def run_isolated(spark, d):
    def whole(record: dict) -> str:
        return str(int(record["text"]) + 1)

    return jobs.run_isolated(samples.raw_cells(spark, d), whole).select("case_id", "row", "col", "result", "status")


@query
def upsert_tasks(spark, d):
    old = samples.tasks(spark, d).select("task_id", "job_id", "file_name", "status", "error").where(F.col("status") != "skipped")
    new = samples.tasks(spark, d).where(F.col("status") != "failed").select(
        "task_id", F.lit(-1).cast("bigint").alias("job_id"), F.lit("renamed").alias("file_name"), F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error")
    )
    first = new.withColumns({"at": F.lit(1), "status": F.lit("running"), "error": F.lit("not yet")})
    twice = new.withColumns({"at": F.lit(2), "file_name": F.lit("late")}).unionByName(first)
    return jobs.upsert(old, twice.withColumn("file_name", F.when(F.col("at") == 1, "renamed").otherwise(F.col("file_name"))), "task_id", ["status", "error"], "at")


def _jobs(spark, d):
    return samples.tasks(spark, d).groupBy("job_id").agg(
        F.min("seq").alias("created_at"), F.max_by("status", "seq").alias("last"), F.count(F.lit(1)).alias("n")
    ).withColumn("status", F.when(F.col("last") == "cancelled", "queued").when(F.col("last") == "skipped", "running").otherwise(F.col("last")))


@query
def list_jobs(spark, d):
    return jobs.list_jobs(_jobs(spark, d), 9999, 3).select("job_id", "created_at")


@query
def active_jobs(spark, d):
    return jobs.active_jobs(_jobs(spark, d)).select("job_id", "status")


@query
def job_tasks(spark, d):
    return jobs.job_tasks(samples.tasks(spark, d), jobs.active_jobs(_jobs(spark, d))).select("job_id", "task_id", "status")


@query
def clear_history(spark, d):
    kept_jobs, kept_tasks = jobs.clear_history(_jobs(spark, d), samples.tasks(spark, d), jobs.active_jobs(_jobs(spark, d)))
    counted = kept_tasks.groupBy("job_id").agg(F.count(F.lit(1)).alias("tasks"))
    return kept_jobs.join(counted, "job_id", "left").select("job_id", "tasks")


@query
def size_change(spark, d):
    return jobs.size_change(samples.tasks(spark, d))


@query
def first_success(spark, d):
    return jobs.first_success(samples.attempts(spark, d))


@query
def preferred_engine(spark, d):
    engines = table(spark, d, "part").select(
        F.col("p_brand").alias("domain"), F.col("p_size").alias("fidelity"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("engine"),
        (F.col("p_type") != "SMALL").alias("available"),
    )
    return jobs.preferred_engine(engines)


# --- presets, cache, usage -------------------------------------------------


@query
def save_presets(spark, d):
    return store.save_presets(samples.preset_changes(spark, d))


@query
def refused_presets(spark, d):
    name = F.when(F.col("updated") % 7 == 0, "  ").when(F.col("updated") % 7 == 1, F.repeat("name", 20)).otherwise(F.col("name"))
    return store.refused_presets(samples.preset_changes(spark, d).withColumn("name", name)).select("new_id", "error")


@query
def list_presets(spark, d):
    return store.list_presets(store.save_presets(samples.preset_changes(spark, d)), "click").select("name", "params")


@query
def delete_presets(spark, d):
    saved = store.save_presets(samples.preset_changes(spark, d))
    gone = saved.where(F.col("created") < 1000).select("id")
    return store.delete_presets(saved, gone).select("action", "name")


@query
def merge_params(spark, d):
    e = table(spark, d, "events")
    preset = F.from_json("props", "map<string,string>")
    merged = store.merge_params(preset, F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "view", "k").otherwise("kind"), F.col("event_type")))
    return e.select("event_id", *[F.try_element_at(merged, F.lit(k)).alias(k) for k in ("k", "user", "kind")])


@query
def cache_lookup(spark, d):
    return store.cache_lookup(samples.cache_requests(spark, d), samples.result_cache(spark, d)).select("request_id", "hit", "value")


@query
def cache_misses(spark, d):
    return store.cache_misses(samples.cache_requests(spark, d), samples.result_cache(spark, d))


def _touched(spark, d):
    return store.cache_touch(samples.result_cache(spark, d), samples.cache_requests(spark, d))


@query
def cache_touch(spark, d):
    return _touched(spark, d).select("key", "hits", "last_hit")


@query
def cache_refused(spark, d):
    value = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), value.alias("value"), F.col("doc_id").alias("created"))
    return store.cache_refused(rows, 2000)


@query
def cache_put(spark, d):
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), F.col("lang").alias("value"), F.col("doc_id").alias("created"))
    return store.cache_put(samples.result_cache(spark, d), rows).select("key", "value", "created", "hits")


@query
def cache_evict(spark, d):
    return store.cache_evict(_touched(spark, d), 100).select("key", "hits")


@query
def cache_stats(spark, d):
    return store.cache_stats(_touched(spark, d))


@query
def usage_rollup(spark, d):
    calls = table(spark, d, "events").select(
        "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("prompt_tokens"), (F.col("event_id") % 1000).alias("completion_tokens")
    )
    return store.usage_rollup(calls, ["event_type"])


@query
def estimate_cost(spark, d):
    return store.estimate_cost(samples.invoice_images(spark, d, 4), 1500, True)


# --- chains ----------------------------------------------------------------

CHAINS = [
    ["pdf.rotate", "pdf.info"],
    ["image.ocr", "doc.to_pdf"],
    ["doc.to_pdf", "pdf.to_images", "image.watermark"],
    ["pdf.merge"],
    ["image.watermark", "pdf.to_word"],
]


def _chained(spark, d):
    f = samples.files(spark, d)
    lists = F.array(*[F.array(*[F.lit(s) for s in c]) for c in CHAINS])
    return chain.validate_chain(f, files.extension(F.col("name")), F.element_at(lists, (F.col("doc_id") % 5 + 1).cast("int")))


@query
def validate_chain(spark, d):
    return _chained(spark, d).select("doc_id", "error", "final_ext")


@query
def describe_chain(spark, d):
    return _chained(spark, d).select("doc_id", "flow")


@query
def run_chain(spark, d):
    """Extract, rotate, describe: one plan; documents without a selected page fail in step 1."""

    def extract(rows):
        hit = R.page_ranges(_spec(), F.col("page_count"))
        marked = rows.withColumn("error", F.when(F.size(hit) == 0, "no page matches"))
        kept = marked.where(F.col("error").isNotNull() | R.page_selected(F.col("page_no"), hit))
        return kept.withColumn("page_no", F.when(F.col("error").isNull(), R.selected_rank(F.col("page_no"), hit)).otherwise(F.col("page_no")))

    def rotate(rows):
        turned = F.pmod(F.col("rotation") + 90, F.lit(360))
        return rows.withColumn("rotation", F.when(F.col("error").isNull(), turned).otherwise(F.col("rotation")))

    def describe(rows):
        return rows.groupBy("doc_id", "error", "failed_step").agg(
            F.count(F.lit(1)).alias("pages"), F.sum("characters").cast("bigint").alias("characters"), F.max("rotation").alias("rotation")
        )

    done = chain.run_chain(samples.doc_pages(spark, d), [("pdf.extract_pages", extract), ("pdf.rotate", rotate), ("pdf.info", describe)], "pdf")
    return done.select("doc_id", "pages", "characters", "rotation", "error", "failed_step")


# --- evaluation ------------------------------------------------------------


def _grids(spark, d):
    """Both grids by lines, the cells of a line as lists from column 0 on."""
    rows = samples.raw_rows(spark, d)
    place, texts = rows.columns[:2], rows.columns[2:]
    read = samples.damaged_rows(rows)
    # Texts, typed cells and values are columns of their own, so each is worked out once.
    typed = read.withColumns({f"cell_{t}": C.parse_cell(F.col(t)) for t in texts})

    def value(t: str) -> Column:
        num = F.col(f"cell_{t}.num")
        return F.coalesce(F.when(num == F.floor(num), num.cast("bigint").cast("string")).otherwise(num.cast("string")), F.col(t))

    values, fmts = [value(t) for t in texts], [F.col(f"cell_{t}.fmt") for t in texts]
    return rows.select(*place, F.array(*texts).alias("text")), typed.select(*place, F.array(*values).alias("value"), F.array(*fmts).alias("fmt"))


@query
def compare_grids(spark, d):
    return evaluate.compare_grids(*_grids(spark, d))


@query
def top_mismatches(spark, d):
    return evaluate.top_mismatches(*_grids(spark, d)).select("case_id", "verdict", "nth", "row", "col", "want", "got")


@query
def eval_summary(spark, d):
    return evaluate.eval_summary(evaluate.compare_grids(*_grids(spark, d)))


# --- streams (batch twins) -------------------------------------------------


@query
def latest_task_state(spark, d):
    e = samples.tasks(spark, d).select(F.col("job_id").alias("task_id"), "ts", "seq", "status", "progress")
    return feeds.latest_task_state(e).select("task_id", "seq", "status", "progress")


@query
def fresh_files(spark, d):
    """Two looks at a folder: by the second one some files are new and some rewritten."""
    listed = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), "n_chars")
    now = listed.select("path", F.when(F.col("doc_id") % 10 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"))
    before = listed.where(F.col("doc_id") % 3 != 0).select("path", F.col("n_chars").alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"))
    return feeds.fresh_files(now, before).select("path", "length")


@query
def batch_merges(spark, d):
    """Documents that arrive in batches of a hundred, each batch one merge."""
    docs = samples.documents_as_docs(spark, d).withColumn("merge_id", F.floor(F.col("doc_id") / 100).cast("string"))
    return pages.merge_bookmarks(docs).select("merge_id", "doc_id", "first_page", "skipped")


@query
def throttle(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("task_id"), (F.col("event_id") * 10).alias("ts_ms"), F.col("event_id").alias("seq"), (F.col("user_id") == 7).alias("forced")
    )
    return feeds.throttle(e).select("task_id", "seq")


@query
def log_tail(spark, d):
    return feeds.log_tail(samples.tasks(spark, d)).select("task_id", "status")
