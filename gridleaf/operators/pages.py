"""Page-table operators: routing, merging, splitting, selecting, rotating and describing documents.

A page is a row ``doc_id, page_no (from 1), page_text, characters, images, width, height, rotation``.
Page selections are intervals on the row (``functions.pageranges``), so no operator here needs a
window over the pages of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pageranges import page_ranges, page_selected, piece_ranges, selected_count, selected_rank
from ..functions.text import strip, text_lines
from .scan import null_safe_join, running_total

# --- fixed values ---------------------------------------------------------
MIN_TEXT = 20
ROTATIONS = 90
# --------------------------------------------------------------------------

PART_PAGES = 1000


def page_route(pages: DataFrame, min_chars: int = MIN_TEXT, force: bool = False) -> DataFrame:
    """Adds ``route``: keep pages that already have text, recognise the rest."""
    enough = F.length(strip(F.col("page_text"))) >= min_chars
    return pages.withColumn("route", F.when(enough & ~F.lit(force), "keep").otherwise("recognise"))


def route_stats(routed: DataFrame) -> DataFrame:
    keep = (F.col("route") == "keep").cast("bigint")
    return routed.groupBy("doc_id").agg(F.sum(keep).alias("kept_pages"), F.sum(1 - keep).alias("ocr_pages"))


def likely_scanned() -> Column:
    """Little text and at least one image on the page."""
    return (F.col("characters") < MIN_TEXT) & (F.col("images") > 0)


def doc_looks_scanned(pages: DataFrame) -> DataFrame:
    """Little text for its number of pages and an image on every page, over the whole document."""
    n = F.count(F.lit(1))
    scanned = (F.sum("characters") < n * MIN_TEXT) & (F.sum("images") >= n)
    return pages.groupBy("doc_id").agg(scanned.alias("scanned"))


def doc_info(pages: DataFrame) -> DataFrame:
    """Counts per document; the per-page facts stay rows (``page_facts``)."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum("characters").cast("bigint").alias("total_characters"),
        F.sum("images").cast("bigint").alias("total_images"), F.count_if(likely_scanned()).alias("scanned_pages"),
    )


def page_facts(pages: DataFrame) -> DataFrame:
    return pages.select(
        "doc_id", "page_no", F.round("width", 1).alias("width"), F.round("height", 1).alias("height"), "rotation",
        "characters", "images", likely_scanned().alias("likely_scanned"),
    )


def merge_bookmarks(docs: DataFrame) -> DataFrame:
    """Where each document starts in its merged file: ``merge_id, doc_id, ord, page_count, first_page, skipped``.

    ``docs``: ``merge_id, doc_id, ord, page_count, encrypted`` (``page_count`` null when unreadable).
    The running page offset is a two-level sum, so a merge of any number of documents is spread out.
    """
    bad = F.when(F.col("page_count").isNull(), "unreadable").when(F.col("encrypted"), "encrypted")
    marked = docs.withColumn("skipped", bad).withColumn(
        "__n", F.when(bad.isNull(), F.col("page_count")).otherwise(0).cast("bigint")
    )
    placed = running_total(marked, ["merge_id"], "ord", "__n", "__before")
    return placed.select(
        "merge_id", "doc_id", "ord", "page_count", F.when(F.col("skipped").isNull(), F.col("__before") + 1).alias("first_page"), "skipped"
    )


def merge_status(docs: DataFrame) -> DataFrame:
    """Per merge: documents, pages, skipped documents and the error, if any."""
    good = F.col("page_count").isNotNull() & ~F.col("encrypted")
    total = F.coalesce(F.sum(F.when(good, F.col("page_count"))), F.lit(0)).cast("bigint")
    n = F.count(F.lit(1))
    error = F.when(n < 2, "needs two documents").when(total == 0, "no readable document")
    return docs.groupBy("merge_id").agg(
        n.alias("docs"), total.alias("pages"), F.count_if(~good).alias("skipped"), error.alias("error")
    )


def merge_docs(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages of every merged file with their new number; merges in error give no pages."""
    usable = merge_status(docs).where(F.col("error").isNull()).select("merge_id")
    starts = merge_bookmarks(docs).where(F.col("first_page").isNotNull()).select("merge_id", "doc_id", "first_page")
    starts = starts.join(usable, "merge_id", "left_semi")
    joined = null_safe_join(pages, starts, ["doc_id"], grown=False)
    return joined.withColumn("merged_page", F.col("first_page") + F.col("page_no") - 1).drop("first_page")


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """Adds ``part`` (from 0) and its ``label`` (``a-b``)."""
    n = max(1, n)
    part = F.floor((F.col("page_no") - 1) / n).cast("int")
    last = F.least(part * n + n, F.col("page_count"))
    return pages.withColumns(
        {"part": part, "label": F.concat((part * n + 1).cast("string"), F.lit("-"), last.cast("string"))}
    )


def split_ranges(pages: DataFrame, spec: Column) -> DataFrame:
    """One part per comma piece that holds the page; pieces may overlap. ``page_count`` is on the page."""
    pieces = F.filter(
        piece_ranges(spec, F.col("page_count")), lambda p: (F.col("page_no") >= p["lo"]) & (F.col("page_no") <= p["hi"])
    )
    spread = pages.withColumn("__p", F.explode(pieces))
    return spread.withColumns({"part": F.col("__p.no").cast("int"), "label": F.col("__p.label")}).drop("__p")


def extract_pages(pages: DataFrame, spec: Column) -> DataFrame:
    """Keep the selected pages and renumber them (``new_page``)."""
    # as a generator's output the list is parsed once, not once for the filter and once for the number
    chosen = pages.withColumn("__r", F.explode(F.array(page_ranges(spec, F.col("page_count")))))
    page = F.col("page_no")
    return (
        chosen.where(page_selected(page, F.col("__r")))
        .withColumn("new_page", selected_rank(page, F.col("__r")))
        .drop("__r")
    )


def selection_status(docs: DataFrame) -> DataFrame:
    """Selected pages per document, or the error that nothing matched."""
    n = selected_count(page_ranges(F.col("spec"), F.col("page_count")))
    return docs.select("doc_id", "page_count", n.alias("selected"), F.when(n == 0, "no page matches").alias("error"))


def rotate_pages(pages: DataFrame, spec: Column, angle: int) -> DataFrame:
    """Turn the selected pages further; the angle is a multiple of 90."""
    if angle % ROTATIONS:
        raise ValueError("the angle must be a multiple of 90")
    hit = page_selected(F.col("page_no"), page_ranges(spec, F.col("page_count")))
    return pages.withColumn("rotation", F.when(hit, F.pmod(F.col("rotation") + angle, F.lit(360))).otherwise(F.col("rotation")))


def page_text_rebuild(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Text layer where there is one, recognised text elsewhere: ``doc_id, page_no, text, origin, chars``."""
    joined = null_safe_join(pages.select("doc_id", "page_no", "page_text"), ocr, ["doc_id", "page_no"], "left")
    layer = strip(F.col("page_text"))
    has_layer = F.coalesce(F.length(layer) > 0, F.lit(False))
    origin = F.when(has_layer, "layer").when(F.col("ocr_text").isNotNull(), "ocr").otherwise("failed")
    text = F.when(has_layer, layer).otherwise(F.coalesce("ocr_text", F.lit("")))
    lines = text_lines(text)
    return joined.select("doc_id", "page_no", F.array_join(lines, "\n").alias("text"), origin.alias("origin")).withColumn(
        "chars", F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    )


def rebuild_status(rebuilt: DataFrame) -> DataFrame:
    chars = F.sum("chars").cast("bigint")
    return rebuilt.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("origin") == "ocr").alias("recognised"),
        F.count_if(F.col("origin") == "failed").alias("failed"), chars.alias("chars"),
        F.when(chars == 0, "no text on any page").alias("error"),
    )


def doc_text(rebuilt: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """``doc_id, part, text``: pages joined by form feeds; a long document goes on in further parts."""
    pages = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return rebuilt.groupBy("doc_id", F.floor((F.col("page_no") - 1) / part_pages).alias("part")).agg(
        F.array_join(F.transform(pages, lambda p: p["text"]), "\f").alias("text")
    )
