"""Document-shaped views over the given tables: boxes, files, pages, jobs, fragments, cells, presets, cache.

Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
PAGE_CHARS = 1000
EXTENSIONS = ("pdf", "png", "jpg", "docx", "xlsx", "txt", "zip", "bin")
SPECS = ("all", "1-2", "2-", "1,3", "9-1")


def invoice_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` with ``rn``, the line's place in its order (an order has at most a few dozen lines)."""
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return table(spark, folder, "lineitem").withColumn("rn", rn)


def invoice_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Text boxes of one invoice scan per order: a header line and four columns, slightly shaken."""
    lines = invoice_lines(spark, folder)
    # Eight places beside each line, the header's four for the first line only: a broadcast join keeps the order of the lines, so
    # the boxes of an image come together and are not sorted again, which ``explode`` would ask for.
    place = spark.range(8).select((F.col("id") >= 4).alias("head"), (F.col("id") % 4).cast("int").alias("c"))
    spread = lines.join(F.broadcast(place), ~F.col("head") | (F.col("rn") == 1))
    c, title = F.col("c"), F.col("head")
    text = (
        F.when(title, F.element_at(F.array(*[F.lit(t) for t in ("Item", "Flag", "Qty", "Amount")]), c + 1))
        .when(c == 0, F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
        .when(c == 1, F.col("l_returnflag"))
        .when(c == 2, F.col("l_quantity").cast("int").cast("string"))
        .otherwise(F.format_number("l_extendedprice", 2))
    )
    flat = spread.select(F.col("l_orderkey").alias("image_id"), F.when(title, 0).otherwise(F.col("rn")).alias("rn"), "c", text.alias("text"))
    shake = ((F.col("image_id") * 7 + F.col("rn") * 3 + F.col("c") * 5) % 6).cast("int")
    boxed = flat.select(
        "image_id", "rn", "c",
        (F.col("rn") * 10 + F.col("c")).cast("bigint").alias("block_id"), "text",
        (F.col("c") * 200 + 10 + shake).alias("x0"), (F.col("rn") * 50 + 10 + shake).alias("y0"),
    )
    return boxed.select(
        "image_id", "block_id", "text", "x0", "y0", (F.col("x0") + 80).alias("x1"), (F.col("y0") + 28).alias("y1"),
        (F.lit(0.5) + (F.col("block_id") % 50) / 100).alias("confidence"),
    )


def headless_blocks(blocks: DataFrame) -> DataFrame:
    """Every third invoice without its header line."""
    return blocks.where((F.col("image_id") % 3 != 0) | (F.col("block_id") >= 10))


def doubled_blocks(blocks: DataFrame) -> DataFrame:
    """Every box read twice, the second time one pixel off and a little less sure."""
    again = F.array(F.lit(0), F.lit(1))
    two = blocks.withColumn("k", F.explode(again))
    return two.select(
        "image_id", (F.col("block_id") * 2 + F.col("k")).alias("block_id"), "text",
        *[(F.col(c) + F.col("k")).alias(c) for c in ("x0", "y0", "x1", "y1")],
        (F.col("confidence") - F.col("k") * 0.25).alias("confidence"),
    )


def gappy_blocks(blocks: DataFrame) -> DataFrame:
    """Some cells of the two middle columns left unread."""
    rn, c = F.floor(F.col("block_id") / 10), F.col("block_id") % 10
    return blocks.where(~(((rn + c + F.col("image_id")) % 11 == 0) & c.isin(1, 2)))


def invoice_images(spark: SparkSession, folder: str, scale: int = 1) -> DataFrame:
    """``image_id, width, height, line_height`` per order, optionally enlarged."""
    counted = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "image_id", F.lit(810 * scale).alias("width"), (((F.col("n") + 1) * 50 + 20) * scale).cast("int").alias("height"),
        F.lit(28.0).alias("line_height"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("doc"), (F.col("doc_id") % 50).cast("string"), F.lit("."), ext)
    return d.select(
        "doc_id", F.concat_ws("/", F.lit("/in"), "source", "lang", name).alias("path"), name.alias("name"),
        F.when(F.col("doc_id") % 37 == 0, 0).otherwise(F.col("n_chars")).cast("bigint").alias("length"),
        F.col("doc_id").alias("seq"),
    )


def documents_as_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: page count, flags and a page selection."""
    d = table(spark, folder, "documents")
    spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        "doc_id", F.col("source").alias("merge_id"), F.col("doc_id").alias("ord"),
        F.ceil(F.length("text") / PAGE_CHARS).cast("int").alias("page_count"),
        (F.col("doc_id") % 41 == 0).alias("encrypted"), spec.alias("spec"),
    )


def doc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text of every document in pages of 1 000 characters; some pages are scans."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    last = F.ceil(F.length("text") / PAGE_CHARS).cast("int")
    # Cut inside the row, so that the whole text is not copied once per page.
    pieces = F.transform(
        F.sequence(F.lit(1), last), lambda p: F.struct(p.alias("no"), F.substring(F.col("text"), (p - 1) * PAGE_CHARS + 1, F.lit(PAGE_CHARS)).alias("text"))
    )
    numbered = d.where(F.length("text") > 0).select("doc_id", last.alias("page_count"), F.explode(pieces).alias("p")).select(
        "doc_id", "page_count", F.col("p.no").alias("page_no"), F.col("p.text").alias("whole")
    )
    whole = F.col("whole")
    scan = (F.col("doc_id") + F.col("page_no")) % 5 == 0
    return numbered.select(
        "doc_id", "page_no", "page_count", F.when(scan, "").otherwise(whole).alias("page_text"), whole.alias("full_text"),
        F.when(scan | (F.col("page_no") % 3 == 0), 1).otherwise(0).alias("images"),
        F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), (90 * (F.col("doc_id") % 4)).cast("int").alias("rotation"),
    ).withColumn("characters", F.length("page_text"))


def recognised_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("doc_id") % 7 != 0).select("doc_id", "page_no", F.col("full_text").alias("ocr_text"))


STATUS_OF_EVENT = {"purchase": "succeeded", "click": "succeeded", "error": "failed", "view": "skipped", "signup": "cancelled"}


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    status = F.lit(None).cast("string")
    for event, word in STATUS_OF_EVENT.items():
        status = F.when(F.col("event_type") == event, word).otherwise(status)
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("task_id"), F.col("event_id").alias("seq"), "ts",
        F.concat(F.lit("file"), F.col("event_id").cast("string")).alias("file_name"), status.alias("status"),
        (F.col("event_id") % 100).cast("double").alias("progress"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("broken input "), F.col("event_id").cast("string"))).alias("error"),
        (F.col("event_id") * 100).alias("bytes_in"),
    ).withColumn("bytes_out", F.floor(F.col("bytes_in") * 7 / 10).cast("bigint"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "event_type")
    ok = F.col("event_type") != "error"
    return e.select(
        F.floor(F.col("event_id") / 3).cast("bigint").alias("file_id"), (F.col("event_id") % 3).cast("int").alias("ord"), ok.alias("ok"),
        F.concat(F.lit("engine"), (F.col("event_id") % 3).cast("string")).alias("engine"),
        F.when(~ok, F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
    )


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's lines in pieces of three; a later piece repeats the line before it."""
    lines = invoice_lines(spark, folder)
    piece = F.floor((F.col("rn") - 1) / 3).cast("int")
    lines = lines.withColumn("__last", F.max("rn").over(W.partitionBy("l_orderkey")))
    goes_on = (F.col("rn") % 3 == 0) & (F.col("rn") < F.col("__last"))
    at = F.when(goes_on, F.array(F.struct(piece.alias("f"), F.lit(1).alias("own")), F.struct((piece + 1).alias("f"), F.lit(0).alias("own")))).otherwise(
        F.array(F.struct(piece.alias("f"), F.lit(1).alias("own")))
    )
    spread = lines.select("*", F.explode(at).alias("a"))
    changed = (F.col("l_orderkey") % 9 == 0) & (F.col("a.f") >= 2)
    row = F.struct("rn", F.array(F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("rn").cast("string")), F.format_number("l_extendedprice", 2)).alias("cells"))
    return (
        spread.groupBy(
            F.col("l_orderkey").alias("image_id"), F.col("a.f").cast("bigint").alias("frag_no"), F.lit("Invoice").alias("title"),
            F.when(changed, F.array(F.lit("Item"), F.lit("Sum"))).otherwise(F.array(F.lit("Item"), F.lit("Amount"))).alias("headers"),
        )
        .agg(F.array_sort(F.collect_list(row)).alias("r"))
        .select("image_id", "frag_no", "title", "headers", F.transform("r", lambda e: e["cells"]).alias("rows"))
    )


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """A model's JSON per order: plain, fenced, with words around it, or cut off."""
    row = F.concat(F.lit('["P'), F.col("l_partkey").cast("string"), F.lit('","'), F.format_number("l_extendedprice", 2), F.lit('"]'))
    # The rows of an order are collected beside its first line, on the sort that numbers the lines: no aggregate, and the answers
    # come in order. Numbered first, or the texts would be made ahead of the exchange.
    order = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    orders = invoice_lines(spark, folder).withColumn("rows", F.collect_list(row).over(order)).where("rn = 1")
    body = F.array_join("rows", ",")
    orders = orders.withColumn("text", F.concat(F.lit('{"tables":[{"title":"Invoice","headers":["Item","Amount"],"rows":['), body, F.lit("]}]}")))
    text = F.col("text")
    kind = F.col("l_orderkey") % 4
    return orders.select(
        F.col("l_orderkey").alias("image_id"), F.lit(0).alias("tile_id"),
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), text, F.lit(" Done.")))
        .otherwise(F.substring(text, F.lit(1), F.length(text) - 3)).alias("answer"),
    )


def raw_texts() -> list[Column]:
    """Six texts per line: grouped price, percent, plain number, id with a zero, bracketed number, word."""
    return [
        F.format_number("l_extendedprice", 2),
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")),
        F.col("l_quantity").cast("int").cast("string"),
        F.concat(F.lit("00"), F.col("l_linenumber").cast("string")),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), F.format_number("l_partkey", 0), F.lit(")"))).otherwise(F.format_number("l_partkey", 0)),
        F.col("l_linestatus"),
    ]


def raw_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The six texts of every line as cells."""
    lines = invoice_lines(spark, folder)
    return lines.select(F.col("l_orderkey").alias("case_id"), F.col("rn").alias("row"), F.posexplode(F.array(*raw_texts())).alias("col", "text"))


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``raw_cells`` with the cells of a line side by side: ``case_id, row, t0 .. t5``."""
    lines = invoice_lines(spark, folder)
    return lines.select(F.col("l_orderkey").alias("case_id"), F.col("rn").alias("row"), *[text.alias(f"t{i}") for i, text in enumerate(raw_texts())])


def damaged_rows(rows: DataFrame) -> DataFrame:
    """A reading of ``raw_rows`` with faults: some texts changed, some rows lost."""
    texts = [c for c in rows.columns if c not in ("case_id", "row")]
    damaged = {c: F.when(F.col("row") % 10 == 0, F.concat(F.col(c), F.lit("x"))).otherwise(F.col(c)) for c in texts}
    return rows.where(F.col("row") % 17 != 0).withColumns(damaged)


def preset_changes(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_type").alias("action"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"),
        F.col("props").alias("params"), F.col("event_id").alias("updated"),
        F.concat(F.lit("id"), F.col("event_id").cast("string")).alias("new_id"),
    )


def result_cache(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return (
        d.where(F.col("doc_id") % 2 == 0)
        .groupBy(F.sha2("text", 256).alias("key"))
        .agg(
            F.min_by(F.concat(F.lit("result of "), F.col("doc_id").cast("string")), "doc_id").alias("value"),
            F.min("doc_id").alias("created"),
        )
        .withColumns({"hits": F.lit(0).cast("bigint"), "last_hit": F.lit(None).cast("bigint")})
    )


def cache_requests(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("request_id"), F.sha2("text", 256).alias("key"), F.col("doc_id").alias("at"))
