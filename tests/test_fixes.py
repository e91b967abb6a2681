"""Small inputs on which a rule shows: long numbers, repeated keys, odd answers, missing headers, late events."""

from decimal import Decimal

from pyspark.sql import functions as F

from gridleaf.functions import cells as C
from gridleaf.functions import text as T
from gridleaf.operators import files, grids, jobs, store
from gridleaf.plans.invoices import invoice_totals
from gridleaf.streaming import feeds

LONG = 9007199254740993


def test_long_numbers_keep_their_digits(spark):
    raws = ["123456789012345678", "(9,007,199,254,740,993)", "1" * 40, "12.5", "9007199254740993%"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", C.parse_cell(F.col("raw")).alias("c"), C.coerce_simple(F.col("raw")).alias("s")).collect()
    got = {r.raw: (r.c.whole, r.c.text) for r in rows}
    assert got[raws[0]] == (Decimal(raws[0]), None) and got[raws[1]] == (Decimal(-LONG), None) and got[raws[2]] == (None, raws[2])
    assert got["12.5"] == (None, None) and got[raws[4]] == (None, None)
    assert {r.raw: r.s.whole for r in rows}[raws[0]] == Decimal(raws[0])


def test_template_positions(spark):
    values = F.create_map(F.lit("page"), F.lit("7"))
    for template, want in [("{} {page}", "{} {page}"), ("{0}{page}", "{0}{page}"), ("{page} {who}", "7 {who}")]:
        assert spark.range(1).select(T.expand_template(F.lit(template), values)).first()[0] == want


def test_upsert_writes_in_order(spark):
    old = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, name string, status string")
    new = spark.createDataFrame([(1, "x", "late", 2), (1, "y", "early", 1), (3, "q", None, 2), (3, "p", "early", 1)], "k int, name string, status string, at int")
    got = {r.k: (r.name, r.status) for r in jobs.upsert(old, new, "k", ["status"], "at").collect()}
    assert got == {1: ("a", "late"), 2: ("b", "old"), 3: ("p", None)} and jobs.upsert(old, new.drop("at"), "k", ["status"]).count() == 3


def test_rows_pass_unchanged(spark):
    rows = spark.createDataFrame([(LONG, "1"), (None, "x"), (LONG + 2, "3")], "id bigint, text string")
    got = jobs.run_isolated(rows, lambda r: f"{r['id']}/{int(r['text'])}").collect()
    assert {(r.id, r.result, r.status) for r in got} == {(LONG, f"{LONG}/1", "succeeded"), (None, None, "failed"), (LONG + 2, f"{LONG + 2}/3", "succeeded")}
    events = spark.createDataFrame([("t", i * 50, i, False, LONG + i if i % 3 else None) for i in range(9)], "task_id string, ts_ms bigint, seq bigint, forced boolean, extra bigint")
    assert {(r.seq, r.extra) for r in feeds.throttle(events).collect()} == {(i, LONG + i if i % 3 else None) for i in range(0, 9, 2)}


def test_answers_are_not_lost(spark):
    table = '{"tables":[{"title":"t"}]}'
    cases = {f"3 tables found: {table}": "t", f"[1,2] and {table}": "t", table: "t", f"{table} {table}": None, "7 of 9": None, "[1,2]": None, "": None, "5": None}
    parsed = grids.parse_json_lenient(spark.createDataFrame([(c,) for c in cases], "answer string"), "answer")
    rows = parsed.select("answer", "error", F.to_json("value").alias("value"), F.try_variant_get("value", "$.tables[0].title", "string").alias("title")).collect()
    assert {r.answer: r.title for r in rows} == cases and all((r.value is None) == (r.error is not None) for r in rows)
    assert {r.answer: r.value for r in rows}["[1,2]"] == '{"data":[1,2]}'


def test_decimals_as_written(spark):
    got = spark.range(1).select(grids.exact_decimals(F.lit('{"a": 2.0, "b\\" 1.5": ["x 3.0", 4, 1.50, -0.10, 1e3]}'))).first()[0]
    assert got == '{"a": "2.0", "b\\" 1.5": ["x 3.0", 4, "1.50", "-0.10", "1e3"]}'


def test_invoice_without_header(spark):
    blocks = [(1, r * 10 + c, t, c * 200, r * 50, c * 200 + 80, r * 50 + 28) for r in range(3) for c, t in enumerate((f"P{r}", "A", "4", f"{(r + 1) * 100}.00"))]
    got = invoice_totals(spark.createDataFrame(blocks, "image_id long, block_id long, text string, x0 int, y0 int, x1 int, y1 int")).first()
    assert (got.lines, got.total) == (3, 600.0)


def test_nothing_vanishes(spark):
    presets = spark.createDataFrame([("a", "  ", "p", 1, "i1"), ("a", "n" * 41, "p", 2, "i2"), ("a", None, "p", 3, "i3"), ("a", "ok", "p", 4, "i4")], "action string, name string, params string, updated int, new_id string")
    assert {r.new_id: r.error for r in store.refused_presets(presets).collect()} == {"i1": "empty name", "i2": "name too long", "i3": "empty name"}
    assert store.save_presets(presets).count() == 1
    rows = spark.createDataFrame([("a", "x" * 11, 1), ("b", None, 1), ("c", "ok", 1)], "key string, value string, created int")
    assert {r.key: r.reason for r in store.cache_refused(rows, 10).collect()} == {"a": "value too long", "b": "no value"}
    deep = spark.createDataFrame([("/in/" + "d/" * 20 + "f.txt", 5)], "path string, length bigint")
    assert files.file_inventory(deep, "/in").count() == 1 and files.file_inventory(deep, "/in", max_depth=12).count() == 0


def plain_rows(boxes, tolerance=0.35):
    """The greedy rule, box by box: by (y0, x0, y1), into the first row with a member that it overlaps."""
    rows, at = [], {}
    for b in sorted(set(boxes)):
        for i, row in enumerate(rows):
            if any(min(b[2], m[2]) - max(b[0], m[0]) > 0 and (min(b[2], m[2]) - max(b[0], m[0])) / max(1, min(b[2] - b[0], m[2] - m[0])) >= tolerance for m in row):
                row.append(b)
                at[b] = i
                break
        else:
            at[b] = len(rows)
            rows.append([b])
    return at


def test_dense_rows_match_the_rule(spark):
    import random

    random.seed(3)
    images = {i: [(random.randrange(200), random.randrange(300), 0) for _ in range(60)] for i in range(6)}
    images = {i: [(y, x, y + random.choice([8, 14, 20, 28, 90])) for y, x, _ in bs] for i, bs in images.items()}
    blocks = [(i, n, "t", x, y, x + 40, y1) for i, bs in images.items() for n, (y, x, y1) in enumerate(bs)]
    frame = spark.createDataFrame(blocks, "image_id long, block_id long, text string, x0 int, y0 int, x1 int, y1 int")
    want = {i: plain_rows(bs) for i, bs in images.items()}
    got = grids.group_rows(frame).collect()
    assert len(got) == len(blocks) and all(r.row == want[r.image_id][(r.y0, r.x0, r.y1)] for r in got)


def test_dense_band_is_quick(spark):
    import time

    frame = spark.range(20_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("block_id"), F.lit("t").alias("text"), (F.col("id") % 7 * 100).cast("int").alias("x0"), (F.col("id") * 3).cast("int").alias("y0"))
    frame = frame.withColumns({"x1": F.col("x0") + 80, "y1": F.col("y0") + 28})
    start = time.time()
    assert tuple(grids.group_rows(frame).agg(F.max("row"), F.count("row")).first()) == (0, 20_000)  # each box overlaps the next
    assert time.time() - start < 60
