"""Steps over whole images: rules at missing edges, and plans that sort the boxes once."""

import pytest
from pyspark.sql import functions as F

from gridleaf.operators import grids, layout
from gridleaf.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
BLOCK = "image_id long, block_id long, text string, x0 int, y0 int, x1 int, y1 int, confidence double"


def steps(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    count = lambda word: sum(line.lstrip(" :+-*(0123456789)").startswith(word) for line in plan.splitlines())
    return {w: count(w) for w in ("Exchange", "Sort ", "Window", "ObjectHashAggregate", "SortAggregate", "MapInArrow", "ArrowEvalPython")}


#: Exchanges of each query (the first one numbers the lines) and sorts of boxes or cells.
PLANS = {"table_summary": (3, 2), "guess_header_row": (2, 2), "invoice_totals": (2, 2), "blocks_to_grid": (1, 2), "group_rows": (1, 2), "reading_order": (1, 2), "page_text": (2, 3), "detect_columns": (1, 2)}


@pytest.mark.parametrize("name", PLANS)
def test_boxes_are_sorted_once(spark, name):
    """Windows over boxes and lists of them sorted the boxes up to seven times, which spilled."""
    found = steps(QUERIES[name](spark, DATA))
    assert found["ObjectHashAggregate"] == found["SortAggregate"] == found["ArrowEvalPython"] == 0 and found["Window"] == 1
    assert (found["Exchange"], found["Sort "]) <= PLANS[name] and found["Sort "] <= PLANS[name][1]


def test_a_dense_row_is_made_on_one_exchange_of_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2, "c"), (1, 4, 1, None), (2, 0, 1, "x"), (None, 3, 0, "n")], "image_id long, row int, col int, text string")
    dense = grids.dense_rows(cells)
    assert sorted((r.image_id or 0, r.row, r.cells) for r in dense.collect()) == [(0, 3, ["n"]), (1, 0, ["a", "", "c"]), (1, 4, ["", "", ""]), (2, 0, ["", "x"])]
    assert steps(dense)["ObjectHashAggregate"] == 0
    with pytest.raises(Exception, match="two cells"):
        grids.dense_rows(cells.union(cells)).collect()


def test_a_box_without_a_bottom_is_a_row_of_its_own(spark):
    """It once joined a band in which every box overlaps the first."""
    rows = [(1, 0, "a", 0, 0, 10, 20, 1.0), (1, 1, "b", 20, 1, 30, None, 1.0), (1, 2, "c", 40, 2, 50, 22, 1.0)]
    got = {r.block_id: r.row for r in grids.group_rows(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_images_across_batches(spark):
    """Images longer than an Arrow batch and many small ones give the same rows, columns and order as each alone."""
    frame = spark.range(60_000).select(
        F.when(F.col("id") < 40_000, 7).otherwise(F.col("id") % 5000).cast("long").alias("image_id"), F.col("id").alias("block_id"), F.lit("t").alias("text"),
        (F.col("id") % 4 * 100).cast("int").alias("x0"), (F.floor(F.col("id") / 4) * 30).cast("int").alias("y0"),
    )
    frame = frame.withColumns({"x1": F.col("x0") + 80, "y1": F.col("y0") + 28, "confidence": F.lit(1.0)}).where("image_id <> 7 or block_id < 40000")
    placed = grids.place_blocks(frame).where("image_id = 7")
    assert placed.where("row <> block_id div 4 or col <> block_id % 4").count() == 0 and placed.count() == 40_000
    ordered = layout.reading_order(frame).where("image_id = 7")
    assert ordered.where("pos <> block_id or line <> block_id div 4").count() == 0 and ordered.count() == 40_000


def test_columns_across_batches(spark):
    """One image of many batches; copies of a span and a gap of exactly six pixels. The plan keeps no map of all spans."""
    rows = spark.range(50_000).select((F.col("id") % 2).alias("image_id"), (F.col("id") % 5000 * 20).cast("int").alias("x0")).withColumn("x1", F.col("x0") + F.when(F.col("x0") % 40 == 0, 14).otherwise(15))
    wide = grids.detect_columns(rows)
    got = {(r.image_id, r.col): (r.x0, r.x1) for r in wide.collect()}
    want, spans = {}, {}
    for r in rows.distinct().orderBy("image_id", "x0").collect():
        mine = spans.setdefault(r.image_id, [])
        if mine and r.x0 - mine[-1][1] < 6:
            mine[-1][1] = r.x1
        else:
            mine.append([r.x0, r.x1])
    want = {(i, k): tuple(s) for i, mine in spans.items() for k, s in enumerate(mine)}
    assert got == want and len(want) == 5000 and steps(wide)["Window"] == 0


def test_readings_over_whole_images_match_the_fold():
    """Zones of two are decided together as the fold of each image decides them; it was the only way before."""
    import random

    import numpy as np
    import pyarrow as pa

    from gridleaf.operators.folds import kept_of_images, kept_readings

    random.seed(11)
    rows = []
    for image in range(300):
        for b in range(random.choice([1, 2, 2, 3, 20])):
            x, y = random.randrange(120), random.randrange(120)
            box = (x, y, x + random.choice([3, 10, 20]), y + random.choice([8, 12, 30]))
            key = random.choice(["a", "ab", "It", "Item", "7x"])
            rows.append((image, 2 * b, key, *box, random.choice([0.5, 0.9, None]), key))
            if random.random() < 0.5:
                rows.append((image, 2 * b + 1, key, *[v + random.choice([0, 1]) for v in box], 0.25, key))
    names = ["image_id", "block_id", "text", "x0", "y0", "x1", "y1", "confidence", "key"]
    batch = pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows))})
    starts = np.unique([r[0] for r in rows], return_index=True)[1]
    got = {rows[k][:2] for k in kept_of_images(batch, starts, 0.3, 0.75, 6).tolist()}
    want = set()
    for image in range(300):
        boxes = [(r[7], r[1], r[8], r[2], *r[3:7]) for r in rows if r[0] == image]
        want |= {(image, b[1]) for b in kept_readings(boxes, 0.3, 0.75, 6)}
    assert got == want and len(got) < len(rows)


def test_a_parameter_is_cut_and_stripped_once(spark):
    """Each output used to cut, strip and match the text again."""
    plan = QUERIES["parse_param"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") <= 3 and plan.count("RLIKE") <= 4 and plan.count("instr(") == 1
