"""What keeps a query's memory and time in proportion to its input: plans, and steps that ran more than once for a row."""

import unicodedata

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gridleaf.functions import cells as C
from gridleaf.functions import text
from gridleaf.operators import evaluate, jobs, layout
from gridleaf.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["guess_header_row", "invoice_totals", "blocks_to_grid", "reading_order"])
def test_boxes_are_not_sorted_again(spark, name):
    """The lines of an image are in order when its boxes are made, so the only sort of the plan is that of the lines."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1, plan
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1, plan


def test_an_edge_is_made_once(spark):
    """``polygon_to_box`` rounds four edges of a polygon, each once, also where a box without a width is left out."""
    plan = QUERIES["polygon_to_box"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rint(") + plan.count("bround(") == 4, plan


def test_unusable_polygons(spark):
    point = "array<struct<x:double,y:double>>"
    rows = [
        (1, [(1.0, 2.0), (4.0, 9.0)], 0.5), (2, [], 1.0), (3, None, 1.0), (4, [(1.0, None), (4.0, 9.0)], 1.0), (5, [None, (4.0, 9.0)], 1.0),
        (6, [(1.0, 2.0), (4.0, 9.0)], None), (7, [(1.0, 2.0), (1.4, 9.0)], 1.0), (8, [(3.0, -5.0), (5.0, 5.0), (4.0, 9.0)], 0.5),
    ]
    frame = spark.createDataFrame([(1, i, "t", p, s, "x") for i, p, s in rows], f"image_id long, block_id long, text string, points {point}, scale double, score string")
    got = {r.block_id: (r.x0, r.y0, r.x1, r.y1, r.confidence) for r in layout.polygon_to_box(frame).collect()}
    assert got == {1: (0, 1, 2, 4, 1.0)}  # the last: 1.5 and 2.5 are both 2, no width


def test_records_of_isolated_rows(spark):
    """A record has plain Python values, whatever way its columns are read."""
    rows = [(1, None, "a", 1.5, [1, None], True), (None, 2, None, None, None, None), (3, 4, "", 0.0, [], False)]
    frame = spark.createDataFrame(rows, "a long, b int, c string, d double, e array<int>, f boolean").repartition(1)
    got = jobs.run_isolated(frame, repr).orderBy("result").collect()
    assert sorted(r.result for r in got) == sorted(repr(dict(zip("abcdef", r))) for r in rows)
    assert {r.status for r in got} == {"succeeded"} and all(r.error is None and r.duration_ms >= 0 for r in got)
    failed = jobs.run_isolated(frame, lambda r: str(1 / r["a"])).collect()
    assert [r.error for r in failed if r.a is None] == ["TypeError: unsupported operand type(s) for /: 'int' and 'NoneType'"]


def test_nfkc_takes_arrow_arrays(spark):
    """The texts of a batch are not all Python objects at once: the function gets Arrow arrays, in pieces."""
    rows = [(i, None if i % 7 == 0 else "Ａ①é" * (i % 3) + "ﬁ") for i in range(500)]
    frame = spark.createDataFrame(rows, "i long, t string").repartition(1).withColumn("k", text.nfkc(F.col("t")))
    assert {r.i: r.k for r in frame.collect()} == {i: t and unicodedata.normalize("NFKC", t) for i, t in rows}
    assert not hasattr(text, "pd")


@pytest.mark.parametrize("name", ["compare_grids", "top_mismatches", "eval_summary"])
def test_grids_meet_without_a_join_of_cells(spark, name):
    """Cells travel in runs by case and band of rows: no sorted join of single cells."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(case_id#") >= 1 and ", band#" in plan, plan


def test_cells_that_repeat_or_have_no_place(spark):
    """Cells meet as in a full outer join: repeats each with each, nulls with nothing; cells beyond a band and a run too."""
    want = [(1, 0, 0, "1,250"), (1, 0, 0, "b"), (None, 0, 0, "n"), (1, None, 0, "r"), (2, 0, 0, None), *[(3, r, 0, f"Ａ{r}" * (r % 90)) for r in range(600)]]
    got = [(1, 0, 0, "1250", "#,##0"), (1, 0, 0, "B", None), (None, 0, 0, "n", None), (1, None, 0, "r", None), (2, 1, 1, "x", ""), *[(3, r, 0, f"A{r}" * (r % 90), "") for r in range(599, -1, -1)]]
    expected = spark.createDataFrame(want, "case_id int, row int, col int, text string")
    actual = spark.createDataFrame(got, "case_id int, row int, col int, value string, fmt string")
    cells = evaluate.paired_cells(expected, actual)
    keys = ["case_id", "row", "col"]
    joined = expected.withColumnRenamed("text", "want").join(actual.withColumnRenamed("value", "got"), keys, "full_outer").select(*keys, "want", "got", "fmt")
    assert sorted(map(repr, cells.select(joined.columns).collect())) == sorted(map(repr, joined.collect()))
    assert {r.verdict for r in cells.where("case_id = 3").collect()} == {"exact"}


@pytest.mark.parametrize("name", ["compare_grids", "top_mismatches", "eval_summary"])
def test_cells_of_a_line_travel_together(spark, name):
    """A row on its way into Arrow is a line, not a cell, and no verdict is worked out in a lambda or a generator."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan, plan
    after = plan[: plan.index("MapInArrow")]
    assert "lambda" not in after and "explode(array(verdict" in after and after.count("RLIKE") > 2, plan


def test_grids_as_lists(spark):
    """Cells given as lists of a row meet like single cells; lists may be empty or null, cells and texts null."""
    want = [(1, 0, [0, 1, 2], ["1,250", "a", None]), (1, 1, [], []), (1, 2, None, None), (2, 0, [0, None, 0], ["x", "y", "z"]), (None, 0, [0], ["n"]), *[(3, r, [0, 7], [f"Ａ{r}", "5%"]) for r in range(600)]]
    got = [(1, 0, [2, 0], ["", "1250"], [None, "#,##0"]), (2, 0, [0, 5], ["X", None], ["", None]), *[(3, r, [7, 0], ["0.05", f"A{r}"], ["0%", None]) for r in range(599, -1, -1)]]
    expected = spark.createDataFrame(want, "case_id int, row int, col array<int>, text array<string>")
    actual = spark.createDataFrame(got, "case_id int, row int, col array<int>, value array<string>, fmt array<string>")
    place = ["case_id", "row"]
    single = [
        expected.select(*place, F.explode(F.arrays_zip("col", "text")).alias("c")).select(*place, "c.*"),
        actual.select(*place, F.explode(F.arrays_zip("col", "value", "fmt")).alias("c")).select(*place, "c.*"),
    ]
    for work in (evaluate.paired_cells, evaluate.compare_grids, evaluate.top_mismatches):
        rows = sorted(map(repr, work(*single).collect()))
        assert rows and sorted(map(repr, work(expected, actual).collect())) == rows == sorted(map(repr, work(single[0], actual).collect()))
    dense = expected.where("case_id = 3").withColumn("col", F.array(F.lit(0), F.lit(1)))
    both = [sorted(map(repr, evaluate.paired_cells(e, actual).collect())) for e in (dense, dense.drop("col"))]
    assert both[0] == both[1]
    with pytest.raises(Exception, match="differ in length"):
        evaluate.paired_cells(expected.select(*place, "col", F.array(F.lit("x")).alias("text")), actual).collect()


def test_equal_texts_stay_where_they_met(spark):
    """Only expected cells whose text is another leave the meeting for the list of mismatches, which is that of all pairs."""
    texts = ["1,250", "1250", "1250.0", "1e400", "inf", "INF", "-0", "0", " a", "A", "a b", "", " ", ",", None, "Ａ", "５", "5", "1.2500000001", "1.25", "nan", "NaN", "é", "É", "¥5", "￥5", "(5)", "5%"]
    pairs = [(i, j, w, g) for i, w in enumerate(texts) for j, g in enumerate(texts)]
    frame = spark.createDataFrame(pairs, "case_id int, row int, want string, got string").withColumn("col", F.lit(0))
    expected = frame.select("case_id", "row", "col", F.col("want").alias("text"))
    actual = frame.select("case_id", F.col("row"), "col", F.col("got").alias("value"), F.lit("0").alias("fmt")).where("row % 5 != 4")
    more = actual.unionByName(actual.where("row = 1").withColumn("col", F.lit(9)))
    cells = evaluate.paired_cells(expected, more)
    same = C.value_key(F.col("want")) == C.value_key(F.col("got"))
    judged = cells.select("verdict", same.alias("same")).distinct().collect()
    assert all((r.verdict in ("exact", "format", "value")) == r.same for r in judged) and len({r.verdict for r in judged}) == 5
    listed = cells.where("has_want and verdict in ('missing', 'wrong', 'format')")
    left = evaluate._pairs(expected, more, True, differ=True)
    assert left.where("not has_want or want <=> got").count() == 0 and listed.count() <= left.count() < len(pairs)
    top = evaluate.top_mismatches(expected, more, k=100).drop("nth")
    assert sorted(map(repr, top.collect())) == sorted(map(repr, listed.select(top.columns).collect()))


def test_common_numbers_are_read_as_by_all_steps(spark):
    """``parse_cell`` tells most texts by a pattern; whatever it tells, the steps tell too."""
    bodies = ["0", "00", "01", "7", "0.5", "12.340", "1,234", "1,23", "0,123", "1234,567", "1,234,567.80", ".5", "5.", "1.2.3", "1e3", "x", "-", "", "123456789012345", "1234567890123456", "9" * 39, "1,234,567,890,123,456", "٣", "1 2"]
    texts = [None, *[f"{a}{b}{c}" for a in ("", "-", "+", "(", "$", "￥", "-$", "$-", "$(", " ", "(-") for b in bodies for c in ("", ")", "%", ")%", "%)", "x", "$", "\n", ",")]]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.parse_cell(F.col("t")).alias("quick"), C._parts(F.col("t")).alias("whole"))
    assert [r for r in frame.select("t", F.col("quick").cast("string").alias("q"), F.col("whole").cast("string").alias("w")).collect() if r.q != r.w] == []
    kinds = frame.select(F.count_if(F.col("t").rlike(C.COMMON)), F.count_if(F.col("t").rlike(C.NEVER)), F.count_if(F.col("t").rlike(C.COMMON) & F.col("t").rlike(C.NEVER))).first()
    assert kinds[0] > 100 and kinds[1] > 100 and kinds[2] == 0
