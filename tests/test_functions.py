"""Exact answers for cells, texts, page lists and geometry."""

import pytest
from pyspark.sql import functions as F

from gridleaf.functions import cells as C
from gridleaf.functions import geometry as G
from gridleaf.functions import pageranges as R
from gridleaf.functions import text as T


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


CELLS = [
    ("9,407", 9407, "#,##0"), ("86", 86, "0"), ("3.75", 3.75, "0.00"), ("¥7,020.5", 7020.5, '"¥"#,##0.0'), ("$81,300.00", 81300, '"$"#,##0.00'),
    ("40%", 0.4, "0%"), ("0.25%", 0.0025, "0.00%"), ("-6,001", -6001, "#,##0"), ("+5", 5, "0"), ("(88)", -88, "0;#,##0"), ("0042", None, None), ("00", None, None),
    ("A-17", None, None), ("乙,丙", None, None), ("12:30", None, None), (" ", None, None), ("1,2345", None, None), ("12,345,678.9", 12345678.9, "#,##0.0"),
    ("€ 5", 5, '"€"0'), (" £1,000 ", 1000, '"£"#,##0'), ("1,23", None, None), ("0.5", 0.5, "0.0"), ("($2,000.50)", -2000.5, '"$"#,##0.00;#,##0.00'),
    ("1.", 1, "0"), ("5 %", 0.05, "0%"), ("()", None, None), ("1.2.3", None, None), ("￥9", 9, '"￥"0'), ("0", 0, "0"), ("　3　", 3, "0"),
]


def test_parse_cell(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CELLS)], "i int, raw string")
    for row in rows.withColumn("c", C.parse_cell(F.col("raw"))).collect():
        raw, num, fmt = CELLS[row["i"]]
        got = row["c"]
        assert (got["num"], got["fmt"]) == (num, fmt), raw
        assert got["text"] == (None if num is not None else raw)


def test_coerce_simple(spark):
    cases = {"1,2,3": 123, "007": None, "1.5": 1.5, "12%": None, "": None, "x": None, "-4": -4}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    for row in rows.withColumn("c", C.coerce_simple(F.col("raw"))).collect():
        assert row["c"]["num"] == cases[row["raw"]]


PARAMS = [
    ("title=Ærø 7", ("title", "Ærø 7")), ("dpi=300", ("dpi", 300)), ("ratio=-0.75", ("ratio", -0.75)), ("keep=TRUE", ("keep", True)), ("keep=yes", ("keep", True)),
    ("keep=On", ("keep", True)), ("keep=False", ("keep", False)), ("keep=NO", ("keep", False)), ("keep=Off", ("keep", False)), ("  name =  two words  ", ("name", "two words")),
    ("zip=01234", ("zip", "01234")), ("n=0", ("n", 0)), ("n=+12", ("n", 12)), ("rule=x==y", ("rule", "x==y")), ("note=   ", ("note", "")), ("size=2e-2", ("size", 0.02)),
    ("only a name", None), ("=5", None), (" = ", None), ("", None),
]


def test_parse_param(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PARAMS)], "i int, raw string")
    for row in rows.withColumn("p", C.parse_param(F.col("raw"))).collect():
        raw, want = PARAMS[row["i"]]
        p = row["p"]
        if want is None:
            assert p["error"] and p["key"] is None, raw
            continue
        value = {"bool": p["flag"], "int": p["whole"] and int(p["whole"]) or 0 if p["kind"] == "int" else None, "float": p["real"], "text": p["text"]}[p["kind"]]
        assert (p["key"], value) == want and type(value) is type(want[1]), raw


PAGE_LISTS = [
    ("all", 3, [1, 2, 3]), ("  ", 4, [1, 2, 3, 4]), (None, 2, [1, 2]), ("*", 2, [1, 2]), ("4-6", 9, [4, 5, 6]), ("7,2,4", 8, [2, 4, 7]), ("5-", 7, [5, 6, 7]), ("-2", 6, [1, 2]),
    ("6-4", 9, []), ("two", 3, []), ("2-40", 4, [2, 3, 4]), ("3-4,", 6, [3, 4]), (",,2,,", 3, [2]), ("1, ?, 2-3", 5, [1, 2, 3]), ("4，2", 5, [2, 4]), ("0,8", 7, []),
    ("5-6,1-2,2-3", 9, [1, 2, 3, 5, 6]), ("2-3-4", 6, []), ("1", 0, []), ("--3", 5, []), ("99999999999999999999-", 5, []), ("1-99999999999999999999", 3, [1, 2, 3]),
]


def test_parse_page_range(spark):
    rows = spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate(PAGE_LISTS)], "i int, spec string, total int")
    got = rows.select("i", "total", R.page_ranges(F.col("spec"), F.col("total")).alias("r"), R.parse_page_range(F.col("spec"), F.col("total")).alias("p"))
    ranked = got.withColumn("n", R.selected_count(F.col("r"))).withColumn("rank", R.selected_rank(F.lit(3), F.col("r")))
    for row in ranked.collect():
        spec, _, want = PAGE_LISTS[row["i"]]
        assert row["p"] == want, spec
        assert row["n"] == len(want)
        assert row["rank"] == sum(p <= 3 for p in want)


def test_piece_ranges(spark):
    rows = spark.createDataFrame([("1-3,2, x,-2,all", 4)], "spec string, total int")
    got = rows.select(R.piece_ranges(F.col("spec"), F.col("total")).alias("p")).first()["p"]
    assert [(p["no"], p["label"], p["lo"], p["hi"]) for p in got] == [(1, "1_3", 1, 3), (2, "2", 2, 2), (3, "_2", 1, 2), (4, "all", 1, 4)]


def test_expand_template(spark):
    values = F.create_map(F.lit("page"), F.lit("3"), F.lit("file"), F.lit("{page}.pdf"))
    cases = {
        "{file} p{page}": "{page}.pdf p3", "{unknown}": "{unknown}", "{unclosed": "{unclosed", "{{x}}": "{x}", "a}": "a}", "{}": "{}", "{{{page}}}": "{3}", "": "",
    }
    for template, want in cases.items():
        assert one(spark, T.expand_template(F.lit(template), values)) == want, template


def test_text_helpers(spark):
    assert one(spark, T.strip(F.lit("　\xa0 a b\t\n"))) == "a b"
    assert one(spark, T.nfkc(F.lit("Ａ１ﬁ①"))) == "A1fi1"
    assert one(spark, T.normalize_text(F.lit(" Ｈｅ \n llo "))) == "he llo"
    assert one(spark, T.cell_key(F.lit("１，２ ５０"))) == "1,250"
    assert one(spark, T.language_hint(F.lit("中文文本 ab"))) == "zh"
    assert one(spark, T.language_hint(F.lit("hello 12"))) == "en"
    assert one(spark, T.language_hint(F.lit("123 !"))) == "auto"
    assert one(spark, T.language_hint(F.lit(""))) == "auto"
    assert one(spark, T.needs_cjk(F.lit("ａ"))) is True and one(spark, T.needs_cjk(F.lit("é"))) is False
    assert one(spark, T.display_width(F.lit("ab中"))) == 4
    assert one(spark, T.warning_summary(F.lit("s"), F.array(F.lit("w" * 50), F.lit("x")))) == "s · ⚠ " + "w" * 46 + "… (2 in all)"
    assert one(spark, T.warning_summary(F.lit("s"), F.array().cast("array<string>"))) == "s"
    lines = one(spark, T.structure_lines(F.lit("# A\r\n\n ####### B \x85c#")))
    assert [tuple(x) for x in lines] == [("heading", 1, "A"), ("heading", 6, "B"), ("paragraph", 0, "c#")]


@pytest.mark.parametrize(
    "value,want",
    [("#fff", (255, 255, 255, 255)), ("102030", (16, 32, 48, 255)), ("#10203040", (16, 32, 48, 64)), ("nope", (255, 255, 255, 255)), (None, (255, 255, 255, 255))],
)
def test_hex_color(spark, value, want):
    assert tuple(one(spark, T.hex_color(F.lit(value).cast("string")))) == want


def test_keys(spark):
    assert one(spark, C.value_key(F.lit("1,250"))) == one(spark, C.value_key(F.lit("1250.0")))
    assert one(spark, C.value_key(F.lit("1 月"))) == one(spark, C.value_key(F.lit("1月")))
    assert one(spark, C.value_key(F.lit("￥5"))) == one(spark, C.value_key(F.lit("5")))
    assert one(spark, C.format_key(F.lit(" 1,250\n x"))) == "1,250 x"
    for source, fmt, want in [("1,250", "#,##0", True), ("1,250", "0", False), ("18.50", "0.00", True), ("18.50", "0.0", False), ("$5", '"$"0', True), ("5%", "0%", True), ("5%", "0", False), ("", "", True)]:
        assert one(spark, C.display_matches(F.lit(source), F.lit(fmt))) is want, source


def test_geometry(spark):
    assert one(spark, G.max_tile_side(F.lit(0.0))) == 1300
    assert one(spark, G.model_scale(F.lit(2600), F.lit(100))) == 0.5
    assert one(spark, G.sanity_line_height(F.lit(0.0), F.lit(354))) == pytest.approx(354 * 0.012)
    assert one(spark, G.sanity_line_height(F.lit(500.0), F.lit(1000))) == 200.0
    extent = G.rotated_extent(F.lit(100.0), F.lit(20.0), F.lit(90.0))
    assert one(spark, extent["width"]) == pytest.approx(20.0)
    spots = one(spark, G.tile_centers(F.lit(100.0), F.lit(100.0), G.rotated_extent(F.lit(500.0), F.lit(500.0), F.lit(0.0)), F.lit(0.1)))
    assert [tuple(s) for s in spots] == [(50.0, 50.0)]
    params = F.create_map(F.lit("a"), F.lit(" 12 "), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("On"))
    assert one(spark, T.int_param(params, "a", 1)) == 12 and one(spark, T.int_param(params, "b", 1)) == 1
    assert one(spark, T.bool_param(params, "b", True)) is False and one(spark, T.bool_param(params, "z", True)) is True
    assert one(spark, T.bool_param(params, "c", False)) is True and one(spark, T.float_param(params, "c", 0.5)) == 0.5
