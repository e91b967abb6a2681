"""Model answers read in whole batches give what the column operators give, and a query reads them at most twice."""

import json
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gridleaf.functions.text import is_blank
from gridleaf.operators import answers as A
from gridleaf.operators import grids as G
from gridleaf.plans.queries import QUERIES

SCHEMA = "image_id long, tile_id int, answer string"
AWKWARD = [
    None, "", "no json", "[1]", "null", "5", "{}", '{"tables":null}', '{"tables":{}}', '{"tables":[]}', '{"tables":[7,null,[],{}]}',
    '{"tables":[{"headers":[],"rows":[]}]}', '{"tables":[{"headers":[],"rows":[[]]}]}', '{"tables":[{"headers":[null," "],"rows":[["x"]]}]}',
    '{"tables":[{"headers":"a","rows":[{"b":1,"a":{"z":[1,true,null,"\\u001f"],"b":"é"}},[2.50,-0,1e5],"s",null,false]}]}',
    '{"tables":[{"headers":["b","a","c"],"rows":[{"b":1,"a":null},{"c":[]},{}]}]}', '{"tables":[{"headers":[1,2.0],"rows":5}]}',
    '{"tables":[{"headers":["a"],"rows":[["1"]],"rows":[["2"]]}]}', '{"tables":[{"headers":["a"],"rows":[[{"x":1,"x":2}]]}]}',
    '{"tables":[{"headers":["a"],"rows":[[NaN]]}]}', '{"tables":[{"headers":["a"],"rows":[["\\ud83d\\ude00","\\ud800"]]}]}',
    '```json\n{"tables":[{"headers":["a"],"rows":[["1"]]}]}\n```', '```{"tables":[{"headers":["a"],"rows":[["1"]]}]}```', "```", "```\n```",
    ' 　see {"tables":[{"headers":["a"],"rows":[["1"]]}]}, well\xa0', '{"tables":[{"headers":["a"],"rows":[["1"]]}]} {}', '{"tables":[{"headers":["a"],"rows":[["1"]]',
    '{"tables":[{"headers":["a"],"rows":[["12345678901234567890123456"]]}], "n": 12345678901234567890123456}',
    '{"tables":[{"headers":["a"],"rows":[[12345678901234567890123456]]}]}', '}{"tables":[{"headers":["a"],"rows":[["1"]]}]}{', '{"tables":[{"headers":["a\tb"],"rows":[]}]}',
    '{"data":1,"tables":[{"headers":["H"],"rows":[["x"]]},{"headers":["Ｈ"],"rows":[["x"],["y"]]},{"headers":["J"],"rows":[["y"]]}]}',
]


def by_columns(answers):
    """``model_cells`` from ``model_tables`` and ``merge_fragments``."""
    merged = G.merge_fragments(G.model_tables(answers))
    titled = F.exists("headers", lambda h: ~is_blank(h))
    lines = F.when(titled & F.col("opens"), F.concat(F.array("headers"), F.col("rows"))).otherwise(F.col("rows"))
    start = F.col("first_row") + F.when(titled & ~F.col("opens"), 1).otherwise(0)
    spread = merged.select("image_id", "table_no", start.alias("start"), (titled & F.col("opens")).alias("top"), F.posexplode(lines).alias("i", "cells"))
    return spread.select(
        "image_id", "table_no", (F.col("start") + F.col("i")).alias("row"), F.posexplode("cells").alias("col", "text"), (F.col("top") & (F.col("i") == 0)).alias("is_header"),
    )


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("image_id", "table_no", "row", "col", "text", "is_header").collect()), key=repr)


def pieces(rng):
    """An answer of a few tables out of a few rows and headers, so that seams, blank rows and equal headers are common."""
    made = [["1", "x"], ["１", "x "], ["2", "y"], ["", " "], ["2"], [], ["", "　"]]
    heads = [["a", "b"], ["ａ", "b "], ["a", "c"], [], ["", " "], ["a"]]
    tables = [{"headers": rng.choice(heads[: rng.choice([2, 6])]), "rows": [rng.choice(made) for _ in range(rng.randrange(8))]} for _ in range(rng.randrange(4))]
    return json.dumps({"tables": tables}, ensure_ascii=False)


def test_cells_are_those_of_the_columns(spark):
    rng = random.Random(3)
    rows = [(i, 0, text) for i, text in enumerate(AWKWARD)] + [(100 + i, t, pieces(rng)) for i in range(150) for t in rng.sample(range(9), rng.randrange(1, 5))]
    rows += [(None, 1, AWKWARD[-1]), (None, 0, AWKWARD[-1])]
    answers = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = rows_of(by_columns(answers))
    assert rows_of(A.model_cells(answers)) == want and len(want) > 500
    assert not any(r[5] for r in rows_of(A.model_cells(answers, headers=False)))
    told = {r.image_id for r in A.images_with_tables(answers).collect()}
    assert told == {r.image_id for r in G.model_tables(answers).collect()}


def test_names_that_repeat(spark):
    answers = spark.createDataFrame([(1, 0, AWKWARD[17])], SCHEMA)
    assert A.model_cells(answers).count() == A.images_with_tables(answers).count() == 0
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert rows_of(A.model_cells(answers)) == rows_of(by_columns(answers)) != []
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_two_answers_of_one_tile(spark):
    """They count once each, in the order of their texts, whatever way they arrive."""
    texts = ['{"tables":[{"headers":["a"],"rows":[["%d"]]}]}' % i for i in (1, 2)]
    for turn in (texts, texts[::-1]):
        cells = A.model_cells(spark.createDataFrame([(1, 0, t) for t in turn], SCHEMA).repartition(1)).collect()
        assert [(r.table_no, r.row, r.text) for r in cells] == [(0, 0, "a"), (0, 1, "1"), (0, 2, "2")]


def test_a_batch_goes_out_in_parts(spark, monkeypatch):
    """Images of a batch, and cells of many, are not all held: the cells are the same in parts of any size."""
    answers = spark.createDataFrame([(i // 3, i % 3, pieces(random.Random(i))) for i in range(90)], SCHEMA)
    want = rows_of(A.model_cells(answers))
    monkeypatch.setattr(A, "IMAGES", 2)
    monkeypatch.setattr(A, "CELLS", 5)
    assert rows_of(A.model_cells(answers)) == want


@pytest.mark.parametrize("name", ["image_to_table", "tables_of_images"])
def test_answers_are_read_at_most_twice(spark, name):
    """No variant, no aggregate of answers, no sort of boxes or of answers: lines are sorted three times, and so are ids."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan and "variant" not in plan and "collect_list(struct" not in plan, plan
    assert plan.count("Window [collect_list") == 2 and plan.count("Sort [l_orderkey") == 3 and "Sort [image_id" in plan, plan
    assert plan.count("Sort [") == 4 + 2 * (name == "tables_of_images"), plan
