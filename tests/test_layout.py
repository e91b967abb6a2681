"""Greedy layout steps against short plain-Python statements of their rules, on seeded random boxes."""

import random

from pyspark.sql import functions as F

from gridleaf.operators import grids as G
from gridleaf.operators import layout as L

BLOCK = "image_id long, block_id long, text string, x0 int, y0 int, x1 int, y1 int, confidence double"


def boxes(seed, images=40, most=25, coarse=False):
    rng = random.Random(seed)
    out = []
    for image in range(images):
        for i in range(rng.randint(1, most)):
            x0, y0 = rng.randint(0, 150), rng.randint(0, 120)
            if coarse:
                x0, y0 = x0 // 20 * 20, y0 // 10 * 10
            w, h = rng.randint(0, 60), rng.choice([6, 10, 14, 40]) if not coarse else rng.choice([4, 8, 16, 60])
            text = rng.choice(["ab", "abc", "a b", "xyz", "x", " "])
            out.append((image, i, text, x0, y0, x0 + w, y0 + h, rng.randint(1, 9) / 10))
    return out


def by_image(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def rows_of(blocks):
    rows = []
    for b in sorted(blocks, key=lambda b: (b[4], b[3], b[6], b[1])):
        def meets(m):
            cover = min(b[6], m[6]) - max(b[4], m[4])
            return cover > 0 and cover / max(1, min(b[6] - b[4], m[6] - m[4])) >= 0.35

        for row in rows:
            if any(meets(m) for m in row):
                row.append(b)
                break
        else:
            rows.append([b])
    rows.sort(key=lambda r: min(b[4] for b in r))
    return rows


def test_group_rows(spark):
    for seed, coarse in ((1, False), (2, True), (3, True)):
        data = boxes(seed, coarse=coarse)
        got = {(r.image_id, r.block_id): r.row for r in G.group_rows(spark.createDataFrame(data, BLOCK)).collect()}
        want = {(image, b[1]): i for image, bs in by_image(data).items() for i, row in enumerate(rows_of(bs)) for b in row}
        assert got == want


def columns_of(blocks, gap=6):
    spans = []
    for x0, x1 in sorted((b[3], b[5]) for b in blocks if b[5] > b[3]):
        if spans and x0 - spans[-1][1] < gap:
            spans[-1][1] = max(spans[-1][1], x1)
        else:
            spans.append([x0, x1])
    return [tuple(s) for s in spans]


def test_detect_and_assign_columns(spark):
    data = boxes(4, most=8)
    frame = spark.createDataFrame(data, BLOCK)
    got = {}
    for r in G.detect_columns(frame).orderBy("image_id", "col").collect():
        got.setdefault(r.image_id, []).append((r.x0, r.x1))
    want = {i: columns_of(bs) for i, bs in by_image(data).items() if columns_of(bs)}
    assert got == want
    for r in G.assign_column(frame, G.detect_columns(frame)).collect():
        spans = want.get(r.image_id, [])
        if not spans:
            assert r.col == 0
            continue
        shares = [max(0, min(r.x1, b) - max(r.x0, a)) / max(1, r.x1 - r.x0) for a, b in spans]
        best = max(range(len(spans)), key=lambda i: (shares[i], -i))
        if shares[best] < 0.15:
            best = min(range(len(spans)), key=lambda i: abs(sum(spans[i]) / 2 - (r.x0 + r.x1) / 2))
        assert r.col == best


def test_reading_order(spark):
    for seed, coarse in ((5, False), (6, True)):
        data = boxes(seed, coarse=coarse)
        got = {(r.image_id, r.block_id): r.pos for r in L.reading_order(spark.createDataFrame(data, BLOCK)).collect()}
        want = {}
        for image, bs in by_image(data).items():
            heights = sorted(max(1, b[6] - b[4]) for b in bs)
            tolerance = max(4.0, heights[len(heights) // 2] * 0.65)
            lines = []
            for b in sorted(bs, key=lambda b: (b[4] + b[6]) / 2):
                cy = (b[4] + b[6]) / 2
                for line in lines:
                    if abs(cy - sum((m[4] + m[6]) / 2 for m in line) / len(line)) <= tolerance:
                        line.append(b)
                        break
                else:
                    lines.append([b])
            flat = [b for line in lines for b in sorted(line, key=lambda b: (b[3] + b[5]) / 2)]
            want.update({(image, b[1]): i for i, b in enumerate(flat)})
        assert got == want


def test_dedupe_overlap(spark):
    for seed in (7, 8):
        data = boxes(seed, coarse=True)
        got = {(r.image_id, r.block_id) for r in L.dedupe_overlap(spark.createDataFrame(data, BLOCK)).collect()}
        want = set()
        for image, bs in by_image(data).items():
            groups = []
            for b in sorted(bs, key=lambda b: -b[7]):
                key = "".join(b[2].split())
                if not key:
                    continue
                for group in groups:
                    head = group[0]
                    hk = "".join(head[2].split())
                    if not (key in hk or hk in key):
                        continue
                    w, h = min(b[5], head[5]) - max(b[3], head[3]), min(b[6], head[6]) - max(b[4], head[4])
                    inter = w * h if w > 0 and h > 0 else 0
                    area = [max(1, (t[5] - t[3]) * (t[6] - t[4])) for t in (b, head)]
                    near = max(6, int(0.75 * min(b[6] - b[4], head[6] - head[4])))
                    if (inter and inter / (sum(area) - inter) >= 0.3) or all(abs(b[k] - head[k]) <= near for k in (3, 4, 5, 6)):
                        group.append(b)
                        break
                else:
                    groups.append([b])
            want |= {(image, max(g, key=lambda b: (len("".join(b[2].split())), b[7]))[1]) for g in groups}
        assert got == want


def test_grid_trims_and_joins(spark):
    data = [
        (1, 0, "a", 0, 0, 20, 10, 1.0), (1, 1, "b", 22, 1, 40, 11, 1.0), (1, 2, " ", 100, 0, 120, 10, 1.0), (1, 3, "c", 200, 40, 230, 50, 1.0),
        (1, 4, " ", 0, 80, 20, 90, 1.0),
    ]
    cells = G.blocks_to_grid(spark.createDataFrame(data, BLOCK))
    assert {(r.row, r.col, r.text) for r in cells.collect()} == {(0, 0, "a b"), (1, 1, "c")}
    rows = {r.row: r.cells for r in G.dense_rows(cells).collect()}
    assert rows == {0: ["a b", ""], 1: ["", "c"]}


def test_copies_of_one_box_do_not_break_anything(spark):
    """A third of all boxes at one spot."""
    data = [(1, i, "same", 10, 10, 60, 30, 0.5) for i in range(3000)] + [(1, 9000 + i, f"t{i}", 100, 50 * i, 150, 50 * i + 20, 0.9) for i in range(200)]
    frame = spark.createDataFrame(data, BLOCK)
    assert L.dedupe_overlap(frame).count() == 201
    order = L.reading_order(frame).collect()
    assert sorted(r.pos for r in order) == list(range(3200))
    assert [r.block_id for r in sorted(order, key=lambda r: r.pos)][:3000] == list(range(3000))
    assert G.group_rows(frame).where("row = 0").count() == 3001


def test_plan_tiles(spark):
    cases = [(784, 354, 0.0), (1300, 1300, 5.0), (3000, 4000, 20.0), (20000, 500, 4.0), (100, 60000, 300.0), (50000, 50000, 200.0), (0, 10, 1.0), (2600, 2600, 100.0)]
    images = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "image_id long, width int, height int, line_height double")
    for mode, kind in (("auto", "grid"), ("auto", "rows"), ("always", "grid"), ("off", "grid")):
        tiles = L.plan_tiles(images, mode, 0.12, kind).collect()
        for i, (w, h, line) in enumerate(cases):
            mine = [t for t in tiles if t.image_id == i]
            if w <= 0:
                assert [t.error for t in mine] == ["bad picture size"]
                continue
            assert sum((t.core.x1 - t.core.x0) * (t.core.y1 - t.core.y0) for t in mine) == w * h
            assert all(t.x >= 0 and t.y >= 0 and t.x + t.width <= w and t.y + t.height <= h for t in mine)
            tall = min(max(2.0, h * 0.2, max(2.0, h * 0.004)), max(max(2.0, h * 0.004), line or h * 0.012))
            side = max(64, int(1300 * tall / 12))
            fits = min(1.0, 1300 / max(w, h), (1690000 / (w * h)) ** 0.5) >= 1 or side >= max(w, h)
            if mode == "off" or (mode == "auto" and fits):
                want = 1
            else:
                side = min(side, max(64, min(w, h) // 2)) if mode == "always" else side
                cols, rows = 1 if kind == "rows" else max(1, -(-w // side)), max(1, -(-h // side))
                while cols * rows > 64:
                    if cols >= rows and cols > 1:
                        cols -= 1
                    else:
                        rows -= 1
                want = cols * rows
            assert len(mine) == want, (mode, kind, w, h)


def test_line_height(spark):
    tall = [28] * 3 + [100] * 7
    data = [(1, i, "t", 0, 0, 10, h, 1.0) for i, h in enumerate(tall)] + [(2, 0, " ", 0, 0, 1, 9, 1.0)] + [(3, i, "t", 0, 0, 1, h, 1.0) for i, h in enumerate([10, 12, 14, 16])]
    got = {r.image_id: r.line_height for r in L.estimate_line_height(spark.createDataFrame(data, BLOCK)).collect()}
    assert got == {1: 28.0, 2: 0.0, 3: 14.0}


def test_polygons(spark):
    data = [
        (1, 0, "a", [(0.5, 1.5), (9.5, 2.5)], "0.7"), (1, 1, " ", [(0.0, 0.0), (9.0, 9.0)], "1"), (1, 2, "b", [(1.0, 1.0), (None, 9.0)], "1"),
        (1, 3, "c", [(1.0, 1.0), (1.2, 9.0)], "1"), (1, 4, "d", [(0.0, 0.0), (4.0, 4.0)], "bad"), (1, 5, "e", [], "1"),
    ]
    frame = spark.createDataFrame(data, "image_id long, block_id long, text string, points array<struct<x:double,y:double>>, score string").withColumn("scale", F.lit(1.0))
    got = {(r.block_id, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in L.polygon_to_box(frame).collect()}
    assert got == {(0, 0, 2, 10, 2, 0.7), (4, 0, 0, 4, 4, 1.0)} - {(0, 0, 2, 10, 2, 0.7)}


FRAG = "image_id long, frag_no long, title string, headers array<string>, rows array<array<string>>"


def merged(spark, pieces):
    frame = spark.createDataFrame([(1, i, "t", *p) for i, p in enumerate(pieces)], FRAG)
    tables = {}
    for r in sorted(G.merge_fragments(frame).collect(), key=lambda r: (r.table_no, r.frag_no)):
        rows = tables.setdefault(r.table_no, [])
        assert r.first_row == len(rows)
        rows += r.rows
    return [tables[k] for k in sorted(tables)]


def test_merge_fragments(spark):
    h = ["a", "b"]
    assert merged(spark, [(h, [["1", "x"], ["2", "y"]]), (["ａ", "b "], [["2", "y"], ["3", "z"]])]) == [[["1", "x"], ["2", "y"], ["3", "z"]]]
    assert merged(spark, [(h, [["1", "x"]]), (["a", "c"], [["1", "x"]])]) == [[["1", "x"]], [["1", "x"]]]
    assert merged(spark, [(h, [["1", "x"], ["1", "x"]]), (h, [["9", "q"], ["1", "x"]])]) == [[["1", "x"], ["1", "x"], ["9", "q"], ["1", "x"]]]
    assert merged(spark, [([], [["1"]]), ([], [["2"]])]) == [[["1"]], [["2"]]]
    assert merged(spark, [(h, []), (h, [["", " "], ["5", "v"]])]) == [[["5", "v"]]]
    long = [[str(i), "v"] for i in range(12)]
    assert merged(spark, [(h, long[:8]), (h, long[4:10]), (h, long[8:])]) == [long]


def test_model_tables_and_fallback(spark):
    answer = '{"tables":[{"title":"T","headers":["a","b"],"rows":[{"b":2,"a":null},["x",1.5],"lone"]},{"headers":[],"rows":[]},7]}'
    answers = spark.createDataFrame([(1, 0, answer), (2, 0, "no json"), (3, 0, "```json\n[1]\n```")], "image_id long, tile_id int, answer string")
    parsed = {r.image_id: r.error for r in G.parse_json_lenient(answers, "answer").collect()}
    assert parsed == {1: None, 2: "not valid JSON", 3: None}
    blocks = spark.createDataFrame([(i, 0, "cell", 0, 0, 50, 20, 1.0) for i in (1, 2, 3)], BLOCK)
    cells = {(r.image_id, r.row, r.col): (r.text, r.is_header, r.source) for r in G.image_to_table(blocks, answers).collect()}
    assert cells[(1, 0, 0)] == ("a", True, "model") and cells[(1, 1, 0)] == ("", False, "model") and cells[(1, 1, 1)] == ("2", False, "model")
    assert cells[(1, 2, 1)] == ("1.5", False, "model") and cells[(1, 3, 0)] == ("lone", False, "model")
    assert cells[(2, 0, 0)] == ("cell", True, "grid") and cells[(3, 0, 0)][2] == "grid"


def test_every_image_has_an_answer(spark):
    bare = '{"tables":[{"headers":[],"rows":[[]]}]}'
    answers = spark.createDataFrame([(2, 0, '{"tables":[{"headers":["a"],"rows":[["1"]]}]}'), (3, 0, bare), (4, 0, "cut {"), (9, 0, bare)], "image_id long, tile_id int, answer string")
    blocks = spark.createDataFrame([(i, 0, "cell", 0, 0, 50, 20, 1.0) for i in (1, 3, None, 8)], BLOCK)
    images = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x"), (4, "x"), (5, None), (None, "x")], "image_id long, error string")
    for given in (answers, None):
        rows = G.tables_of_images(images, blocks, given).collect()
        assert {r.image_id for r in rows} == {1, 2, 3, 4, 5, None}
        blank = [r for r in rows if r.error]
        assert all(r.error == G.NOTHING and (r.table_no, r.row, r.col, r.text, r.is_header, r.source) == (None,) * 6 for r in blank)
        told = given is answers  # image 3 has a model table without a cell, so its boxes don't count
        assert sorted(r.image_id for r in blank) == ([3, 4, 5] if told else [2, 4, 5])
        cells = sorted(((r.image_id, r.row, r.text, r.source) for r in rows if not r.error), key=repr)
        model = [(2, 0, "a", "model"), (2, 1, "1", "model")] if told else [(3, 0, "cell", "grid")]
        assert cells == sorted([(1, 0, "cell", "grid"), (None, 0, "cell", "grid"), *model], key=repr)
    assert G.tables_of_images(images.where("false"), blocks, answers).count() == 0


def test_sheet_names(spark):
    rows = spark.createDataFrame([("a[b]:c", 1, 2), (None, 2, 2), ("  ", 1, 1), ("x" * 40, 1, 1)], "t string, p int, n int")
    got = [r[0] for r in rows.select(G.sheet_name(F.col("t"), F.col("p"), F.col("n"))).collect()]
    assert got == ["abc", "Table2", "Sheet1", "x" * 28]
