"""Dense images: the zone folds against quadratic versions, and in time that grows with the boxes."""

import random
import time

import pytest
from test_layout import BLOCK

from gridleaf.operators import layout as L
from gridleaf.operators.folds import kept_readings


def crowded(seed, n, side):
    """Overlapping rows of boxes with whole, partial and foreign texts, equal confidences and large boxes among them."""
    rng = random.Random(seed)
    words = ["invoice", "inv", "voice", "total amount", "total", "tot", "12", "1", "a"]
    out = []
    for i in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        w, h = rng.choice([(40, 12), (90, 14), (5, 30), (0, 0), (400, 200)]) if rng.random() < 0.3 else (60 + rng.randrange(9), 18 + rng.randrange(6))
        out.append((rng.choice([0.9, 0.8, 0.5, None]), i, rng.choice(words), "", x, y, x + w, y + h))
    return [(c, i, k.replace(" ", ""), k, *b) for c, i, k, _, *b in out]


def slow_kept(boxes):
    groups, seen = [], set()
    for b in sorted(boxes, key=lambda b: (b[0] is not None, -(b[0] or 0), b[1])):
        if (b[2], *b[4:]) in seen:
            continue
        seen.add((b[2], *b[4:]))
        for g in groups:
            head = g[0]
            if b[2] not in head[2] and head[2] not in b[2]:
                continue
            w, h = min(b[6], head[6]) - max(b[4], head[4]), min(b[7], head[7]) - max(b[5], head[5])
            inter = w * h if w > 0 and h > 0 else 0
            area = [max(1, (t[6] - t[4]) * (t[7] - t[5])) for t in (b, head)]
            near = max(6, int(0.75 * min(b[7] - b[5], head[7] - head[5])))
            if (inter and inter / (sum(area) - inter) >= 0.3) or all(abs(b[k] - head[k]) <= near for k in (4, 5, 6, 7)):
                g.append(b)
                break
        else:
            groups.append([b])
    return sorted(max(g, key=lambda b: len(b[2]))[1] for g in groups)


@pytest.mark.parametrize("seed,n,side", [(0, 10, 50), (1, 200, 300), (2, 800, 900), (3, 800, 200), (4, 1500, 3000)])
def test_kept_readings(seed, n, side):
    boxes = crowded(seed, n, side)
    kept = sorted(b[1] for b in kept_readings(boxes, L.SAME_IOU, L.NEAR_RATIO, L.NEAR_MIN))
    assert kept == slow_kept(boxes) and len(kept) < n


def slow_lines(centres, counts, tolerance):
    lines, out = [], []
    for c, n in zip(centres, counts):
        hit = next((k for k, (s, m) in enumerate(lines) if abs(c - s / m) <= tolerance), None)
        if hit is None:
            lines.append([0.0, 0])
            hit = len(lines) - 1
        lines[hit][0] += c * n
        lines[hit][1] += n
        out.append(hit + 1)
    return out


def test_lines_of_dense_zones(spark):
    """Centres a step or less apart: one zone, many lines, running means and equal centres."""
    rows, want = [], {}
    for image in range(6):
        rng = random.Random(image)
        centres = sorted(rng.randrange(1200) for _ in range(400))
        rows += [(image, i, "x", 5 * (i % 3), c - 6, 5 * (i % 3) + 9, c + 6, 1.0) for i, c in enumerate(centres)]
        counted = sorted(set(centres))
        line = dict(zip(counted, slow_lines(counted, [centres.count(c) for c in counted], max(4.0, 12 * L.ROW_TOLERANCE))))
        want.update({(image, i): line[c] - 1 for i, c in enumerate(centres)})
    got = {(r.image_id, r.block_id): r.line for r in L.reading_order(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == want and max(want.values()) > 40


def test_hundred_thousand_boxes_of_one_zone():
    start = time.time()
    rng = random.Random(1)
    boxes = [(rng.random(), i, f"t{i % 50}", "", x, y, x + 60, y + 18) for i in range(100_000) for x, y in [(rng.randrange(6000), rng.randrange(6000))]]
    kept_readings(boxes, L.SAME_IOU, L.NEAR_RATIO, L.NEAR_MIN)
    assert time.time() - start < 60


def test_dense_image_on_spark(spark):
    rows = [(i % 2, b[1], b[3], *b[4:], b[0]) for i, b in enumerate(crowded(5, 600, 250))] + [(1, 9000 + k, "loose", None, 5, 6, 7, 0.5) for k in range(2)]
    rows += [(None, 9100, "no image", 1, 1, 9, 9, 1.0), (0, 9200, "  ", 1, 1, 9, 9, 1.0), (0, 9201, None, 1, 1, 9, 9, 1.0)]
    got = sorted((r.image_id is None, r.image_id or 0, r.block_id) for r in L.dedupe_overlap(spark.createDataFrame(rows, BLOCK)).collect())
    want = [(True, 0, 9100), (False, 1, 9000)]
    for image in (0, 1):
        mine = [(r[7], r[1], r[2].replace(" ", ""), r[2], *r[3:7]) for r in rows if r[0] == image and r[2] and r[2].strip() and r[3] is not None]
        want += [(False, image, i) for i in slow_kept(mine)]
    assert got == sorted(want)
    assert L.dedupe_overlap(spark.createDataFrame([], BLOCK)).count() == 0
    tall = [(7, i, "x", 0, 3 * i, 10, 3 * i + 20, 1.0) for i in range(20_000)]
    order = L.reading_order(spark.createDataFrame(tall, BLOCK))
    assert order.agg({"pos": "max"}).first()[0] == 19_999
