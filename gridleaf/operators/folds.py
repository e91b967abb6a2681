"""Greedy steps over the boxes of one zone, in time that grows with the boxes and not with their square."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import floor
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .images import numbers, running_max

#: Heads of clusters up to which a zone needs no grid.
FEW = 12


class Readings:
    """Clusters of readings of one text at one place, in a uniform grid.

    ``put`` takes boxes from the most confident on. A box joins the earliest cluster whose head has a compatible text at the
    same place, and two boxes at one place share a cell of the grid once one of them is widened by its reach.
    """

    def __init__(self, boxes: list[tuple], iou: float, ratio: float, least: int):
        self.iou, self.ratio, self.least = iou, ratio, least
        self.heads: list[tuple] = []
        self.best: list[tuple] = []
        self.grid: dict[tuple[int, int], list[int]] | None = None
        self.width = max(16, 2 * int(median(b[6] - b[4] for b in boxes)))
        self.height = max(16, 2 * int(median(b[7] - b[5] for b in boxes)))

    def _cells(self, x0: int, y0: int, x1: int, y1: int) -> Iterator[tuple[int, int]]:
        for i in range(x0 // self.width, max(x0, x1) // self.width + 1):
            for j in range(y0 // self.height, max(y0, y1) // self.height + 1):
                yield i, j

    def _index(self, k: int) -> None:
        for cell in self._cells(*self.heads[k][4:8]):
            self.grid.setdefault(cell, []).append(k)

    def _candidates(self, box: tuple) -> Iterable[int]:
        if self.grid is None:
            return range(len(self.heads))
        x0, y0, x1, y1 = box[4:8]
        reach = max(self.least, floor((y1 - y0) * self.ratio))
        found: set[int] = set()
        for cell in self._cells(x0 - reach, y0 - reach, max(x0, x1) + reach, max(y0, y1) + reach):
            found.update(self.grid.get(cell, ()))
        return sorted(found)

    def _same_place(self, a: tuple, b: tuple) -> bool:
        ax0, ay0, ax1, ay1 = a[4:8]
        bx0, by0, bx1, by1 = b[4:8]
        shared = max(0, min(ax1, bx1) - max(ax0, bx0)) * max(0, min(ay1, by1) - max(ay0, by0))
        if shared > 0 and shared / (max(1, (ax1 - ax0) * (ay1 - ay0)) + max(1, (bx1 - bx0) * (by1 - by0)) - shared) >= self.iou:
            return True
        near = max(self.least, floor(min(ay1 - ay0, by1 - by0) * self.ratio))
        return abs(ax0 - bx0) <= near and abs(ay0 - by0) <= near and abs(ax1 - bx1) <= near and abs(ay1 - by1) <= near

    def put(self, box: tuple) -> None:
        key = box[2]
        for k in self._candidates(box):
            head = self.heads[k]
            if (key in head[2] or head[2] in key) and self._same_place(box, head):
                if len(key) > len(self.best[k][2]):
                    self.best[k] = box
                return
        self.heads.append(box)
        self.best.append(box)
        if self.grid is not None:
            self._index(len(self.heads) - 1)
        elif len(self.heads) > FEW:
            self.grid = {}
            for k in range(len(self.heads)):
                self._index(k)


def kept_readings(boxes: list[tuple], iou: float, ratio: float, least: int) -> list[tuple]:
    """One box of each cluster, from (confidence, id, key, text, x0, y0, x1, y1). Equal texts with equal boxes are one."""
    merged: dict[tuple, tuple] = {}
    for box in sorted(boxes, key=lambda b: (b[0] is not None, -(b[0] or 0.0), b[1] is not None, b[1] or 0)):
        merged.setdefault((box[2], *box[4:8]), box)
    if len(merged) == 1:
        return [*merged.values()]
    clusters = Readings([*merged.values()], iou, ratio, least)
    for box in merged.values():
        clusters.put(box)
    return clusters.best


def _reach(low: np.ndarray, high: np.ndarray, height: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """Where, along one axis, a later box can no longer be at the place of this one."""
    return np.maximum(high, low + np.maximum(least, np.floor(height * ratio).astype(np.int64)))


def zones(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """A zone's number for each box: groups cut where no box reaches in y, then in x. Boxes of two zones are never at one place."""
    zone = group
    for low, high in ((y0, y1), (x0, x1)):
        order = np.lexsort((low, zone))
        z, start = zone[order], low[order]
        new = np.append(True, z[1:] != z[:-1])
        cut = new.copy()
        cut[1:] |= start[1:] > running_max(_reach(start, high[order], (y1 - y0)[order], ratio, least), np.cumsum(new) - 1)[:-1]
        zone = np.empty(len(order), np.int64)
        zone[order] = np.cumsum(cut) - 1
    return zone


def same_place(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], iou: float, ratio: float, least: int) -> np.ndarray:
    """``Readings._same_place`` for many pairs of (x0, y0, x1, y1)."""
    shared = np.maximum(0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    area = sum(np.maximum(1, (e[2] - e[0]) * (e[3] - e[1])) for e in (a, b)) - shared
    near = np.maximum(least, np.floor(np.minimum(a[3] - a[1], b[3] - b[1]) * ratio))
    close = np.logical_and.reduce([np.abs(p - q) <= near for p, q in zip(a, b)])
    return ((shared > 0) & (shared / np.where(shared > 0, area, 1) >= iou)) | close


def kept_of_images(batch: pa.RecordBatch, starts: np.ndarray, iou: float, ratio: float, least: int) -> np.ndarray:
    """Places of the boxes that stay, for rows ``image_id, block_id, text, x0, y0, x1, y1, confidence, key`` of whole images.

    Zones of one or two boxes, which is nearly all, are decided together; the others one by one. A box without an edge is at no
    place: it stays, its copies apart.
    """
    n = batch.num_rows
    image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    edges, missing = zip(*(numbers(batch, c) for c in ("x0", "y0", "x1", "y1")))
    loose = np.logical_or.reduce(missing)
    keys = batch.column("key")
    kept: list[np.ndarray] = []

    def boxes(at: np.ndarray) -> list[tuple]:
        c, i, key, *box = (batch.column(name).take(pa.array(at)).to_pylist() for name in ("confidence", "block_id", "key", "x0", "y0", "x1", "y1"))
        return [*zip(c, i, key, at.tolist(), *box)]

    at = np.flatnonzero(loose)
    if len(at):
        first: dict[tuple, tuple] = {}
        for own, (c, i, key, place, *box) in zip(image[at].tolist(), boxes(at)):
            order = (c is not None, -(c or 0.0), i is not None, i or 0)
            spot = (own, key, *box)
            if spot not in first or order < first[spot][0]:
                first[spot] = (order, place)
        kept.append(np.array([place for _, place in first.values()], np.int64))
    at = np.flatnonzero(~loose)
    if len(at):
        zone = zones(image[at], *(e[at] for e in edges), ratio, least)
        (sure, unsure), (block, unnamed) = numbers(batch, "confidence"), numbers(batch, "block_id")
        # From the most confident on, nulls first, as in ``kept_readings``.
        order = np.lexsort((block[at], ~unnamed[at], -sure[at], ~unsure[at], zone))
        at, zone = at[order], zone[order]
        begin = np.flatnonzero(np.append(True, zone[1:] != zone[:-1]))
        sizes = np.diff(np.append(begin, len(at)))
        kept.append(at[begin[sizes == 1]])
        a, b = at[begin[sizes == 2]], at[begin[sizes == 2] + 1]
        if len(a):
            ka, kb = keys.take(pa.array(a)), keys.take(pa.array(b))
            near = same_place(tuple(e[a] for e in edges), tuple(e[b] for e in edges), iou, ratio, least)
            fits = pc.equal(ka, kb).to_numpy(zero_copy_only=False).copy()
            longer = (pc.utf8_length(kb).to_numpy(zero_copy_only=False) > pc.utf8_length(ka).to_numpy(zero_copy_only=False))
            # Copies of one text at one box are one, wherever "place" stands.
            twins = fits & np.logical_and.reduce([e[a] == e[b] for e in edges])
            for k in np.flatnonzero(near & ~fits).tolist():
                p, q = ka[k].as_py(), kb[k].as_py()
                fits[k] = p in q or q in p
            joined = twins | (near & fits)
            kept += [np.where(joined & longer, b, a), b[~joined]]
        rest = np.flatnonzero(sizes > 2)
        if len(rest):
            found = []
            crowd = boxes(at[np.repeat(sizes > 2, sizes)])
            done = 0
            for size in sizes[rest].tolist():
                found += [box[3] for box in kept_readings(crowd[done : done + size], iou, ratio, least)]
                done += size
            kept.append(np.array(found, np.int64))
    return np.sort(np.concatenate(kept)) if kept else np.empty(0, np.int64)
