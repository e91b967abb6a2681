"""Steps over whole images in numpy: an Arrow batch holds many images, and each step runs over all of them at once.

Boxes meet by image on one exchange and are sorted by image only; what a step puts in order it orders in the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

#: Rows up to which batches are put together.
ROWS = 32768


def starts_of(column: pa.Array) -> np.ndarray:
    """Where a run of equal values begins; nulls are equal to each other."""
    if not len(column):
        return np.empty(0, np.int64)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (
        a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    )
    return np.concatenate([[0], np.flatnonzero(differ) + 1])


def _one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in which every group is whole, from rows sorted by ``keys``, with the places where groups begin."""
    held: list[pa.RecordBatch] = []
    size = limit = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < max(rows, limit):
            continue
        full = _one(held)
        at = groups_of(full, keys)
        held, size, limit = [full], full.num_rows, 2 * full.num_rows  # one group so far: wait for twice as much
        if at[-1] > 0:
            yield full.slice(0, int(at[-1])), at[:-1]
            held = [full.slice(int(at[-1]))]
            size, limit = held[0].num_rows, 0
    if held:
        full = _one(held)
        yield full, groups_of(full, keys)


def groups_of(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    at = starts_of(batch.column(keys[0]))
    for key in keys[1:]:
        at = np.union1d(at, starts_of(batch.column(key)))
    return at


def numbers(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and where they are null."""
    column = batch.column(name)
    null = column.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(column, pa.scalar(0, column.type)) if column.null_count else column
    values = values.to_numpy(zero_copy_only=False)
    return values.astype(np.int64 if values.dtype.kind in "iu" else np.float64), null


def by_group(rows: DataFrame, keys: list[str], order: list[str], schema: StructType, work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | list]) -> DataFrame:
    """``work(batch, starts)`` over whole groups; it gives the columns of ``schema``."""
    ship(rows.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in whole_groups(batches, keys):
            made = work(batch, at)
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def running_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Greatest value so far in the group; groups are numbered upwards from 0."""
    known, rank = np.unique(values, return_inverse=True)
    # Groups are lifted above each other, so one pass serves them all.
    lift = group * len(known)
    return known[np.maximum.accumulate(rank + lift) - lift]
