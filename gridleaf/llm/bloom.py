"""Membership filters of a bounded size over 64-bit hashes: what they let through by mistake costs work, never a result."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .words import mix

#: Bits of one segment, and of a whole filter at most (32 MB), as powers of two.
SEGMENT, MOST = 19, 28
#: Bits for each entry while the bound allows it.
EACH = 16


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    """Three places inside a segment for each hash."""
    spread, mask = mix(hashes), np.uint64((1 << SEGMENT) - 1)
    return [((spread >> np.uint64(SEGMENT * k)) & mask).astype(np.int64) for k in range(3)]


@dataclass
class Bloom:
    """Bits in segments; a hash lives in the segment that its top bits name."""

    top: int  # the number of segments as a power of two
    bits: np.ndarray  # bool, segment after segment

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """True for every hash that was put in, and by mistake for a few others."""
        base = (hashes >> np.uint64(64 - self.top)).astype(np.int64) << SEGMENT if self.top else np.zeros(len(hashes), np.int64)
        out = np.ones(len(hashes), bool)
        for place in _places(hashes):
            at = base + place
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def build(hashes: DataFrame, count: int) -> Bloom:
    """The filter of the one long column of ``hashes`` (already well mixed), of which there are ``count``.

    Each segment is filled by one task. The driver gets 2 ** (MOST - 3) bytes at most, however long the column is; a
    filter that is too full for its entries lets more through.
    """
    ship(hashes.sparkSession)
    top = min(MOST, max(SEGMENT, int(np.ceil(np.log2(max(1, EACH * count)))))) - SEGMENT
    column = F.col(hashes.columns[0])
    segment = (F.shiftrightunsigned(column, 64 - top) if top else F.lit(0)).cast("int").alias("segment")

    def fill(batches):
        held, bits = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            segments = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]]) if len(segments) else []
            for a, b in zip(cuts, [*cuts[1:], len(segments)]):
                if segments[a] != held:
                    if held is not None:
                        yield done()
                    held, bits = int(segments[a]), np.zeros(1 << SEGMENT, bool)
                for place in _places(values[a:b]):
                    bits[place] = True
        if held is not None:
            yield done()

    filled = hashes.select(segment, column).repartition("segment").sortWithinPartitions("segment").mapInArrow(fill, "segment int, bits binary").toArrow()
    out = np.zeros(1 << (top + SEGMENT - 3), np.uint8)
    size = 1 << (SEGMENT - 3)
    for k, part in zip(filled.column("segment").to_pylist(), filled.column("bits")):
        out[k * size : (k + 1) * size] = np.frombuffer(part.as_buffer(), np.uint8)
    return Bloom(top, out)
