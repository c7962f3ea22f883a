"""A filter of hashed keys, made on the executors: it keeps rows that nobody asks for out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Bits for each key, and the filter's size at least and at most, as powers of two; it is sent in segments.
EACH, LEAST, MOST, SEGMENT_BITS = 16, 20, 28, 19


def _segments(width: int):
    def run(batches):
        for batch in batches:
            at = np.unique((batch.column(0).to_numpy().view(U) & U((1 << width) - 1)).astype(np.int64))
            for segment in np.unique(at >> SEGMENT_BITS):
                bits = np.zeros(1 << SEGMENT_BITS, np.uint8)
                bits[at[at >> SEGMENT_BITS == segment] & ((1 << SEGMENT_BITS) - 1)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([int(segment)], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _united(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, bits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            new = np.frombuffer(bits, np.uint8)
            held[segment] = held[segment] | new if segment in held else new
    for segment, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])


def build(keys: DataFrame, n: int) -> Broadcast:
    """keys: one column of n 64-bit hashes, computed already.

    16 bits for each key, up to 32 MB in all whatever n is: with more keys than
    that the filter lets more rows through to the exact join behind it, and
    never keeps back a row that belongs to a key.
    """
    width = min(max((EACH * n).bit_length(), LEAST), MOST)
    rows = keys.mapInArrow(_segments(width), "segment int, bits binary").repartitionById(1 << (width - SEGMENT_BITS), F.col("segment")).mapInArrow(_united, "segment int, bits binary").collect()
    table = np.zeros(1 << (width - 3), np.uint8)
    size = 1 << (SEGMENT_BITS - 3)
    for segment, bits in rows:
        table[segment * size : (segment + 1) * size] = np.frombuffer(bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    at = (hashes.view(U) & U(8 * len(table) - 1)).astype(np.int64)
    return ((table[at >> 3] >> (7 - (at & 7))) & 1).astype(bool)
