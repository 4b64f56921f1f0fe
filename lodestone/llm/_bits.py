"""A bitmap of 64-bit keys, of bounded size at any size of input: it may let other keys pass, but loses none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import in_arrow

#: Bits of a bitmap, at most, and of each of its blocks.
BITS, BLOCK = 1 << 27, 1 << 15


def bitmap(keys: DataFrame, n_bits: int = BITS) -> np.ndarray:
    """The bits of ``keys`` (key): ``n_bits`` of them, a power of two from BLOCK to BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits // 8, np.uint8)
        for b in batches:
            at = b.column("key").to_numpy() & (n_bits - 1)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        bits = bits.reshape(-1, BLOCK // 8)
        for i in np.flatnonzero(bits.any(1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([int(i)], pa.int32()), "bits": pa.array([bits[i].tobytes()], pa.binary())})

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.shiftright(F.col("key").bitwiseAND(F.lit(n_bits - 1)), BLOCK.bit_length() - 1)
    out = np.zeros((n_bits // BLOCK, BLOCK // 8), np.uint8)
    for r in keys.select("key").repartition(n, block).transform(in_arrow, run, "block int, bits binary").collect():  # at most n_bits / BLOCK rows
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
