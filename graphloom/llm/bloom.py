"""Blocked Bloom filter: 512-bit blocks of eight 64-bit words, one bit a word, so that a probe touches one cache line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multipliers, one for each word of a block.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def masks(h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(0xFFFFFFFF)
    bit = ((low[:, None] * SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return np.uint64(1) << bit


def blocks(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False: certainly not among the keys. True: possibly."""
    if not len(h):
        return np.zeros(0, bool)
    m = masks(h)
    return ((bits[blocks(h, len(bits))] & m) == m).all(axis=1)


def build(keys: DataFrame, column: str, expected: int, max_bytes: int = 32 << 20) -> np.ndarray:
    """The filter over a long column of hashes; 16 bits a key, but never over max_bytes. With more keys than fit it lets
    more through, never fewer, so whatever follows it must be exact. Partitions fill their own blocks, which are joined by OR."""
    n = max(1, min(max_bytes // 64, -(-expected * 16 // 512)))
    n_blocks = n

    def fill(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(h):
                at, inv = np.unique(blocks(h, n_blocks), return_inverse=True)
                words = np.zeros((len(at), 8), np.uint64)
                np.bitwise_or.at(words, inv, masks(h))
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(words[:, i].view(np.int64)) for i in range(8))], ["block", *(f"w{i}" for i in range(8))])

    parts = keys.select(column).where(F.col(column).isNotNull()).mapInArrow(fill, "block long, " + ", ".join(f"w{i} long" for i in range(8)))
    rows = parts.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toArrow()
    bits = np.zeros((n, 8), np.uint64)
    if rows.num_rows:
        at = rows.column("block").to_numpy()
        for i in range(8):
            bits[at, i] = rows.column(f"w{i}").to_numpy().view(np.uint64)
    return bits
