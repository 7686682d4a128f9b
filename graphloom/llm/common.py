"""Shared helpers: scratch tables, word splitting, word hashes, grouped streaming."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import scratch_path, stored  # noqa: F401

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries that a per-task word cache holds at most; further words are hashed anew each time.
CACHE = 400_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, columns: str) -> StructType:
    """The schema of df, which may have any names, with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])


def quoted(df: DataFrame) -> list:
    """All columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def partitions(df: DataFrame, each: int = 128 << 20) -> int:
    """Partitions for an exchange of df's rows: the session's number, or more where Catalyst's estimate of df's bytes gives over `each` to a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size >= 1 << 60 else max(n, -(-size // each))  # beyond that, Catalyst has no estimate


def doc_key(seed: int = 0):
    """A long for a document's id and text. Rows that repeat both are one document; key_seed gives a seed with which no others share a key."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def key_seed(docs: DataFrame, tries: int = 8) -> int:
    """The first seed with which each document of docs (doc_id, text) has a key of its own: a second hash tells documents apart. What travels is two longs a document."""
    for seed in range(tries):
        both = docs.select(doc_key(seed).alias("key"), F.xxhash64(F.lit("other"), F.col("text"), F.col("doc_id")).alias("other"))
        if both.groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("z")).where("a < z").isEmpty():
            return seed
    raise RuntimeError(f"documents shared a 64-bit key with each of {tries} seeds")


class WordHash(dict):
    """Word (bytes) to its 64-bit hash, remembering up to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = v
        return v

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += h[j : j + n]
    return mix(g)


def shingles(words: list[bytes], hashes: WordHash, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; a text of 1 to k-1 words is one run; no words, none."""
    h = hashes.array(words)
    if 0 < len(h) < k:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64))
    return np.unique(grams(h, k))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, ... (counts[0] of them), then those from starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def pieces(batch, column: int, size: int):
    """Cut a record batch into parts whose strings in a column have about size bytes together; a longer string is a part of its own."""
    import pyarrow.compute as pc

    n = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(n, size + (n[i - 1] if i else 0), "right")))
        yield batch.slice(i, j - i)
        i = j


def runs(batches, key_of):
    """Cut an iterator of pandas frames, sorted by a key, into one frame per key. A key's rows must fit in memory: callers bound them."""
    import pandas as pd

    held, at = [], None
    for b in batches:
        if not len(b):
            continue
        keys = key_of(b)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for i, j in zip(cut, np.r_[cut[1:], len(b)], strict=True):
            if held and keys[i] != at:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            at = keys[i]
            held.append(b.iloc[i:j])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
