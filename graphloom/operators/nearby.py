"""A similarity join without all pairs: vectors live in the cell of their nearest pivot and visit the other cells that a vector near enough could
live in, by an exact bound; so every pair is found, and pairs of cells that are far apart never meet."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

#: Vectors of a cell on average, pivots at most, and vectors that pivots are fitted on, about so many for each pivot.
CELL, MOST_PIVOTS, FIT = 2_048, 1_024, 32
#: Vectors at home that a task holds; visitors that it streams for them; rows of a block of scores.
TILE, VISITORS, BLOCK = 8_192, 131_072, 512
#: Room for rounding of distances.
EPS = 1e-9


def unit(rows) -> np.ndarray:
    """Lists of numbers as unit vectors; a zero vector stays zero."""
    x = np.array(rows, np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def pivots_of(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit vectors in the middle of groups of x, by Lloyd's rounds on the sphere."""
    rng = np.random.default_rng(1)
    p = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(x[i : i + 2048] @ p.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(p)
        np.add.at(total, of, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        p = np.where(n > 1e-9, total / np.maximum(n, 1e-9), p)
    return np.unique(p, axis=0)


def distance(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * threshold))


def bounds(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """home of each vector, and how far at least it is from any vector of each cell.

    Let x live with a and y with b. As y is nearer to b than to a, x is at least (|x-b|^2 - |x-a|^2) / (2 |a-b|) from y; for pivots of one
    length that is (xa - xb) / |a-b|.
    """
    s = x @ pivots.T
    home = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T)))[home]
    return home, np.where(apart > EPS, (s.max(axis=1)[:, None] - s) / np.maximum(apart, EPS), 0.0)


def places(x: np.ndarray, pivots: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """home of each vector, and (row, cell) of the later cells that are at most room away. The bound holds both ways, so of two cells the vectors of the earlier one visit the later."""
    home, low = bounds(x, pivots)
    return home, *np.nonzero((low <= room + EPS) & (np.arange(len(pivots))[None, :] > home[:, None]))


def room_for(x: np.ndarray, pivots: np.ndarray, threshold: float, recall: float) -> float:
    """How far a cell may be so that pairs at just the threshold, in any direction from rows of x, meet with this probability."""
    if recall >= 1.0:
        return distance(threshold)
    rng = np.random.default_rng(2)
    q = x[rng.integers(0, len(x), 8192)]
    off = rng.normal(size=q.shape)
    off -= (off * q).sum(axis=1, keepdims=True) * q
    other = threshold * q + math.sqrt(max(0.0, 1 - threshold**2)) * unit(off)
    (a, low_a), (b, low_b) = bounds(q, pivots), bounds(other, pivots)
    every = np.arange(len(q))
    return float(np.quantile(np.where(a == b, 0.0, np.where(a < b, low_a[every, b], low_b[every, a])), recall))


def _meet(threshold: float):
    """Tiles one after the other: those at home, then visitors; each pair that reaches the threshold once."""
    import pyarrow as pa

    def out(a, b, s):
        swap = a > b
        return pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(s)], ["a", "b", "score"])

    def pairs(x, ids, home, home_ids, among=False):
        for i in range(0, len(x), BLOCK):
            s = x[i : i + BLOCK] @ home.T
            r, c = np.nonzero(s >= threshold)
            if among:
                r, c = r[c > r + i], c[c > r + i]
            if len(r):
                yield out(ids[i + r], home_ids[c], s[r, c])

    def run(batches):
        at, held, home = None, [], None

        def close():
            if at is not None and at[2] == 0 and held:
                x, ids = (np.concatenate(v) for v in zip(*held, strict=True))
                yield from pairs(x, ids, x, ids, True)

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "tile", "slice", "guest")])
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                key, guest = tuple(keys[i, :3].tolist()), keys[i, 3]
                if key != at:
                    yield from close()
                    at, held, home = key, [], None
                x = unit(b.column("vector").slice(i, j - i).to_pylist())
                if not guest:
                    held.append((x, ids[i:j]))
                elif held:
                    home = home or tuple(np.concatenate(v) for v in zip(*held, strict=True))
                    yield from pairs(x, ids[i:j], *home)
        yield from close()

    return run


def similar_pairs(vectors: DataFrame, threshold: float, recall: float = 1.0, cell: int = CELL) -> DataFrame:
    """(a, b, score): every pair of rows of vectors (vec_id: a whole number, vector) with a cosine of threshold or more, a < b; repeated ids make pairs a = b.

    Recall is 1 by the bound of bounds(); where vectors have no groups or the threshold is low, that leaves few cells out, and what is left is the
    work of all pairs, dealt to tasks. A recall below 1 visits nearer cells only, as many as that share of pairs at the threshold needs;
    nearer pairs are found more often. What is found is exact. Pivots are fitted on a bounded sample. Cells are cut into tiles of TILE vectors and visitors into slices of VISITORS,
    so a task holds one tile however many vectors are alike. Null, empty and zero vectors are like nothing; no vectors: no pairs. All
    vectors have one length. Vectors don't pass the driver.
    """
    import pyarrow as pa

    has = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda v: v != 0)
    v = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(has), "vectors")
    n = v.count()
    none = v.sparkSession.createDataFrame([], "a long, b long, score double")
    if n < 2:
        return none
    k = min(MOST_PIVOTS, max(1, n // cell))
    share = min(1.0, FIT * k / n)
    rows = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vector").collect() or v.select("vector").limit(FIT).collect()
    sample = unit([r[0] for r in rows])
    fit = sample[: max(k, 3 * len(sample) // 4)]
    pivots = pivots_of(fit, k)
    left = sample[len(fit) :] if len(sample) > len(fit) else sample  # vectors that pivots were fitted on lie nearer to them than others
    sent = v.sparkSession.sparkContext.broadcast((pivots, room_for(left, pivots, threshold, recall)))

    def code(batches):
        for b in batches:
            for t in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):
                home, row, to = places(unit(t.column(1).to_pylist()), *sent.value)
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=t.num_rows))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(home.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(to.astype(np.int32)))], ["vec_id", "vector", "home", "visits"])

    kind = v.schema["vector"].dataType.simpleString()
    coded = stored(v.mapInArrow(code, f"vec_id long, vector {kind}, home int, visits array<int>"), "cells")
    coded = coded.withColumn("h", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    count = lambda c, one: coded.select(c.alias("cell"), F.lit(one).alias("one"))
    counts = count(F.col("home"), 1).unionByName(count(F.explode("visits"), 0)).groupBy("cell").agg(F.sum("one").alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1")
    counts = counts.select(F.col("cell").alias("of"), F.ceil(F.col("homes") / TILE).cast("int").alias("tiles"), F.ceil(F.col("n") / VISITORS).cast("int").alias("slices"))
    at = coded.withColumn("cell", F.explode(F.concat(F.array("home"), "visits"))).join(counts, F.col("cell") == F.col("of"))
    tile, piece = F.pmod("h", "tiles").cast("int"), F.pmod(F.shiftright("h", 20), "slices").cast("int")
    spot = lambda t, s, g: F.struct(t.alias("tile"), s.alias("slice"), F.lit(g).alias("guest"))
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<tile:int,slice:int,guest:int>>"))
    own = F.concat(each(F.col("slices"), lambda s: spot(tile, s, 0)), each(tile, lambda t: spot(t, piece, 1)))
    at = at.withColumn("c", F.explode(F.when(F.col("cell") == F.col("home"), own).otherwise(each(F.col("tiles"), lambda t: spot(t, piece, 1)))))
    at = at.select("cell", "c.tile", "c.slice", "c.guest", "vec_id", "vector")
    return at.repartition("cell", "tile", "slice").sortWithinPartitions("cell", "tile", "slice", "guest").mapInArrow(_meet(threshold), "a long, b long, score double")
