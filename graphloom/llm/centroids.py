"""Centroid clustering with block-norm screening: each vector carries the sums and squares of its segments, from which Cauchy-Schwarz gives
a lower bound of its distance to each centroid; only centroids that no bound rules out get an exact integer distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Components of a vector, components of a segment, steps of a unit, clusters, rounds.
DIMENSIONS, SEGMENT, SCALE, CLUSTERS, ROUNDS = 64, 8, 64, 16, 3
SEGMENTS = DIMENSIONS // SEGMENT
#: The largest whole component whose squared distances a long can hold: 64 (2 * 2**27)**2 = 2**62.
LARGEST = 1 << 27
#: Relative room of the bounds, which are computed in doubles, so that rounding never rules a centroid out.
ROOM = 1e-9
#: Rows of a vector matrix that a task works on at once.
ROWS = 4096
COMPRESSED = "vec_id {}, q binary, sums array<long>, squares array<long>"


def whole(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, q (the whole components as little-endian integers of 1, 2 or 4 bytes), sums and squares (of each segment) of the kept vectors."""
    x = F.transform(column, lambda v: v.cast("double"))
    fits = lambda v: F.coalesce((v >= -LARGEST / SCALE) & (v <= LARGEST / SCALE), F.lit(False))  # noqa: E731  false for nulls, NaN and infinities
    rows = vectors.where(F.coalesce(F.size(column) == DIMENSIONS, F.lit(False))).select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.forall("x", fits))
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("x"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            s, n = segments(q)
            most = np.abs(q).max(axis=1)
            packed = [row.astype("<i1" if m < 128 else "<i2" if m < 32768 else "<i4").tobytes() for row, m in zip(q, most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(list(s)), pa.array(list(n))], ["vec_id", "q", "sums", "squares"])

    return rows.mapInArrow(run, COMPRESSED.format(rows.schema["vec_id"].dataType.simpleString()))


def segments(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of squares of each segment of whole vectors."""
    parts = q.astype(np.int64).reshape(len(q), SEGMENTS, SEGMENT)
    return parts.sum(axis=2), (parts * parts).sum(axis=2)


def unpacked(q: pa.Array) -> np.ndarray:
    """Whole vectors of packed ones, as longs."""
    raw = q.to_pylist()
    out = np.empty((len(raw), DIMENSIONS), np.int64)
    widths = np.array([len(r) for r in raw]) // DIMENSIONS
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{w}").reshape(-1, DIMENSIONS)
    return out


def bounds(sums: np.ndarray, squares: np.ndarray, centre_sums: np.ndarray, centre_squares: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances, vectors by centroids. A segment is its mean and a rest without mean: means differ exactly, and rests
    by the difference of their norms at least (Cauchy-Schwarz)."""
    rest = lambda s, n: np.sqrt(np.maximum(n - s * (s / SEGMENT), 0.0))
    a, b = sums.astype(np.float64), centre_sums.astype(np.float64)
    ra, rb = rest(a, squares.astype(np.float64)), rest(b, centre_squares.astype(np.float64))
    low = np.zeros((len(a), len(b)))
    for k in range(SEGMENTS):
        low += (a[:, k, None] - b[None, :, k]) ** 2 / SEGMENT + (ra[:, k, None] - rb[None, :, k]) ** 2
    far = squares.astype(np.float64).sum(axis=1)[:, None] + centre_squares.astype(np.float64).sum(axis=1)[None, :]
    return low - ROOM * far - 0.5


def nearest(q: np.ndarray, sums: np.ndarray, squares: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid (ties: the smaller number), and how many distances were computed."""
    low = bounds(sums, squares, *segments(centres))
    order, every = np.argsort(low, axis=1, kind="stable"), np.arange(len(q))
    best, cost, made = np.full(len(q), -1), np.full(len(q), np.iinfo(np.int64).max), 0
    for k in range(len(centres)):
        c = order[:, k]
        left = np.flatnonzero(low[every, c] <= cost)  # bounds rise with k: a row that one rules out is done
        if not len(left):
            break
        made += len(left)
        c = c[left]
        d = ((q[left] - centres[c]) ** 2).sum(axis=1)
        better = (d < cost[left]) | ((d == cost[left]) & (c < best[left]))
        best[left[better]], cost[left[better]] = c[better], d[better]
    return best, cost, made


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            t = b.slice(at, ROWS)
            lists = [t.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, SEGMENTS) for c in ("sums", "squares")]
            yield t, unpacked(t.column("q")), *lists


def sums_by_cluster(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """cluster, n and the exact sums of components, of the vectors nearest to each centroid. A task sends one row a cluster."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        n, total = np.zeros(len(sent.value), np.int64), np.zeros(sent.value.shape, np.int64)
        for _, q, sums, squares in _slices(batches):
            best, _, _ = nearest(q, sums, squares, sent.value)
            n += np.bincount(best, minlength=len(n))
            for c in np.unique(best):
                total[c] += q[best == c].sum(axis=0)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has]), pa.array(list(total[has]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    found = rows.mapInArrow(run, "cluster long, n long, total array<long>")
    exact = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(DIMENSIONS)]
    return found.groupBy("cluster").agg(F.sum("n").alias("n"), *exact)


def first_centres(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt and vec_id; ties by components; a null vec_id comes last. Fewer vectors: all of them."""
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(h.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return unpacked(pa.array([bytes(r.q) for r in chosen], pa.binary()))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "1:", id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per kept row of vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of 64 components, none null, NaN or infinite, whose whole components floor(64 x) are within 2**27, beyond which
    a long can't hold distances. In each round the vectors go to the nearest centroid (ties: the smaller number), and each
    centroid that has any becomes the floor of their mean; means are of exact sums. Then all are assigned once more. Repeated rows and
    null ids are rows like others; an inertia that no long can hold is null. No vectors: no rows.

    Only k centroids come to the driver and go to the tasks; a task sends k rows of sums at most. So a cluster with most of the rows
    is as many tasks as the table has.
    """
    rows = stored(whole(vectors, id_col, column), "vectors")
    centres = first_centres(rows, k, salt)
    for _ in range(rounds if len(centres) else 0):
        for r in sums_by_cluster(rows, centres).collect():
            centres[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(DIMENSIONS)]
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for t, q, sums, squares in _slices(batches):
            best, cost, _ = nearest(q, sums, squares, sent.value)
            yield pa.RecordBatch.from_arrays([t.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(cost)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = stored(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda v: v if v < 1 << 63 else None
    told = [(c, long(s), long(sum(per.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    told = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    assign = "SELECT vec_id, q, r, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (SELECT v.*, c.k, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} c) GROUP BY vec_id, q, r"
    mean = """c{j} AS (SELECT c{i}.k, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (SELECT k, list(t ORDER BY i) AS q FROM
    (SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS t FROM (SELECT k, unnest(q) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) m ON m.k = c{i}.k)"""
    steps = [f"a{i} AS ({assign.format(i=i)}), {mean.format(i=i, j=i + 1)}" for i in range(ROUNDS)]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q, row_number() OVER () AS r FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, q FROM v ORDER BY sha256('1:' || vec_id) LIMIT {CLUSTERS}),
{", ".join(steps)}, z AS ({assign.format(i=ROUNDS)})
SELECT vec_id, z.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.q, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} ON z.k = c{ROUNDS}.k
"""


ORACLE = _sql()
