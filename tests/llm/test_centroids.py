"""Centroid clustering against exact arithmetic over messy vectors, and screening that rules centroids out without changing a result."""

import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import centroids

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) <= 1 << 27 for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    pack = lambda v: np.array(v, "<i1" if max(map(abs, v)) < 128 else "<i2" if max(map(abs, v)) < 32768 else "<i4").tobytes()
    c = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), pack(r[1])))[:16]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, x), k) for k, x in enumerate(c))
    for _ in range(3):
        of = [near(v)[1] for _, v in kept]
        for k in set(of):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == k]
            c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    per = {k: sum(d for _, x, d in got if x == k) for _, k, _ in got}
    return [(i, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in got]


def vectors():
    random.seed(3)
    middle = [[random.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [m + random.gauss(0, 0.2) for m in middle[i % 6]]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.1] * 63), (203, [0.1] * 65), (204, [None] + [0.1] * 63), (205, [math.nan] * 64), (206, [math.inf] + [0.0] * 63), (207, [1e30] * 64)]
    rows += [(210, [0.0] * 64), (211, [0.0] * 64), (212, [3.0] * 64), (213, [500.0] * 64), (214, [-2097152.0] + [0.5] * 63), (None, [0.25] * 64), (None, [0.25] * 64), (3, rows[3][1]), (3, rows[4][1])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_match_exact_arithmetic(spark, kind):
    rows = vectors()
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, q string").repartition(4)
    out = centroids.cluster(df)
    assert out.columns == COLUMNS
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert order(map(tuple, out.collect())) == order(brute(rows))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64)], "vec_id int, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in centroids.cluster(df).collect()) == [(1, 0), (2, 0)]
    assert centroids.cluster(df.limit(0)).count() == 0


def test_screening_spares_distances_and_never_a_nearer_centroid():
    rng = np.random.default_rng(0)
    middle = rng.integers(-60, 60, (16, 64))
    q = middle[rng.integers(0, 16, 5000)] + rng.integers(-9, 10, (5000, 64))
    best, cost, made = centroids.nearest(q, *centroids.segments(q), middle)
    d = ((q[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (cost == d.min(axis=1)).all()
    assert made < 0.2 * d.size
    assert (centroids.bounds(*centroids.segments(q), *centroids.segments(middle)) <= d).all()
    same = np.repeat(middle[:1], 16, axis=0)
    assert (centroids.nearest(q, *centroids.segments(q), same)[0] == 0).all()
