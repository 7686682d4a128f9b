"""Near-duplicate vectors against all pairs: messy rows, crowds, tiles and slices, recall at the threshold."""

import math

import numpy as np
import pytest

from graphloom.llm import near_vectors

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [fine(v) for _, v in rows]
    unit = [near_vectors.unit([np.array(v, "<f8").tobytes()], "<f8")[0] if f else None for f, (_, v) in zip(ok, rows, strict=True)]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= 0.95 or rows[i][1] == rows[j][1])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, front = {i}, [i]
        while front:
            front = [k for j in front for k in links[j] if k not in seen and not seen.add(k)]
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), comp, rows[i][0] == comp))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def around(rng, middle, cos, n):
    """n unit vectors with just this cosine to a unit vector."""
    off = rng.normal(size=(n, len(middle)))
    off -= (off @ middle)[:, None] * middle
    return cos * middle + math.sqrt(1 - cos**2) * off / np.linalg.norm(off, axis=1, keepdims=True)


def unit_vectors(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def messy():
    rng = np.random.default_rng(4)
    base = unit_vectors(rng, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k, cos in enumerate((0.999, 0.98, 0.96, 0.94, 0.9)):
        rows += [(100 + 20 * k + i, v.tolist()) for i, v in enumerate(around(rng, base[k], cos, 12))]
    crowd = around(rng, base[9], 0.993, 60)
    rows += [(300 + i, v.tolist()) for i, v in enumerate(crowd)] + [(400 + i, v.tolist()) for i, v in enumerate(around(rng, base[9], 0.955, 20))]
    rows += [(500, None), (501, []), (502, [0.0] * 64), (503, [None] + [1.0] * 63), (504, [math.nan] * 64), (505, [math.inf] * 64), (506, [1.0] * 63), (507, [2.0] * 63), (508, [1.0]), (509, [3.0]), (510, [-1.0])]
    rows += [(511, (1e200 * base[3]).tolist()), (512, (1e-300 * base[3]).tolist()), (513, (-base[3]).tolist()), (None, base[4].tolist()), (None, [0.0] * 64), (7, base[8].tolist()), (7, base[8].tolist()), (514, [-0.0] * 63 + [1.0]), (515, [0.0] * 63 + [1.0])]
    return rows


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, digest string, row int").repartition(4)


def test_links_match_all_pairs(spark):
    rows = messy()
    out = near_vectors.near_vectors(frame(spark, rows))
    assert out.columns == COLUMNS
    assert ordered(out.collect()) == ordered(brute(rows))


@pytest.fixture
def batches_of_all_rows(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_tiles_slices_and_no_crowds(spark, monkeypatch):
    rows = [r for r in messy() if r[1] and len(r[1]) == 64]
    for name, value in (("TILE", 16), ("VISITORS", 24), ("CROWD", 10**6)):
        monkeypatch.setattr(near_vectors, name, value)
    assert ordered(near_vectors.near_vectors(frame(spark, rows)).collect()) == ordered(brute(rows))
    monkeypatch.setattr(near_vectors, "CROWD", 8)
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 4)
    assert ordered(near_vectors.near_vectors(frame(spark, rows)).collect()) == ordered(brute(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_few_and_no_rows(spark, kind):
    df = frame(spark, [(3, [1.0, 0.0]), (2, [1.0, 0.0])], kind)
    assert ordered(near_vectors.near_vectors(df).collect()) == [(2, 1, 2, True), (3, 1, 2, False)]
    assert near_vectors.near_vectors(df.limit(0)).count() == 0
    assert ordered(near_vectors.near_vectors(frame(spark, [(1, None)], kind)).collect()) == [(1, 0, 1, True)]


def test_recall_of_pairs_at_the_threshold(spark, batches_of_all_rows):
    rng = np.random.default_rng(6)
    base = unit_vectors(rng, 3000)
    other = np.concatenate([around(rng, v, 0.9501, 1) for v in base])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other]))]
    x = np.concatenate([base, other])
    links = int((x @ x.T >= 0.95).sum()) - len(x)
    got = near_vectors.near_vectors(frame(spark, rows).coalesce(1)).groupBy().sum("n_links").first()[0]
    assert links >= 6000 and 0.99 * links <= got <= links


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random((50, 9)), rng.random((50, 7))
    rows, cells = near_vectors.traverse(a, b, 0.4)
    for r in range(50):
        cost = (a[r][:, None] + b[r][None, :]).ravel()
        got = cells[rows == r]
        assert sorted(got) == sorted(np.flatnonzero(cost <= cost.min() + 0.4))
        assert (np.diff(cost[got]) >= 0).all()
