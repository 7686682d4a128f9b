"""Nearest vectors: ties, equal vectors and odd ones against plain numpy; the encoder against its definition."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.operators import retrieve, vector


def test_nearest_of_many_equal_vectors_are_the_first_ids(spark, monkeypatch):
    """Equal vectors have equal scores wherever they lie, so the least ids win; before, a product's rounding could tell them apart."""
    monkeypatch.setattr(retrieve, "COLUMNS", 16)
    monkeypatch.setattr(retrieve, "TILE", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 33)).astype(np.float32)
    v = [(i, base[(i * 7) % 40].tolist()) for i in range(1500)] + [(1500, [0.0] * 33), (1501, [float("nan")] * 33)]
    q = [(i, (base[i] + np.float32(0.01) * base[(i + 1) % 40]).tolist()) for i in range(40)] + [(40, [0.0] * 33), (41, [float("nan")] * 33)]
    vs, qs = spark.createDataFrame(v, "vec_id long, vector array<float>").repartition(5), spark.createDataFrame(q, "query_id long, vector array<float>")
    got = {}
    for r in retrieve.top_k(qs, vs, 5, max_queries=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in range(40):
        x = np.array([u for _, u in v[:1500]], np.float64)
        s = np.round((x @ np.array(q[i][1])) / np.linalg.norm(x, axis=1), 9)
        assert got[i] == np.lexsort((np.arange(1500), -s))[:5].tolist()
    assert got[40] == [0, 1, 2, 3, 4] and len(got[41]) == 5


def test_search_reads_vectors_without_python_numbers():
    """unit_rows takes a column's buffer; lists of Python numbers made the search slow."""
    c = pa.array([[3.0, 4.0], [0.0, 0.0], [None, 1.0]], pa.list_(pa.float32()))
    got = retrieve.unit_rows(c)
    assert np.allclose(got[:2], [[0.6, 0.8], [0, 0]]) and np.isnan(got[2]).all()
    assert np.allclose(retrieve.unit_rows(pa.chunked_array([c.slice(0, 1), c.slice(1, 1)])), [[0.6, 0.8], [0, 0]])
    assert len(retrieve.unit_rows(c.slice(0, 0))) == 0


def test_encoder_hashes_words_and_trigrams(monkeypatch):
    monkeypatch.setattr(vector, "CHARACTERS", 50)
    texts = ["", None, " ", "ab", "Part#12 large ring", "naïve 漢字かな x", "İstanbul a\tb\n", "A b " * 40]
    got = vector.hash_encoder(16)(texts)
    for t, x in zip(texts, got, strict=True):
        t, want = (t or "").lower(), np.zeros(16, np.float32)
        for w in [*t.split(), *(t[j : j + 3] for j in range(len(t) - 2))]:
            h = zlib.crc32(w.encode())
            want[h % 16] += 1.0 if h & 0x80000000 else -1.0
        n = np.linalg.norm(want)
        assert np.array_equal(x, want / (n if n > 0 else 1))
    assert vector.hash_encoder(16)([]).shape == (0, 16)


def test_equal_texts_of_a_batch_are_encoded_once(spark):
    def make():
        return lambda texts: np.array([[float(len(texts)), float(len(set(texts)))]] * len(texts), np.float32).reshape(-1, 2)

    rows = spark.range(60).coalesce(1).select("id", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("text"))
    assert {tuple(r.vector) for r in vector.encode(rows, "text", make).collect()} == {(3.0, 3.0)}
