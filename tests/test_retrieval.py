"""Retrieval over the different texts of an index against plain numpy over all records."""

import numpy as np
import pytest

from graphloom.operators import answer, retrieve, vector

N, E, P = "seq long, id string, type string, kind string, description string", "src string, relation string, dst string", "entity string, attribute string, value string, datatype string"


def test_an_index_has_no_vectors_of_its_own_and_equal_texts_are_one(spark):
    """Fails where an index encodes each record; ties of records of equal and of different texts go to the first ids."""

    def broken():
        raise RuntimeError("no vector of a record is wanted here")

    n = spark.createDataFrame([(i, f"Item{i % 9}", "Thing", "instance", None) for i in range(30)] + [(30, "thing", "item", "class", None)], N)
    e = spark.createDataFrame([(f"Item{i % 3}", ("has", "HAS")[i % 2], f"box {i}") for i in range(40)] * 2, E)
    p = spark.createDataFrame([("Item1", "size", None if i == 5 else str(i % 2), "int") for i in range(6)], P)
    idx = answer.index(n, e, p, make=broken)
    assert idx.select("record_id", "full").count() == idx.select("record_id").distinct().count() == 10 + 40 + 3
    rows = sorted(idx.select("record_id", "key", "value", "node", "source_ref").collect(), key=lambda r: r.record_id)
    assert [(r.source_ref, r.value or "") for r in rows] == sorted((r.source_ref, r.value or "") for r in rows)
    asked = [(1, "item2 has what"), (2, "box 7"), (3, "zz"), (4, "item2 has what"), (5, None), (6, "")]
    encoder = vector.hash_encoder()
    for k in (1, 4):
        got = {}
        for r in answer.retrieve(spark.createDataFrame(asked, "query_id long, question string"), idx, k).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.record_id, r.concept))
        for i, q in asked:
            x = encoder([q])[0].astype(np.float64)
            best = set()
            for c in ("key", "value"):
                v = encoder([r[c] for r in rows]).astype(np.float64)
                best |= {rows[j].record_id for j in sorted(range(len(rows)), key=lambda j: (-round(float(v[j] @ x), 9), rows[j].record_id))[:k]}
            words = [w for w in (q or "").split() if len(w) > 2]
            hits = [r.record_id for r in rows if any(w in r.node.lower() or r.node.lower() in w for w in words)]
            want = sorted({*hits} | best, key=lambda r: (r not in hits, r))[: min(2 * k, 20)]
            assert sorted(got[i]) == [(j + 1, r, int(r in hits)) for j, r in enumerate(want)], (k, i, q)
    kept = answer.retrieve(spark.createDataFrame(asked, "query_id long, question string"), answer.index(n, e, p), 4, kept=True)
    assert sorted(map(tuple, kept.select("query_id", "rank", "record_id").collect())) == sorted((i, rank, r) for i, x in got.items() for rank, r, _ in x)
    with pytest.raises(Exception, match="no vector"):
        idx.select("key_vector").collect()


def test_texts_are_encoded_where_they_are_compared(spark):
    rows = [(i, f"part {i % 7} of {i % 50}") for i in range(300)] + [(300, None), (301, "")]
    t = spark.createDataFrame(rows, "vec_id long, text string").repartition(3)
    q = vector.encode(spark.createDataFrame([(i, f"of {i} part") for i in range(5)], "query_id long, text string"), "text")
    top = lambda df: sorted(map(tuple, df.collect()))
    assert top(retrieve.top_k(q, t, 3, make=vector.hash_encoder)) == top(retrieve.top_k(q, vector.encode(t, "text"), 3)) == top(retrieve.top_k(q, t, 3, 2, make=vector.hash_encoder))
