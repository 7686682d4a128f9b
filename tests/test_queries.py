"""Every registered query has the same rows as its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A spread of operators; the whole list runs with TEST_ALL=1.
SOME = ["p1_classes", "p6_noise", "j1_inheritance", "j7_cooccurrence", "g2_closure", "a1_triples", "a12_correctness", "w1_query_cap", "f16_relaxed_recall", "f24_fidelity", "o1_top_k", "t7_sessions", "k7_turtle", "r4_context"]


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()) if os.environ.get("TEST_ALL") else SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    r = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(r.columns, r.fetchall())


def test_entry_lists():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
