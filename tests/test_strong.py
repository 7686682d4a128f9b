"""Strongly connected components against reachability, on random graphs, long chains and cycles, with rounds counted."""

import random

import pytest

from graphloom.operators import strong


def brute(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(x):
        seen, front = set(), {x}
        while front:
            front = {z for y in front for z in to.get(y, ())} - seen
            seen |= front
        return seen

    r = {x: reach(x) for x in {y for e in edges for y in e}}
    return {x: min(y for y in r[x] if x in r[y]) for x in r if x in r[x]}


def got(spark, edges):
    rows = strong.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", [1, 3])
def test_random_graphs(spark, seed):
    random.seed(seed)
    n = 60
    edges = [(f"n{random.randrange(n)}", f"n{random.randrange(n)}") for _ in range(int(n * (0.8 + 0.3 * seed)))]
    edges += [(None, "n1"), ("n2", None), ("n3", "n3"), edges[0]]
    edges += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("c2", "n5"), ("d0", "d1"), ("d1", "d0"), ("d1", "c3"), ("loop", "loop"), ("n7", "loop")]
    assert got(spark, edges) == brute([e for e in edges if None not in e])


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    rounds = []
    one = strong._rake_and_compress
    monkeypatch.setattr(strong, "_rake_and_compress", lambda e: rounds.append(1) or one(e))
    n = 400
    chain = [(f"a{i:05}", f"a{i + 1:05}") for i in range(n)]
    assert got(spark, chain) == {} and len(rounds) < 26
    rounds.clear()
    ring = [(f"r{i:05}", f"r{(i + 1) % n:05}") for i in range(n)]
    assert got(spark, ring + chain[:50] + [("a00050", "r00000")]) == {f"r{i:05}": "r00000" for i in range(n)} and len(rounds) < 26


def test_cycle_edges_and_no_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "x"), ("c", "x")], "src string, dst string")
    assert {tuple(r) for r in strong.cycle_edges(e).collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("x", "x")}
    assert strong.cycle_edges(e.limit(0)).count() == 0 and strong.strong_components(e.where("src = 'c'")).count() == 0
    numbers = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    assert {tuple(r) for r in strong.strong_components(numbers).collect()} == {(1, 1), (2, 1)}
