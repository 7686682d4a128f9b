"""Inference from changes against inference anew, and the rules against a plain loop to the fixpoint."""

import random

import pytest

from graphloom.operators import reason

E = "src string, relation string, dst string"
AXIOMS = [("inverse", ["supplies", "suppliedBy"]), ("inverse", ["near", "nearTo"]), ("inverse", ["near", "closeBy"]), ("domain", ["supplies", "S"]), ("range", ["suppliedBy", "P"]), ("transitivity", ["inside"]), ("symmetry", ["touches"]), ("symmetry", ["inside2"]), ("transitivity", ["inside2"])]


def fixpoint(edges):
    """Every edge that follows, by applying all rules to all edges until nothing is new."""
    closed, sym = {"subClassOf", "inside", "inside2"}, {"touches", "inside2"}
    inv = [y for k, e in AXIOMS if k == "inverse" for y in ((e[0], e[1]), (e[1], e[0]))]
    known = set(edges)
    while True:
        new = {(a, r, d) for a, r, b in known if r in closed for c, r2, d in known if r2 == r and b == c and a != d}
        new |= {(x, "type", d) for x, r, a in known if r == "type" for c, r2, d in known if r2 == "subClassOf" and a == c}
        new |= {(b, r, a) for a, r, b in known if r in sym} | {(b, q, a) for a, r, b in known for p, q in inv if p == r}
        new |= {(a, "type", "S") for a, r, b in known if r == "supplies"} | {(b, "type", "P") for a, r, b in known if r == "suppliedBy"}
        if new <= known:
            return known
        known |= new


def graph(seed, n=45):
    random.seed(seed)
    names = [f"n{i}" for i in range(12)]
    rel = ["subClassOf", "type", "inside", "inside2", "touches", "supplies", "suppliedBy", "near", "nearTo", "closeBy", "likes"]
    return {(random.choice(names), random.choice(rel), random.choice([*names, "S", "P"])) for _ in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows), E)


def triples(df):
    rows = [(r.src, r.relation, r.dst) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_reach_the_fixpoint(spark, seed):
    edges = graph(seed)
    ax = spark.createDataFrame(AXIOMS, "axiom_type string, entities array<string>")
    assert triples(reason.infer(frame(spark, edges), ax)) == fixpoint(edges) - edges


@pytest.mark.parametrize("seed", [3, 4])
def test_changes_give_what_a_full_run_gives(spark, seed):
    edges = graph(seed)
    ax = spark.createDataFrame(AXIOMS, "axiom_type string, entities array<string>")
    inferred = fixpoint(edges) - edges
    removed = set(random.sample(sorted(edges), 8)) | {("no", "such", "edge")}
    # some that were inferred are now said, and some are said anew that were removed
    added = (graph(seed + 50, 8) | set(random.sample(sorted(inferred), 2))) | set(sorted(removed)[:1])
    after = (edges - removed) | added
    got, new = reason.reinfer(frame(spark, edges), frame(spark, inferred), frame(spark, added).union(frame(spark, added)), frame(spark, removed), ax)
    assert triples(got) == after and triples(new) == fixpoint(after) - after


def test_cycles_lose_their_own_support(spark):
    edges = {("a", "inside", "b"), ("b", "inside", "c"), ("c", "inside", "a"), ("x", "type", "A"), ("A", "subClassOf", "B"), ("B", "subClassOf", "A")}
    ax = spark.createDataFrame(AXIOMS, "axiom_type string, entities array<string>")
    inferred = fixpoint(edges) - edges
    for gone in (("b", "inside", "c"), ("x", "type", "A"), ("A", "subClassOf", "B")):
        after, new = reason.reinfer(frame(spark, edges), frame(spark, inferred), frame(spark, set()), frame(spark, {gone}), ax)
        assert triples(after) == edges - {gone} and triples(new) == fixpoint(edges - {gone}) - (edges - {gone})
    after, new = reason.reinfer(frame(spark, edges), frame(spark, inferred), frame(spark, set()), frame(spark, set()), ax)
    assert triples(after) == edges and triples(new) == inferred
