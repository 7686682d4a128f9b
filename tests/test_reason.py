from pyspark.sql import functions as F

from graphloom.operators import components, fixpoint, quality, reason, strong

E = "src string, relation string, dst string"
A = "axiom_type string, entities array<string>"


def triples(df):
    return {(r.src, r.relation, r.dst) for r in df.collect()}


def test_inference_adds_subsumption_and_inheritance(spark):
    e = spark.createDataFrame([("A", "subClassOf", "B"), ("B", "subClassOf", "C"), ("x", "type", "A")], E)
    t = reason.infer(e, spark.createDataFrame([], A))
    assert triples(t) == {("A", "subClassOf", "C"), ("x", "type", "B"), ("x", "type", "C")}
    assert {r.rule for r in t.collect()} == {"transitive_subsumption", "inheritance"}


def test_empty_graph_adds_nothing(spark):
    assert reason.infer(spark.createDataFrame([], E), spark.createDataFrame([], A)).count() == 0


def test_disjointness(spark):
    e = spark.createDataFrame([("x", "type", "Cat"), ("x", "type", "Dog"), ("y", "type", "Cat")], E)
    v = reason.disjointness(e, spark.createDataFrame([("disjointness", ["Cat", "Dog"])], A)).collect()
    assert [(r.instance, r.a, r.b) for r in v] == [("x", "Cat", "Dog")]


def test_symmetric_and_inverse_and_range(spark):
    e = spark.createDataFrame([("A", "related_to", "B"), ("s", "supplies", "p")], E)
    ax = spark.createDataFrame([("inverse", ["supplies", "suppliedBy"]), ("domain", ["supplies", "S"]), ("range", ["supplies", "P"])], A)
    assert triples(reason.infer(e, ax)) == {("B", "related_to", "A"), ("p", "suppliedBy", "s"), ("s", "type", "S"), ("p", "type", "P")}


def test_deep_chain_and_two_relations_on_one_pair(spark):
    rows = [(f"L{i + 1}", "subClassOf", f"L{i}") for i in range(4)] + [("L0", "subClassOf", "Root"), ("L4", "likes", "Root")]
    t = triples(reason.infer(spark.createDataFrame(rows, E), spark.createDataFrame([], A)))
    assert ("L4", "subClassOf", "Root") in t and ("L4", "likes", "Root") not in t


def test_cycle_closure_keeps_or_drops_self(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d")], E)
    assert fixpoint.transitive_closure(e, include_self=True).count() == 12
    assert fixpoint.transitive_closure(e).count() == 9
    assert strong.cycle_edges(e).count() == 3


def test_closure_is_idempotent(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c")], E)
    once = fixpoint.transitive_closure(e)
    assert triples(fixpoint.transitive_closure(once)) == triples(once)


def test_components_match_union_find_and_ignore_order(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent}
    for order in (edges, [(b, a) for a, b in reversed(edges)]):
        got = components.connected_components(spark.createDataFrame(order, "src long, dst long"))
        assert {r.node: r.component for r in got.collect()} == want


def test_relation_properties_boundaries(spark):
    chains = lambda n: [(f"a{i}", "t", f"b{i}") for i in range(n)] + [(f"b{i}", "t", f"c{i}") for i in range(n)]
    p = lambda rows: reason.relation_properties(spark.createDataFrame(rows, E)).first()
    assert not p(chains(3)).transitive and p(chains(4)).transitive
    back = lambda n, m: [(f"x{i}", "s", f"y{i}") for i in range(n)] + [(f"y{i}", "s", f"x{i}") for i in range(m)]
    seven_of_ten = [*back(0, 0), *[(f"x{i}", "s", f"x{i}") for i in range(7)], *[(f"z{i}", "s", f"w{i}") for i in range(3)]]
    assert not p(seven_of_ten).symmetric and p(back(4, 4)).symmetric


def test_health_counts_orphans_and_components(spark):
    n = spark.createDataFrame([(i, x, "Class", "class", "d" if x != "e" else None) for i, x in enumerate("abcde")], "seq long, id string, type string, kind string, description string")
    e = spark.createDataFrame([("a", "subClassOf", "b"), ("c", "subClassOf", "d")], E)
    h = quality.health_score(quality.health(n, e)).first()
    assert (h.n, h.m, h.orphans, h.components, h.largest, h.unlabeled) == (5, 2, 1, 3, 2, 1)
    assert abs(h.density - 0.2) < 1e-9 and h.badge == "Needs Attention"


def test_depths_from_first_root(spark):
    n = spark.createDataFrame([(i, x, "Class", "class", None) for i, x in enumerate(["top", "mid", "low", "other"])], "seq long, id string, type string, kind string, description string")
    e = spark.createDataFrame([("mid", "subClassOf", "top"), ("low", "subClassOf", "mid")], E)
    assert {r.id: r.depth for r in quality.depths(n, e).collect()} == {"top": 0, "mid": 1, "low": 2, "other": 0}


def test_consistency_kinds(spark):
    e = spark.createDataFrame([("A", "subClassOf", "B"), ("B", "subClassOf", "A"), ("C", "subClassOf", "D"), ("C", "subClassOf", "E"), ("D", "subClassOf", "E"), ("p", "over", "q"), ("q", "over", "p")], E)
    ax = spark.createDataFrame([("disjointness", ["A", "B"]), ("asymmetry", ["over"])], A)
    k = {r.kind: r.n for r in quality.consistency(e, ax).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert k == {"disjoint_subclass": 2, "two_way_subclass": 2, "shared_parent": 1, "asymmetric_both_ways": 2}


def test_set_metrics_of_empty_sets(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "key string")
    m = lambda a, b: quality.set_metrics(a, b).first()
    r = m(s("A", "B", "C"), s("A", "B"))
    assert r.recall == 1 and r.precision < 1
    assert m(s(), s("x")).f1 == 0 and m(s(), s()).f1 == 1


def test_relations_without_chains_are_not_searched_for_triangles(spark, monkeypatch):
    """Copies, loops, reverses and missing ends are told from one grouping by the ends of edges; only relations with chains go on to triangles."""
    rows = [("a", "r", "b"), ("b", "r", "a"), ("b", "r", "c"), ("a", "r", "c"), ("c", "r", "c"), ("c", "r", "d"), ("a", "r", "b"), (None, "r", "d"), ("d", "r", None)] + [(f"s{i % 7}", "flat", f"p{i}") for i in range(30)]
    kept, real = [], reason.stored
    monkeypatch.setattr(reason, "stored", lambda df, name="t": kept.append((name, real(df, name))) or kept[-1][1])
    got = {r.relation: (r.n, r.backs, r.open_chains) for r in reason.relation_properties(spark.createDataFrame(rows, E)).collect()}
    e = set(rows)
    full = {x for x in e if None not in x}
    chains = sum(1 for a, r, b in full for c, s, d in full if r == s == "r" and b == c and a != d and a != b and c != d and (a, "r", d) not in full)
    assert got == {"r": (8, sum((b, r, a) in full for a, r, b in full if r == "r"), chains), "flat": (30, 0, 0)}
    assert [n for n, _ in kept] == ["pairs", "chains"] and {r.relation: r.chains for r in kept[1][1].collect()}["flat"] == 0
