"""Queries that do the whole job, on small tables where a part of it gives other rows."""

import re
from difflib import SequenceMatcher
from types import SimpleNamespace

import pytest
import test_queries
from pyspark.sql import functions as F

from graphloom.operators import retrieve, vector
from graphloom.plans import registry, scans
from graphloom.sources import documents, export

DATA = "/root/testdata/sf0.001"


def test_entities_of_all_documents(spark, tmp_path):
    texts = ["NeuralNet and GPU", "Der MüllerWagen, ÉCOLE, été", "éABC ²DEF ABCé GHI ÀJKL", 'sagte "schöne Grüße" zu NeuralNet é', "_ABC naïveNet NaiveNet, FooBaré"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    of = lambda t: set(re.findall(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", t) + re.findall(r"\b([A-Z]{3,})\b", t) + re.findall(r'"([^"]+)"', t))
    got = {r.doc_id: r.n for r in registry.queries()["f19_entities"](spark, str(tmp_path)).collect()}
    assert got == {i: len(of(t)) for i, t in enumerate(texts)}


def test_more_queries_and_blocks_than_one_job_holds(spark):
    import numpy as np

    x = np.random.default_rng(2).integers(-2, 3, size=(90, 6)).astype(np.float32)
    v = spark.createDataFrame([(i * 7, [float(f) for f in r]) for i, r in enumerate(x)], "vec_id long, vector array<float>")
    q = v.withColumnRenamed("vec_id", "query_id")
    rows = lambda df: sorted((r.query_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert rows(retrieve.top_k(q, v, 3, max_queries=8)) == rows(retrieve.top_k(q, v, 3)) and len(rows(retrieve.top_k(q, v, 3, max_queries=8))) == 270


def test_two_hops_over_all_edges(spark):
    test_queries.test_query_matches_sql(spark, "j10_two_hops")
    rows = registry.queries()["j10_two_hops"](spark, DATA).where("v like 'Part#%'")
    assert rows.where("u like 'Supplier#%'").count() > 0 and rows.select("w").distinct().count() > 1


def test_ntriples_of_all_kinds(spark, monkeypatch):
    n = spark.createDataFrame([(0, "Animal", "Class", "class", 'a "living"\nthing'), (1, "Dog", "Class", "class", None), (2, "Rex", "Dog", "instance", None)], "seq long, id string, type string, kind string, description string")
    e = spark.createDataFrame([("Dog", "subClassOf", "Animal"), ("Rex", "type", "Dog"), ("Rex", "likes", "Dog")], "src string, relation string, dst string")
    p = spark.createDataFrame([("Rex", "age", "5", "integer")], "entity string, attribute string, value string, datatype string")
    a = spark.createDataFrame([("disjointness", ["Cat", "Dog"])], "axiom_type string, entities array<string>")
    monkeypatch.setattr(scans, "Graph", lambda spark, d: SimpleNamespace(nodes=n, edges=e, data_props=p, axioms=a))
    b, rdf, rdfs, owl = export.BASE, export.RDF, export.RDFS, export.OWL
    uris = [(b + "Animal", rdf + "type", owl + "Class"), (b + "Dog", rdf + "type", owl + "Class"), (b + "Rex", rdf + "type", owl + "NamedIndividual"), (b + "Rex", rdf + "type", b + "Dog"), (b + "Dog", rdfs + "subClassOf", b + "Animal")]
    uris += [(b + "likes", rdf + "type", owl + "ObjectProperty"), (b + "Rex", b + "likes", b + "Dog"), (b + "age", rdf + "type", owl + "DatatypeProperty"), (b + "Cat", owl + "disjointWith", b + "Dog"), (b.rstrip("#/"), rdf + "type", owl + "Ontology")]
    want = {f"<{s}> <{p}> <{o}> ." for s, p, o in uris} | {f'<{b}{x}> <{rdfs}label> "{x}" .' for x in ("Animal", "Dog", "Rex")}
    want |= {f'<{b}Animal> <{rdfs}comment> "a \\"living\\"\\nthing" .', f'<{b}Rex> <{b}age> "5"^^<{export.XSD}integer> .', f'<{b.rstrip("#/")}> <{rdfs}label> "ontology" .'}
    got = [r.line for r in registry.queries()["k7_ntriples"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["a12_correctness", "j3_node_context", "g7_relation_properties"])
def test_all_edges(spark, name):
    test_queries.test_query_matches_sql(spark, name)
    rows = [str(r) for r in registry.queries()[name](spark, DATA).collect()]
    assert all(any(x in r for r in rows) for x in ("tradesWith", "hasBrand", "supplies"))


def test_build_reads_customers_and_parts(spark):
    got = {tuple(r) for r in registry.queries()["c1_build"](spark, DATA).select("src", "relation", "dst").collect()}
    word = lambda t: re.sub("[^a-z]", "", t.lower())
    want = set()
    for t, key, kind, of, name in (("part", "p_partkey", "p_type", "product", "Part"), ("customer", "c_custkey", "c_mktsegment", "market", "Customer")):
        for k, x in spark.read.parquet(f"{DATA}/{t}.parquet").select(key, kind).collect():
            want |= {(word(x), "subClassOf", of), (f"{name}{k}", "type", word(x)), (f"{name}{k}", "type", of)}
    assert got == want


def test_bridges_by_way_of_a_node(spark):
    at = {"R": (1, 0, 0, 0), "T": (0.8, 0.6, 0, 0), "M": (0.78, 0.5, 0.3764, 0), "S": (0, 0, 0, 1), "D": (0, 0.2, 0, 0.98), "W": (0, -0.74, 0, 0.6726)}

    def make():
        import numpy as np

        return lambda texts: np.array([at.get(t.split()[0], (0, 0, -1, 0)) for t in texts], np.float32)

    def bridges(ids, **more):
        n = spark.createDataFrame(list(enumerate(["T", "M", "D", "X", *ids])), "seq long, id string").withColumn("description", F.lit(None).cast("string"))
        e = spark.createDataFrame([("T", "M"), ("M", "D"), ("D", "X")], "src string, dst string").withColumn("relation", F.lit("r"))
        return {(r.src, r.dst) for r in vector.bridge_components(n, e, make=make, **more).collect()}

    assert bridges(["R", "S"]) == {("R", "M"), ("M", "T"), ("S", "D")}
    assert bridges(["R", "S"], between=0.95) == {("R", "T"), ("S", "D")}
    at["D"], at["S"] = (0, 0, 0, 1), (0, 0, (1 - 0.72**2) ** 0.5, 0.72)
    assert bridges(["S"]) == set()
    assert ("S", "D") in bridges(["S", *(f"far{i}" for i in range(20))])


def test_names_near_by_cosine_join(spark):
    n = spark.createDataFrame([("knowledge graphs", 0), ("cat", 1), ("knowledge graph", 2), ("Cat", 3)], "name string, seq long")
    assert {r.name: r.canonical for r in vector.canonical_names(n).collect()} == {"knowledge graphs": "knowledge graphs", "knowledge graph": "knowledge graphs", "cat": "cat", "Cat": "cat"}


def test_grounded_by_ratio(spark, tmp_path):
    texts, names = ["Red Widgte", "blu gear", "zzz zzz", "a long text that has nothing of it " * 3, "tiny blue gaer cog"], ["red wdget", "blue gear", "ab"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(x,) for x in names], "p_name string").write.parquet(str(tmp_path / "part.parquet"))

    def grounded(name, t):
        n, t = name.lower(), t.lower()
        return n in t or any(w in t for w in n.split() if len(w) > 3) or SequenceMatcher(None, n, t).ratio() >= 0.6

    got = {(r.doc_id, r.name) for r in registry.queries()["p5_grounded_full"](spark, str(tmp_path)).collect()}
    assert got == {(i, x) for i, t in enumerate(texts) for x in names if grounded(x, t)} and (0, "red wdget") in got
    less = {(r.doc_id, r.name): r.grounded for r in registry.queries()["p5_grounded"](spark, str(tmp_path)).collect()}
    assert not less[(0, "red wdget")]


def test_whole_page_text(spark, tmp_path):
    html = "<p>" + "a word " * 3000 + "last</p>"
    pages = spark.createDataFrame([(1, "http://x.org/", html)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    text = "a word " * 3000 + "last"
    assert registry.queries()["s7_page_text"](spark, str(tmp_path)).first().content == text
    assert documents.page_rows(pages).first().content == text and len(documents.page_rows(pages, 8000).first().content) == 8000
