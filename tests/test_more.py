"""Small tests of views, judgements, hierarchies, knowledge bases in versions, stored indexes, and loops that end in time."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import answer, extract, fixpoint, hierarchy, judge, merge, reason, repair, retrieve, vector, viewer
from graphloom.sources import kb
from graphloom.streaming import incremental

E = "src string, relation string, dst string"
N = "id string, seq long, type string, kind string, description string"


def nodes(spark, *ids, kind="class"):
    return spark.createDataFrame([(x, i, "Class", kind, None) for i, x in enumerate(ids)], N)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_view_has_roots_levels_clusters_and_cycles(spark):
    e = spark.createDataFrame([("b", "subClassOf", "a"), ("b", "subClassOf", "a"), ("c", "subClassOf", "b"), ("c", "x", "gone")], E)
    v = viewer.view(nodes(spark, "a", "b", "c", "z"), e)
    assert {r.id: (r.root, r.level, r.cluster, r.isolated) for r in v["nodes"].collect()} == {"a": (True, 0, "a", False), "b": (False, 1, "a", False), "c": (False, 2, "a", False), "z": (True, 0, "z", True)}
    assert v["edges"].count() == 2 and not v["cyclic"].first().cyclic
    ring = viewer.view(nodes(spark, "a", "b"), spark.createDataFrame([("a", "subClassOf", "b"), ("b", "subClassOf", "a")], E))
    assert ring["cyclic"].first().cyclic and [r.id for r in ring["nodes"].where("root").collect()] == [viewer.VIRTUAL_ROOT]


def test_hidden_edges_and_stored_views(spark, tmp_path):
    e = spark.createDataFrame([("a", "subClassOf", "b"), ("a", "type", "c"), ("a", "x", "d")], E)
    shown = lambda **k: {r.dst for r in viewer.hidden(e, **k).where("not hidden").collect()}
    assert shown() == {"b", "c", "d"} and shown(zoom=0.4) == {"b"} and shown(zoom=0.6) == {"b", "c"} and shown(show="other") == {"d"} and shown(show="type") == {"c"} and shown(mode="classes") == {"b"} and shown(mode="instances") == {"c"}
    c = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "id string, cluster string")
    assert shown(show="intraCluster", clusters=c) == {"b"}
    path = str(tmp_path / "v")
    assert viewer.load_view(spark, path, "g1") is None
    viewer.save_view(viewer.view_rows(nodes(spark, "a", "b", "c", "d"), e), path, "g1")
    assert viewer.load_view(spark, path, "g1").count() == 7 and viewer.load_view(spark, path, "g2") is None and viewer.load_view(spark, path, "g1", 2) is None


def test_judgements_and_prompts(spark):
    items = spark.createDataFrame([(1, "q1", "good", ["f"], "r"), (2, "q2", "bad", ["f"] * 40, "r")], "seq long, question string, answer string, facts array<string>, reference string")
    for kind in judge.PROMPTS:
        assert got(judge.judge(items, kind, lambda p: "1.0" if "good" in p else "")) == [(1, 1.0), (2, 0.0)]
    assert got(judge.natural_questions(items, lambda p: " Why? " if "q1" in p else "no")) == [(1, "Why?"), (2, "q2")]
    assert got(judge.references(items, lambda p: str(p.count("\nf")))) == [(1, "1"), (2, str(judge.FACTS))]
    assert got(judge.claim_batches(items, lambda p: "a\n\n b ")) == [(1, ["a", "b"]), (2, ["a", "b"])]
    assert judge.is_schema_error(ValueError("Unsupported response_format")) and not judge.is_schema_error("time out")
    assert judge.language_instruction("en") == "" and "German" in judge.language_instruction("de") and "xx" in judge.extraction_prompt("xx")


def test_completion_backs_off_and_gives_up_on_long_prompts(spark):
    def model(p):
        if p == "long":
            raise ValueError("maximum context length")
        if p == "bad":
            raise ValueError("no")
        return p

    rows = spark.createDataFrame([(1, "long"), (2, "bad"), (3, "fine")], "seq long, prompt string")
    out = {r.seq: (r.reply, r.error) for r in extract.complete(rows, model, attempts=2, wait=0.01).collect()}
    assert out == {1: ("", "maximum context length"), 2: ("", "no"), 3: ("fine", None)}


def test_taxonomy_and_enrichment(spark):
    C = "name string, seq long, parent string, description string, synonyms array<string>"
    c = spark.createDataFrame([("Network", 1, None, None, []), ("Neural Network", 2, "Nothing", None, []), ("Deep Neural Network", 3, "Network", None, []), ("Tree", 4, None, None, [])], C)
    assert {r.name: r.parent for r in hierarchy.build_taxonomy(c).collect()} == {"Network": None, "Neural Network": "Network", "Deep Neural Network": "Neural Network", "Tree": None}
    wrong = hierarchy.build_taxonomy(c, lambda p: json.dumps({"taxonomy": [{"name": "Tree", "parent": "Tree"}, {"name": "Network", "parent": "Unknown"}]}))
    assert {r.name: r.parent for r in wrong.collect()}["Tree"] is None
    many = spark.createDataFrame([(f"n{i:02}", i, None, None, []) for i in range(12)], C)
    again = hierarchy.build_taxonomy(many, lambda p: json.dumps({"taxonomy": [{"name": "n01", "parent": "n00"}]}) if "top" in p else "{}")
    assert {r.name: r.parent for r in again.where("parent is not null").collect()} == {"n01": "n00"}
    flat = spark.createDataFrame([("red apple", "subClassOf", "Thing"), ("red apples", "subClassOf", "Thing"), ("zebra", "subClassOf", "Thing")], E)
    new = hierarchy.enrich(nodes(spark, "Thing", "red apple", "red apples", "zebra"), flat, least=0.6)
    assert got(new.select("src", "dst")) == [("red apples", "red apple")]
    targets = hierarchy.population_targets(nodes(spark, "a", "b"), spark.createDataFrame([("a", "x", "b"), ("i", "type", "a")], E))
    assert [r.id for r in targets.collect()] == ["b"]
    windows = spark.createDataFrame([("text one",), ("text two",)], "text string")
    found = hierarchy.boost_population(targets, nodes(spark, "a", "b"), windows, lambda p: '```json\n{"instances": [{"name": "Rex", "description": "d"}, {"name": "a"}]}\n```')
    assert got(found) == [("Rex", "b", "d")]


def test_versions_survive_a_write_that_dies(spark, tmp_path):
    c = kb.Catalog(spark, str(tmp_path))
    none = {"axioms": spark.createDataFrame([], "axiom_type string"), "data_props": spark.createDataFrame([], "entity string")}
    tables = lambda k: {"nodes": spark.range(k), "edges": spark.range(k), **none}
    c.save("k", tables(1), name="K")
    broken = spark.range(3).select(F.assert_true(F.col("id") < 2).alias("x"), "id")
    with pytest.raises(Exception):  # noqa: B017
        c.save("k", {**tables(3), "edges": broken})
    assert c.load("k")["nodes"].count() == 1 and len(c.versions("k")) == 1
    c.save("k", {**c.load("k"), "nodes": c.load("k")["nodes"].union(spark.range(1))})  # tables that are read from what is written
    c.update("k", description="d")
    assert c.load("k")["nodes"].count() == 2 and c.metadata("k").description == "d" and c.metadata("k").name == "K"
    for _ in range(3):
        c.update("k", language="fr")
    assert c.load("k")["nodes"].count() == 2 and len(c.versions("k")) == 2 and [r.language for r in c.list().collect()] == ["fr"]
    assert c.load_health("k") is None
    c.save_health("k", spark.range(1))
    assert c.load_health("k").count() == 1
    c.delete("k")
    assert not c.exists("k")


def test_stored_index_questions_and_nodes(spark, tmp_path):
    n = spark.createDataFrame([("Dog", 0, "Class", "class", "a barking animal"), ("Animal", 1, "Class", "class", None)], N)
    e = spark.createDataFrame([("Dog", "subClassOf", "Animal")], E)
    p = spark.createDataFrame([("Dog", "legs", "4")], "entity string, attribute string, value string")
    path = str(tmp_path / "i")
    assert answer.load_index(spark, path) is None
    answer.index(n, e, p, path=path)
    idx = answer.load_index(spark, path)
    q = spark.createDataFrame([(1, "what is a dog")], "query_id long, question string")
    r = answer.query_kb(q, idx).first()
    assert r.concepts == ["Animal", "Dog"] and ("Dog", "subClassOf", "Animal") in [tuple(x) for x in r.relations] and ("Dog", "Class") in [tuple(x) for x in r.definitions]
    a = answer.node_answers(q, n, e, 1).first()
    assert a.supporting == ["Dog"] and a.confidence == 1.0 and "barking" in a.answer
    syn = spark.createDataFrame([("Cat", 0, ["house tiger"]), ("Tiger", 1, [])], "id string, seq long, synonyms array<string>")
    asked = spark.createDataFrame([(1, "is the house tiger wild")], "query_id long, question string")
    assert got(retrieve.question_entities(asked, syn)) == [(1, "Cat"), (1, "Tiger")]


def test_loops_raise_where_they_do_not_end(spark, monkeypatch):
    e = spark.createDataFrame([(f"n{i:02}", "r", f"n{i + 1:02}") for i in range(20)], E)
    small = got(fixpoint.transitive_closure(e))
    monkeypatch.setattr(fixpoint, "FEW", 0)
    assert got(fixpoint.transitive_closure(e)) == small and len(small) == 210
    with pytest.raises(RuntimeError):
        fixpoint.transitive_closure(e, max_rounds=2)
    assert fixpoint.bfs_levels(e, spark.createDataFrame([("n00",)], "node string")).count() == 21
    a = spark.createDataFrame([], "axiom_type string, entities array<string>")
    with pytest.warns(RuntimeWarning):
        reason.infer(spark.createDataFrame([("a", "subClassOf", "b"), ("x", "type", "a")], E), a, max_rounds=1)


def test_open_chains_against_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    pairs = {(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}") for _ in range(34)}
    want = sum(1 for a, b in pairs for c, d in pairs if b == c and a != d and (a, d) not in pairs)
    r = reason.relation_properties(spark.createDataFrame([(a, "r", b) for a, b in pairs], E)).first()
    assert r.open_chains == want and r.n == len(pairs) and r.backs == sum((b, a) in pairs for a, b in pairs)


def test_batches_mix_components(spark):
    rows = spark.createDataFrame([(f"a{i}", "A", i) for i in range(5)] + [("b0", "B", 10), ("b1", "B", 11)], "id string, component string, seq long")
    out = sorted((r.place, r.id, r.batch) for r in merge.interleave(rows, 3).collect())
    assert out == [(i, x, i // 3) for i, x in enumerate(["a0", "b0", "a1", "b1", "a2", "a3", "a4"])]


def test_orphans_pairs_and_empty_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.1])], "vec_id long, vector array<float>")
    assert [(r.a, r.b) for r in vector.similar_pairs(v, 0.9).collect()] == [(1, 3)] and vector.similar_pairs(v.limit(0), 0.5).count() == 0
    assert vector.clusters(v.limit(0)).count() == 0
    n = nodes(spark, "a", "b", "c", "d", "lone")
    e = spark.createDataFrame([("a", "x", "b"), ("b", "x", "c")], E)
    assert got(repair.component_pairs(n, e)) == [("d", "b"), ("lone", "b")]
    inst = nodes(spark, "red apple", "red appel", kind="instance")
    r = repair.repair_incremental(n.union(inst.withColumn("seq", F.col("seq") + 10)), e.union(spark.createDataFrame([("red apple", "type", "a")], E)))
    assert {(x.src, x.dst, x.step) for x in r.where("step = 'root'").collect()} == {("d", "DomainRoot", "root"), ("lone", "DomainRoot", "root")}


def test_streams_of_pages_and_turns(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([(1, "u1", "about dogs", 0.5), (2, "u2", "nothing", 0.5)], "page_id long, url string, content string, fidelity double").write.parquet(str(src / "a"))
    s = spark.readStream.schema("page_id long, url string, content string, fidelity double").option("recursiveFileLookup", "true").parquet(str(src))
    q = spark.createDataFrame([("dogs", "dogs definition")], "id string, query string")
    for _ in range(2):  # the second run finds nothing new
        incremental.enrich(s, q, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert got(incremental.read_grown(spark, str(tmp_path / "out"), "page_id long, query string").select("page_id", "query")) == [(1, "dogs definition")]
    with incremental.Timer() as t:
        pass
    assert t.seconds >= 0
    log = str(tmp_path / "log")
    assert kb.read_log(spark, log, "a int").count() == 0
    kb.append_log(spark.range(2), log)
    kb.append_log(spark.range(1), log)
    assert kb.read_log(spark, log, "id long").count() == 3
