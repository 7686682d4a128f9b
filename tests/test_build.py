from graphloom.operators import answer, build
from graphloom.settings import Settings
from graphloom.sources.kb import Catalog

A = "axiom_type string, entities array<string>"


def test_semantic_chunks_hold_every_sentence_and_overlap():
    t = " ".join(f"Sentence number {i} has some words." for i in range(60))
    chunks = build.semantic_chunks(t, 300, 60)
    assert all(len(c) <= 300 for c in chunks) and len(chunks) > 5
    assert all(f"number {i} " in " ".join(chunks) for i in range(60))
    assert all(b.split(". ")[0].rstrip(".") in a for a, b in zip(chunks, chunks[1:], strict=False))
    assert build.semantic_chunks("", 300, 60) == [] and build.semantic_chunks("short", 300, 60) == ["short"]


def test_build_and_gate(spark):
    docs = spark.createDataFrame([(1, "A dog is an animal. Rex is a dog. A puppy is a dog."), (2, "A dog is an animal."), (3, None)], "doc_id long, text string")
    g = build.build(docs, spark.createDataFrame([], A))
    edges = {(r.src, r.relation, r.dst): r.vote_count for r in g["edges"].collect()}
    assert edges[("dog", "subClassOf", "animal")] == 2 and edges[("Rex", "type", "dog")] == 1
    assert {(r.src, r.relation, r.dst) for r in g["inferred"].collect()} == {("puppy", "subClassOf", "animal"), ("Rex", "type", "animal")}
    none = {k: g[k].limit(0) for k in ("nodes", "edges")}
    same, c = build.gated_merge(none, g, min_score=0.99)
    assert not c.first().merged and same["nodes"].count() == 0
    merged, c = build.gated_merge(none, g)
    assert c.first().merged and c.first().new_nodes == merged["nodes"].count() == g["nodes"].count()


def test_retrieval_prefers_concepts_and_answers(spark):
    n = spark.createDataFrame([(0, "Dog", "Class", "class", "pet"), (1, "Cat", "Class", "class", "pet"), (2, "Rex", "Dog", "instance", None)], "seq long, id string, type string, kind string, description string")
    e = spark.createDataFrame([("Rex", "chases", "Cat")], "src string, relation string, dst string")
    p = spark.createDataFrame([("Rex", "age", "5", "integer")], "entity string, attribute string, value string, datatype string")
    idx = answer.index(n, e, p)
    q = spark.createDataFrame([(1, "whom does rex chase")], "query_id long, question string")
    facts = sorted(answer.retrieve(q, idx, 2).collect(), key=lambda r: r.rank)
    assert facts[0].concept == 1 and {"Rex chases: Cat", "Rex age: 5"} <= {f.full for f in facts if f.concept}
    got = answer.answers(answer.retrieve(q, idx, 2), q, lambda prompt: "Cat [node:Rex]").first()
    assert got.answer == "Cat" and got.n_facts == len(facts)
    r = answer.evaluation(spark.createDataFrame([(1, 7, "whom does rex chase", "Rex chases: Cat")], "query_id long, kb_id int, question string, reference string"), idx).first()
    assert r.n == 1 and r.failures == 0 and r.context_recall == 1.0


def test_settings_profiles(monkeypatch):
    monkeypatch.setenv("GRAPHLOOM_PROFILE", "technical")
    assert Settings.from_env().chunk_size == 1200 and Settings().effective().chunk_size == 2000


def test_repair_command(spark, tmp_path):
    from graphloom.__main__ import main

    n = spark.createDataFrame([(0, "Animal", "Class", "class", "x"), (1, "Dog", "Class", "class", None), (2, "Lost", "Class", "class", None)], "seq long, id string, type string, kind string, description string")
    e = spark.createDataFrame([("Dog", "subClassOf", "Animal")], "src string, relation string, dst string")
    kb = Catalog(spark, str(tmp_path))
    kb.save("k", {"nodes": n, "edges": e, "axioms": spark.createDataFrame([], A), "data_props": spark.createDataFrame([], "entity string, attribute string, value string, datatype string")})
    assert main(["repair", str(tmp_path), "k", "--dry-run"]) == 0 and kb.load("k")["edges"].count() == 1
    assert main(["repair", str(tmp_path), "k"]) == 0
    assert ("Lost", "subClassOf", "DomainRoot") in {(r.src, r.relation, r.dst) for r in kb.load("k")["edges"].collect()}


def test_chunks_of_a_triple_are_gathered_on_demand(spark, monkeypatch):
    """No table that a build writes has a row with all the chunks that say a triple; who asks for them gets them."""
    written, real = {}, build.stored
    monkeypatch.setattr(build, "stored", lambda df, name="t": written.setdefault(name, df.columns) and real(df, name))
    docs = spark.createDataFrame([(i, "A dog is an animal.") for i in range(30)], "doc_id long, text string")
    g = build.build(docs, spark.createDataFrame([], A))
    assert "edges" not in written and not any("chunk_ids" in c for c in written.values())
    r = g["edges"].first()
    assert (r.src, r.relation, r.dst, r.vote_count) == ("dog", "subClassOf", "animal", 30) and sorted(r.chunk_ids) == sorted(f"{i}:0" for i in range(30))
    assert "collect_set" not in g["edges"].select("src", "relation", "dst")._jdf.queryExecution().optimizedPlan().toString()
