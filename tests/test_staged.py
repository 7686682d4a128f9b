"""Staged and single-shot extraction: replies of a model, stages that fail, what is known to a stage, budgets, and building from stages."""

import json

from graphloom.operators import build, extract


def chunks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_id long, text string").repartition(3)


def test_three_replies_of_a_model(spark):
    replies = {
        "classes": '```json\n{"classes": [{"name": "Vehicle", "parent": null, "description": "A means of transport"}]}\n```',
        "instances": '[{"name": "Tesla Model 3", "class_name": "Vehicle", "description": "Electric car"}, {"name": "Ghost", "class_name": "Spirit"}, 7]',
        "relations": '{"object_properties": [{"source": "Tesla Model 3", "relation": "instance_like", "target": "vehicle", "confidence": 0.9}, {"source": "Tesla Model 3", "relation": "manufactured_by", "target": "Tesla"}], "data_properties": [{"entity": "Tesla Model 3", "attribute": "wheels", "value": 4}], "axioms": [{"axiom_type": "magic", "entities": ["Vehicle"]}, {"axiom_type": "functional", "entities": ["Vehicle"]}]}',
    }
    prompts = {"classes": "1|{chunk}", "instances": "2|{classes}|{chunk}", "relations": "3|{classes}|{instances}|{chunk}"}

    def model(prompt):
        stage, *given = prompt.split("|")
        if stage == "2":
            assert json.loads(given[0]) == [{"name": "Vehicle"}], given
        if stage == "3":
            assert json.loads(given[1]) == [{"name": "Tesla Model 3", "class_name": "Vehicle"}], given
        return replies[{"1": "classes", "2": "instances", "3": "relations"}[stage]]

    df = chunks(spark, [(1, 0, "Text about vehicles: a vehicle, a Tesla Model 3")])
    r = extract.staged_extract(df, extract.prompted(model, prompts)).first()
    assert r.error is None and r.errors == {}, r
    assert [(c.name, c.description) for c in r.classes] == [("Vehicle", "A means of transport")]
    assert [(i.name, i.class_name) for i in r.instances] == [("Tesla Model 3", "Vehicle")]
    assert [(x.src, x.relation, x.dst, x.confidence) for x in r.relations] == [("Tesla Model 3", "instance_like", "vehicle", 0.9)]
    assert [tuple(x) for x in r.data_properties] == [("Tesla Model 3", "wheels", "4", None)]
    assert [(x.axiom_type, x.entities) for x in r.axioms] == [("functional", ["Vehicle"])]


def test_without_strictness_unknown_names_stay(spark):
    df = chunks(spark, [(1, 0, "A dog is an animal. Rex requires Bone.")])
    rel = lambda **kw: [(x.src, x.dst) for x in extract.staged_extract(df, **kw).first().relations]
    assert rel() == [] and rel(strict=False) == [("Rex", "Bone")]


def test_a_stage_that_fails_leaves_the_others(spark):
    for bad in ("classes", "instances", "relations"):

        def model(stage, chunk, classes, instances, bad=bad):
            if stage == bad and "bad" in chunk:
                raise RuntimeError(f"{stage} down")
            return extract.staged_rules(stage, chunk, classes, instances)

        got = {r.doc_id: r for r in extract.staged_extract(chunks(spark, [(1, 0, "A dog is an animal. Rex is a dog. Rex requires animal."), (2, 0, "bad A dog is an animal. Rex is a dog. Rex requires animal."), (3, 0, None)]), model).collect()}
        assert got[1].errors == {} and got[3].errors == {} and got[2].errors == {bad: f"{bad} down"} and got[2].error == f"{bad} down"
        full = [len(got[1][c]) for c in ("classes", "instances", "relations")]
        assert full == [2, 1, 1] and [len(got[3][c]) for c in ("classes", "instances", "relations")] == [0, 0, 0]
        assert [len(got[2][c]) for c in ("classes", "instances", "relations")] == {"classes": [0, 0, 0], "instances": [2, 0, 0], "relations": [2, 1, 0]}[bad]


def test_scope_and_budget_of_what_is_known(spark):
    rows = [(1, 0, "A dog is an animal. A cat is an animal."), (1, 1, "Rex is a dog. Tom is a cat."), (2, 0, "Rex is a dog.")]
    seen = lambda **kw: sorted((r.doc_id, r.chunk_id, sorted(i.name for i in r.instances)) for r in extract.staged_extract(chunks(spark, rows), **kw).collect() if r.instances)
    assert seen() == [(1, 1, ["Rex", "Tom"])]
    assert seen(scope="chunk") == []

    def model(stage, chunk, classes, instances):
        if stage == "classes":
            return [{"name": n, "salience": s} for n, s in (("dog", 0.2), ("cat", 0.9), ("Cat", 0.9)) if n.lower() in chunk.lower()]
        if stage == "instances":
            return [{"name": json.dumps(classes), "class_name": "cat"}]
        return {}

    known = lambda **kw: {r.chunk_id: [i.name for i in r.instances] for r in extract.staged_extract(chunks(spark, rows[:2]), model, **kw).collect()}
    assert known()[0] == known()[1] == ['[{"name": "Cat"}, {"name": "dog"}]']
    assert known(vocabulary=20)[0] == ['[{"name": "Cat"}]'] and known(vocabulary=5)[0] == ["[]"]
    assert extract.staged_extract(chunks(spark, rows).limit(0)).count() == 0


def test_single_shot_falls_back_to_text_once(spark):
    def model(text, plain):
        if "schema" in text and not plain:
            raise RuntimeError("Invalid JSON Schema: Unrecognized schema")
        if "down" in text:
            raise RuntimeError("model down")
        return "not json" if "junk" in text else json.dumps({"entities": [{"name": "A", "type": "T", "description": "d"}], "relations": [{"source": "A", "relation": "r", "target": "B", "confidence": 0.8}]})

    got = {r.doc_id: r for r in extract.single_shot(chunks(spark, [(1, 0, "Some text"), (2, 0, "schema"), (3, 0, "down"), (4, 0, "junk")]), model).collect()}
    for i in (1, 2):
        assert [e.name for e in got[i].entities] == ["A"] and [(r.src, r.relation, r.dst, r.confidence) for r in got[i].relations] == [("A", "r", "B", 0.8)] and got[i].error is None
    assert got[3].error == "model down" and not got[3].entities and got[4].error is None and not got[4].entities


def test_building_from_stages(spark):
    docs = spark.createDataFrame([(1, "A dog is an animal. Rex is a dog. Rex has a size of 3. No dog is a animal."), (2, "A dog is an animal.")], "doc_id long, text string")
    g = build.build(docs, spark.createDataFrame([], "axiom_type string, entities array<string>"), staged=True)
    assert {(r.src, r.relation, r.dst) for r in g["edges"].collect()} == {("dog", "subClassOf", "animal"), ("Rex", "type", "dog")}
    assert [tuple(r) for r in g["data_props"].collect()] == [("Rex", "size", "3", "integer")]
    assert [(r.axiom_type, r.entities) for r in g["axioms"].collect()] == [("disjointness", ["dog", "animal"])]
    assert ("Rex", "type", "animal") in {(r.src, r.relation, r.dst) for r in g["inferred"].collect()}


def test_stages_keep_types_and_texts_without_pandas(spark):
    """A stage gives its chunks' texts on, so that what it found needs no join to be compared with them."""
    df = spark.createDataFrame([("d", 7, "A dog is an animal.")], "doc_id string, chunk_id int, text string").selectExpr("*", "'[]' known_classes", "'[]' known_instances")
    got = extract._stage(df, "classes", extract.staged_rules, 1)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    r = got.first()
    assert (r.doc_id, r.chunk_id, r.text, r.error) == ("d", 7, "A dog is an animal.", None) and [(c.name, c.parent, c.salience) for c in r.classes] == [("animal", None, None), ("dog", "animal", None)]
