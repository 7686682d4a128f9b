"""Tables in versions, indexes that are reused, lemmas by a table."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import answer, vector
from graphloom.sources import kb, versions

N, E, P = "seq long, id string, type string, kind string, description string", "src string, relation string, dst string", "entity string, attribute string, value string, datatype string"


def test_versions_are_whole_and_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.versions(spark, path) == [] and versions.read_version(spark, path) is None
    one = versions.write_version(spark, path, {"a": spark.range(3)}, None)
    first = versions.read_version(spark, path)["a"]
    two = versions.write_version(spark, path, {"a": first.where("id > 0"), "b": spark.range(1)}, one)  # made from what it replaces
    assert {k: v.count() for k, v in versions.read_version(spark, path).items()} == {"a": 2, "b": 1} and first.count() == 3
    with pytest.raises(RuntimeError, match="not at"):
        versions.write_version(spark, path, {"a": spark.range(9)}, one)
    assert versions.versions(spark, path) == [one, two]
    three = versions.write_version(spark, path, {"a": spark.range(5)})
    assert versions.versions(spark, path) == [two, three] and versions.read_version(spark, path, one) is None
    with pytest.raises(Exception, match="boom"):  # a write that dies leaves the version before
        versions.write_version(spark, path, {"a": spark.range(5).select(F.raise_error(F.lit("boom")))})
    assert versions.read_version(spark, path)["a"].count() == 5


def test_an_index_is_made_anew_only_where_records_changed(spark, tmp_path):
    n = spark.createDataFrame([(0, "Dog", "Class", "class", "pet"), (1, "Cat", "Class", "class", "pet")], N)
    e = spark.createDataFrame([("Dog", "chases", "Cat"), ("Cat", "likes", "Dog")], E)
    p = spark.createDataFrame([("Dog", "age", "5", "integer")], P)
    path = str(tmp_path / "i")
    idx, k = answer.refresh_index(n, e, p, path)
    assert k == 5 and idx.count() == 5
    assert answer.refresh_index(n.orderBy("id"), e.orderBy("dst").union(e), p, path)[1] == 0
    more = e.union(spark.createDataFrame([("Dog", "eats", "Bone")], E)).where("relation != 'likes'")
    idx, k = answer.refresh_index(n, more, p, path)
    whole = lambda x: sorted((r.record_id, r.full, r.source_ref, list(r.key_vector), list(r.value_vector)) for r in x.collect())
    fresh = answer.index(n, more, p)
    assert k == 1 and [x[1:] for x in whole(idx)] == [x[1:] for x in whole(fresh)] and len({x[0] for x in whole(idx)}) == 5
    assert versions.read_version(spark, path)["hyperedges"].where("node = 'Dog'").count() == 4
    assert whole(answer.load_index(spark, path)) == whole(idx)
    empty = answer.refresh_index(n.limit(0), e.limit(0), p.limit(0), str(tmp_path / "e"))
    assert empty[1] == 0 and empty[0].count() == 0


def test_equal_texts_are_encoded_once(spark, tmp_path):
    """By their number in the kept texts, with the vectors of an index made anew; records are written without vectors."""
    n = spark.createDataFrame([(i, f"N{i}", "Class", "class", "x") for i in range(20)], N)
    e = spark.createDataFrame([("N0", "r", f"N{i}") for i in range(20)] + [(f"N{i}", "r", "N0") for i in range(20)], E)
    p, path = spark.createDataFrame([], P), str(tmp_path / "i")
    idx, k = answer.refresh_index(n, e, p, path)
    assert k == 59
    kept = versions.read_version(spark, path)
    texts = {t for r in idx.select("key", "value").collect() for t in r}
    assert sorted(r.text for r in kept["texts"].collect()) == sorted(texts) and "key_vector" not in kept["index"].columns
    more = e.unionByName(spark.createDataFrame([("N1", "r", "N2")], E))
    idx, k = answer.refresh_index(n, more, p, path)
    whole = lambda x: sorted((r.full, r.source_ref, list(r.key_vector), list(r.value_vector)) for r in x.collect())
    assert k == 1 and whole(idx) == whole(answer.index(n, more, p))
    assert answer.graph_digest(idx.drop("record_id")) == answer.graph_digest(idx.unionByName(idx))


def test_two_writers_of_a_knowledge_base(spark, tmp_path, monkeypatch):
    c = kb.Catalog(spark, str(tmp_path))
    t = {"nodes": spark.createDataFrame([], N), "edges": spark.createDataFrame([], E), "axioms": spark.createDataFrame([], "axiom_type string, entities array<string>"), "data_props": spark.createDataFrame([], P)}
    c.save("k", t)
    real, calls = kb.Catalog.versions, []

    def late(self, kb_id):
        calls.append(1)
        return real(self, kb_id) + (["99999999.other"] if len(calls) > 3 else [])

    monkeypatch.setattr(kb.Catalog, "versions", late)
    with pytest.raises(RuntimeError, match="another version"):
        c.update("k", name="x")
    monkeypatch.setattr(kb.Catalog, "versions", real)
    c.save_health("k", spark.range(1))
    c.save_health("k", c.load_health("k").drop("kb_id").union(spark.range(1)))  # made from the report that it replaces
    assert c.load_health("k").count() == 2 and c.metadata("k").name == "k"


def test_lemmas_follow_their_table(spark):
    table = text.Lemmas({"mice": "mouse", "geese": "goose"}, [("s", "", 2), ("ies", "y", 2), ("ss", "ss", 0)])
    words = {"mice": "mouse", "Geese": "goose", "flies": "fly", "ties": "tie", "glass": "glass", "dogs": "dog", "as": "as", "": "", "s": "s", "die": "die", "red-dogs": "red dog", "Dog's mice": "dog mouse", "  cats  flies ": "cat fly"}
    rows = spark.createDataFrame([(x,) for x in words] + [(None,)], "name string")
    assert {r.name: r.lemma for r in rows.select("name", text.lemmatised("name", table).alias("lemma")).collect()} == {**words, None: None}
    n = spark.createDataFrame([("graph", 0), ("Graphs", 1), ("mouse", 2), ("mice", 3)], "name string, seq long")
    assert {r.name: r.canonical for r in vector.canonical_names(n, make=None, lemmas=table).collect()} == {"graph": "graph", "Graphs": "graph", "mouse": "mouse", "mice": "mouse"}
