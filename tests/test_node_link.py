"""Node-link JSON read in splits of any size, with everything that a file holds, and written in parts."""

import json
import random

import pytest

from graphloom.sources import node_link

TRICKY = ['plain', 'br{ac}es', 'quo"te', 'back\\slash', '\\"both}\\', 'line\nend', 'é日𝔘', '[]', '', '}', '\\', 'a,"b":1}']


def kb(seed, n=40):
    random.seed(seed)
    text = lambda: random.choice(TRICKY) + random.choice(TRICKY)
    nodes = [{"id": f"{text()}{i}", "type": text(), "kind": random.choice(["class", "instance"]), "description": text(), "extra": {"deep": [1, {"x": text()}], "t": text()}, "n": i} for i in range(n)]
    nodes[3] = {"description": "no id"}
    nodes[4]["synonyms"] = ["a}", "b"]
    by_id = [{"source": random.choice(nodes[5:])["id"], "target": random.choice(nodes[5:])["id"], "relation": text(), "confidence": 0.5, "vote_count": 2, "chunk_ids": [1, 2]} for _ in range(n)]
    places = [{"source": random.randrange(n + 3), "target": random.randrange(n), "relation": "by place"} for _ in range(n)]
    return {"directed": True, "graph": {"name": "g}", "list": [1]}, "nodes": nodes, "links": by_id + places, "axioms": [{"axiom_type": "disjointness", "entities": ["a}", "b"], "why": text()}, {"type": "symmetry", "entities": ["r"]}], "data_properties": [{"entity": "e", "attribute": text(), "value": text(), "datatype": "integer", "source_documents": ["d}"]}, {"entity": "e"}], "embedding_cache": {"a}": [0.5, 1], "b": [], text(): [2.5]}}


@pytest.fixture
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("indent", [None, 1])
def test_every_element_whatever_the_splits(spark, tmp_path, tiny_splits, indent):
    data = {"a": kb(1), "b": kb(2, 25)}
    for name, d in data.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=indent is None) + "\n" * (indent or 0))
    assert node_link._fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    want = set()
    for name, d in data.items():
        for section, v in d.items():
            if isinstance(v, list):
                want |= {(name, section, i, None, json.dumps(x, sort_keys=True)) for i, x in enumerate(v)}
            elif isinstance(v, dict):
                want |= {(name, section, i, k, json.dumps(x, sort_keys=True)) for i, (k, x) in enumerate((k, x) for k, x in v.items() if isinstance(x, (list, dict)))}
    rows = node_link.elements(spark, str(tmp_path)).collect()
    got = {(r.file.rsplit("/", 1)[1][0], r.section, r.pos, r.name, json.dumps(json.loads(r.json), sort_keys=True)) for r in rows}
    assert len(rows) == len(got) and got == want


def test_knowledge_base_without_loss(spark, tmp_path, tiny_splits):
    d = kb(3)
    (tmp_path / "g.json").write_text(json.dumps(d))
    t = node_link.read_kb(spark, str(tmp_path / "g.json"))
    ids = [n.get("id", str(i)) for i, n in enumerate(d["nodes"])]
    assert [r.name for r in sorted(t["seed"].collect(), key=lambda r: r.seq)] == ids
    nodes = {r.id: r for r in t["nodes"].collect()}
    assert set(nodes) == set(ids)
    for i, n in zip(ids, d["nodes"], strict=True):
        assert (nodes[i].type, nodes[i].kind, nodes[i].description, nodes[i].synonyms) == (n.get("type", "Entity"), n.get("kind", "class"), n.get("description", ""), n.get("synonyms"))
    assert json.loads(nodes[ids[7]].attributes["extra"]) == d["nodes"][7]["extra"] and nodes[ids[7]].attributes["n"] == "7"
    want = sorted((x["source"], x["relation"], x["target"]) if isinstance(x["source"], str) else (ids[x["source"]], x["relation"], ids[x["target"]]) for x in d["links"] if isinstance(x["source"], str) or x["source"] < len(ids))
    assert sorted((r.src, r.relation, r.dst) for r in t["edges"].collect()) == want
    assert {(r.confidence, r.vote_count) for r in t["edges"].collect()} == {(0.5, 2), (1.0, None)}
    assert sorted((r.axiom_type, tuple(r.entities)) for r in t["axioms"].collect()) == [("disjointness", ("a}", "b")), ("symmetry", ("r",))]
    props = sorted(t["data_props"].collect(), key=lambda r: r.datatype)
    assert (props[0].value, props[0].source_documents, props[1].datatype, props[1].value) == (d["data_properties"][0]["value"], ["d}"], "string", None)
    assert {r.id: [float(x) for x in r.vector] for r in t["vectors"].collect()} == {k: [float(x) for x in v] for k, v in d["embedding_cache"].items()}
    node_link.write_kb(t, str(tmp_path / "out"), 3)
    for f in (tmp_path / "out").glob("part-*.txt"):
        assert set(json.loads(f.read_text())) <= {"nodes", "links", "axioms", "data_properties"}
    again = node_link.read_kb(spark, str(tmp_path / "out"))
    for name in ("nodes", "edges", "axioms", "data_props"):
        rows = lambda x, name=name: sorted(json.dumps({k: ({a: (json.loads(b) if b and b[0] in '{["-0123456789tfn' else b) for a, b in v.items()} if k == "attributes" and v else v or None) for k, v in r.asDict(True).items()}, sort_keys=True) for r in x[name].collect())  # noqa: E731, B023
        assert rows(again) == rows(t), name


def test_files_without_sections(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text('{"nodes": [], "edges": [{"source": "x", "target": "y"}, 7, "z"]}')
    (tmp_path / "c.json").write_text("")
    t = node_link.read_kb(spark, str(tmp_path))
    assert t["nodes"].count() == 0 and [(r.src, r.relation, r.dst, r.confidence) for r in t["edges"].collect()] == [("x", "related_to", "y", 1.0)]


def test_links_by_name_with_numbers_deeper_down(spark, tmp_path):
    d = {"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "r", "of": {"source": 1, "target": 0}}, {"source": "a", "relation": "s", "target": "b", "of": {"source": 1}}, {"source": 1, "target": 0, "relation": "p"}]}
    (tmp_path / "g.json").write_text(json.dumps(d))
    assert sorted((r.src, r.relation, r.dst) for r in node_link.read_kb(spark, str(tmp_path / "g.json"))["edges"].collect()) == [("a", "r", "b"), ("a", "s", "b"), ("b", "p", "a")]


def test_fragments_of_a_batch_are_one_text():
    text = ('{"a": [1, "x"], "nodes": [' + ",".join(json.dumps({"id": t, "deep": [{"x": {"y": t}}]}) for t in TRICKY) + '], "e": {"k\\\\\\"}": [1]}}').encode()
    for cut in (i for i in range(len(text) + 1) if text[:i][-1:] != b"\\"):  # fragments end with a brace
        s, open_, got = node_link.Scanner(), b"", []
        for part in (text[:cut], text[cut:]):
            for piece, name, begins, ends in s.read(part):
                open_ = piece if begins else open_ + piece
                got += [(s.section, name, json.loads(open_))] if ends else []
        assert [x[2] for x in got] == [*({"id": t, "deep": [{"x": {"y": t}}]} for t in TRICKY), [1]] and (s.in_string, s.depth) == (False, 0), cut
    assert len(list(node_link.Scanner().read(text))) == len(TRICKY) + 1
