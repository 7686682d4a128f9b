import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import merge, repair, retrieve, vector
from graphloom.sources import documents, export, kb
from graphloom.streaming import incremental

NODES = "seq long, id string, type string, kind string, description string"
EDGES = "src string, relation string, dst string"


def graph(spark):
    n = spark.createDataFrame([(0, "Animal", "Class", "class", "a living thing"), (1, "Dog", "Class", "class", None), (2, "Rex", "Dog", "instance", None)], NODES)
    e = spark.createDataFrame([("Dog", "subClassOf", "Animal"), ("Rex", "type", "Dog"), ("Rex", "likes", "Dog")], EDGES)
    p = spark.createDataFrame([("Rex", "age", "5", "integer")], "entity string, attribute string, value string, datatype string")
    a = spark.createDataFrame([("disjointness", ["Cat", "Dog"])], "axiom_type string, entities array<string>")
    return n, e, a, p


def test_triples_in_all_formats(spark):
    n, e, a, p = graph(spark)
    t = export.triples(n, e, p, a)
    text = lambda f: "\n".join(r.line for r in export.serialize(t, f).collect())
    nt = text("nt")
    assert "owl#Class" in nt and "disjointWith" in nt and '"5"^^<http://www.w3.org/2001/XMLSchema#integer>' in nt
    assert "subClassOf" in text("turtle") and '"@id"' in text("json-ld") and "rdf:about" in text("xml")
    with pytest.raises(ValueError):
        export.serialize(t, "nope")


def test_knowledge_base_round_trip(spark, tmp_path):
    n, e, a, p = graph(spark)
    c = kb.Catalog(spark, str(tmp_path))
    tables = {"nodes": n, "edges": e, "axioms": a, "data_props": p}
    c.save("k1", tables, name="First", documents=["a.txt"])
    made = c.metadata("k1").created_at
    c.save("k1", tables, documents=["b.txt", "a.txt"], merge=True)
    m = c.metadata("k1")
    assert m.created_at == made and m.documents == ["a.txt", "b.txt"] and m.name == "First"
    c.update("k1", description="text")
    assert c.metadata("k1").description == "text" and c.load("k1")["edges"].count() == 3 and c.list().count() == 1
    c.delete("k1")
    with pytest.raises(FileNotFoundError):
        c.load("k1")


def test_documents_by_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.xyz").write_text("x")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Hi) Tj ET\nendstream")
    (tmp_path / "d.pdf").write_bytes(b"junk")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "hello" and "unsupported" in rows["b.xyz"].error and rows["c.pdf"].text == "Hi" and rows["d.pdf"].text is None


def test_node_link_by_position_and_id(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": 0, "target": 1, "relation": "r"}]}')
    n, e = documents.read_node_link(spark, str(tmp_path / "g.json"))
    assert n.count() == 2 and [(r.src, r.dst) for r in e.collect()] == [("a", "b")]


def test_ties_go_to_the_first_row(spark):
    rows = spark.createDataFrame([("a", 1, "xx", None, ["s"], 1), ("a", 2, "yy", "P", ["t", "s"], 2)], "id string, seq long, description string, parent string, synonyms array<string>, chunk_id long")
    r = merge.aggregate_entities(rows).first()
    assert (r.description, r.parent, r.synonyms, r.chunk_ids) == ("xx", "P", ["s", "t"], [1, 2])
    c = spark.createDataFrame([("Animal", 0, None, "long text", []), ("animal", 1, "Thing", "x", ["beast"]), ("Plant", 2, None, "", [])], "name string, seq long, parent string, description string, synonyms array<string>")
    assert {x.key: (x.name, x.parent) for x in merge.dedup_classes(c).collect()} == {"animal": ("animal", "Thing"), "plant": ("Plant", None)}


def test_cooccurrence(spark):
    m = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 2), ("c", 1)], "id string, chunk_id long")
    known = spark.createDataFrame([("c", "a")], "src string, dst string")
    assert {(r.a, r.b, r.shared) for r in merge.cooccurrence(m, known).collect()} == {("a", "b", 2), ("b", "c", 2)}
    hot = spark.createDataFrame([(f"e{i}", c) for i in range(40) for c in range(1 + i % 3)] + [("e1", None), ("e2", None)], "id string, chunk_id int")
    want = {(*sorted((f"e{i}", f"e{j}")), 1 + min(i % 3, j % 3)) for i in range(40) for j in range(i) if min(i % 3, j % 3)}
    for tile in (3, 1024):
        got = [(r.a, r.b, r.shared) for r in merge.cooccurrence(hot, known, tile=tile).collect()]
        assert len(got) == len(want) and set(got) == want


def test_set_cover_gains_fall(spark):
    s = spark.createDataFrame([("q", "a", [1, 2, 3]), ("q", "b", [3, 4]), ("q", "c", [1, 2]), ("q", "d", [5])], "question string, node string, record_ids array<long>")
    rows = sorted(retrieve.set_cover(s).collect(), key=lambda r: r.pick)
    assert [(r.node, r.gain) for r in rows] == [("a", 3), ("b", 1), ("d", 1)]


def test_set_cover_of_many_questions_by_a_plain_loop(spark):
    """Ties, empty sets, records that come twice; no task holds a question."""
    import random

    random.seed(5)
    rows = [(f"q{i % 3}", f"n{i // 3}", random.choices(range(40), k=random.randrange(7))) for i in range(90)]
    want = set()
    for q in ("q0", "q1", "q2"):
        left = {}
        for k, n, r in rows:
            if k == q:
                left.setdefault(n, set()).update(r)
        for i in range(4):
            n = min(left, key=lambda n: (-len(left[n]), n))
            if left[n]:
                want.add((q, i + 1, n, len(left[n])))
            left = {m: r - left[n] for m, r in left.items()}
    got = retrieve.set_cover(spark.createDataFrame(rows, "question string, node string, record_ids array<long>"), 4)
    assert {tuple(r) for r in got.collect()} == want
    assert "InPandas" not in got._jdf.queryExecution().toString()
    assert retrieve.set_cover(spark.createDataFrame([("q", "a", [])], "question string, node string, record_ids array<long>")).collect() == []


def test_top_k_and_clusters_match_numpy(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(120, 8))
    x[60:] = x[:60] + 0.05 * x[60:]
    v = spark.createDataFrame([(i, [float(f) for f in r]) for i, r in enumerate(x)], "vec_id long, vector array<float>")
    q = v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    u = (x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)).astype(float)
    want = {(i, int(j)) for i in range(5) for j in np.argsort(-(u[i] @ u.T))[:3]}
    assert {(r.query_id, r.vec_id) for r in retrieve.top_k(q, v, 3).collect()} == want
    leaders, got = [], {}
    for i in range(120):
        hit = next((j for j in leaders if u[i] @ u[j] >= 0.9), None)
        got[i] = i if hit is None else hit
        leaders += [i] if hit is None else []
    assert {r.vec_id: r.leader for r in vector.clusters(v, 0.9).collect()} == got
    leaders, wide = [], {}
    for i in range(120):
        wide[i] = next((j for j in leaders if u[i] @ u[j] >= 0.5), i)
        leaders += [i] if wide[i] == i else []
    for at_once in (0, 200, 500_000):  # all by rounds, some, none
        assert {r.vec_id: r.leader for r in vector.clusters(v, 0.5, at_once).collect()} == wide


def test_canonical_names_join_overlaps(spark):
    n = spark.createDataFrame([("Big Red Dog House", 0), ("big red dog house", 1), ("Big Red Dog House Two", 2), ("cat", 3)], "name string, seq long")
    assert {r.name: r.canonical for r in vector.canonical_names(n).collect()} == {"Big Red Dog House": "Big Red Dog House", "big red dog house": "Big Red Dog House", "Big Red Dog House Two": "Big Red Dog House", "cat": "cat"}


def test_gaps_and_pages(spark):
    n, *_ = graph(spark)
    g = repair.gaps(n)
    assert [r.id for r in g.collect()] == ["Dog", "Rex"]
    p = spark.createDataFrame([(1, "about dog pages", "x" * 60), (2, "Dog", "y" * 60), (3, "Rex", "short")], "page_id long, query string, content string")
    assert {r.id: r.page_id for r in repair.fill_gaps(g, p).collect()} == {"Dog": 2, "Rex": None}


def test_stream_grows_once(spark, tmp_path):
    src = tmp_path / "in"
    rows = lambda *x: spark.createDataFrame([(i, f"v{i}") for i in x], "id long, v string")
    rows(1, 2).coalesce(1).write.parquet(str(src / "a"))
    read = lambda: spark.readStream.schema("id long, v string").option("recursiveFileLookup", "true").parquet(str(src))
    for extra in (None, (2, 3)):
        if extra:
            rows(*extra).coalesce(1).write.parquet(str(src / "b"))
        q = incremental.grow(read(), str(tmp_path / "kb"), ["id"], str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert incremental.progress(q) is not None
    assert sorted(r.id for r in incremental.read_grown(spark, str(tmp_path / "kb"), "id long, v string").collect()) == [1, 2, 3]


def test_windows_on_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 01:00:00' ts, 1L user_id, 'a' event_type, 1.5D value union all select timestamp'2024-01-02 01:00:00', 1, 'a', 2").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, user_id long, event_type string, value double").parquet(str(tmp_path / "e"))
    q = incremental.windowed(s).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.cents) for r in spark.table("w").collect()) == [(1, 150), (1, 200)]


def test_job_group(spark):
    with incremental.Job(spark, "j") as j:
        assert spark.range(5).count() == 5
        j.cancel()
    time.sleep(0)


def test_documents_are_parsed_in_slices(spark, monkeypatch):
    from graphloom.sources import documents

    monkeypatch.setattr(documents, "SLICE", 8)
    rows = [(f"{i}.{k}", x) for i, (k, x) in enumerate([("txt", b"abc"), ("md", b"x" * 40), ("TXT", b""), ("bin", b"zz"), ("pdf", b""), ("txt", None), ("txt", "é".encode()), ("md", b"last")])]
    got = {r.path: (r.text, r.error) for r in documents.parse_documents(spark.createDataFrame(rows, "path string, content binary").coalesce(1)).collect()}
    assert got == {"0.txt": ("abc", None), "1.md": ("x" * 40, None), "2.TXT": ("", None), "3.bin": (None, "unsupported file type: .bin"), "4.pdf": (None, "empty file"), "5.txt": (None, "cannot convert 'NoneType' object to bytes"), "6.txt": ("é", None), "7.md": ("last", None)}
    assert documents.parse_documents(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_a_view_has_one_row_for_each_id_and_kind(spark):
    from graphloom.operators.viewer import view

    n = spark.createDataFrame([("a", "class"), ("a", "instance"), ("b", "class"), ("lone", "instance")], "id string, kind string")
    e = spark.createDataFrame([("b", "subClassOf", "a")], "src string, relation string, dst string")
    got = sorted((r.id, r.kind, r.root, r.level, r.cluster, r.isolated) for r in view(n, e)["nodes"].collect())
    assert got == [("a", "class", True, 0, "a", False), ("a", "instance", True, 0, "a", False), ("b", "class", False, 1, "a", False), ("lone", "instance", False, None, "lone", True)]


def test_set_cover_goes_on_until_all_is_covered(spark):
    """By a plain loop: more than five picks of a question, by rounds over all executors, by one task for a question, and both; nulls cover nothing."""
    import random

    random.seed(9)
    rows = [(f"q{i % 3}", f"n{i // 3}", random.sample(range(200), k=random.randrange(9))) for i in range(300)] + [("few", f"n{i}", [i, i + 1]) for i in range(20)]
    want = []
    for q in ("q0", "q1", "q2", "few"):
        left = {n: set(r) for k, n, r in rows if k == q}
        pick = 0
        while any(left.values()):
            n = min(left, key=lambda n: (-len(left[n]), n))
            pick += 1
            want.append((q, pick, n, len(left[n])))
            left = {m: r - left[n] for m, r in left.items()}
    assert max(p for _, p, _, _ in want) > 20
    sets = spark.createDataFrame(rows + [("q0", None, [1]), (None, "n0", [1]), ("q1", "z", [None]), ("q1", "y", None)], "question string, node string, record_ids array<long>").repartition(3)
    for at_once in (10_000_000, 200):
        assert sorted(map(tuple, retrieve.set_cover(sets, at_once=at_once).collect())) == sorted(want)
    assert sorted(map(tuple, retrieve.set_cover(sets, 3, 100).collect())) == sorted(w for w in want if w[1] <= 3)
    words = sets.select("question", "node", F.transform("record_ids", lambda x: x.cast("string")).alias("record_ids"))
    assert sorted(map(tuple, retrieve.set_cover(words).collect())) == sorted(want)
