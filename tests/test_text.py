import re

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import extract


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first().x


def test_fixed_chunks(spark):
    c = one(spark, text.chunks_fixed("t", 1200, 200), t="a" * 3000)
    assert len(c) == 3 and max(map(len, c)) == 1200 and sum(map(len, c)) == 1200 + 1200 + 1000
    assert one(spark, text.chunks_fixed("t", 1200, 200), t="") == [] and one(spark, text.chunks_fixed("t", 1200, 200), t="short") == ["short"]
    assert len(one(spark, text.chunks_fixed("t", 3, 9), t="abcde")) == 5


def test_sentences_match_python(spark):
    t = "One two. Three! four? Five.  Six.\nSeven a.b Éa"
    want = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t.strip()) if s.strip()]
    assert one(spark, text.sentences("t"), t=t) == want


def test_section_starts(spark):
    t = "preamble text that ends.\n# Head\nbody.\nALL CAPS\nbody.\n\nNote:\nx.\nShort one\n\nend."
    assert one(spark, text.section_starts("t"), t=t) == [False, True, False, True, False, False, True, False, True, False, False]


def test_recalls(spark):
    f = F.array(F.lit("Dogs are animals"), F.lit("cat"))
    assert one(spark, text.context_recall(F.array(F.lit("dogs"), F.lit("birds")), f), a=1) == 0.5
    assert one(spark, text.context_recall(F.array().cast("array<string>"), f), a=1) == 1.0
    assert abs(one(spark, text.entity_recall(F.array(F.lit("Dogs"), F.lit("cat"), F.lit("bird")), f), a=1) - 2 / 3) < 1e-9
    assert one(spark, text.answer_f1("p", "r"), p="the big dog", r="big dog") == 1.0
    assert 0.5 < one(spark, text.answer_f1("p", "r"), p="big red dog", r="big dog") < 1
    assert one(spark, text.answer_f1("p", "r"), p="", r="") == 1.0 and one(spark, text.answer_f1("p", "r"), p="dog", r="") == 0.0


def test_names(spark):
    assert one(spark, text.normal_name("n"), n="The Dog's_best-Friend") == "the dog best friend"
    assert one(spark, text.exact_name("n"), n=" Café  (Bar)! ") == "café bar"
    assert one(spark, text.relation_name("n"), n=" IsA ") == "subClassOf" and one(spark, text.relation_name("n"), n="part_of") == "part_of"
    assert one(spark, text.split_camel("n"), n="HTTPServerName") == "http server name"
    assert one(spark, text.safe_local("n"), n=" a b/(c) ") == "a_b_c" and one(spark, text.safe_local("n"), n="//") == "entity"
    assert one(spark, text.source_label("n"), n="edge:A-likes-B-C") == "A likes B-C"
    assert one(spark, text.entities_in("n"), n='NeuralNet uses GPU and "deep learning"') == ["NeuralNet", "GPU", "deep learning"]


def test_noise(spark):
    assert one(spark, text.is_noise("n"), n="run(x)") and one(spark, text.is_noise("n"), n="the cat") and not one(spark, text.is_noise("n"), n="cat")
    assert one(spark, text.is_concept_name("n"), n="cat") and not one(spark, text.is_concept_name("n"), n="12.5%")
    assert one(spark, text.definition("n"), n="NONE") is None and one(spark, text.definition("n"), n="A dog is a pet animal") == "A dog is a pet animal"


def test_html_text(spark):
    h = "<html><script>x<y</script><p>One &amp; two</p><nav>menu</nav><div>Three</div></html>"
    assert one(spark, text.html_text("h"), h=h).split() == ["One", "&", "two", "Three"]


def test_score_and_fidelity(spark):
    assert one(spark, text.score_in("s"), s="I say 0.75 of 1") == 0.75 and one(spark, text.score_in("s"), s="none") == 0.0 and one(spark, text.score_in("s"), s="1") == 1.0
    assert one(spark, text.fidelity("u"), u="https://arxiv.org/abs/1") == 1.0 and one(spark, text.fidelity("u"), u="http://blog.x.com/") == 0.45 and one(spark, text.fidelity("u"), u="x") == 0.15


def test_repair_json():
    assert extract.repair_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert extract.repair_json('Here: {"a": [1, 2,], }  thanks') == {"a": [1, 2]}
    assert extract.repair_json("{'a': 'b'}") == {"a": "b"}
    assert extract.repair_json('{"a": [1, {"b": "c') == {"a": [1, {"b": "c"}]}
    assert extract.repair_json("") is None and extract.repair_json("nothing") is None


def test_extract_rules_and_failure(spark):
    got = extract.extract_rules("A dog is an animal. Rex is a dog. Engine requires fuel.")
    assert {"name": "dog", "parent": "animal", "description": None} in got["classes"]
    assert {"name": "Rex", "class_name": "dog"} in got["instances"] and got["relations"][0]["dst"] == "fuel"
    chunks = spark.createDataFrame([(1, 0, "A cat is a pet"), (1, 1, None)], "doc_id long, chunk_id long, text string")

    def broken(t):
        if not t:
            raise ValueError("no text")
        return extract.extract_rules(t)

    rows = {r.chunk_id: r for r in extract.extract(chunks, broken).collect()}
    assert rows[0].error is None and len(rows[0].classes) == 2 and rows[1].error == "no text" and rows[1].classes == []
