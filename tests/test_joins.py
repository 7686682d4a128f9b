"""Containment joins and the similarity join against loops over all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from graphloom.functions import text
from graphloom.operators import contain, nearby, retrieve, similar


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_containment_matches_all_pairs(spark):
    random.seed(1)
    word = lambda n: "".join(random.choice("ab é日") for _ in range(n))
    names = [word(random.randrange(0, 12)) for _ in range(150)] + ["", "á", "𝔘nicode", "x" * 3000]
    words = [word(random.randrange(0, 6)) for _ in range(120)] + ["nicode", "xx", "𝔘"]
    n = spark.createDataFrame([(x, 1) for x in names * 2] + [(None, 1)], "name string, text int").repartition(3)
    w = spark.createDataFrame([(x, 1) for x in words * 2] + [(None, 1)], "word string, pattern int").repartition(3)
    inside = {(a, b) for a in names for b in words if b in a}
    around = {(b, a) for a in names for b in words if a in b}
    pairs = lambda df: (sorted(map(tuple, df.collect())), len(set(df.collect())))
    for kw in ({}, {"most": 10}, {"size": 40}):
        got, k = pairs(contain.in_texts(n, w, "name", "word", **kw))
        assert set(got) == inside and len(got) == k
    got, k = pairs(contain.parts_of(w, n, "word", "name"))
    assert set(got) == around and len(got) == k
    assert set(pairs(contain.either_way(n, w))[0]) == inside | {(b, a) for a, b in around}
    assert contain.either_way(n, w.limit(0)).count() == 0 == contain.either_way(n.limit(0), w).count()


def test_concept_matches_of_many_questions(spark):
    q = spark.createDataFrame([(1, "Which Brand#1 sells in ASIA now"), (2, "of asian art"), (3, ""), (4, None), (5, "the the brand#12x")], "query_id long, question string")
    n = spark.createDataFrame([(i, x) for i, x in enumerate(["Asia", "asia", "Brand#1", "Brand#12", "ART", "", "in", "sellsword"])], "seq long, id string")
    want = {(r.query_id, r.id) for r in q.join(n, retrieve.concept_match(q.question, n.id)).collect()}
    got = retrieve.concept_matches(q, n)
    assert {tuple(r) for r in got.collect()} == want and (5, "") in want
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_question_entities_of_phrases_and_synonyms(spark):
    q = spark.createDataFrame([(1, "tell of North Sea oil now"), (2, "north sea")], "query_id long, question string")
    n = spark.createDataFrame([(3, "North Sea", []), (1, "sea oil now and then", []), (2, "Ocean", ["the north sea"]), (5, "oil", ["x"])], "seq long, id string, synonyms array<string>")
    got = {tuple(r) for r in retrieve.question_entities(q, n).collect()}
    low = lambda s: s.lower()
    want = set()
    for i, text in ((1, "tell of north sea oil now"), (2, "north sea")):
        w = text.split()
        for p in {" ".join(w[a : a + k]) for k in (2, 3, 4) for a in range(len(w) - k + 1)}:
            hits = sorted((s, x) for s, x in ((3, "North Sea"), (1, "sea oil now and then"), (2, "Ocean"), (5, "oil")) if low(p) in low(x) or low(x) in low(p))
            if len(p) < 4:
                continue
            stop = hits[0][0] if hits else 99
            want |= {(i, hits[0][1])} if hits else set()
            want |= {(i, x) for s, x, syn in ((2, "Ocean", "the north sea"), (5, "oil", "x")) if s < stop and (p in syn or syn in p)}
    assert got == want


def cosines(x):
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    return u @ u.T


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.95])
def test_similar_pairs_are_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(nearby, "TILE", 50)
    monkeypatch.setattr(nearby, "VISITORS", 70)
    rng = np.random.default_rng(int(100 * threshold))
    middle = rng.normal(size=(8, 16))
    x = np.concatenate([middle[rng.integers(0, 8, 300)] + rng.normal(size=(300, 16)) * 0.4, rng.normal(size=(60, 16)), np.zeros((2, 16))])
    rows = [(i * 3, r.tolist()) for i, r in enumerate(x)] + [(9001, None), (9002, [])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(4)
    s = cosines(x)
    want = {(i * 3, j * 3) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= threshold}
    got = [(r.a, r.b) for r in nearby.similar_pairs(v, threshold, cell=24).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fewer_cells_for_less_recall(spark):
    rng = np.random.default_rng(5)
    base = nearby.unit(rng.normal(size=(1500, 32)))
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    x = np.concatenate([base, 0.901 * base + (1 - 0.901**2) ** 0.5 * nearby.unit(off)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, vector array<double>")
    want = int(np.triu(cosines(x) >= 0.9, 1).sum())
    got = nearby.similar_pairs(v, 0.9, recall=0.95, cell=100).count()
    assert 0.92 * want <= got <= want
    pivots = nearby.pivots_of(x, 30)
    meets = lambda recall: len(nearby.places(x, pivots, nearby.room_for(x, pivots, 0.9, recall))[1])
    assert meets(0.95) < 0.6 * meets(1.0)


def test_no_vector_passes_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("vectors pass the driver"))
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, vector array<double>")
    assert nearby.similar_pairs(v, 0.99).count() > 0


def near_names(seed, n):
    random.seed(seed)
    base = ["red widget", "blue gear", "knowledge graph", "aaaa", "ab", "née é", "strasse"]

    def edit(s):
        s = list(s)
        for _ in range(random.randrange(0, 5)):
            i = random.randrange(len(s) + 1)
            s[i : i + random.randrange(2)] = random.choice(["", "x", "e", " ", "zz"])
        return "".join(s)

    return [edit(random.choice(base)) for _ in range(n)] + ["", "q" * 250, "q" * 200]


@pytest.mark.parametrize("least", [0.6, 0.85, 1.0])
def test_edit_similar_is_difflib_on_all_pairs(spark, least):
    names, texts = near_names(1, 60), near_names(2, 70)
    n = spark.createDataFrame([(x,) for x in [*names, *names[:5], None]], "name string")
    t = spark.createDataFrame([(x,) for x in [*texts, None]], "text string")
    got = [tuple(r) for r in similar.edit_similar(n, t, least).select("name", "text").collect()]
    want = {(a, b) for a in names for b in texts if a and b and SequenceMatcher(None, a, b).ratio() >= least}
    assert len(got) == len(set(got)) and set(got) == want
    c = similar.candidates(n, t, least)
    assert c.count() < 0.75 * len(set(names)) * len(set(texts)) and "Cartesian" not in plan_of(c)
    assert similar.edit_similar(n, t.limit(0), least).count() == 0


def test_grounded_pairs_are_the_predicate_on_all_pairs(spark):
    names = [*near_names(3, 25), "Red Widget", "  blue gear ", None]
    texts = [*near_names(4, 25), "A RED WIDGET and more " * 20, "the Knowledge of it", "", None]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(r.doc_id, r.name) for r in d.join(n).where(text.grounded_or_similar("name", "text")).collect()}
    got = similar.grounded_pairs(d, n)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "Cartesian" not in plan_of(got)
