"""The pipeline on small data: each stage takes effect, keeps clean documents, and returns the columns of documents."""

import collections
import os
import subprocess
import sys

import corpus_pipeline

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns, name
    whole = spark.read.parquet(f"{DATA}/documents.parquet").count()
    n = {k: v.count() for k, v in kept.items()}
    assert whole >= n["toxicity"] > 0.7 * whole and n["toxicity"] >= n["exact_dedup"] >= n["ngram_jaccard_join"] > 0.5 * whole
    copies = collections.Counter(r.doc_id for r in kept["mixing"].select("doc_id").collect())
    assert max(copies.values()) <= 2 and len(copies) > 0.5 * n["ngram_jaccard_join"]
    packed = {r.doc_id for r in kept["packing"].select("doc_id").collect()}
    assert packed == set(copies)


def test_each_stage_matches_brute_force(spark, tmp_path):
    """Each stage on what the one before kept: by definition, a plain dict, all pairs, SQL and the tokenizer."""
    import re

    import duckdb
    import numpy as np
    from test_operators import brute_links, plain_features
    from tokenizers import Tokenizer

    from graphloom.llm import mixing, packing, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        stages[name](spark, docs, DATA).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(~corpus_pipeline.held_out(0, 5))
    terms, weights = toxicity.learn(docs.select("doc_id", "text"), labels)
    x = {r.doc_id: np.array(plain_features(r.text or "", terms), float) for r in docs.collect()}
    score = {i: 1 / (1 + np.exp(-np.clip(toxicity.design(v[None]) @ weights, -30, 30)[0])) for i, v in x.items()}
    docs = step("toxicity")
    assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, v in score.items() if v < 0.5) and len(score) > docs.count() > 0

    first = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    docs = step("exact_dedup")
    assert sorted(r.doc_id for r in docs.collect()) == sorted(first.values())

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    linked, groups = brute_links(rows)
    docs = step("ngram_jaccard_join")
    assert sorted(r.doc_id for r in docs.collect()) == sorted({k[1] for k in linked}) and docs.count() == groups

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/ngram_jaccard_join/*.parquet'")
    want = {i: n for i, n in con.sql(mixing.sql(select="doc_id, copies")).fetchall() if n}
    docs = step("mixing")
    assert collections.Counter(r.doc_id for r in docs.collect()) == collections.Counter(want)

    tok, texts = Tokenizer.from_file(packing.tokenizer_path()), {r.doc_id: r.text or "" for r in docs.collect()}
    got, held = collections.Counter(), b""
    for r in sorted(step("packing").collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset + r.length <= packing.LENGTH
        held += bytes(r.ids)
        if len(held) == 4 * r.doc_tokens:
            got[r.doc_id, held] += 1
            held = b""
    assert got == collections.Counter({(i, np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 1], "<u4").tobytes()): n for i, n in want.items()})


def test_stages_take_any_columns_and_no_rows(spark):
    """Names with dots, names of the stages' own columns, nulls, repeated rows; and no rows."""
    names = ["doc_id", "text", "source", "a.b", "doc", "key", "copies", "score"]
    rows = [(i, t, s, 1, "d", "k", 2, 0.5) for i, t, s in [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, None, None), (3, "", "b"), (None, "seven eight nine ten", "b")]]
    full = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, doc string, `key` string, copies int, score double")
    for docs, least in ((full, 1), (full.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == names and out.count() >= least, name


def test_rest_of_the_library_does_without_llm(tmp_path):
    """Copy the repository without the llm folders and the pipeline: the entry still imports and lists queries."""
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True).stdout
