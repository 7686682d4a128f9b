"""Narrow ids, many partitions, and results that come by way of their operators."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_operators import make, messy

from graphloom.llm import fingerprint, language_id, toxicity, warc


@pytest.mark.parametrize("kind", ["int", "smallint", "string"])
def test_toxicity_takes_ids_of_other_kinds(spark, kind):
    rows = [(i, f"you are a {'stupid idiot' if i % 3 == 0 else 'kind friend'} number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id int, toxic int").select(F.col("doc_id").cast(kind).alias("doc_id"), "toxic")
    terms, weights = toxicity.learn(docs, labels.where(~language_id.held_out(0, 5)))
    got = {int(r.doc_id): r.score for r in toxicity.score(docs.select("text", "doc_id"), terms, weights, ("doc_id",)).collect()}
    assert len(got) == 60 and min(got[i] for i in range(0, 60, 3)) > max(got[i] for i in range(1, 60, 3))


def test_fingerprints_over_more_partitions_than_rows(spark, monkeypatch):
    docs = make(spark, messy()).select("doc_id", "text")
    want = sorted(map(str, fingerprint.edited_neighbours(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).drop("near_next").collect()))
    monkeypatch.setattr(fingerprint, "partitions", lambda df: 300)
    wide = fingerprint.edited_neighbours(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).drop("near_next")
    assert sorted(map(str, wide.collect())) == want
    assert fingerprint.edited_neighbours(docs.limit(1)).count() == 1


def test_warc_results_come_from_records(spark, tmp_path, monkeypatch):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "y\r\n\r\ny")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 2000) and got[3].payload_digest == hashlib.sha1(b"y\r\n\r\ny").hexdigest()
    assert "WARC-Target-URI: w\r\n" in got[3].header and got[3].header.endswith("\r\n\r\n")
    whole = warc.records
    monkeypatch.setattr(warc, "records", lambda *a, **k: whole(*a, **k).where("record_type = 'revisit'"))
    assert warc.read_archive(spark, path).count() == 1
    monkeypatch.setattr(warc, "records", lambda *a, **k: whole(*a, **k).withColumn("record", F.concat(F.substring("record", 1, 20), F.substring("record", 21, 10**6), F.encode(F.lit("!!!!"), "utf-8"))))
    with pytest.raises(Exception, match="names another"):
        warc.read_archive(spark, path).collect()
