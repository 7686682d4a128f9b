"""Operators over nodes with very many edges: the same rows, and no task with a whole hub."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, ranks, viewer


@pytest.fixture(scope="module")
def hub(spark):
    """A node with 100,000 edges among small ones."""
    big = spark.range(100_000).select(F.lit("hub").alias("src"), F.lit("r").alias("relation"), F.format_string("t%06d", F.col("id")).alias("dst"))
    small = spark.range(3000).select(F.format_string("s%d", F.col("id") % 30).alias("src"), F.lit("r").alias("relation"), F.format_string("u%d", F.col("id")).alias("dst"))
    return big.union(small).repartition(8).cache()


def test_ranks_of_a_hub(spark, hub):
    got = graph.hub_ranks(hub).groupBy("src").agg(F.count("*").alias("n"), F.sum("rank").alias("s"), F.max("rank").alias("m"), F.count_distinct("rank").alias("k")).collect()
    assert {(r.src, r.n, r.s, r.m, r.k) for r in got} >= {("hub", 100_000, sum(range(100_000)), 99_999, 100_000), ("s0", 100, 4950, 99, 100)} and len(got) == 31
    assert graph.hub_ranks(hub).where("src = 'hub' and rank != cast(substring(dst, 2, 6) as int)").count() == 0
    ranges = hub.where("src = 'hub'").repartitionByRange(16, "src", "dst").groupBy(F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in ranges) < 15_000


def test_ranks_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 5), (None, 2), (None, 1)], "k string, v int")
    for parts in (1, 5, 40):
        got = sorted(((r.k or "", r.v if r.v is not None else -1, r["rank"]) for r in ranks.ranked(rows, "k", ["v"], parts=parts).collect()))
        assert got == [("", 1, 1), ("", 2, 2), ("a", -1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 5, 1)]
    assert ranks.ranked(rows.limit(0), "k", ["v"]).count() == 0


def test_edges_beyond_the_cap_of_a_hub(spark, hub):
    h = viewer.hidden(hub, cap=20)
    got = {r.src: (r.shown, r.n) for r in h.groupBy("src").agg(F.count_if(~F.col("hidden")).alias("shown"), F.count("*").alias("n")).collect()}
    assert got["hub"] == (20, 100_000) and got["s3"] == (20, 100) and h.where("src = 'hub' and not hidden").agg(F.max("dst")).first()[0] == "t000019"
    back = viewer.hidden(hub.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst")), cap=5)
    assert back.where("not hidden").groupBy("dst").count().where("count = 5").count() == 31
    few = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c")], "src string, relation string, dst string")
    assert viewer.hidden(few, cap=1).where("hidden").count() == 0


def test_first_lines_and_rows(spark, hub):
    ctx = {r.id: r.context for r in graph.node_context(hub, 3).where("id in ('hub', 't000001')").collect()}
    assert ctx == {"hub": "r -> t000000; r -> t000001; r -> t000002", "t000001": "r <- hub"}
    assert graph.context_lines(hub).where("id = 'hub'").count() == 100_000
    assert viewer.relation_groups(hub, 2).where("id = 'hub'").first().others == ["t000000", "t000001"]
    assert viewer.group_rows(hub).where("id = 'hub'").count() == 100_000
