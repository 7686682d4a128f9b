"""Checks of relations that most edges have; supplies in tasks of bounded size."""

import re

from graphloom.operators import quality
from graphloom.plans import fixture


def test_asymmetric_relations_are_found_where_the_edges_are(spark):
    """Edges meet the relations of axioms without being dealt by relation; before, all edges of a relation went to one task."""
    e = spark.createDataFrame([("a", "over", "b"), ("b", "over", "a"), ("a", "near", "b"), ("b", "near", "a"), ("c", "over", "c"), ("a", "over", "b")], "src string, relation string, dst string")
    a = spark.createDataFrame([("asymmetry", ["over"]), ("asymmetry", ["over"]), ("disjointness", ["x", "y"])], "axiom_type string, entities array<string>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = quality.consistency(e, a)
        assert sorted(tuple(r) for r in found.collect()) == [("asymmetric_both_ways", "warning", *x) for x in (("a", "b"), ("b", "a"), ("c", "c"))]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" in plan and not re.findall(r"hashpartitioning\(relation#\d+, \d+\)", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_supplies_are_grouped_by_tasks_of_bounded_size(spark, monkeypatch):
    """More lines make more tasks; before, a task's share grew with the lines."""
    d = "/root/testdata/sf0.001"
    few = fixture.Graph(spark, d).supplies
    monkeypatch.setattr(fixture, "LINES", 500)
    many = fixture.Graph(spark, d).supplies
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    got = sorted(tuple(r) for r in many.collect())
    assert got == sorted(tuple(r) for r in few.collect()) and len(got) > 1000
    sizes = re.findall(r"hashpartitioning\(l_suppkey#\d+L?, l_partkey#\d+L?, (\d+)\)", many._jdf.queryExecution().toString())
    assert sizes and {int(x) for x in sizes} == {-(-lines // 500)}
