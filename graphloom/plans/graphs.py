"""Queries over the fixture graph: look-ups, joins, rules, fixpoints, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import components, fixpoint, graph, merge, quality, reason, strong
from .fixture import Graph, sql, table
from .registry import query

CLOSE = """sub(src, dst) AS (SELECT src, dst FROM edges WHERE relation = 'subClassOf' UNION SELECT sub.src, e.dst FROM sub JOIN edges e ON e.relation = 'subClassOf' AND sub.dst = e.src),
part_of(src, dst) AS (SELECT src, dst FROM edges WHERE relation = 'partOf' UNION SELECT p.src, e.dst FROM part_of p JOIN edges e ON e.relation = 'partOf' AND p.dst = e.src),
trade(src, dst) AS (SELECT src, dst FROM edges WHERE relation = 'tradesWith' UNION SELECT t.src, e.dst FROM trade t JOIN edges e ON e.relation = 'tradesWith' AND t.dst = e.src)"""
PAIRS = "comp(id, root) AS (SELECT id, id FROM nodes UNION SELECT u.b, comp.root FROM comp JOIN (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) u ON comp.id = u.a WHERE comp.root <= u.b)"


# look-ups


@query("p1_classes", sql("SELECT id, type, kind FROM nodes WHERE kind = 'class'"))
def p1(spark, d):
    return Graph(spark, d).nodes.where("kind = 'class'").select("id", "type", "kind")


@query("p1_instances", sql("SELECT id, type FROM nodes WHERE kind = 'instance'"))
def p1b(spark, d):
    return Graph(spark, d).nodes.where("kind = 'instance'").select("id", "type")


@query("p2_lookup", sql("SELECT a.id, coalesce(n.description, '') AS description FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) a LEFT JOIN nodes n USING (id)"))
def p2(spark, d):
    g = Graph(spark, d)
    return graph.lookup(g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), g.nodes, {"description": ""})


@query("p3_edge_exists", sql("SELECT src, relation, dst, src IN (SELECT dst FROM edges e2 WHERE e2.src = e.dst AND e2.relation = e.relation) AS has_reverse FROM edges e WHERE relation = 'tradesWith'"))
def p3(spark, d):
    e = Graph(spark, d).edges.where("relation = 'tradesWith'")
    asked = e.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst"))
    return graph.has_edge(asked, e).select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst"), F.col("exists").alias("has_reverse"))


@query("p12_low_confidence", sql("SELECT src, relation, dst, votes, path_length FROM (SELECT *, CASE WHEN vote_count > 0 THEN vote_count ELSE 1 END AS votes, CASE WHEN origin = 'extraction' THEN 1 ELSE 2 END AS path_length FROM edges) WHERE least(1e0, 0.5 * least(1e0, votes / 5e0) + 0.3 * confidence + 0.2 / path_length) < 0.5"))
def p12(spark, d):
    e = quality.correctness(Graph(spark, d).edges).where("correctness < 0.5")
    return e.select("src", "relation", "dst", F.greatest("vote_count", F.lit(1)).alias("votes"), "path_length")


@query("p15_edge_filters", sql("SELECT src, relation, dst, CASE WHEN relation = 'subClassOf' THEN 'hierarchy' WHEN relation = 'type' THEN 'type' ELSE 'other' END AS bucket, relation = 'subClassOf' AS far, relation IN ('subClassOf', 'type', 'partOf', 'hasPart') AS middle FROM edges"))
def p15(spark, d):
    return graph.edge_filters(Graph(spark, d).edges).select("src", "relation", "dst", "bucket", "far", "middle")


@query("p16_node_search", sql("SELECT id FROM nodes WHERE contains(lower(id), 'nation_1') ORDER BY seq LIMIT 1"))
def p16(spark, d):
    return graph.find_node(Graph(spark, d).nodes, "Nation_1").select("id")


# joins and rules


@query("j1_inheritance", sql("SELECT DISTINCT t.src, 'type' AS relation, s.dst FROM edges t JOIN edges s ON t.relation = 'type' AND s.relation = 'subClassOf' AND t.dst = s.src WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = t.src AND e.relation = 'type' AND e.dst = s.dst)"))
def j1(spark, d):
    return reason.inheritance(Graph(spark, d).edges)


@query("j2_parents_children", sql("SELECT id, coalesce(p, 0) AS parents, coalesce(c, 0) AS children FROM nodes LEFT JOIN (SELECT src AS id, count(*) AS p FROM edges WHERE relation = 'subClassOf' GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS c FROM edges WHERE relation = 'subClassOf' GROUP BY 1) USING (id) WHERE kind = 'class'"))
def j2(spark, d):
    g = Graph(spark, d)
    return graph.parents_children(g.nodes.where("kind = 'class'"), g.edges).select("id", F.size("parents").alias("parents"), F.size("children").alias("children"))


@query("j3_node_context", sql("SELECT id, string_agg(t, '; ' ORDER BY t) AS context FROM (SELECT src AS id, relation || ' -> ' || dst AS t FROM edges UNION SELECT dst, relation || ' <- ' || src FROM edges) GROUP BY id"))
def j3b(spark, d):
    return graph.node_context(Graph(spark, d).edges)


@query("j3_context_lines", sql("SELECT src AS id, relation || ' -> ' || dst AS line FROM edges UNION SELECT dst, relation || ' <- ' || src FROM edges"))
def j3l(spark, d):
    return graph.context_lines(Graph(spark, d).edges)


@query("j3_first_lines", sql("SELECT id, string_agg(t, '; ' ORDER BY t) AS context FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS r FROM (SELECT src AS id, relation || ' -> ' || dst AS t FROM edges UNION SELECT dst, relation || ' <- ' || src FROM edges)) WHERE r <= 20 GROUP BY id"))
def j3f(spark, d):
    return graph.node_context(Graph(spark, d).edges, 20)


@query("j7_cooccurrence", sql("SELECT a.id AS a, b.id AS b, count(DISTINCT a.chunk_id) AS shared FROM members a JOIN members b ON a.chunk_id = b.chunk_id AND a.id < b.id GROUP BY 1, 2 HAVING count(DISTINCT a.chunk_id) >= 2"))
def j7(spark, d):
    g = Graph(spark, d)
    return merge.cooccurrence(g.members, g.supplies)


@query("j8_disjointness", sql("SELECT t.src AS instance, a.n_name AS a, b.n_name AS b FROM nation_a a, nation_b b, edges t WHERE t.relation = 'type' AND t.dst = a.n_name AND EXISTS (SELECT 1 FROM edges u WHERE u.src = t.src AND u.relation = 'type' AND u.dst = b.n_name) UNION SELECT c_name, a.n_name, b.n_name FROM nation_a a, nation_b b, customer WHERE c_nationkey = 0 AND c_custkey % 3 = 0"))
def j8(spark, d):
    g = Graph(spark, d)
    names = g.axioms.where("axiom_type = 'disjointness'").select(F.get("entities", F.lit(1)).alias("dst"))
    extra = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey = 0 and c_custkey % 3 = 0").select(F.col("c_name").alias("src"), F.lit("type").alias("relation")).join(names)
    return reason.disjointness(g.edges.select("src", "relation", "dst").unionByName(extra), g.axioms)


@query("j9_consistency", sql("SELECT 'asymmetric_both_ways' AS kind, 'warning' AS severity, e.src AS a, e.dst AS b FROM edges e JOIN edges f ON e.relation = 'tradesWith' AND f.relation = 'tradesWith' AND e.src = f.dst AND e.dst = f.src"))
def j9(spark, d):
    g = Graph(spark, d)
    return quality.consistency(g.edges, g.axioms)


@query("j10_two_hops", sql("SELECT DISTINCT a.src AS u, a.dst AS v, b.dst AS w FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst"))
def j10b(spark, d):
    g = Graph(spark, d)
    return graph.two_hops(g.edges, g.edges).select("u", "v", "w").distinct()


@query("g1_subsumption", sql("SELECT src, 'subClassOf' AS relation, dst FROM sub EXCEPT SELECT src, relation, dst FROM edges", CLOSE))
def g1(spark, d):
    return reason.subsumption(Graph(spark, d).edges)


@query("g2_closure", sql("SELECT src, 'tradesWith' AS relation, dst FROM trade UNION SELECT src, 'partOf', dst FROM part_of", CLOSE))
def g2(spark, d):
    return fixpoint.transitive_closure(Graph(spark, d).places.where("relation in ('tradesWith', 'partOf')"), include_self=True)


@query("g3_symmetric", sql("SELECT dst AS src, relation, src AS dst FROM edges WHERE relation = 'tradesWith' EXCEPT SELECT src, relation, dst FROM edges"))
def g3(spark, d):
    return reason.symmetric(Graph(spark, d).edges, ["tradesWith"])


@query("g4_inverse", sql("SELECT dst AS src, 'suppliedBy' AS relation, src AS dst FROM edges WHERE relation = 'supplies'"))
def g4(spark, d):
    g = Graph(spark, d)
    return reason.inverse(g.edges, g.axioms)


@query("g5_components", "SELECT id, min(id) OVER (PARTITION BY g) AS component FROM (SELECT 'World' AS id, 1 AS g UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT n_name, 1 FROM nation UNION ALL SELECT c_name, 1 FROM customer UNION ALL SELECT s_name, 1 FROM supplier UNION ALL SELECT 'Part#' || p_partkey, 1 FROM part UNION ALL SELECT DISTINCT p_brand, 1 FROM part UNION ALL SELECT DISTINCT p_type, 1 FROM part)")
def g5b(spark, d):
    g = Graph(spark, d)
    return quality.node_components(g.nodes, g.edges)


@query("g6_domain_range", sql("SELECT DISTINCT src, 'type' AS relation, 'Supplier' AS dst FROM supplies UNION SELECT dst, 'type', 'Product' FROM supplies"))
def g6(spark, d):
    g = Graph(spark, d)
    return reason.domain_range(g.edges, g.axioms)


@query("g7_relation_properties", sql("""SELECT relation, count(*) AS n, count(*) FILTER (back) AS backs, coalesce(any_value(k), 0) AS open_chains FROM (SELECT e.relation, e.src, e.dst, EXISTS (SELECT 1 FROM edges f WHERE f.relation = e.relation AND f.src = e.dst AND f.dst = e.src) AS back FROM edges e)
LEFT JOIN (SELECT a.relation, count(*) AS k FROM edges a JOIN edges b ON a.relation = b.relation AND a.dst = b.src AND a.src <> b.dst WHERE NOT EXISTS (SELECT 1 FROM edges c WHERE c.relation = a.relation AND c.src = a.src AND c.dst = b.dst) GROUP BY 1) USING (relation) GROUP BY relation HAVING count(*) >= 2"""))
def g7b(spark, d):
    return reason.relation_properties(Graph(spark, d).edges).select("relation", "n", "backs", "open_chains")


@query("g8_axiom_relations", "SELECT 'transitive' AS kind, 'partOf' AS relation UNION ALL SELECT 'symmetric', 'tradesWith'")
def g8(spark, d):
    return reason.axiom_relations(Graph(spark, d).axioms)


@query("g9_inference", sql("""SELECT src, relation, dst FROM (SELECT src, 'subClassOf' AS relation, dst FROM sub UNION SELECT src, 'partOf', dst FROM part_of UNION SELECT dst, 'tradesWith', src FROM edges WHERE relation = 'tradesWith'
UNION SELECT dst, 'suppliedBy', src FROM supplies UNION SELECT src, 'type', 'Supplier' FROM supplies UNION SELECT dst, 'type', 'Product' FROM supplies UNION SELECT t.src, 'type', s.dst FROM edges t JOIN sub s ON t.relation = 'type' AND t.dst = s.src)
EXCEPT SELECT src, relation, dst FROM edges""", CLOSE))
def g9(spark, d):
    g = Graph(spark, d)
    return reason.infer(g.edges, g.axioms).select("src", "relation", "dst")


@query("g10_class_hierarchy", sql("SELECT DISTINCT src, dst FROM edges WHERE relation = 'subClassOf'"))
def g10(spark, d):
    g = Graph(spark, d)
    return quality.class_hierarchy(g.nodes, g.edges)


DEPTH = "lv(id, depth) AS (SELECT 'World', 0 UNION SELECT e.src, lv.depth + 1 FROM lv JOIN edges e ON e.relation = 'subClassOf' AND e.dst = lv.id), dp AS (SELECT n.id, coalesce(min(lv.depth), 0) AS depth FROM nodes n LEFT JOIN lv USING (id) WHERE kind = 'class' GROUP BY n.id)"


@query("g11_depths", sql("SELECT id, depth FROM dp", DEPTH))
def g11(spark, d):
    g = Graph(spark, d)
    return quality.depths(g.nodes, g.edges)


@query("g12_level_map", sql("SELECT id, depth AS level FROM lv", DEPTH))
def g12(spark, d):
    e = Graph(spark, d).edges.where("relation = 'subClassOf'")
    start = spark.createDataFrame([("World",)], "node string")
    return fixpoint.bfs_levels(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).select(F.col("node").alias("id"), "level")


@query("g13_normalize", sql("SELECT src, relation, dst, count(*) AS copies FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL"))
def g13(spark, d):
    g = Graph(spark, d)
    return graph.normalize(g.nodes, g.edges)


@query("g14_cycles", sql("SELECT count(*) > 0 AS cyclic FROM trade WHERE src = dst", CLOSE))
def g14(spark, d):
    return strong.cycle_edges(Graph(spark, d).places.where("relation = 'tradesWith'")).agg((F.count("*") > 0).alias("cyclic"))


@query("g14_components", sql("SELECT a AS node, min(b) AS component FROM (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) GROUP BY a", "e AS (SELECT DISTINCT src, dst FROM edges UNION SELECT lower(n_name), lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT lower(r_name), min(lower(n_name)) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name), reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON reach.b = e.src)"))
def g14c(spark, d):
    """All relations as one graph, and besides it a cycle by way of each region and its first nation, which other nations lead to."""
    e = Graph(spark, d).edges.select("src", "dst")
    nr = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("n"), F.lower("r_name").alias("r"))
    e = e.unionByName(nr.select(F.col("n").alias("src"), F.col("r").alias("dst"))).unionByName(nr.groupBy(F.col("r").alias("src")).agg(F.min("n").alias("dst")))
    return strong.strong_components(e)


@query("g15_roots", sql("SELECT id FROM nodes WHERE kind = 'class' AND id NOT IN (SELECT src FROM edges WHERE relation = 'subClassOf')"))
def g15(spark, d):
    g = Graph(spark, d)
    return graph.roots(g.nodes.where("kind = 'class'"), g.edges)


@query("g16_neighbourhood", sql("SELECT id, min(hop) AS hop FROM hops GROUP BY id", "hops(id, hop) AS (SELECT 'World', 0 UNION SELECT u.b, h.hop + 1 FROM hops h JOIN (SELECT src AS a, dst AS b FROM places UNION SELECT dst, src FROM places) u ON u.a = h.id WHERE h.hop < 2)"))
def g16(spark, d):
    start = spark.createDataFrame([("World",)], "node string")
    return fixpoint.bfs_levels(Graph(spark, d).places, start, 2, directed=False).select(F.col("node").alias("id"), F.col("level").alias("hop"))


@query("g16_neighbourhood_all", sql("SELECT id, min(hop) AS hop FROM hops GROUP BY id", "hops(id, hop) AS (SELECT id, 0 FROM nodes WHERE id = 'Supplier#000000001' UNION SELECT u.b, h.hop + 1 FROM hops h JOIN (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) u ON u.a = h.id WHERE h.hop < 2)"))
def g16a(spark, d):
    """Two hops about a supplier, over all relations: its parts, their types and brands, and who else supplies them."""
    g = Graph(spark, d)
    return fixpoint.bfs_levels(g.edges, g.nodes.where("id = 'Supplier#000000001'").select(F.col("id").alias("node")), 2, directed=False).select(F.col("node").alias("id"), F.col("level").alias("hop"))


@query("g17_adjacency", sql("SELECT src AS id, relation, dst AS other, 'out' AS way FROM edges UNION ALL SELECT dst, relation, src, 'in' FROM edges"))
def g17(spark, d):
    return graph.adjacency(Graph(spark, d).edges)


@query("g19_candidates", sql("""SELECT n.id, p.parent, coalesce(c.children, 0) AS children, coalesce(r.k, 0) AS relations, coalesce(dp.k, 0) AS properties FROM nodes n LEFT JOIN (SELECT src AS id, min(dst) AS parent FROM edges WHERE relation IN ('subClassOf', 'type') GROUP BY 1) p USING (id)
LEFT JOIN (SELECT dst AS id, count(*) AS children FROM edges WHERE relation IN ('subClassOf', 'type') GROUP BY 1) c USING (id) LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) r USING (id) LEFT JOIN (SELECT entity AS id, count(*) AS k FROM data_props GROUP BY 1) dp USING (id)"""))
def g19(spark, d):
    g = Graph(spark, d)
    return graph.candidates(g.nodes, g.edges, g.data_props)


@query("g20_add_edges", sql("SELECT src, coalesce(nullif(relation, 'partOf'), 'related_to') AS relation, dst, CASE WHEN relation = 'partOf' THEN 1e0 ELSE confidence END AS confidence FROM edges WHERE dst <> 'World'"))
def g20(spark, d):
    e = Graph(spark, d).edges
    blank = e.select("src", F.nullif("relation", F.lit("partOf")).alias("relation"), F.when(F.col("dst") == "World", "").otherwise(F.col("dst")).alias("dst"), F.when(F.col("relation") != "partOf", F.col("confidence")).alias("confidence"))
    return graph.edges_to_add(blank)


# quality


@query("a7_health", sql("""SELECT n, m, 2e0 * m / (n * (n - 1)) AS density, ends / n AS avg_degree, max_degree, orphans, classes, instances, unlabeled FROM (SELECT count(*) AS n, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'instance') AS instances, count(*) FILTER (coalesce(description, '') = '') AS unlabeled FROM nodes),
(SELECT count(*) AS m, 2 * count(*) AS ends FROM edges), (SELECT max(k) AS max_degree, count(*) FILTER (k = 0) AS orphans FROM (SELECT n.id, count(e.id) AS k FROM nodes n LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e USING (id) GROUP BY n.id))"""))
def a7(spark, d):
    g = Graph(spark, d)
    return quality.health(g.nodes, g.edges).select("n", "m", "density", "avg_degree", "max_degree", "orphans", "classes", "instances", "unlabeled")


@query("a7_entropy", sql("SELECT count(*) AS relations, round(1e6 * -sum(p * log2(p)))::BIGINT AS micro_bits FROM (SELECT relation, count(*) / sum(count(*)) OVER () AS p FROM edges GROUP BY relation)"))
def a7b(spark, d):
    return quality.entropy(Graph(spark, d).edges).select("relations", F.round(F.col("relation_entropy") * 1e6).cast("long").alias("micro_bits"))


@query("a7_components", sql("SELECT components, largest, (SELECT round(1e6 * stddev_pop(k))::BIGINT FROM (SELECT count(e.id) AS k FROM nodes n LEFT JOIN (SELECT src AS id FROM places UNION ALL SELECT dst FROM places) e USING (id) GROUP BY n.id)) AS micro_stddev FROM (SELECT count(*) AS components, max(k) AS largest FROM (SELECT c, count(*) AS k FROM (SELECT id, min(root) AS c FROM comp GROUP BY id) GROUP BY c))", PAIRS.replace("FROM edges", "FROM places")))
def a7c(spark, d):
    g = Graph(spark, d)
    return quality.health(g.nodes, g.places).select("components", "largest", F.round(F.col("degree_stddev") * 1e6).cast("long").alias("micro_stddev"))


@query("a8_health_score", sql("""SELECT CASE WHEN s >= 80 THEN 'Healthy' WHEN s >= 50 THEN 'Needs Attention' ELSE 'Critical' END AS badge, components, round(1000 * s)::BIGINT AS millis FROM (SELECT c.k AS components, 100 - CASE WHEN 100e0 * o.k / n.k > 5 THEN least(30, 200e0 * o.k / n.k) ELSE 0 END - CASE WHEN c.k > 10 THEN least(25, 2 * (c.k - 10)) ELSE 0 END - CASE WHEN m.k::DOUBLE / n.k < 2 THEN least(20, 10 * (2 - m.k::DOUBLE / n.k)) ELSE 0 END AS s
FROM (SELECT count(*) AS k FROM nodes) n, (SELECT count(*) AS k FROM places) m, (SELECT count(DISTINCT c) AS k FROM (SELECT id, min(root) AS c FROM comp GROUP BY id)) c, (SELECT count(*) AS k FROM nodes WHERE id NOT IN (SELECT src FROM places UNION SELECT dst FROM places)) o)""", PAIRS.replace("FROM edges", "FROM places")))
def a8(spark, d):
    g = Graph(spark, d)
    return quality.health_score(quality.health(g.nodes, g.places)).select("badge", "components", F.round(F.col("score") * 1000).cast("long").alias("millis"))


@query("a9_repair_health", sql("SELECT o.k / n.k AS orphan_ratio, c.k / n.k AS fragmentation, 2e0 * m.k / n.k AS average_degree, o.k / n.k < 0.05 AND c.k <= 3 AS target_met FROM (SELECT count(*) AS k FROM nodes) n, (SELECT count(*) AS k FROM places) m, (SELECT count(DISTINCT c) AS k FROM (SELECT id, min(root) AS c FROM comp GROUP BY id)) c, (SELECT count(*) AS k FROM nodes WHERE id NOT IN (SELECT src FROM places UNION SELECT dst FROM places)) o", PAIRS.replace("FROM edges", "FROM places")))
def a9(spark, d):
    g = Graph(spark, d)
    return quality.repair_health(quality.health(g.nodes, g.places))


STRUCT = "(SELECT max(depth) AS max_depth, var_pop(depth) AS depth_variance FROM dp) a, (SELECT max(k) AS max_breadth, var_pop(k) AS breadth_variance FROM (SELECT count(*) AS k FROM dp GROUP BY depth)) b, (SELECT count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'instance') AS instances FROM nodes) c, (SELECT count(*)::DOUBLE AS m, count(*) FILTER (relation = 'subClassOf') AS s, count(*) FILTER (relation IN ('related_to', 'type')) AS g FROM edges) e"


@query("a10_structure", sql(f"SELECT max_depth, max_breadth, classes, instances, s / m AS subclass_ratio, (m - s - g) / m AS named_ratio, g / m AS generic_ratio FROM {STRUCT}", DEPTH))
def a10(spark, d):
    g = Graph(spark, d)
    return quality.structure(g.nodes, g.edges).select("max_depth", "max_breadth", "classes", "instances", "subclass_ratio", "named_ratio", "generic_ratio")


@query("a11_reliability", sql(f"""SELECT CASE WHEN score >= .8 THEN 'A' WHEN score >= .6 THEN 'B' WHEN score >= .4 THEN 'C' WHEN score >= .2 THEN 'D' ELSE 'F' END AS grade, round(1000 * score)::BIGINT AS millis FROM (SELECT CASE WHEN depth_variance >= .9 THEN .3 WHEN depth_variance >= .5 THEN .15 ELSE 0 END + CASE WHEN breadth_variance >= 20 THEN .25 WHEN breadth_variance >= 5 THEN .12 ELSE 0 END + CASE WHEN max_breadth >= 100 THEN .2 WHEN max_breadth >= 30 THEN .08 ELSE 0 END
+ CASE WHEN instances / classes >= 1 THEN .15 WHEN instances / classes >= .3 THEN .07 ELSE 0 END + CASE WHEN max_depth >= 5 THEN .1 WHEN max_depth >= 3 THEN .05 ELSE 0 END + CASE WHEN (m - s - g) / m >= .3 THEN .1 WHEN (m - s - g) / m >= .15 THEN .05 ELSE 0 END - CASE WHEN g / m >= .6 THEN .15 ELSE 0 END AS score FROM {STRUCT})""", DEPTH))
def a11(spark, d):
    g = Graph(spark, d)
    return quality.reliability(quality.structure(g.nodes, g.edges)).select("grade", F.round(F.col("score") * 1000).cast("long").alias("millis"))


@query("a12_correctness", sql("SELECT src, relation, dst, CASE WHEN origin = 'extraction' THEN 1 ELSE 2 END AS path_length, round(1000 * least(1e0, 0.5 * least(1e0, vote_count / 5e0) + 0.3 * confidence + 0.2 / CASE WHEN origin = 'extraction' THEN 1 ELSE 2 END))::BIGINT AS millis FROM edges"))
def a12b(spark, d):
    return quality.correctness(Graph(spark, d).edges).select("src", "relation", "dst", "path_length", F.round(F.col("correctness") * 1000).cast("long").alias("millis"))


@query("a15_targets", sql("SELECT n.id, count(DISTINCT e.src) AS instances FROM nodes n LEFT JOIN edges e ON e.relation = 'type' AND e.dst = n.id WHERE n.kind = 'class' GROUP BY n.id"))
def a15(spark, d):
    g = Graph(spark, d)
    return graph.population(g.nodes, g.edges)


@query("a21_relation_summary", sql("SELECT id, way, relation, k FROM (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY k DESC, relation) AS r FROM (SELECT id, way, relation, count(*) AS k FROM (SELECT src AS id, 'out' AS way, relation FROM edges UNION ALL SELECT dst, 'in', relation FROM edges) GROUP BY ALL)) WHERE r <= 4"))
def a21(spark, d):
    return graph.relation_summary(Graph(spark, d).edges, 4)


@query("a22_rollup", sql("SELECT relation, origin, count(*) AS k FROM edges GROUP BY ROLLUP (relation, origin)"))
def a22(spark, d):
    return Graph(spark, d).edges.rollup("relation", "origin").agg(F.count("*").alias("k"))


@query("c5_component_pairs", sql("""SELECT r.id AS src, b.id AS dst FROM rep r, (SELECT * FROM rep ORDER BY n DESC, c LIMIT 1) b WHERE r.c <> b.c ORDER BY r.n DESC, r.c LIMIT 30""", PAIRS.replace("FROM edges", "FROM places") + """, rep AS (SELECT c, count(*) AS n, arg_min(id, (-k, seq)) AS id FROM (SELECT x.id, x.c, n.seq, coalesce(d.k, 0) AS k FROM (SELECT id, min(root) AS c FROM comp GROUP BY id) x JOIN nodes n USING (id) LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM places UNION ALL SELECT dst FROM places) GROUP BY 1) d USING (id)) GROUP BY c)"""))
def c5(spark, d):
    from ..operators.repair import component_pairs

    g = Graph(spark, d)
    return component_pairs(g.nodes, g.places)


@query("o4_node_rank", sql("SELECT n.id, v.votes, d.k AS degree FROM nodes n JOIN (SELECT src AS id, sum(vote_count)::BIGINT AS votes FROM edges GROUP BY 1) v USING (id) JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d USING (id) ORDER BY 0.6 * v.votes / (SELECT max(x) FROM (SELECT sum(vote_count) AS x FROM edges GROUP BY src)) + 0.4 * d.k / (SELECT max(x) FROM (SELECT count(*) AS x FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)) DESC, seq LIMIT 20"))
def o4(spark, d):
    g = Graph(spark, d)
    return graph.rank_nodes(g.nodes, g.edges, 20).select("id", "votes", "degree")


@query("o5_most_connected", sql("SELECT n.id, d.k AS degree FROM nodes n JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d USING (id) WHERE kind = 'class' ORDER BY d.k DESC, seq LIMIT 10"))
def o5(spark, d):
    g = Graph(spark, d)
    return quality.degrees(g.nodes, g.edges).join(g.nodes.where("kind = 'class'").select("id", "seq"), "id").orderBy(F.desc("degree"), "seq").limit(10).select("id", "degree")


@query("o6_top_relations", sql("SELECT src, relation, dst, vote_count FROM edges ORDER BY vote_count DESC, src, relation, dst LIMIT 20"))
def o6(spark, d):
    return Graph(spark, d).edges.orderBy(F.desc("vote_count"), "src", "relation", "dst").limit(20).select("src", "relation", "dst", "vote_count")


@query("o9_best_edge", sql("SELECT src, relation, dst, vote_count FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY vote_count DESC, relation, dst) AS r FROM edges) WHERE r = 1"))
def o9(spark, d):
    best = F.min(F.struct((-F.col("vote_count")).alias("v"), "relation", "dst")).alias("b")
    return Graph(spark, d).edges.groupBy("src").agg(best).select("src", "b.relation", "b.dst", (-F.col("b.v")).alias("vote_count"))


@query("w2_hub_ranks", sql("SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) - 1 AS rank FROM edges e JOIN (SELECT src FROM edges WHERE relation = 'supplies' GROUP BY src HAVING count(*) > 80) h USING (src) WHERE relation = 'supplies'"))
def w2(spark, d):
    return graph.hub_ranks(Graph(spark, d).supplies)


@query("u2_new_edges", sql("SELECT src, dst FROM sub EXCEPT SELECT src, dst FROM edges WHERE relation = 'subClassOf'", CLOSE))
def u2(spark, d):
    e = Graph(spark, d).edges.where("relation = 'subClassOf'")
    return fixpoint.transitive_closure(e).select("src", "dst").exceptAll(e.select("src", "dst"))


@query("u6_entity_names", sql("SELECT id FROM nodes WHERE kind IN ('class', 'instance') GROUP BY id"))
def u6(spark, d):
    n = Graph(spark, d).nodes
    return n.where("kind = 'class'").select("id").union(n.where("kind = 'instance'").select("id")).distinct()


@query("u7_merge_counters", sql("SELECT (SELECT count(*) FROM nodes WHERE kind = 'instance') AS new_nodes, (SELECT count(*) FROM nodes WHERE kind = 'class') AS updated_nodes, (SELECT count(*) FROM types) AS new_edges"))
def u7(spark, d):
    g = Graph(spark, d)
    return merge.merge_counters(g.nodes.where("kind = 'class'"), g.nodes, g.places, g.places.unionByName(g.types))


@query("a6_merge_graphs", sql("SELECT id, coalesce(min(CASE WHEN kind = 'class' THEN description END), min(description)) AS description, count(*) AS k FROM nodes GROUP BY id"))
def a6(spark, d):
    n = Graph(spark, d).nodes.select("id", "description", F.array("kind").alias("source_documents"))
    out = merge.merge_graphs(n, n.where("array_contains(source_documents, 'class')"), ["id"])
    return out.select("id", "description", F.size("source_documents").cast("long").alias("k"))


@query("a13_set_metrics", sql("SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND b) / count(*) FILTER (a) AS precision, count(*) FILTER (a AND b) / count(*) FILTER (b) AS recall, 2e0 * count(*) FILTER (a AND b) / (count(*) FILTER (a) + count(*) FILTER (b)) AS f1 FROM (SELECT id, kind = 'class' OR seq % 2 = 0 AS a, kind = 'instance' AS b FROM nodes)"))
def a13(spark, d):
    n = Graph(spark, d).nodes.select(F.col("id").alias("key"), "kind", "seq")
    return quality.set_metrics(n.where("kind = 'class' or seq % 2 = 0"), n.where("kind = 'instance'"))


@query("g18_session_graph", "SELECT 'node' AS what, lower(p_brand) AS a, NULL AS relation, NULL AS b, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'edge', lower(p_brand), 'makes', lower(p_type), count(*) FROM part GROUP BY 2, 4")
def g18(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    n = graph.session_nodes(p.select(F.lit("s").alias("session"), F.col("p_brand").alias("concept"))).select(F.lit("node").alias("what"), F.col("node").alias("a"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("b"), F.col("k").alias("n"))
    e = graph.session_edges(p.select(F.lit("s").alias("session"), F.col("p_brand").alias("src"), F.lit("Makes").alias("relation"), F.col("p_type").alias("dst")))
    return n.unionByName(e.select(F.lit("edge").alias("what"), F.col("src").alias("a"), "relation", F.col("dst").alias("b"), "n"))


@query("g13_view", sql("SELECT n.id, kind = 'class' AND n.id NOT IN (SELECT src FROM places WHERE relation = 'subClassOf') AS root, l.level, c.cluster, n.id NOT IN (SELECT src FROM places UNION SELECT dst FROM places) AS isolated FROM nodes n LEFT JOIN (SELECT id, min(depth) AS level FROM top GROUP BY id) l USING (id) JOIN (SELECT id, min(root) AS cluster FROM comp GROUP BY id) c USING (id)", PAIRS.replace("FROM edges", "FROM places") + ", top(id, depth) AS (SELECT id, 0 FROM nodes WHERE kind = 'class' AND id NOT IN (SELECT src FROM places WHERE relation = 'subClassOf') UNION SELECT e.src, top.depth + 1 FROM top JOIN places e ON e.relation = 'subClassOf' AND e.dst = top.id)"))
def g13v(spark, d):
    from ..operators.viewer import view

    g = Graph(spark, d)
    return view(g.nodes, g.places)["nodes"].select("id", "root", "level", "cluster", "isolated")


@query("g19_profiles", sql("""SELECT n.id, coalesce('parent: ' || p.parent || '; ', '') || 'children: ' || coalesce(c.children, 0) || '; relations: ' || coalesce(r.k, 0) || '; properties: ' || coalesce(dp.k, 0) AS profile FROM nodes n LEFT JOIN (SELECT src AS id, min(dst) AS parent FROM edges WHERE relation IN ('subClassOf', 'type') GROUP BY 1) p USING (id)
LEFT JOIN (SELECT dst AS id, count(*) AS children FROM edges WHERE relation IN ('subClassOf', 'type') GROUP BY 1) c USING (id) LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) r USING (id) LEFT JOIN (SELECT entity AS id, count(*) AS k FROM data_props GROUP BY 1) dp USING (id)"""))
def g19p(spark, d):
    g = Graph(spark, d)
    return graph.profiles(g.nodes, g.edges, g.data_props)


@query("a21_groups", sql("SELECT id, grp, list_sort(list(other)) AS others FROM (SELECT src AS id, CASE WHEN relation = 'subClassOf' THEN 'Children' WHEN relation = 'type' THEN 'Instances' ELSE 'Other' END AS grp, dst AS other FROM edges UNION ALL SELECT dst, CASE WHEN relation IN ('subClassOf', 'type') THEN 'Parents' ELSE 'Other' END, src FROM edges) GROUP BY 1, 2"))
def a21g(spark, d):
    from ..operators.viewer import relation_groups

    return relation_groups(Graph(spark, d).edges)


@query("a21_group_rows", sql("SELECT src AS id, CASE WHEN relation = 'subClassOf' THEN 'Children' WHEN relation = 'type' THEN 'Instances' ELSE 'Other' END AS grp, dst AS other FROM edges UNION ALL SELECT dst, CASE WHEN relation IN ('subClassOf', 'type') THEN 'Parents' ELSE 'Other' END, src FROM edges"))
def a21r(spark, d):
    from ..operators.viewer import group_rows

    return group_rows(Graph(spark, d).edges)


@query("p15_hidden", sql("SELECT src, relation, dst, relation NOT IN ('subClassOf', 'type') OR (ko > 80 AND ro > 20) OR (ki > 80 AND ri > 20) AS hidden FROM (SELECT src, relation, dst, count(*) OVER (PARTITION BY src) AS ko, count(*) OVER (PARTITION BY dst) AS ki, row_number() OVER (PARTITION BY src ORDER BY dst, relation) AS ro, row_number() OVER (PARTITION BY dst ORDER BY src, relation) AS ri FROM edges)"))
def p15h(spark, d):
    from ..operators.viewer import hidden

    return hidden(Graph(spark, d).edges, zoom=0.6, cap=20)


@query("a15_population_targets", sql("SELECT n.id, coalesce(d.k, 0) AS degree, 0::BIGINT AS instances FROM nodes n LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM places UNION ALL SELECT dst FROM places) GROUP BY 1) d USING (id) WHERE kind = 'class' ORDER BY 2 DESC, seq LIMIT 10"))
def a15t(spark, d):
    from ..operators.hierarchy import population_targets

    g = Graph(spark, d)
    return population_targets(g.nodes.where("kind = 'class'"), g.places)


@query("a13_ontology_metrics", sql("""SELECT round(c, 4) AS class_f1, round(i, 4) AS instance_f1, round(r, 4) AS relation_f1, round((c + i + r) / 3, 4) AS overall, round(2e0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 3) AS average_degree FROM
(SELECT 2e0 * count(*) FILTER (seq % 2 = 0) / (count(*) FILTER (seq % 2 = 0) + count(*)) AS c FROM (SELECT id, min(seq) AS seq FROM nodes WHERE kind = 'class' GROUP BY id)), (SELECT 2e0 * count(*) FILTER (seq % 2 = 0) / (count(*) FILTER (seq % 2 = 0) + count(*)) AS i FROM (SELECT id, min(seq) AS seq FROM nodes WHERE kind = 'instance' GROUP BY id)), (SELECT 1e0 AS r)"""))
def a13o(spark, d):
    g = Graph(spark, d)
    n = g.nodes.groupBy("kind", F.col("id").alias("key")).agg(F.min("seq").alias("seq"))
    r = g.places.select(F.lit("relation").alias("kind"), F.concat_ws("|", "src", "relation", "dst").alias("key"))
    said, true = n.where("seq % 2 = 0").select("kind", "key").unionByName(r.select("kind", F.upper("key").alias("key"))), n.select("kind", "key").unionByName(r)
    return quality.ontology_metrics(said, true, g.nodes.count(), g.edges.count())


@query("a13_relation_f1", sql("SELECT 1e0 AS class_f1, 1e0 AS instance_f1, round(2e0 * k / (k + n), 4) AS relation_f1, round((2e0 + 2e0 * k / (k + n)) / 3, 4) AS overall, round(2e0 * n / (SELECT count(*) FROM nodes), 3) AS average_degree FROM (SELECT count(*) AS n, count(*) FILTER (length(dst) % 2 = 1 OR length(src) % 3 = 0) AS k FROM edges)"))
def a13r(spark, d):
    """Relations of the whole graph, of which those with names of some lengths are predicted."""
    g = Graph(spark, d)
    n = g.nodes.select("kind", F.col("id").alias("key"))
    r = g.edges.select(F.lit("relation").alias("kind"), F.concat_ws("|", "src", "relation", "dst").alias("key"), ((F.length("dst") % 2 == 1) | (F.length("src") % 3 == 0)).alias("said"))
    return quality.ontology_metrics(n.unionByName(r.where("said").select("kind", "key")), n.unionByName(r.select("kind", "key")), g.nodes.count(), g.edges.count())


@query("a15_population_whole", sql("SELECT id, degree, instances FROM (SELECT n.id, seq, count(*) FILTER (e.id IS NOT NULL) AS degree, count(*) FILTER (e.relation = 'hasBrand') AS instances FROM nodes n LEFT JOIN (SELECT src AS id, 'x' AS relation FROM edges UNION ALL SELECT dst, relation FROM edges) e USING (id) WHERE kind = 'class' GROUP BY n.id, seq) WHERE instances = 0 ORDER BY degree DESC, seq LIMIT 10"))
def a15w(spark, d):
    """All edges, with brands as the classes that parts are of: classes without parts, most connected first."""
    from ..operators.hierarchy import population_targets

    g = Graph(spark, d)
    e = g.edges.where("relation != 'type'").unionByName(g.edges.where("relation = 'type'").withColumn("relation", F.lit("was")))
    e = e.withColumn("relation", F.when(F.col("relation") == "hasBrand", "type").otherwise(F.col("relation")))
    return population_targets(g.nodes, e, share=1e9)


@query("u7_merge_counters_all", sql("SELECT (SELECT count(*) FROM nodes WHERE kind = 'instance' AND id LIKE 'Part#%') AS new_nodes, (SELECT count(*) FROM nodes WHERE NOT id LIKE 'Part#%') AS updated_nodes, (SELECT count(*) FROM edges WHERE src LIKE 'Part#%' OR dst LIKE 'Part#%') AS new_edges"))
def u7a(spark, d):
    """A graph without parts, into which the whole graph is merged."""
    g = Graph(spark, d)
    return merge.merge_counters(g.nodes.where("id not like 'Part#%'"), g.nodes, g.edges.where("src not like 'Part#%' and dst not like 'Part#%'"), g.edges)


@query("t5_incremental_repair", sql("SELECT id AS src, 'subClassOf' AS relation, 'DomainRoot' AS dst, 'root' AS step FROM nodes WHERE kind = 'class' AND id NOT IN (SELECT src FROM places UNION SELECT dst FROM places)"))
def t5(spark, d):
    """Among classes alone no orphans are left to link; tests hold links of instances against expected rows."""
    from ..operators.repair import repair_incremental

    g = Graph(spark, d)
    return repair_incremental(g.nodes.where("kind = 'class'"), g.places)
