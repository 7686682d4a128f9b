"""Health, structure, reliability, correctness and consistency of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..scratch import stored
from .components import connected_components
from .fixpoint import bfs_levels


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): in- and out-edges of every node, 0 for orphans. Partial sums keep hubs from being one task's work."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component); an isolated node is its own."""
    c = connected_components(edges)
    return nodes.select("id").join(c.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def entropy(edges: DataFrame) -> DataFrame:
    """One row: relations, relation_entropy in bits."""
    n = edges.groupBy("relation").agg(F.count("*").alias("k"))
    n = n.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy()))
    return n.agg(F.count("*").alias("relations"), F.coalesce(F.sum(-F.col("p") * F.log2("p")), F.lit(0.0)).alias("relation_entropy"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of structural health: counts, density (2m / n(n-1)), mean and greatest degree, orphans, components, largest component, score and badge."""
    edges = stored(edges.select("src", "relation", "dst"), "edges")
    d = degrees(nodes, edges).agg(F.count("*").alias("n"), F.sum("degree").alias("ends"), F.max("degree").alias("max_degree"), F.stddev_pop("degree").alias("degree_stddev"), F.count_if(F.expr("degree = 0")).alias("orphans"))
    sizes = node_components(nodes, edges).groupBy("component").agg(F.count("*").alias("k"))
    c = sizes.agg(F.count("*").alias("components"), F.max("k").alias("largest"))
    kinds = nodes.agg(F.count_if(F.expr("kind = 'class'")).alias("classes"), F.count_if(F.expr("kind = 'instance'")).alias("instances"), F.count_if(F.expr("coalesce(description, '') = ''")).alias("unlabeled"))
    out = d.join(c).join(kinds).join(edges.agg(F.count("*").alias("m")))
    return out.select("n", "m", F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"), (F.coalesce("ends", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avg_degree"), "max_degree", "degree_stddev", "orphans", "components", "largest", "classes", "instances", "unlabeled")


def health_score(h: DataFrame) -> DataFrame:
    """Adds score (100 less penalties for orphans, components and sparseness) and badge to rows of health()."""
    orphan = 100.0 * F.col("orphans") / F.greatest("n", F.lit(1))
    dense = F.col("m") / F.greatest("n", F.lit(1))
    score = 100.0 - F.when(orphan > 5, F.least(F.lit(30.0), 2 * orphan)).otherwise(0.0) - F.when(F.col("components") > 10, F.least(F.lit(25.0), 2.0 * (F.col("components") - 10))).otherwise(0.0) - F.when(dense < 2, F.least(F.lit(20.0), 10 * (2 - dense))).otherwise(0.0)
    h = h.withColumn("score", F.when(F.col("n") > 0, score).otherwise(0.0))
    return h.withColumn("badge", F.when(F.col("n") == 0, "Empty").when(F.col("score") >= 80, "Healthy").when(F.col("score") >= 50, "Needs Attention").otherwise("Critical"))


def repair_health(h: DataFrame, max_orphans: float = 0.05, max_components: int = 3) -> DataFrame:
    n = F.greatest("n", F.lit(1))
    ratio = F.col("orphans") / n
    return h.select(ratio.alias("orphan_ratio"), (F.col("components") / n).alias("fragmentation"), (2.0 * F.col("m") / n).alias("average_degree"), ((F.col("n") == 0) | ((ratio < max_orphans) & (F.col("components") <= max_components))).alias("target_met"))


def class_hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """subClassOf edges between classes."""
    c = nodes.where("kind = 'class'")
    e = edges.where("relation = 'subClassOf'").select("src", "dst")
    return e.join(c.select(F.col("id").alias("src")), "src", "left_semi").join(c.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def depths(nodes: DataFrame, edges: DataFrame, root: str = "Thing") -> DataFrame:
    """(id, depth) of classes, from root or else the first class by seq that has no superclass; 0 where it can't be reached."""
    h = class_hierarchy(nodes, edges)
    classes = nodes.where("kind = 'class'").select("id", "seq")
    tops = classes.join(h.select(F.col("src").alias("id")), "id", "left_anti").withColumn("o", F.when(F.col("id") == root, -1).otherwise(F.col("seq")))
    start = tops.agg(F.min_by("id", "o").alias("node")).where("node is not null")
    levels = bfs_levels(h.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
    return classes.select("id").join(levels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("depth"))


def structure(nodes: DataFrame, edges: DataFrame, root: str = "Thing") -> DataFrame:
    """One row: depth and breadth (classes a level, empty levels are 0) statistics, counts, shares of subClassOf, named and generic relations."""
    d = depths(nodes, edges, root)
    deep = d.agg(F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"), F.avg("depth").alias("avg_depth"), F.var_pop("depth").alias("depth_variance"))
    levels = deep.select(F.explode(F.sequence(F.lit(0), F.coalesce("max_depth", F.lit(0)))).alias("depth"))
    broad = levels.join(d.groupBy("depth").agg(F.count("*").alias("k")), "depth", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    broad = broad.agg(F.max("k").alias("max_breadth"), F.min("k").alias("min_breadth"), F.avg("k").alias("avg_breadth"), F.var_pop("k").alias("breadth_variance"))
    kinds = nodes.agg(F.count_if(F.expr("kind = 'class'")).alias("classes"), F.count_if(F.expr("kind = 'instance'")).alias("instances"))
    rel = edges.agg(F.count("*").alias("m"), F.count_if(F.expr("relation = 'subClassOf'")).alias("sub"), F.count_if(F.expr("relation in ('related_to', 'type')")).alias("gen"))
    m = F.greatest("m", F.lit(1))
    return deep.join(broad).join(kinds).join(rel).select("max_depth", "min_depth", "avg_depth", "depth_variance", "max_breadth", "min_breadth", "avg_breadth", "breadth_variance", "classes", "instances", (F.col("sub") / m).alias("subclass_ratio"), ((F.col("m") - F.col("sub") - F.col("gen")) / m).alias("named_ratio"), (F.col("gen") / m).alias("generic_ratio"))


def _ladder(value, *steps):
    out = F.lit(0.0)
    for at, points in reversed(steps):
        out = F.when(value >= at, points).otherwise(out)
    return out


def grade(score):
    out = F.lit("F")
    for at, g in reversed(fixed.GRADES):
        out = F.when(score >= at, g).otherwise(out)
    return out


def reliability(s: DataFrame) -> DataFrame:
    """score (0 to 1) and grade of rows of structure()."""
    c = F.col
    per = c("instances") / F.greatest(c("classes"), F.lit(1))
    score = _ladder(c("depth_variance"), (0.9, 0.30), (0.5, 0.15)) + _ladder(c("breadth_variance"), (20, 0.25), (5, 0.12)) + _ladder(c("max_breadth"), (100, 0.20), (30, 0.08)) + _ladder(per, (1.0, 0.15), (0.3, 0.07)) + _ladder(c("max_depth"), (5, 0.10), (3, 0.05)) + _ladder(c("named_ratio"), (0.3, 0.10), (0.15, 0.05)) - F.when(c("generic_ratio") >= 0.6, 0.15).otherwise(0.0)
    s = s.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    return s.withColumn("grade", grade(F.col("score")))


def correctness(edges: DataFrame) -> DataFrame:
    """Adds path_length and correctness: half by votes (five count in full), 0.3 by confidence, 0.2 by the length of the derivation. Columns: vote_count, confidence, origin."""
    length = F.when(F.col("origin").isin("inference_owl", "inference_llm", "repair"), 2).otherwise(1)
    votes = F.when(F.col("vote_count") > 0, F.col("vote_count")).otherwise(1)
    score = 0.5 * F.least(F.lit(1.0), votes / 5.0) + 0.3 * F.col("confidence") + 0.2 / length
    return edges.withColumn("path_length", length).withColumn("correctness", F.least(F.lit(1.0), score))


def consistency(edges: DataFrame, axioms: DataFrame) -> DataFrame:
    """(kind, severity, a, b): disjoint classes with a subClassOf between them, subClassOf both ways, subclasses that share a parent with their superclass, asymmetric relations both ways."""
    sub = edges.where("relation = 'subClassOf'").select("src", "dst").distinct()
    dis = axioms.where("axiom_type = 'disjointness'").select(F.get("entities", F.lit(0)).alias("a"), F.get("entities", F.lit(1)).alias("b"))
    pairs = dis.unionByName(dis.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = sub.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    either = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    back = ends.select(F.col("b").alias("a"), F.col("a").alias("b"))
    shared = ends.where("a != b").join(sub.select(F.col("src").alias("a"), "dst"), "a").join(sub.select(F.col("src").alias("b"), "dst"), ["b", "dst"]).select("a", "b").distinct()
    asym = axioms.where("axiom_type = 'asymmetry'").select(F.explode("entities").alias("relation"))
    # relations that axioms name are few; edges dealt by relation would all be one task's
    e = edges.join(F.broadcast(asym), "relation").select("relation", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    two = e.join(e.select("relation", F.col("b").alias("a"), F.col("a").alias("b")), ["relation", "a", "b"], "left_semi")
    tag = lambda df, kind, sev: df.select(F.lit(kind).alias("kind"), F.lit(sev).alias("severity"), "a", "b")
    return tag(pairs.join(either, ["a", "b"], "left_semi"), "disjoint_subclass", "critical").unionByName(tag(ends.where("a != b").join(back, ["a", "b"], "left_semi"), "two_way_subclass", "critical")).unionByName(tag(shared, "shared_parent", "warning")).unionByName(tag(two, "asymmetric_both_ways", "warning"))


def ontology_metrics(predicted: DataFrame, reference: DataFrame, nodes: int, edges: int) -> DataFrame:
    """One row: f1 of classes, instances and relations (by rows (kind, key), keys of relations in lower case), their mean as overall, and the average degree; rounded to four and three places."""
    f1 = {}
    for k in ("class", "instance", "relation"):
        key = F.lower("key") if k == "relation" else F.col("key")
        f1[k] = set_metrics(*(t.where(F.col("kind") == k).select(key.alias("key")) for t in (predicted, reference))).select(F.col("f1").alias(k))
    out = f1["class"].join(f1["instance"]).join(f1["relation"])
    mean = (F.col("class") + F.col("instance") + F.col("relation")) / 3
    return out.select(*(F.round(k, 4).alias(f"{k}_f1") for k in f1), F.round(mean, 4).alias("overall"), F.lit(round(2 * edges / nodes, 3) if nodes else 0.0).alias("average_degree"))


def set_metrics(predicted: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """One row: tp, precision, recall, f1 of two sets; both empty 1, one empty 0."""
    p, r = predicted.select(key).distinct().withColumn("p", F.lit(1)), reference.select(key).distinct().withColumn("r", F.lit(1))
    n = p.join(r, key, "full").agg(F.count("p").alias("np"), F.count("r").alias("nr"), F.count_if(F.expr("p is not null and r is not null")).alias("tp"))
    f = lambda d: F.when((F.col("np") == 0) & (F.col("nr") == 0), 1.0).when(F.col(d) == 0, 0.0).otherwise(F.col("tp") / F.col(d))
    f1 = F.when((F.col("np") == 0) & (F.col("nr") == 0), 1.0).when(F.col("np") + F.col("nr") == 0, 0.0).otherwise(2.0 * F.col("tp") / (F.col("np") + F.col("nr")))
    return n.select("tp", f("np").alias("precision"), f("nr").alias("recall"), f1.alias("f1"))
