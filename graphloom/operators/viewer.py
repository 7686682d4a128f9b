"""What a viewer of a graph needs: styles, normalised views, groups of relations, visible edges, rows to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..scratch import stored
from ..sources.versions import read_version, write_version
from .components import connected_components
from .fixpoint import bfs_levels
from .graph import adjacency, normalize, roots
from .quality import degrees
from .ranks import beyond_first
from .strong import cycle_edges

VIRTUAL_ROOT = "__root__"


def ring(degree: Column) -> Column:
    """0 for hubs, 1 from ten edges on, 2 from two, else 3."""
    return F.when(degree > fixed.HUB_DEGREE, 0).when(degree >= 10, 1).when(degree >= 2, 2).otherwise(3)


def styles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, ring, size, mass) of nodes: size grows with the logarithm of the degree to 90, mass with the degree from 1.5 to 6."""
    d = F.col("degree")
    return degrees(nodes, edges).select("id", "degree", ring(d).alias("ring"), F.least(F.lit(90.0), 20 + 14 * F.ln(d + 1.0)).alias("size"), F.greatest(F.lit(1.5), F.least(F.lit(6.0), d * 0.6)).alias("mass"))


def opacity(correctness: Column) -> Column:
    return F.when(correctness.isNull(), 0.96).otherwise(0.35 + correctness * 0.6)


def view(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """nodes (id, kind, root, level, cluster, isolated), edges (without copies and without missing ends) and cyclic (one row).

    Levels count from the classes without a superclass; a node that these don't reach has none. Where no class is without a
    superclass, a virtual root stands above nothing and is the only root."""
    e = stored(normalize(nodes, edges).select("src", "relation", "dst"), "view")
    sub = e.where("relation = 'subClassOf'")
    top = stored(roots(nodes.where("kind = 'class'"), e).distinct(), "roots")
    rows = nodes.select("id", "kind").distinct()
    if top.isEmpty() and not rows.isEmpty():
        virtual = nodes.sparkSession.createDataFrame([(VIRTUAL_ROOT, "class")], "id string, kind string")
        rows, top = rows.unionByName(virtual), virtual.select("id")
    levels = bfs_levels(sub.select(F.col("dst").alias("src"), F.col("src").alias("dst")), top.select(F.col("id").alias("node"))).withColumnRenamed("node", "id")
    cluster = connected_components(e).withColumnsRenamed({"node": "id", "component": "cluster"})  # of nodes with edges; others are their own
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_e", F.lit(True))
    out = rows.join(top.withColumn("_r", F.lit(True)), "id", "left").join(levels, "id", "left").join(cluster, "id", "left").join(ends, "id", "left")
    out = out.select("id", "kind", F.coalesce("_r", F.lit(False)).alias("root"), "level", F.coalesce("cluster", "id").alias("cluster"), F.col("_e").isNull().alias("isolated"))
    cyclic = cycle_edges(sub).agg((F.count("*") > 0).alias("cyclic"))
    return {"nodes": out, "edges": e, "cyclic": cyclic}


def group_rows(edges: DataFrame) -> DataFrame:
    """(id, grp, other): each node's neighbours by groups, a row for each edge: the exact form for nodes of any degree. subClassOf counts the far end
    as a parent where the edge comes in, as the viewer that this follows does."""
    rel, way = F.col("relation"), F.col("way")
    kind = rel.isin("type", "instanceOf")
    grp = F.when(rel == "subClassOf", F.when(way == "in", "Parents").otherwise("Children")).when(kind, F.when(way == "out", "Instances").otherwise("Parents")).when(rel.isin("depends_on", "part_of", "contains"), "Dependencies").otherwise("Other")
    return adjacency(edges).select("id", grp.alias("grp"), "other")


def relation_groups(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, grp, others): group_rows as one sorted array a group; with most, the first of each, which Spark limits before the exchange. Where
    groups have millions of members, take group_rows or a limit."""
    rows = group_rows(edges)
    if most is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id", "grp").orderBy("other"))).where(F.col("_r") <= most)
    return rows.groupBy("id", "grp").agg(F.array_sort(F.collect_list("other")).alias("others"))


def hidden(edges: DataFrame, clusters: DataFrame | None = None, show: str = "all", mode: str = "all", zoom: float = 1.0, cap: int | None = None) -> DataFrame:
    """edges (src, relation, dst) with hidden. show: all, intraCluster (both ends in one cluster of clusters (id, cluster)), subClassOf,
    type or other; mode: all, classes or instances; zoom: below 0.45 only the hierarchy, below 0.75 only structure; cap: so many
    out- and in-edges of a hub, in the order of their other ends."""
    rel, kind = F.col("relation"), F.col("relation").isin("type", "instanceOf")
    off = F.lit(False)
    if show == "intraCluster":
        c = clusters.select("id", "cluster")
        edges = edges.join(c.select(F.col("id").alias("src"), F.col("cluster").alias("_a")), "src", "left").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("_b")), "dst", "left")
        off = ~F.col("_a").eqNullSafe(F.col("_b"))
    elif show == "subClassOf":
        off = rel != "subClassOf"
    elif show == "type":
        off = ~kind
    elif show == "other":
        off = kind | (rel == "subClassOf")
    if zoom < 0.45:
        off = off | (rel != "subClassOf")
    elif zoom < 0.75:
        off = off | ~rel.isin("subClassOf", "type", "instanceOf", "part_of", "contains")
    off = off | ((rel != "subClassOf") if mode == "classes" else ~kind if mode == "instances" else F.lit(False))
    if cap is not None:
        for end, other in (("src", "dst"), ("dst", "src")):
            edges, late = beyond_first(edges, end, [other, "relation"], cap, fixed.HUB_DEGREE)
            off = off | late
    return edges.select("src", "relation", "dst", F.coalesce(off, F.lit(False)).alias("hidden"))


def view_rows(nodes: DataFrame, edges: DataFrame, version: int = 1) -> DataFrame:
    """(version, kind, id, json): one row for each node with its style and one for each edge with its id, so that no row holds the graph."""
    n = nodes.select("id", "kind").join(styles(nodes, edges), "id").select(F.lit("node").alias("what"), "id", F.to_json(F.struct("id", "kind", "degree", "ring", F.round("size", 3).alias("size"), "mass")).alias("json"))
    e = normalize(nodes, edges).withColumn("id", text.edge_id("src", "dst", "relation"))
    e = e.select(F.lit("edge").alias("what"), "id", F.to_json(F.struct("id", "src", "relation", "dst")).alias("json"))
    return n.unionByName(e).select(F.lit(version).alias("version"), F.col("what").alias("kind"), "id", "json")


def save_view(rows: DataFrame, path: str, source: str) -> None:
    """Keep the rows of a view, with the version of the graph that they show, as a new version under path."""
    write_version(rows.sparkSession, path, {"view": rows.withColumn("source", F.lit(source))})


def load_view(spark: SparkSession, path: str, source: str, version: int = 1) -> DataFrame | None:
    """The kept rows, unless there are none or they have another layout or show another version of the graph."""
    rows = (read_version(spark, path) or {}).get("view")
    return None if rows is None or rows.where((F.col("source") != source) | (F.col("version") != version)).limit(1).count() else rows.drop("source")
