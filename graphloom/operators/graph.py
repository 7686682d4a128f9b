"""Look-ups, neighbourhoods and views over nodes (id, seq, kind, ...) and edges (src, relation, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .quality import degrees
from .ranks import ranked

KEYS = ["src", "relation", "dst"]


def lookup(ids: DataFrame, nodes: DataFrame, columns: dict) -> DataFrame:
    """ids with columns of their nodes; a missing node or null gives the default."""
    return ids.join(nodes.select("id", *columns), "id", "left").select("id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in columns.items()))


def has_edge(asked: DataFrame, edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """asked with exists: whether an edge has the same keys."""
    return asked.join(edges.select(*keys).distinct().withColumn("_e", F.lit(True)), keys, "left").withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_e")


def edge_filters(edges: DataFrame) -> DataFrame:
    """Adds bucket (hierarchy, type, other) and whether an edge shows when zoomed far out and in the middle."""
    bucket = F.when(F.col("relation") == "subClassOf", "hierarchy").when(F.col("relation") == "type", "type").otherwise("other")
    return edges.withColumn("bucket", bucket).withColumn("far", F.col("relation") == "subClassOf").withColumn("middle", F.col("relation").isin("subClassOf", "type", "partOf", "hasPart"))


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("id"), F.lit(text.lower()))).orderBy("seq").limit(1)


def parents_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sub = edges.where("relation = 'subClassOf'").select("src", "dst").distinct()
    up = sub.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("parents"))
    down = sub.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("children"))
    none = F.array().cast("array<string>")
    return nodes.select("id").join(up, "id", "left").join(down, "id", "left").select("id", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def context_lines(edges: DataFrame) -> DataFrame:
    """(id, line): a row for each different out- and in-edge of each node, as text: the exact form for nodes of any degree."""
    return edges.select(F.col("src").alias("id"), F.concat("relation", F.lit(" -> "), "dst").alias("line")).unionByName(edges.select(F.col("dst").alias("id"), F.concat("relation", F.lit(" <- "), "src").alias("line"))).distinct()


def node_context(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, context): context_lines of each node, sorted, joined by semicolons; with most, its first lines only, which Spark limits before
    the exchange. A node's text is one value: where nodes have millions of edges, take context_lines or a limit."""
    rows = context_lines(edges)
    if most is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where(F.col("_r") <= most)
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("line")), "; ").alias("context"))


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select(F.col("src").alias("u"), F.col("relation").alias("r1"), F.col("dst").alias("v"))
    b = second.select(F.col("src").alias("v"), F.col("relation").alias("r2"), F.col("dst").alias("w"))
    return a.join(b, "v").where("u != w")


def normalize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges once each (with copies), without those that miss an end."""
    ids = nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.groupBy(*KEYS).agg(F.count("*").alias("copies"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a superclass."""
    return nodes.select("id").join(edges.where("relation = 'subClassOf'").select(F.col("src").alias("id")), "id", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("id"), "relation", F.col("dst").alias("other"), F.lit("out").alias("way"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), "relation", F.col("src").alias("other"), F.lit("in").alias("way")))


def candidates(nodes: DataFrame, edges: DataFrame, data_props: DataFrame) -> DataFrame:
    """Profile of each node: parent (the least by name), and numbers of children, relations and properties."""
    up = edges.where("relation in ('subClassOf', 'type')")
    parent = up.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
    child = up.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("children"))
    props = data_props.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("properties"))
    out = nodes.select("id").join(parent, "id", "left").join(child, "id", "left").join(degrees(nodes, edges), "id", "left").join(props, "id", "left")
    return out.select("id", "parent", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("degree", F.lit(0)).alias("relations"), F.coalesce("properties", F.lit(0)).alias("properties"))


def edges_to_add(rows: DataFrame) -> DataFrame:
    """Rows with both ends; relation related_to and confidence 1 where absent."""
    ok = "src is not null and src != '' and dst is not null and dst != ''"
    return rows.where(ok).select("src", F.coalesce("relation", F.lit("related_to")).alias("relation"), "dst", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def population(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, instances) of classes."""
    n = edges.where("relation = 'type'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("instances"))
    return nodes.where("kind = 'class'").select("id").join(n, "id", "left").select("id", F.coalesce("instances", F.lit(0)).alias("instances"))


def relation_summary(edges: DataFrame, most: int = 4) -> DataFrame:
    """Each node's most frequent relations in either way."""
    k = adjacency(edges).groupBy("id", "way", "relation").agg(F.count("*").alias("k"))
    return k.withColumn("r", F.row_number().over(Window.partitionBy("id", "way").orderBy(F.desc("k"), "relation"))).where(F.col("r") <= most).drop("r")


def rank_nodes(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Nodes by 0.6 votes + 0.4 degree, each by its greatest; ties by seq."""
    v = edges.groupBy(F.col("src").alias("id")).agg(F.sum("vote_count").alias("votes"))
    n = nodes.select("id", "seq").join(v, "id").join(degrees(nodes, edges).where("degree > 0"), "id")
    top = n.agg(F.max("votes").alias("mv")).join(degrees(nodes, edges).agg(F.max("degree").alias("md")))
    return n.join(F.broadcast(top)).withColumn("score", 0.6 * F.col("votes") / F.col("mv") + 0.4 * F.col("degree") / F.col("md")).orderBy(F.desc("score"), "seq").limit(most)


def hub_ranks(edges: DataFrame, threshold: int = fixed.HUB_DEGREE) -> DataFrame:
    """(src, dst, rank) of the out-edges of hubs, by dst, from 0. A hub's edges are cut into ranges; edges of other nodes don't move to it."""
    hubs = edges.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") > threshold).select("src")
    e = ranked(edges.join(hubs, "src", "left_semi").select("src", "dst"), "src", ["dst"])
    return e.select("src", "dst", (F.col("rank") - 1).alias("rank"))


def session_edges(rows: DataFrame) -> DataFrame:
    """(session, src, relation, dst, n): relations of each session in lower case, once each, with how often they came."""
    low = [F.lower(c).alias(c) for c in KEYS]
    return rows.select("session", *low).groupBy("session", *KEYS).agg(F.count("*").alias("n"))


def profiles(nodes: DataFrame, edges: DataFrame, data_props: DataFrame, shared: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(id, profile): candidates() as text; with shared (a, b, shared), also the entities that come together with it most often."""
    c = candidates(nodes, edges, data_props)
    parts = [F.concat(F.lit("parent: "), "parent"), *(F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in ("children", "relations", "properties"))]
    if shared is not None:
        both = shared.select(F.col("a").alias("id"), F.col("b").alias("other"), "shared").unionByName(shared.select(F.col("b").alias("id"), F.col("a").alias("other"), "shared"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "other"))
        top = both.withColumn("r", rank).where(F.col("r") <= most).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x.other), ", ").alias("together"))
        c = c.join(top, "id", "left")
        parts.append(F.concat(F.lit("with: "), "together"))
    return c.select("id", F.concat_ws("; ", *parts).alias("profile"))


def session_nodes(rows: DataFrame) -> DataFrame:
    """Concepts of each session in lower case, with how often they came."""
    return rows.groupBy("session", F.lower("concept").alias("node")).agg(F.count("*").alias("k"))
