"""Repair of a fragmented graph, and gaps that web pages fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import stored
from .contain import in_texts
from .quality import degrees, node_components
from .reason import KEYS, infer
from .vector import bridge_components, link_orphans


def add_root(nodes: DataFrame, edges: DataFrame, root: str = "DomainRoot") -> DataFrame:
    """subClassOf edges from classes without any edge to the root."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.where((F.col("kind") == "class") & (F.col("id") != root)).join(ends, "id", "left_anti").select(F.col("id").alias("src"), F.lit("subClassOf").alias("relation"), F.lit(root).alias("dst"))


def repair(nodes: DataFrame, edges: DataFrame, axioms: DataFrame, root: str = "DomainRoot", iterations: int = 1) -> DataFrame:
    """(src, relation, dst, step): edges that a repair adds: root, orphans, bridges, inference, orphans again. Nodes: id, seq, kind, type, description."""
    known, added = stored(edges.select(*KEYS).distinct(), "known"), None
    nodes = nodes.unionByName(nodes.limit(1).select(F.lit(-1).cast("long").alias("seq"), F.lit(root).alias("id"), F.lit("Class").alias("type"), F.lit("class").alias("kind"), F.lit("root").alias("description")), allowMissingColumns=True).dropDuplicates(["id"])
    for _ in range(iterations):
        for step in ("root", "orphans", "bridges", "inference", "orphans_again"):
            if step == "root":
                new = add_root(nodes, known, root)
            elif step == "bridges":
                new = bridge_components(nodes, known)
            elif step == "inference":
                new = infer(known, axioms)
            else:
                new = link_orphans(nodes, known)
            new = stored(new.select(*KEYS).distinct().join(known, KEYS, "left_anti").withColumn("step", F.lit(step)), "repair")
            added = new if added is None else added.unionByName(new)
            known = known.unionByName(new.select(*KEYS))
    return added


def repair_incremental(nodes: DataFrame, edges: DataFrame, root: str = "DomainRoot") -> DataFrame:
    """(src, relation, dst, step): what a merge needs at once: the root above classes without edges, and links of orphans."""
    new = add_root(nodes, edges, root).withColumn("step", F.lit("root"))
    links = link_orphans(nodes.where(F.col("kind") != "class"), edges).select(*KEYS).withColumn("step", F.lit("orphans"))
    return new.unionByName(links)


def component_pairs(nodes: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """(src, dst): representatives of smaller components, each with the largest one's, the largest components first. A component's
    representative is its node with most edges, ties by seq."""
    comp = stored(node_components(nodes, edges).join(degrees(nodes, edges), "id").join(nodes.select("id", "seq"), "id"), "components")
    rep = comp.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("degree")).alias("d"), "seq", "id")).alias("r")).select("component", "n", "r.id", "r.seq")
    big = rep.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("_c"), F.col("id").alias("dst"))
    return rep.join(F.broadcast(big)).where("component != _c").orderBy(F.desc("n"), "component").limit(most).select(F.col("id").alias("src"), "dst")


def gaps(nodes: DataFrame, most: int = 15) -> DataFrame:
    """(id, seq): concepts without a description, not noise, the first of each name by seq."""
    rows = nodes.where((F.coalesce("description", F.lit("")) == "") & ~text.is_noise("id"))
    first = rows.groupBy(F.lower(F.trim("id")).alias("key")).agg(F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq"))
    return first.select("id", "seq").orderBy("seq").limit(most)


def fill_gaps(gap_rows: DataFrame, pages: DataFrame, least: int = 50) -> DataFrame:
    """(id, page_id, content): for each gap the first page of its query, else the first page whose query contains its name; pages (page_id, query, content) of least characters. Names and queries meet in a containment join."""
    p = pages.where(F.length("content") >= least)
    g = gap_rows.select("id")
    exact = p.join(g, F.col("query") == F.col("id")).withColumn("how", F.lit(0))
    names = g.select("id", F.lower("id").alias("pattern"))
    asked = in_texts(p.select(F.lower("query").alias("low")), names, "low").withColumnRenamed("text", "low").join(names, "pattern").select("low", "id")
    part = p.withColumn("low", F.lower("query")).join(asked, "low").select(*exact.columns[:-1]).withColumn("how", F.lit(1))
    best = exact.unionByName(part).groupBy("id").agg(F.min(F.struct("how", "page_id", "content")).alias("b"))
    return gap_rows.select("id").join(best, "id", "left").select("id", "b.page_id", "b.content")


def diagnosis(health: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """One row: gaps and a recommendation."""
    n = gap_rows.agg(F.count("*").alias("gaps"))
    rec = F.when(F.col("orphans") > 0, "link orphans").when(F.col("components") > 3, "bridge components").when(F.col("gaps") > 0, "define concepts").otherwise("none")
    return health.join(n).select("gaps", "orphans", "components", rec.alias("recommendation"))
