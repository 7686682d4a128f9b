"""Strongly connected components: nodes without in- or out-edges are raked off, nodes with one of each are compressed, and what is left is
coloured forward and searched backward. Chains and trees of any depth take a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored


def _degrees(e: DataFrame) -> DataFrame:
    """(node, i, o): different in- and out-neighbours."""
    ends = F.explode(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    return e.select(ends.alias("x")).groupBy("x.node").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))


def _rake_and_compress(e: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """One round on edges (u, v) without loops: the edges left, what was compressed (v between u and w), and how many nodes went.

    Of neighbours with one in- and one out-edge the one with the largest hash goes, so that no two neighbours go at once."""
    deg = stored(_degrees(e), "degrees")
    live = deg.where("i > 0 and o > 0").select("node", ((F.col("i") == 1) & (F.col("o") == 1)).alias("mid"))
    at = lambda c, m: live.select(F.col("node").alias(c), F.col("mid").alias(m))
    kept = stored(e.join(at("u", "u_mid"), "u").join(at("v", "v_mid"), "v"), "kept")
    turn = lambda c: F.struct(F.xxhash64(c), F.col(c))
    # a middle node beats the neighbour at an edge if that isn't one, or has a smaller turn
    into = kept.where("v_mid").select(F.col("v").alias("x"), "u", (~F.col("u_mid") | (turn("v") > turn("u"))).alias("wins_u"))
    onward = kept.where("u_mid").select(F.col("u").alias("x"), F.col("v").alias("w"), (~F.col("v_mid") | (turn("u") > turn("v"))).alias("wins_w"))
    gone = stored(into.join(onward, "x").where("wins_u and wins_w").select("x", "u", "w"), "compressed")
    rest = kept.join(gone.select(F.col("x").alias("u")), "u", "left_anti").join(gone.select(F.col("x").alias("v")), "v", "left_anti").select("u", "v")
    left = stored(rest.unionByName(gone.select("u", F.col("w").alias("v"))).distinct(), "edges")
    went = deg.where("i = 0 or o = 0").count() + gone.count()
    return left, gone, went


def _coloured(e: DataFrame) -> DataFrame:
    """(node, label) of some components of edges (u, v), at least one: each node takes the largest label that reaches it; of each label, the nodes that reach the node of that name are one."""
    state = stored(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        came = e.join(state.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.max("label").alias("came"))
        new = stored(state.join(came, "node", "left").select("node", F.greatest("label", F.coalesce("came", "label")).alias("label"), (F.col("came") > F.col("label")).alias("up")), "labels")
        state = new.select("node", "label")
        if new.where("up").isEmpty():
            break
    inside = e.join(state.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(state.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v").where("lu = lv").select("u", "v")
    inside = stored(inside, "inside")
    found = front = stored(state.where("node = label"), "found")
    while True:
        back = inside.join(front.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label").distinct()
        front = stored(back.join(found, "node", "left_anti"), "front")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that lies on a cycle, loops included; component is the smallest node that it reaches and that reaches it.

    Nodes on no cycle have no row; null ends make no edge; repeated edges are one. A round rakes off nodes without in- or out-edges and
    compresses a share of the chains; rounds go on while one takes a tenth of the nodes or more, or the edges left are few enough to be raked to the end. What
    is left is coloured, which takes as many rounds as a shortest path in it is long; the components found go, and so on. Compressed nodes are in the component of
    both their neighbours, if that is one. Each round is written, and only counts come to the driver.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    e = stored(e, "edges")
    loops, compressed, found = [e.where("u = v").select(F.col("u").alias("node"))], [], []
    e = e.where("u != v")
    while not e.isEmpty():
        while True:
            e, gone, went = _rake_and_compress(e)
            compressed.append(gone)
            loops.append(gone.where("u = w").select(F.col("u").alias("node")))
            e = e.where("u != v")
            if not went or e.isEmpty():
                break
        if e.isEmpty():
            break
        part = _coloured(e)
        # a component of one node is no cycle here: loops are counted apart
        many = part.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        found.append(stored(part.join(many, "label", "left_semi").select("node", "label"), "component"))
        e = stored(e.join(part.select(F.col("node").alias("u")), "u", "left_anti").join(part.select(F.col("node").alias("v")), "v", "left_anti"), "edges")
    labels = None
    for f in found:
        labels = f if labels is None else labels.unionByName(f)
    every = loops[0]
    for x in loops[1:]:
        every = every.unionByName(x)
    alone = every.distinct().select("node", F.col("node").alias("label"))
    labels = alone if labels is None else labels.unionByName(alone.join(labels.select("node"), "node", "left_anti"))
    labels = stored(labels, "labels")
    for gone in reversed(compressed):
        ends = gone.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("node").alias("w"), F.col("label").alias("lw")), "w").where("lu = lw")
        # a compressed node with a loop of its own stood for itself until now
        more = ends.select(F.col("x").alias("node"), F.col("lu").alias("label"))
        more = stored(more, "labels")
        if not more.isEmpty():
            labels = stored(labels.join(more.select("node"), "node", "left_anti").unionByName(more), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): the different edges that lie on a cycle, both ends in one component; empty if and only if there is no cycle."""
    e = edges.select("src", "dst").distinct()
    c = strong_components(e)
    ends = e.join(c.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    return ends.where("a = b").select("src", "dst")
