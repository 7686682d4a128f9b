"""Fixpoints over edges: closures, levels. Loops are semi-naive, each round's rows go to a scratch table, and only counts reach the driver."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored


#: Edges that one task closes by itself: schemas, whose closure has at most the square of that many rows. Larger relations are closed in rounds, with the same result.
FEW = 2000


def _close(batches):
    """The closure of a task's edges, one source after another."""
    import pandas as pd

    out: dict = {}
    for b in batches:
        for r, a, z in zip(b.relation, b.src, b.dst, strict=True):
            out.setdefault(r, {}).setdefault(a, set()).add(z)
    for r, to in out.items():
        for a in to:
            seen, front = set(), set(to[a])
            while front:
                seen |= front
                front = set().union(*(to.get(x, ()) for x in front)) - seen
            yield pd.DataFrame({"relation": r, "src": a, "dst": sorted(seen)})


def transitive_closure(edges: DataFrame, include_self: bool = False, max_rounds: int = 64) -> DataFrame:
    """(relation, src, dst) reachable over one or more edges of one relation. Paths double in length each round, so the rounds
    are the logarithm of the longest path; members of cycles reach themselves, which include_self keeps."""
    base = stored(edges.select("relation", "src", "dst").distinct(), "closure")
    if base.count() <= FEW:
        every = base.coalesce(1).mapInPandas(_close, "relation string, src string, dst string") if dict(base.dtypes)["src"] == "string" else None
        if every is not None:
            every = stored(every, "closure")
            return every if include_self else every.where("src != dst")
    every = delta = base
    for _ in range(max_rounds):
        left = delta.select("relation", "src", F.col("dst").alias("mid")).join(every.select("relation", F.col("src").alias("mid"), "dst"), ["relation", "mid"]).select("relation", "src", "dst")
        right = every.select("relation", "src", F.col("dst").alias("mid")).join(delta.select("relation", F.col("src").alias("mid"), "dst"), ["relation", "mid"]).select("relation", "src", "dst")
        new = stored(left.unionByName(right).distinct().join(every, ["relation", "src", "dst"], "left_anti"), "delta")
        if new.isEmpty():
            break
        every, delta = every.unionByName(new), new
    else:
        raise RuntimeError(f"the closure still grew after {max_rounds} rounds")
    return every if include_self else every.where("src != dst")


def bfs_levels(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, directed: bool = True) -> DataFrame:
    """(node, level): the fewest edges from any start (column node), level by level; of at most max_depth edges, if that is given."""
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("node"))
    if not directed:
        step = step.unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("node")))
    step = step.where("at is not null and node is not null").distinct()
    seen = frontier = stored(starts.select("node").distinct().withColumn("level", F.lit(0)), "levels")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = frontier.select(F.col("node").alias("at")).join(step, "at").select("node").distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(depth))
        new = stored(new, "frontier")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen
